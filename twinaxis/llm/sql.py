"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"


def _closure(links: str, ids: str) -> str:
    """Common table expressions ending in comp(id, component_id) over links(a, b) in both directions."""
    return (
        f"links as ({links}), reach(id, far) as (select id, id from ({ids}) union select reach.id, links.b from reach join links on links.a = reach.far), "
        "comp as (select id, min(far) as component_id from reach group by id)"
    )


_COSINE = "list_cosine_similarity(x.embedding::double[], y.embedding::double[])"
_FINE = "embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0"

OP1 = (
    f"with recursive fine as (select vec_id, embedding from embeddings where {_FINE}), "
    + _closure(f"select x.vec_id as a, y.vec_id as b from fine x join fine y on x.vec_id <> y.vec_id where {_COSINE} >= 0.95", "select vec_id as id from embeddings")
    + " select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join comp on id = vec_id"
)

OP2 = (
    f"with recursive w as (select doc_id, {_WORDS} as w from documents), "
    "s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] "
    "else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w), "
    "g as (select doc_id, len(s) as n, hash(unnest(s)) as g from s), "
    + _closure(
        "select x.doc_id as a, y.doc_id as b from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))",
        "select doc_id as id from documents",
    )
    + " select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join comp on id = doc_id"
)

OP5 = (
    "with l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)), "
    f"k as (select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as key from l), "
    "d as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2), "
    "x as (select k.*, d.first is not null and d.first <> doc_id as gone from k left join d using (key)) "
    "select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from x group by doc_id"
)

OP9 = (
    f"with l as (select doc_id, {_WORDS} as w from documents), p as (select doc_id, unnest(w) as c, generate_subscripts(w, 1) as i from l), "
    "t as (select doc_id, i, c, lag(c) over o as b, lag(c, 2) over o as a from p window o as (partition by doc_id order by i)), "
    "o1 as (select doc_id, c, count(*) as n from t group by all), c1 as (select c, sum(n) as n from o1 group by all), "
    "o2 as (select doc_id, b, c, count(*) as n from t where b is not null group by all), c2 as (select b, c, sum(n) as n from o2 group by all), "
    "o3 as (select doc_id, a, b, c, count(*) as n from t where a is not null group by all), c3 as (select a, b, c, sum(n) as n from o3 group by all), "
    "x as (select t.doc_id, t.i, c1.n - o1.n as n1, h1.n - g1.n as m1, c2.n - o2.n as n2, h2.n - g2.n as m2, c3.n - o3.n as n3 from t "
    "join o1 on o1.doc_id = t.doc_id and o1.c = t.c join c1 on c1.c = t.c "
    "left join o1 g1 on g1.doc_id = t.doc_id and g1.c = t.b left join c1 h1 on h1.c = t.b "
    "left join o2 on o2.doc_id = t.doc_id and o2.b = t.b and o2.c = t.c left join c2 on c2.b = t.b and c2.c = t.c "
    "left join o2 g2 on g2.doc_id = t.doc_id and g2.b = t.a and g2.c = t.b left join c2 h2 on h2.b = t.a and h2.c = t.b "
    "left join o3 on o3.doc_id = t.doc_id and o3.a = t.a and o3.b = t.b and o3.c = t.c left join c3 on c3.a = t.a and c3.b = t.b and c3.c = t.c), "
    "s as (select doc_id, sum(case when n3 > 0 then ln(n3 / m2) when n2 > 0 then ln(n2 / m1) + case when i > 2 then ln(0.4) else 0 end "
    "else ln(greatest(n1, 0.5) / greatest(1, (select count(*) from t) - (select len(w) from l where l.doc_id = x.doc_id))) + least(i - 1, 2) * ln(0.4) end) as s from x group by doc_id) "
    "select l.doc_id, cast(len(w) as bigint) as n_words, round(coalesce(s, 0), 6) as log_score, round(coalesce(s, 0) / greatest(1, len(w)), 6) as mean_log_score from l left join s using (doc_id)"
)
