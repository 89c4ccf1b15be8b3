"""Language identification of web pages by Bayesian evidence fusion.

Each page has four pieces of evidence: its text, the language its markup
declares, the suffix of its address, and its host.

1. Text: likelihoods of hashed character trigrams of the page's main text, per
   language, from a bounded sample of labelled documents. Long texts are
   tempered, for their trigrams are not independent.
2. From the texts alone every page gets a posterior; grouped sums of these
   soft counts give, for the whole table, how often each language occurs, what
   each language's pages declare, and the languages of suffixes and hosts.
3. Priors are smoothed down the hierarchy: the corpus for a suffix, the suffix
   for a host. A page's own share is taken off before, so it is no evidence for
   itself.
4. Posterior = text likelihood x probability of the declaration given the
   language x host prior.

Defined results: every row gives one row. A null or empty html has no text
evidence and no declaration; a null or odd url has the empty host and suffix;
repeated ids give a row each; of languages that are equally likely the first by
name counts, and text_lang is null where the text favours none; columns beside page_id, url and html are ignored; without labelled
documents lang is null and confidence 0. Of documents that share an id the
smallest by language and text is learned from.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS = 1 << 16
#: Trigrams after which more text adds no certainty, and the weight of each prior level in pages.
TEMPER, KAPPA = 200, 5.0
FRAME, MAIN = ("script", "style", "nav", "footer", "head", "noscript", "template"), ("article", "main")
_OPENS = re.compile(rf"<!--|<({'|'.join(FRAME)})\b", re.I)
_MAIN_OPENS = re.compile(rf"<({'|'.join(MAIN)})\b[^<>]*>", re.I)
_CLOSES = re.compile(rf"-->|</({'|'.join(FRAME + MAIN)})\s{{0,100}}>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&[#\w]{1,40};")
_OTHER = re.compile(r"[\W\d_]+")


def _spans(html: str, opens: re.Pattern, closes: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, start of what is inside, its end, end) of elements, each up to the next closing tag of its name."""
    at = 0
    for m in opens.finditer(html):
        if m.start() < at:
            continue
        ends = closes.get((m[1] or "-->").lower(), ())
        k = bisect.bisect_left(ends, (m.end(), 0))
        if k < len(ends):
            yield m.start(), m.end(), *ends[k]
            at = ends[k][1]


def main_text(html: str) -> str:
    """The text of the article or main elements, else of the page without its frame; an element that
    is never closed counts as a tag alone. Closing tags are listed once, so time is linear."""
    closes: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSES.finditer(html):
        closes.setdefault((m[1] or "-->").lower(), []).append(m.span())
    parts = [html[a:b] for _, a, b, _ in _spans(html, _MAIN_OPENS, closes)]
    if not parts:
        at = 0
        for a, _, _, b in _spans(html, _OPENS, closes):
            parts.append(html[at:a])
            at = b
        parts.append(html[at:])
    return _ENTITY.sub(" ", _TAG.sub(" ", " ".join(parts)))


def trigrams(text: str) -> np.ndarray:
    t = f"  {_OTHER.sub(' ', text.lower())}  "
    c = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)[(c[1:-1] != 32)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, rows in pdf.groupby("lang"):
            n = np.zeros(BUCKETS, np.int64)
            for text in rows["text"]:
                n += np.bincount(trigrams(text), minlength=BUCKETS)
            own = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": own.astype(np.int32), "n": n[own]})


def fit_text(docs: DataFrame, sample_rows: int = 4000) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each trigram): from at most sample_rows texts, one an id, the smallest by a hash of the id."""
    rows = docs.where("text is not null and lang is not null and lang <> '' and doc_id is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("lang", "text").alias("t"))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t")).select("t.lang", "t.text")
    # Counted where the texts lie: the driver gets sums of at most BUCKETS numbers a language.
    sums = rows.repartition(16).mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.full((len(langs), BUCKETS), 0.05)
    counts[sums["lang"].map(langs.index).to_numpy(int), sums["bucket"].to_numpy(int)] += sums["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(np.frombuffer(held.value[1], np.float32).reshape(held.value[0], BUCKETS).T)
        for batch in batches:
            out = np.zeros((batch.num_rows, held.value[0]))
            for i, html in enumerate(batch.column("html").to_pylist()):
                g = trigrams(main_text(html)) if html else ()
                if len(g):
                    s = table[g].sum(axis=0, dtype=np.float64) / (1 + len(g) / TEMPER)
                    out[i] = s - s.max()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * held.value[0], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "declared", "suffix", "host")), lists], ["page_id", "declared", "suffix", "host", "text"])

    return run


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, html, declared, suffix, host; absent evidence is the empty string."""
    tag = F.regexp_extract("html", r"(?is)<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    meta = F.regexp_extract("html", r"(?is)<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.when(tag != "", tag).otherwise(meta))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "html",
        F.coalesce(declared, F.lit("")).alias("declared"),
        F.coalesce(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), F.lit("")).alias("suffix"),
        F.coalesce(host, F.lit("")).alias("host"),
    )


def _softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(spark: SparkSession, pages: DataFrame, docs: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, suffix, host of each row of pages (page_id, url, html).

    Sums per host, suffix and declaration are aggregated with map-side combine;
    the joins back are by host, which AQE splits where a host is hot.
    """
    langs, table = fit_text(docs, sample_rows)
    n = len(langs)
    if not n:
        rows = evidence(pages)
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "suffix", "host")
    scratch = Scratch(spark, "languages")
    held = spark.sparkContext.broadcast((n, table.tobytes()))  # 256 KB a language
    rows = evidence(pages).mapInArrow(_likelihoods(held), "page_id long, declared string, suffix string, host string, text array<double>")
    rows = scratch.save(rows.withColumn("own", _softmax(F.col("text"))), "likelihoods")

    def sums(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("own")[i]) for i in range(n)]).alias("s"))

    def names(df: DataFrame, s: str) -> DataFrame:
        return df.withColumnRenamed("s", s)

    hosts = scratch.save(sums("suffix", "host"), "hosts")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def smoothed(counts: Column, above: Column) -> Column:
        return F.zip_with(counts, above, lambda c, p: (c + KAPPA * p) / (total(counts) + KAPPA))

    # Suffixes are names in the root zone and declarations two- or three-letter codes: both tables are small by nature.
    suffixes = names(hosts.groupBy("suffix").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s")), "suffix_s")
    corpus = hosts.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s")).first()
    corpus = [x or 0.0 for x in (corpus["s"] if corpus and corpus["s"] else [0.0] * n)]
    declared = names(sums("declared"), "declared_s")
    kinds = declared.count()
    corpus_col = F.array(*[F.lit(float(x)) for x in corpus])
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    x = rows.join(names(hosts, "host_s"), ["suffix", "host"]).join(suffixes, "suffix").join(declared, "declared")
    x = x.withColumn("all_s", minus(corpus_col, F.col("own")))
    for c in ("host_s", "suffix_s", "declared_s"):
        x = x.withColumn(c, minus(F.col(c), F.col("own")))
    x = x.withColumn("p_all", smoothed(F.col("all_s"), uniform))
    x = x.withColumn("p_suffix", smoothed(F.col("suffix_s"), F.col("p_all")))
    x = x.withColumn("p_host", smoothed(F.col("host_s"), F.col("p_suffix")))
    # P(declared | language); no declaration is a declaration like any other.
    x = x.withColumn("p_declared", F.zip_with("declared_s", "all_s", lambda d, a: (d + 1.0) / (a + 1.0 * max(1, kinds))))
    logits = F.zip_with(F.zip_with(F.col("text"), F.col("p_host"), lambda t, p: t + F.log(p)), F.col("p_declared"), lambda t, p: t + F.log(p))
    x = x.withColumn("logits", logits).withColumn("posterior", _softmax(F.col("logits")))
    names_ = F.array(*[F.lit(g) for g in langs])
    place = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    return x.select(
        "page_id",
        F.element_at(names_, place(F.col("posterior"))).alias("lang"),
        F.round(F.array_max("posterior"), 6).alias("confidence"),
        F.when(total(F.transform("text", F.abs)) > 0, F.element_at(names_, place(F.col("own")))).alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
