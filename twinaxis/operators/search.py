"""Ranked text search with exact facets.

A posting is one occurrence of a term in an asserted literal. The score of a
subject is the sum over the query's terms of n * ln(1 + total / df), n being its
own postings of the term, df all postings of the term and total all postings.

rank() counts terms in texts; rank_indexed() reads them from a stored index
(sources/postings.py), of which only the query's terms are scanned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FacetTooWide, NoFacetBound, NoLimit, NoQuery
from ..functions.text import analyze, query_terms
from .carried import carried, latest
from .temporal import Snapshot, visible


#: What an index keeps of a datom: all but its value.
FACTS = ["tenant", "entity", "attribute", "is_reference", "valid_from", "valid_to", "assert", "tx", "ord"]


def literals(datoms: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Datoms that have postings: asserted, no references, of the attributes if any are named."""
    out = datoms.where(F.col("assert") & ~F.col("is_reference"))
    return out.where(F.col("attribute").isin(*attributes)) if attributes else out


def postings(datoms: DataFrame) -> DataFrame:
    """(subject, term, tx_from, tx_until): the index as a table, one row an occurrence."""
    return literals(datoms).select(
        F.col("entity").alias("subject"), F.explode(analyze(F.col("value"))).alias("term"), F.col("tx").alias("tx_from"), F.lit(None).cast("struct<wall:bigint,logical:bigint,leaf_prefix:binary,leaf_depth:smallint,seq:bigint>").alias("tx_until")
    )


def _occurrences(term: str) -> Column:
    return F.size(F.filter("t", lambda x: x == term))


def rank(rows: DataFrame, query: str, limit: int, erased: DataFrame | None = None) -> DataFrame:
    """(subject, score) of the best subjects among rows (entity, value), best first.

    erased (subject) takes subjects out without a word; they still count in total.
    """
    terms = query_terms(query)
    if not terms:
        raise NoQuery("the query has no terms")
    if limit <= 0:
        raise NoLimit("a search needs a positive limit")
    tokens = rows.select(F.col("entity").alias("subject"), analyze(F.col("value")).alias("t"))
    counted = tokens.select("subject", F.size("t").alias("n"), *[_occurrences(w).alias(f"n{i}") for i, w in enumerate(terms)])
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(terms))]
    by_subject = counted.groupBy("subject").agg(F.sum("n").alias("n"), *sums)
    seen = by_subject if erased is None else by_subject.join(erased.select("subject"), "subject", "left_anti")
    # Corpus statistics are one row of numbers; they become constants of the second pass.
    total = by_subject.agg(F.sum("n").alias("n"), *sums).first()
    df = total if erased is None else seen.agg(*sums).first()
    return _best(seen, total["n"], [df[f"n{i}"] for i in range(len(terms))], limit)


def _best(counts: DataFrame, total: int, df: list[int | None], limit: int) -> DataFrame:
    """The best of counts (subject, n0, n1, ...)."""
    weights = [math.log1p(total / n) if n else 0.0 for n in df]
    hits = counts.where(" or ".join(f"n{i} > 0" for i in range(len(df))))
    score = sum((F.col(f"n{i}") * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))
    return hits.select("subject", score.alias("score")).orderBy(F.desc("score"), "subject").limit(limit)


def rank_indexed(index, query: str, limit: int, erased: DataFrame | None = None, attributes: tuple[str, ...] = (), at: Snapshot | None = None) -> DataFrame:
    """rank() through an index (postings, facts), of all history or of what is carried at a snapshot.

    At a snapshot the facts of subjects with a term of the query are reduced;
    texts are not read.
    """
    terms = query_terms(query)
    if not terms:
        raise NoQuery("the query has no terms")
    if limit <= 0:
        raise NoLimit("a search needs a positive limit")
    facts = index.facts
    if (attributes, at) not in index.totals:
        counted = literals(facts if at is None else carried(facts, at), attributes)
        index.totals[attributes, at] = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    # One row a fact with a term of the query, by its place in the index: two numbers.
    place, found = ["block", "slot"], index.places.where(F.col("term").isin(*terms))
    found = found.groupBy(*place).agg(*[F.sum(F.when(F.col("term") == w, F.col("n")).otherwise(0)).alias(f"n{i}") for i, w in enumerate(terms)])
    if at is not None:
        near = facts.select("entity", *place).join(found.select(*place), place, "left_semi").select("entity").distinct()
        facts = carried(facts.join(near, "entity", "left_semi"), at)
    held = literals(facts, attributes).select(F.col("entity").alias("subject"), *place)
    counts = found.join(held, place).groupBy("subject").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(terms))])
    if erased is not None:
        counts = counts.join(erased.select("subject"), "subject", "left_anti")
    df = counts.agg(*[F.sum(f"n{i}") for i in range(len(terms))]).first()
    return _best(counts, index.totals[attributes, at], list(df), limit)


def match(index: DataFrame, query: str, limit: int) -> DataFrame:
    """Up to limit postings of an index (subject, term) with a term of the query, unranked."""
    if limit <= 0:
        raise NoLimit("a search needs a positive limit")
    return index.where(F.col("term").isin(*query_terms(query))).limit(limit)


def confirm(hits: DataFrame, datoms: DataFrame, query: str, at: Snapshot, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Hits that carry a term of the query at the snapshot; scores stay."""
    terms = F.array(*[F.lit(t) for t in query_terms(query)])
    held = literals(carried(datoms.join(hits.select(F.col("subject").alias("entity")), "entity", "left_semi"), at), attributes)
    return hits.join(held.where(F.arrays_overlap(analyze(F.col("value")), terms)).select(F.col("entity").alias("subject")).distinct(), "subject", "left_semi")


def search(datoms: DataFrame, query: str, limit: int, attributes: tuple[str, ...] = (), at: Snapshot | None = None, erased: DataFrame | None = None, index=None) -> DataFrame:
    """SEARCH. With a snapshot only visible facts of the attributes count and hits are confirmed;
    without one the whole history of all attributes does. An index of the datoms is used if given."""
    if index is not None:
        return rank_indexed(index, query, limit, erased, attributes if at is not None else (), at)
    if at is None:
        return rank(literals(datoms), query, limit, erased)
    # Only subjects that carry a term can be hits, so what is visible and carried is what is ranked.
    return rank(literals(carried(datoms, at), attributes), query, limit, erased)


@dataclass(frozen=True)
class Facet:
    """Exact counts of an attribute's values over matched subjects; total counts those without a value too."""

    values: DataFrame  # value, count
    total: int


def facet(hits: DataFrame, values: DataFrame, bound: int) -> DataFrame:
    """(value, count) over hits (subject) of values (entity, value); exact or refused."""
    return facet_of(hits, values, bound).values


def facet_of(hits: DataFrame, values: DataFrame, bound: int) -> Facet:
    """The facet over hits (subject) of values (entity, value); exact or refused."""
    if bound <= 0:
        raise NoFacetBound("a facet needs a positive bound")
    total = hits.select("subject").limit(bound + 1).count()
    if total > bound:
        raise FacetTooWide(f"the matched set is larger than {bound}")
    own = values.select(F.col("entity").alias("subject"), "value")
    counts = hits.select("subject").join(own, "subject").groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return Facet(counts, total)


def facet_values(datoms: DataFrame, attribute: str) -> DataFrame:
    """(entity, value): the last recorded datom of each entity whatever its validity, if asserted."""
    return latest(datoms.where(F.col("attribute") == attribute)).where(F.col("assert")).select("entity", "value")


__all__ = ["FACTS", "Facet", "confirm", "facet", "facet_of", "facet_values", "literals", "match", "postings", "rank", "rank_indexed", "search", "visible"]
