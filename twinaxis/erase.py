"""Erasure by destroying keys, and the purge verbs around it.

Postings are sealed with a key of their subject (AES-256-GCM). Destroying the
key makes them unreadable wherever copies lie. Facts themselves are not sealed:
READ still returns a shredded subject's datoms unless asked to hide them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import KeyDestroyed, NoBound, UnknownSubject

KEYS = "subject string, handle binary, key binary, destroyed boolean"


class Keystore:
    """subject -> (handle, key); destroyed handles stay known, so destroyed and unknown differ."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, {}
        self.current: dict[str, bytes] = {}

    def allocate(self, subject: str) -> bytes:
        """The handle of a subject's key; after a shred a new one."""
        if subject not in self.current:
            handle = os.urandom(16)
            self.rows[handle] = [subject, os.urandom(32)]
            self.current[subject] = handle
        return self.current[subject]

    def fetch(self, handle: bytes) -> bytes:
        if handle not in self.rows:
            raise UnknownSubject("no key was ever allocated under that handle")
        if self.rows[handle][1] is None:
            raise KeyDestroyed("the key under that handle was destroyed")
        return self.rows[handle][1]

    def destroy(self, handle: bytes) -> None:
        self.fetch(handle)
        subject = self.rows[handle][0]
        self.rows[handle][1] = None
        if self.current.get(subject) == handle:
            del self.current[subject]

    def shred(self, subject: str) -> None:
        if subject not in self.current:
            raise UnknownSubject(f"{subject} has no key")
        self.destroy(self.current[subject])

    def table(self) -> DataFrame:
        rows = [(s, bytearray(h), None if k is None else bytearray(k), k is None) for h, (s, k) in self.rows.items()]
        return self.spark.createDataFrame(rows, KEYS)


def allocate_all(subjects: DataFrame) -> DataFrame:
    """A key table with a live key for each of the distinct subjects; keys are random, so write the table before using it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(s, os.urandom(16), os.urandom(32), False) for s in pdf["subject"]]
            yield pd.DataFrame(made, columns=["subject", "handle", "key", "destroyed"])

    return subjects.select("subject").mapInPandas(run, KEYS)


def destroy_of(keys: DataFrame, subject: str) -> DataFrame:
    """The key table after the subject's keys are destroyed; their handles stay known."""
    gone = F.col("subject") == subject
    return keys.select("subject", "handle", F.when(~gone, F.col("key")).alias("key"), (F.col("destroyed") | gone).alias("destroyed"))


def seal(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """(handle, sealed): postings (subject, term) under their subjects' live keys."""
    x = postings.join(keys.where("not destroyed"), "subject")
    return x.select("handle", F.aes_encrypt(F.to_json(F.struct("subject", "term")), "key", F.lit("GCM")).alias("sealed"))


def open_(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """(subject, term) of the postings that can still be read; the others vanish without a count."""
    x = sealed.join(keys.where("not destroyed").select("handle", "key"), "handle")
    plain = F.from_json(F.try_aes_decrypt("sealed", "key", F.lit("GCM")).cast("string"), "subject string, term string").alias("p")
    return x.select(plain).where("p is not null").select("p.subject", "p.term")


@dataclass
class Obligations:
    """What is still owed, oldest first; raising again keeps the first time."""

    rows: dict[tuple[str, str], int] = field(default_factory=dict)

    def raise_(self, kind: str, subject: str, at: int) -> None:
        self.rows.setdefault((kind, subject), at)

    def acknowledge(self, kind: str, subject: str) -> None:
        self.rows.pop((kind, subject), None)

    def outstanding(self) -> list[tuple[str, str, int]]:
        return sorted(((k, s, at) for (k, s), at in self.rows.items()), key=lambda r: (r[2], r[:2]))


class Purge:
    """mark, shred and sweep; only shred erases. Sinks that cannot forget stay outstanding."""

    def __init__(self, keys: Keystore, sinks: dict[str, object]):
        self.keys, self.sinks = keys, sinks

    def _fan_out(self, subject: str) -> tuple[str, list[str]]:
        left = []
        for name, sink in self.sinks.items():
            forget = getattr(sink, "forget", None)
            if forget is None or forget(subject) is False:
                left.append(name)
        return ("incomplete" if left else "done"), left

    def mark(self, subject: str) -> tuple[str, list[str]]:
        return self._fan_out(subject)

    def shred(self, subject: str) -> tuple[str, list[str]]:
        try:
            self.keys.shred(subject)
        except UnknownSubject:
            return "refused", []
        return self._fan_out(subject)

    def sweep(self, datoms: DataFrame, horizon: int) -> DataFrame:
        """Datoms whose validity ended before the horizon: what a sweep would take out of view."""
        if horizon <= 0:
            raise NoBound("a sweep needs a horizon")
        return datoms.where(F.col("valid_to") <= horizon)


def erased_subjects(keys: DataFrame) -> DataFrame:
    """(subject) with a destroyed key and no live one."""
    return keys.groupBy("subject").agg(F.min("destroyed").alias("gone")).where("gone").select("subject")


def hide_erased(datoms: DataFrame, keys: DataFrame) -> DataFrame:
    """Datoms without those of erased subjects."""
    return datoms.join(erased_subjects(keys).withColumnRenamed("subject", "entity"), "entity", "left_anti")
