"""A keyed cache as tables: latest entry wins, entries expire, statistics; keys as digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(parts: dict[str, Column]) -> Column:
    """Digest of parts as JSON with sorted names, ", " and ": " between."""
    def value(c: Column) -> Column:
        return F.substr(F.to_json(F.struct(c.alias("v"))), F.lit(6))

    items = [F.concat(F.lit(f'"{k}": '), F.regexp_replace(value(parts[k]), r"\}$", "")) for k in sorted(parts)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")), 256)


def page_key(base: Column, page_index: Column) -> Column:
    return F.sha2(F.concat(base, F.lit(":page:"), page_index.cast("string")), 256)


def latest(entries: DataFrame) -> DataFrame:
    """Of each key the entry with the greatest timestamp (of equal ones the greatest data): an upsert. One aggregate, no sort."""
    return entries.groupBy("key").agg(F.max(F.struct("timestamp", "data", "metadata")).alias("e")).select("key", "e.data", "e.timestamp", "e.metadata")


def get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """key, data of the keys asked for; null where there is none."""
    return keys.join(latest(entries), "key", "left")


def get_or_compute(entries: DataFrame, wanted: DataFrame, compute) -> DataFrame:
    """Entries for wanted (key, and what compute needs): those there are, and compute(missing) for the rest."""
    known = latest(entries)
    missing = wanted.join(known.select("key"), "key", "left_anti")
    return known.join(wanted.select("key"), "key", "left_semi").unionByName(compute(missing))


def invalidate(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key"), "key", "left_anti")


def fresh(entries: DataFrame, now: float, days: float) -> DataFrame:
    """Entries that are not older than days."""
    return entries.where(F.col("timestamp") >= now - days * 86400.0)


def cleared(entries: DataFrame, now: float, days: float) -> DataFrame:
    """How many entries fresh() leaves out."""
    return entries.where(F.col("timestamp") < now - days * 86400.0).agg(F.count("*").alias("cleared"))


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("bytes"))
