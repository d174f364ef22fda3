"""Mixing sources to target weights by hash-random keys, range sort and distributed prefix sums.

Each row has a hash-random key. Within its source, rows are ranged by key into fixed key ranges
(4096 a source), each range is sorted and summed on its own, and the ranges' sums give each range
its offset: a prefix sum in which no task holds a whole source. A source's budget is its target
rounded; the mix takes whole epochs while they fit, then rows in key order, and cuts the row at
which the budget ends, so a source's taken words are its budget exactly.

Targets: the total is SHARE times all sizes, shared by weight (3, 1, 2, repeating over the sources
by code point, null last); targets stop at CAP times their source's size, and what is cut off is
shared again by weight until none is above (in closed form: sources sorted by cap over weight).

Defined results: null text has size 0; null source is a source of its own, last; a null doc_id has
a key like any other, for the text counts too; rows of equal key are ordered by their content, so that reruns agree (rows
equal in all columns cannot be told apart); other columns are ignored by plan() and kept by mix(); an empty table gives
an empty table. plan() counts rows of one doc_id and text once and sums them up, so that a third of all rows may be one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_BREAK, pick, saved

WEIGHTS = (3, 1, 2)
CAP = 2
#: SHARE is 3 / 2; targets are computed in halves, in whole numbers until the last division.
SHARE_HALVES = 3
#: Hexadecimal digits of the key that name its range.
RANGE_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of sizes (source, source_size): one row a source, no more."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    order = W.orderBy((F.col("source_size") / F.col("w")), F.col("source").isNull(), "source")
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rank = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int")).cast("long"))
    s = s.select("source", "source_size", "w", (total * SHARE_HALVES).alias("t2"),
                 F.coalesce(F.sum(F.col("source_size") * 2 * CAP).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("c2"),
                 F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("wrest"))
    # the first row whose level is not above its own cap sets the level for itself and all after
    fits = (F.col("t2") - F.col("c2")) * F.col("w") <= F.col("source_size") * 2 * CAP * F.col("wrest")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", F.min(F.when(fits, F.struct("c2", "t2", "wrest"))).over(every))
    level = (F.col("level.t2") - F.col("level.c2")) * F.col("w") / (F.col("level.wrest") * F.lit(2.0))
    return s.select("source", "source_size", F.when(fits, level).otherwise((F.col("source_size") * CAP).cast("double")).cast("double").alias("target"))


def ranges_of(d: DataFrame) -> DataFrame:
    """mix_source, mix_range, range_before, source_size, target of rows with a size (times n, where they have that)."""
    size = F.col("size") * F.col("n") if "n" in d.columns else F.col("size")
    sums = d.groupBy("mix_source", "mix_range").agg(F.first("source").alias("source"), F.sum(size).alias("range_size"))
    sizes = sums.groupBy("mix_source").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    goal = targets(sizes.select("source", "source_size")).withColumn("mix_source", source_key(F.col("source"))).drop("source")
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("mix_source").orderBy("mix_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("range_before", before).join(goal, "mix_source").drop("source", "range_size")


def taken_of(row_before: Column) -> Column:
    """Words taken of a row that has row_before words of its range before it."""
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("range_before") - row_before
    return (epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long")


def keyed(d: DataFrame) -> DataFrame:
    d = d.withColumns({"size": size_of(F.col("text")), "mix_key": key_of(F.col("doc_id"), F.col("text")), "mix_source": source_key(F.col("source"))})
    return d.withColumn("mix_range", F.substring("mix_key", 1, RANGE_DIGITS))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row. Texts are read once: what the plan needs of them is
    written, rows of one key as one with their number."""
    d = keyed(pick(docs, doc_id="long", text="string", source="string"))
    d = saved(d.groupBy("mix_source", "mix_range", "mix_key", "doc_id", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")), "mix-sizes")
    here = W.partitionBy("mix_source", "mix_range").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("row_before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(here), F.lit(0))).join(ranges_of(d), ["mix_source", "mix_range"])
    d = d.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return d.select("doc_id", "source", "size", "source_size", "target", taken_of(F.col("row_before") + F.col("turn") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each whole epoch, and its first words where the budget ends in it. Rows equal
    in doc_id and text are ordered by their other columns; those of one key are one range of a source."""
    columns = docs.columns
    own = {c: f"mix_own{k}" for k, c in enumerate(columns)}
    have = {c.lower(): c for c in columns}
    known = [(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("text", "string"), ("source", "string"))]
    d = keyed(docs.select(*known, *[F.col(f"`{c}`").alias(own[c]) for c in columns]))
    content = F.xxhash64(*[own[c] for c, kind in docs.dtypes if "map<" not in kind])
    here = W.partitionBy("mix_source", "mix_range").orderBy("mix_key", "doc_id", "size", content).rowsBetween(W.unboundedPreceding, -1)
    planned = d.withColumn("row_before", F.coalesce(F.sum("size").over(here), F.lit(0))).join(ranges_of(d), ["mix_source", "mix_range"])
    planned = planned.withColumn("taken", taken_of(F.col("row_before")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = planned.withColumn("mix_cut", F.explode(copies))
    words = F.array_join(F.slice(F.filter(F.split("text", WORD_BREAK), lambda w: w != ""), 1, F.col("mix_cut").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("mix_cut") > 0, words).otherwise(F.col("text")))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("mix_cut") > 0, F.length("text").cast("long")).otherwise(F.col(own["n_chars"])) if "n_chars" in own else None}
    return rows.select(*[(F.col(own[c]) if made.get(c) is None else made[c]).alias(c) for c in columns])


def digests(docs: DataFrame) -> DataFrame:
    """The columns of op8."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::BIGINT AS w FROM s),
o AS (SELECT *, (3 * sum(source_size) OVER ())::BIGINT AS t2,
             coalesce(sum(4 * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c2,
             sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wrest FROM r),
f AS (SELECT *, (t2 - c2) * w <= 4 * source_size * wrest AS fits FROM o),
l AS (SELECT c2, t2, wrest FROM f WHERE fits ORDER BY c2, t2, wrest LIMIT 1),
g AS (SELECT f.source, f.source_size,
             CASE WHEN fits THEN ((l.t2 - l.c2) * f.w) / (l.wrest * 2.0::DOUBLE) ELSE (2 * f.source_size)::DOUBLE END AS target FROM f, l),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken, source
FROM p"""
