"""Quality rules: learned decision lists on text statistics, as ordered Spark conditional expressions.

Statistics, rules and verdict are DataFrame expressions only. Learning is sequential covering on a
bounded sample of labelled rows' statistics: a rule grows by the threshold condition of most
information gain until it covers no good row, is pruned on rows held back, and is kept while it is
right on these; the rows it covers are set aside, and the next one grows.

Defined results: null or empty text has all counts 0 and fails the base rules; repeated rows each
give a row; null doc_id is kept; other columns are ignored; without labels the list is empty and
the base rules alone decide; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Labelled rows to learn from (those of least hash), rules in a list, conditions in a rule.
SAMPLE, RULES, CONDITIONS = 20_000, 12, 3
#: Thresholds tried a statistic; share of good rows below which a rule is kept; least rows covered.
THRESHOLDS, IMPURE, COVER = 48, 0.02, 5
BREAKS = " \t\n\x0b\x0c\r"
MARKS = "!?"
SYMBOLS = "#*$%&|<>"


def without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def repeats(h: Column, doubled: Column) -> Column:
    """Words covered by windows whose hash is found twice: doubled are (hash, place) in order."""
    places = F.array_sort(F.transform(doubled, lambda x: x["p"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks of every row."""
    d = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(without(x, BREAKS)) > 0)
    bare = without(F.col("text"), BREAKS)
    d = d.select(
        "doc_id",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "").alias("words"),
        lines.alias("lines"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(without(F.col("text"), MARKS))).cast("long").alias("n_marks"),
    )
    counts = ("word_chars", "n_symbols", "n_upper", "n_marks")
    window = F.when(
        F.size("words") >= 3,
        F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window.alias("h"), *counts)
    # hashes and places in order, for texts that have any window twice
    some = F.size(F.array_distinct("h")) < F.size("h")
    nothing = F.array().cast("array<struct<x:bigint,p:int>>")
    d = d.withColumn("o", F.when(some, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("p"))))).otherwise(nothing))
    d = d.withColumn("o", F.filter(F.col("o"), lambda s, i: F.coalesce(s["x"] == F.get("o", i - 1)["x"], F.lit(False)) | F.coalesce(s["x"] == F.get("o", i + 1)["x"], F.lit(False))))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats(F.col("h"), F.col("o")).alias("n_repeat_words"), "n_upper", "n_marks")


def features() -> dict[str, Column]:
    """Whole-number rates, so that thresholds mean the same everywhere."""
    rate = lambda c, per, k=1000: F.when(F.col(per) > 0, F.floor(F.col(c) * k / F.col(per))).otherwise(F.lit(0)).cast("long")
    return {
        "n_words": F.col("n_words"),
        "avg_word_c": rate("word_chars", "n_words", 100),
        "symbols_pm": rate("n_symbols", "word_chars"),
        "repeats_pm": rate("n_repeat_words", "n_words"),
        "dup_lines_pm": rate("n_dup_lines", "n_words"),
        "upper_pm": rate("n_upper", "word_chars"),
        "marks_pm": rate("n_marks", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    """A statistic not below (least) or not above a threshold."""

    name: str
    least: bool
    at: int

    def holds(self, row: dict[str, int]) -> bool:
        return row[self.name] >= self.at if self.least else row[self.name] <= self.at

    def column(self) -> Column:
        c = features()[self.name]
        return c >= self.at if self.least else c <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.least else '<='} {self.at}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet every condition are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, row: dict[str, int]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def thresholds(values: list[int]) -> list[int]:
    v = sorted(set(values))
    return v if len(v) <= THRESHOLDS else sorted({v[len(v) * k // THRESHOLDS] for k in range(THRESHOLDS)} | {v[-1]})


def grow(bad: list[dict], good: list[dict]) -> list[Condition]:
    """Conditions in the order they were added."""
    out: list[Condition] = []
    while good and bad and len(out) < CONDITIONS:
        base, best, gain = math.log2(len(bad) / (len(bad) + len(good))), None, 0.0
        for name in bad[0]:
            b, g = sorted(r[name] for r in bad), sorted(r[name] for r in good)
            i = j = 0
            for t in thresholds(b):
                while i < len(b) and b[i] < t:
                    i += 1
                while j < len(g) and g[j] < t:
                    j += 1
                upper = i
                while upper < len(b) and b[upper] <= t:
                    upper += 1
                above = j
                while above < len(g) and g[above] <= t:
                    above += 1
                for least, p, n in ((True, len(b) - i, len(g) - j), (False, upper, above)):
                    if p >= COVER and (new := p * (math.log2(p / (p + n)) - base)) > gain + 1e-9:
                        best, gain = Condition(name, least, t), new
        if best is None:
            break
        out.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return out


def worth(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[float, int, int]:
    p, n = sum(map(rule.holds, bad)), sum(map(rule.holds, good))
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn(rows: list[tuple[dict[str, int], bool]]) -> list[Rule]:
    """Rules that reject, from statistics and whether the row is good, every third row held back to prune."""
    grown = [[r for k, (r, y) in enumerate(rows) if k % 3 and y is kind] for kind in (False, True)]
    held = [[r for k, (r, y) in enumerate(rows) if not k % 3 and y is kind] for kind in (False, True)]
    out: list[Rule] = []
    while len(out) < RULES and len(grown[0]) >= COVER:
        found = grow(*grown)
        if not found:
            break
        cut = [Rule(tuple(found[:k])) for k in range(1, len(found) + 1)]
        rule = max(cut, key=lambda r: (round(worth(r, *held)[0], 6), len(r.conditions) * -1))
        _, p, n = worth(rule, held[0] + grown[0], held[1] + grown[1])
        if p < COVER or n > IMPURE * (p + n):
            break
        out.append(rule)
        grown, held = ([[r for r in x if not rule.holds(r)] for x in side] for side in (grown, held))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from at most SAMPLE labelled rows, those whose doc_id has the least hash."""
    known = pick(labels, doc_id="long", quality="int").where("doc_id IS NOT NULL AND quality IS NOT NULL").dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "known_id")
    d = pick(docs, doc_id="long", text="string")
    # SAMPLE bounds the broadcast side
    rows = statistics(d.join(F.broadcast(known), d.doc_id == known.known_id, "left_semi"))
    got = rows.join(F.broadcast(known), rows.doc_id == known.known_id).select("doc_id", "quality", *[c.alias(k) for k, c in features().items()])
    names = list(features())
    found = sorted({tuple(r) for r in got.collect()})
    return learn([(dict(zip(names, r[2:])), r[1] > 0) for r in found])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, from 1; 0 if none does."""
    out = F.lit(0) if not rules else None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(), k) if out is None else out.when(r.column(), k)
    return out if not rules else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, rule of every row."""
    s = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule", "n_upper", "n_marks")


def decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op10: rules learned from labels, applied to every row."""
    return judge(docs, fit(docs, labels))
