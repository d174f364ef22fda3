"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's latent score is the sum of hashed-text weights shared by all grades; ordered thresholds cut
the score into grades: P(grade > k) = sigmoid(score - threshold k). From these come the expected
grade and the tail probability that selection uses.

Grades come from labels: 2 for quality 1 and toxic 0, 1 for one of the two faults, 0 for both.
Features are the different words, word shapes and repeats of a whole text, hashed to BUCKETS weights; those in fewer
than LEAST labelled texts have no weight. At most SAMPLE labelled rows (those of least hash) are
used to fit; the weights are a fixed size and are broadcast. Of the features, those take part in the fit
whose texts' mean grade is at least SCREEN standard errors from that of all texts.

Defined results: null or empty text has no features but the bias; repeated rows each give a row;
null doc_id is kept; null grades are left out of the fit; without labels of two grades at least every
text has tail probability 1 and is kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, pick

BUCKETS = 1 << 18
SAMPLE = 20_000
LEAST = 4
SCREEN = 4.0
GRADES = 3
ROUNDS, RATE, SHRINK = 120, 0.05, 2e-4
#: A text is kept if the probability of the highest grade is at least this.
KEEP = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[^\W\d_]")


def shape(word: str) -> str:
    """What a word looks like: letters' case and the marks at its end."""
    core = word.rstrip("!?.,;:%$&#*|<>@~^=+-_/\\")
    tail = word[len(core) :]
    case = "0" if not core else "X" if core.isupper() and len(core) > 1 else "x" if core.isalpha() else "?"
    return f"\x01{case}{tail[:3]}"


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's different features, in order."""
    words = text.split() if text else []
    n = len(words)
    found = {w.lower() for w in LETTERS.findall(text)} if text else set()
    marked: set[str] = set()
    if n:
        counts: dict[str, int] = {}
        for s in map(SHAPES.get, words):
            counts[s] = counts.get(s, 0) + 1
        for s, k in counts.items():
            # a shape's share of all words by powers of two: sparse, common or nearly all
            marked.add(f"{s}/{min(8, int(np.log2(n / k)))}")
        marked.add(f"\x02{min(8, int(8 * (1 - len(set(words)) / n)))}")
        same = sum(a == b for a, b in zip(words, words[1:]))
        marked.add(f"\x03{min(8, int(16 * same / n))}")
    out = {crc32(x.encode()) % BUCKETS for x in found}
    out |= {crc32(x.encode()) % BUCKETS for x in marked}
    return np.fromiter(sorted(out), np.int64, len(out))


class Shapes(dict):
    """Shapes of words, those seen lately."""

    def get(self, word: str) -> str:  # type: ignore[override]
        if (s := super().get(word)) is None:
            if len(self) > 200_000:
                self.clear()
            s = self[word] = shape(word)
        return s


SHAPES = Shapes()


@dataclass
class Model:
    """weights: by bucket; cuts: ordered thresholds, GRADES - 1 of them (none: everything is kept)."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -60, 60)))

    def score(self, text: str | None) -> float:
        return float(self.weights[features(text)].sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Adam on the mean log-likelihood of the cumulative-link model with a little shrinkage."""
    w = np.zeros(BUCKETS)
    if len({y for _, y in rows}) < 2:
        return Model(w, np.zeros(0))
    n = len(rows)
    at = np.concatenate([[0], np.cumsum([len(x) for x, _ in rows])])
    idx = np.concatenate([x for x, _ in rows])
    row = np.repeat(np.arange(n), np.diff(at))
    y = np.array([g for _, g in rows])
    df = np.bincount(idx, minlength=BUCKETS)
    shift = np.bincount(idx, weights=(y - y.mean())[row], minlength=BUCKETS)
    use = (df >= LEAST) & (np.abs(shift) >= SCREEN * y.std() * np.sqrt(np.maximum(df, 1)))
    keep = use[idx]
    idx, row = idx[keep], row[keep]
    old, idx = np.unique(idx, return_inverse=True)
    v, m1, m2 = np.zeros(len(old)), np.zeros(len(old)), np.zeros(len(old))
    share = np.array([(y > k).mean() for k in range(GRADES - 1)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    # ordered by construction: the first threshold and the logs of the steps between
    cut = np.array([first[0], *np.log(np.maximum(np.diff(first), 1e-2))])
    c1, c2 = np.zeros(len(cut)), np.zeros(len(cut))
    far = 1e9
    for t in range(1, ROUNDS + 1):
        steps = np.exp(cut[1:])
        theta = cut[0] + np.concatenate([[0], np.cumsum(steps)])
        s = np.bincount(row, weights=v[idx], minlength=n)
        edge = np.concatenate([[-far], theta, [far]])
        up, down = sigmoid(edge[y + 1] - s), sigmoid(edge[y] - s)
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        gs = (du - dd) / n  # gradient of the loss by the score
        gt = np.array([-(du[y == k].sum() - dd[y == k + 1].sum()) / n for k in range(GRADES - 1)])
        gc = np.array([gt.sum(), *(gt[k:].sum() * steps[k - 1] for k in range(1, GRADES - 1))])
        gv = np.bincount(idx, weights=gs[row], minlength=len(old)) + SHRINK * v
        for g, x, a, b in ((gv, v, m1, m2), (gc, cut, c1, c2)):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    w[old] = v
    return Model(w, cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE labelled rows; their hashed features, not their texts, go to the driver."""
    known = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.select("doc_id", ((F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")).alias("grade"))
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "known_id")
    d = pick(docs, doc_id="long", text="string")
    # SAMPLE bounds the broadcast side
    d = d.join(F.broadcast(known), d.doc_id == known.known_id).select("doc_id", "text", "grade")

    def make():
        def one(doc_id, text, grade):
            yield doc_id, grade, features(text).astype(np.int32).tobytes()

        return one

    # a doc_id of several rows counts once: SAMPLE bounds what is collected
    got = by_row(d, make, "doc_id long, grade int, f binary").groupBy("doc_id", "grade").agg(F.min("f").alias("f")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([(np.frombuffer(r["f"], np.int32).astype(np.int64), r["grade"]) for r in got])


def scores(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability (of the highest grade), kept of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))

    def make():
        here = Model(*sent.value)

        def one(doc_id, text):
            if not len(here.cuts):
                yield doc_id, 0.0, float(GRADES - 1), 1.0, True
                return
            s = here.score(text)
            t = here.tails(s)
            yield doc_id, round(s, 4), round(float(t.sum()), 6), round(float(t[-1]), 6), bool(t[-1] >= keep)

        return one

    return by_row(pick(docs, doc_id="long", text="string"), make, "doc_id long, score double, expected_grade double, tail_probability double, kept boolean")


def accepted(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of docs that are kept, with their own columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))
    names = docs.columns
    at = names.index("text")
    from .common import batches_where

    def make():
        here = Model(*sent.value)
        return lambda text: not len(here.cuts) or bool(here.tails(here.score(text))[-1] >= keep)

    return batches_where(docs, at, make)


def decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op7."""
    return scores(docs, train(docs, labels))
