"""Substring dedup with a log-structured fingerprint index.

Each batch of documents gives the hashes of its windows' runs (see windows.py). They are written as a
sorted immutable run, dealt out and ordered by hash range. Appending a batch merge-joins its run with
the compacted history of its range, which tells the hashes that repeat and the shards that have them, old
and new. These are candidates only: the contents they stand for are brought together by range and
compared word for word, and what has been verified is kept with the log. Compaction merges runs into one
history, before the next batch is appended; a run is never changed. A log may be kept and appended to later: the
tables it is made of are its state().

Defined results: null or empty text has no words; texts shorter than a window lose nothing; a repeated
row is another document, so its windows repeat; null doc_id is kept; other columns are ignored by
removals() and kept by deduplicated(); an empty table gives an empty table; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows
from .common import arrow_schema, rows_of, saved

WINDOW = 35
GRAM = 12
#: Batches in which a table is appended.
BATCHES = 2
#: Entries of one hash range, in order of hash and shard: hash, shard, print of its contents, their number.
HISTORY = "part long, hashes binary, shards binary, prints binary, counts binary"


class Entries:
    """Entries of one range, of a history row and of marks of shards, merged: in order of hash, then shard."""

    def __init__(self, rows: list[tuple]):
        kinds = (np.int64, np.uint16, np.uint8)
        each = [windows.untrimmed(r[1]) for r in rows]
        owners = [np.frombuffer(r[4], np.int64) if r[0] < 0 else np.full(len(h), r[0], np.int64) for r, h in zip(rows, each)]
        self.fresh = np.concatenate([np.full(len(h), r[0] >= 0) for r, h in zip(rows, each)])
        self.hash, self.shard = np.concatenate(each), np.concatenate(owners)
        self.prints, self.counts = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in zip((2, 3), kinds[1:]))
        order = np.lexsort((self.shard, self.hash))
        self.fresh, self.hash, self.shard, self.prints, self.counts = (x[order] for x in (self.fresh, self.hash, self.shard, self.prints, self.counts))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        t = self.hash
        raw = (t >> np.uint64(8)).astype(np.uint32).tobytes() + (t & np.uint64(255)).astype(np.uint8).tobytes()
        return raw, self.shard.tobytes(), self.prints.tobytes(), self.counts.tobytes()


def joined(homes: dict[int, windows.Homes], hot: int):
    """Of one range: history and fresh marks to answers for each shard that has a fresh hash which repeats."""

    def f(part: int, rows: list[tuple]) -> Iterator[tuple]:
        e = Entries(rows)
        twice, is_hot = windows.repeated(e.hash, e.prints, e.counts, hot)
        new = e.hash[e.fresh]
        wanted = windows.among(twice, new)
        hit = windows.among(e.hash, twice[wanted])
        very = hit & windows.among(e.hash, twice[wanted & is_hot])
        order = np.argsort(e.shard, kind="stable")  # each shard's entries, in order of hash
        shards = e.shard[order]
        for shard, s in windows.per_range(shards):
            if (mine := hit[order[s]]).any():
                yield homes[shard >> 56](shard), shard, part, np.packbits(mine).tobytes() + np.packbits(very[order[s]]).tobytes()

    return f


class FingerprintLog:
    """Sorted immutable runs of window hashes with a compacted history, the shards they come from, and what was found repeated."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, hot: int = windows.HOT, bits: int | None = None):
        self.spark, self.window, self.gram, self.hot, self.bits = spark, window, gram, hot, bits
        self.history: DataFrame | None = None
        self.run: DataFrame | None = None
        self.batches: list[windows.Shards] = []
        #: Of each append its candidates and the verified windows among them.
        self.found: list[tuple[DataFrame, DataFrame]] = []

    @property
    def ranges(self) -> int:
        return 1 << (self.bits or 0)

    def append(self, docs: DataFrame) -> None:
        """A batch's run, merge-joined with the history, its candidates verified against all shards that have them."""
        if self.run is not None:
            self.compact()
        s = windows.Shards(docs, self.window, self.gram, words=True, bits=self.bits, batch=len(self.batches))
        self.bits = s.bits
        self.batches.append(s)
        tasks = max(4, min(self.ranges, 1 << 16))
        self.run = saved(s.marks().repartition(tasks, "part").sortWithinPartitions("part", "shard"), "fingerprint-run")
        homes = {k: b.homes for k, b in enumerate(self.batches)}
        hits = saved(windows.by_part(self._entries(), COLUMNS, joined(homes, self.hot), windows.ANSWERS, self.ranges), "candidates")

        def counts(c: windows.Contents, ids: list) -> np.ndarray:
            return np.bincount(c.which, minlength=len(c.heads)).astype(np.int64)

        brought = reduce(DataFrame.unionByName, [b.bring(hits, counts) for b in self.batches])
        masks = windows.by_part(brought, ["shard", "body", "lens", "hashes", "extra"], verify(self.window, homes), windows.ANSWERS, self.ranges)
        self.found.append((hits, saved(masks, "verified")))

    def _entries(self) -> DataFrame:
        """Rows of history (shard -1) and of the run."""
        rows = self.run.select("part", "shard", "hashes", "prints", "counts", F.lit(None).cast("binary").alias("shards"))
        if self.history is None:
            return rows
        return rows.unionByName(self.history.select("part", F.lit(-1).cast("long").alias("shard"), "hashes", "prints", "counts", "shards"))

    def compact(self) -> DataFrame:
        """Merge the run with the history, range by range, into a new history."""
        if self.run is not None:

            def merge(part: int, rows: list[tuple]) -> Iterator[tuple]:
                yield part, *Entries(rows).packed()

            self.history = saved(windows.by_part(self._entries(), COLUMNS, merge, HISTORY, self.ranges), "fingerprint-history")
            self.run = None
        return self.history

    def kept(self, with_text: bool) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (or kept, the text where words were removed) of each document of all batches."""
        return saved(reduce(DataFrame.unionByName, [applied(s, self.found[k:], with_text) for k, s in enumerate(self.batches)]), "kept")


COLUMNS = ["shard", "hashes", "prints", "counts", "shards"]


def verify(window: int, homes: dict[int, windows.Homes]):
    """Of one range: contents word for word. Answers each shard's contents with a bit a window: found elsewhere too."""

    def f(part: int, rows: list[tuple]) -> Iterator[tuple]:
        known: dict[bytes, int] = {}
        grams: list[int] = []
        total: list[int] = []
        which = []
        for _, body, lens, h, extra in rows:
            at, mine = 0, []
            for n, x, many in zip(np.frombuffer(lens, np.int32).tolist(), np.frombuffer(h, np.uint64).tolist(), np.frombuffer(extra, np.int64).tolist()):
                k = known.setdefault(body[at : at + n], len(known))
                at += n
                if k == len(total):
                    grams.append(x)
                    total.append(0)
                total[k] += many
                mine.append(k)
            which.append(np.array(mine, np.int64))
        texts = list(known)
        h = np.array(grams, np.uint64)
        order = np.argsort(h, kind="stable")
        edge = windows.edges_of(h[order])
        masks = np.zeros(len(texts), np.uint64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a == 1:
                # the only content of its gram: its windows are found wherever it is
                k = int(order[a])
                masks[k] = (1 << texts[k].count(b" ") + 2 - window) - 1 if total[k] > 1 else 0
                continue
            found: dict[bytes, int] = {}
            of = {}
            for k in order[a:b].tolist():
                t, n = texts[k], total[k]
                ends = np.append(np.flatnonzero(np.frombuffer(t, np.uint8) == 32), len(t))
                begin = np.concatenate(([0], ends[:-1] + 1))
                of[k] = [t[i:j] for i, j in zip(begin[: len(ends) - window + 1].tolist(), ends[window - 1 :].tolist())]
                for x in of[k]:
                    found[x] = found.get(x, 0) + n
            for k, mine in of.items():
                masks[k] = sum(1 << j for j, x in enumerate(mine) if found[x] > 1)
        for (shard, *_), w in zip(rows, which):
            if (m := masks[w]).any():
                yield homes[shard >> 56](shard), shard, part, m.tobytes()

    return f


def search(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, hot: int = windows.HOT, bits: int | None = None) -> FingerprintLog:
    """A log to which the table is appended in batches, dealt out by hash of the text."""
    log = FingerprintLog(docs.sparkSession, window, gram, hot, bits or windows.Layout(docs).bits)
    turn = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(batches))
    for k in range(batches):
        log.append(docs.where(turn == k))
    return log


def applied(s: windows.Shards, found: list[tuple[DataFrame, DataFrame]], with_text: bool) -> DataFrame:
    """The documents of a batch's shards without the words that its own append and the later ones found repeated."""
    runs_of, contents, window, n = s.runs_of(), s.contents_of(), s.window, len(found)
    schema = "doc_id long, n_words long, n_removed long, " + ("kept string" if with_text else "kept_sha256 string")

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(schema)
        for batch in got:
            for ids, ends, body, *answers in rows_of(batch):
                units, marks = runs_of(ends, body)
                gone = np.zeros(len(units), bool)
                for hit, verified in (answers[2 * k : 2 * k + 2] for k in range(n)):
                    if verified:
                        c = contents(units, marks, *windows.opened(hit))
                        gone |= windows.covered(len(units), windows.flagged(c.first, c.count, c.masked(*windows.opened(verified))[c.which]), window)
                rows = documents(units, ids, gone, with_text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

    columns = [f"answers{k}" for k in range(2 * n)]
    return s.with_answers(*(x for pair in found for x in pair)).select("ids", "ends", "body", *columns).mapInArrow(run, schema)


def documents(units: windows.Units, ids: list, gone: np.ndarray, with_text: bool) -> list[tuple]:
    """doc_id, n_words, n_removed and the kept words (or their digest) of a shard's documents."""
    body, begin, end, edges = units.body, units.begin, units.end, units.edges
    lost = np.concatenate(([0], np.cumsum(gone)))
    rows, at = [], 0
    for k, (doc_id, stop) in enumerate(zip(ids, units.ends.tolist())):
        a, b = int(edges[k]), int(edges[k + 1])
        n = int(lost[b] - lost[a])
        if not n:
            text = body[at : max(at, stop - 1)]
        else:
            # stretches of kept words
            step = np.diff(np.concatenate(([1], gone[a:b].astype(np.int8), [1])))
            firsts, lasts = np.flatnonzero(step == -1) + a, np.flatnonzero(step == 1) + a - 1
            text = b" ".join(body[i:j] for i, j in zip(begin[firsts].tolist(), end[lasts].tolist()))
        rows.append((doc_id, b - a, n, (text.decode() if n else None) if with_text else hashlib.sha256(text).hexdigest()))
        at = stop
    return rows


def removals(docs: DataFrame) -> DataFrame:
    """The columns of op1."""
    return search(docs).kept(with_text=False)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with each text that lost words replaced by its kept words, n_chars following; texts that lost
    none stay as they are, and documents that lost all words go. Rows are told apart by a key written with
    them, so a doc_id may be null or repeated."""
    columns = docs.columns
    keyed = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = search(keyed.withColumn("doc_id", F.col("_row"))).kept(with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("_doc"), F.col("kept").alias("_kept"))
    out = keyed.join(found, keyed["_row"] == found["_doc"], "left").where("_kept IS NULL OR _kept <> ''")
    changed = {"text": F.coalesce("_kept", "text"), "n_chars": F.when(F.col("_kept").isNotNull(), F.length("_kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(c) for c in columns])
