"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

The contents that may hold repeated strings are found and brought together by hash range (see windows.py), every one of
them whether or not another shard has the same. A range's contents are cut into shards. A shard's strings of `window`
symbols are a collection of strings of one length, and its transform is built column by column from the right, as for
collections of reads: suffixes of d symbols are in order, and the symbols before them deal them out in the order of d + 2
symbols. Equal strings are one entry of a shard's transform from then on.

Transforms are merged without sorting suffixes again: an interleave says from which shard and which place in its transform
each entry comes. It starts as the shards one after another, and each round deals it out anew by the transforms' own
columns, in a stable counting pass; it is right for two symbols more after each. Where neighbours first part tells their
common prefix, and stretches of neighbours that do not part within the window's length are the repeated intervals.

Defined results: null or empty text has no bytes; texts shorter than a window lose nothing; a repeated row
has the same doc_id, so neither removes from the other; a null doc_id comes after all others; other
columns are ignored; an empty table gives an empty table; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import windows
from .common import arrow_schema, rows_of, saved

WINDOW = 50
GRAM = 24
#: Strings in a shard's transform, and in the transforms that are merged at once. A piece ends where a gram does.
SHARD, PIECE = 1 << 15, 1 << 17
#: Symbols behind a piece's last one, so that columns may be read past it.
PAD = bytes(16)


class Text:
    """A piece's symbols: its columns of two symbols, and of eight for common prefixes, from each place on."""

    def __init__(self, body: bytes):
        raw = np.frombuffer(body + PAD, np.uint8)
        self.pairs = raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]
        self.words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)).astype(np.uint64)

    def column(self, spots: np.ndarray, at: int, last: int) -> np.ndarray:
        """The symbols at and after it of the strings at spots; the one at the last place alone."""
        c = self.pairs.take(spots + at)
        return c >> np.uint16(8) if at == last else c


def dealt(text: Text, spots: np.ndarray, depth: int) -> np.ndarray:
    """The strings at spots in order of depth symbols: rounds of stable counting passes, the last column first."""
    order = np.arange(len(spots))
    for at in range((depth - 1) // 2 * 2, -1, -2):
        c = text.column(spots, at, depth - 1)
        order = order.take(np.argsort(c.take(order), kind="stable"))
    return order


def common(text: Text, spots: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each string with the one before, depth at most."""
    out = np.zeros(len(spots), np.int32)
    left = np.arange(1, len(spots))
    for at in range(0, depth, 8):
        w = text.words.take(spots.take(left) + at)
        v = text.words.take(spots.take(left - 1) + at)
        x = w ^ v
        parted = x != 0
        y = x[parted]
        out[left[parted]] += sum((y < np.uint64(1 << 8 * k)).astype(np.int32) for k in range(1, 8))
        left = left[~parted]
        out[left] += 8
    return np.minimum(out, depth)


class Transform:
    """One shard: the places of its strings in order, which interval of equal strings each belongs to, and one place each."""

    def __init__(self, text: Text, spots: np.ndarray, depth: int):
        self.order = dealt(text, spots, depth)
        spots = spots.take(self.order)
        new = common(text, spots, depth) < depth
        self.firsts = np.flatnonzero(new)
        self.interval = np.cumsum(new) - 1
        self.spots = spots[self.firsts]


def merge(text: Text, transforms: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms' entries (counted over the shards one after another), and the common prefix of each
    with the one before, at most depth."""
    spots = np.concatenate([t.spots for t in transforms])
    order = dealt(text, spots, depth)
    return order, common(text, spots.take(order), depth)


def least(text: Text, spots: np.ndarray, owners: np.ndarray, window: int, shard: int = SHARD) -> np.ndarray:
    """For each string its interval's least owner."""
    if not len(spots):
        return owners
    cuts = [*range(0, len(spots), shard), len(spots)]
    transforms = [Transform(text, spots[a:b], window) for a, b in zip(cuts, cuts[1:])]
    low = np.concatenate([np.minimum.reduceat(owners[a:b].take(t.order), t.firsts) for t, a, b in zip(transforms, cuts, cuts[1:])])
    order, prefixes = merge(text, transforms, window)
    new = prefixes < window
    merged = np.empty(len(order), np.int64)
    merged[order] = np.minimum.reduceat(low.take(order), np.flatnonzero(new)).take(np.cumsum(new) - 1)
    out, at = np.empty(len(spots), np.int64), 0
    for t, a, b in zip(transforms, cuts, cuts[1:]):
        out[a:b][t.order] = merged[at : at + len(t.spots)].take(t.interval)
        at += len(t.spots)
    return out


def resolve(window: int, homes: windows.Homes, piece: int = PIECE, shard: int = SHARD):
    """Of one range: for each shard's contents a bit a window: it starts in a smaller document too."""

    def f(part: int, rows: list[tuple]) -> Iterator[tuple]:
        lens, hashes, owners = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((2, np.int32), (3, np.uint64), (4, np.int64)))
        ends = np.cumsum(lens, dtype=np.int64)
        body = b"".join(r[1] for r in rows)
        counts = lens.astype(np.int64) - window + 1
        order = np.argsort(hashes, kind="stable")  # contents of one gram together
        grams = windows.edges_of(hashes[order])
        total = np.concatenate(([0], np.cumsum(counts[order])))
        masks, k = np.zeros(len(lens), np.uint64), 0
        while k < len(order):
            # whole grams, of about as many windows as a piece has
            m = int(grams[max(np.searchsorted(total[grams], total[k] + piece, side="right") - 1, np.searchsorted(grams, k, side="right"))])
            some = order[k:m]
            text = Text(b"".join([body[b - n : b] for b, n in zip(ends[some].tolist(), lens[some].tolist())]))
            n = counts[some]
            begin = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(begin, n)
            mine = np.repeat(owners[some], n)
            low = least(text, np.repeat(np.cumsum(lens[some], dtype=np.int64) - lens[some], n) + step, mine, window, shard)
            masks[some] = np.bitwise_or.reduceat((low < mine).astype(np.uint64) << step.astype(np.uint64), begin)
            k = m
        at = 0
        for row_shard, _, sizes, *_ in rows:
            n = len(sizes) // 4
            if masks[at : at + n].any():
                yield homes(row_shard), row_shard, part, masks[at : at + n].tobytes()
            at += n

    return f


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = windows.HOT, bits: int | None = None) -> DataFrame:
    """The columns of op2."""
    s = windows.Shards(docs, window, gram, words=False, bits=bits)
    ranges, runs_of, contents = 1 << s.bits, s.runs_of(), s.contents_of()
    hit = saved(windows.by_part(s.marks(), ["shard", "hashes", "prints", "counts"], windows.match(s.homes, hot), windows.ANSWERS, ranges), "candidates")

    def owners(c: windows.Contents, ids: list) -> np.ndarray:
        doc = np.array([windows.NO_ID if x is None else x for x in ids], np.int64)
        low = np.full(len(c.heads), windows.NO_ID, np.int64)
        np.minimum.at(low, c.which, doc[c.doc])
        return low

    masks = windows.by_part(s.bring(hit, owners), ["shard", "body", "lens", "hashes", "extra"], resolve(window, s.homes), windows.ANSWERS, ranges)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SPANS)
        for batch in found:
            for ids, ends, body, found_twice, decided in rows_of(batch):
                gone = np.zeros(len(body), bool)
                if found_twice:
                    c = contents(*runs_of(ends, body), *windows.opened(found_twice))
                    doc = np.array([windows.NO_ID if x is None else x for x in ids], np.int64)[c.doc]
                    # a content that a smaller document of this shard has too is found there as a whole
                    whole = doc > owners(c, ids)[c.which]
                    gone = windows.covered(len(body), windows.flagged(c.first, c.count, np.where(whole, ~np.uint64(0), c.masked(*windows.opened(decided))[c.which])), window)
                yield spans(schema, ids, np.frombuffer(ends, np.int64), body, gone)

    answered = s.with_answers(hit, masks).select("ids", "ends", "body", "answers0", "answers1")
    return saved(answered.mapInArrow(run, SPANS), "spans")


def spans(schema: pa.Schema, ids: list, ends: np.ndarray, body: bytes, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of one shard's documents."""
    lost, rows, at = np.concatenate(([0], np.cumsum(gone))), [], 0
    raw = memoryview(body)
    for doc_id, end in zip(ids, ends.tolist()):
        n = int(lost[end] - lost[at])
        kept = hashlib.sha256()
        runs = 0
        if not n:
            kept.update(raw[at:end])
        else:
            step = np.diff(np.concatenate(([1], gone[at:end].astype(np.int8), [1])))
            firsts, lasts = np.flatnonzero(step == -1) + at, np.flatnonzero(step == 1) + at
            for a, b in zip(firsts.tolist(), lasts.tolist()):
                kept.update(raw[a:b])
            runs = len(firsts) + 1 - int(not gone[at]) - int(not gone[end - 1])
        rows.append((doc_id, end - at, n, runs, kept.hexdigest()))
        at = end
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
