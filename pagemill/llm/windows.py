"""Repeated windows of units (words or bytes) over a corpus, exactly, in bounded memory.

Documents are packed into shards of some megabytes. In each window of W units the gram of G units with
the least hash stands for the window, so equal windows have equal grams; windows next to each other
mostly share theirs, and form a run. Four steps, each with small tasks:

1. mark: each shard gives its runs' different hashes, dealt out by hash range.
2. match: per range, hashes of two runs at least are found; each shard gets its hits back as bits.
3. bring: each shard gives the different contents of its runs that were hit, by the same ranges,
   each once however often the shard has it. Per range, contents are compared exactly, and each
   shard gets back a bit for each window of each content.
4. apply: each shard finds its windows' bits and the units that they cover.

Only hashes, bits and contents that may repeat are shuffled, no texts: shards are a table bucketed by
home, joined with the answers in place. A passage that a third of all documents share is one content a
shard. At its edges, where its surroundings differ, one gram has a content a document: such a gram is
hot (match() counts different contents by prints of them), and its windows are brought one by one, dealt
out by their own hashes. Equal windows have equal grams, so they still meet.

Texts of any length are taken; a text is never cut, so a shard holds the longest text that it has. Two
contents of a shard with equal hashes are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, pick, rows_of

#: Bytes of text in a shard, windows looked at together, bytes of input a hash range and a bucket.
SHARD, BLOCK, RANGE, BUCKET = 1 << 20, 1 << 14, 2 << 20, 16 << 20
#: Shards that a task writes to one bucket before it takes the next: bounds its number of files.
SPREAD = 8
#: A gram of so many different contents is dealt out window by window.
HOT = 512
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
R_BYTE, R_UNIT = 0xD1342543DE82EF95, 0xAEF17502108EF2D9


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base & (1 << 64) - 1, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans a to b, wherever they stand."""
    inverse = pow(base, -1, 1 << 64)
    return mixed((sums[b] - sums[a]) * powers(inverse, int(a.max(initial=0)) + 1)[a])


def words_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of a body in which single spaces part words."""
    raw = np.frombuffer(body, np.uint8)
    gap = raw == 32
    inside = ~gap
    begin = np.flatnonzero(inside & np.concatenate(([True], gap[:-1]))) if len(raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & np.concatenate((gap[1:], [True]))) + 1 if len(raw) else np.zeros(0, np.int64)
    return begin, end


class Units:
    """The units of a shard: their hashes, where they stand in its body, and each document's share."""

    def __init__(self, body: bytes, ends: np.ndarray, words: bool):
        self.body, self.ends, self.raw = body, ends, np.frombuffer(body, np.uint8)
        if words:
            self.begin, self.end = words_of(body)
            self._hashes = self._hashed()
            self.edges = np.concatenate(([0], np.searchsorted(self.begin, ends)))
        else:
            self.begin = self.end = self._hashes = None
            self.edges = np.concatenate(([0], ends))

    def __len__(self) -> int:
        return len(self.raw) if self.begin is None else len(self.begin)

    def hashes(self, a: int, b: int) -> np.ndarray:
        """Hashes of the units a to b; those of bytes are looked up where they are asked for."""
        return BYTE_HASH[self.raw[a:b]] if self._hashes is None else self._hashes[a:b]

    def _hashed(self) -> np.ndarray:
        out, k = np.empty(len(self.begin), np.uint64), 0
        while k < len(self.begin):  # by stretches, to bound memory
            m = max(k + 1, int(np.searchsorted(self.end, self.begin[k] + (1 << 16))))
            low, high = int(self.begin[k]), int(self.end[m - 1])
            sums = prefix(BYTE_HASH[self.raw[low:high]], R_BYTE)
            out[k:m] = spans_hash(sums, self.begin[k:m] - low, self.end[k:m] - low, R_BYTE)
            k = m
        return out

    def bytes_at(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Body offsets of the units a to b."""
        return (a, b) if self.begin is None else (self.begin[a], self.end[b - 1])


NO_RUNS = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def runs(units: Units, window: int, gram: int, block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, hash of the gram and hash of the content of each run, in order.

    The least gram of a window is the leftmost of several, by the upper 40 bits of its hash: equal windows
    then have it at the same place, and one that is found twice belongs to two runs.
    """
    edges, block = units.edges, block or BLOCK
    width, total = window - gram + 1, len(units) - window + 1
    found = []
    if total <= 0:
        return NO_RUNS
    low, high = edges[:-1], np.maximum(edges[1:] - window + 1, edges[:-1])
    inverse = powers(pow(R_UNIT, -1, 1 << 64), block + width)
    for at in range(0, total, block):
        n = min(block, total - at)
        sums = prefix(units.hashes(at, at + n + window - 1), R_UNIT)
        grams = n + width - 1
        g = mixed((sums[gram : gram + grams] - sums[:grams]) * inverse[:grams])
        key = g >> np.uint64(24) << np.uint64(24) | np.arange(grams, dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[:n], key[width - step : width - step + n])
        spot = (key[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
        step_in = np.zeros(n + 1, np.int32)
        k, m = np.searchsorted(high, at, side="right"), np.searchsorted(low, at + n)
        np.add.at(step_in, np.clip(low[k:m] - at, 0, n), 1)
        np.add.at(step_in, np.clip(high[k:m] - at, 0, n), -1)
        ok = np.cumsum(step_in[:-1]) > 0
        new = np.ones(n, bool)
        new[1:] = (spot[1:] != spot[:-1]) | ~ok[:-1]
        starts = np.flatnonzero(new & ok)
        if not len(starts):
            continue
        # a run ends where the next begins or windows end
        stop = np.flatnonzero(np.concatenate((new[1:] | ~ok[1:], [True])) & ok) + 1
        content = mixed((sums[stop + window - 1] - sums[starts]) * inverse[starts])
        found.append((starts + at, stop - starts, mixed(g[spot[starts]] ^ M1), content))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else NO_RUNS


class Layout:
    """Sizes of one job: hash ranges and buckets follow the input's size."""

    def __init__(self, docs: DataFrame, bits: int | None = None):
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 60:  # not a table's size but the planner's word for unknown
            size = int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // 2
        self.bits = bits or max(4, min(32, (size // RANGE).bit_length()))
        self.buckets = max(12, min(1 << 20, size // BUCKET))


SHARDS = "home long, shard long, ids array<long>, ends binary, body binary"


class Homes:
    """Of a shard the number by which its table is bucketed: one that falls into the bucket meant for the shard, so
    that a task writes few files. A shard's number holds its batch, the task that wrote it, and its turn there."""

    def __init__(self, spark: SparkSession, buckets: int):
        # as many rows as there are buckets
        found = dict(spark.range(buckets * 32).groupBy(F.expr(f"pmod(hash(id), {buckets})")).agg(F.min("id")).collect())
        self.numbers = [found.get(k, found[min(found)]) for k in range(buckets)]

    def __call__(self, shard: int) -> int:
        return self.numbers[((shard >> 24 & (1 << 32) - 1) + (shard & (1 << 24) - 1) // SPREAD) % len(self.numbers)]


def pack(docs: DataFrame, layout: Layout, words: bool, batch: int, homes: Homes) -> DataFrame:
    """A table of shards in the shared folder, bucketed by home. Words: texts become their words with single spaces."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema, k, base = arrow_schema(SHARDS), 0, batch << 56 | part << 24
        ids: list = []
        parts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            row = (homes(base + k), base + k, ids, ends.tobytes(), b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema)], schema=schema)

        for b in found:
            for doc_id, text in rows_of(b):
                raw = (text or "").encode()
                # a space after the last word parts it from the next document's first
                raw = b" ".join(raw.split()) + b" " if words else raw
                ids.append(doc_id)
                parts.append(raw)
                size += len(raw)
                if size >= SHARD:
                    yield made()
                    ids, parts, size, k = [], [], 0, k + 1
        if ids:
            yield made()

    packed = pick(docs, doc_id="long", text="string").mapInArrow(run, SHARDS)
    return bucketed(packed, "shards", "home", layout.buckets)


def ranged(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def trimmed(h: np.ndarray, bits: int) -> bytes:
    """The 40 bits after a hash's range, as 5 bytes each."""
    t = h << np.uint64(bits) >> np.uint64(24)
    return (t >> np.uint64(8)).astype(np.uint32).tobytes() + (t & np.uint64(255)).astype(np.uint8).tobytes()


def untrimmed(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(raw, np.uint8, n, 4 * n)


def per_range(p: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal values in p, which is in order."""
    edge = edges_of(p)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(p[a]), slice(a, b)


def edges_of(x: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin in x, which is in order, and its length."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)


MARKS = "part long, shard long, hashes binary, prints binary, counts binary"
BROUGHT = "part long, shard long, body binary, lens binary, hashes binary, extra binary"
ANSWERS = "home long, shard long, part long, blob binary"


def marked(h: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of a shard's runs in order; of each a print of its contents, and their number (127
    stands for more), with the highest bit set where two runs have the hash."""
    order = np.argsort(h, kind="stable")
    hs, cs = h[order], content[order]
    edge = edges_of(hs)
    if len(edge) == 1:
        return hs, np.zeros(0, np.uint16), np.zeros(0, np.uint8)
    n, number = np.diff(edge), np.ones(len(edge) - 1, np.int64)
    prints = (mixed(np.maximum.reduceat(cs, edge[:-1])) >> np.uint64(48)).astype(np.uint16)
    if (n > 1).any():
        some = np.repeat(n > 1, n)
        group, c = np.repeat(np.arange(len(n)), n)[some], cs[some]
        turn = np.lexsort((c, group))
        group, c = group[turn], c[turn]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (c[1:] != c[:-1])))
        number = np.where(n > 1, np.bincount(group[new], minlength=len(n)), 1)
    return hs[edge[:-1]], prints, np.minimum(number, 127).astype(np.uint8) | (n > 1).astype(np.uint8) << np.uint8(7)


class Shards:
    """A table of shards, in which repeated windows are looked for."""

    def __init__(self, docs: DataFrame, window: int, gram: int, words: bool, bits: int | None = None, batch: int = 0):
        self.layout = Layout(docs, bits)
        self.bits, self.window, self.gram, self.words = self.layout.bits, window, gram, words
        self.homes = Homes(docs.sparkSession, self.layout.buckets)
        self.table = pack(docs, self.layout, words, batch, self.homes)

    def runs_of(self) -> Callable[[bytes, bytes], tuple[Units, tuple]]:
        window, gram, words = self.window, self.gram, self.words

        def found(ends: bytes, body: bytes):
            units = Units(body, np.frombuffer(ends, np.int64), words)
            return units, runs(units, window, gram)

        return found

    def marks(self) -> DataFrame:
        """part, shard, and marked() of each shard's runs by range."""
        bits, runs_of = self.bits, self.runs_of()

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = arrow_schema(MARKS)
            for batch in found:
                for shard, ends, body in rows_of(batch):
                    _, (_, _, h, content) = runs_of(ends, body)
                    u, prints, counts = marked(h, content)
                    rows = [(p, shard, trimmed(u[s], bits), prints[s].tobytes(), counts[s].tobytes()) for p, s in per_range(ranged(u, bits))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        return self.table.select("shard", "ends", "body").mapInArrow(run, MARKS)

    def contents_of(self) -> Callable[[Units, tuple, list[int], list[bytes]], Contents]:
        window, bits = self.window, self.bits

        def found(units: Units, marks: tuple, parts: list[int], blobs: list[bytes]) -> Contents:
            return Contents(units, marks, *hits(marks[2], bits, parts, blobs), window, bits)

        return found

    def bring(self, answers: DataFrame, extra: Callable[[Contents, list], np.ndarray]) -> DataFrame:
        """part, shard, body, lens, hashes, extra: contents of runs that were hit; extra has 8 bytes a content."""
        runs_of, contents = self.runs_of(), self.contents_of()

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = arrow_schema(BROUGHT)
            for batch in found:
                for shard, ids, ends, body, answers in rows_of(batch):
                    if not answers:
                        continue
                    c = contents(*runs_of(ends, body), *opened(answers))
                    more = extra(c, ids)
                    rows = []
                    for p, k, m in c.ranges():
                        x = c.texts(body, k, m)
                        rows.append((p, shard, b"".join(x), np.fromiter(map(len, x), np.int32, m - k).tobytes(), c.hash[c.heads[k:m]].tobytes(), more[k:m].tobytes()))
                    for k in range(0, len(rows), 1024):
                        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows[k : k + 1024]), schema)], schema=schema)

        return self.with_answers(answers).select("shard", "ids", "ends", "body", "answers0").mapInArrow(run, BROUGHT)

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """Each shard's row with its answers (ANSWERS) of each kind, packed, numbered by their place.

        A shard has an answer of almost every range, so a home's answers grow with the number of ranges: they are sorted
        where Spark may spill and packed shard by shard, and no row has those of other shards. The shard is compared by
        a difference, as a second key of the join would deal the texts out anew.
        """
        out = self.table
        for k, a in enumerate(answers):
            dealt = a.repartition(self.layout.buckets, "home").sortWithinPartitions("home", "shard").mapInArrow(packed, PACKED)
            dealt = dealt.toDF(f"_home{k}", f"_shard{k}", f"answers{k}")
            out = out.join(dealt, (out["home"] == dealt[f"_home{k}"]) & (out["shard"] - dealt[f"_shard{k}"] == 0), "left").drop(f"_home{k}", f"_shard{k}")
        return out


PACKED = "home long, shard long, answers binary"


def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (ANSWERS), of which a shard's follow each other, to one row a shard: their number, the ranges, the lengths and
    the bits one after another."""
    schema, now, held = arrow_schema(PACKED), None, []

    def made() -> pa.RecordBatch:
        lens = np.fromiter((len(b) for _, b in held), np.int32, len(held))
        parts = np.fromiter((p for p, _ in held), np.int64, len(held))
        raw = b"".join((np.int64(len(held)).tobytes(), parts.tobytes(), lens.tobytes(), *(b for _, b in held)))
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*now, raw), schema)], schema=schema)

    for batch in found:
        for home, shard, part, blob in rows_of(batch):
            if (home, shard) != now:
                if held:
                    yield made()
                now, held = (home, shard), []
            held.append((part, blob))
    if held:
        yield made()


def opened(answers: bytes | None) -> tuple[list[int], list[bytes]]:
    """Ranges and bits of a shard's packed answers."""
    if not answers:
        return [], []
    n = int(np.frombuffer(answers, np.int64, 1)[0])
    parts, lens = np.frombuffer(answers, np.int64, n, 8), np.frombuffer(answers, np.int32, n, 8 + 8 * n)
    ends = (np.cumsum(lens, dtype=np.int64) + 8 + 12 * n).tolist()
    return parts.tolist(), [answers[b - m : b] for b, m in zip(ends, lens.tolist())]


def hits(h: np.ndarray, bits: int, parts: list[int] | None, blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of a shard's runs that match() found repeated, in order, and which of them are hot."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.sort(h)
    u = h[edges_of(h)[:-1]]
    answer = dict(zip(parts, blobs))
    keep, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
    for p, s in per_range(ranged(u, bits)):
        if p in answer:
            raw, n = np.frombuffer(answer[p], np.uint8), s.stop - s.start
            keep[s] = np.unpackbits(raw[: len(raw) // 2], count=n)
            hot[s] = np.unpackbits(raw[len(raw) // 2 :], count=n)
    return u[keep], hot[keep]


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among the known, which are in order."""
    at = np.searchsorted(known, x)
    found = at < len(known)
    found[found] = known[at[found]] == x[found]
    return found


def repeated(h: np.ndarray, prints: np.ndarray, counts: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the marks of one range: hashes of two runs at least, in order, and which of them have hot contents or more."""
    every = np.sort(h)
    edge = edges_of(every)
    n = np.diff(edge)
    value = every[edge[:-1]]
    more = np.zeros(len(value), bool)
    twice = np.sort(h[counts > 127])
    more[np.searchsorted(value, twice)] = True
    keep = more | (n > 1)
    several = counts & 127 > 1
    bound = n + np.bincount(np.searchsorted(value, h[several]), weights=(counts[several] & 127) - 1.0, minlength=len(value))
    wide = value[bound >= hot]
    is_hot = np.zeros(len(value), bool)
    if len(wide):
        # contents of the different prints of these; shards with one print have the same contents
        some = among(h, wide)
        x, p, c = h[some], prints[some], counts[some] & 127
        order = np.lexsort((c, p, x))
        x, p, c = x[order], p[order], c[order]
        last = np.concatenate(((x[1:] != x[:-1]) | (p[1:] != p[:-1]), [True]))
        total = np.bincount(np.searchsorted(value, x[last]), weights=c[last], minlength=len(value))
        is_hot = total >= hot
    return value[keep], is_hot[keep]


def match(homes: Homes, hot: int):
    """Of one range: its marks (shard, hashes, prints, counts) to answers: bits of the hashes found in two runs at least,
    and bits of those that are hot."""

    def f(part: int, rows: list[tuple]) -> Iterator[tuple]:
        each = [untrimmed(h) for _, h, _, _ in rows]
        prints, counts = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((2, np.uint16), (3, np.uint8)))
        twice, is_hot = repeated(np.concatenate(each), prints, counts, hot)
        for (shard, *_), h in zip(rows, each):
            hit = among(h, twice)
            if hit.any():
                yield homes(shard), shard, part, np.packbits(hit).tobytes() + np.packbits(hit & among(h, twice[is_hot])).tobytes()

    return f


def by_part(df: DataFrame, columns: list[str], f: Callable[[int, list[tuple]], Iterator[tuple]], schema: str, parts: int) -> DataFrame:
    """Each range's rows, of the columns, through f; a task holds one range at a time."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(schema)
        now, held = None, []

        def out(rows):
            made = list(rows)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), kind)], schema=kind)

        for batch in found:
            for p, *row in rows_of(batch):
                if p != now:
                    if held:
                        yield from out(f(now, held))
                    now, held = p, []
                held.append(tuple(row))
        if held:
            yield from out(f(now, held))

    tasks = max(4, min(parts, 1 << 16))
    return df.select("part", *columns).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


class Contents:
    """The different contents of a shard's runs that were hit, by range, in the order of their hashes.

    Each window of a hot gram is a content of its own, dealt out by its own hash. Equal contents are found by their
    hashes and compared by their bytes.
    """

    def __init__(self, units: Units, found: tuple, repeated: np.ndarray, hot: np.ndarray, window: int, bits: int):
        first, count, h, content = found
        hit = among(h, repeated)
        first, count, h, content = first[hit], count[hit], h[hit], content[hit]
        if hot.any():
            split = among(h, repeated[hot])
            f, n = first[split], count[split]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            f = np.repeat(f, n) + step
            own = self._hashed(units, f, f + window)
            first, count = np.concatenate((first[~split], f)), np.concatenate((count[~split], np.ones(len(f), np.int64)))
            h, content = np.concatenate((h[~split], own)), np.concatenate((content[~split], own))
        low = np.uint64((1 << 64 - bits) - 1)
        key = h & ~low | mixed(h ^ content * M1) & low
        order = np.argsort(key, kind="stable")
        key, self.first, self.count, self.hash = key[order], first[order], count[order], h[order]
        self.part = ranged(self.hash, bits)
        self.doc = np.searchsorted(units.edges, self.first, side="right") - 1
        last = self.first + self.count + window - 1
        self.begin, self.end = units.bytes_at(self.first, last) if len(order) else (self.first, last)
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        # a content whose hashes another one has by chance is one of its own
        body, begin, end = units.body, self.begin.tolist(), self.end.tolist()
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        for k in np.flatnonzero(~new).tolist():
            j = int(at[k])
            if body[begin[k] : end[k]] != body[begin[j] : end[j]]:
                new[k] = True
        self.heads = np.flatnonzero(new)
        self.which = np.where(new, np.cumsum(new) - 1, (np.cumsum(new) - 1)[at]) if len(new) else np.zeros(0, np.int64)

    @staticmethod
    def _hashed(units: Units, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, k = np.empty(len(a), np.uint64), np.argsort(a, kind="stable")
        i = 0
        while i < len(k):  # by stretches, to bound memory
            j = max(i + 1, int(np.searchsorted(a[k], a[k[i]] + (1 << 16))))
            low, high = int(a[k[i]]), int(b[k[i:j]].max())
            out[k[i:j]] = spans_hash(prefix(units.hashes(low, high), R_UNIT), a[k[i:j]] - low, b[k[i:j]] - low, R_UNIT)
            i = j
        return out

    def texts(self, body: bytes, k: int, m: int) -> list[bytes]:
        return [body[i:j] for i, j in zip(self.begin[self.heads[k:m]].tolist(), self.end[self.heads[k:m]].tolist())]

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """Range, first and end of its contents."""
        for p, s in per_range(self.part[self.heads]):
            yield p, s.start, s.stop

    def masked(self, parts: list[int] | None, blobs: list[bytes] | None) -> np.ndarray:
        """The windows' bits of each content by the answers of the ranges."""
        answer, mask = dict(zip(parts or [], blobs or [])), np.zeros(len(self.heads), np.uint64)
        for p, k, m in self.ranges():
            if p in answer:
                mask[k:m] = np.frombuffer(answer[p], np.uint64)
        return mask


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n units the windows at starts, no two alike, cover."""
    step = np.zeros(n + 1, np.int16)
    step[starts] = 1
    step[starts + window] -= 1
    return np.cumsum(step[:n], dtype=np.int16) > 0


def flagged(first: np.ndarray, count: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """First units of the windows whose bit is set in their run's mask."""
    some = masks != 0
    first, count, masks = first[some], count[some], masks[some]
    out = []
    for j in range(int(count.max(initial=0))):
        out.append(first[(count > j) & (masks >> np.uint64(j) & np.uint64(1)).astype(bool)] + j)
    return np.concatenate(out) if out else np.zeros(0, np.int64)
