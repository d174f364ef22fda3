"""SimHash near-dedup: tiled exact comparison of fingerprints by exclusive-or and bit counts.

Fingerprints are compared once each, however many documents have them. A tile holds the
fingerprints with the same population counts in their four 16-bit lanes. Two fingerprints within
RADIUS bits differ by no more than RADIUS in these counts, summed over lanes (nor, therefore, in
their whole counts), so a tile is compared with itself and with the few tiles that near it; all
other pairs of tiles are skipped. Members and visitors of a tile are cut into blocks of about SIDE by
hash, and each pair of blocks is a part of its own, so that no part grows with the input; a task holds one part
at a time. Each part gives a spanning forest of its links, not all of its pairs; connected components of
the forests give the classes.

Defined results: null or empty text and text of white space only have fingerprint zero, linked
like any other; repeated rows each give a row; a null doc_id is kept and never names a component
unless all its members are null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import near
from .common import arrow_schema, by_row, pick, saved
from .windows import Layout

RADIUS = 2
SHINGLE = 3
SEED = 42
LANES = 4
#: Fingerprints in a block of a tile.
SIDE = 1 << 14
#: Shingles counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    counts, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        found = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + m].tolist(), (ends[k + SHINGLE - 1 : k + SHINGLE - 1 + m] - 1).tolist())), np.uint64, m)
        counts += np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (its 64 bits as a signed long) of every row."""

    def make():
        def one(doc_id, text):
            yield doc_id, signed(fingerprint(text))

        return one

    return by_row(pick(docs, doc_id="long", text="string"), make, "doc_id long, fp long")


def lanes(fps: np.ndarray) -> np.ndarray:
    """Population counts of each fingerprint's lanes."""
    width = 64 // LANES
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count(fps >> np.uint64(width * k) & mask) for k in range(LANES)], axis=1).astype(np.int64)


def steps(radius: int) -> np.ndarray:
    """Differences of lane counts within radius, those after zero in order of tiles."""
    found = [[]]
    for _ in range(LANES):
        found = [[*x, d] for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return np.array([x for x in found if x > [0] * LANES], np.int64)


BASE = 64 // LANES + 1


def tile_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.int64)
    for k in range(LANES):
        out = out * BASE + counts[:, k]
    return out


def near_tiles(counts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step: indices of fingerprints that have a tile there, and its number."""
    for step in steps(radius):
        there = counts + step
        ok = np.flatnonzero(((there >= 0) & (there < BASE)).all(axis=1))
        yield ok, tile_of(there[ok])


def forest(own: np.ndarray, rest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of own fingerprints among themselves and with the rest, as (root, other) pairs of a spanning forest."""
    every = np.concatenate([own, rest])
    label = np.arange(len(every))
    lefts, rights = [], []
    for k in range(0, len(own), 256):
        for m in range(k, len(every), 8192):
            a, b = np.nonzero(np.bitwise_count(own[k : k + 256, None] ^ every[None, m : m + 8192]) <= radius)
            keep = a + k < b + m
            lefts.append(a[keep] + k)
            rights.append(b[keep] + m)
        if sum(map(len, lefts)) > 1 << 20 or k + 256 >= len(own):
            a, b = np.concatenate(lefts), np.concatenate(rights)
            label = settled(label, a, b)
            lefts, rights = [], []
    other = np.flatnonzero(label != np.arange(len(label)))
    return every[label[other]], every[other]


def settled(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: of each component the smallest index, by minima and pointer jumps."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def block_of(fps: np.ndarray, blocks: int) -> np.ndarray:
    """The blocks of a tile that fingerprints fall into."""
    return (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks


def parts_of(fps: np.ndarray, own: bool, mine: int, theirs: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Where a tile's fingerprints go, of mine blocks of members and theirs of visitors: which, to which part, and
    whether as the part's own. Part (i, j) compares block i with itself and with block j; visitors' blocks follow members'."""
    home = block_of(fps, mine if own else theirs)
    for i in range(mine):
        for j in range(i, mine + theirs):
            if own:
                here = (home == i) | (home == j)
                yield np.flatnonzero(here), i * (mine + theirs) + j, home[here] == i
            elif j >= mine:
                here = np.flatnonzero(home == j - mine)
                yield here, i * (mine + theirs) + j, np.zeros(len(here), bool)


def links(fps: DataFrame, radius: int = RADIUS, side: int = SIDE) -> DataFrame:
    """a, b: spanning forests of all links between the different values in fps (fp)."""
    spot = "tile long, part long, visitor boolean, fp long"

    def counted(found):
        # members and visitors of each tile in this task's rows
        own: dict[int, int] = {}
        seen: dict[int, int] = {}
        for batch in found:
            x = batch.column(0).to_numpy().view(np.uint64)
            c = lanes(x)
            for into, t in [(own, tile_of(c)), *((seen, t) for _, t in near_tiles(c, radius))]:
                for k, n in zip(*(v.tolist() for v in np.unique(t, return_counts=True))):
                    into[k] = into.get(k, 0) + n
        keys = sorted({*own, *seen})
        yield pa.RecordBatch.from_pydict({"tile": keys, "own": [own.get(k, 0) for k in keys], "rest": [seen.get(k, 0) for k in keys]}, schema=arrow_schema("tile long, own long, rest long"))

    # At most 17 ** 4 tiles exist, whatever the input: this may go to the driver.
    tiles = fps.mapInArrow(counted, "tile long, own long, rest long").groupBy("tile").agg(F.sum("own").alias("own"), F.sum("rest").alias("rest"))
    blocks = {t: (-(-n // side), -(-m // side)) for t, n, m in tiles.where((F.col("own") > 0) & (F.col("own") + F.col("rest") > 2 * side)).collect()}

    def dealt(found):
        schema = arrow_schema(spot)
        big = np.array(sorted(blocks), np.int64)
        for batch in found:
            x = batch.column(0).to_numpy().view(np.uint64)
            c = lanes(x)
            for ok, t, own in [(np.arange(len(x)), tile_of(c), True), *((ok, t, False) for ok, t in near_tiles(c, radius))]:
                f = x[ok]
                split = np.isin(t, big)
                rows = [(t[~split], np.zeros(int((~split).sum()), np.int64), np.full(int((~split).sum()), not own), f[~split])]
                for tile in np.unique(t[split]).tolist():
                    g = f[t == tile]
                    for here, part, mine in parts_of(g, own, *blocks[tile]):
                        rows.append((np.full(len(here), tile), np.full(len(here), part), ~mine, g[here]))
                for a, b, v, g in rows:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v), pa.array(g.view(np.int64))], schema=schema)

    def compared(found):
        schema = arrow_schema("a long, b long")
        held, now = [], None

        def out():
            visitor, fp = (np.concatenate(x) for x in zip(*held))
            n = int((~visitor).sum())
            if n and len(fp) > 1:
                a, b = forest(fp[:n].view(np.uint64), fp[n:].view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], schema=schema)

        # rows come in order of tile and part, members first
        for batch in found:
            tile, part, visitor, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edge = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (part[1:] != part[:-1]), [True]))) if len(tile) else [0]
            for i, j in zip(edge[:-1], edge[1:]):
                if now is not None and now != (tile[i], part[i]):
                    yield from out()
                    held = []
                now = (tile[i], part[i])
                held.append((visitor[i:j], fp[i:j]))
        if held:
            yield from out()

    dealt_out = fps.mapInArrow(dealt, spot).repartition("tile", "part").sortWithinPartitions("tile", "part", "visitor")
    return dealt_out.mapInArrow(compared, "a long, b long")


def components(edges: DataFrame, what: str = "links") -> DataFrame:
    """node, root of every node in edges (a, b): roots are components' smallest nodes.

    Large and small stars in turn, by minima and joins (no node's neighbours are ever gathered),
    each round written to the shared folder, until nothing changes.
    """
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), what)
    was = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # now a < b: each b's smaller neighbours meet at the least of them
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        e = e.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").distinct()
        e = saved(e.select(F.col("x").alias("a"), F.col("y").alias("b")), what)
        now = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        if now == was:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        was = now


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    marked = saved(fingerprints(docs), "fingerprints")
    one = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    found = components(links(one.select("fp"), radius))
    rooted = one.join(found, one.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = saved(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return marked.join(label, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near copies: of each component, linked by fingerprints within radius and by shingles (near.py), the
    row with the smallest doc_id stays, a row without a doc_id where there is no other, and of repeated ids one row.

    Rows are told apart by a key written with them, so that null and repeated doc_ids are rows like any other.
    """
    columns = docs.columns
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    at, own = columns.index("text"), "_fp long, _digest long, _bands array<long>, _shingles binary"
    schema = StructType([*keyed.schema.fields, *(StructField(f"_{n}", t) for n, t in (("fp", LongType()), ("digest", LongType()), ("bands", ArrayType(LongType())), ("shingles", BinaryType())))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, known = [f.type for f in arrow_schema(own)], set()
        for batch in found:
            rows = []
            for x in batch.column(at).to_pylist():
                # a task keeps a set once, so that copies do not meet in one place
                digest, *rest = near.member(x)
                rows.append((signed(fingerprint(x)), digest, *(rest if digest not in known else (None, None))))
                known.add(digest)
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(x.split()[0] for x in own.split(", "))])

    marked = saved(keyed.mapInArrow(run, schema), "marked")
    members = marked.select(F.col("_fp").alias("fp"), F.col("_digest").alias("digest"), F.col("_bands").alias("bands"), F.col("_shingles").alias("shingles"))
    found = near.joined(members, links(members.select("fp").distinct(), radius), components, Layout(marked).buckets)
    # the first row of each fingerprint, then of each component
    doc_id = F.col("doc_id") if "doc_id" in columns else F.lit(None).cast("long")
    best = marked.groupBy("_fp").agg(F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_row").alias("row"))).alias("best"))
    best = best.join(found, best["_fp"] == found["node"], "left").groupBy(F.coalesce("root", "_fp")).agg(F.min("best").alias("best"))
    stay = saved(best.select(F.col("best.row").alias("_stay")), "stay")
    return marked.select("_row", *columns).join(stay, F.col("_row") == F.col("_stay"), "left_semi").select(*columns)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of op5."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
