"""Near copies by five-word shingles: pairs whose Jaccard similarity is SIMILAR at least.

Candidates come from bands of MinHash values of a text's shingles; each is then checked on the whole
sets of both texts, so no pair is linked that is less similar. A pair of similarity 0.8 shares no band,
and so is missed, with a chance of (1 - 0.8 ** ROWS) ** BANDS = 0.0002, a more similar one less often.

Texts with one and the same set are one member. A band's members are compared in two rounds: first each with the
band's leader, the member whose bands have most members in all, as the text has that a group's copies were made of; then, of what
that has joined into components, each member outside the band's largest component with all members of other components.
So every pair of a band is compared or joined already: a group of copies takes as many comparisons as it has members, and
only members that are not similar are compared with all others. The second round's pairs are no rows: a band's members
are cut into blocks, each pair of blocks is compared in one task, and only links that join components come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, rows_of, saved
from .windows import M1, R_UNIT, Units, mixed, powers

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Members of a band in a block of the second round.
BUCKET = 1024
#: Odd factors, one a MinHash value.
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * M1) | np.uint64(1)
MEMBER = "digest long, bands array<long>, shingles binary"


def shingles(text: str | None) -> np.ndarray:
    """Different hashes of a text's runs of SHINGLE words (of all its words, where these are fewer), in order."""
    body = b" ".join(text.encode().lower().split()) if text else b""
    if not body:
        return np.zeros(0, np.uint64)
    units = Units(body, np.array([len(body)], np.int64), True)
    h = units.hashes(0, len(units))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    return np.unique(mixed(sum(h[j : j + n] * powers(R_UNIT, k)[j] for j in range(k))))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash a band of the MinHash values of a set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, (found[k : k + 4096, None] * FACTORS).min(axis=0))
    m = mixed(least.reshape(BANDS, ROWS))
    return mixed((m * powers(R_UNIT, ROWS)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * M1).view(np.int64)


def member(text: str | None) -> tuple[int, list[int], bytes]:
    """digest, bands and shingles (the upper halves of their hashes, in order) of a text."""
    s = shingles(text)
    digest = int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0])
    return digest, bands(s).tolist(), np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes()


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def checked(pairs: DataFrame, one: DataFrame, buckets: int) -> DataFrame:
    """a, b: values of fp of those pairs (x, y: digests) whose sets are similar; only their sets are moved."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("_wanted")).repartition(buckets, "_wanted").distinct()
    one = saved(one.join(wanted, one["digest"] == wanted["_wanted"], "left_semi").select("digest", "fp", "shingles"), "shingles")
    left = one.select(F.col("digest").alias("x"), F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    right = one.select(F.col("digest").alias("y"), F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "x").join(right, "y").where("a <> b").select("a", "b", "sa", "sb")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("a long, b long")
        for batch in found:
            ok = pa.array([similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], schema=schema)

    return both.mapInArrow(run, "a long, b long")


def joined(members: DataFrame, linked: DataFrame, components: Callable[[DataFrame], DataFrame], buckets: int) -> DataFrame:
    """node, root: components() of the links (a, b) of fp and of members (fp and MEMBER) with one set or similar sets.

    A digest's bands and shingles may be null in all rows but one. Sets are dealt out once, to a table of so many
    buckets by digest, and looked up there in place: what is looked up is dealt out to as many parts, since otherwise, where the
    session has more shuffle partitions than there are buckets, Spark deals out the table too."""
    dealt = members.where("shingles IS NOT NULL").repartition(buckets, "digest")
    once = dealt.groupBy("digest").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    one = bucketed(once.withColumn("n", (F.octet_length("shingles") / 4).cast("long")), "members", "digest", buckets)
    same = members.select("digest", "fp").repartition(buckets, "digest").join(one.select("digest", F.col("fp").alias("least")), "digest").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()

    keyed = one.select("digest", "fp", "n", F.explode("bands").alias("band"))
    many = keyed.groupBy("band").agg(F.count("*").alias("held")).where("held > 1")
    shared = saved(keyed.join(many, "band"), "shared-bands")
    # copies differ from each other more than from what they were made of, which has the bands that most of them have
    scores = shared.groupBy("digest").agg(F.sum("held").alias("score"))
    lead = shared.join(scores, "digest").groupBy("band").agg(F.max(F.struct("score", "digest", "n")).alias("lead"))
    blocks = F.ceil(F.col("held") / BUCKET).cast("int")
    dealt = saved(shared.join(lead, "band").withColumn("buckets", blocks).withColumn("bucket", F.pmod(F.xxhash64("digest", "band"), F.col("buckets")).cast("int")).drop("held"), "bands")
    # only sets whose sizes allow the similarity
    alike = f"least(n, {{0}}) >= {SIMILAR} * greatest(n, {{0}})"
    pairs = saved(dealt.where("digest <> lead.digest").where(alike.format("lead.n")).select(F.col("lead.digest").alias("x"), F.col("digest").alias("y")).distinct(), "pairs")
    found = components(linked.unionByName(same).unionByName(checked(pairs, one, buckets)))

    rooted = dealt.join(found, dealt["fp"] == found["node"], "left").select("band", "digest", "fp", "buckets", "bucket", F.coalesce("root", "fp").alias("root"))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("k"))
    most = sizes.groupBy("band").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root"))["root"].alias("most")).where("roots > 1").drop("roots")
    large = saved(rooted.join(most, "band"), "parted-bands")
    if large.isEmpty():
        return found
    sets = one.select("digest", "shingles").join(large.select(F.col("digest").alias("_wanted")).repartition(buckets, "_wanted").distinct(), F.col("digest") == F.col("_wanted"), "left_semi")
    # block i meets every block j: part (i, j) has i <= j, the members of j as visitors
    parts = F.transform(F.sequence(F.lit(0), F.col("buckets") - 1), lambda j: F.struct((F.least("bucket", j) * F.col("buckets") + F.greatest("bucket", j)).alias("part"), (F.col("bucket") > j).alias("visitor")))
    dealt = large.repartition(buckets, "digest").join(sets, "digest").withColumn("p", F.explode(parts)).select("band", F.col("p.part").cast("long").alias("part"), F.col("p.visitor").alias("visitor"), (F.col("root") != F.col("most")).alias("outside"), "root", "fp", "shingles")
    dealt = dealt.repartition("band", "part").sortWithinPartitions("band", "part", "visitor")
    cross = saved(dealt.mapInArrow(met, "a long, b long").distinct(), "pairs")
    if cross.isEmpty():
        return found
    return components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(cross))


def met(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, part, visitor, outside, root, fp, shingles) in order of band and part to links (a, b) of fp; a part at a time."""
    schema, held, now = arrow_schema("a long, b long"), [], None

    def out():
        made = list(joins(*zip(*held)))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=schema)

    for batch in found:
        for band, part, *row in rows_of(batch):
            if now != (band, part):
                if held:
                    yield from out()
                held, now = [], (band, part)
            held.append(row)
    if held:
        yield from out()


def joins(visitor: tuple, outside: tuple, root: tuple, fp: tuple, shingle: tuple) -> Iterator[tuple[int, int]]:
    """Links between similar members of a part's two blocks (of one block, where it has no visitors) that join components."""
    sets = [np.frombuffer(x, np.uint32) for x in shingle]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets) if size.sum() else np.zeros(0, np.uint32)
    order = np.argsort(every, kind="stable")
    number = np.empty(len(every), np.int64)  # of each shingle of each member
    number[order] = np.cumsum(np.concatenate(([0], every[order][1:] != every[order][:-1]))) if len(every) else 0
    edge = np.concatenate(([0], np.cumsum(size)))
    guest = np.array(visitor, bool)
    across = guest.any() and not guest.all()
    label = np.unique(np.array(root, np.int64), return_inverse=True)[1]
    table = np.zeros(int(number.max(initial=-1)) + 1, bool)
    total = np.zeros(len(every) + 1, np.int64)
    for k in np.flatnonzero(np.array(outside, bool)).tolist():
        other = (label != label[k]) & (np.minimum(size, size[k]) >= SIMILAR * np.maximum(size, size[k]))
        if across:
            other &= guest != guest[k]
        elif guest.any():
            continue
        if not other.any():
            continue
        mine = number[edge[k] : edge[k + 1]]
        table[mine] = True
        np.cumsum(table[number], out=total[1:])
        table[mine] = False
        both = total[edge[1:]] - total[edge[:-1]]
        near = np.flatnonzero(other & (both >= SIMILAR * (size + size[k] - both)))
        for j in near.tolist():
            if label[j] != label[k]:
                yield fp[k], fp[j]
                label[label == label[j]] = label[k]
