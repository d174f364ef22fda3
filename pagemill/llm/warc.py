"""WARC archives, index first: offset, length, URL and digest of every record, then ranged reads.

Each task writes one archive of gzip members, a member a record, and gives the index rows of its
records; the index is written as a table. To read, the selected index rows are sorted by archive and
offset, ranges that touch or nearly touch are read at once, and each record is parsed from its slice.

An archive's name is its task's place and the digest of what it holds, and it is moved into place
when complete, so a task that is run again (a lost executor, a slow copy) does no harm.

Equal payloads of at least MIN_BYTES bytes: the record with the largest page_id is the response, the
others revisit it. Defined results: null html is the empty payload; a null page_id counts as less
than any other, and where all of a group are null the revisits' refers_to is null; of repeated rows
of the largest page_id one is the response; null url is the empty target; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, batches, fresh_dir, pick, saved

MIN_BYTES = 0
#: Bytes between two ranges that are read through, and bytes in one read.
GAP, READ = 64 << 10, 4 << 20
#: Bytes of records that a task reads back.
TASK = 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long, record_id string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers: int | None, sum_: str | None = None) -> bytes:
    """One record, not compressed. A revisit has the payload's digest and length, not the payload."""
    body = payload if kind == "response" else b""
    # line breaks in a URL would end the header
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sum_ or digest(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{record_id(refers)}>", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; ValueError where it is broken."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(found["content-length"])
    if len(rest) < n:
        raise ValueError("record is cut off")
    return found, rest[:n]


def member(raw: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, kind, refers of every row."""
    p = pick(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("sum", F.sha1("html"))
    long = F.octet_length("html") >= min_bytes
    each = p.where(long).groupBy("sum", "page_id").agg(F.count("*").alias("k"))
    same = each.groupBy(F.col("sum").alias("same")).agg(F.sum("k").alias("n"), F.max("page_id").alias("first"), F.max_by("k", F.coalesce("page_id", F.lit(-(1 << 63)))).alias("ties")).where("n > 1")
    # groups of equal payloads only, aggregated before they are shuffled; written, for it is asked twice
    same = saved(same, "warc-same")
    # the pages are shuffled once, by sum; where a sum is hot, AQE splits their side of the join
    p = p.join(same, F.col("sum") == F.col("same"), "left")
    head = F.col("same").isNotNull() & F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(F.col("same").isNull() | head, "response").otherwise("revisit")
    refers = F.when(kind == "revisit", F.col("first"))
    if same.where("ties > 1").isEmpty():
        return p.select("page_id", "url", "html", kind.alias("kind"), refers.alias("refers"))
    alone = F.coalesce(~head | (F.col("ties") == 1), F.lit(True))
    plain = p.where(alone).select("page_id", "url", "html", kind.alias("kind"), refers.alias("refers"))
    # repeated rows of a group's largest page_id: of these the first by URL is the response
    turn = F.row_number().over(W.partitionBy("sum", "page_id").orderBy(F.col("url").asc_nulls_first()))
    again = p.where(~alone).withColumn("turn", turn)
    again = again.select("page_id", "url", "html", F.when(F.col("turn") == 1, "response").otherwise("revisit").alias("kind"), F.when(F.col("turn") > 1, F.col("first")).alias("refers"))
    return plain.unionByName(again)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def write(pages: DataFrame, to: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives; the index of their records, itself a table in the shared folder."""
    spark = pages.sparkSession
    to = to or fresh_dir(spark, "warc")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(to)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}"
        draft = posixpath.join(folder, f".{name}-{uuid.uuid4().hex}")
        at, seen, rows = 0, hashlib.sha256(), []
        out = None
        for batch in found:
            for page_id, url, text, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.open_output_stream(draft, compression=None)
                payload = text.encode()
                sum_ = digest(payload)
                raw = member(record(page_id, url, payload, kind, refers, sum_))
                out.write(raw)
                seen.update(raw)
                rows.append((at, len(raw), url, sum_, kind, page_id, record_id(page_id)))
                at += len(raw)
        if out is None:
            return
        out.close()
        file = f"{name}-{seen.hexdigest()[:16]}.warc.gz"
        store.move(draft, posixpath.join(folder, file))
        yield from batches(((f"{to}/{file}", *r) for r in rows), arrow_schema(INDEX))

    return saved(roles(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted (offset, length) rows as reads: begin, end and the rows in it."""
    begin, end, held = 0, -1, []
    for k, (at, n) in enumerate(rows):
        if held and (at > end + gap or at + n - begin > most):
            yield begin, end, held
            held = []
        if not held:
            begin, end = at, at + n
        end = max(end, at + n)
        held.append(k)
    if held:
        yield begin, end, held


READ_ROWS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The selected records: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload
    (of a revisit null, its bytes and digest as its header has them; of a response as its payload has them)."""

    def load(store, path: str, rows: list[tuple[int, int]]) -> Iterator[tuple]:
        with store.open_input_file(path) as f:
            for begin, end, held in ranges(rows):
                raw = f.read_at(end - begin, begin)
                for k in held:
                    at, n = rows[k]
                    head, body = parse(zlib.decompress(raw[at - begin : at - begin + n], 31))
                    page = head["warc-record-id"].strip("<>").removeprefix("urn:page:")
                    refers = head.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")
                    plain = head["warc-type"] == "response"
                    yield (
                        None if page == "null" else int(page), head["warc-target-uri"], head["warc-type"],
                        len(body) if plain else int(head["x-payload-length"]), digest(body) if plain else head["warc-payload-digest"].removeprefix("sha1:"),
                        int(refers) if refers not in ("", "null") else None, body if plain and with_payload else None,
                    )

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            file, held, store, path = None, [], None, ""
            for batch in found:
                for f, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if f != file or len(held) >= 5000:
                        if held:
                            yield from load(store, path, held)
                        if f != file:
                            store, path = place(f)
                        file, held = f, []
                    held.append((at, n))
            if held:
                yield from load(store, path, held)

        yield from batches(rows(), arrow_schema(READ_ROWS), 200 if with_payload else 2000)

    # ranges of one archive's stretch go to one task, in order; as many tasks as their bytes ask for, whatever the index weighs
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    dealt = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, READ_ROWS)


def digests(pages: DataFrame) -> DataFrame:
    """The columns of op3: archives written, then every record read back by its index row."""
    return read(write(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
