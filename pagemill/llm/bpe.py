"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, from its first
character, so chunks need not wait for each other. Two neighbours' pre-token boundaries are then
compared within their overlap: at the first boundary both have, the pre-tokeniser has no memory
left of where it began, so all later boundaries of the right chunk are the text's own. The text is
cut there, and each piece is encoded. Where an overlap holds no common boundary (one
pre-token longer than the overlap), the left chunk is extended by its neighbour.

Chunks of one text run one after another in a task, but for texts of more than LONG characters: theirs are dealt
out over the cluster (spread()), by the same steps.

Decoding concatenates the ids' raw bytes.

Defined results: null text is the empty text (no ids); repeated rows each give a row; a null
doc_id is kept; other columns are ignored; an empty table gives an empty table; texts may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_row, pick

#: Characters in a chunk, and in the overlap of two.
CHUNK, OVERLAP = 2_048, 128
#: Texts above this many characters have their chunks, of so many characters, dealt out over the cluster.
LONG, LONG_CHUNK = 1 << 20, 1 << 16


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def tokens(text: str, split: regex.Pattern) -> list[str]:
    """The pre-tokens of text, as whole matches."""
    return [m[0] for m in split.finditer(text)] if split.groups else split.findall(text)


def resync(left: list[str], right: list[str], left_end: int, right_begin: int, text: str) -> tuple[int, int, int] | None:
    """The first offset of text that is a boundary of two neighbours' pre-tokens, with a character other than white
    space before it (a run of white space looks one character ahead): the offset, and how many pre-tokens of the left
    and of the right chunk stand before it; or None.

    The left chunk's last boundary is its own end and may be false.
    """
    at, k, ends = left_end, len(left), {}
    while k and at - len(left[k - 1]) >= right_begin:
        k -= 1
        at -= len(left[k])
        ends[at] = k
    for m, x in enumerate(accumulate(map(len, right), initial=right_begin)):
        if x >= left_end:
            return None
        if x in ends and x and not text[x - 1].isspace():
            return x, ends[x], m
    return None


def pieces(text: str, split: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Begin and end of each stitched piece of text."""
    n = len(text)
    begin, end = 0, min(n, chunk + overlap)
    left = tokens(text[:end], split)
    for at in range(chunk, n - overlap, chunk):
        stop = min(n, at + chunk + overlap)
        right = tokens(text[at:stop], split)
        if (met := resync(left, right, end, at, text)) is None:
            left = tokens(text[begin:stop], split)
        else:
            at, _, m = met
            yield begin, at
            begin, left = at, right[m:]
        end = stop
    yield begin, n


class Codec:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, path: str | None = None, pat: str | None = None):
        import tiktoken

        with open(path or vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pat or pattern())
        self.piece = tiktoken.Encoding("ranks", pat_str=pat or pattern(), mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        return [x for a, b in pieces(text, self.split, chunk, overlap) for x in self.piece.encode_ordinary(text[a:b])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encoded(docs: DataFrame, make: Callable[[Codec], Callable[..., tuple]], schema: str, path: str | None = None, pat: str | None = None) -> DataFrame:
    """make(codec)(doc_id, lang, source, ids) of every row, in the pass that encodes it; chunks of long texts are encoded in
    tasks of their own (see spread)."""
    d = pick(docs, doc_id="long", text="string", lang="string", source="string").withColumn("text", F.coalesce("text", F.lit("")))

    def short():
        codec = Codec(path, pat)
        row = make(codec)

        def one(doc_id, text, lang, source):
            yield row(doc_id, lang, source, codec.encode(text))

        return one

    def long():
        row = make(Codec(path, pat))

        def one(doc_id, lang, source, ids):
            yield row(doc_id, lang, source, ids)

        return one

    many = d.where(F.length("text") > LONG).withColumn("digest", F.sha2("text", 256))
    found = many.drop("text").join(spread(many.select("digest", "text"), path, pat), "digest").select("doc_id", "lang", "source", "ids")
    return by_row(d.where(F.length("text") <= LONG), short, schema, 500).unionByName(by_row(found, long, schema, 16))


def encode(docs: DataFrame, path: str | None = None, pat: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every row."""
    return encoded(docs, lambda codec: lambda doc_id, lang, source, ids: (doc_id, lang, source, len(ids), np.array(ids, np.int32)), "doc_id long, lang string, source string, n_tokens int, ids array<int>", path, pat)


def spread(texts: DataFrame, path: str | None = None, pat: str | None = None, chunk: int = LONG_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """digest, ids of each different text (digest, text), its chunks dealt out over the cluster.

    Chunks have their overlaps with them; each finds where its right neighbour takes over; a
    window over the text's chunks (a few rows each) tells each chunk where it starts, and chunks
    without a common boundary join the next one; the pieces are encoded and put together in order.
    """

    def chunks():
        def one(digest, text):
            for k, at in enumerate(range(0, max(1, len(text)), chunk)):
                yield digest, k, text[at : at + chunk + overlap], at + chunk >= len(text)

        return one

    def cut():
        split = regex.compile(pat or pattern())

        def one(digest, k, text, last):
            met = None if last else resync(tokens(text, split), tokens(text[chunk:], split), len(text), chunk, text)
            yield digest, k, text[: len(text) if last else chunk], text[chunk:], -2 if last else met[0] if met else -1

        return one

    def joined():
        codec = Codec(path, pat)

        def one(digest, k, parts):
            # parts: the chunks of one group in order, each as (k, start, text, tail, cut); the last ends at its cut
            whole = "".join(p["text"] for p in parts) + (parts[-1]["tail"] if parts[-1]["cut"] >= 0 else "")
            end = len(whole) if parts[-1]["cut"] < 0 else sum(len(p["text"]) for p in parts[:-1]) + parts[-1]["cut"]
            yield digest, k, codec.encode(whole[parts[0]["start"] : end])

        return one

    dealt = by_row(texts.dropDuplicates(["digest"]), chunks, "digest string, k int, text string, last boolean", 16)
    known = by_row(dealt.repartition("digest", "k"), cut, "digest string, k int, text string, tail string, cut int", 16)
    order = W.partitionBy("digest").orderBy("k")
    known = known.withColumn("before", F.lag("cut").over(order))
    known = known.withColumns({"g": F.sum(F.when((F.col("before") >= 0) | F.col("before").isNull(), 1).otherwise(0)).over(order), "start": F.when(F.col("before") >= 0, F.col("before") - chunk).otherwise(0)})
    grouped = known.groupBy("digest", "g").agg(F.min("k").alias("k"), F.array_sort(F.collect_list(F.struct("k", "start", "text", "tail", "cut"))).alias("parts")).drop("g")
    ids = by_row(grouped, joined, "digest string, k int, ids array<int>", 16)
    return ids.groupBy("digest").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes of ids (doc_id, ids); null ids are no ids."""

    def make():
        codec = Codec(path)

        def one(doc_id, found):
            yield doc_id, codec.decode(found or [])

        return one

    return by_row(pick(ids, doc_id="long", ids="array<int>"), make, "doc_id long, bytes binary", 200)


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of op6: of the ids, and of the bytes that they decode to, in the pass that encodes."""

    def make(codec):
        def row(doc_id, lang, source, ids) -> tuple:
            return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return row

    return encoded(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
