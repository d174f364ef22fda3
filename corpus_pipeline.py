"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes what the one before kept, as written and read again, and decides for itself:

1. quality classifier: fitted on the labels of the documents it is given; documents it rejects go.
2. SimHash near-dedup: of each component, of fingerprints as in op5 and of texts whose five-word shingles have a Jaccard
   similarity of 0.8 at least (near.py), the document with the smallest doc_id stays.
3. substring dedup: words of 35-word windows found twice go; documents left without words go.
4. mixing: documents as often as the mix takes them, the last one of a source cut at its budget.
5. byte-level BPE: token ids.

A doc_id may be null or repeated: stages 2 and 3 tell rows apart by a key that they write with them, and a
row goes for its text only. All stages but the last return the columns of documents.

A stage's tables in the shared folder are deleted when the next stage is called, whose docs are by then written and read
again; while docs still read them they stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, classifier, mixing, simhash, substring
from pagemill.llm.common import discard, saved, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the stage called last.
_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, after deleting what the one before has left and docs does not read."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        if not any(folder.rsplit("/", 1)[-1] in f for folder in _left for f in read):
            discard(spark, _left)
            _left.clear()
        with scratch() as held:
            out = stage(spark, docs, sf_dir)
        _left.extend(held)
        return out

    return run_stage


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is classifier.KEEP at least."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.accepted(docs, model)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints at simhash.RADIUS bits and of texts whose five-word shingles are similar."""
    return simhash.near_dedup(docs)


@tidy
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows."""
    return substring.deduplicated(docs)


@tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights."""
    return mixing.mix(docs)


@tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: The classifier's fit, the fingerprints' hash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
