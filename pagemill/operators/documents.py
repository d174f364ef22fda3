"""Statistics of documents: fonts, scans, repeated marginal texts, page quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import GOOD, average_word, clamp, count_of, matches_of, normalize_for_repetition, share, strip
from .spans import KEY, plain_text, sampled_pages


def page_texts(blocks: DataFrame) -> DataFrame:
    """KEY, text: the pages' blocks in order, lines by line feeds."""
    one = F.struct("block_no", F.array_join("raw_lines", "\n").alias("t"))
    return blocks.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("text"), F.first("height").alias("height"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.max("page_number").alias("page_count"))


def inspect(pages: DataFrame, most: int = 20) -> DataFrame:
    """book_id, page_count, sampled_pages, chars, average, looks_scanned, text_quality of at most `most` pages each."""
    counts = page_counts(pages)
    wanted = counts.select("book_id", "page_count", F.explode(sampled_pages(F.col("page_count"), most)).alias("i")).select("book_id", "page_count", (F.col("i") + 1).cast("long").alias("page_number"))
    t = strip(F.col("text"))
    s = pages.join(wanted, ["book_id", "page_number"]).select("book_id", "page_count", F.length(t).alias("n"), F.regexp_count(t, F.lit(f"[{GOOD}]")).alias("good"))
    s = s.groupBy("book_id").agg(F.first("page_count").alias("page_count"), F.count("*").alias("sampled_pages"), F.sum("n").alias("chars"), F.sum("good").alias("good"))
    mean = F.col("chars").cast("double") / F.col("sampled_pages")
    return s.select("book_id", "page_count", "sampled_pages", "chars", mean.alias("average"), ((F.col("sampled_pages") > 0) & (mean < 25)).alias("looks_scanned"), F.coalesce(F.try_divide(F.col("good").cast("double"), F.col("chars").cast("double")), F.lit(0.0)).alias("text_quality"))


def median_size(spans: DataFrame, most: int = 30, default: float = 11.0) -> DataFrame:
    """book_id, median_size of spans that are not blank on the first pages; exact, so that ties split evenly."""
    size = F.when((F.col("page_number") <= most) & (F.length(strip(F.col("text"))) > 0), F.col("size"))
    return spans.groupBy("book_id").agg(F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(default)).alias("median_size"))


def repeated_marginals(blocks: DataFrame, most: int = 80, repeats: int = 3, margin: float = 0.12) -> DataFrame:
    """book_id, normalized: texts in margins of the first pages that are found in `repeats` blocks at least."""
    at = (F.col("page_number") <= most) & P.in_margin(F.col("y0"), F.col("y1"), F.col("height"), margin)
    found = blocks.where(at).select("book_id", normalize_for_repetition(plain_text(F.col("raw_lines"))).alias("normalized"))
    return found.where(F.length("normalized") >= 3).groupBy("book_id", "normalized").agg(F.count("*").alias("repeats")).where(F.col("repeats") >= repeats)


def marginal_texts(blocks: DataFrame, most: int, margin: float = 0.12, each: int = 8) -> DataFrame:
    """book_id, page_number, area, pos, text: a page's first texts at its top and bottom."""
    b = blocks.where(F.col("page_number") <= most).select("book_id", "page_number", "block_no", "y0", "y1", "height", plain_text(F.col("raw_lines")).alias("text")).where(F.length("text") > 0)
    areas = F.filter(F.array(F.when(F.col("y1") <= F.col("height") * margin, "top"), F.when(F.col("y0") >= F.col("height") * (1.0 - margin), "bottom")), lambda x: x.isNotNull())
    b = b.select("book_id", "page_number", "block_no", "text", F.explode(areas).alias("area"))
    turn = F.row_number().over(W.partitionBy("book_id", "page_number", "area").orderBy("block_no"))
    return b.withColumn("pos", turn).where(F.col("pos") <= each)


def header_footer_candidates(blocks: DataFrame, most: int = 80, repeats: int = 3, keep: int = 30) -> DataFrame:
    """book_id, area, text (as first found), normalized, repeats, rank: top before bottom, most repeats first, ties as first found."""
    t = marginal_texts(blocks, most).withColumn("normalized", normalize_for_repetition(F.col("text"))).where(P.is_useful(F.col("normalized")))
    first = F.struct("page_number", F.when(F.col("area") == "top", 0).otherwise(1).alias("a"), "pos")
    each = t.groupBy("book_id", "area", "normalized").agg(F.count("*").alias("repeats"), F.min(first).alias("seen"), F.min_by("text", first).alias("text"))
    # a text found in both areas goes by the first of either
    whole = W.partitionBy("book_id", "normalized")
    each = each.withColumn("text", F.min_by("text", "seen").over(whole))
    order = W.partitionBy("book_id").orderBy(F.col("area").desc(), F.col("repeats").desc(), "seen")
    return each.where(F.col("repeats") >= repeats).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("book_id", "area", "text", "normalized", "repeats", "rank")


PUNCT = r"/\\@#$%&*+=<>"


def page_quality(pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """KEY, score, total_chars, good_chars, garbage_chars, avg_word_length, word_count, strategy, reasons of pages (KEY, text).

    images: KEY of pages that have an image (for those with hardly any text).
    """
    p = pages.select(*KEY, "text")
    p = p.withColumn("has_image", F.lit(False)) if images is None else p.join(images.select(*KEY).distinct().withColumn("has_image", F.lit(True)), list(KEY), "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    count = lambda chars: count_of(F.col("text"), chars)
    found = lambda pattern: matches_of(F.col("text"), pattern)
    p = p.withColumns({
        "total_chars": F.length(strip(F.col("text"))), "good_chars": count(f"[{GOOD}{PUNCT}]"), "garbage_chars": count(r"[\p{Co}\p{Cn}[\p{Cc}&&[^\n\r\t]]]"),
        "word_count": found(r"(?U)\S+"), "avg_word_length": average_word(F.col("text")), "real": found(r"(?U)(?<!\S)(?=\S{3})(?=\S*?\p{L})\S++"),
        "upper": count(r"\p{IsUppercase}"), "alpha": count(r"\p{L}"), "runs": found(r"(?s)([^\n])\1{4,}"),
    })
    total, n = F.greatest("total_chars", F.lit(1)), F.greatest("word_count", F.lit(1))
    loud = (F.col("alpha") > 20) & (F.col("upper") > F.col("alpha") * 0.6)
    short = (F.col("avg_word_length") < 2.0) & (F.col("word_count") > 10)
    runs, few = F.col("runs") > 3, F.col("total_chars") < 30
    chars = F.col("good_chars") / total * F.when(loud, 0.7).otherwise(1.0) * F.when(runs, 0.8).otherwise(1.0)
    word = F.least(F.col("avg_word_length") / 4.5, F.lit(1.0)) * F.when(short, 0.5).otherwise(1.0)
    rubbish = F.least(F.col("garbage_chars") / total * 3.0, F.lit(1.0))
    score = clamp(chars * 0.35 + word * 0.20 + F.col("real") / n * 0.25 - rubbish * 0.20, 0.0, 1.0)
    empty, picture = F.col("total_chars") == 0, few & F.col("has_image")
    score = F.when(empty, 0.0).when(picture, 0.2).otherwise(score)
    p = p.withColumn("score", score).withColumn("strategy", F.when(empty | picture, "facsimile").otherwise(P.strategy(F.col("score"))))
    told = F.array_compact(F.array(
        F.when(empty, "empty text"), F.when(~empty & loud, F.format_string("mostly capitals: %.0f%%", F.coalesce(F.try_divide(F.col("upper") * 100.0, F.col("alpha")), F.lit(0.0)))),
        F.when(~empty & short, F.format_string("very short words: avg=%.1f", "avg_word_length")), F.when(~empty & runs, F.format_string("repeated characters: %d", "runs")),
        F.when(~empty & few, F.format_string("hardly any text: %d characters", "total_chars")), F.when(~empty & ~picture & (F.col("garbage_chars") > F.col("total_chars") * 0.15), F.format_string("much rubbish: %d/%d", "garbage_chars", "total_chars")),
    ))
    verdict = F.when(F.col("score") > 0.7, "good text").when(F.col("score") > 0.3, "middling text, hybrid").otherwise("poor text, facsimile")
    return p.withColumn("reasons", F.when(F.size(told) > 0, told).otherwise(F.array(verdict))).select(*KEY, "score", "total_chars", "good_chars", "garbage_chars", "avg_word_length", "word_count", "strategy", "reasons")


def quality_summary(quality: DataFrame) -> DataFrame:
    """A row a book: how many pages were scored, mean, least and greatest score, pages by strategy."""
    kind = lambda k: F.count_if(F.col("strategy") == k)
    return quality.groupBy("book_id").agg(F.count("*").alias("total_scored"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), kind("text").alias("text_pages"), kind("hybrid").alias("hybrid_pages"), kind("facsimile").alias("facsimile_pages"))


def classify(blocks: DataFrame, marginals: DataFrame, sizes: DataFrame, profile) -> DataFrame:
    """Blocks with kind, level and reason by the profile's decision list.

    marginals: book_id, normalized; sizes: book_id, median_size. Flags of the profile are settled when the plan
    is made, so what it leaves out is not in the plan.
    """
    b = blocks.join(sizes.select("book_id", "median_size"), "book_id", "left").withColumn("median_size", F.coalesce("median_size", F.lit(11.0)))
    if profile.remove_headers_footers:
        # a book's are few, from its first pages: blocks are not dealt out by text, and only those in margins are looked up
        m = marginals.groupBy("book_id").agg(F.collect_set("normalized").alias("known"))
        b = b.join(m, "book_id", "left")
    text, size = F.col("text"), F.col("max_size")
    rules: list[tuple[Column, object, Column, str]] = [(F.length(text) == 0, "unknown", F.lit(0), "empty")]
    if profile.remove_headers_footers:
        again = P.in_margin(F.col("y0"), F.col("y1"), F.col("height")) & F.coalesce(F.array_contains("known", normalize_for_repetition(text)), F.lit(False))
        rules.append((again & (F.col("y0") < F.col("height") * 0.5), "header", F.lit(0), "repeated at the top"))
        rules.append((again, "footer", F.lit(0), "repeated at the bottom"))
    rules.append((P.is_page_number(text, F.col("y0"), F.col("y1"), F.col("height")), "footer", F.lit(0), "page number"))
    rules.append((P.is_caption(text), "caption", F.lit(0), "caption"))
    if profile.preserve_code_blocks:
        rules.append((P.is_code(F.col("lines"), F.col("mono_share")), "code", F.lit(0), "code"))
    if profile.detect_tables:
        rules.append((P.is_table(F.col("lines")), "table", F.lit(0), "table"))
    if profile.detect_headings:
        rules.append((P.is_heading(text, size, F.col("median_size")), "heading", P.heading_level(text, size, F.col("median_size")), "size"))
    out = None
    for test, kind, level, reason in rules:
        value = F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), F.lit(reason).alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    out = out.otherwise(F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.lit("default").alias("reason")))
    # made rows of one, so that a filter on the kind stays behind it and the list is worked out once
    return b.select(*blocks.columns, F.inline(F.array(out)).alias("kind", "level", "reason"))
