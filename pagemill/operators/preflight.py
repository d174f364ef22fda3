"""Preflight: what a book is like before it is converted, and the rules to convert it by."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import normalize_spaces, words
from .chapters import page_ranges
from .documents import header_footer_candidates, inspect, page_texts
from .spans import KEY

CROP = {"mode": "ratio", "top_ratio": 0.07, "bottom_ratio": 0.065, "left_ratio": 0.0, "right_ratio": 0.0}


def analyze_pages(pages: DataFrame, images: DataFrame | None = None, most: int = 40) -> DataFrame:
    """KEY, text_chars, word_count, image_count and markers of the first pages (KEY, text)."""
    p = pages.where(F.col("page_number") <= most).withColumn("plain", normalize_spaces(F.col("text")))
    if images is None:
        p = p.withColumn("image_count", F.lit(0).cast("long"))
    else:
        p = p.join(images.groupBy(*KEY).agg(F.count("*").alias("image_count")), list(KEY), "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))
    low = F.lower("plain")
    return p.select(*KEY, F.length("plain").alias("text_chars"), F.size(words(F.col("text"))).alias("word_count"), "image_count", P.has_toc_markers(low).alias("has_toc_markers"), P.has_code_markers(low).alias("has_code_markers"), F.col("text").rlike(r"\.{5,}").alias("has_dot_leaders"))


def run(blocks: DataFrame, images: DataFrame | None = None, pages_most: int = 40, margins_most: int = 80) -> DataFrame:
    """A row a book: statistics, candidate pages, candidates for headers and footers, profile, OCR mode, warnings."""
    pages = page_texts(blocks)
    stats = inspect(pages)
    page = analyze_pages(pages, images, pages_most)
    toc = F.col("has_toc_markers") | F.col("has_dot_leaders")
    listed = lambda test: F.array_sort(F.array_compact(F.collect_list(F.when(test, F.col("page_number")))))
    per = page.groupBy("book_id").agg(F.count("*").alias("analyzed_pages"), F.sum("image_count").alias("images"), listed(toc).alias("toc_pages"), listed(F.col("has_code_markers")).alias("code_pages"), listed((F.col("text_chars") < 50) & (F.col("image_count") > 0)).alias("low_text_pages"))
    c = header_footer_candidates(blocks, margins_most)
    cand = c.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "area", "text", "normalized", "repeats"))), lambda x: F.struct(x["area"].alias("area"), x["text"].alias("text"), x["normalized"].alias("normalized"), x["repeats"].alias("repeats"))).alias("candidates"))
    r = stats.join(per, "book_id").join(cand, "book_id", "left")
    has = lambda name: F.size(F.coalesce(F.col(name), F.array().cast(dict(r.dtypes)[name]))) > 0
    many = F.col("images") >= F.greatest(F.lit(8), F.floor(F.col("analyzed_pages") / 2))
    profile = F.when(F.col("looks_scanned"), "hybrid").when(has("code_pages"), "technical").when(has("toc_pages") & many, "hybrid").otherwise("technical")
    told = F.array_compact(F.array(
        F.when(F.col("looks_scanned"), "The text layer is weak or missing: use OCR."),
        F.when(has("toc_pages"), "Pages like a table of contents: convert dotted leaders by meaning."),
        F.when(has("code_pages"), "Pages with code: use profile technical or hybrid."),
        F.when(has("candidates"), "Repeated headers or footers: remove them, crop moderately."),
        F.when(has("low_text_pages"), F.concat(F.lit("Images with little text, consider OCR: "), F.array_join(F.transform(F.slice("low_text_pages", 1, 20), lambda x: x.cast("string")), ", "))),
    ))
    return r.select("book_id", "page_count", "sampled_pages", "average", "looks_scanned", "text_quality", "toc_pages", "code_pages", "low_text_pages", "candidates", profile.alias("recommended_profile"), F.when(F.col("looks_scanned"), "auto").otherwise("off").alias("recommended_ocr_mode"), told.alias("warnings"))


def recommended_rules(report: DataFrame) -> DataFrame:
    """book_id, rules: JSON of the rules to convert each book by."""
    ranges = page_ranges(report.select("book_id", F.explode("toc_pages").alias("page_number")))
    r = report.select("book_id").join(ranges, "book_id", "left").withColumn("ranges", F.coalesce("ranges", F.lit("")))
    lit = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    rules = F.struct(
        lit(CROP).alias("crop"),
        F.struct(F.when(F.col("ranges") != "", "semantic").otherwise("auto").alias("mode"), F.col("ranges").alias("pages"), F.lit(True).alias("drop_original_dot_leaders")).alias("toc"),
        lit({"remove_repeated": True, "remove_page_numbers": True, "top_ratio": 0.12, "bottom_ratio": 0.12, "min_repeats": 3}).alias("headers_footers"),
        lit({"repair_git_spacing": True, "detect_commit_blocks": True, "detect_diff_blocks": True}).alias("code"),
        F.array().cast("array<string>").alias("exclude_regions"),
    )
    return r.select("book_id", F.to_json(rules).alias("rules"))


def summary(report: DataFrame) -> DataFrame:
    """book_id, summary: the report as text; at most 30 code pages and 10 candidates are named."""
    pages = lambda c, n=None: F.array_join(F.transform(F.slice(c, 1, n) if n else F.col(c), lambda x: x.cast("string")), ", ")
    lines = F.array_compact(F.array(
        F.format_string("Book: %d", "book_id"), F.format_string("Pages: %d", "page_count"), F.concat(F.lit("Looks scanned: "), F.col("looks_scanned").cast("string")),
        F.format_string("Average characters a sampled page: %.1f", "average"), F.concat(F.lit("Recommended profile: "), "recommended_profile"), F.concat(F.lit("Recommended OCR mode: "), "recommended_ocr_mode"),
        F.lit(f"Recommended crop: top={CROP['top_ratio']}, bottom={CROP['bottom_ratio']}"),
        F.when(F.size("toc_pages") > 0, F.concat(F.lit("Contents pages: "), pages("toc_pages"))), F.when(F.size("code_pages") > 0, F.concat(F.lit("Code pages: "), pages("code_pages", 30))),
        F.when(F.size("candidates") > 0, F.concat(F.lit("Repeated headers and footers:\n"), F.array_join(F.transform(F.slice("candidates", 1, 10), lambda c: F.concat(F.lit("  - ["), c["area"], F.lit("] x"), c["repeats"].cast("string"), F.lit(": "), c["text"])), "\n"))),
        F.when(F.size("warnings") > 0, F.concat(F.lit("Warnings:\n  - "), F.array_join("warnings", "\n  - "))),
    ))
    return report.select("book_id", F.array_join(lines, "\n").alias("summary"))


def write_json(report: DataFrame, path: str) -> None:
    """Reports as JSON, a file a task, in any store Spark writes to."""
    report.write.mode("overwrite").json(path)


def pretty(row_json: str) -> str:
    """One report's JSON with indents, other letters than ASCII as they are."""
    return json.dumps(json.loads(row_json), ensure_ascii=False, indent=2)
