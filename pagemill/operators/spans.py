"""Spans to lines to blocks: repair, fake bold, kerning, crops and excluded regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import full_repair, normalize_line, normalize_spaces, rstrip

KEY = ("book_id", "page_number")


def sampled_pages(count: Column, most: int = 20) -> Column:
    """Page indices, evenly over a document: all if there are no more than most, else int(i * n / most)."""
    return F.when(count <= most, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * count / most)))
    )


def repaired(spans: DataFrame) -> DataFrame:
    """Spans with text repaired, empty ones left out."""
    return spans.where(F.length("text") > 0).withColumn("text", full_repair(F.col("text")))


def bold_pages(spans: DataFrame) -> DataFrame:
    """Of each page whether its bold is fake: over 40% of 50 characters at least."""
    n = F.length(F.trim("text"))
    page = spans.groupBy(*KEY).agg(F.sum(n).alias("chars"), F.sum(F.when(P.is_bold(F.col("flags"), F.col("font")), n).otherwise(0)).alias("bold"))
    return page.select(*KEY, "chars", "bold", ((F.col("chars") >= 50) & (F.col("bold") > F.col("chars") * 0.40)).alias("fake_bold"))


def normalize_bold(spans: DataFrame) -> DataFrame:
    """Spans with the bold bit taken off on pages where it is fake."""
    fake = bold_pages(spans).select(*KEY, "fake_bold")
    return spans.join(fake, list(KEY)).withColumn("flags", F.when(F.col("fake_bold"), F.col("flags").bitwiseAND(~P.BOLD)).otherwise(F.col("flags")))


def clipped(spans: DataFrame, crop: dict) -> DataFrame:
    """Spans that meet the page's crop rectangle; the filter is on columns of the scan."""
    r = P.clip_rect(F.col("width"), F.col("height"), crop)
    return spans.where(P.rects_meet([F.col(c) for c in ("x0", "y0", "x1", "y1")], [r["x0"], r["y0"], r["x1"], r["y1"]]))


def without_margins(spans: DataFrame, header: float = 50.0, footer: float = 45.0) -> DataFrame:
    """Spans between a header's and a footer's height."""
    return spans.where((F.col("y1") > header) & (F.col("y0") < F.col("height") - footer))


def without_regions(spans: DataFrame, regions: list[dict]) -> DataFrame:
    """Spans outside of all excluded regions ({pages, rect}); rules are few and become one filter."""
    out = spans
    for r in regions:
        meets = P.rects_meet([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.lit(float(v)) for v in r["rect"]])
        out = out.where(~(P.page_in(F.col("page_number"), r.get("pages", "")) & meets))
    return out


def anti_regions(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """The same with regions as a table (page_lo, page_hi, x0, y0, x1, y1): an anti join on overlap."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in ("page_lo", "page_hi", "x0", "y0", "x1", "y1")])
    meets = P.rects_meet([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    return spans.join(r, F.col("page_number").between(F.col("r_page_lo"), F.col("r_page_hi")) & meets, "left_anti")


SPAN = "struct<text:string,font:string,size:double,flags:int,x0:double,y0:double,x1:double,y1:double>"


def merge_kerning(spans: Column, expected: float = 0.0) -> Column:
    """Ordered spans of a line with those that kerning parted put together: same font and about the same
    size and height, less than 0.3 of a space between. The first one's font, size and flags stay."""

    def fits(a: Column, b: Column) -> Column:
        space = F.lit(expected) if expected > 0 else a["size"] * 0.25
        gap = b["x0"] - a["x1"]
        return (a["font"] == b["font"]) & (F.abs(a["size"] - b["size"]) < 0.5) & (gap > -1.0) & (gap < space * 0.3) & (F.abs(a["y0"] - b["y0"]) < 2.0)

    def step(done: Column, b: Column) -> Column:
        a = F.try_element_at(done, F.lit(-1))
        one = F.struct(
            F.concat(a["text"], b["text"]).alias("text"), a["font"].alias("font"), a["size"].alias("size"), a["flags"].alias("flags"),
            a["x0"].alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), b["x1"].alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
        ).cast(SPAN)
        joined = F.coalesce(fits(a, b), F.lit(False))
        return F.when(joined, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(done, F.array(b.cast(SPAN))))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def lines(spans: DataFrame) -> DataFrame:
    """A row a line (KEY, block_no, line_no): spans in order, kerning merged; its text and rectangle."""
    one = F.struct("span_no", F.struct("text", "font", "size", "flags", "x0", "y0", "x1", "y1").cast(SPAN).alias("s"))
    found = spans.groupBy(*KEY, "block_no", "line_no").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("spans"))
    found = found.withColumn("spans", merge_kerning(F.col("spans")))
    return found.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), ""))


def blocks(spans: DataFrame) -> DataFrame:
    """A row a block: its lines' texts in order, normalised lines, largest size, share in fixed-width fonts,
    rectangle and line height. Spans need no line_no or span_no if a block is a line."""
    s = spans
    for c in ("line_no", "span_no"):
        s = s if c in s.columns else s.withColumn(c, F.lit(0))
    n = F.length("text")
    found = s.groupBy(*KEY, "block_no").agg(
        F.first("width").alias("width"), F.first("height").alias("height"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("max_size"), F.sum(n).alias("chars"), F.sum(F.when(P.font_is_mono(F.col("font")), n).otherwise(0)).alias("mono"), F.max(F.col("y1") - F.col("y0")).alias("line_height"),
        F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text"))).alias("parts"),
    )
    # runs of spans of one line, put together
    raw = F.aggregate(
        "parts",
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("int").alias("at")),
        lambda a, p: F.struct(
            F.when(a["at"].eqNullSafe(p["line_no"]), F.concat(F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a["done"], F.lit(-1)), p["text"])))).otherwise(F.concat(a["done"], F.array(p["text"]))).alias("done"),
            p["line_no"].cast("int").alias("at"),
        ),
        lambda a: a["done"],
    )
    found = found.withColumn("raw_lines", raw).drop("parts")
    found = found.withColumn("lines", F.filter(F.transform("raw_lines", normalize_line), lambda x: F.length(x) > 0))
    mono = F.coalesce(F.try_divide(F.col("mono").cast("double"), F.col("chars").cast("double")), F.lit(0.0))
    return found.select(*KEY, "block_no", "width", "height", "x0", "y0", "x1", "y1", "max_size", "line_height", mono.alias("mono_share"), "raw_lines", "lines", normalize_spaces(F.array_join("lines", " ")).alias("text"))


def plain_text(raw: Column) -> Column:
    """A block's lines, each folded, empty ones left out, as one text."""
    return normalize_spaces(F.array_join(F.filter(F.transform(raw, normalize_spaces), lambda x: F.length(x) > 0), " "))


def large_images(images: DataFrame, least: float = 20.0) -> DataFrame:
    """Image blocks but for those small in both directions, and those without bytes."""
    small = ((F.col("x1") - F.col("x0")) < least) & ((F.col("y1") - F.col("y0")) < least)
    return images.where(~small & (F.octet_length("image") > 0))


def merge_paragraphs(blocks_: Column) -> Column:
    """Ordered blocks of a page (kind, text, y0, y1, line_height, members) with paragraphs that go on put together."""

    def fits(a: Column, b: Column) -> Column:
        head = b["text"]
        goes_on = head.rlike(r"^\p{IsLowercase}") | head.rlike("^[(«“]")
        marked = head.rlike("^[•–—]") | head.rlike(r"^\p{Nd}+[.)\s]") | head.rlike(r"^\p{IsUppercase}")
        ended = rstrip(a["text"]).rlike("[.!?;:»\"”]$")
        near = (b["y0"] - a["y1"]) <= F.coalesce(a["line_height"], F.lit(14.0)) * 2.0
        return (a["kind"] == "paragraph") & (b["kind"] == "paragraph") & (F.length(a["text"]) > 0) & (F.length(head) > 0) & ~ended & ~marked & near & goes_on

    def step(done: Column, b: Column) -> Column:
        a = F.try_element_at(done, F.lit(-1))
        one = F.struct(
            b["kind"].alias("kind"), F.concat(a["text"], F.lit(" "), b["text"]).alias("text"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["y1"], b["y1"]).alias("y1"),
            F.greatest(a["line_height"], b["line_height"]).alias("line_height"), F.concat(a["members"], b["members"]).alias("members"),
        ).cast(MERGED)
        return F.when(F.coalesce(fits(a, b), F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(done, F.array(b.cast(MERGED))))

    return F.aggregate(blocks_, F.array().cast(f"array<{MERGED}>"), step)


MERGED = "struct<kind:string,text:string,y0:double,y1:double,line_height:double,members:array<int>>"
