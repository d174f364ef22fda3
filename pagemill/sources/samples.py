"""Views of the sample tables that have what the operators repair and find: seeded texts and laid-out books.

Both are plain functions of doc_id and text, so that any SQL engine can build the same (see *_SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What text number doc_id % 16 begins with.
SEEDS = (
    "The compu-\nter net- work is a well-known inter-\n  net topic\nand goes on here.",
    "Contents\nChapter 1 Basics ........ 12\nChapter 2 More ....... 15\n1.2 Parts of it . . 9\nSection 3.1 Tools ......... 27\nЧто-то\nГлава 4 Сети .......... 31",
    "Page 12\n стр. 7\n1987\n42\n12345\nA line of text , with ( odd ) blanks !\nСТР. 9",
    "• one\n■ two\n□ □ three\n- four\n★ five\nz z six\nzz seven\nx = 5 & y",
    "Ã©tÃ©  bullet space ﬁne oﬃce soft­hyphen ＡＢＣ dash‒― zero​width  wide é",
    "$ sudo apt-get install git\ngit comm it -m fix\ncommi t 3f2a91b\nAutho r: A\nls -la /tmp",
    "commit 3f2a 91bc\nAuthor: A\nDate: today\ndiff --git a b\nindex 12\n--- a\n+++ b\n@@ 1\n+x\n-y",
    "[section]\nkey = value\npath: /usr/bin\nname = x{y}\n}\nserver {",
    "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |",
    "name\tsize\tkind\n" + "\n".join(f"row{i}\t{i}\tx" for i in range(9)),
    "We have $a^2 + b_1$ and $$\\frac{x}{y}$$ and \\[\\alpha + \\sum\\] with ∑∏∫ αβγδ here.",
    "Figure 3 shows it\nfig. 2\nрисунок 5\na.\n1 2 3 4 5 6\n0.1 0.2 0.3 ok",
    "Глава 1 Начало\nCHAPTER 2 THE END OF ALL\nAAAAA BBBBB CCCCC DDDDD EEEEE\n1.1 one\n1.1.1 two\npart 3 three",
    "col one   col two   col three\n" + "\n".join(f"{i}item    {i}00       y{i}" for i in range(9)),
    "first line ends here.\nsecond begins\n(in brackets)\nЛиния\nпродолжается\n\n\nnew-\npara and more ... dots..... end",
    "<b>\"bold\" & 'it'</b>  My File: Name?.txt",
)
#: Lines on a page, documents in a book.
PAGE, BOOK = 4, 20
WIDTH, HEIGHT = 595.0, 842.0


def _sql_text(s: str) -> str:
    parts: list[str] = []
    for c in s:
        if c in "\n\t\\'":
            parts.append(f"' || chr({ord(c)}) || '")
        else:
            parts.append(c)
    return "'" + "".join(parts) + "'"


SEEDED_SQL = "SELECT doc_id, CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN {_sql_text(s)}" for k, s in enumerate(SEEDS)) + " END || chr(10) || text AS t FROM documents"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: every document's text after its seed."""
    seed = F.get(F.array(*map(F.lit, SEEDS)), (F.col("doc_id") % 16).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat(seed, F.lit("\n"), F.col("text")).alias("t"))


LAYOUT_COLUMNS = ("book_id", "page_number", "block_no", "text", "font", "size", "flags", "x0", "y0", "x1", "y1", "width", "height")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of books of 20 documents: a block a line, PAGE lines a page, a running header and a page number each page."""
    docs = documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / BOOK).cast("long").alias("book_id"), F.split("text", "\n", -1).alias("rows"))
    pages = F.ceil(F.size("rows") / F.lit(PAGE)).cast("long")
    first = F.coalesce(F.sum("pages").over(W.partitionBy("book_id").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = docs.withColumn("pages", pages).withColumn("first", first)
    lines = placed.select("doc_id", "book_id", "first", F.posexplode("rows").alias("line_no", "text"))
    spot = F.pmod("line_no", F.lit(PAGE))
    body = lines.select(
        "book_id",
        (1 + F.col("first") + F.floor(F.col("line_no") / PAGE)).cast("long").alias("page_number"),
        (1 + spot).cast("int").alias("block_no"),
        "text",
        F.when(F.col("doc_id") % 5 == 0, "Courier Mono").when(F.col("doc_id") % 7 == 0, "Body-Bold").otherwise("Body").alias("font"),
        F.when(F.col("line_no") == 0, 18.0).otherwise(11.0).alias("size"),
        F.when(F.col("doc_id") % 3 == 0, 16).otherwise(0).alias("flags"),
        F.lit(50.0).alias("x0"),
        (120.0 + 40.0 * spot).alias("y0"),
        F.lit(545.0).alias("x1"),
        (132.0 + 40.0 * spot).alias("y1"),
    )
    each = placed.select("book_id", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("pages"))).alias("page_number"))
    head = each.select("book_id", "page_number", F.lit(0).alias("block_no"), F.format_string("Book %d page %d", "book_id", "page_number").alias("text"), F.lit("Body").alias("font"), F.lit(9.0).alias("size"), F.lit(0).alias("flags"), F.lit(50.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(545.0).alias("x1"), F.lit(32.0).alias("y1"))
    foot = each.select("book_id", "page_number", F.lit(99).alias("block_no"), F.concat(F.lit("— "), F.col("page_number").cast("string"), F.lit(" —")).alias("text"), F.lit("Body").alias("font"), F.lit(9.0).alias("size"), F.lit(0).alias("flags"), F.lit(50.0).alias("x0"), F.lit(812.0).alias("y0"), F.lit(545.0).alias("x1"), F.lit(824.0).alias("y1"))
    return body.unionByName(head).unionByName(foot).withColumn("width", F.lit(WIDTH)).withColumn("height", F.lit(HEIGHT))


LAYOUT_SQL = f"""
 placed AS (SELECT doc_id, book_id, ls, ceil(len(ls) / {PAGE}.0)::BIGINT AS pages,
    coalesce(sum(ceil(len(ls) / {PAGE}.0)) OVER (PARTITION BY book_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
   FROM (SELECT doc_id, doc_id // {BOOK} AS book_id, string_split(text, chr(10)) AS ls FROM documents)),
 lined AS (SELECT doc_id, book_id, first, unnest(ls) AS text, unnest(range(len(ls))) AS line_no FROM placed),
 eachpage AS (SELECT book_id, unnest(range(first + 1, first + pages + 1)) AS page_number FROM placed),
 spans AS (
  SELECT book_id, (1 + first + line_no // {PAGE})::BIGINT AS page_number, (1 + line_no % {PAGE})::INT AS block_no, text,
    CASE WHEN doc_id % 5 = 0 THEN 'Courier Mono' WHEN doc_id % 7 = 0 THEN 'Body-Bold' ELSE 'Body' END AS font,
    CASE WHEN line_no = 0 THEN 18.0 ELSE 11.0 END::DOUBLE AS size, CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 0 END AS flags,
    50.0::DOUBLE AS x0, (120 + 40 * (line_no % {PAGE}))::DOUBLE AS y0, 545.0::DOUBLE AS x1, (132 + 40 * (line_no % {PAGE}))::DOUBLE AS y1, {WIDTH}::DOUBLE AS width, {HEIGHT}::DOUBLE AS height FROM lined
  UNION ALL SELECT book_id, page_number, 0, 'Book ' || book_id || ' page ' || page_number, 'Body', 9.0, 0, 50.0, 20.0, 545.0, 32.0, {WIDTH}, {HEIGHT} FROM eachpage
  UNION ALL SELECT book_id, page_number, 99, '— ' || page_number || ' —', 'Body', 9.0, 0, 50.0, 812.0, 545.0, 824.0, {WIDTH}, {HEIGHT} FROM eachpage)
"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, pos, level, title, page_number: a row a document; every fourth book's titles are all the same."""
    docs = documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / BOOK).cast("long").alias("book_id"), F.split("text", "\n", -1).alias("rows"))
    pages = F.ceil(F.size("rows") / F.lit(PAGE)).cast("long")
    first = F.coalesce(F.sum(pages).over(W.partitionBy("book_id").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    title = F.when(F.col("book_id") % 4 == 3, "Same").otherwise(F.concat(F.lit("  Part  "), F.col("doc_id").cast("string")))
    return docs.select("book_id", "doc_id", first.alias("first"), title.alias("title")).select("book_id", F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 6 == 5, 2).otherwise(1).alias("level"), "title", (F.col("first") + 1).alias("page_number"))


OUTLINE_SQL = """
 outline AS (SELECT book_id, doc_id AS pos, CASE WHEN doc_id % 6 = 5 THEN 2 ELSE 1 END AS level,
    CASE WHEN book_id % 4 = 3 THEN 'Same' ELSE '  Part  ' || doc_id END AS title, first + 1 AS page_number FROM placed)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, page_number, word_no, word, x0, y0, x1, y1 (of 1000), label, confidence: as a layout model would give them."""
    s = layout(spark, sf_dir).where("block_no BETWEEN 1 AND 98")
    w = s.select("book_id", "page_number", "block_no", F.posexplode(F.filter(F.split("text", " ", -1), lambda x: x != "")).alias("k", "word"))
    return w.select(
        "book_id", "page_number", (F.col("block_no") * 100000 + F.col("k")).cast("int").alias("word_no"), "word",
        (80 + 30 * F.pmod("k", F.lit(25))).cast("int").alias("x0"), (140 + 48 * (F.col("block_no") - 1)).cast("int").alias("y0"),
        (105 + 30 * F.pmod("k", F.lit(25))).cast("int").alias("x1"), (156 + 48 * (F.col("block_no") - 1)).cast("int").alias("y1"),
        F.when(F.pmod(F.col("page_number") + F.col("block_no"), F.lit(5)) == 0, 1).when(F.pmod(F.col("page_number") + F.col("block_no"), F.lit(7)) == 0, 4).otherwise(2).alias("label"),
        ((50 + F.pmod(F.col("page_number") * 7 + F.col("block_no") * 13 + F.col("k"), F.lit(50))) / 100.0).cast("double").alias("confidence"),
    )


PREDICTIONS_SQL = """
 chopped AS (SELECT book_id, page_number, block_no, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM spans WHERE block_no BETWEEN 1 AND 98),
 worded AS (SELECT book_id, page_number, block_no, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM chopped),
 predictions AS (SELECT book_id, page_number, (block_no * 100000 + k)::INT AS word_no, word, (80 + 30 * (k % 25))::INT AS x0, (140 + 48 * (block_no - 1))::INT AS y0,
    (105 + 30 * (k % 25))::INT AS x1, (156 + 48 * (block_no - 1))::INT AS y1,
    CASE WHEN (page_number + block_no) % 5 = 0 THEN 1 WHEN (page_number + block_no) % 7 = 0 THEN 4 ELSE 2 END AS label,
    ((50 + (page_number * 7 + block_no * 13 + k) % 50) / 100.0)::DOUBLE AS confidence FROM worded)
"""
