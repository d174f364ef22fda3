"""Operators on small hand-made tables, and registered queries against SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagemill import config
from pagemill.operators import chapters as C, ml, spans as S
from pagemill.plans import epub, render

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "html_escape", "normalize_line", "repair_encoding", "normalize_unicode", "clean_page_numbers", "repair_paragraphs", "page_markers", "toc_entries", "table_parse",
    "median_font_size", "repeated_marginals", "exclude_regions_anti", "bold_normalize", "outline_plan", "plan_safety", "page_ranges", "ml_word_groups", "image_dedup",
    "cache_latest", "cache_keys", "preflight_report", "clean_garbage_symbols", "repair_code", "repair_hash_spacing", "formula_mathml", "formulas", "formula_placeholders", "toc_html", "toc_from_words",
    "kerning_merge", "text_repair_spans", "paragraph_merge", "ml_override", "doclaynet_labels", "progress_rates", "recommended_rules", "preflight_summary",
]
#: Results that hang on sums at a threshold, also at the next size.
LARGER = ["ml_word_groups", "toc_from_words", "preflight_summary"]


def plain(v):
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if pd.isna(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float, np.number)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", LARGER)
def test_sql_at_the_next_size(spark, sf_dir, name):
    test_sql(spark, sf_dir.replace("sf0.001", "sf0.01"), name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kerning(spark):
    def merged(*spans):
        df = spark.createDataFrame([([(t, f, s, 0, x0, y0, x1, y0 + 10.0) for t, f, s, x0, y0, x1 in spans],)], f"s array<{S.SPAN}>")
        return [r["text"] for r in df.select(S.merge_kerning(F.col("s")).alias("m")).first()["m"]]

    assert merged(("a", "F", 10.0, 0.0, 0.0, 5.0), ("b", "F", 10.0, 5.7, 0.0, 9.0)) == ["ab"]
    assert merged(("a", "F", 10.0, 0.0, 0.0, 5.0), ("b", "F", 10.0, 5.75, 0.0, 9.0)) == ["a", "b"]
    assert merged(("a", "F", 10.0, 0.0, 0.0, 5.0), ("b", "F", 10.5, 5.0, 0.0, 9.0)) == ["a", "b"]
    assert merged(("a", "F", 10.0, 0.0, 0.0, 5.0), ("b", "F", 10.0, 4.0, 0.0, 9.0)) == ["a", "b"]
    assert merged(("a", "F", 10.0, 0.0, 0.0, 5.0), ("b", "F", 10.0, 5.0, 2.0, 9.0)) == ["a", "b"]


def test_islands(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 7)], "book_id long, page_number long")
    assert C.page_ranges(df).first()["ranges"] == "1-3,7"


def test_fixed_plan(spark):
    n = spark.createDataFrame([(1, 45), (2, 0)], "book_id long, page_count long")
    assert [tuple(r) for r in C.fixed_plan(n, 20).orderBy("start_page_index").collect()] == [(1, "Pages 1-20", 0, 20), (1, "Pages 21-40", 20, 40), (1, "Pages 41-45", 40, 45)]
    with pytest.raises(ValueError):
        C.fixed_plan(n, 0)


def test_word_groups(spark):
    w = [(1, 1, k, f"w{k}", x, 0, x + 10, 10, label, 0.9) for k, (x, label) in enumerate([(0, 2), (20, 2), (100, 2), (110, 1)])]
    df = spark.createDataFrame(w, "book_id long, page_number long, word_no int, word string, x0 int, y0 int, x1 int, y1 int, label int, confidence double")
    assert sorted(r["text"] for r in ml.group_words(df).collect()) == ["w0 w1", "w2", "w3"]


def test_epub(spark):
    c = spark.createDataFrame([(1, 1, "One & all", "chapters/a.xhtml", "<p>x</p>"), (1, 2, "Two", "chapters/b.xhtml", "<p>y</p>")], "book_id long, chapter_index int, title string, file_name string, html string")
    made = epub.books(c)
    r = epub.validate(made).first()
    assert r["is_valid"] and r["errors"] == [] and "XHTML files: 3" in r["info"]
    broken = spark.createDataFrame([(2, b"no")], "book_id long, epub binary")
    assert not epub.validate(broken).first()["is_valid"]
    with pytest.raises(RuntimeError):
        epub.assemble("t", "en", None, "u", [("a", "t", ""), ("a", "t", "")], [])


def test_images(spark):
    i = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 19.0, 19.0, b"x", "jpg"), (1, 2, 0, 0.0, 0.0, 19.0, 20.0, b"y", "jpg"), (1, 3, 0, 0.0, 0.0, 50.0, 50.0, b"y", "png")], "book_id long, page_number long, block_no int, x0 double, y0 double, x1 double, y1 double, image binary, ext string")
    named = render.name_images(S.large_images(i)).orderBy("page_number").collect()
    assert len(named) == 2 and len({r["file_name"] for r in named}) == 1 and [r["is_first"] for r in named] == [True, False]


def test_config():
    assert config.get_profile(" Novel ").name == "novel" and config.get_profile("programming", "python").language == "python"
    with pytest.raises(ValueError, match="technical"):
        config.get_profile("none")
    with pytest.raises(ValueError):
        config.parse_rules({"crop": {"mode": "x"}})
    with pytest.raises(ValueError):
        config.parse_rules({"exclude_regions": [{"rect": [1]}]})
    with pytest.raises(FileNotFoundError):
        config.load_rules("/nowhere/rules.json")


def test_cache_key_takes_long_parts_whole(spark):
    from pyspark.sql import functions as F

    from pagemill.operators import cache

    keys = spark.range(2).select(cache.key({"text": F.concat(F.repeat(F.lit("x"), F.lit(1 << 20)), F.col("id").cast("string"))}).alias("k"))
    assert keys.distinct().count() == 2


def test_kinds_are_worked_out_once_behind_a_filter(spark, sf_dir):
    """A filter on the kind does not repeat the decision list, and no text is taken once a marker."""
    df = entry.queries()["render_html"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("git show") == 1
    assert plan.count("Join ") == 2  # sizes and marginals by book; blocks are not dealt out by text


def test_beginnings_and_blanks(spark):
    from pagemill.functions import predicates as P
    from pagemill.functions import text as T

    blanks = T.BLANKS
    texts = ["", " ", "index ", "index x", " index ", " index  y", "@@ ", "@@ 1", "--- a", "  +", "x index y", "$ ls", "# a", "[x", "\x85a b　", "apt-get i", "​index x", "стр", *blanks]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    prefixes = (*P.DIFF_STARTS, *(f"{c} " for c in P.COMMANDS))
    c = F.col("t")
    got = rows.select(c, T.strip(c), T.rstrip(c), P.begins(c, prefixes), P.begins(c, prefixes, whole=False)).collect()
    for t, s, r, whole, left in got:
        if t is None:
            assert s is None and r is None and whole is None
            continue
        assert (s, r) == (t.strip(blanks), t.rstrip(blanks)), repr(t)
        assert whole == t.strip(blanks).startswith(prefixes), repr(t)
        assert left == t.lstrip(blanks).startswith(prefixes), repr(t)
    points = spark.createDataFrame([(chr(k),) for k in range(0x10000) if not 0xD800 <= k < 0xE000], "t string")
    assert {r.t for r in points.where(c.rlike(f"[{T.WS}]")).collect()} == set(blanks)
