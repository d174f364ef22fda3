"""Hand-derived cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import formulas, predicates as P, tables, text as T

CASES = [
    (T.normalize_spaces, " a \t b\n c ", "a b\n c"),
    (T.normalize_for_repetition, "Page 12 — Of  TEXT!", "page # of text"),
    (T.normalize_line, "a , b ( c ) « d »", "a, b (c) «d»"),
    (T.html_escape, "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"),
    (T.repair_hyphenation, "компью-\nтер a-\nb inter- net", "компьютер a-\nb internet"),
    (T.filename_fragment, " My File: Name?! ", "my_file_name"),
    (T.filename_fragment, "???", "item"),
    (T.clean_metadata, "   ", None),
    (T.repair_encoding, " Ã© ﬁ­\x07x", "• é fix"),
    (T.normalize_unicode, "é ＡＢ ‒ ​x y", "é AB – x y"),
    (T.clean_page_numbers, "text\n12\n1987\n12345\nPage 3 end", "text\n\n1987\n12345\n end"),
    (T.clean_toc_leaders, "One ........ 12\ntwo.... three", "One\ntwo — three"),
    (T.clean_side_numbers, "a\n12\n1234", "a\n1234"),
    (T.clean_chart_artifacts, "a.\nword\n1 2 3 4\n", "word\n"),
    (T.repair_paragraphs, "one two\nthree-\nfour\nFive.\nsix\n\n\nseven", "one two threefour\nFive.\nsix\n\n\nseven"),
    (T.clean_garbage, "■ one\nz z two\npizza", "• one\n• two\npi•a"),
    (T.repair_hash_spacing, "3f2a 91b cafe cafe1 abc def 1234", "3f2a91b cafe cafe1 abc def 1234"),
    (T.repair_option_spacing, "ls -- all x - l", "ls --all x -l"),
    (T.repair_code_line, "git comm it a / b  ", "git comm it a/b"),
]


@pytest.mark.parametrize(("f", "given", "wanted"), CASES)
def test_text(spark, f, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t"))).first()[0] == wanted


def test_nulls(spark):
    row = spark.createDataFrame([(None,)], "t string").select(*[f(F.col("t")).alias(str(k)) for k, (f, *_) in enumerate(CASES)]).first()
    assert all(v is None for v in row)


def value(spark, c, **values):
    return spark.range(1).select(c(**{k: F.lit(v) for k, v in values.items()})).first()[0]


def test_boundaries(spark):
    h = 842.0
    inside = lambda y0, y1: value(spark, lambda a, b: P.in_margin(a, b, F.lit(h)), a=y0, b=y1)
    assert inside(0.0, 0.12 * h) and inside(h * (1 - 0.12), h) and not inside(200.0, 300.0)
    number = lambda t: value(spark, lambda t: P.is_page_number(t, F.lit(0.0), F.lit(20.0), F.lit(h)), t=t)
    assert number("— 12 —") and number("стр. 7") and number("1234") and not number("12345")
    head = lambda t, s: value(spark, lambda t, s: P.is_heading(t, s, F.lit(11.0)), t=t, s=s)
    assert head("a " * 18, 13.75) and not head("a " * 19, 13.75) and not head("x", 13.7) and not head("a b c d e f g h.", 20.0)
    assert P.page_ranges("4-9,12,20-,a") == [(4, 9), (12, 12), (20, 1_000_000_000)] and P.page_ranges("") == []
    with pytest.raises(ValueError):
        P.page_ranges("a-b")


def test_quality_strategy(spark):
    assert [value(spark, P.strategy, score=s) for s in (0.71, 0.7, 0.3)] == ["text", "hybrid", "facsimile"]


def test_tables(spark):
    def parsed(lines):
        return tables.parse(spark.createDataFrame([(lines,)], "ls array<string>"), "ls", "p").first()["p"]

    assert parsed(["a"]) is None
    pipe = parsed(["| a | b |", "|---|---|", "| 1 | 2 |"])
    assert pipe["rows"] == [["a", "b"], ["1", "2"]] and pipe["has_header"]
    assert parsed([f"{k}\tx" for k in range(8)])["how"] == "delimited" and parsed([f"{k}\tx" for k in range(7)]) is None
    assert parsed([f"{k} aaa {k}" for k in range(7)])["how"] == "fixed"


def test_formulas(spark):
    found = formulas.find("x $$a$$ and $b$ ∑∏∫")
    # the single-mark pattern also reads inside double marks, and then from their second closing mark on
    assert [f["latex"] for f in found] == ["a", "a", "and", "\\sum\\prod\\int"]
    out = spark.createDataFrame([("x $b$ y $c$",)], "t string").select(formulas.placeholders(F.col("t"), formulas.formulas(F.col("t")))).first()[0]
    assert out == "x <!-- FORMULA_1 --> y <!-- FORMULA_0 -->"


def test_plain_lines_are_cleaned_by_no_step_and_counted_without_lists(spark):
    """Lines in which no cleaning step finds anything skip the steps, and only those."""
    fixed = ["", " ", "ab", "a.", "a b", " two  words ", "It is (so), isn't it?", "- four", "( a", "z six", "x z z y", "zoo", "jazz", "puzzle z", "a...b", "page 12 of it", "42", "1987", "a " * 25 + "1987", "a " * 25 + "Page  7", "стр. 9 " + "a " * 25, "x = 5 & y", "a\nb", "a\n", "a\u00a0b", "один два", "été ß", "12 a b 3", "a 'b' c", "• one"]
    plain = {" two  words ", "a b", "It is (so), isn't it?", "zoo", "a " * 25 + "1987", "один два", "été ß"}
    df = spark.createDataFrame([(x,) for x in [*fixed, None]], "t string")
    c = F.col("t")
    steps = T.clean_toc_leaders(T.clean_page_numbers(T.clean_garbage(c)))
    steps = T.repair_paragraphs(T.clean_chart_artifacts(T.clean_side_numbers(steps)))
    steps = T.strip(T.sub(T.sub(steps, r"\n{3,}", "\n\n"), r"[ \t]+", " "))
    words = F.filter(F.split(c, r"(?U)\s+", -1), lambda w: F.length(w) > 0)
    for r in df.select(c, T.is_plain(c).alias("plain"), T.clean_full(c).alias("got"), steps.alias("want"), T.matches_of(c, r"(?U)\S+").alias("n"), F.when(c.isNotNull(), F.size(words)).alias("n_words"), T.average_word(c).alias("mean")).collect():
        assert r.got == r.want, repr(r.t)
        assert r.n == r.n_words, repr(r.t)
        assert bool(r.plain) == (r.t in plain), repr(r.t)
        w = (r.t or "").split()
        assert abs(r["mean"] - (sum(map(len, w)) / len(w) if w else 0)) < 1e-12
