"""Registered queries of the document engine, with SQL that any engine can run for most of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import get_profile
from .functions import formulas, predicates as P, tables, text as T
from .operators import cache, chapters as C, documents as D, ml, preflight, progress, spans as S
from .plans import convert, epub, render
from .sources import samples
from .sources.samples import LAYOUT_SQL, OUTLINE_SQL, PREDICTIONS_SQL, SEEDED_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WS, WORD, LETTERS = T.WS, T.WORD, T.LETTERS


# SQL text -----------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pattern: str, to: str = "", how: str = "g") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, '{how}')"


def has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(pattern)})"


def count(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, {q(pattern)}))"


def strip(e: str) -> str:
    return rx(e, f"^[{WS}]+|[{WS}]+$")


def spaces(e: str) -> str:
    return strip(rx(f"translate({e}, chr(160), ' ')", r"[ \t\r\f\x0B]+", " "))


def line(e: str) -> str:
    e = rx(f"translate({e}, chr(160), ' ')", r"[ \t\r\f\x0B]+", " ")
    e = rx(rx(e, f"[{WS}]+([,.;:!?])", r"\1"), f"([(«])[{WS}]+", r"\1")
    return strip(rx(e, f"[{WS}]+([)»])", r"\1"))


def repetition(e: str) -> str:
    e = rx(f"lower({spaces(e)})", r"\p{Nd}+", "#")
    return strip(rx(rx(e, f"[^{WORD}# ]+"), f"[{WS}]+", " "))


def escaped(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        e = f"replace({e}, {q(a)}, {q(b)})"
    return e


def hits(e: str, markers) -> str:
    return "(" + " + ".join(f"contains({e}, {q(m)})::INT" for m in markers) + ")"


def starts(e: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({e}, {q(m)})" for m in prefixes) + ")"


def rows(e: str) -> str:
    return f"string_split({e}, chr(10))"


def kept(e: str, keep: str) -> str:
    return f"array_to_string(list_filter({rows(e)}, lambda x: {keep}), chr(10))"


def page_numbers(e: str) -> str:
    e = rx(e, rf"(?i)\bpage[{WS}]+\p{{Nd}}+\b")
    e = rx(e, rf"(?i)(^|[^{WORD}])стр\.?[{WS}]*\p{{Nd}}+\b", r"\1")
    return strip(rx(e, rf"(?m)^[{WS}]*(?:\p{{Nd}}{{1,3}}|[03-9]\p{{Nd}}{{3}}|1[0-8]\p{{Nd}}{{2}}|2[1-9]\p{{Nd}}{{2}})[{WS}]*$"))


def toc_leaders(e: str) -> str:
    e = rx(e, rf"(?m)[{WS}]*\.{{6,}}[{WS}]*\p{{Nd}}+[{WS}]*$")
    return rx(rx(e, rf"[{WS}]*\.{{4,}}[{WS}]*", " — "), rf"(\.{{3,}}[{WS}]*)+", " — ")


def side_numbers(e: str) -> str:
    return kept(e, f"NOT {has(strip('x'), '^[0-9]{1,3}$')}")


def charts(e: str) -> str:
    s = strip("x")
    odd = f"({has(f'lower({s})', '^[а-яa-z][.]?$')} OR ({count(s, '[0-9]')} > length({s}) * 0.45 AND length({s}) < 50))"
    return kept(e, f"length({s}) = 0 OR length({s}) > 70 OR contains({s}, '—') OR NOT {odd}")


def paragraphs(e: str, level: str) -> str:
    r = f"list_transform({rows(e)}, lambda z: {strip('z')})"
    low = lambda x: has(x, r"^\p{Ll}")
    join = "FALSE" if level == "Low" else f"(NOT {has('b', f'[.!?;:»' + chr(34) + f'][{WS}]*$')} AND ({low('x')} OR {has('x', '^[(«' + chr(34) + '—–]')}))"
    return f"""(SELECT {strip(rx("string_agg(CASE WHEN i = 1 THEN '' WHEN x <> '' AND b <> '' AND ends_with(b, '-') AND " + low('x') + " THEN '' WHEN x <> '' AND b <> '' AND " + join + " THEN ' ' ELSE chr(10) END || CASE WHEN x <> '' AND n <> '' AND ends_with(x, '-') AND " + low('n') + " THEN substr(x, 1, length(x) - 1) ELSE x END, '' ORDER BY i)", '[ \\t]{2,}', ' '))}
      FROM (SELECT i, l[i] AS x, coalesce(CASE WHEN i > 1 THEN l[i - 1] END, '') AS b, coalesce(l[i + 1], '') AS n FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {r} AS l))))"""


def density(e: str) -> str:
    return f"(CASE WHEN length({e}) = 0 THEN 0.0 ELSE {count(e, r'[/\\_=$#.:;|&><*{}()@+\[\]-]')}::DOUBLE / length({e}) END)"


COMMANDS = "|".join(c.replace("$", r"\$") for c in P.COMMANDS)


def command(e: str) -> str:
    return has(f"lower({strip(e)})", f"^(?:{COMMANDS}) |^[a-z0-9_.-]+@[a-z0-9_.-]+[:~/$#>]|^(sudo[{WS}]+)?[a-z0-9_.-]+[{WS}]+(-{{1,2}}[a-z0-9][a-z0-9-]*|/[a-z0-9_.-]+)|^git[{WS}]+[a-z0-9_.-]+")


def setting(e: str) -> str:
    return has(strip(e), f"^\\[[A-Za-z0-9_. -]+\\]$|^[A-Za-z0-9_.-]+[{WS}]*[=:][{WS}]*.+$|\\{{$|^\\}}$")


def commit(e: str) -> str:
    return f"({hits(f'lower({e})', P.COMMIT_MARKERS)} >= 2)"


def diff(ls: str) -> str:
    return f"(len(list_filter({ls}, lambda x: {starts(strip('x'), P.DIFF_STARTS)})) >= 3)"


def code(ls: str, mono: str) -> str:
    t, n = f"array_to_string({ls}, chr(10))", f"len({ls})"
    low = rx(f"lower({t})", f"^[{WS}]+", "", "")
    c, s = f"len(list_filter({ls}, lambda x: {command('x')}))", f"len(list_filter({ls}, lambda x: {setting('x')}))"
    return f"({n} > 0 AND ({commit(t)} OR {diff(ls)} OR {starts(low, P.CODE_STARTS)} OR {mono} >= 0.60 OR {c} >= 2 OR ({c} >= 1 AND {n} <= 3) OR ({s} >= 2 AND {density(t)} >= 0.08) OR {starts(low, [x + ' ' for x in P.COMMANDS])} OR ({n} >= 3 AND {density(t)} >= 0.16)))"


def is_table(ls: str) -> str:
    bars = f"len(list_filter({ls}, lambda x: contains(x, '|')))"
    gaps = f"len(list_filter({ls}, lambda x: {has('x', f'[^{WS}][{WS}]{{2,}}[^{WS}]')}))"
    cols = f"len(list_filter({ls}, lambda x: len(regexp_split_to_array({strip('x')}, {q(f'[{WS}]{{2,}}')})) >= 3))"
    return f"(len({ls}) >= 2 AND ({bars} >= 2 OR ({gaps} >= 3 AND {cols} >= 2)))"


def n_words(e: str) -> str:
    return count(e, f"[^{WS}]+")


V = f"WITH v AS ({SEEDED_SQL})"
#: Lines of seeded texts, cleaned, those that are not empty.
VL = f"{V}, l AS (SELECT doc_id, t, list_filter(list_transform({rows('t')}, lambda x: {line('x')}), lambda x: length(x) > 0) AS ls FROM v)"
L = f"WITH {LAYOUT_SQL}"
BLOCK_SQL = f""",
 blocks AS (SELECT *, {line('text')} AS tx FROM spans),
 sized AS (SELECT book_id, coalesce(quantile_cont(size, 0.5) FILTER (page_number <= 30 AND length({strip('text')}) > 0), 11.0) AS m FROM spans GROUP BY book_id),
 marg AS (SELECT book_id, norm AS normalized, count(*)::BIGINT AS repeats FROM (SELECT book_id, {repetition('text')} AS norm FROM spans WHERE page_number <= 80 AND (y1 <= height * 0.12 OR y0 >= height * 0.88)) WHERE length(norm) >= 3 GROUP BY ALL HAVING count(*) >= 3)
"""
PAGES_SQL = """,
 pages_ AS (SELECT book_id, page_number, string_agg(text, chr(10) ORDER BY block_no) AS text FROM spans GROUP BY ALL)
"""


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def scalar(name: str, column, sql: str | None = None) -> None:
    """A query that applies one text function to every seeded text."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples.seeded(spark, sf_dir).select("doc_id", column(F.col("t")).alias("out"))

    query(name, f"{V} SELECT doc_id, {sql} AS out FROM v" if sql else None)(f)


def both(name: str, columns: dict, sqls: dict[str, str] | None, source=samples.seeded) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select("doc_id", *[c(F.col("t")).alias(k) for k, c in columns.items()])

    query(name, f"{V} SELECT doc_id, {', '.join(f'{s} AS {k}' for k, s in sqls.items())} FROM v" if sqls else None)(f)


# Text ---------------------------------------------------------------------------------------

scalar("html_escape", T.html_escape, escaped("t"))
scalar("normalize_spaces", T.normalize_spaces, spaces("t"))
scalar("normalize_line", T.normalize_line, line("t"))
scalar("normalize_repetition", T.normalize_for_repetition, repetition("t"))
scalar("repair_hyphenation", T.repair_hyphenation, rx(rx(rx("t", rf"([{LETTERS}]{{2,}})-[{WS}]*\n[{WS}]*([a-zа-яё])", r"\1\2"), rf"-[{WS}]*\n[{WS}]*-"), rf"([{LETTERS}]{{2,}})-[{WS}]+([a-zа-яё])", r"\1\2"))
scalar("filename_fragment", T.filename_fragment, f"(SELECT substr(CASE WHEN length(s) > 0 THEN s WHEN s IS NOT NULL THEN 'item' END, 1, 64) FROM (SELECT {rx(rx('lower(' + strip('t') + ')', f'[^{WORD}.-]+', '_'), '^[._-]+|[._-]+$')} AS s))")
scalar("metadata_clean", lambda c: T.clean_metadata(F.when(F.length(c) % 7 == 0, F.lit("   ")).otherwise(c)), f"nullif({spaces('CASE WHEN length(t) % 7 = 0 THEN chr(32) || chr(160) || chr(32) ELSE t END')}, '')")


def encoding_sql(e: str) -> str:
    e = f"translate({e}, {q(''.join(T.PRIVATE_USE))}, {q(''.join(T.PRIVATE_USE.values()))})"
    for a, b in (*T.WRONG_DECODING, *T.LIGATURES):
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"translate({rx(e, r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{AD}]')}, chr(160), ' ')"


def unicode_sql(e: str) -> str:
    full, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    e = f"translate(nfc_normalize({e}), {q(full)}, {q(plain)})"
    e = f"translate({e}, {q(''.join(T.DASHES) + T.SPACES)}, {q(''.join(T.DASHES.values()) + ' ' * len(T.SPACES))})"
    return f"translate({e}, {q(T.ZERO_WIDTH)}, '')"


scalar("repair_encoding", T.repair_encoding, encoding_sql("t"))
scalar("normalize_unicode", T.normalize_unicode, unicode_sql("t"))
scalar("full_repair", T.full_repair, unicode_sql(encoding_sql("t")))
scalar("clean_page_numbers", T.clean_page_numbers, page_numbers("t"))
scalar("clean_toc_leaders", T.clean_toc_leaders, toc_leaders("t"))
scalar("clean_side_numbers", T.clean_side_numbers, side_numbers("t"))
scalar("clean_chart_artifacts", T.clean_chart_artifacts, charts("t"))
scalar("repair_paragraphs", T.repair_paragraphs, paragraphs("t", "Medium"))
scalar("repair_paragraphs_low", lambda c: T.repair_paragraphs(c, "Low"), paragraphs("t", "Low"))
scalar("join_lines", lambda c: T.join_lines(T.lines_of(c)), f"list_reduce({rows('t')}, lambda a, x: CASE WHEN length(x) = 0 THEN a || ' ' WHEN ends_with({rx('a', f'[{WS}]+$')}, '-') AND {has('x', r'^\p{Ll}')} THEN substr({rx('a', f'[{WS}]+$')}, 1, length({rx('a', f'[{WS}]+$')}) - 1) || x ELSE a || ' ' || x END)")
scalar("clean_garbage_symbols", T.clean_garbage)
scalar("clean_full", T.clean_full)
scalar("repair_code", T.repair_code)
scalar("repair_hash_spacing", T.repair_hash_spacing)
scalar("formula_mathml", formulas.mathml)

TOTAL = f"length({strip('t')})"
both(
    "text_quality",
    {"score": lambda c: F.round(T.text_quality(c), 6)},
    {"score": f"CASE WHEN {TOTAL} < 5 THEN 0.0::DOUBLE ELSE round(greatest(0.0, least(1.0, {count(strip('t'), '[' + T.GOOD + ']')}::DOUBLE / {TOTAL} * 0.5 + least(1.0, ({count('t', f'[^{WS}]')}::DOUBLE / {n_words('t')}) / 4.0) * 0.3 - {count(strip('t'), r'[\p{Co}\p{Cf}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')}::DOUBLE / {TOTAL} * 0.5)), 6)::DOUBLE END"},
)
both(
    "code_detectors",
    {"is_commit": P.is_commit, "is_diff": P.is_diff, "density": lambda c: F.round(P.density(c), 6), "commands": lambda c: F.size(F.filter(T.lines_of(c), P.is_command)), "settings": lambda c: F.size(F.filter(T.lines_of(c), P.is_config))},
    {"is_commit": commit("t"), "is_diff": diff(rows("t")), "density": f"round({density('t')}, 6)", "commands": f"len(list_filter({rows('t')}, lambda x: {command('x')}))::INT", "settings": f"len(list_filter({rows('t')}, lambda x: {setting('x')}))::INT"},
)
LOW = f"lower({spaces('t')})"
both(
    "page_markers",
    {"toc": lambda c: P.has_toc_markers(F.lower(T.normalize_spaces(c))), "code": lambda c: P.has_code_markers(F.lower(T.normalize_spaces(c))), "toc_text": P.is_toc_text, "leaders": lambda c: c.rlike(r"\.{5,}")},
    {
        "toc": f"({hits(LOW, P.TOC_TITLES)} > 0 OR {hits(LOW, [*P.TOC_TITLES, *P.TOC_CHAPTERS])} >= 4 OR {has(LOW, r'\.{5,}')})",
        "code": f"({hits(LOW, P.CODE_MARKERS)} >= 2 OR {has(LOW, f'(^|[^{WORD}])git[{WS}]+[a-z0-9_.-]+')} OR {has(LOW, f'(^|[^{WORD}])commit[{WS}]+[0-9a-f]{{7,40}}([^{WORD}]|$)')})",
        "toc_text": f"({hits('lower(t)', P.TOC_TITLES)} > 0 OR {count('t', r'\.{5,}')} >= 5 OR {' + '.join(count('lower(t)', m.strip()) for m in P.TOC_CHAPTERS)} >= 8)",
        "leaders": has("t", r"\.{5,}"),
    },
)


def as_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seeded text as a book of one page."""
    return samples.seeded(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.lit(1).cast("long").alias("page_number"), F.col("t").alias("text"))


def entry_sql(e: str) -> tuple[str, str, str, str]:
    """title, page, level, whether it is an entry; of a line."""
    c = spaces(e)
    page = f"TRY_CAST(nullif(regexp_extract({c}, {q(f'([0-9]{{1,4}})[{WS}]*$')}, 1), '') AS INT)"
    title = spaces(rx(rx(c, f"[0-9]{{1,4}}[{WS}]*$", "", ""), r"\.{5,}", " "))
    level = f"CASE WHEN {starts('lower(title)', ('глава ', 'chapter '))} THEN 1 WHEN {starts('lower(title)', ('раздел ', 'section '))} THEN 2 WHEN {has('title', '^[0-9]+[.][0-9]+[.][0-9]+')} THEN 3 WHEN {has('title', '^[0-9]+[.][0-9]+')} THEN 2 ELSE 1 END"
    ok = f"length(title) > 0 AND ({starts('lower(title)', P.TOC_CHAPTERS)} OR {has('title', f'^[0-9]+([.][0-9]+)*[{WS}]+')})"
    return title, page, level, ok


_title, _page, _level, _ok = entry_sql("line")


@query("toc_entries", f"""{V}, l AS (SELECT doc_id, unnest({rows('t')}) AS line, unnest(range(len({rows('t')}))) AS pos FROM v),
 e AS (SELECT doc_id AS book_id, pos::INT AS pos, {_title} AS title, {_page} AS page FROM l WHERE lower({spaces('line')}) NOT IN ('содержание', 'оглавление', 'contents'))
 SELECT book_id, 1::BIGINT AS page_number, pos, title, page, {_level} AS level FROM e WHERE {_ok}""")
def toc_entries(spark, sf_dir):
    return C.toc_entries(as_book(spark, sf_dir))


@query("toc_html", None)
def toc_html(spark, sf_dir):
    return render.toc_html(C.toc_entries(as_book(spark, sf_dir)))


@query("toc_from_words", None)
def toc_from_words(spark, sf_dir):
    b = as_book(spark, sf_dir).select("book_id", "page_number", F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line"))
    w = b.select("book_id", "page_number", F.lit(0).alias("block_no"), "line_no", F.posexplode(T.words(F.col("line"))).alias("word_no", "text"))
    return C.toc_from_words(w.withColumn("x0", F.col("word_no") * 10.0))


@query("table_parse", f"""{V}, l AS (SELECT doc_id, list_filter({rows('t')}, lambda x: length({strip('x')}) > 0 AND contains(x, '|')) AS ls FROM v),
 r AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: list_transform(string_split(regexp_replace(regexp_replace({strip('x')}, '^[|]', ''), '[|]$', ''), '|'), lambda c: {strip('c')})), lambda r: len(list_filter(r, lambda c: {has('c', f'^-[{WS}:-]*$')})) = 0) AS rs FROM l)
 SELECT doc_id, len(rs)::INT AS n_rows, list_sum(list_transform(rs, lambda r: len(r)))::BIGINT AS n_cells, array_to_string(rs[1], '/') AS head FROM r WHERE len(rs) > 0""")
def table_parse(spark, sf_dir):
    t = samples.seeded(spark, sf_dir).select("doc_id", tables.barred(tables.lines_of_block(F.col("t"))).alias("b")).where("b IS NOT NULL")
    return t.select("doc_id", F.size("b.rows").alias("n_rows"), F.aggregate("b.rows", F.lit(0).cast("long"), lambda a, r: a + F.size(r)).alias("n_cells"), F.array_join(F.get("b.rows", F.lit(0)), "/").alias("head"))


@query("table_parse_all", None)
def table_parse_all(spark, sf_dir):
    t = tables.parse(samples.seeded(spark, sf_dir).select("doc_id", tables.lines_of_block(F.col("t")).alias("ls")), "ls", "p")
    return t.select("doc_id", "p.how", F.size("p.rows").alias("n_rows"), "p.has_header", "p.confidence", tables.table_html(F.col("p")).alias("html"))


@query("formulas", None)
def find_formulas(spark, sf_dir):
    t = samples.seeded(spark, sf_dir).where(formulas.may_have(F.col("t")))
    f = t.select("doc_id", F.explode(formulas.formulas(F.col("t"))).alias("f"))
    return f.select("doc_id", "f.latex", F.col("f.begin").alias("begin_pos"), F.col("f.end").alias("end_pos"), "f.confidence", "f.type", formulas.formula_html(F.col("f.latex"), F.col("f.type")).alias("html"))


@query("formula_placeholders", None)
def formula_placeholders(spark, sf_dir):
    t = samples.seeded(spark, sf_dir).withColumn("f", F.coalesce(formulas.formulas(F.when(formulas.may_have(F.col("t")), F.col("t"))), F.array().cast(formulas.SCHEMA)))
    return t.select("doc_id", F.size("f").alias("n"), formulas.placeholders(F.col("t"), F.col("f")).alias("out"))


@query("code_blocks", f"{VL} SELECT doc_id, {code('ls', '0.0')} AS is_code, {is_table('ls')} AS is_table FROM l")
def code_blocks(spark, sf_dir):
    ls = F.filter(F.transform(T.lines_of(F.col("t")), T.normalize_line), lambda x: F.length(x) > 0)
    t = samples.seeded(spark, sf_dir).select("doc_id", ls.alias("ls"))
    return t.select("doc_id", P.is_code(F.col("ls"), F.lit(0.0)).alias("is_code"), P.is_table(F.col("ls")).alias("is_table"))


# Layout -------------------------------------------------------------------------------------


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(samples.layout(spark, sf_dir))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_texts(blocks_of(spark, sf_dir)).select("book_id", "page_number", "text")


GOODS, TRIM = f"[{T.GOOD}]", strip("text")


@query("document_stats", f"""{L}{PAGES_SQL}, c AS (SELECT book_id, max(page_number) AS n FROM pages_ GROUP BY 1),
 w AS (SELECT DISTINCT book_id, n, CASE WHEN n <= 20 THEN i ELSE i * n // 20 END + 1 AS page_number FROM (SELECT book_id, n, unnest(range(least(n, 20))) AS i FROM c)),
 s AS (SELECT book_id, any_value(n) AS page_count, count(*)::BIGINT AS sampled_pages, sum(length({TRIM}))::BIGINT AS chars, sum({count(TRIM, GOODS)}) AS good FROM pages_ JOIN w USING (book_id, page_number) GROUP BY 1)
 SELECT book_id, page_count, sampled_pages, chars, round(chars::DOUBLE / sampled_pages, 6) AS average, chars::DOUBLE / sampled_pages < 25 AS looks_scanned, round(coalesce(good::DOUBLE / nullif(chars, 0), 0.0), 6) AS text_quality FROM s""")
def document_stats(spark, sf_dir):
    return D.inspect(pages_of(spark, sf_dir)).withColumns({"average": F.round("average", 6), "text_quality": F.round("text_quality", 6)})


@query("median_font_size", f"{L}{BLOCK_SQL} SELECT book_id, m AS median_size FROM sized")
def median_font_size(spark, sf_dir):
    return D.median_size(samples.layout(spark, sf_dir))


@query("repeated_marginals", f"{L}{BLOCK_SQL} SELECT book_id, normalized, repeats FROM marg")
def repeated_marginals(spark, sf_dir):
    return D.repeated_marginals(blocks_of(spark, sf_dir))


CANDIDATES_SQL = f"""m AS (SELECT book_id, page_number, block_no, {spaces('text')} AS text, CASE WHEN y1 <= height * 0.12 THEN 'top' ELSE 'bottom' END AS area FROM spans WHERE page_number <= 80 AND (y1 <= height * 0.12 OR y0 >= height * 0.88) AND length({spaces('text')}) > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_number, area ORDER BY block_no) AS pos, {repetition('text')} AS normalized FROM m),
 u AS (SELECT *, page_number * 1000 + CASE WHEN area = 'top' THEN 0 ELSE 100 END + pos AS seen FROM k WHERE pos <= 8 AND (length(normalized) >= 3 OR length(normalized) >= 2 AND {has('normalized', '^[0-9]+$')})),
 g AS (SELECT book_id, area, normalized, count(*)::BIGINT AS repeats, min(seen) AS seen, arg_min(text, seen) AS text FROM u GROUP BY ALL),
 h AS (SELECT *, first_value(text) OVER (PARTITION BY book_id, normalized ORDER BY seen) AS t2 FROM g),
 cand AS (SELECT * FROM (SELECT book_id, area, t2 AS text, normalized, repeats, row_number() OVER (PARTITION BY book_id ORDER BY area DESC, repeats DESC, seen)::INT AS rank FROM h WHERE repeats >= 3) WHERE rank <= 30)"""


@query("header_footer_candidates", f"{L}, {CANDIDATES_SQL} SELECT * FROM cand")
def header_footer_candidates(spark, sf_dir):
    return D.header_footer_candidates(blocks_of(spark, sf_dir))


CROP = {"mode": "ratio", "top_ratio": 0.07, "bottom_ratio": 0.065}


@query("crop_filter", f"{L} SELECT book_id, count(*)::BIGINT AS n, min(y0) AS low, max(y1) AS high FROM spans WHERE x1 > 0 AND x0 < width AND y1 > height * 0.07 AND y0 < height - height * 0.065 GROUP BY 1")
def crop_filter(spark, sf_dir):
    return S.clipped(samples.layout(spark, sf_dir), CROP).groupBy("book_id").agg(F.count("*").alias("n"), F.min("y0").alias("low"), F.max("y1").alias("high"))


@query("margin_heights", f"{L} SELECT book_id, count(*)::BIGINT AS n FROM spans WHERE y1 > 50 AND y0 < height - 45 GROUP BY 1")
def margin_heights(spark, sf_dir):
    return S.without_margins(samples.layout(spark, sf_dir)).groupBy("book_id").agg(F.count("*").alias("n"))


@query("exclude_regions_anti", f"{L}, r AS (SELECT * FROM (VALUES (2, 9, 0.0, 100.0, 200.0, 140.0), (5, 1000000000, 0.0, 800.0, 595.0, 842.0)) AS t(lo, hi, a0, b0, a1, b1)) SELECT book_id, count(*)::BIGINT AS n FROM spans s WHERE NOT EXISTS (SELECT 1 FROM r WHERE s.page_number BETWEEN lo AND hi AND s.x1 > a0 AND s.x0 < a1 AND s.y1 > b0 AND s.y0 < b1) GROUP BY 1")
def exclude_regions_anti(spark, sf_dir):
    regions = [(lo, hi, 0.0, b0, a1, b1) for text, b0, a1, b1 in (("2-9", 100.0, 200.0, 140.0), ("5-", 800.0, 595.0, 842.0)) for lo, hi in P.page_ranges(text)]
    r = spark.createDataFrame(regions, "page_lo long, page_hi long, x0 double, y0 double, x1 double, y1 double")
    return S.anti_regions(samples.layout(spark, sf_dir), r).groupBy("book_id").agg(F.count("*").alias("n"))


@query("bold_normalize", f"""{L}, p AS (SELECT book_id, page_number, sum(length(trim(text)))::BIGINT AS chars, sum(CASE WHEN flags & 16 <> 0 OR {has("lower(replace(replace(font, '-', ''), '_', ''))", 'bold|heavy|black|demibold|semibold')} THEN length(trim(text)) ELSE 0 END)::BIGINT AS bold FROM spans GROUP BY ALL)
 SELECT book_id, page_number, chars, bold, chars >= 50 AND bold > chars * 0.40 AS fake_bold, (SELECT sum(CASE WHEN chars >= 50 AND bold > chars * 0.40 THEN flags - (flags & 16) ELSE flags END)::BIGINT FROM spans s WHERE s.book_id = p.book_id AND s.page_number = p.page_number) AS flag_sum FROM p""")
def bold_normalize(spark, sf_dir):
    s = samples.layout(spark, sf_dir)
    flags = S.normalize_bold(s).groupBy("book_id", "page_number").agg(F.sum("flags").alias("flag_sum"))
    return S.bold_pages(s).join(flags, ["book_id", "page_number"])


@query("kerning_merge", None)
def kerning_merge(spark, sf_dir):
    """Every line cut into spans of 10 characters that touch, but for every third cut."""
    s = samples.layout(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 10).cast("int")), lambda i: F.struct(i.alias("span_no"), F.substring(F.col("text"), i * 10 + 1, F.lit(10)).alias("t"), (50.0 + i * 60 + F.floor(i / 3) * 20).alias("a")))
    parts = s.withColumn("line_no", F.lit(0)).withColumn("p", F.explode(cut)).withColumns({"text": F.col("p.t"), "span_no": F.col("p.span_no"), "x0": F.col("p.a"), "x1": F.col("p.a") + 60.0}).drop("p")
    return S.lines(parts).select("book_id", "page_number", "block_no", F.size("spans").alias("n_spans"), "text")


@query("text_repair_spans", None)
def text_repair_spans(spark, sf_dir):
    return S.repaired(samples.layout(spark, sf_dir)).groupBy("book_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def profiled(spark, sf_dir, name="technical") -> DataFrame:
    s = samples.layout(spark, sf_dir)
    b = S.blocks(s)
    return D.classify(b, D.repeated_marginals(b), D.median_size(s), get_profile(name))


WORDS = n_words("tx")
BARE = strip(rx(strip(rx(strip("tx"), f"^[{WS}\\-–—.•◦]*|[{WS}\\-–—.•◦]*$")), f"(?i)^(стр\\.?|page|p\\.?|с\\.?)[{WS}]*", "", ""))
HEADING = f"(length(tx) <= 180 AND {WORDS} <= 18 AND size >= greatest(m * 1.25, m + 1.5) AND NOT (ends_with(tx, '.') AND {WORDS} > 7))"
MONO_SQL = "(CASE WHEN font = 'Courier Mono' THEN 1.0 ELSE 0.0 END)"
KIND_SQL = f"""CASE WHEN length(tx) = 0 THEN 'unknown' WHEN known AND (y1 <= height * 0.12 OR y0 >= height * 0.88) AND y0 < height * 0.5 THEN 'header' WHEN known AND (y1 <= height * 0.12 OR y0 >= height * 0.88) THEN 'footer'
   WHEN {has(BARE, '^[0-9]{1,4}$')} AND (y1 <= height * 0.10 OR y0 >= height * 0.90) THEN 'footer' WHEN {starts(strip('lower(tx)'), P.CAPTIONS)} THEN 'caption'
   WHEN {code('[tx]', MONO_SQL)} THEN 'code' WHEN {HEADING} THEN 'heading' ELSE 'paragraph' END"""
#: In the profile for novels nothing is code.
NOVEL_KIND_SQL = f"""{KIND_SQL.split("   WHEN " + code("[tx]", MONO_SQL))[0]}   WHEN {HEADING} THEN 'heading' ELSE 'paragraph' END"""
LEVEL_SQL = f"CASE WHEN {has(strip('tx'), f'(?i)^(chapter|part|глава|часть)[{WS}]+[0-9]+')} THEN 1 WHEN {has(strip('tx'), f'^[0-9]+[.][0-9]+([.][0-9]+)?[{WS}]+')} THEN 2 WHEN size >= m * 1.8 THEN 1 WHEN size >= m * 1.45 THEN 2 ELSE 3 END"
CLASSIFIED = f"{L}{BLOCK_SQL}, j AS (SELECT b.*, s.m, g.normalized IS NOT NULL AS known FROM blocks b JOIN sized s USING (book_id) LEFT JOIN marg g ON b.book_id = g.book_id AND {repetition('b.tx')} = g.normalized), k AS (SELECT *, {KIND_SQL} AS kind FROM j)"
NOVEL = CLASSIFIED.replace(KIND_SQL, NOVEL_KIND_SQL)


@query("classify_blocks", f"{CLASSIFIED} SELECT book_id, page_number, block_no, kind, CASE WHEN kind = 'heading' THEN {LEVEL_SQL} ELSE 0 END AS level FROM k")
def classify_blocks(spark, sf_dir):
    return profiled(spark, sf_dir).select("book_id", "page_number", "block_no", "kind", "level")


@query("block_kinds", f"{CLASSIFIED} SELECT kind, count(*)::BIGINT AS n FROM k GROUP BY 1")
def block_kinds(spark, sf_dir):
    return profiled(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("paragraph_merge", None)
def paragraph_merge(spark, sf_dir):
    return render.merged_blocks(profiled(spark, sf_dir, "novel")).select("book_id", "page_number", "pos", "kind", F.size("members").alias("n_members"))


QN = n_words("text")
QUALITY_SQL = f"""{L}{PAGES_SQL}, a AS (SELECT book_id, page_number, text, length({TRIM}) AS total, {count('text', '[' + T.GOOD + D.PUNCT + ']')} AS good, {count('text', r'[\p{Co}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')} AS bad, {QN} AS n,
   CASE WHEN {QN} = 0 THEN 0.0 ELSE {count('text', f'[^{WS}]')}::DOUBLE / {QN} END AS avgw, len(list_filter(regexp_extract_all(text, {q(f'[^{WS}]+')}), lambda w: length(w) >= 3 AND {has('w', r'\p{L}')})) AS real_, {count('text', r'\p{Lu}')} AS up, {count('text', r'\p{L}')} AS al,
   len(list_filter(regexp_extract_all(text, '[^\\n]'), lambda c: FALSE)) AS zero FROM pages_),
 runs AS (SELECT book_id, page_number, sum(len_ // 1)::BIGINT AS runs FROM (SELECT book_id, page_number, CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS len_ FROM (SELECT book_id, page_number, i, c, i - row_number() OVER (PARTITION BY book_id, page_number, c ORDER BY i) AS g FROM (SELECT book_id, page_number, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM pages_)) WHERE c <> chr(10) GROUP BY book_id, page_number, c, g) GROUP BY ALL),
 b AS (SELECT a.*, coalesce(r.runs, 0) AS runs FROM a LEFT JOIN runs r USING (book_id, page_number)),
 s AS (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, good / greatest(total, 1)::DOUBLE * CASE WHEN al > 20 AND up > al * 0.6 THEN 0.7 ELSE 1.0 END * CASE WHEN runs > 3 THEN 0.8 ELSE 1.0 END * 0.35 + least(avgw / 4.5, 1.0) * CASE WHEN avgw < 2.0 AND n > 10 THEN 0.5 ELSE 1.0 END * 0.20 + real_ / greatest(n, 1)::DOUBLE * 0.25 - least(bad / greatest(total, 1)::DOUBLE * 3.0, 1.0) * 0.20)) END AS score FROM b)"""
STRATEGY = "CASE WHEN total = 0 THEN 'facsimile' WHEN score > 0.7 THEN 'text' WHEN score > 0.3 THEN 'hybrid' ELSE 'facsimile' END"


@query("page_quality", f"{QUALITY_SQL} SELECT book_id, page_number, round(score, 6) AS score, total::INT AS total_chars, good::INT AS good_chars, bad::INT AS garbage_chars, round(avgw, 6) AS avg_word_length, n::INT AS word_count, {STRATEGY} AS strategy FROM s")
def page_quality(spark, sf_dir):
    return D.page_quality(pages_of(spark, sf_dir)).drop("reasons").withColumns({"score": F.round("score", 6), "avg_word_length": F.round("avg_word_length", 6)})


@query("quality_summary", f"{QUALITY_SQL}, z AS (SELECT *, {STRATEGY} AS st FROM s) SELECT book_id, count(*)::BIGINT AS total_scored, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, count(*) FILTER (st = 'text')::BIGINT AS text_pages, count(*) FILTER (st = 'hybrid')::BIGINT AS hybrid_pages, count(*) FILTER (st = 'facsimile')::BIGINT AS facsimile_pages FROM z GROUP BY 1")
def quality_summary(spark, sf_dir):
    return D.quality_summary(D.page_quality(pages_of(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("avg_score", "min_score", "max_score")})


# Chapters -----------------------------------------------------------------------------------


def counts_of(spark, sf_dir) -> DataFrame:
    return samples.layout(spark, sf_dir).groupBy("book_id").agg(F.max("page_number").alias("page_count"))


PLAN_SQL = f"""{L}, {OUTLINE_SQL}, counts AS (SELECT book_id, max(page_number) AS page_count FROM spans GROUP BY 1),
 o1 AS (SELECT o.book_id, level, {strip(rx('title', f'[{WS}]+', ' '))} AS title, least(page_number - 1, page_count - 1) AS s, page_count, count(*) FILTER (level = 1) OVER (PARTITION BY o.book_id) AS ones FROM outline o JOIN counts USING (book_id) WHERE page_number > 0),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, s ORDER BY level, title) AS turn FROM o1 WHERE CASE WHEN ones >= 2 THEN level = 1 ELSE level <= 2 END),
 o3 AS (SELECT book_id, title, s, page_count FROM o2 WHERE turn = 1 UNION ALL SELECT book_id, 'Start', 0, any_value(page_count) FROM o2 WHERE turn = 1 GROUP BY 1 HAVING min(s) > 0),
 plan AS (SELECT * FROM (SELECT book_id, title, s AS start_page_index, coalesce(lead(s) OVER (PARTITION BY book_id ORDER BY s), page_count) AS end_page_index FROM o3) WHERE start_page_index < end_page_index),
 t AS (SELECT book_id, title, count(*) AS n, sum(end_page_index - start_page_index) AS pages FROM plan GROUP BY ALL),
 safety AS (SELECT c.book_id, coalesce(sum(pages) / any_value(page_count)::DOUBLE, 0.0) AS coverage, coalesce(max(n) / sum(n)::DOUBLE, 0.0) AS modal_share,
   coalesce(sum(pages) / any_value(page_count)::DOUBLE >= 0.80 AND NOT (sum(n) >= 3 AND max(n) / sum(n)::DOUBLE > 0.50), FALSE) AS safe FROM counts c LEFT JOIN t USING (book_id) GROUP BY 1),
 fixed AS (SELECT book_id, 'Pages ' || (s + 1) || '-' || least(s + 20, page_count) AS title, s AS start_page_index, least(s + 20, page_count) AS end_page_index FROM (SELECT book_id, page_count, unnest(range(0, page_count, 20)) AS s FROM counts)),
 chosen AS (SELECT * FROM plan WHERE book_id IN (SELECT book_id FROM safety WHERE safe) UNION ALL SELECT * FROM fixed WHERE book_id NOT IN (SELECT book_id FROM safety WHERE safe)),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY start_page_index)::INT AS chapter_index FROM chosen)"""


@query("outline_plan", f"{PLAN_SQL} SELECT book_id, title, start_page_index, end_page_index FROM plan")
def outline_plan(spark, sf_dir):
    return C.outline_plan(samples.outline(spark, sf_dir), counts_of(spark, sf_dir))


@query("plan_safety", f"{PLAN_SQL} SELECT book_id, round(coverage, 6) AS coverage, round(modal_share, 6) AS modal_share, safe FROM safety")
def plan_safety(spark, sf_dir):
    n = counts_of(spark, sf_dir)
    return C.plan_safety(C.outline_plan(samples.outline(spark, sf_dir), n), n).withColumns({c: F.round(c, 6) for c in ("coverage", "modal_share")})


@query("fixed_plan", f"{PLAN_SQL} SELECT * FROM fixed")
def fixed_plan(spark, sf_dir):
    return C.fixed_plan(counts_of(spark, sf_dir), 20)


@query("chapter_plan", f"{PLAN_SQL} SELECT book_id, title, start_page_index, end_page_index, chapter_index FROM numbered")
def chapter_plan(spark, sf_dir):
    return C.chapter_plan(samples.outline(spark, sf_dir), counts_of(spark, sf_dir))


@query("page_chapter_join", f"{PLAN_SQL} SELECT p.book_id, p.page_number, c.chapter_index, c.title FROM (SELECT DISTINCT book_id, page_number FROM spans) p JOIN numbered c ON p.book_id = c.book_id AND p.page_number - 1 >= c.start_page_index AND p.page_number - 1 < c.end_page_index")
def page_chapter_join(spark, sf_dir):
    plan = C.chapter_plan(samples.outline(spark, sf_dir), counts_of(spark, sf_dir))
    pages = samples.layout(spark, sf_dir).select("book_id", "page_number").distinct()
    return pages.join(C.pages_of(plan), ["book_id", "page_number"]).select("book_id", "page_number", "chapter_index", "title")


@query("page_ranges", f"{L}, p AS (SELECT DISTINCT book_id, page_number FROM spans WHERE font = 'Courier Mono'), i AS (SELECT *, page_number - row_number() OVER (PARTITION BY book_id ORDER BY page_number) AS g FROM p), r AS (SELECT book_id, min(page_number) AS lo, max(page_number) AS hi FROM i GROUP BY book_id, g) SELECT book_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM r GROUP BY 1")
def page_ranges(spark, sf_dir):
    return C.page_ranges(samples.layout(spark, sf_dir).where("font = 'Courier Mono'").select("book_id", "page_number"))


# Models, images, cache ----------------------------------------------------------------------

NAMES = "[" + ", ".join(q(x) for x in ml.LABELS) + "]"
GROUPS_SQL = f"""{PREDICTIONS_SQL},
 f AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR label <> lag(label) OVER w OR NOT (abs(x0 - lag(x1) OVER w) < 50 AND y0 <= lag(y1) OVER w AND y1 >= lag(y0) OVER w) THEN 1 ELSE 0 END AS new FROM predictions WINDOW w AS (PARTITION BY book_id, page_number ORDER BY word_no)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY book_id, page_number ORDER BY word_no ROWS UNBOUNDED PRECEDING)::BIGINT AS ml_no FROM f),
 grp AS (SELECT book_id, page_number, ml_no, label, string_agg(word, ' ' ORDER BY word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(confidence::DECIMAL(20, 6))::DOUBLE / count(*) AS confidence, count(*)::BIGINT AS n_words FROM i GROUP BY ALL HAVING sum(confidence::DECIMAL(20, 6)) >= 0.7::DECIMAL(2, 1) * count(*))"""


@query("ml_word_groups", f"{L}, {GROUPS_SQL} SELECT book_id, page_number, ml_no, {NAMES}[label + 1] AS label, text, x0, y0, x1, y1, round(confidence, 6) AS confidence, n_words FROM grp")
def ml_word_groups(spark, sf_dir):
    return ml.group_words(samples.predictions(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("doclaynet_labels", f"{L} SELECT DISTINCT book_id, page_number, block_no, CASE block_no % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'list' WHEN 2 THEN 'header' ELSE 'unlisted' END AS label FROM spans")
def doclaynet_labels(spark, sf_dir):
    given = F.get(F.array(*map(F.lit, ("footnote", "list-item", "page-header", "unlisted"))), F.pmod("block_no", F.lit(4)).cast("int"))
    return ml.standard_labels(samples.layout(spark, sf_dir).select("book_id", "page_number", "block_no", given.alias("label"))).distinct()


@query("ml_override", None)
def ml_override(spark, sf_dir):
    return ml.override(profiled(spark, sf_dir), ml.group_words(samples.predictions(spark, sf_dir))).select("book_id", "page_number", "block_no", "kind", "overridden")


def images_of(spark, sf_dir) -> DataFrame:
    """Every document's text as an image of a book; copies have equal bytes."""
    d = samples.documents(spark, sf_dir)
    return d.select(F.floor(F.col("doc_id") / 20).cast("long").alias("book_id"), (F.col("doc_id") % 20 + 1).cast("long").alias("page_number"), F.lit(0).alias("block_no"), F.encode("text", "UTF-8").alias("image"), F.when(F.col("doc_id") % 2 == 0, "jpg").otherwise("png").alias("ext"))


@query("image_dedup", """WITH i AS (SELECT doc_id // 20 AS book_id, doc_id % 20 + 1 AS page_number, sha256(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'jpeg' ELSE 'png' END AS ext FROM documents),
 f AS (SELECT *, first_value(page_number) OVER w AS p1, first_value(ext) OVER w AS e1 FROM i WINDOW w AS (PARTITION BY book_id, digest ORDER BY page_number))
 SELECT book_id, page_number, digest, 'images/page_' || printf('%04d', p1) || '_image_' || substr(digest, 1, 16) || '.' || e1 AS file_name, page_number = p1 AS is_first FROM f""")
def image_dedup(spark, sf_dir):
    return render.name_images(images_of(spark, sf_dir)).select("book_id", "page_number", "digest", "file_name", "is_first")


def cache_of(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("key"), F.encode("props", "UTF-8").alias("data"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("metadata"))


@query("cache_latest", "SELECT user_id::VARCHAR AS key, max(epoch_us(ts)) / 1e6 AS timestamp FROM events GROUP BY 1")
def cache_latest(spark, sf_dir):
    return cache.latest(cache_of(spark, sf_dir)).select("key", "timestamp")


NOW = "(SELECT max(epoch_us(ts)) / 1e6 FROM events)"


@query("cache_ttl", f"SELECT user_id::VARCHAR AS key, event_type || ':' || event_id AS metadata FROM events WHERE epoch_us(ts) / 1e6 >= {NOW} - 7 * 86400.0")
def cache_ttl(spark, sf_dir):
    e = cache_of(spark, sf_dir)
    now = e.agg(F.max("timestamp")).first()[0] or 0.0
    return cache.fresh(e, now, 7).select("key", "metadata")


@query("cache_stats", "SELECT count(*)::BIGINT AS entries, coalesce(sum(strlen(props)), 0)::BIGINT AS bytes FROM events")
def cache_stats(spark, sf_dir):
    return cache.stats(cache_of(spark, sf_dir))


@query("cache_keys", """SELECT doc_id, sha256('{"n_chars": ' || n_chars || ', "source": "' || source || '"}') AS key, sha256(sha256('{"n_chars": ' || n_chars || ', "source": "' || source || '"}') || ':page:3') AS page_key FROM documents""")
def cache_keys(spark, sf_dir):
    d = samples.documents(spark, sf_dir).select("doc_id", cache.key({"source": F.col("source"), "n_chars": F.col("n_chars")}).alias("key"))
    return d.withColumn("page_key", cache.page_key(F.col("key"), F.lit(3)))


@query("progress_rates", None)
def progress_rates(spark, sf_dir):
    p = counts_of(spark, sf_dir).select("book_id", F.floor(F.col("page_count") / 3).alias("done"), F.col("page_count").alias("total"), (F.col("book_id") + 1.5).alias("seconds"))
    return progress.rates(p)


# Rendering ----------------------------------------------------------------------------------


@query("render_html", f"""{CLASSIFIED} SELECT book_id, page_number, block_no, CASE kind WHEN 'code' THEN '<pre><code>' || {escaped('tx')} || '</code></pre>' ELSE '<p>' || {escaped('tx')} || '</p>' END AS html FROM k WHERE kind IN ('code', 'paragraph')""")
def render_html(spark, sf_dir):
    b = profiled(spark, sf_dir).where("kind IN ('code', 'paragraph')")
    html = F.when(F.col("kind") == "code", F.concat(F.lit("<pre><code>"), T.html_escape(F.col("text")), F.lit("</code></pre>"))).otherwise(render.lines_html(F.col("lines")))
    return b.select("book_id", "page_number", "block_no", html.alias("html"))


@query("render_pages", None)
def render_pages(spark, sf_dir):
    return render.render_pages(profiled(spark, sf_dir), D.page_quality(pages_of(spark, sf_dir)), get_profile("technical"))


@query("chapter_html", None)
def chapter_html(spark, sf_dir):
    return convert.chapters(samples.layout(spark, sf_dir), samples.outline(spark, sf_dir))


@query("convert_epub", None)
def convert_epub(spark, sf_dir):
    return convert.convert(samples.layout(spark, sf_dir), samples.outline(spark, sf_dir)).select("book_id", "title", F.octet_length("epub").alias("n_bytes"), F.sha2("epub", 256).alias("digest"))


@query("validate_epub", None)
def validate_epub(spark, sf_dir):
    return epub.validate(convert.convert(samples.layout(spark, sf_dir), samples.outline(spark, sf_dir), "facsimile"))


# Preflight ----------------------------------------------------------------------------------

MARKED_SQL = f"""{L}{PAGES_SQL}, c AS (SELECT book_id, max(page_number) AS n FROM pages_ GROUP BY 1),
 w AS (SELECT DISTINCT book_id, n, CASE WHEN n <= 20 THEN i ELSE i * n // 20 END + 1 AS page_number FROM (SELECT book_id, n, unnest(range(least(n, 20))) AS i FROM c)),
 st AS (SELECT book_id, any_value(n) AS page_count, count(*)::BIGINT AS sampled_pages, sum(length({TRIM}))::DOUBLE / count(*) AS average FROM pages_ JOIN w USING (book_id, page_number) GROUP BY 1),
 pg AS (SELECT book_id, page_number, lower({spaces('text')}) AS low, text FROM pages_ WHERE page_number <= 40),
 mk AS (SELECT book_id, page_number, ({hits('low', P.TOC_TITLES)} > 0 OR {hits('low', [*P.TOC_TITLES, *P.TOC_CHAPTERS])} >= 4 OR {has('low', r'\.{5,}')}) OR {has('text', r'\.{5,}')} AS toc,
   ({hits('low', P.CODE_MARKERS)} >= 2 OR {has('low', f'(^|[^{WORD}])git[{WS}]+[a-z0-9_.-]+')} OR {has('low', f'(^|[^{WORD}])commit[{WS}]+[0-9a-f]{{7,40}}([^{WORD}]|$)')}) AS code FROM pg)"""
PREFLIGHT_SQL = f"""{MARKED_SQL},
 ag AS (SELECT book_id, count(*) FILTER (toc)::INT AS n_toc, count(*) FILTER (code)::INT AS n_code FROM mk GROUP BY 1)
 SELECT book_id, page_count, sampled_pages, round(average, 6) AS average, average < 25 AS looks_scanned, n_toc, n_code, CASE WHEN average < 25 THEN 'hybrid' ELSE 'technical' END AS recommended_profile, CASE WHEN average < 25 THEN 'auto' ELSE 'off' END AS recommended_ocr_mode FROM st JOIN ag USING (book_id)"""


@query("preflight_report", PREFLIGHT_SQL)
def preflight_report(spark, sf_dir):
    r = preflight.run(blocks_of(spark, sf_dir))
    return r.select("book_id", "page_count", "sampled_pages", F.round("average", 6).alias("average"), "looks_scanned", F.size("toc_pages").alias("n_toc"), F.size("code_pages").alias("n_code"), "recommended_profile", "recommended_ocr_mode")


@query("recommended_rules", None)
def recommended_rules(spark, sf_dir):
    return preflight.recommended_rules(preflight.run(blocks_of(spark, sf_dir)))


@query("preflight_summary", None)
def preflight_summary(spark, sf_dir):
    return preflight.summary(preflight.run(blocks_of(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return ORACLES | oracles.oracles()
