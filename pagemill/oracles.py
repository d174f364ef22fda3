"""SQL for queries whose patterns look around: RE2 has no look-around, so neighbours are captured and put back, and steps that
may overlap are repeated until nothing can be left."""

from __future__ import annotations

from .functions import formulas as M, text as T
from .operators import ml, preflight
from .queries import CANDIDATES_SQL, CLASSIFIED, GROUPS_SQL, L, MARKED_SQL, NOVEL, V, WORD, WS, charts, encoding_sql, entry_sql, escaped, has, page_numbers, paragraphs, q, rows, rx, side_numbers, spaces, strip, toc_leaders, unicode_sql

LETTER = "А-ЯA-Zа-яa-z"
#: Stands at the ends of words that ASCII word boundaries do not see; no hexadecimal digit.
EDGE = "zqxz"


def again(e: str, pattern: str, to: str, times: int = 2) -> str:
    for _ in range(times):
        e = rx(e, pattern, to)
    return e


def translated(e: str, a: str, b: str) -> str:
    return f"translate({e}, {q(a)}, {q(b)})"


def garbage(e: str) -> str:
    odd = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u3000"
    e = translated(translated(e, odd, " " * len(odd)), "\u200c\u200d\ufeff", "")
    e = rx(rx(e, f"(?i)z[{WS}]+z", "•"), "(?i)zz+", "•")
    e = rx(e, f"(?im)^[{WS}]*z[{WS}]+([{LETTER}])", r"• \1")
    e = rx(e, f"(?i)\\n[{WS}]*z[{WS}]+([{LETTER}])", "\n• \\1")
    e = rx(e, f"(?m)^[{WS}]*[{T.SQUARES}]+[ \\t]*", "• ")
    e = rx(e, f"\\n[{WS}]*[{T.SQUARES}]+[ \\t]*", "\n• ")
    e = rx(e, f"[{T.SQUARES}](?:[ \\t]*[{T.SQUARES}])*", "•")
    e = translated(e, T.MARKERS, "•" * len(T.MARKERS))
    e = rx(e, f"[{T.PRIVATE_MARKERS}]+", "•")
    e = again(e, f"(^|[^{LETTER}0-9ёЁ])[\\x{{E000}}-\\x{{F8FF}}]($|[^{LETTER}0-9ёЁ])", r"\1•\2", 4)
    e = rx(e, f"(?m)^[{WS}]*[^{WORD}{WS}][ \\t]+([{LETTER}])", r"• \1")
    e = again(e, f"(^|[{WS}])[^{WORD}{WS}.,;:!?()\\[\\]{{}}«»“”‘’—–•-]($|[{WS}])", r"\1•\2")
    return rx(rx(e, "•+", "•"), "•[ \\t]+", "• ")


FULL = f"""{V}, a AS (SELECT doc_id, {garbage('t')} AS t FROM v), b AS (SELECT doc_id, {toc_leaders(page_numbers('t'))} AS t FROM a),
 c AS (SELECT doc_id, {charts(side_numbers('t'))} AS t FROM b), d AS (SELECT doc_id, {paragraphs('t', 'Medium')} AS t FROM c)
 SELECT doc_id, {strip(rx(rx('t', chr(10) + '{3,}', chr(10) * 2), '[ ' + chr(9) + ']+', ' '))} AS out FROM d"""


def hash_spacing(e: str) -> str:
    hexa = "[0-9a-fA-F]"
    e = rx(e, r"((?:[^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F])+)", EDGE + r"\1" + EDGE)
    e = rx(e, f"\\b({hexa}{{3,20}})([{WS}]+)({hexa}{{3,20}})\\b", "\x01\\1\x02\\2\x03\\3\x04")
    for n in T.HASH_LENGTHS:
        for i in range(3, 21):
            if 3 <= n - i <= 20:
                e = rx(e, f"\x01({hexa}{{{i}}})\x02[^\x03]*\x03({hexa}{{{n - i}}})\x04", r"\1\2")
    return translated(f"replace({e}, '{EDGE}', '')", "\x01\x02\x03\x04", "")


def code_line(e: str) -> str:
    e = translated(rx(e, f"[{WS}]+$"), "\u00ad\ufffe", "")
    e = rx(e, f"[{WS}]+-[{WS}]+-", " --")
    e = again(e, f"([{WS}])-[{WS}]+([A-Za-z])", r"\1-\2")
    e = again(e, f"([{WORD}])[{WS}]+\\.[{WS}]+([{WORD}])", r"\1.\2")
    e = again(e, f"([{WORD}])[{WS}]+/[{WS}]+([{WORD}])", r"\1/\2")
    e = rx(e, f"([{WORD}])[{WS}]+:[{WS}]+/[{WS}]+/", r"\1://")
    for pattern, whole in T.SPLIT_WORDS:
        e = again(e, f"(?i)(^|[^{WORD}]){pattern.format(s=f'[{WS}]*')}($|[^{WORD}])", rf"\1{whole}\2")
    e = rx(hash_spacing(e), f"--[{WS}]+([A-Za-z][A-Za-z0-9-]+)", r"--\1")
    return again(e, f"([{WS}])-[{WS}]+([A-Za-z])", r"\1-\2")


LINES = f"string_split_regex(t, {q('\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')})"
CODE = f"""{V}, l AS (SELECT doc_id, {LINES} AS ls FROM v), k AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM l)
 SELECT doc_id, {rx(f"array_to_string(list_transform(ls, lambda x: {code_line('x')}), chr(10))", f'[{WS}]+$')} AS out FROM k"""


def mathml(e: str) -> str:
    e = rx(e, r"\\frac\{([^}]+)\}\{([^}]+)\}", r"<mfrac><mi>\1</mi><mi>\2</mi></mfrac>")
    e = rx(e, f"\\^([{WORD}]+)", r"<msup><mi></mi><mi>\1</mi></msup>")
    e = rx(e, f"_\\{{?([{WORD}]+)\\}}?", r"<msub><mi></mi><mi>\1</mi></msub>")
    letters = {v[1:]: k for k, v in M.SYMBOLS.items()}
    for name in M.GREEK:
        e = again(e, f"\\\\{name}([^{WORD}]|$)", rf"<mi>{letters[name]}</mi>\1")
    for name in M.OPERATORS:
        e = f"replace({e}, {q(chr(92) + name)}, {q(f'<mo>{letters[name]}</mo>')})"
    return f"""'<math xmlns="http://www.w3.org/1998/Math/MathML">' || {e} || '</math>'"""


def symbols(e: str) -> str:
    for a, b in M.SYMBOLS.items():
        e = f"replace({e}, {q(a)}, {q(b)})"
    return e


MATH = "[" + "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in M.MATH) + "]{3,}"
PATTERNS = [*M.LATEX, f"({MATH})"]
#: Places of matches: each is the first place of its text after the match before.
FORMULAS = f"""{V.replace('WITH ', 'WITH RECURSIVE ', 1)},
 p AS ({' UNION ALL '.join(f"SELECT doc_id, t, {k} AS pat, regexp_extract_all(t, {q(p)}) AS ms, regexp_extract_all(t, {q(p)}, 1) AS gs FROM v" for k, p in enumerate(PATTERNS))}),
 s AS (SELECT * FROM p WHERE len(ms) > 0),
 w AS (SELECT doc_id, pat, 0::BIGINT AS k, 0::BIGINT AS b, 0::BIGINT AS e FROM s UNION ALL
       SELECT doc_id, pat, k + 1, x, x + length(m) FROM (SELECT w.doc_id, w.pat, w.k, s.ms[w.k + 1] AS m, w.e + strpos(substr(s.t, w.e + 1), s.ms[w.k + 1]) - 1 AS x FROM w JOIN s ON w.doc_id = s.doc_id AND w.pat = s.pat WHERE w.k < len(s.ms))),
 f AS (SELECT w.doc_id, w.pat, w.k, w.b, w.e, CASE WHEN w.pat = {len(M.LATEX)} THEN {symbols('s.ms[w.k]')} ELSE {strip('s.gs[w.k]')} END AS latex, CASE WHEN w.pat = {len(M.LATEX)} THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence,
   CASE WHEN w.pat < {len(M.LATEX)} AND (starts_with(s.ms[w.k], '$$') OR starts_with(s.ms[w.k], chr(92) || '[')) THEN 'display' ELSE 'inline' END AS type FROM w JOIN s ON w.doc_id = s.doc_id AND w.pat = s.pat WHERE w.k > 0)"""
FIND = f"""{FORMULAS} SELECT doc_id, latex, b::INT AS begin_pos, e::INT AS end_pos, confidence, type,
 CASE type WHEN 'display' THEN '<div class="math-display">' || {mathml('latex')} || '</div>' ELSE '<span class="math-inline">' || {mathml('latex')} || '</span>' END AS html FROM f"""
PLACED = f"""{FORMULAS}, o AS (SELECT doc_id, count(*)::INT AS n, list({{'t': '', 'b': b::INT, 'e': e::INT, 'n': 0::INT}} ORDER BY b DESC, pat, k) AS l FROM f GROUP BY 1)
 SELECT v.doc_id, coalesce(o.n, 0)::INT AS n, CASE WHEN o.n IS NULL THEN v.t ELSE (list_reduce(list_prepend({{'t': v.t, 'b': 0::INT, 'e': 0::INT, 'n': 0::INT}}, o.l),
   lambda a, x: {{'t': substr(a.t, 1, x.b) || '<!-- FORMULA_' || a.n || ' -->' || substr(a.t, x.e + 1), 'b': 0::INT, 'e': 0::INT, 'n': (a.n + 1)::INT}})).t END AS out FROM v LEFT JOIN o ON v.doc_id = o.doc_id"""

TITLE, PAGE, LEVEL, OK = entry_sql("line")
LISTED = f"""{V}, l AS (SELECT doc_id, unnest({rows('t')}) AS line, unnest(range(len({rows('t')}))) AS pos FROM v),
 e AS (SELECT doc_id, pos, {TITLE} AS title, {PAGE} AS page FROM l WHERE lower({spaces('line')}) NOT IN ('содержание', 'оглавление', 'contents')),
 i AS (SELECT doc_id, pos, '<li class="toc-level-' || {LEVEL} || '"><span class="toc-title">' || {escaped('title')} || '</span><span class="toc-page">' || coalesce(page::VARCHAR, '') || '</span></li>' AS item FROM e WHERE {OK})
 SELECT doc_id AS book_id, 1::BIGINT AS page_number, '<section class="source-toc">' || chr(10) || '<h1>Contents</h1>' || chr(10) || '<ol class="toc-list">' || chr(10) || string_agg(item, chr(10) ORDER BY pos) || chr(10) || '</ol>' || chr(10) || '</section>' AS html FROM i GROUP BY 1"""
FROM_WORDS = f"""{V}, l AS (SELECT doc_id, unnest({rows('t')}) AS raw, unnest(range(len({rows('t')}))) AS line_no FROM v),
 j AS (SELECT doc_id, line_no, {rx(strip('raw'), f'[{WS}]+', ' ')} AS line FROM l WHERE length({strip('raw')}) > 0),
 e AS (SELECT doc_id, line_no, {TITLE} AS title, {PAGE} AS page FROM j)
 SELECT doc_id AS book_id, 1::BIGINT AS page_number, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS pos, title, page, {LEVEL} AS level FROM e WHERE {OK}"""

#: Cuts of ten characters, of which three touch: each group of three is one span.
KERNING = f"{L} SELECT book_id, page_number, block_no, ceil((greatest(length(text) - 1, 0) // 10 + 1) / 3.0)::INT AS n_spans, text FROM spans"
REPAIRED = f"{L} SELECT book_id, count(*)::BIGINT AS n, sum(length({unicode_sql(encoding_sql('text'))}))::BIGINT AS chars FROM spans WHERE length(text) > 0 GROUP BY 1"

#: A page's blocks in order; a paragraph that goes on joins the one before. Blocks of these books have one height and
#: stand below each other, so the last member tells where the paragraph ends.
MERGED = f"""{NOVEL}, o AS (SELECT book_id, page_number, block_no, kind, tx, lag(kind) OVER w AS pk, lag(tx) OVER w AS pt, y0 - lag(y1) OVER w AS gap, lag(y1 - y0) OVER w AS height_
   FROM k WINDOW w AS (PARTITION BY book_id, page_number ORDER BY block_no)),
 g AS (SELECT *, CASE WHEN kind = 'paragraph' AND pk = 'paragraph' AND length(tx) > 0 AND length(pt) > 0 AND NOT {has('pt', f'[.!?;:»"”][{WS}]*$')} AND gap <= height_ * 2 AND ({has('tx', '^' + chr(92) + 'p{Ll}')} OR {has('tx', '^[(«“]')}) THEN 0 ELSE 1 END AS new FROM o),
 h AS (SELECT *, sum(new) OVER (PARTITION BY book_id, page_number ORDER BY block_no)::INT - 1 AS pos FROM g)
 SELECT book_id, page_number, pos, any_value(kind) AS kind, count(*)::INT AS n_members FROM h GROUP BY book_id, page_number, pos"""

AREA = "(x1 - x0) * (y1 - y0) + (b1 - a1) * (b2 - a2)"
KIND_OF = "CASE best.label " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ml.KINDS.items()) + " END"


def override_sql(groups: str) -> str:
    """groups: tables from predictions to grp (ml_no, label number, mean confidence)."""
    names = "[" + ", ".join(q(x) for x in ml.LABELS) + "]"
    return f"""{CLASSIFIED}, {groups},
 os AS (SELECT k.book_id, k.page_number, k.block_no, {names}[g.label + 1] AS label, g.confidence, g.ml_no, k.x0, k.y0, k.x1, k.y1, g.x0 / 1000.0 * k.width AS a1, g.y0 / 1000.0 * k.height AS a2, g.x1 / 1000.0 * k.width AS b1, g.y1 / 1000.0 * k.height AS b2
   FROM k JOIN grp g ON k.book_id = g.book_id AND k.page_number = g.page_number),
 oi AS (SELECT *, least(x1, b1) - greatest(x0, a1) AS w, least(y1, b2) - greatest(y0, a2) AS h FROM os),
 ou AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 OR {AREA} - w * h <= 0 THEN 0.0 ELSE w * h / ({AREA} - w * h) END AS iou FROM oi),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_number, block_no ORDER BY iou DESC, ml_no) AS turn FROM ou WHERE iou > 0.3) WHERE turn = 1),
 ot AS (SELECT k.book_id, k.page_number, k.block_no, k.kind, {KIND_OF} AS other, coalesce(best.confidence > 0.75 AND coalesce({KIND_OF}, k.kind) <> k.kind, FALSE) AS overridden
   FROM k LEFT JOIN best ON k.book_id = best.book_id AND k.page_number = best.page_number AND k.block_no = best.block_no)
 SELECT book_id, page_number, block_no, CASE WHEN overridden THEN other ELSE kind END AS kind, overridden FROM ot"""


RATES = f"""{L}, c AS (SELECT book_id, max(page_number)::BIGINT AS total FROM spans GROUP BY 1), p AS (SELECT book_id, total // 3 AS done, total, book_id + 1.5::DOUBLE AS seconds FROM c),
 r AS (SELECT *, CASE WHEN seconds = 0 THEN 0.0 ELSE done / seconds END AS speed, CASE WHEN total = 0 THEN 0.0 ELSE done::DOUBLE / total END AS part FROM p)
 SELECT book_id, done, total, seconds, round(speed, 2) AS pages_per_second, CASE WHEN speed = 0 THEN 0.0 ELSE round((total - done) / speed, 1) END AS eta_seconds, round(part * 100, 1) AS percent,
   repeat('#', floor(part * 20)::INT) || repeat('-', 20 - floor(part * 20)::INT) AS bar FROM r"""

C = preflight.CROP
RANGES = "rg AS (SELECT book_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM (SELECT book_id, min(page_number) AS lo, max(page_number) AS hi FROM (SELECT book_id, page_number, page_number - row_number() OVER (PARTITION BY book_id ORDER BY page_number) AS g FROM mk WHERE toc) GROUP BY book_id, g) GROUP BY 1)"
RULES = f"""{MARKED_SQL}, {RANGES} SELECT st.book_id, '{{"crop":{{"mode":"ratio","top_ratio":{C["top_ratio"]},"bottom_ratio":{C["bottom_ratio"]},"left_ratio":0.0,"right_ratio":0.0}},"toc":{{"mode":"' || CASE WHEN ranges IS NULL THEN 'auto' ELSE 'semantic' END || '","pages":"' || coalesce(ranges, '')
 || '","drop_original_dot_leaders":true}},"headers_footers":{{"remove_repeated":true,"remove_page_numbers":true,"top_ratio":0.12,"bottom_ratio":0.12,"min_repeats":3}},"code":{{"repair_git_spacing":true,"detect_commit_blocks":true,"detect_diff_blocks":true}},"exclude_regions":[]}}' AS rules
 FROM st LEFT JOIN rg ON st.book_id = rg.book_id"""
#: Books without images: of the two kinds of warnings on them none, and no profile for them.
SUMMARY = f"""{MARKED_SQL}, {CANDIDATES_SQL}, cd AS (SELECT book_id, count(*) AS n, string_agg('  - [' || area || '] x' || repeats || ': ' || text, chr(10) ORDER BY rank) FILTER (rank <= 10) AS listed FROM cand GROUP BY 1),
 pgs AS (SELECT book_id, string_agg(page_number::VARCHAR, ', ' ORDER BY page_number) FILTER (toc) AS toc_pages, string_agg(page_number::VARCHAR, ', ' ORDER BY page_number) FILTER (code AND turn <= 30) AS code_pages
   FROM (SELECT *, sum(code::INT) OVER (PARTITION BY book_id ORDER BY page_number) AS turn FROM mk) GROUP BY 1),
 x AS (SELECT st.*, average < 25 AS scanned, toc_pages, code_pages, listed FROM st LEFT JOIN pgs USING (book_id) LEFT JOIN cd USING (book_id))
 SELECT book_id, concat_ws(chr(10), 'Book: ' || book_id, 'Pages: ' || page_count, 'Looks scanned: ' || scanned, 'Average characters a sampled page: ' || printf('%.1f', round(average::DECIMAL(20, 8), 1)),
   'Recommended profile: ' || CASE WHEN scanned THEN 'hybrid' ELSE 'technical' END, 'Recommended OCR mode: ' || CASE WHEN scanned THEN 'auto' ELSE 'off' END, 'Recommended crop: top={C["top_ratio"]}, bottom={C["bottom_ratio"]}',
   'Contents pages: ' || toc_pages, 'Code pages: ' || code_pages, 'Repeated headers and footers:' || chr(10) || listed,
   'Warnings:' || chr(10) || '  - ' || nullif(concat_ws(chr(10) || '  - ', CASE WHEN scanned THEN 'The text layer is weak or missing: use OCR.' END, CASE WHEN toc_pages IS NOT NULL THEN 'Pages like a table of contents: convert dotted leaders by meaning.' END,
     CASE WHEN code_pages IS NOT NULL THEN 'Pages with code: use profile technical or hybrid.' END, CASE WHEN listed IS NOT NULL THEN 'Repeated headers or footers: remove them, crop moderately.' END), '')) AS summary FROM x"""


def oracles() -> dict[str, str]:
    plain = lambda e: f"{V} SELECT doc_id, {e} AS out FROM v"
    return {
        "clean_garbage_symbols": plain(garbage("t")), "clean_full": FULL, "repair_code": CODE, "repair_hash_spacing": plain(hash_spacing("t")), "formula_mathml": plain(mathml("t")),
        "formulas": FIND, "formula_placeholders": PLACED, "toc_html": LISTED, "toc_from_words": FROM_WORDS, "kerning_merge": KERNING, "text_repair_spans": REPAIRED,
        "paragraph_merge": MERGED, "ml_override": override_sql(GROUPS_SQL), "progress_rates": RATES, "recommended_rules": RULES, "preflight_summary": SUMMARY,
    }
