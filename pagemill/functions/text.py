"""Scalar text functions as Spark column expressions.

White space, digits, letters and case follow Unicode, as Java's defaults do not: classes are spelt out
here, once. Line anchors know \\n only. All functions give null for null unless they say otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: Unicode white space, word characters.
WS = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"
#: The characters of WS.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LETTERS = "A-Za-zА-Яа-яЁё"

# Characters of private use that stand for others, wrong decodings, ligatures.
PRIVATE_USE = {
    "\uF06C": "•", "\uF0B7": "•", "\uF0A1": "•", "\uF06E": "•", "\uF070": "•", "\uF0A7": "•", "\uF0AD": "•", "\uF022": '"',
    "\uF023": "#", "\uF025": "%", "\uF02D": "-", "\uF02E": ".", "\uF0D0": "—", "\uF0D1": "–", "\uF020": " ", "\uF0FC": "✓",
}
WRONG_DECODING = (
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã\u00a0", "à"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã±", "ñ"), ("Â«", "«"), ("Â»", "»"), ("Â\u00a0", " "),
)
LIGATURES = (("\uFB00", "ff"), ("\uFB01", "fi"), ("\uFB02", "fl"), ("\uFB03", "ffi"), ("\uFB04", "ffl"), ("\uFB05", "ſt"), ("\uFB06", "st"))
DASHES = {"\u2012": "–", "\u2015": "—", "\u2010": "-", "\u2011": "-", "\uFE58": "—", "\uFE63": "-"}
SPACES = "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
ZERO_WIDTH = "\u200B\u200C\u200D\uFEFF"
# List markers.
SQUARES = "□■▪▫●○·∙⬜⬛◻◼▢❑❒☐"
MARKERS = "▪▫■●○·∙◦‣⁃◘◙⦿⦾☐☑☒⬜⬛◻◼▢❑❒❖➢➣➤➥➧➨➩➪➫➬➭➮➯➱➲➳➴➵➶➷➸➹➺➻➼➽➾✦✧★☆✩✪✫✬✭✮✯✰♦◊🞐🞑🞒🞓▲▼◀▶△▽◁▷"
PRIVATE_MARKERS = "\uF06C\uF0B7\uF0A1\uF06E\uF070\uF0A7\uF0AD"


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def swap(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value's own expression stands once and is worked out once. Neither value nor body may hold a Python UDF."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Words between white space; no words for null."""
    found = F.split(strip(c), f"[{WS}]+", -1)
    return F.when(F.length(strip(c)) > 0, found).otherwise(F.array().cast("array<string>"))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{IsLowercase}")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{IsUppercase}")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = swap(c, a, b)
    return c


def normalize_spaces(c: Column) -> Column:
    """No-break spaces become spaces, runs of blanks one space; line feeds stay; ends are trimmed."""
    return strip(sub(F.translate(c, "\u00a0", " "), r"[ \t\r\f\x0B]+", " "))


def normalize_for_repetition(c: Column) -> Column:
    """What repeats of a running header have in common: lower case, digits as #, no marks."""
    c = sub(F.lower(normalize_spaces(c)), r"\p{Nd}+", "#")
    return strip(sub(sub(c, f"[^{WORD}# ]+"), f"[{WS}]+", " "))


def normalize_line(c: Column) -> Column:
    """Blanks folded; none before closing marks, none after opening ones."""
    c = sub(F.translate(c, "\u00a0", " "), r"[ \t\r\f\x0B]+", " ")
    c = sub(c, f"[{WS}]+([,.;:!?])", "$1")
    c = sub(c, f"([(«])[{WS}]+", "$1")
    return strip(sub(c, f"[{WS}]+([)»])", "$1"))


def repair_hyphenation(c: Column) -> Column:
    """Words broken by a hyphen and white space are joined; at least two letters stand before the break."""

    def joined(t: Column) -> Column:
        t = sub(t, f"([{LETTERS}]{{2,}})-[{WS}]*\\n[{WS}]*([a-zа-яё])", "$1$2")
        t = sub(t, f"-[{WS}]*\\n[{WS}]*-")
        return sub(t, f"([{LETTERS}]{{2,}})-[{WS}]+([a-zа-яё])", "$1$2")

    return let(c, lambda t: F.when(t.contains("-"), joined(t)).otherwise(t))


def filename_fragment(c: Column, most: int = 64) -> Column:
    """Lower case, other than word characters, points and dashes as one _ each run; never empty."""
    c = sub(F.lower(strip(c)), f"[^{WORD}.-]+", "_")
    c = sub(c, r"^[._-]+|[._-]+$")
    return F.substring(F.when(F.length(c) > 0, c).when(c.isNotNull(), "item"), 1, most)


def clean_metadata(c: Column) -> Column:
    return F.nullif(normalize_spaces(c), F.lit(""))


def repair_encoding(c: Column) -> Column:
    """Private use characters, wrong decodings, ligatures, control characters, soft hyphens."""
    c = F.translate(c, "".join(PRIVATE_USE), "".join(PRIVATE_USE.values()))
    for a, b in (*WRONG_DECODING, *LIGATURES):
        c = swap(c, a, b)
    c = sub(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{AD}]")
    return F.translate(c, "\u00a0", " ")


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Composed form. Spark has no such function; texts without characters from U+0300 on are composed
    already and do not travel to Python."""
    needs = c.rlike(r"[\x{300}-\x{10FFFF}]")
    return F.coalesce(F.pandas_udf(_nfc, "string")(F.when(needs, c)), c)


def normalize_unicode(c: Column, composed: bool = False) -> Column:
    """Composed form (unless it is known to be), full-width forms, dashes, spaces, zero-width characters."""
    c = c if composed else nfc(c)
    full = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    c = F.translate(c, full, plain)
    c = F.translate(c, "".join(DASHES) + SPACES, "".join(DASHES.values()) + " " * len(SPACES))
    return F.translate(c, ZERO_WIDTH, "")


def full_repair(c: Column) -> Column:
    return normalize_unicode(repair_encoding(c))


GOOD = r"\p{L}\p{Nd} .,;:!?\-–—()\[\]{}\"'«»\n\t"


def count_of(c: Column, chars: str) -> Column:
    """Characters of a class in c: by what is left without them, which makes no list of them."""
    return F.length(c) - F.length(sub(c, f"{chars}+"))


def matches_of(c: Column, pattern: str) -> Column:
    """How often a pattern is found in c: by what a mark at each place adds, which makes no list of them."""
    return F.length(sub(c, pattern, "$0.")) - F.length(c)


def share(c: Column, chars: str, total: Column) -> Column:
    return F.coalesce(F.try_divide(count_of(c, chars).cast("double"), total.cast("double")), F.lit(0.0))


def average_word(c: Column) -> Column:
    """Characters that are not white space over words; 0 without words."""

    def mean(t: Column) -> Column:
        # white space is all spaces here: a class of one character is found much faster than WS
        return F.coalesce(F.try_divide(F.length(swap(t, " ", "")).cast("double"), matches_of(t, "[^ ]+").cast("double")), F.lit(0.0))

    return let(F.translate(c, BLANKS, " " * len(BLANKS)), mean)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def text_quality(c: Column) -> Column:
    """0 (rubbish) to 0.8: good characters, length of words, less rubbish characters."""

    def score(s: Column) -> Column:
        n = F.length(s)
        found = share(s, f"[{GOOD}]", n) * 0.5 + F.least(F.lit(1.0), average_word(s) / 4.0) * 0.3 - share(s, r"[\p{Co}\p{Cn}\p{Cf}[\p{Cc}&&[^\n\r\t]]]", n) * 0.5
        return F.when(F.coalesce(n, F.lit(0)) < 5, F.lit(0.0)).otherwise(clamp(found, 0.0, 1.0))

    return let(strip(c), score)


def repair_paragraphs(c: Column, level: str = "Medium") -> Column:
    """Broken paragraphs joined: hyphens at line ends (all levels but Off), and with Medium and Aggressive lines
    that go on in lower case or with an opening mark after a line without an ending mark."""
    if level == "Off":
        return c

    def joined(a: Column, now: Column) -> Column:
        if level == "Low":
            return F.lit(False)
        return ~a["last"].rlike(f"[.!?;:»\"][{WS}]*$") & (starts_lower(now) | now.rlike("^[(«\"—–]"))

    def add(a: Column, x: Column) -> Column:
        inside = (F.length(x) > 0) & (F.length(a["last"]) > 0)
        glued = inside & a["last"].endswith("-") & starts_lower(x)
        text = (
            F.when(a["first"], x)
            .when(glued, F.concat(F.substring(a["text"], F.lit(1), F.length(a["text"]) - 1), x))
            .when(inside & joined(a, x), F.concat(a["text"], F.lit(" "), x))
            .otherwise(F.concat(a["text"], F.lit("\n"), x))
        )
        return F.struct(text.alias("text"), x.alias("last"), F.lit(False).alias("first"))

    # a fold, so that the text's own expression stands here once: cleaning steps nest
    begin = F.struct(F.lit("").alias("text"), F.lit("").alias("last"), F.lit(True).alias("first"))
    return strip(sub(F.aggregate(F.transform(lines_of(c), strip), begin, add, lambda a: a["text"]), r"[ \t]{2,}", " "))


def join_lines(rows: Column) -> Column:
    """Lines of a block to one text, hyphens at line ends repaired; an empty line is a space."""

    def add(a: Column, x: Column) -> Column:
        bare = rstrip(a)
        glue = bare.endswith("-") & starts_lower(x)
        return F.when(F.length(x) == 0, F.concat(a, F.lit(" "))).when(glue, F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), x)).otherwise(F.concat(a, F.lit(" "), x))

    def fold(r: Column) -> Column:
        rest = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
        return F.coalesce(F.aggregate(rest, F.coalesce(F.get(r, F.lit(0)), F.lit("")), add), F.lit(""))

    return let(rows, fold)


def clean_garbage(c: Column) -> Column:
    """List markers of all kinds to one bullet and a blank."""
    letters = "А-ЯA-Zа-яa-z"
    odd = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u3000"
    c = F.translate(c, odd, " " * len(odd))
    c = F.translate(c, "\u200c\u200d\ufeff", "")
    c = sub(c, f"(?iu)z[{WS}]+z", "•")
    c = sub(c, "(?iu)zz+", "•")
    c = sub(c, f"(?iumd)^[{WS}]*z[{WS}]+([{letters}])", "• $1")
    c = sub(c, f"(?iu)\\n[{WS}]*z[{WS}]+([{letters}])", "\n• $1")
    c = sub(c, f"(?md)^[{WS}]*[{SQUARES}]+[ \\t]*", "• ")
    c = sub(c, f"\\n[{WS}]*[{SQUARES}]+[ \\t]*", "\n• ")
    c = sub(c, f"[{SQUARES}](?:[ \\t]*[{SQUARES}])*", "•")
    c = F.translate(c, MARKERS, "•" * len(MARKERS))
    c = sub(c, f"[{PRIVATE_MARKERS}]+", "•")
    c = sub(c, f"(?<![{letters}0-9ёЁ])[\\x{{E000}}-\\x{{F8FF}}](?![{letters}0-9ёЁ])", "•")
    c = sub(c, f"(?md)^[{WS}]*[^{WORD}{WS}][ \\t]+([{letters}])", "• $1")
    c = sub(c, f"(?<![^{WS}])[^{WORD}{WS}.,;:!?()\\[\\]{{}}«»“”‘’—–-](?![^{WS}])", "•")
    return sub(sub(c, "•+", "•"), "•[ \\t]+", "• ")


def clean_page_numbers(c: Column) -> Column:
    """No "Page N", no lines of one to four digits, but for the years 1900 to 2099."""
    c = sub(c, f"(?iU)\\bpage[{WS}]+\\p{{Nd}}+\\b")
    c = sub(c, f"(?iU)\\bстр\\.?[{WS}]*\\p{{Nd}}+\\b")
    return strip(sub(c, f"(?md)^[{WS}]*(?!(?:19|20)[0-9][0-9][{WS}]*$)\\p{{Nd}}{{1,4}}[{WS}]*$"))


def clean_toc_leaders(c: Column) -> Column:
    """Dotted leaders: with a page number at the line's end they go, elsewhere they are a dash."""
    c = sub(c, f"(?md)[{WS}]*\\.{{6,}}[{WS}]*\\p{{Nd}}+[{WS}]*$")
    c = sub(c, f"[{WS}]*\\.{{4,}}[{WS}]*", " — ")
    return sub(c, f"(\\.{{3,}}[{WS}]*)+", " — ")


def kept_lines(c: Column, keep) -> Column:
    return F.array_join(F.filter(lines_of(c), keep), "\n")


def clean_side_numbers(c: Column) -> Column:
    return kept_lines(c, lambda x: ~strip(x).rlike(r"^\p{Nd}{1,3}$"))


def clean_chart_artifacts(c: Column, keep_figures: bool = False) -> Column:
    """No lines of one letter, none short of mostly digits; long ones and those with a dash stay."""

    def keep(x: Column) -> Column:
        s = strip(x)
        low, n = F.lower(s), F.length(s)
        stays = (n == 0) | (n > 70) | s.contains("—")
        if keep_figures:
            stays = stays | low.rlike(f"(рис\\.?|рисунок|figure|fig\\.?)[{WS}]*\\p{{Nd}}")
        odd = low.rlike(r"^[а-яa-z]\.?$") | ((F.regexp_count(s, F.lit(r"\p{Nd}")) > n * 0.45) & (n < 50))
        return stays | ~odd

    return kept_lines(c, keep)


#: Letters but for z, which cleaning may take for a list marker.
PLAIN = "A-Ya-yÀ-ÖØ-öø-ÿА-Яа-яЁё"


def is_plain(c: Column) -> Column:
    """One line in which no cleaning step finds anything but blanks to fold: letters, digits, spaces and marks that no
    step takes for a list marker; no mark or z alone at its begin, no z before another, no three points; where there are digits,
    50 characters at least and none after "page" or "стр"."""
    line = c.rlike(rf"^(?! *+[^{PLAIN}0-9 ] )(?:[{PLAIN}0-9 ,;:!?()\[\]{{}}«»“”‘’—–-]++|\.(?!\.\.)|[zZ](?! *+[zZ])|(?<=[{PLAIN}])['\"])*+\z")
    n = F.length(F.trim(c))
    return line & (n >= 3) & (~c.rlike("[0-9]") | ((n >= 50) & ~c.rlike(r"[eE] +[0-9]|[рР]\.? *[0-9]")))


def clean_full(c: Column, level: str = "Medium", keep_figures: bool = False) -> Column:
    """All cleaning steps in their fixed order."""

    def cleaned(t: Column) -> Column:
        t = clean_toc_leaders(clean_page_numbers(clean_garbage(t)))
        t = repair_paragraphs(clean_chart_artifacts(clean_side_numbers(t), keep_figures), level)
        return strip(sub(sub(t, r"\n{3,}", "\n\n"), r"[ \t]+", " "))

    # most lines are plain, and the steps are some 40 searches
    return let(c, lambda t: F.when(is_plain(t), F.trim(sub(t, " {2,}", " "))).otherwise(cleaned(t)))


# Words whose letters extraction parts, with the forms that replace them.
SPLIT_WORDS = (
    ("g{s}i{s}t", "git"), ("commi{s}t", "commit"), ("autho{s}r", "Author"), ("авто{s}р", "Автор"), ("dat{s}e", "Date"), ("merg{s}e", "Merge"),
    ("maste{s}r", "master"), ("origi{s}n", "origin"), ("branc{s}h", "branch"), ("remot{s}e", "remote"), ("reposit{s}o{s}ry", "repository"),
)
HASH_LENGTHS = (7, 8, 12, 16, 20, 40)


def repair_hash_spacing(c: Column) -> Column:
    """Two runs of hexadecimal digits become one where it has a hash's length. Pairs are found first, left to
    right, and set apart by marks, so that a run belongs to one pair only."""
    hexa = "[0-9a-fA-F]"
    c = sub(c, f"(?U)\\b({hexa}{{3,20}})([{WS}]+)({hexa}{{3,20}})\\b", "\x01$1\x02$2\x03$3\x04")
    pairs = "|".join(f"(?={hexa}{{{i}}}\x02[^\x03]*\x03{hexa}{{{n - i}}}\x04)" for n in HASH_LENGTHS for i in range(3, 21) if 3 <= n - i <= 20)
    c = sub(c, f"\x01(?:{pairs})({hexa}+)\x02[^\x03]*\x03({hexa}+)\x04", "$1$2")
    return F.translate(c, "\x01\x02\x03\x04", "")


def repair_option_spacing(c: Column) -> Column:
    c = sub(c, f"--[{WS}]+([A-Za-z][A-Za-z0-9-]+)", "--$1")
    return sub(c, f"(?<=[{WS}])-[{WS}]+([A-Za-z])", "-$1")


def repair_code_line(c: Column, split_words: bool = True) -> Column:
    c = F.translate(rstrip(c), "\u00ad\ufffe", "")
    c = sub(c, f"[{WS}]+-[{WS}]+-", " --")
    c = sub(c, f"(?<=[{WS}])-[{WS}]+(?=[A-Za-z])", "-")
    c = sub(c, f"(?<=[{WORD}])[{WS}]+\\.[{WS}]+(?=[{WORD}])", ".")
    c = sub(c, f"(?<=[{WORD}])[{WS}]+/[{WS}]+(?=[{WORD}])", "/")
    c = sub(c, f"(?<=[{WORD}])[{WS}]+:[{WS}]+/[{WS}]+/", "://")
    if split_words:
        for pattern, whole in SPLIT_WORDS:
            c = sub(c, f"(?iU)\\b{pattern.format(s=f'[{WS}]*')}\\b", whole)
    return repair_option_spacing(repair_hash_spacing(c))


def code_lines(c: Column) -> Column:
    """Lines as written; one empty line at the end does not count."""
    rows = F.split(c, "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]", -1)
    return F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)


def repair_code(c: Column, split_words: bool = True) -> Column:
    return rstrip(F.array_join(F.transform(code_lines(c), lambda x: repair_code_line(x, split_words)), "\n"))
