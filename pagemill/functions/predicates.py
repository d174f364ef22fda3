"""Tests and decision lists on text and geometry, as Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, code_lines, let, normalize_spaces, strip, sub, words

# Fonts, prefixes and markers.
MONOSPACE = ("mono", "courier", "consolas", "menlo", "monaco", "liberationmono", "dejavusansmono", "nimbusmono")
CAPTIONS = ("figure ", "fig. ", "рисунок ", "рис. ", "table ", "таблица ")
COMMANDS = (
    "$", "#", ">", "sudo", "su", "cd", "ls", "cat", "less", "more", "grep", "egrep", "fgrep", "awk", "sed", "find", "chmod", "chown", "systemctl",
    "journalctl", "dnf", "yum", "apt", "apt-get", "pacman", "zypper", "docker", "podman", "kubectl", "ssh", "scp", "rsync", "ip", "ifconfig", "nmcli",
    "firewall-cmd", "iptables", "nft", "mount", "umount", "tar", "curl", "wget", "vim", "nano", "git",
)
CODE_STARTS = ("commit ", "merge:", "author:", "date:", "автор:", "дата:", "diff --git", "index ", "--- ", "+++ ", "@@ ")
COMMIT_MARKERS = ("commit ", "merge:", "author:", "автор", "date:", "diff --git", "@@", "index ", "git log", "git show")
DIFF_STARTS = ("diff --git", "index ", "--- ", "+++ ", "@@ ", "+", "-")
TOC_TITLES = ("содержание", "оглавление", "contents")
TOC_CHAPTERS = ("глава ", "раздел ", "chapter ", "section ")
CODE_MARKERS = (
    "git ", "commit ", "merge:", "author:", "автор:", "date:", "diff --git", "@@ ", "index ",
    "git log", "git show", "git commit", "git remote", "git checkout", "git branch", "git rebase", "git merge", "git pull", "git push",
)
SPECIAL = r"/\-_=$#.:;|&><*{}[]()@+"
BOLD, ITALIC = 16, 2


def hits(c: Column, markers: Sequence[str]) -> Column:
    """How many of the markers a text has. The text's own expression is worked out once."""

    def count(t: Column) -> Column:
        out = F.lit(0)
        for m in markers:
            out = out + F.coalesce(t.contains(m).cast("int"), F.lit(0))
        return out

    return let(c, count)


def starts(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def begins(c: Column, prefixes: Sequence[str], whole: bool = True) -> Column:
    """starts() of a text without white space at its begin (and its end, if whole), in one pass over its begin."""
    each = (re.sub(r"([^\w ])", r"\\\1", p) + (f"(?=(?s:.*)[^{WS}])" if whole and p.endswith(" ") else "") for p in prefixes)
    return c.rlike(f"^[{WS}]*+(?:{'|'.join(each)})")


def clip_rect(width: Column, height: Column, crop: dict) -> Column:
    """Rectangle left of a crop by points or by shares; an axis without extent is the page's whole."""
    sides = {k: F.lit(float(crop.get(k if crop.get("mode") == "points" else f"{k}_ratio", 0.0))) for k in ("left", "top", "right", "bottom")}
    if crop.get("mode") != "points":
        sides = {k: v * (width if k in ("left", "right") else height) for k, v in sides.items()}
    x0, x1 = F.greatest(F.lit(0.0), F.least(width, sides["left"])), F.greatest(F.lit(0.0), F.least(width, width - sides["right"]))
    y0, y1 = F.greatest(F.lit(0.0), F.least(height, sides["top"])), F.greatest(F.lit(0.0), F.least(height, height - sides["bottom"]))
    flat, low = x1 <= x0, y1 <= y0
    return F.struct(F.when(flat, 0.0).otherwise(x0).alias("x0"), F.when(low, 0.0).otherwise(y0).alias("y0"), F.when(flat, width).otherwise(x1).alias("x1"), F.when(low, height).otherwise(y1).alias("y1"))


def rects_meet(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Rectangles (x0, y0, x1, y1) overlap; touching is not enough."""
    return (a[2] > b[0]) & (a[0] < b[2]) & (a[3] > b[1]) & (a[1] < b[3])


def page_ranges(text: str) -> list[tuple[int, int]]:
    """"4-9,12,20-" as closed ranges; open ends are 1 and a billion; single parts that are not numbers are left out."""
    out = []
    for part in (p.strip() for p in (text or "").split(",")):
        if "-" in part:
            low, _, high = part.partition("-")
            out.append((int(low) if low.strip() else 1, int(high) if high.strip() else 1_000_000_000))
        elif part.isdigit():
            out.append((int(part), int(part)))
    return out


def page_in(number: Column, ranges: str) -> Column:
    out = F.lit(False)
    for low, high in page_ranges(ranges):
        out = out | number.between(low, high)
    return out


def in_margin(y0: Column, y1: Column, height: Column, share: float = 0.12) -> Column:
    return (y1 <= height * share) | (y0 >= height * (1.0 - share))


def bare_number(c: Column) -> Column:
    """A text without marks around it and page words before it."""
    marks = f"[{WS}\\-–—.•◦]*"
    c = sub(strip(c), f"^{marks}|{marks}$")
    return strip(sub(c, f"(?iu)^(стр\\.?|page|p\\.?|с\\.?)[{WS}]*"))


def is_page_number(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    return bare_number(text).rlike(r"^\p{Nd}{1,4}$") & in_margin(y0, y1, height, 0.10)


def is_caption(text: Column) -> Column:
    return begins(F.lower(text), CAPTIONS)


def heading_threshold(median: Column) -> Column:
    return F.greatest(median * 1.25, median + 1.5)


def is_heading(text: Column, size: Column, median: Column) -> Column:
    n = F.size(words(text))
    return (F.length(text) <= 180) & (n <= 18) & (size >= heading_threshold(median)) & ~(text.endswith(".") & (n > 7))


def heading_level(text: Column, size: Column, median: Column) -> Column:
    s = strip(text)
    return (
        F.when(s.rlike(f"(?iu)^(chapter|part|глава|часть)[{WS}]+\\p{{Nd}}+"), 1)
        .when(s.rlike(f"^\\p{{Nd}}+\\.\\p{{Nd}}+(\\.\\p{{Nd}}+)?[{WS}]+"), 2)
        .when(size >= median * 1.8, 1)
        .when(size >= median * 1.45, 2)
        .otherwise(3)
    )


def is_command(line: Column) -> Column:
    low = F.lower(strip(line))
    names = "|".join(c.replace("$", r"\$").replace("-", r"\-") for c in COMMANDS)
    return low.rlike(
        f"^(?:{names}) |^[a-z0-9_.-]+@[a-z0-9_.-]+[:~/$#>]|^(sudo[{WS}]+)?[a-z0-9_.-]+[{WS}]+(-{{1,2}}[a-z0-9][a-z0-9-]*|/[a-z0-9_.-]+)|^git[{WS}]+[a-z0-9_.-]+"
    )


def is_config(line: Column) -> Column:
    return strip(line).rlike(f"^\\[[A-Za-z0-9_. -]+\\]$|^[A-Za-z0-9_.-]+[{WS}]*[=:][{WS}]*.+$|\\{{$|^\\}}$")


def is_commit(text: Column) -> Column:
    return hits(F.lower(text), COMMIT_MARKERS) >= 2


def is_diff(text: Column) -> Column:
    return F.size(F.filter(let(text, code_lines), lambda x: begins(x, DIFF_STARTS))) >= 3


def density(text: Column) -> Column:
    """Share of special characters; 0 for no text."""
    return F.coalesce(F.try_divide((F.length(text) - F.length(F.translate(text, SPECIAL, ""))).cast("double"), F.length(text).cast("double")), F.lit(0.0))


def is_code(lines: Column, mono_share: Column) -> Column:
    """lines: a block's normalised lines that are not empty; mono_share: of its characters in fixed-width fonts."""
    text = F.array_join(lines, "\n")
    low = F.lower(text)
    n, dense = F.size(lines), let(text, density)
    commands, settings = F.size(F.filter(lines, is_command)), F.size(F.filter(lines, is_config))
    # what costs least comes first; each text is worked out once
    yes = (
        (mono_share >= 0.60) | is_commit(text) | begins(low, (*CODE_STARTS, *(f"{c} " for c in COMMANDS)), whole=False) | is_diff(text)
        | let(commands, lambda k: (k >= 2) | ((k >= 1) & (n <= 3))) | let(dense, lambda d: ((n >= 3) & (d >= 0.16)) | ((d >= 0.08) & (settings >= 2)))
    )
    return (n > 0) & yes


def is_table(lines: Column) -> Column:
    """At least two lines of which two have a bar, or with wide gaps and three columns."""
    gaps = F.size(F.filter(lines, lambda x: x.rlike(f"[^{WS}][{WS}]{{2,}}[^{WS}]")))
    columns = F.size(F.filter(lines, lambda x: F.size(F.split(strip(x), f"[{WS}]{{2,}}", -1)) >= 3))
    bars = F.size(F.filter(lines, lambda x: x.contains("|")))
    return (F.size(lines) >= 2) & ((bars >= 2) | ((gaps >= 3) & (columns >= 2)))


def font_is_mono(font: Column) -> Column:
    return sub(F.lower(font), " ").rlike("|".join(MONOSPACE))


def font_is_bold(font: Column) -> Column:
    return sub(F.lower(font), "[-_]").rlike("bold|heavy|black|demibold|semibold")


def font_is_italic(font: Column) -> Column:
    return sub(F.lower(font), "[-_]").rlike("italic|oblique|inclined")


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(BOLD) != 0) | font_is_bold(font)


def is_italic(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(ITALIC) != 0) | font_is_italic(font)


def has_toc_markers(low: Column) -> Column:
    """low: lower-case page text."""
    return (hits(low, TOC_TITLES) > 0) | (hits(low, [*TOC_TITLES, *TOC_CHAPTERS]) >= 4) | low.rlike(r"\.{5,}")


def has_code_markers(low: Column) -> Column:
    return (hits(low, CODE_MARKERS) >= 2) | low.rlike(f"(?U)\\bgit[{WS}]+[a-z0-9_.-]+") | low.rlike(f"(?U)\\bcommit[{WS}]+[0-9a-f]{{7,40}}\\b")


def is_toc_text(text: Column) -> Column:
    low = F.lower(text)
    chapters = sum((F.regexp_count(low, F.lit(m.strip())) for m in TOC_CHAPTERS), F.lit(0))
    return (hits(low, TOC_TITLES) > 0) | (F.regexp_count(text, F.lit(r"\.{5,}")) >= 5) | (chapters >= 8)


def is_toc_title(text: Column) -> Column:
    return starts(F.lower(text), TOC_CHAPTERS) | text.rlike(f"^\\p{{Nd}}+(\\.\\p{{Nd}}+)*[{WS}]+")


def toc_level(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(starts(low, ("глава ", "chapter ")), 1).when(starts(low, ("раздел ", "section ")), 2)
        .when(text.rlike(r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+"), 3).when(text.rlike(r"^\p{Nd}+\.\p{Nd}+"), 2).otherwise(1)
    )


def toc_entry(line: Column) -> Column:
    """struct(title, page, level) of a line of contents; null where it is none."""
    c = normalize_spaces(line)
    page = F.nullif(F.regexp_extract(c, f"(\\p{{Nd}}{{1,4}})[{WS}]*$", 1), F.lit("")).cast("int")
    title = sub(c, f"\\p{{Nd}}{{1,4}}[{WS}]*$")
    title = normalize_spaces(sub(title, r"\.{5,}", " "))
    return F.when((F.length(title) > 0) & is_toc_title(title), F.struct(title.alias("title"), page.alias("page"), toc_level(title).alias("level")))


def is_useful(normal: Column) -> Column:
    return ((F.length(normal) >= 2) & normal.rlike(r"^\p{Nd}+$")) | (F.length(normal) >= 3)


def strategy(score: Column) -> Column:
    return F.when(score > 0.7, "text").when(score > 0.3, "hybrid").otherwise("facsimile")


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area that two rectangles share over the area that either has; 0 where they part."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = w * h
    either = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when((w <= 0) | (h <= 0) | (either <= 0), F.lit(0.0)).otherwise(both / either)


