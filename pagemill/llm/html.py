"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The first pass decides blocks by where they stand
(menus, headers, footers, sidebars, notices, adverts, forms, comments), link density, length and
stop-word density. Short or doubtful blocks stay undecided; in the second pass they inherit the
label of the nearest decided neighbours of their section.

Where a page names no article, all of it that no menu, header and the like holds is one section. In a language whose
stop words are not known (none of them occur) length and link density decide alone. Inside an article only a closed
list of whole class and id words and of roles sets a part aside.

Defined results: null or empty html has empty text; markup that is broken or cut off is read as far
as it goes; repeated rows each give a row; null page_id and url are kept; other columns are ignored; an empty
table gives an empty table; pages of any length are read whole, in one pass.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import by_row, pick

#: Characters below which a block is short; share of a block's characters in links from which it is a
#: list of links; shares of stop words from which a block is text, and may be.
SHORT, LINKS, TEXT, MAYBE = 70, 0.5, 0.30, 0.12

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
OUTSIDE = frozenset("head nav header footer aside form menu button select dialog iframe object svg canvas audio video map".split())
ARTICLE = frozenset("article main".split())
#: Words in class, id and role that name parts which are not the article's.
NAMES = re.compile(r"(?:^|[\s_\-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|contentinfo|cookies?|copyright|disqus|footer|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notice|pagination|paywall|popup|promo\w*|recommend\w*|related|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|complementary)(?:$|[\s_\-])", re.I)
#: Inside an article: whole words of class and id, and roles, that set a part aside.
INSIDE = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments comment-list comments-area cookie-banner disqus disqus_thread newsletter pagination paywall popup promo related related-posts respond share share-buttons sharing sidebar social sponsored subscribe widget".split())
ROLES = frozenset("navigation banner complementary contentinfo form search dialog alertdialog menu menubar toolbar".split())
#: Share of stop words from which a page's language is a known one.
KNOWN = 0.03
#: Of these, parts that hold articles of their own, such as a reader's comment or a card.
LISTS = re.compile(r"(?:^|[\s_\-])(?:ads?|advert\w*|comments?|disqus|footer|nav\w*|promo\w*|recommend\w*|related|respond|sidebar|sponsor\w*)(?:$|[\s_\-])", re.I)
#: Classes that tell of a wrapper's state or layout, or are a framework's, name no part.
STATE = re.compile(r"(?:^|[_\-])(?:has|have|with|without|no|not|is)[_\-]|^(?:elementor|e-con|wp-block|wpb|vc|et_pb|fl|uk|js|ast|ct)[_\-]", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-z/!][^>]*\Z""",
    re.I | re.S,
)
RIGHTS = re.compile("©|\\bcopyright\\b|all rights reserved", re.I)
LETTERS = re.compile(r"[^\W\d_]+")

#: Common function words of English, German, French and Spanish.
STOP = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or our she so that the their there they this to was we were what when which who will with you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir zu zum zur "
    "à au aux avec ce ces comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous y "
    "al con como cuando de del desde el ella en entre era es esta este fue ha han hasta hay la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya yo".split()
)


def attributes(source: str) -> dict[str, str]:
    """Attributes by name in lower case; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), a or b or c)
    return found


def hidden(attrs: dict[str, str]) -> bool:
    return attrs.get("hidden", "false").lower() != "false" or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(HIDDEN.search(attrs.get("style", "")))


def labels(attrs: dict[str, str]) -> str:
    """What names an element: classes and ids that tell of no state, role and aria-label."""
    named = [x for k in ("class", "id") for x in attrs.get(k, "").split() if not STATE.search(x)]
    return " ".join([*named, *(attrs[k] for k in ("role", "aria-label") if k in attrs)])


def inside(attrs: dict[str, str]) -> bool:
    """Whether an element in an article is set aside."""
    return not INSIDE.isdisjoint(x.lower() for k in ("class", "id") for x in attrs.get(k, "").split()) or not ROLES.isdisjoint(attrs.get("role", "").lower().split())


@dataclass
class Block:
    text: str
    outside: bool
    section: int
    article: bool
    links: int = 0
    heading: bool = False
    label: str = ""
    #: The page names no article.
    assumed: bool = False
    stops: tuple[int, int] | None = None


def blocks(source: str) -> list[Block]:
    """Blocks of a page in order, white space folded, character references decoded."""
    out: list[Block] = []
    # open elements: name, outside, section of the article or 0, numbers of those around it that NAMES sets aside
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []
    lists: list[bool] = []  # of each that NAMES sets aside: whether it is one of LISTS
    held: list[tuple[int, ...]] = []  # what is around each article
    marks: list[tuple[int, ...]] = []  # what is around each block
    parts: list[str] = []
    links, anchors, sections, heading = 0, 0, 0, False

    def state() -> tuple[bool, int, tuple[int, ...]]:
        return stack[-1][1:] if stack else (False, 0, ())

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                outside, section, around = state()
                marks.append(around)
                out.append(Block(text, outside, section, section > 0, links, heading))
        parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        parts.append(raw)
        if anchors:
            links += len(entities.unescape(raw).strip())

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        ending, attrs = bool(m[2] or m[5]), m[4] or m[7] or ""
        if name in BLOCKS or name in OUTSIDE:
            close()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            anchors = 0 if ending else 1
        if name in VOID or attrs.endswith("/"):
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name == "body":
                stack = [x for x in stack if x[0] == "html"]
            if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()
            outside, section, around = state()
            if name in ARTICLE:
                held.append(around)
                if not section:
                    sections += 1
                    section = sections
            has = attributes(attrs) if attrs else {}
            named = labels(has) if has and name not in ("html", "body", "article", "main") else ""
            # an article's own header has its title
            outside = outside or name in OUTSIDE and not (section and name == "header") or hidden(has)
            if section and has and name not in ARTICLE:
                outside = outside or inside(has)
            aside = bool(named and not section and NAMES.search(named))
            if aside:
                around = (*around, len(lists))
                lists.append(bool(LISTS.search(named)))
            if name in BLOCKS or outside or around or name in ARTICLE:
                stack.append((name, outside, section, around))
        heading = name[:1] == "h" and name[1:].isdigit() and not ending if name in BLOCKS else heading
    if at < len(source):
        add(source[at:])
    close()
    # a name says nothing where the article is inside; lists of articles stay aside if another is outside
    void = {k for x in held for k in x if not lists[k]} | set(min(held, key=len, default=()))
    for b, around in zip(out, marks):
        b.outside = b.outside or not void.issuperset(around)
    return out


def stop_share(b: Block) -> tuple[int, int]:
    """Stop words and words of a block, counted once."""
    if b.stops is None:
        words = LETTERS.findall(b.text.lower())
        b.stops = sum(map(STOP.__contains__, words)), len(words)
    return b.stops


def first_pass(b: Block, known: bool) -> str:
    """good, bad or empty for undecided; known: the page's language has stop words here."""
    if b.outside or (b.assumed or not b.article) and RIGHTS.search(b.text) and len(b.text) < 4 * SHORT:
        return "bad"
    if b.links > LINKS * len(b.text):
        return "bad"
    if len(b.text) < SHORT or b.heading:
        return ""
    if not known:
        return "good"
    n, m = stop_share(b)
    density = n / m if m else 0.0
    if density >= TEXT or b.article and density >= MAYBE:
        return "good"
    return "" if b.article or density >= MAYBE else "bad"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided neighbours of their section: of two
    as near that differ, and where there is none, what the section is (an article or not) decides."""
    n = len(found)
    first = [b.label for b in found]
    for step, label in ((1, [None] * n), (-1, [None] * n)):
        last: dict[int, int] = {}
        for k in range(n) if step > 0 else range(n - 1, -1, -1):
            label[k] = last.get(found[k].section)
            # in an article, parts set aside as menus, adverts and the like say nothing on its text
            if first[k] and not (found[k].article and found[k].outside):
                last[found[k].section] = k
        if step > 0:
            before = label
        else:
            after = label
    for k, b in enumerate(found):
        if b.label:
            continue
        i, j = before[k], after[k]
        near = [x for x in (i, j) if x is not None]
        kinds = {first[x] for x in near}
        if len(kinds) == 1:
            b.label = kinds.pop()
        elif len(near) == 2 and k - i != j - k:
            b.label = first[i] if k - i < j - k else first[j]
        else:
            b.label = "good" if b.article else "bad"


def labelled(source: str | None) -> list[Block]:
    """The blocks of a page, all labelled good or bad."""
    found = blocks(source or "")
    if not any(b.article for b in found):
        for b in found:
            b.article = b.assumed = not b.outside
    n, m = map(sum, zip(*(stop_share(b) for b in found if not b.outside))) if any(not b.outside for b in found) else (0, 0)
    for b in found:
        b.label = first_pass(b, n >= KNOWN * m and n > 0)
    second_pass(found)
    return found


def main_text(source: str | None) -> str:
    return " ".join(b.text for b in labelled(source) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the columns of op9."""

    def make():
        def one(page_id, url, source):
            text = main_text(source)
            yield page_id, url, text, len(text)

        return one

    return by_row(pick(pages, page_id="long", url="string", html="string"), make, "page_id long, url string, text string, n_chars long")
