"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a about all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    more no not of on one or our she so some than that the their them then there these they this to up was we were what when
    which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist
    kann man mit nach nicht noch nur oder sich sie sind so über um und von vor war was wenn wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu
    que qui sa se ses son sont sur un une vous
    al como con cuando de del desde el ella en entre era es esta este están fue ha hay la las lo los me más muy ni no nos o para
    pero por porque que se ser si sin sobre son su sus también un una uno y ya
    """.split()
)
# Elements whose content is never shown as text.
HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas audio video select option textarea title head datalist".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
# Elements that hold something other than the article.
ASIDE = frozenset("nav footer aside form button menu dialog header".split())
# Elements that begin and end a block.
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table
    tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of class, id and role values that mark menus, adverts, notices, comments and the like.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|side-bar|aside|widget|menu|nav|navbar|navigation|breadcrumbs?|"
    r"masthead|comments?|commentlist|disqus|cookies?|consent|gdpr|notice|notification|popup|modal|share|sharing|social|related|"
    r"recommended|newsletter|subscribe|subscription|signup|login|pagination|pager|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
# Parts that mark such things outside an article, but are as often a section or topic of the article inside it.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:banner|header|footer|foot|copyright|legal|disclaimer|respond|replies|alert|overlay|search|tags?|toolbar|hidden)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][\w:-]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.S)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")

#: A block of at least LONG characters is decided by its words; a shorter one inherits.
LONG, LINKS, STOPS = 70, 0.33, 0.15
#: What the place of a block changes of the share of stop words that it needs: in an article less, after a hint more.
IN_ARTICLE, HINTED = -0.05, 0.1


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    outside: bool  # in an element that never holds the article's text
    article: bool
    hinted: bool = False
    label: bool | None = field(default=None)
    rule: str = ""  # what decided: container, links, words, neighbour or place


def _attributes(text: str) -> dict[str, str]:
    """Names, in lower case, and values; of names that repeat the first counts."""
    out: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), next(filter(None, value), ""))
    return out


def _container(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element holds something other than the article, and whether it is only hinted at."""
    if name in ASIDE and not (name == "header" and in_article):
        return True, False
    if name in ("body", "html", "main", "h1") or not attributes:
        return False, False
    own = _attributes(attributes)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(own.get("style", "")):
        return True, False
    values = " ".join(own.get(k, "") for k in ("class", "id", "role"))
    hint = bool(HINTS.search(values))
    return bool(MARKS.search(values)) or (hint and not in_article), hint and in_article


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order, with what the rules look at."""
    out: list[Block] = []
    parts: list[str] = []
    linked = [0]
    stack: list[tuple[str, bool, bool, bool]] = []  # name, outside, article, hinted
    state = {"a": False, "h": False}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked[0], state["h"], *(stack[-1][1:] if stack else (False, False, False))))
            parts.clear()
        linked[0] = 0

    def shown(text: str) -> None:
        if text:
            text = html.unescape(text)
            parts.append(text)
            if state["a"]:
                linked[0] += len(" ".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            shown(page[at:])
            break
        shown(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, close, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in RAW and not close:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "a":
            state["a"] = not close
            continue
        if name == "br":
            parts.append(" ")
            continue
        inline = name not in BLOCK and name not in HIDDEN
        if inline and not close and (name in VOID or not (attributes and _container(name, attributes, bool(stack and stack[-1][2]))[0])):
            if name in ("td", "th"):
                parts.append(" ")
            continue
        if close:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCK or where is not None:
                flush()
            if where is not None:
                del stack[where:]
            if name in BLOCK:
                state["h"] = False
            continue
        flush()
        state["h"] = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in BLOCK:
            state["a"] = False
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "p":
            while stack and stack[-1][0] == "p":
                stack.pop()
        top = stack[-1] if stack else ("", False, False, False)
        other, hint = _container(name, attributes, top[2])
        outside = top[1] or name in HIDDEN or other
        stack.append((name, outside, (top[2] or name in ("article", "main")) and not outside, top[3] or hint))
    flush()
    return out


def _first(b: Block, marked: bool) -> tuple[bool | None, str]:
    """What a block is by itself: main text, something else, or undecided."""
    if b.outside:
        return False, "container"
    if b.linked > LINKS * len(b.text):
        return False, "links"
    elsewhere = marked and not b.article
    if len(b.text) < (2 * LONG if elsewhere else LONG):
        return (False, "place") if elsewhere else (None, "")
    words = _WORD.findall(b.text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    need = 2 * STOPS if elsewhere else STOPS + IN_ARTICLE * b.article + HINTED * b.hinted
    if share >= need:
        return True, "words"
    return (None, "") if b.article else (False, "words")


def classify(found: list[Block]) -> None:
    """Set every block's label (True for the main text) and the rule that gave it.

    First pass: a block in a menu, footer, form, advert or the like is not main text, nor is one mostly of
    links.  A block of LONG characters and more is main text if enough of its words are stop words, and
    not otherwise; in an article fewer are enough and what has too few is undecided (a table, code, names,
    another language), and where the page marks an article, a block outside it needs twice the length and
    the share.  Short blocks are undecided.  Second pass: undecided blocks take the label of the nearest
    decided block before or after, of the same section (in the article or not); if both are as near and
    differ, a heading goes with what follows, any other block with what precedes.  With no decided block in
    its section, a block is main text if that is the article.
    """
    marked = any(b.article and not b.outside for b in found)
    for b in found:
        b.label, b.rule = _first(b, marked)
    decided = [i for i, b in enumerate(found) if b.label is not None and not (marked and not b.article)]
    before: list[int | None] = []
    k = 0
    for i in range(len(found)):
        while k < len(decided) and decided[k] <= i:
            k += 1
        before.append(k - 1)
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        p = decided[before[i]] if before[i] >= 0 else None
        q = decided[before[i] + 1] if before[i] + 1 < len(decided) else None
        if p is None and q is None:
            b.label, b.rule = b.article, "place"
            continue
        if p is None or q is None:
            which = q if p is None else p
        elif q - i == i - p:
            which = q if b.heading else p
        else:
            which = q if q - i < i - p else p
        b.label, b.rule = labels[which], "neighbour"


def main_text(page: str | None) -> str:
    """The blocks of main text, joined by line feeds; empty for null, empty or text-free pages."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages; one narrow pass, no shuffle.

    Null html counts as empty and gives an empty text; the whole html is read, however long.  Rows that
    repeat are read each by itself, null ids and urls stay null, and an empty table gives one.  Other
    columns are ignored, whatever their names.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
