"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines (one per block of text; regions that are never article text, such as navigation, scripts
or adverts, leave a gap: one empty line within a container, else ``width``). Over windows of ``width`` lines the text lengths are summed: a stretch surges
where the sum rises from zero and dives where it falls back to zero. Stretches whose highest sum reaches the surge height,
or else the highest one, hold the text, and with them the stretches beside them where only something left out lies
between. At the ends of what is taken, lines that are short and no prose (outside of paragraphs, headings, list items and
the like) go, up to the first and last line that is. Lines in article and main elements count double and are prose; they
compete with all others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import read, ship

WIDTH, SURGE, ROOT_WEIGHT = 3, 80, 2
SCHEMA = "page_id long, url string, text string, n_chars long"

_BREAKS_OUT = "article|blockquote|body|br|center|div|dl|h[1-6]|head|hr|img|li|main|ol|p|pre|section|span|table|ul"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>"
    # code runs to the end of the page if it isn't closed; of others only the tag is left out then
    r"|<(?P<raw>script|style)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<other>noscript|template|textarea|iframe|object|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?</(?P=other)\s*>"
    # in svg and math, a tag of html means that they weren't closed
    rf"|<(?P<foreign>svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(?:[^<]|<(?!(?:{_BREAKS_OUT})[\s/>]))*?</(?P=foreign)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu"
    " meta nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav footer aside form button select menu dialog head fieldset search".split())
_ROOTS = frozenset(("article", "main"))
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption caption td th".split())
_CONTAINERS = frozenset("article div main section table td body".split())
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_NAMED = ("class", "id", "role", "data-role")
_CHROME_WORD = (
    r"(?:ads?|adverts?|advertis\w*|adsense|adbox|sponsor\w*|promos?|promoted|promotions?|promotional|promobox|banner|cookies?|consent|gdpr|notices?|alerts?|disclaimer|sidebars?|side|rail|widgets?|navs?|navbar|navlinks?|navmenu|navigation|menus?"
    r"|topbar|toolbar|breadcrumbs?|crumbs?|pagination|pager|comments?|commentlist|respond|replies|reply|disqus|related|recommend\w*|share|sharing|social|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|footer|masthead"
    r"|(?:site|page)[_-]+header|search|contentinfo|complementary|skip[_-]+link|paywall|tags?)"
)
#: A whole name: chrome words, with words around them at most that say where or what kind of box it is.
_CHROME_NAME = re.compile(
    rf"(?:(?:site|page|main|top|bottom|global|mobile|primary|secondary)[_-]+)*{_CHROME_WORD}(?:[_-]+{_CHROME_WORD})*(?:[_-]+(?:container|wrapper|wrap|box|area|bar|list|items?|links?|buttons?|icons?|block|section|inner|unit|slot|panel|form|posts?|articles?|body|\d+))*",
    re.I,
)
_COMMENT_NAME = re.compile(r"(?:div-)?(?:comments?|reply|replies)(?:[_-]+(?:body|content|entry|item|\d+))*", re.I)
_SPACE = re.compile(r"\s+")


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _is_hidden(found: dict[str, str]) -> bool:
    if found.get("hidden", "false").lower() != "false" or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    for declaration in found.get("style", "").lower().split(";"):
        name, _, value = declaration.partition(":")
        if (name.strip(), value.replace("!important", "").strip()) in (("display", "none"), ("visibility", "hidden")):
            return True
    return False


def _is_chrome(tag: str, attrs: str, in_root: bool) -> bool:
    if tag in _CHROME or (tag == "header" and not in_root):
        return True
    if not attrs or tag in ("main", "html", "body"):
        return False
    found = _attributes(attrs)
    names = [x for k in _NAMED for x in found.get(k, "").split()]
    if tag == "article":  # its other names say what it is about
        return any(_COMMENT_NAME.fullmatch(x) for x in names)
    label = found.get("aria-label", "").strip()
    return any(_CHROME_NAME.fullmatch(x) for x in names) or bool(_CHROME_NAME.fullmatch(label)) or _is_hidden(found)


def strip_markup(page: str, width: int = WIDTH) -> tuple[list[str], list[bool | None], list[bool]]:
    """Lines of text (empty for gaps), and for each whether it lies in an article or main element (None at their edges) and whether it is prose."""
    lines: list[str] = []
    roots: list[bool | None] = []
    prose: list[bool] = []
    block = ""
    parts: list[str] = []
    skip, nested, depth = "", 0, 0
    containers, number, last, pending = [0], 0, 0, False

    def empty(n: int, root: bool | None = False) -> None:
        lines.extend([""] * n)
        roots.extend([root] * n)
        prose.extend([False] * n)

    def close() -> None:
        nonlocal last, pending
        if parts:
            line = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if line:
                if pending:  # within one container, something left out is no end of the stretch
                    empty(1 if last == containers[-1] else width)
                lines.append(line)
                roots.append(depth > 0)
                prose.append(depth > 0 or block in _PROSE)
                last, pending = containers[-1], False

    def gap() -> None:
        nonlocal pending
        close()
        pending = True

    for m in _TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            if not skip:
                parts.append(text)
            continue
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        attrs = m.group("attrs")
        closing = bool(m.group("end"))
        if skip:
            if tag == skip:
                if closing:
                    nested -= 1
                elif not attrs.endswith("/"):
                    nested += 1
                if nested == 0:
                    skip = ""
                    gap()
                continue
            if not (tag in _ROOTS and not closing and not depth and not _is_chrome(tag, attrs, False)) and not (skip == "head" and tag == "body"):
                continue
            skip, nested = "", 0  # an element that was never closed ends where the article begins
            gap()
        if not closing and tag not in _VOID and not attrs.endswith("/") and _is_chrome(tag, attrs, depth > 0):
            gap()
            skip, nested = tag, 1
            continue
        if tag in _ROOTS:
            close()
            empty(width, None)
            depth = max(0, depth - 1) if closing else depth + 1
        if tag in _BLOCKS:
            close()
            if tag != "br":
                block = "" if closing else tag
        if tag in _CONTAINERS:
            if not closing:
                number += 1
                containers.append(number)
            elif len(containers) > 1:
                containers.pop()
    close()
    return lines, roots, prose


def stretches(lengths: list[int], width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(surge, dive, highest window sum) of the stretches between runs of ``width`` or more empty lines."""
    out: list[tuple[int, int, int]] = []
    start, last, window = -1, -1, [0] * width
    total = peak = 0
    for k, n in enumerate(lengths):
        total += n - window[k % width]
        window[k % width] = n
        if n:
            if start < 0:
                start, peak = k, 0
            last = k
        if start >= 0:
            peak = max(peak, total)
            if total == 0:
                out.append((start, last + 1, peak))
                start = -1
    if start >= 0:
        out.append((start, last + 1, peak))
    return out


def main_text(page: str | None, width: int = WIDTH, surge: int = SURGE) -> str:
    """The article's blocks, one per line; empty for null, for an empty page and for one without text.

    The stretches of the whole page compete; a character in an article or main element counts ROOT_WEIGHT times.
    """
    if not page:
        return ""
    lines, roots, prose = strip_markup(page, width)
    found = stretches([len(x) * (ROOT_WEIGHT if r else 1) for x, r in zip(lines, roots, strict=True)], width)
    if not found:
        return ""
    least = min(surge, max(s[2] for s in found))
    first = next(k for k, s in enumerate(found) if s[2] >= least)
    tall = [s[2] >= surge or k == first for k, s in enumerate(found)]
    joined = [None not in roots[a[1] : b[0]] for a, b in zip(found, found[1:], strict=False)]
    taken = [t or (k > 0 and tall[k - 1] and joined[k - 1]) or (k < len(joined) and tall[k + 1] and joined[k]) for k, t in enumerate(tall)]
    held = [k for (a, b, _), t in zip(found, taken, strict=True) if t for k in range(a, b) if lines[k]]
    firm = [i for i, k in enumerate(held) if prose[k] or len(lines[k]) >= surge]
    return "\n".join(lines[k] for k in (held[firm[0] : firm[-1] + 1] if firm else held))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            rows = batch.slice(first, 512)
            texts = [main_text(x.as_py()) for x in rows.column(2)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html), from the whole html.

    A null or empty html gives an empty text; equal rows give equal results; other columns are ignored. Rows are handled
    one by one in their own partition, so nothing is shuffled.
    """
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html")).mapInArrow(_extract, SCHEMA)


def op5_line_blocks(spark, sf_dir):
    return extract_main_text(read(spark, sf_dir, "pages"))


#: Plain: the article element's blocks. It holds for pages with one article and the character references below.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|br|div)[^>]*>') AS blocks FROM pages),
t AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
j AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '') AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM j
"""
