"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path and each is paired with the neighbour whose path shares the longest
beginning. The two pages' text lines are aligned by their longest common subsequence; lines in it belong to
the site, not to the page, and are deleted.

Differencing alone can't tell a menu that differs from page to page, nor a paragraph that two articles
rightly share, so the page's own structure has the last word: lines inside the article's element stay
even if shared, lines of menus, footers and the like go even if not, and in pages that are copies of each
other nothing is deleted for being shared.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ordered_parts

#: Elements by their part in a page.
ARTICLE = frozenset({"article", "main"})
SITE = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "iframe", "svg", "head", "noscript", "object"})
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li "
    "main menu nav noscript object ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SITE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination popup promo promoted related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
SITE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/><]*))")
_STOP = re.compile(r"""[>"']""")
_RAW = {name: re.compile(f"</{name}", re.I) for name in ("script", "style", "template")}
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INSIDE, _SITE, _OUTSIDE = 1, 2, 0


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of the markup; comments, scripts and the like have no name.

    Time is linear in the page's length, whatever it holds: a quoted value may contain ``>``, but after a tag whose
    quotes don't close, the rest of the page's tags end at their first ``>``."""
    at, last, quotes = 0, html.rfind(">"), True
    while (m := _OPEN.search(html, at)) and (m.start() < last or m[1]):
        name, start, inside = (m[3] or "").lower(), m.start(), m.end()
        if m[1]:
            end = html.find("-->", inside)
            at = len(html) if end < 0 else end + 3
            inside = at
        elif name in _RAW and not m[2]:
            end = _RAW[name].search(html, inside)
            close = html.find(">", end.end()) if end else -1
            at = len(html) if close < 0 else close + 1
            name = ""
        else:
            end = _end(html, inside) if quotes and name else html.find(">", inside)
            if end < 0:
                quotes, end = False, html.find(">", inside)
            at = end + 1
        yield start, at, name, m[2] == "/", html[inside : at - 1] if name else ""


def _end(html: str, at: int) -> int:
    """Where the tag's ``>`` is, outside quotes; -1 without one."""
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        close = html.find(m[0], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def lines(html: str | None) -> list[tuple[int, str]]:
    """(region, text) of each text block in page order. Region 1: inside an article, 2: a part of the site, 0: neither.

    Unclosed elements end with the page, stray end tags are ignored, a block start ends an open paragraph.
    Character references are decoded after markup is gone; white space becomes one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    pending: list[str] = []
    at, html = 0, html or ""

    def flush() -> None:
        text = " ".join(unescape("".join(pending)).split())
        pending.clear()
        if text:
            out.append((stack[-1][1] if stack else _OUTSIDE, text))

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for start, stop, tag, end, attributes in tags(html):
        if start > at:
            pending.append(html[at:start])
        at = stop
        if not tag:
            continue
        block = tag in BLOCKS
        marked = _region(tag, attributes) if not end else None
        if block or marked:
            flush()
        if end:
            if opened[tag]:
                flush()
                while close() != tag:
                    pass
        elif tag not in VOID and (block or marked):
            if block and stack and stack[-1][0] == "p":
                close()
            above = stack[-1][1] if stack else _OUTSIDE
            region = _SITE if above == _SITE else marked if marked is not None else above
            if tag == "header":  # an article's own heading is part of it
                region = above if above == _INSIDE and marked != _SITE else _SITE
            stack.append((tag, region))
            opened[tag] += 1
    rest = html[at:]
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    pending.append(rest[: cut.start()] if cut else rest)  # not a tag that the page's end cuts off
    flush()
    return out


def _region(tag: str, attributes: str) -> int | None:
    if tag in SITE:
        return _SITE
    if attributes.strip():
        for m in _ATTR.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if value in SITE_ROLES:
                    return _SITE
                if value in ("main", "article"):
                    return _INSIDE
            elif tag not in ("body", "html") and not SITE_NAMES.isdisjoint(re.split(r"[^a-z]+", value)):
                return _SITE
    return _INSIDE if tag in ARTICLE else None


def common(a: list, b: list) -> list[bool]:
    """Which items of ``a`` are in its longest common subsequence with ``b``.

    Equal ends and items that one side lacks are set aside first; the rest is aligned with one bit row an
    item (a row has a bit for each remaining item of ``b``)."""
    mark = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        mark[lo] = True
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        mark[hi_a] = True
    both = set(a[lo:hi_a]) & set(b[lo:hi_b])
    at = [i for i in range(lo, hi_a) if a[i] in both]
    other = [x for x in b[lo:hi_b] if x in both]
    where: dict = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, [full]
    for i in at:
        u = row & where[a[i]]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    size = lambda k, j: (~rows[k] & ((1 << j) - 1)).bit_count()  # noqa: E731  length for the first k and j
    k, j = len(at), len(other)
    while k and j:
        if a[at[k - 1]] == other[j - 1]:
            mark[at[k - 1]] = True
            k, j = k - 1, j - 1
        elif size(k - 1, j) >= size(k, j - 1):
            k -= 1
        else:
            j -= 1
    return mark


def main_text(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> tuple[str, int]:
    """(the page's own lines, how many lines were deleted for being shared), given its nearest page's lines (None: it has none).

    Lines of an article stay and lines of the site go. Other lines stay on a page without an article if the
    neighbour doesn't share them; where it shares all of them the pages are copies and they stay too."""
    shared = common(page, neighbour) if neighbour else [False] * len(page)
    has_article = any(r == _INSIDE for r, _ in page)
    copies = all(s for (r, _), s in zip(page, shared, strict=True) if r == _OUTSIDE)
    own = [r == _INSIDE or r == _OUTSIDE and not has_article and (copies or not s) for (r, _), s in zip(page, shared, strict=True)]
    deleted = 0 if has_article else sum(r == _OUTSIDE and not k for (r, _), k in zip(page, own, strict=True))
    return "\n".join(t for (_, t), k in zip(page, own, strict=True) if k), deleted


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_shared: lines deleted for being shared) of every page. Null html is empty, null URLs share one host that has no name.

    Pages are dealt by ranges of host, path and id, so that a host of any size is spread over tasks, and
    each range comes with its neighbours' edge pages. Rows that agree in id and URL are told apart by
    a hash of the html. A page alone on its host has no pair and keeps all lines its structure allows."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"), F.xxhash64(url_col, html_col).alias("h"))
    dealt, _ = ordered_parts(keyed, ["host", "path", "id", "h"], ["url", "html"], before=1, after=1)
    kind = pages.schema[id_col].dataType.simpleString()

    def near(a: str, b: str) -> int:
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None  # (part, host, path, halo, id, url, lines)

        def done(x, left, right):
            pairs = [(near(x[2], y[2]), k, y) for k, y in ((1, left), (0, right)) if y and y[:2] == x[:2]]
            return x[4], x[5], *main_text(x[6], max(pairs, key=lambda p: p[:2])[2][6] if pairs else None)

        for b in batches:
            out = []
            for part, where, p, halo, key, link, html in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                after = (part, where, p, halo, key, link, lines(html))
                if now and not now[3]:
                    out.append(done(now, before, after))
                before, now = now, after
            yield _batch(out, b.column(4).type)
        if now and not now[3]:
            yield _batch([done(now, before, None)], kinds_of[0])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds_of = [to_arrow_type(pages.schema[id_col].dataType)]
    return dealt.select("part", "host", "path", "halo", "id", "url", "html").mapInArrow(run, f"id {kind}, url string, text string, n_shared long")


def _batch(out: list[tuple], kind) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.string(), pa.string(), pa.int64()), strict=True)], ["id", "url", "text", "n_shared"])


def op6_html_extraction(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars; and n_shared."""
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
