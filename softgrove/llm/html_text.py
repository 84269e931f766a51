"""Main text of web pages by line-block distribution.

1. Markup is stripped into lines: block elements and line breaks end a line;
   comments, scripts, styles, heads, forms, navigation, headers, footers,
   sidebars, and elements whose class, id or role names them as adverts,
   notices, menus or reader comments are left out. A name does so by its last
   word that isn't a word for a box ("post-comments", "ad-box", but neither
   "no-comments" nor "related-work"). Names decide nothing for article, main
   and headings, nor (but for adverts) for an element with headings and more
   than half of the page's text, nor where no other text is left; one of
   reader comments is left out all the same where the rest of the page has a
   surge. On a page that clearly marks its article (one article or main with
   text of its own, or one with a surge), names decide for all elements outside
   it, and inside as long as text other than headings is left.
2. The text lengths (without link texts) of ``WINDOW`` lines from each line
   on are summed, over lines with text only.
3. A dive is a window of lines of links only (but not one between two lines of
   text in the same container), or a part left out between two
   lines that have no element within the body in common (an advert is none).
   The lines between two dives are a block, kept whole if a surge lies in it:
   a line at which such a sum reaches the threshold. Short blocks between two
   kept ones, and headings right before one, are kept too unless links part
   them.
4. On a page that marks its article (article or main) the edges of the mark
   are dives too. If the largest block lies inside (ties do), the mark is a
   bound: only lines inside are dealt with as above, their links count as text
   and short text between two marked parts is no dive. If it lies outside, the
   mark is that of teasers or the like, and the sums alone decide.

The threshold is ``SURGE`` characters, or half of the page's largest sum if
that is less, so a page of a few words still has a surge.

Lines: character references are decoded, white space becomes one space, both
ends are trimmed; lines are joined by one line feed in page order. A header
inside an article (its title) is part of it; so is a form's text only where
the form wraps the article.

Edge cases: a NULL or empty page, or one without text, gives an empty text.
An element that is never closed ends where an outer one ends or an article
begins. Repeated rows give repeated rows; an empty table gives an empty
result; other columns are passed by. The work is a plain map over the pages.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from softgrove.llm.common import add_fields, steps

WINDOW = 3
SURGE = 80

# Elements of HTML.
#: Their content is never text of the page.
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|datalist|video|audio|canvas"
#: Parts of a page that aren't its article.
ASIDE = frozenset("nav header footer aside form menu dialog button head fieldset".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that begin and end a line.
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names decide nothing: ids of headings are made of their words.
UNNAMED = ARTICLE | HEADINGS | frozenset(("html", "body"))
#: Elements that lines of all parts of a page have in common.
PAGE = frozenset(("html", "body"))
#: Elements that make a line or a list of lines, not a container of text.
FLOW = HEADINGS | frozenset("""address blockquote br caption dd details dl dt figcaption figure hgroup hr legend li ol optgroup option p pre
summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose next one ends them.
SELF_ENDING = frozenset("p li tr td th dt dd option".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role names that mark a part that isn't the article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments
commentlist consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr header login masthead menu modal
nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promotion promoted
recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
taboola toolbar widget alert complementary""".split())

#: Those of adverts, which stand within the text they interrupt.
ADVERTS = frozenset("""ad ads advert adverts advertisement advertising advertorial outbrain promo promoted promotion sponsor
sponsored taboola""".split())

#: Those of reader comments, which may be longer than the text.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: First words of names that tell of a part elsewhere, or of a state.
STATES = frozenset("has no not non with without hide show is before after above below".split())
#: Words for boxes and their places, behind which a name's word stands.
BOXES = frozenset("""area articles bar block body bottom box btn button buttons card col column container content details fixed form
frame group header heading holder icon icons iframe inner item items label left link links list main media message panel placeholder
popover posts primary region right row secondary section slot space stories text thread title top unit wrap wrapper zone""".split())
#: Words before "header" where it is the text's own.
OWN_HEADERS = frozenset("article content entry post section story".split())

# attribute values with "<" are rare; a tag with one ends at its first ">"
_ATTRS = r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>{_ATTRS}(?=>)|[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)", re.IGNORECASE | re.DOTALL)
_CLOSED = re.compile(rf"</(?:{RAW})\s*>\Z", re.IGNORECASE)
_OPENED = re.compile(r"<(?:!--|[!?/])")
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])(?:hidden(?:$|[\s=/])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _mark(name: str) -> str | None:
    """The word of a name that marks a part that isn't the article."""
    words = [w for w in (p.lower() for p in _PARTS.findall(name)) if len(w) > 1]
    if not words or words[0] in STATES:
        return None
    while len(words) > 1 and (words[-1] in BOXES and words[-1] not in MARKS or words[-1] == "header" and not MARKS.isdisjoint(words[:-1])):
        words.pop()
    if words[-1] == "header" and not OWN_HEADERS.isdisjoint(words[:-1]):
        return None
    return words[-1] if words[-1] in MARKS else None


def _marks(attrs: str) -> set[str]:
    """Marking words of class, id and role names."""
    found = {_mark(n) for m in _NAMES.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").split()}
    return {w for w in found if w}


class Line(NamedTuple):
    """A line with text."""

    text: str
    #: Length without links.
    own: int
    inside: bool
    heading: bool
    #: Whether a part was left out between the line before and this one, and
    #: whether the two are in one element within the body.
    gap: bool
    shared: bool
    #: The innermost part by name it lies in.
    part: int
    #: Number of the outermost article or main around it, 0 if there is none.
    article: int
    #: Number of the innermost container within the body, 0 if there is none.
    box: int


class Part(NamedTuple):
    """An element that its names mark."""

    marks: set[str]
    #: The part around it, -1 if there is none.
    outer: int


def lines(html: str) -> tuple[list[Line], list[Part]]:
    """The lines of a page that have text, and the parts that names mark."""
    out: list[Line] = []
    named: list[Part] = []
    parts: list[str] = []
    linked = articles = links = headings = 0
    article = 0
    # open containers, and how many there were
    boxes, n_boxes = [0], 0
    # open elements: name, whether it is left out, whether it is a block within the body, part around it if it is one
    stack: list[tuple[str, bool, bool, int | None]] = []
    is_open: Counter[str] = Counter()
    left_out = 0
    part = -1
    # blocks open now, and those open ever since the last line
    level = common = 0
    gap = False
    # no tag begins after the last ">"
    body = html.rfind(">") + 1

    def close_line() -> None:
        nonlocal linked, common, gap
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append(Line(text, max(0, len(text) - linked), articles > 0, headings > 0, gap, common > 0, part,
                            article if articles else 0, boxes[-1]))
            common, gap = level, False
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal left_out, articles, links, headings, level, common, part
        name, aside, block, outer = stack.pop()
        part = part if outer is None else outer
        is_open[name] -= 1
        left_out -= aside
        articles -= name in ARTICLE
        links -= name == "a"
        headings -= name in HEADINGS
        level -= block
        if block and name not in FLOW:
            boxes.pop()
        common = min(common, level)

    at, begun, raw = 0, -1, None
    for m in _TOKEN.finditer(html, 0, body):
        if not left_out and m.start() > at:
            parts.append(html[at:m.start()])
            if links:
                linked += len(_SPACE.sub(" ", unescape(parts[-1])))
        at, begun, raw = m.end(), m.start(), m["raw"]
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        marks = _marks(m["attrs"]) if m["attrs"] and not left_out and not m["end"] and tag not in UNNAMED else None
        if tag in BLOCK and not left_out:
            close_line()
        if m["end"]:
            if is_open[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in ARTICLE and (left_out or part >= 0 and not articles) and not _HIDDEN.search(m["attrs"]) and not _marks(m["attrs"]):
            # an unclosed part ends where the article begins
            while left_out or part >= 0 and not articles:
                pop()
            close_line()
        if tag in SELF_ENDING and is_open[tag]:
            # with no other block between, these end each other
            depth = next((k for k in range(1, min(len(stack), 4) + 1) if stack[-k][0] in BLOCK), 0)
            if depth and stack[-depth][0] == tag:
                for _ in range(depth):
                    pop()
        aside = (tag in ASIDE and not (tag == "header" and articles)) or (tag not in PAGE and bool(_HIDDEN.search(m["attrs"])))
        # what is within a line holds no other lines
        aside = aside or bool(marks) and tag not in BLOCK
        if aside and not left_out and tag != "head":
            gap = gap or not marks or ADVERTS.isdisjoint(marks)
        block = tag in BLOCK and tag not in PAGE
        stack.append((tag, aside, block, part if marks and not aside else None))
        if marks and not aside:
            named.append(Part(marks, part))
            part = len(named) - 1
        is_open[tag] += 1
        left_out += aside
        article += tag in ARTICLE and not articles
        articles += tag in ARTICLE
        if block and tag not in FLOW:
            n_boxes += 1
            boxes.append(n_boxes)
        links += tag == "a"
        headings += tag in HEADINGS
        level += block
    unclosed = begun >= 0 and html.startswith("<!--", begun) and not html.endswith("-->", begun, at) or raw and not _CLOSED.search(html, begun, at)
    if not left_out and not (unclosed and at == body):
        parts.append(_OPENED.split(html[at:], maxsplit=1)[0])
    close_line()
    return out, named


def _clear(got: list[Line], window: int, surge: int) -> bool:
    """Whether the page's mark of an article is one: not of several teasers."""
    marked = {x.article for x in got if x.inside and x.own and not x.heading}
    return len(marked) == 1 or bool(marked) and max(_sums([x.own if x.inside else 0 for x in got], window)) >= surge


def _without_parts(got: list[Line], named: list[Part], window: int, surge: int) -> list[Line]:
    """The lines that no name leaves out."""
    if not any(x.part >= 0 for x in got):
        return got
    clear = _clear([x for x in got if x.part < 0], window, surge)
    size, title = [0] * len(named), [False] * len(named)
    for x in got:
        if x.part >= 0:
            size[x.part] += x.own
            title[x.part] |= x.heading
    # inner parts come after the ones around them
    for p in range(len(named) - 1, -1, -1):
        if named[p].outer >= 0:
            size[named[p].outer] += size[p]
            title[named[p].outer] |= title[p]
    total = sum(x.own for x in got)
    plain = any(x.own and not x.heading for x in got if x.part < 0)
    out = [False] * len(named)
    for p, (marks, outer) in enumerate(named):
        large = size[p] * 2 > total and (title[p] or not plain)
        out[p] = outer >= 0 and out[outer] or not ADVERTS.isdisjoint(marks) or clear or not large
    comments = [False] * len(named)
    for p, (marks, outer) in enumerate(named):
        comments[p] = outer >= 0 and comments[outer] or not COMMENTS.isdisjoint(marks)
    rest = [x.own for x in got if x.part < 0 or not out[x.part] and not comments[x.part]]
    if any(comments) and max(_sums(rest, window), default=0) >= surge:
        out = [a or b for a, b in zip(out, comments)]
    keep: list[Line] = []
    gap, shared = False, True
    for x in got:
        gap, shared = gap or x.gap, shared and x.shared
        if x.part >= 0 and out[x.part]:
            gap = gap or ADVERTS.isdisjoint(named[x.part].marks)
            continue
        keep.append(x._replace(gap=gap, shared=shared))
        gap, shared = False, True
    return keep


def _sums(length: list[int], window: int) -> list[int]:
    """Of each line: the lengths of the ``window`` lines from it on."""
    upto = [0, *accumulate(length)]
    n = len(length)
    return [upto[min(k + window, n)] - upto[k] for k in range(n)]


def _within(got: list[Line], length: list[int], dives: list[bool]) -> list[int]:
    """The lengths, with 1 for lines of links between two lines of text that are
    in one container with them."""
    out, last = list(length), None
    for k, x in enumerate(got):
        if dives[k] or not length[k] and last is not None and x.box != got[last].box:
            last = None
        if length[k]:
            if last is not None and x.box and x.box == got[last].box:
                out[last + 1:k] = [1] * (k - last - 1)
            last = k
    return out


def _blocks(length: list[int], dives: list[bool], window: int) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether links part it from the block
    before) of each block; ``dives``: whether a block has to end before a line."""
    out: list[tuple[int, int, bool]] = []
    n, k, parted = len(length), 0, False
    while k < n:
        first = last = k
        # the lines up to the last one with length, and after it the links
        # that don't fill a window
        while k < n and (k == first or not dives[k]) and k - last < window:
            k += 1
            if length[k - 1]:
                last = k
        if k - last >= window:
            while k < n and not length[k] and not dives[k]:
                k += 1
            if last > first:
                out.append((first, last, parted))
            parted = True
        else:
            out.append((first, k, parted))
            parted = False
    return out


def _kept(got: list[Line], length: list[int], dives: list[bool], window: int, surge: int) -> list[tuple[int, int]]:
    """First line and line after the last of what is kept."""
    blocks = _blocks(_within(got, length, dives), dives, window)
    # no window reaches beyond its block
    largest = [max(_sums(length[first:end], window)) for first, end, _ in blocks]
    threshold = min(surge, max(largest) / 2)
    # of each block the line it is kept from (its end if it isn't)
    start = [first if total and total >= threshold else end for total, (first, end, _) in zip(largest, blocks)]
    surges = [s < end for s, (_, end, _) in zip(start, blocks)]
    before, bridged = False, []
    for b, (first, end, parted) in enumerate(blocks):
        if parted:
            bridged = []
            before = False
        if surges[b]:
            for c in bridged:
                start[c] = blocks[c][0]
            if b and not parted and not surges[b - 1]:
                k = blocks[b - 1][1]
                while k > blocks[b - 1][0] and got[k - 1].heading:
                    k -= 1
                start[b - 1] = min(start[b - 1], k)
            before, bridged = True, []
        elif before:
            bridged.append(b)
    return [(s, end) for s, (_, end, _) in zip(start, blocks) if s < end]


def _bounded(got: list[Line], dives: list[bool], window: int, surge: int) -> tuple[list[Line], list[bool]] | None:
    """The lines inside the article mark and their dives; None if the largest
    block lies outside."""
    length = [x.own for x in got]
    blocks = _blocks(_within(got, length, dives), dives, window)
    sizes: dict[bool, int] = {True: 0, False: 0}
    for first, end, _ in blocks:
        sizes[got[first].inside] = max(sizes[got[first].inside], sum(length[first:end]))
    if sizes[False] > sizes[True]:
        return None
    sums = _sums([0 if x.inside else x.own for x in got], window)
    own: list[Line] = []
    parted: list[bool] = []
    cut = False
    for x, total in zip(got, sums):
        cut = cut or x.gap and not x.shared or not x.inside and total >= surge
        if x.inside:
            own.append(x)
            parted.append(cut)
            cut = False
    return own, parted


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The blocks of a page in which a surge lies."""
    if not html:
        return ""
    got = _without_parts(*lines(html), window, surge)
    dives = [x.gap and not x.shared for x in got]
    length = [x.own for x in got]
    if any(x.inside for x in got):
        edges = [d or k > 0 and got[k - 1].inside != x.inside for k, (x, d) in enumerate(zip(got, dives))]
        bounded = _bounded(got, edges, window, surge)
        if bounded:
            got, dives = bounded
            length = [len(x.text) for x in got]
        else:
            dives = edges
    if not any(length):
        return "\n".join(x.text for x in got)
    keep: list[str] = []
    for first, end in _kept(got, length, dives, window, surge):
        # links at its ends aren't its text, unless they are headings
        while first < end and not length[first] and not got[first].heading:
            first += 1
        while first < end and not length[end - 1] and not got[end - 1].heading:
            end -= 1
        keep.extend(x.text for x in got[first:end])
    return "\n".join(keep)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, name: str = "text",
            length_name: str = "n_chars") -> DataFrame:
    """Columns ``keep`` (default: all but the page itself), ``name`` and its
    length in code points."""
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    if {name.lower(), length_name.lower()} & {c.lower() for c in keep}:
        raise ValueError(f"the pages have a column named {name} or {length_name}")

    def run(batches):
        for batch in batches:
            for part in steps(batch, html_col):
                text = [main_text(h) for h in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text, pa.string()),
                                                  pa.array(map(len, text), pa.int64())], names=[*keep, name, length_name])

    df = pages.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, html_col])])
    return df.mapInArrow(run, add_fields(df.select(*[F.col(f"`{c}`") for c in keep]).schema,
                                         [(name, StringType()), (length_name, LongType())]))
