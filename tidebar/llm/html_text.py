"""Main text of web pages by tag-path ratios.

A page is read once into text leaves with their root-to-leaf tag paths. Per path the text
length and punctuation of its leaves are summed and divided by the number of leaves, which
gives two ratios; both are smoothed over alike paths (one path is a prefix of the other or
they differ in the last tag), fused into one value and compared with a threshold that the
page's own spread sets. Blocks with a leaf above it are content wherever they stand below the
lowest element that holds nearly all such text, and with them the textual blocks next to
them that aren't mostly links. Blocks under navigation, adverts, forms or comments are left out, but
a mark on an element that holds most of the page's high-ratio text doesn't count, unless an
article or main element stands free of marks; weak marks only take a block's neighbours from it.
Leaves inside links count against a path, so lists of links don't become content.

Edge cases: null or empty html gives an empty text; a page that is cut off in the middle of
a tag, a reference or a script keeps what came before; unknown tags are inline; text
outside any tag counts as a block; a page without tags is its own text. Repeated rows each
give a row; an empty table gives an empty result; columns other than the three are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: tags by their role in HTML
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# what a closing block tag may not reach across
SCOPE = frozenset("table td th article section main body html".split())
# names that mark an element as no part of the article, as whole words of its class, id or role
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar side menu nav navigation navbar breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus discussion cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social widget toolbar pagination pager skip search complementary contentinfo".split()
)
# marks that articles' own blocks bear too: what passes the threshold under them is content
WEAK = frozenset("banner discussion header login masthead menu modal notice notices overlay promo promotion recommendations recommended related replies reply respond search share sharing side signup skip social subscribe subscription toolbar widget".split())
# blocks that join the content next to them, and blocks that can't hold all of it
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figcaption caption summary address".split())
INNER = TEXTUAL | frozenset("ul ol dl dir table thead tbody tfoot tr figure hgroup".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[A-Za-z]+")
BLANKS = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、；：！？]")
SHARE, NEARLY = 0.5, 0.95
NONE, WEAKLY, STRONGLY, HIDES = range(4)


class Leaf:
    __slots__ = ("block", "linked", "marks", "path", "text")

    def __init__(self, text: str, path: tuple[int, ...], block: int, marks: tuple[tuple[int, int], ...], linked: bool):
        self.text, self.path, self.block, self.marks, self.linked = text, path, block, marks, linked

    def mark(self, overruled: set[int]) -> int:
        return max((m for e, m in self.marks if e not in overruled), default=NONE)


def _marked(tag: str, attrs: str) -> int:
    if attrs and tag not in ("html", "body", "article", "main") and HIDDEN.search(attrs):
        return HIDES
    if tag in BOILER:
        return STRONGLY
    if not attrs or tag in ("html", "body", "article", "main"):
        return NONE
    words = {w.lower() for m in ATTRS.finditer(attrs) for w in WORDS.findall(m[2] or m[3] or m[4] or "")} & MARKS
    return (STRONGLY if words - WEAK else WEAKLY) if words else NONE


def leaves(page: str) -> tuple[list[Leaf], list[tuple[str, int]]]:
    """Text leaves in page order with the marked elements above them, and (tag, parent) of each element; element 0 stands above the root."""
    found: list[Leaf] = []
    elements: list[tuple[str, int]] = [("", -1)]
    # (tag, element, marks, linked, skipped)
    stack: list[tuple[str, int, tuple[tuple[int, int], ...], bool, bool]] = [("", 0, (), False, False)]
    block, at, end = 0, 0, len(page)

    def text(upto: int) -> None:
        if upto > at and not stack[-1][4]:
            t = entities.unescape(page[at:upto])
            if t:
                found.append(Leaf(t, tuple(s[1] for s in stack), block, stack[-1][2], stack[-1][3]))

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(end)
            break
        text(m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[4]:  # cut off inside a tag
            break
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and not (tag not in SCOPE and any(stack[i][0] in SCOPE and tag not in BLOCK for i in range(depth + 1, len(stack)))):
                del stack[depth:]
            block += tag in BLOCK
            continue
        if tag in BLOCK or tag == "br":
            block += tag in BLOCK
        if tag == "br":
            if not stack[-1][4]:
                found.append(Leaf(" ", tuple(s[1] for s in stack), block, stack[-1][2], stack[-1][3]))
            continue
        if tag in VOID:
            continue
        if tag in BLOCK or tag in CLOSES:
            closed = CLOSES.get(tag, {"p"} if tag in BLOCK else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closed:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and stack[i][0] not in closed:
                    break
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        elements.append((tag, top[1]))
        mark = _marked(tag, m[3])
        stack.append((tag, len(elements) - 1, (*top[2], (len(elements) - 1, mark)) if mark else top[2], top[3] or tag == "a", top[4] or tag in SKIPPED))
    return found, elements


def _ratios(found: list[Leaf], elements: list[tuple[str, int]]) -> dict[tuple[str, ...], float]:
    """The fused, smoothed ratio of each tag path."""
    names: dict[tuple[int, ...], tuple[str, ...]] = {}
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for leaf in found:
        path = names.get(leaf.path)
        if path is None:
            path = names[leaf.path] = tuple(elements[e][0] for e in leaf.path[1:])
        s = sums[path]
        chars = len(leaf.text.strip())
        if not chars:
            continue
        s[0] += 1
        if not leaf.linked:
            s[1] += chars
            s[2] += len(PUNCTUATION.findall(leaf.text))
    text = {p: s[1] / s[0] for p, s in sums.items() if s[0]}
    marks = {p: s[2] / s[0] for p, s in sums.items() if s[0]}
    alike: dict[tuple[str, ...], list[tuple[str, ...]]] = defaultdict(list)
    for p in text:
        alike[p[:-1]].append(p)

    def smooth(r: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
        out = {}
        for p, v in r.items():
            near = [q for q in alike[p[:-1]] if q != p]
            near += alike[p]
            if p[:-1] in r:
                near.append(p[:-1])
            out[p] = (2 * v + sum(r[q] for q in near)) / (2 + len(near)) if near else v
        return out

    text, marks = smooth(text), smooth(marks)
    top_text, top_marks = max(text.values(), default=0) or 1, max(marks.values(), default=0) or 1
    return {p: (text[p] / top_text) * (0.5 + 0.5 * marks[p] / top_marks) for p in text}


def _passing(found: list[Leaf], elements: list[tuple[str, int]]) -> tuple[list[bool], dict[int, int], int]:
    """Whether each leaf's path passes the threshold; the text of those that do, by element and in all."""
    ratios = _ratios(found, elements)
    values = list(ratios.values()) or [0.0]
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    threshold = min(max(mean, spread), max(values))
    passes, weight, total = [], defaultdict(int), 0
    for x in found:
        n = len(x.text.strip())
        passes.append(bool(n) and not x.linked and ratios.get(tuple(elements[e][0] for e in x.path[1:]), 0.0) >= threshold)
        if passes[-1]:
            total += n
            for e in x.path:
                weight[e] += n
    return passes, weight, total


def _overruled(found: list[Leaf], elements: list[tuple[str, int]]) -> set[int]:
    """Marked elements that hold most of the page's high-ratio text."""
    if any(not x.marks and x.text.strip() and any(elements[e][0] in ("article", "main") for e in x.path) for x in found):
        return set()
    _, weight, total = _passing(found, elements)
    return {e for x in found for e, _ in x.marks if weight[e] > SHARE * total}


def _bounds(weight: dict[int, int], total: int, elements: list[tuple[str, int]]) -> set[int]:
    """The lowest element that holds nearly all passing text; an article or main element, or several side by side, go first."""
    named = [e for e in weight if elements[e][0] in ("article", "main")]
    most = [e for e in named if weight[e] >= NEARLY * total]
    if most:
        return {max(most)}  # a child is numbered after its parent
    outer = []
    for e in named:
        up = elements[e][1]
        while up > 0 and elements[up][0] not in ("article", "main"):
            up = elements[up][1]
        if up <= 0:
            outer.append(e)
    if outer and sum(weight[e] for e in outer) > SHARE * total:
        return set(outer)
    return {max((e for e, w in weight.items() if w >= NEARLY * total and elements[e][0] in BLOCK - INNER), default=0)}


def extract(page: str | None) -> str:
    found, elements = leaves(page or "")
    found = [x for x in found if not any(m == HIDES for _, m in x.marks)]
    overruled = _overruled(found, elements) if any(x.marks for x in found) else set()
    found = [x for x in found if x.mark(overruled) < STRONGLY]
    passes, weight, total = _passing(found, elements)
    bounds = _bounds(weight, total, elements)
    stated = all(elements[e][0] in ("article", "main") for e in bounds)
    # (text, passes, may join) of each block within the bounds
    blocks: list[tuple[str, bool, bool]] = []
    k = 0
    while k < len(found):
        first = k
        while k < len(found) and found[k].block == found[first].block:
            k += 1
        part = [i for i in range(first, k) if not bounds.isdisjoint(found[i].path)]
        text = BLANKS.sub(" ", "".join(found[i].text for i in part)).strip()
        if not text:
            continue
        own = [i for i in part if found[i].text.strip()]
        linked = sum(len(found[i].text.strip()) for i in own if found[i].linked)
        textual = any(elements[e][0] in TEXTUAL for i in own for e in found[i].path)
        # outside an article or main element, plain divs must pass themselves
        joins = (2 * linked <= len(text) if textual else not linked and stated) and all(found[i].mark(overruled) == NONE for i in own)
        blocks.append((text, any(passes[i] for i in own), joins))
    keep = [b[1] for b in blocks]
    for order in (range(1, len(blocks)), range(len(blocks) - 2, -1, -1)):
        for i in order:
            keep[i] = keep[i] or (blocks[i][2] and keep[i - order.step])
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            texts = [extract(p) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, address, main text and its code points."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return own.mapInArrow(_texts, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
