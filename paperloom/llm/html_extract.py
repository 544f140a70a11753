"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of
block elements (their names, first classes and evidence). Per path the length of
text that isn't linked, the punctuation and the number of blocks are summed; both
ratios are smoothed over the block sequence by a Gaussian, averaged by path and
fused by multiplication with the path's evidence. Paths above ``THRESHOLD`` times
the mean are content. Content blocks vote, by text, for the deepest element that
holds nearly all of them; the main text is what stands in it, headings, lists and
code among long paragraphs included, but for paths that evidence speaks against
and that don't pass, and for lists of links.

Evidence are weights of elements: ``NAMED`` for classes, ids and forms that are
called what menus, adverts and the like are called, ``DECLARED`` for an article
or main element. A class or id counts by its whole: "related-posts" is made of
such a word and of ``FURNITURE`` alone and counts, "related-work" doesn't. The
first is void for an element that holds a declared article or, on pages without
one, most of the page's prose: such an element is a wrapper. It is void as well
for a paragraph of unlinked prose named by ``AMBIGUOUS`` words only, and for an
element named by those only that holds ``PROSE`` characters of unlinked prose and
next to no links: what an article says of shares or relations is its text.
What HTML itself names as no content (``NO_CONTENT``), has such a role, holds
readers' comments or is hidden never takes part.

Time and memory are linear in a page, however deep its elements are nested.

Defined results: null and empty html give an empty text; unclosed, overlapping
and stray tags are read as browsers do for blocks (a block start ends an open
paragraph; an end tag closes up to its start or is ignored); pages are read one
by one, so repeated rows and ties can't interfere; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import own_columns, read

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg object annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button label legend".split()
)
ENDS_P = BLOCKS - {"option", "optgroup", "button", "label", "select", "legend"}
#: A start of the first ends an open one of these, within the nearest list or table.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
P_SCOPES = frozenset("table td th button body html".split())
SCOPES = frozenset("ul ol menu dl table select body html article section div".split())
NO_CONTENT = frozenset("head nav footer aside fieldset button select menu dialog search dir".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NO_CONTENT_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent gdpr banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus reply replies respond share sharing social related breadcrumb breadcrumbs subscribe subscription newsletter signup login popup modal overlay widget toolbar pagination pager skip outbrain taboola recommended rail".split()
)
#: What else a compound name of such an element may have in it.
FURNITURE = frozenset(
    "site page global main primary secondary top bottom left right container wrapper wrap inner outer area section block box bar slot unit module panel list items item links link buttons button icons row col column content body text title form thread count meta posts post articles stories news media widget widgets".split()
)
#: These are names of things that articles write about, too.
AMBIGUOUS = frozenset("share sharing social related recommended rail menu notice notices header banner aside skip reply replies respond subscription promotion navigation".split())
#: Readers' comments: prose that isn't the page's own, however much of it there is.
OTHERS_PROSE = frozenset("comment comments disqus reply replies respond outbrain taboola".split())
#: These may stand inside an article, with its own title in them.
HEADERS = frozenset("header masthead banner".split())
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")
#: Children of a page's body that hold nothing of its text when no content path is in them.
PARTS = frozenset("div section center table header form article".split())
PAGE = frozenset(["", "html", "body"])
#: Elements that hold blocks; what holds one block only is a block by itself.
GROUPS = frozenset("article main section div center form table tbody tr td address details dl ol ul".split()) | PAGE
SIGMA = 1.0
THRESHOLD = 0.3
NAMED, DECLARED = 0.001, 4.0
#: The share of the content's text that the article's element holds.
HOLDS = 0.9
#: A list of links: so many blocks, and this share of the text linked.
LINKS, LINKED = 3, 0.9
#: So much unlinked prose, with at most this share of links, outweighs an ambiguous name.
PROSE, FEW = 200, 0.1


class Element:
    """An open or closed block element; ``near`` are the open items that a new item of its list or table would end, ``p`` the open paragraph."""

    __slots__ = ("article", "declared", "depth", "header", "holds", "label", "mild", "name", "named", "near", "out", "p", "parent", "path", "total", "weight", "inner", "prose", "linked", "blocks", "content", "gone", "at", "wrapper")

    def __init__(self, name: str, parent: Element | None, source: str = ""):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        inside = bool(parent and parent.article)
        self.declared = name in ("article", "main")
        self.out, self.named, self.header, self.wrapper = name in NO_CONTENT, name == "form", name == "header" and not inside, True
        self.mild = False  # named by ambiguous words only
        self.label = name
        if source.strip():
            a = _attributes(source)
            role, words = a.get("role", "").lower(), _named(a) if name not in ("html", "body", "main") else set()
            self.declared |= role == "main"
            self.header |= bool(words & HEADERS or role == "banner") and not inside
            self.wrapper = not words & OTHERS_PROSE
            self.mild = not self.named and bool(words) and words <= AMBIGUOUS and role != "form" and name != "header"
            self.named |= bool(words - HEADERS) or role == "form"
            self.out |= role in NO_CONTENT_ROLES or "hidden" in a or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))
            if first := (a.get("class") or a.get("id") or "").split():
                self.label += f".{first[0]}"
        self.out |= bool(parent and parent.out)
        self.article = inside or self.declared
        self.p = self if name == "p" else None if parent is None or name in P_SCOPES else parent.p
        self.near = {} if parent is None or name in SCOPES else parent.near
        if name in ITEMS:
            self.near = self.near | {name: self}
        self.holds = False  # a declared article
        self.total = self.prose = self.linked = self.blocks = 0  # of all in it: text, unlinked text with punctuation, linked text, blocks
        self.content = 0.0  # text of content paths in it
        self.gone = False


ITEMS = frozenset(ENDS) | {n for names in ENDS.values() for n in names}


@dataclass
class Block:
    text: str
    element: Element
    linked: int
    marks: int


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


def _named(attributes: dict[str, str]) -> set[str]:
    """The words of ``NO_CONTENT_WORDS`` in classes and ids that are made of them and of furniture alone."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if parts <= NO_CONTENT_WORDS | FURNITURE:
            found |= parts & NO_CONTENT_WORDS
    return found


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order, and its block elements, each after its parent."""
    root = Element("", None)
    stack, elements, found, text, linked, in_link, at = [root], [root], [], [], 0, 0, 0
    names: Counter = Counter()  # of the open elements

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                found.append(Block(joined, stack[-1], min(linked, len(joined)), len(PUNCTUATION.findall(joined))))
            text.clear()
        linked = 0

    def close(upto: Element):
        flush()
        while len(stack) > 1:
            e = stack.pop()
            names[e.name] -= 1
            if e is upto:
                break

    search = TOKEN.search
    while m := search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        end, name, source = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not end and not source.endswith("/"):
                tail = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = tail.end() if tail else len(page)
        elif name == "br":
            text.append(" ")
        elif name == "a":
            in_link = 0 if end else 1
        elif name in BLOCKS:
            if end:
                if names[name] > 0:
                    close(next(e for e in reversed(stack) if e.name == name))  # each element passed is closed
                else:
                    flush()
            else:
                flush()
                in_link = 0 if name not in ("p", "div", "li", "h1", "h2", "h3") else in_link
                if name in ENDS_P and stack[-1].p is not None:
                    close(stack[-1].p)
                if ended := [stack[-1].near[n] for n in ENDS.get(name, ()) if n in stack[-1].near]:
                    close(max(ended, key=lambda e: e.depth))
                if name not in VOID:
                    e = Element(name, stack[-1], source)
                    stack.append(e)
                    elements.append(e)
                    names[name] += 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return found, elements


def _smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-2, 3)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + 2], values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def _weigh(found: list[Block], elements: list[Element]) -> None:
    """Sums of what elements hold, then each element's path and weights; a path is known by its parent's and its own label and evidence."""
    for b in found:
        e, n = b.element, len(b.text)
        e.total += n
        e.linked += b.linked
        e.blocks += 1
        e.prose += (n - b.linked) * bool(b.marks)
    for e in reversed(elements[1:]):
        up = e.parent
        up.total, up.linked, up.blocks = up.total + e.total, up.linked + e.linked, up.blocks + e.blocks
        # What readers or other pages wrote is nobody's reason to be a wrapper.
        up.prose += e.prose if e.wrapper and not e.out else 0
        up.holds |= e.holds or e.declared and not e.out and not e.named
    declared, paths = elements[0].holds, {}
    for e in elements:
        own = e.mild and e.prose > 0 and (e.prose == e.total if e.name == "p" else e.prose >= PROSE and e.linked <= FEW * e.total)
        wraps = own or e.wrapper and (e.holds if declared else 2 * e.prose > elements[0].prose)
        named = NAMED if e.named and not wraps else 1.0
        header = NAMED if e.header and not wraps else 1.0
        e.out |= not (e.wrapper or own and e.name == "p") or bool(e.parent and e.parent.out)
        up = (e.parent.path, e.parent.weight, e.parent.inner) if e.parent else (-1, 1.0, 1.0)
        e.weight = up[1] * named * header * (DECLARED if e.declared and not (e.parent and e.parent.article) else 1.0)
        e.inner = up[2] * named
        e.path = paths.setdefault((up[0], e.label, named * header), len(paths))


def content_paths(kept: list[Block], threshold: float = THRESHOLD) -> set[int]:
    """The paths whose fused ratio is at least ``threshold`` times the mean over blocks."""
    length, marks, number, weight = defaultdict(int), defaultdict(int), Counter(), {}
    for b in kept:
        path = b.element.path
        length[path] += len(b.text) - b.linked
        marks[path] += b.marks
        number[path] += 1
        weight[path] = b.element.weight
    by_text = _smooth([length[b.element.path] / number[b.element.path] for b in kept])
    by_marks = _smooth([(1 + marks[b.element.path]) / number[b.element.path] for b in kept])
    text_of, marks_of = Counter(), Counter()
    for b, x, y in zip(kept, by_text, by_marks, strict=True):
        text_of[b.element.path] += x
        marks_of[b.element.path] += y
    fused = {p: text_of[p] / n * (marks_of[p] / n) * weight[p] for p, n in number.items()}
    mean = sum(fused[b.element.path] for b in kept) / len(kept)
    return {p for p, x in fused.items() if x >= threshold * mean}


def _holder(elements: list[Element]) -> Element:
    """The deepest element with nearly all of the content; from there up to a declared article, or to what has a heading of its own, around it."""
    holder = max((e for e in elements if e.content >= HOLDS * elements[0].content), key=lambda e: e.depth)
    titled = {e.parent for e in elements if e.name in ("h1", "h2") and e.blocks}
    while holder.name not in PAGE and (holder.name not in GROUPS or holder.blocks == 1):
        holder = holder.parent
    up = best = holder
    while up.name not in PAGE:
        best = up if up.declared or up in titled else best
        up = up.parent
    return best


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The page's main text: its blocks, joined by an empty line."""
    found, elements = blocks(page or "")
    _weigh(found, elements)
    kept = [b for b in found if not b.element.out]
    if not kept:
        return ""
    paths = content_paths(kept, threshold)
    for b in kept:
        if b.element.path in paths:
            b.element.content += len(b.text) * b.element.weight
    for e in reversed(elements[1:]):
        e.parent.content += e.content
    holder = _holder(elements)
    whole_page = holder.name in PAGE
    inside = {holder}
    for e in elements:  # each after its parent
        if e.parent in inside:
            inside.add(e)
            links = e.blocks >= LINKS and e.linked >= LINKED * e.total
            part = whole_page and e.parent is holder and e.name in PARTS
            e.gone = e.parent.gone or not e.content and (links or part)
    of_it = [b for b in kept if b.element in inside and (b.element.path in paths or not b.element.gone and b.element.inner >= holder.inner and not (whole_page and b.element.weight < holder.weight))]
    return "\n\n".join(b.text for b in of_it)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (its code points)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def each(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return own_columns(pages, "page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
