"""Main-text extraction by wrappers: union-free regular expressions inferred from the pages of each host.

A page is a stream of tags and texts, read element by element. Within an element, runs of equal groups of
tokens become one repeated group. Two streams are aligned: equal tokens are merged, a text that differs
becomes a slot, tokens of one stream only become optional, and neighbours that turn out equal become a
repeated group. Folding every page of a host into one expression this way gives the host's wrapper, with
how much text and link text each place holds and in how many pages. Places are then judged once for the
host - by their elements and names, by texts that never change, by how much prose and how many links stand
there - and each page, aligned with its wrapper, gives up the texts in places judged to be the article. Nothing
recurses, so pages may be nested to any depth.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches
from corpusmill.session import cut_lineage, release

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
MARKING = re.compile(r"=|hidden", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
# elements whose content is not text; of the two that are not HTML, one may close itself
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas", "audio", "video"}
FOREIGN = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
# an opening tag that ends open elements of these names, up to the nearest of the stoppers
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
SCOPE = {"td", "th", "table", "button", "body", "html"}
# elements, roles and names that mark what is not the article; a class or id is named by its last word that is no FRAME word
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
ADVERT = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion"}
REMARKS = {"comment", "comments", "disqus", "respond", "replies"}
FURNITURE = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "signup", "login", "pagination", "pager", "toolbar", "masthead"}
# names that long prose outweighs
WEAK = {"aside", "banner", "notice", "notices", "notification", "overlay", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended", "widget", "skip", "disclaimer", "copyright"}
STRONG = ADVERT | REMARKS | FURNITURE
FRAME = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "count", "desktop", "form", "group", "icons", "inline", "inner", "item", "items", "label", "large", "left", "link", "links", "list", "main", "media", "mobile", "news", "outer", "panel", "posts", "primary", "right", "row", "secondary", "section", "slot", "small", "sticky", "stories", "text", "thread", "top", "unit", "wrap", "wrapper"}
MAIN_TAGS, MAIN_WORDS = {"article", "main"}, {"article", "content", "main", "post", "entry", "story", "body"}
# elements that hold a paragraph's text themselves: only adverts are dropped for their name
PROSE_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "figcaption", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LONGEST_GROUP = 3
#: A text that never changed in most pages of a host, so many of them of different texts, belongs to its template.
FIXED_IN = 3
#: Inside a marked article that takes so large a part of the pages, and a text of so many characters at most.
FIXED_SHARE, FIXED_CHARS = 0.8, 300
#: Names in WEAK are outweighed by varying text of so many characters a page with at most so large a part in links.
PROSE_CHARS, PROSE_LINKS = 400, 0.2
#: Larger alignments are cut at tokens that both sides hold once, and beyond that matched in order.
MOST_CELLS = 200_000
#: An element's places beyond so many are put together by signature, and then by tag.
WIDEST = 400
#: Wrappers up to so many bytes in all are broadcast; beyond, pages meet theirs in units of so many pages.
MOST_BROADCAST, PAGES_A_UNIT = 16 << 20, 4096


@dataclass(eq=False)
class Element:
    sig: str
    children: list = field(default_factory=list)  # Element, or Text
    page: bytes = b""  # of a root: a digest of the page's texts


@dataclass(eq=False)
class Text:
    text: str
    links: int
    sig: str = "#"


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag with its role and the names in its class and id (letters only, words joined by hyphens), and whether it is hidden."""
    tokens, role, hidden = set(), "", False
    if MARKING.search(attributes):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            name = name.lower()
            if name == "role":
                role = value.strip().lower()
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or value.strip().lower() == "true"
            elif name == "style":
                hidden = hidden or bool(UNSEEN.search(value))
            else:
                tokens.update("-".join(w.lower() for w in CAMEL.split(t) if w) for t in value.split())
    return tag + (f"@{role}" if role else "") + "".join(f".{t}" for t in sorted(tokens) if t), hidden


def parse(html: str) -> Element:
    """The block elements of a page with the texts between them; comments, raw content and hidden or advertising inline elements are left out."""
    root = Element("#root")
    stack: list[tuple[str, Element]] = [("#root", root)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = 0
    skipped: list | None = None  # of an inline element left out: its tag, the open elements around it, how many of its tag are open in it
    digest = blake2b(digest_size=8)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                stack[-1][1].children.append(Text(text, min(linked, len(text))))
                digest.update(text.encode("utf-8", "surrogatepass") + b"\n")
            parts.clear()
        linked = 0

    def put(text: str):
        nonlocal linked
        if text and skipped is None:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(first: int):
        nonlocal skipped
        for name, _ in stack[first:]:
            opened[name] -= 1
        del stack[first:]
        if skipped is not None and len(stack) < skipped[1]:
            skipped = None  # never closed: it ends with the element around it

    at, n = 0, len(html)
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW:
            if not closing and not (tag in FOREIGN and m[3].endswith("/")):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else n
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            put(" ")
        if tag in INLINE or tag in VOID:
            if tag == "hr":
                flush()
            elif skipped is not None:
                if tag == skipped[0] and tag not in VOID:
                    skipped[2] += -1 if closing else 1
                    if not skipped[2]:
                        skipped = None
            elif not closing and tag not in VOID and MARKING.search(m[3]):
                sig, hidden = _signature(tag, m[3])
                if hidden or named(sig) & ADVERT:
                    skipped = [tag, len(stack), 1]
            continue
        flush()
        in_link = 0
        if closing:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in SCOPE and tag not in ("body", "html", "table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        names, stops = ENDS.get(tag, ({"p"}, SCOPE))
        if any(opened[x] for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    close(i)
                    if tag not in ENDS:
                        break
                elif stack[i][0] in stops or tag not in ENDS and stack[i][0] != "p":
                    break
        sig, hidden = _signature(tag, m[3])
        element = Element(sig)
        if not hidden and skipped is None:
            stack[-1][1].children.append(element)
        stack.append((tag, element))
        opened[tag] += 1
    flush()
    root.page = digest.digest()
    return root


@dataclass(eq=False)
class Part:
    """One place of a wrapper: an element, a text slot (`#`), or a group of places that repeats (`()`)."""

    sig: str
    seen: int = 1  # pages in which it stands; fewer than its parent's make it optional
    repeated: bool = False
    parts: list[Part] = field(default_factory=list)
    text: str | None = None  # of a text that was the same so far
    chars: int = 0
    links: int = 0
    verdict: Verdict | None = None  # of a judged element
    pages: frozenset[bytes] = frozenset()  # of a text that was the same so far: digests of pages with it, FIXED_IN or a few more at most


def run(job: Generator):
    """The value of a generator that yields further ones and is sent their values: calls to any depth without a call stack."""
    stack, value = [job], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def runs(sigs: list[str]) -> list[tuple[int, int, int]]:
    """(start, width, times): the stream cut into groups that repeat, and single tokens."""
    out, i, n = [], 0, len(sigs)
    while i < n:
        for width in range(1, min(LONGEST_GROUP, (n - i) // 2) + 1):
            if sigs[i] != sigs[i + width]:
                continue
            first = sigs[i : i + width]
            times = 1
            while sigs[i + times * width : i + (times + 1) * width] == first:
                times += 1
            if times > 1:
                break
        else:
            width = times = 1
        out.append((i, width, times))
        i += width * times
    return out


def _fold(parts: list[Part]) -> Generator:
    """Repeats of one stream put together."""
    out = []
    for start, width, times in runs([p.sig for p in parts]):
        if times == 1:
            out.append(parts[start])
            continue
        body = parts[start : start + width]
        for k in range(1, times):
            for i in range(width):
                body[i] = yield _merge(body[i], parts[start + k * width + i], True)
        if width == 1:
            body[0].repeated = True
            out.append(body[0])
        else:
            out.append(Part("(" + " ".join(p.sig for p in body) + ")", body[0].seen, True, body))
    return out


def of_page(root: Element) -> Part:
    """A page as a wrapper of its own."""
    pages, order, todo = frozenset([root.page]), [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if not isinstance(node, Text):
            todo += node.children
    built: dict[int, Part] = {}
    for node in reversed(order):  # children before what holds them
        if isinstance(node, Text):
            built[id(node)] = Part("#", text=node.text, chars=len(node.text), links=node.links, pages=pages)
        else:
            built[id(node)] = Part(node.sig, parts=run(_fold([built.pop(id(c)) for c in node.children])))
    return built[id(root)]


def _subsequence(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal tokens in order, as many as possible (a longest common subsequence)."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, sorted by the first number, in which the second rises too."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _in_order(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Equal tokens matched one by one, each with the next of its kind that is left."""
    places: dict[str, list[int]] = {}
    for j, t in enumerate(y):
        places.setdefault(t, []).append(j)
    out, least = [], 0
    for i, t in enumerate(x):
        own = places.get(t, [])
        k = bisect_left(own, least)
        # a far jump would leave all between without partners
        if k < len(own) and own[k] - least <= 2 * (len(x) - i) + 64:
            out.append((i, own[k]))
            least = own[k] + 1
    return out


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Equal tokens in order: a longest common subsequence where that is small, else between tokens that each side holds once."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= MOST_CELLS:
            out += [(a + i, c + j) for i, j in _subsequence(x[a:b], y[c:d])]
            continue
        once_x, once_y = Counter(x[a:b]), Counter(y[c:d])
        where = {t: j for j, t in enumerate(y[c:d], c) if once_y[t] == 1}
        anchors = _increasing([(i, where[t]) for i, t in enumerate(x[a:b], a) if once_x[t] == 1 and t in where])
        if not anchors:
            out += [(a + i, c + j) for i, j in _in_order(x[a:b], y[c:d])]
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Both streams as one: pairs of equal tokens, and tokens of one stream with -1 for the other; those of a before those of b."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    out, i, j = [], 0, 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        out += [(k, -1) for k in range(i, x)]
        out += [(-1, k) for k in range(j, y)]
        if x < len(a) and y < len(b):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def _join(a: Part, b: Part, same_page: bool) -> None:
    a.seen = max(a.seen, b.seen) if same_page else a.seen + b.seen
    a.repeated = a.repeated or b.repeated
    a.chars += b.chars
    a.links += b.links
    if a.text != b.text:
        a.text, a.pages = None, frozenset()
    elif a.text is not None and len(a.pages) < FIXED_IN:
        a.pages = a.pages | b.pages


def bare(sig: str) -> str:
    """The signature without names that say nothing of the article."""
    tag, role, tokens = names(sig)
    kept = [t for t in sorted(tokens) if aside_name(t) or set(t.split("-")) & MAIN_WORDS]
    return tag + (f"@{role}" if role else "") + "".join(f".{t}" for t in kept)


def _narrow(parts: list[Part]) -> Generator:
    """Too many places: those of one signature are put together, and if there still are too many, those alike but for names that say nothing."""
    for name in (lambda s: s, lambda s: s if s[0] in "#(" else bare(s)):
        if len(parts) <= WIDEST:
            break
        first: dict[str, Part] = {}
        for p in parts:
            p.sig = name(p.sig)
            if p.sig in first:
                first[p.sig] = yield _merge(first[p.sig], p, False)
                first[p.sig].repeated = True
            else:
                first[p.sig] = p
        parts = list(first.values())
    return parts


def _merge(a: Part, b: Part, same_page: bool) -> Generator:
    _join(a, b, same_page)
    if a.parts or b.parts:
        parts = []
        for i, j in align([p.sig for p in a.parts], [p.sig for p in b.parts]):
            if i < 0 or j < 0:
                parts.append(b.parts[j] if i < 0 else a.parts[i])
                continue
            x, y = a.parts[i], b.parts[j]
            if x.parts or y.parts:
                yield _merge(x, y, same_page)
            else:
                _join(x, y, same_page)
            parts.append(x)
        # the places of a group are as many as its signature names
        if a.sig[0] != "(":
            if any(x.sig == y.sig for x, y in zip(parts, parts[1:], strict=False)):
                parts = yield _fold(parts)
            if len(parts) > WIDEST:
                parts = yield _narrow(parts)
        a.parts = parts
    return a


def merge(a: Part, b: Part) -> Part:
    """The wrapper of both; a may be changed."""
    return run(_merge(a, b, False))


@lru_cache(1 << 16)
def names(sig: str) -> tuple[str, str, frozenset[str]]:
    head, *tokens = sig.split(".")
    tag, _, role = head.partition("@")
    return tag, role, frozenset(tokens)


@lru_cache(1 << 16)
def aside_name(token: str) -> str | None:
    """The name that a class or id goes by, if it is one of what is not the article: `ad-slot` is an `ad`, a `notice-board` no `notice`."""
    words = token.split("-")
    while len(words) > 1 and words[-1] in FRAME:
        words.pop()
    return words[-1] if words[-1] in STRONG or words[-1] in WEAK else None


def named(sig: str) -> set[str]:
    return {x for t in names(sig)[2] if (x := aside_name(t))}


@lru_cache(1 << 16)
def is_aside(sig: str, in_main: bool) -> str:
    """Why an element is not the article: `yes`, `weak` (a name that prose outweighs), or empty."""
    tag, role, tokens = names(sig)
    by_name = named(sig)
    if tag in MAIN_TAGS:
        return "yes" if by_name & (ADVERT | REMARKS | {"related"}) else ""
    if tag in ASIDE_TAGS or role in ASIDE_ROLES or not in_main and (tag == "header" or any(t.split("-")[-1] == "header" for t in tokens)):
        return "yes"
    if tag in PROSE_TAGS and in_main:
        return "yes" if by_name & ADVERT else ""
    if by_name & STRONG:
        return "yes"
    return "weak" if by_name else ""


def is_main(sig: str, strict: bool) -> bool:
    tag, role, tokens = names(sig)
    if tag in MAIN_TAGS or role == "main":
        return not named(sig) & (ADVERT | REMARKS)
    return not strict and tag not in ("body", "html") and any(set(t.split("-")) & MAIN_WORDS for t in tokens) and not is_aside(sig, False)


OUT, MAIN, ASIDE = 0, 1, 2
#: A verdict: where a place lies, whether the wrapper marks the article at all, and whether it does by elements.
Verdict = tuple[int, bool, bool]


def judge(wrapper: Part, given: Verdict | None = None) -> Part:
    """Marks each text slot of the wrapper: `links` becomes 1 where it is article text, else 0; other places get their verdict.

    What elements and names say comes first; what the pages showed then decides: texts that never change are
    template, whether or not an element marks the article, long varying prose outweighs a weak name, and
    without an element that marks the article blocks of links are left out. What stands below a place already
    judged is given its verdict.
    """
    order: list[tuple[Part, int]] = [(wrapper, -1)]
    for k, (p, _) in enumerate(order):  # grows as it is gone through
        order += [(c, k) for c in p.parts]
    n = len(order)
    chars, links, varied = [p.chars for p, _ in order], [p.links for p, _ in order], [p.sig == "#" and p.text is None for p, _ in order]
    for k in range(n - 1, 0, -1):
        up = order[k][1]
        chars[up] += chars[k]
        links[up] += links[k]
        varied[up] = varied[up] or varied[k]

    def aside(k: int, in_main: bool) -> bool:
        p = order[k][0]
        if p.sig[0] in "(#":
            return False
        why = is_aside(p.sig, in_main)
        if why != "weak":
            return bool(why)
        return not (in_main and varied[k] and chars[k] >= PROSE_CHARS * p.seen and links[k] <= PROSE_LINKS * chars[k])

    def states(strict: bool, start: int, contained: bool) -> list[int]:
        """Of each place, whether it lies in the article."""
        state = [start] * n
        for k in range(1, n):
            p, up = order[k]
            state[k] = state[up]
            if p.sig[0] in "(#" or state[up] == ASIDE:
                continue
            if state[up] == OUT and is_main(p.sig, strict):
                state[k] = MAIN
            elif aside(k, state[up] == MAIN and contained):
                state[k] = ASIDE
        return state

    if given:
        start, contained, strict = given
        state = states(strict, start, contained)
    else:
        for strict in (True, False):
            state = states(strict, OUT, True)
            contained = any(s == MAIN and p.sig == "#" and p.chars for s, (p, _) in zip(state, order, strict=True))
            if contained:
                break
        else:
            state = states(False, MAIN, False)
    keep = [False] * n
    dense = [False] * n
    for k, (p, up) in enumerate(order):
        if up >= 0 and not contained:
            own = p.sig[0] not in "(#" and names(p.sig)[0] not in ("body", "html")
            dense[k] = dense[up] or own and chars[k] > 0 and links[k] > 0.5 * chars[k]
        if p.sig == "#":
            fixed = p.text is not None and len(p.pages) >= FIXED_IN and 2 * p.seen > wrapper.seen
            if contained:
                fixed = fixed and p.seen >= FIXED_SHARE * wrapper.seen and len(p.text) <= FIXED_CHARS and names(order[up][0].sig)[0] not in HEADINGS
            keep[k] = state[k] == MAIN and not dense[k] and not fixed
    for (p, _), k, where in zip(order, keep, state, strict=True):
        if p.sig == "#":
            p.text, p.links, p.pages = None, int(k), frozenset()
        else:
            p.verdict = (where, contained, strict)
    return wrapper


def _in_places(node: Element, wrapper: Part) -> list[tuple[Element | Text, Part]]:
    """The node's children with the places they take in its wrapper."""
    cut = runs([c.sig for c in node.children])
    sigs = [node.children[s].sig if w == 1 else "(" + " ".join(c.sig for c in node.children[s : s + w]) + ")" for s, w, _ in cut]
    every: dict[str, Part] = {}
    out = []
    for i, j in align(sigs, [p.sig for p in wrapper.parts]):
        if i < 0:
            continue
        start, width, times = cut[i]
        if j >= 0:
            place = wrapper.parts[j]
            out += [(node.children[start + k], place if width == 1 else place.parts[k % width]) for k in range(times * width)]
            continue
        if not every:  # the alignment puts it elsewhere: the first place of that kind judges
            for p in wrapper.parts:
                for q in [p, *p.parts] if p.sig[0] == "(" else [p]:
                    every.setdefault(q.sig, q)
        for child in node.children[start : start + width * times]:
            place = every.get(child.sig) or every.get(bare(child.sig))
            if place is None:  # it was merged into another place of the host: its own signature judges, below this place's verdict
                place = judge(of_page(Element("#root", [child])), wrapper.verdict).parts[0]
            out.append((child, place))
    return out


def extract(node: Element, wrapper: Part, out: list[str]) -> None:
    """The page's texts in places that judge() kept, in page order."""
    todo: list[tuple[Element | Text, Part]] = [(node, wrapper)]
    while todo:
        own, place = todo.pop()
        if isinstance(own, Text):
            if place.links:
                out.append(own.text)
        elif own.children:
            todo += reversed(_in_places(own, place))


def page_text(html: str, wrapper: Part) -> str:
    """The page's main text under its host's judged wrapper; by itself, if it has none of its host's article places."""
    texts: list[str] = []
    page = parse(html)
    extract(page, wrapper, texts)
    if not texts:
        extract(page, judge(of_page(page)), texts)
    return " ".join(texts)


def host_of(url):
    """The host of a URL without port and user, lower-case; null and odd URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _pack(p: Part) -> bytes:
    """A wrapper as one flat list, each place before those in it."""
    rows, todo = [], [p]
    while todo:
        x = todo.pop()
        rows.append((x.sig, x.seen, x.repeated, x.text, x.chars, x.links, tuple(x.pages), len(x.parts)))
        todo += reversed(x.parts)
    return zlib.compress(pickle.dumps(rows, protocol=5), 1)


def _unpack(b: bytes) -> Part:
    top = Part("")
    holders = [[top, 1]]  # places that wait for so many more
    for sig, seen, repeated, text, chars, links, pages, n in pickle.loads(zlib.decompress(b)):
        while not holders[-1][1]:
            holders.pop()
        p = Part(sig, seen, repeated, [], text, chars, links, pages=frozenset(pages))
        holders[-1][0].parts.append(p)
        holders[-1][1] -= 1
        if n:
            holders.append([p, n])
    return top.parts[0]


def infer(pages: DataFrame, host_col: str, html_col: str, fan: int = 64) -> DataFrame:
    """(host, part, n, wrapper): every page folded into its host's wrapper, and how many pages there were.

    A task folds its own pages first; a host's partial wrappers are merged by groups of tasks and then
    together, always in the order of their tasks, so a host with a third of all pages sends one wrapper a task.
    """

    columns = ["host", "part", "n", "wrapper"]

    def send(found: dict[str, Part], part: int):
        for host, w in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([part], pa.int64()), pa.array([w.seen], pa.int64()), pa.array([_pack(w)], pa.binary())], columns)

    def fold_pages(batches):
        part = TaskContext.get().partitionId()
        found: dict[str, Part] = {}
        for b in batches:
            for host, html in zip(b.column(0), b.column(1), strict=True):
                page, host = of_page(parse(html.as_py() or "")), host.as_py()
                found[host] = merge(found[host], page) if host in found else page
            if len(found) > 5000:
                yield from send(found, part)
                found = {}
        yield from send(found, part)

    def fold_wrappers(batches):
        host, first, whole = None, 0, None
        for b in batches:
            for name, part, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                own = _unpack(w.as_py())
                if name == host:
                    whole = merge(whole, own)
                    continue
                if whole is not None:
                    yield from send({host: whole}, first)
                host, first, whole = name, part, own
        if whole is not None:
            yield from send({host: whole}, first)

    schema = "host string, part long, n long, wrapper binary"
    one = pages.select(host_col, html_col).mapInArrow(fold_pages, schema)
    group = F.col("part") % fan
    some = one.repartition(F.col("host"), group).sortWithinPartitions(F.col("host"), group, "part").mapInArrow(fold_wrappers, schema)
    return some.repartition("host").sortWithinPartitions("host", "part").mapInArrow(fold_wrappers, schema)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with `main_text` in place of the html: blocks in page order joined by one space, empty if there are none.

    Null html counts as empty, pages without a usable URL share one wrapper, repeated rows each get a
    row; an empty table gives none. A page that has none of its host's article places, and the only page of
    a host, are judged by themselves. Pages of any length and depth are taken whole. Other columns are kept,
    but for those named main_text and with a leading underscore like the operator's own (_host, _cuts, _salt, _kind, _wrapper).
    """
    rows = pages.drop("main_text", "_host", "_cuts", "_salt", "_kind", "_wrapper").withColumn("_host", host_of(F.col(url_col).cast("string"))).withColumn(html_col, F.col(html_col).cast("string"))
    wrappers = cut_lineage(infer(rows, "_host", html_col))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    kept = [f for f in rows.schema.fields if f.name not in (html_col, "_host")]
    schema = T.StructType([*kept, T.StructField("main_text", T.StringType())])
    at = {c: i for i, c in enumerate(rows.columns)}

    def judged(b: pa.RecordBatch, wrapper_of: Callable[[str], Part]) -> pa.RecordBatch:
        out = [page_text(html.as_py() or "", wrapper_of(host)) for html, host in zip(b.column(at[html_col]), b.column(at["_host"]).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(at[f.name]) for f in kept), pa.array(out, pa.string())], [*(f.name for f in kept), "main_text"])

    if size <= MOST_BROADCAST:
        sent = rows.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in wrappers.select("host", "wrapper").collect()})
        release(wrappers)

        def by_broadcast(batches):
            ready: dict[str, Part] = {}

            def wrapper_of(host: str) -> Part:
                if host not in ready:
                    if len(ready) > 2000:
                        ready.clear()
                    ready[host] = judge(_unpack(sent.value[host]))
                return ready[host]

            for b in batches:
                yield judged(b, wrapper_of)

        return rows.mapInArrow(by_broadcast, schema)

    # each unit is a wrapper followed by pages of its host, and a host has as many units as its pages need
    cuts = wrappers.select(F.col("host").alias("_host"), F.ceil(F.col("n") / PAGES_A_UNIT).cast("int").alias("_cuts"))
    dealt = rows.join(cuts, "_host").select(*rows.columns, F.pmod(F.monotonically_increasing_id(), F.col("_cuts")).cast("int").alias("_salt"), F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("_wrapper"))
    every = wrappers.select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PAGES_A_UNIT).cast("int") - 1)).alias("_salt"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "_host"]
    heads = every.select(F.col("host").alias("_host"), *none, "_salt", F.lit(0).alias("_kind"), F.col("wrapper").alias("_wrapper")).select(*dealt.columns)
    met = heads.union(dealt).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", "_kind")
    kind, packed = len(rows.columns) + 1, len(rows.columns) + 2

    def by_unit(batches):
        wrapper = None
        for b in batches:
            first = 0
            heads = np.flatnonzero(b.column(kind).to_numpy(zero_copy_only=False) == 0).tolist()
            for stop in [*heads, b.num_rows]:
                if stop > first:
                    yield judged(b.slice(first, stop - first), lambda _: wrapper)
                if stop < b.num_rows:
                    wrapper = judge(_unpack(b.column(packed)[stop].as_py()))
                first = stop + 1

    return met.mapInArrow(by_unit, schema)


def op6(pages: DataFrame) -> DataFrame:
    bound_batches(pages.sparkSession)
    out = main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
