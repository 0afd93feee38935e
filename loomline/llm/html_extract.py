"""Main text of web pages by template deduction over equivalence classes (operator 6).

Tokens are opening tags, told apart by the path of block elements that they
stand in, and lines of text, told apart by their path and words.  Tokens of a
host that occur equally often on each of its pages share an occurrence vector
and form an equivalence class.  Classes that occur on half of the pages and
whose tokens stand inside other such classes nest into the host's template; the
text that is left between a template's tokens lies in its slots.  A line that
all pages have is the template's own text and in no slot.  The main slot is the
one inside an article or main element if the template has any, else the one
that holds most of the varying text outside of links, which is a container
(never a paragraph, a list, a table or the like), together with what stands
beside it.  An element whose class or id speaks of something else than an
article is cut where the host's pages repeat it, and is text where they do not.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .url_filter import host_of
from .workers import small_batches, tidy

#: A template's class occurs on this share of a host's pages at least.
SUPPORT = 0.5
#: Without an article, the main slot is the innermost one with this share of the host's text.
MAIN_SHARE = 0.6
#: An element that its class marks belongs to the template from this share of a host's pages on, and from two pages.
MARK_SUPPORT, MARK_PAGES = 0.05, 2
#: Lines that all pages have are the template's from so many pages on, unless they hold more than this share of all text: such pages are copies.
LINE_PAGES, COPY_SHARE = 3, 0.5
#: Up to so many hosts, their templates are broadcast (a template is a few paths and lines of one page).
BROADCAST_HOSTS = 5_000
#: Paths that a task counts before it hands the counts on.
COUNTED = 200_000

#: Fixed values, after the HTML standard: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li "
    "listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a main slot without an article can be; the others are an article's content, never its whole.
CONTAINER = frozenset("html body div section center".split())
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp|svg|template|noscript"
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
#: Elements whose text is not the article's, wherever they stand; a header counts as part of an article that it stands in.
APART = frozenset("head nav footer aside form fieldset button select option label menu dialog object audio video canvas search datalist".split())
ROLES_APART = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that hint at such elements; the host's template decides.
MARKED_APART = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus share sharing social related recommended widget toolbar "
    "pagination pager skip copyright disclaimer".split()
)
SITE_HEADER = frozenset({"header", "topbar"})

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^>"']++|"[^"]*"|'[^']*')*+(?<=/)>|<({RAW})(?=[\s/>])(?:[^>"']++|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Element:
    """An open block element, or an inline one that stands apart or is marked.

    With its path, whether its text stands apart, whether it lies in an
    article, and the path of the outermost marked element around it.
    """

    __slots__ = ("apart", "article", "inline", "marked", "path", "tag")

    def __init__(self, tag: str, path: str, apart: bool, article: bool, marked: str = "", inline: bool = False):
        self.tag, self.path, self.apart, self.article, self.marked, self.inline = tag, path, apart, article, marked, inline


def _opened(tag: str, attributes: str, parent: Element) -> Element:
    name, marks, role, hidden = tag, set(), "", False
    if attributes.strip():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value, key = (a or b or c).strip().lower(), key.lower()
            if key == "class" and value:
                name += "." + value.split()[0]
            if key in ("class", "id"):
                marks.update(re.split(r"[^a-z]+", value))
            elif key == "role":
                role = value
            else:
                hidden = True
    article = parent.article or tag in ("article", "main") or role in ("article", "main")
    body = tag in ("html", "body", "main") or (tag == "article" and not parent.article)
    header = tag == "header" and not parent.article
    apart = parent.apart or hidden or tag in APART or role in ROLES_APART or header
    hinted = not body and (marks & MARKED_APART or (marks & SITE_HEADER and not parent.article))
    path = f"{parent.path}/{name}" + "!" * bool(hinted)
    return Element(tag, path, apart, article, parent.marked or (path if hinted else ""))


def walk(html: str) -> Iterator[tuple[str, Element, str, bool]]:
    """Events of a page: ("open" or "mark", element, "", False), ("break", element, "", False), ("text", element, text, in a link); a mark is an inline element."""
    stack = [Element("", "", False, False, "")]
    links, at = 0, 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield "text", stack[-1], html[at : m.start()], links > 0
        at = m.end()
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "hr"):
            yield "break", stack[-1], "", False
        elif tag in VOID:
            continue
        elif not (tag in BLOCK or tag in APART):
            # Inline elements matter only where a mark sets them apart; such a one ends with its own end, whatever it holds.
            top = stack[-1]
            if closing:
                if top.inline and top.tag == tag:
                    del stack[-1]
            elif top.inline and top.tag == tag:
                stack.append(Element(tag, top.path, top.apart, top.article, top.marked, True))
            elif not top.apart and attributes.strip():
                found = _opened(tag, attributes, top)
                if found.apart or found.marked != top.marked:
                    stack.append(Element(tag, top.path, found.apart, found.article, found.marked, True))
                    yield "mark", stack[-1], "", False
            continue
        elif closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    links = 0
                    yield "break", stack[-1], "", False
                    break
            else:
                yield "break", stack[-1], "", False
        else:
            while len(stack) > 1 and (stack[-1].tag == "p" and tag in BLOCK or stack[-1].tag in CLOSED_BY.get(tag, ())):
                del stack[-1]
            if tag == "body":  # a head that nobody closed
                stack[:] = [e for e in stack if e.tag != "head"]
            stack.append(_opened(tag, attributes, stack[-1]))
            links = 0
            yield "open", stack[-1], "", False
    if at < len(html):
        yield "text", stack[-1], html[at:], links > 0


def inside(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r + "/") for r in roots)


def article_root(path: str) -> str | None:
    """The path up to its first article or main element (the article inside a main, if there is one)."""
    parts = path.split("/")
    kinds = [p.split(".")[0] for p in parts]
    for kind in ("article", "main"):
        if kind in kinds:
            return "/".join(parts[: kinds.index(kind) + 1])
    return None


def beside(path: str, root: str) -> tuple[str, bool]:
    """What of the elements around the slot ``root`` holds ``path`` that lies outside of it, and whether that is a container.

    Empty if it lies in a container beside one of the elements around the slot, which is another slot.
    """
    parts, around = path.split("/"), root.split("/")
    k = next((k for k, (a, b) in enumerate(zip(parts, around, strict=False)) if a != b), min(len(parts), len(around)))
    if k == len(parts):
        return path, False
    container = parts[k].split(".")[0] in CONTAINER
    return ("" if container and k < len(around) - 1 else "/".join(parts[: k + 1])), container


class Block:
    """A block of text: its path, whether it lies in an article, its parts with the marked element that each is in, and its words (outside of links, in links)."""

    __slots__ = ("article", "parts", "path", "words")

    def __init__(self, path: str, article: bool):
        self.path, self.article, self.parts, self.words = path, article, [], [0, 0]

    def line(self, cut: frozenset[str] | None = frozenset()) -> str:
        """The text without the marked elements in ``cut`` (None: without any), white space as single spaces."""
        kept = (text for text, marked in self.parts if not marked or (cut is not None and marked not in cut))
        return " ".join(entities.unescape("".join(kept)).split())


def blocks_of(html: str) -> tuple[list[Block], dict[str, int]]:
    """Blocks of a page that do not stand apart, and how often each path opens."""
    blocks: list[Block] = []
    opened: dict[str, int] = defaultdict(int)
    fresh = True
    for kind, element, text, linked in walk(html):
        if kind == "mark":
            opened[element.marked] += 1
        elif kind != "text":
            fresh = True
            if kind == "open":
                opened[element.path] += 1
        elif not element.apart:
            if fresh or blocks[-1].path != element.path:
                blocks.append(Block(element.path, element.article))
            blocks[-1].parts.append((text, element.marked))
            if not element.marked:
                blocks[-1].words[linked] += len(text.split())
            fresh = False
        elif not element.inline:
            fresh = True
    return blocks, opened


def line_token(path: str, line: str) -> int:
    """64 bits of a line and its path; never 0, which stands for a path's own token."""
    return (xxhash.xxh3_64_intdigest(f"{path}\n{line}") - (1 << 63)) or 1


class Template(NamedTuple):
    """A host's main slots, its own lines, and its marked elements; ``marks`` None: the host has too few pages to tell, and hints are believed outside of articles."""

    roots: list[str]
    lines: frozenset[int] = frozenset()
    marks: frozenset[str] | None = None


def main_text(html: str | None, template: Template) -> str:
    """Text of the template's main slots; of a page that has none there, of its own article, else of all that does not stand apart.

    A slot that is no article is joined by what stands beside it: blocks of
    text beside it or the elements around it, and containers beside it unless
    most of their words on the page are in links.
    """
    blocks, _ = blocks_of(html or "")
    roots = template.roots
    cut = lambda article: template.marks if template.marks is not None else (frozenset() if article else None)
    lines = [(x.path, x.article, x.line(cut(x.article))) for x in blocks]
    if template.lines:
        own = [line_token(x.path, x.line()) in template.lines for x in blocks]
        lines, blocks = [x for x, o in zip(lines, own, strict=True) if not o], [x for x, o in zip(blocks, own, strict=True) if not o]
    words: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for x in blocks:
        for k in (0, 1):
            words[x.path][k] += x.words[k]
    lines = [x for x in lines if x[2]]
    chosen = [line for path, _, line in lines if inside(path, roots)]
    if chosen and len(roots) == 1 and article_root(roots[0]) is None:
        held = {path: beside(path, roots[0]) for path in words if not inside(path, roots)}
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for path, (place, _) in held.items():
            for k in (0, 1):
                sums[place][k] += words[path][k]
        kept = {path for path, (place, container) in held.items() if place and not (container and sums[place][1] > sums[place][0])}
        chosen = [line for path, _, line in lines if path in kept or inside(path, roots)]
    if not chosen:
        own_article = any(article for _, article, _ in lines)
        chosen = [line for _, article, line in lines if article or not own_article]
    return "\n".join(chosen)


_TOKENS = "host string, path string, line long, pages long, low long, high long, words long, linked long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By host and token: pages, the halves of a fingerprint of the occurrence vector, words, and words in links, as sums to be added up.

    The fingerprint is a sum over the pages, so that neither their order nor a
    page that is there twice makes different vectors equal.
    """
    sums: dict[tuple[str, str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])

    def handed_on() -> pa.RecordBatch:
        columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True))
        sums.clear()
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "line", "pages", "low", "high", "words", "linked"])

    for batch in batches:
        for page, host, html in zip(batch.column("page_id").to_pylist(), batch.column("host").to_pylist(), batch.column("html"), strict=True):
            text = html.as_py() or ""
            blocks, opened = blocks_of(text)
            counts: dict[tuple[str, int], list[int]] = {(path, 0): [n, 0, 0] for path, n in opened.items()}
            counts["", 0] = [1, sum(x.words[0] for x in blocks), sum(x.words[1] for x in blocks)]  # the page itself: a token that every page has once
            for x in blocks:
                if line := x.line():
                    got = counts.setdefault((x.path, line_token(x.path, line)), [0, 0, 0])
                    got[0] += 1
                    whole = counts.setdefault((x.path, 0), [0, 0, 0])
                    for k in (0, 1):
                        got[k + 1] += x.words[k]
                        whole[k + 1] += x.words[k]
            key = f"{page}:{len(text)}:"
            for (path, line), (n, words, linked) in counts.items():
                got = sums[host, path, line]
                mark = xxhash.xxh3_64_intdigest(f"{key}{n}")
                got[0] += 1
                got[1] += mark & 0xFFFFFFFF
                got[2] += mark >> 32
                got[3] += words
                got[4] += linked
            if len(sums) >= COUNTED:
                yield handed_on()
    if sums:
        yield handed_on()


def deduce(tokens: list[tuple[str, int, int, tuple[int, int], int, int]]) -> Template:
    """A host's template from (path, line, pages, vector, words, words in links) of its frequent tokens.

    A class is valid if it occurs on all pages or has two tokens or more, and
    nests: the parent of each of its tokens is a token of the template, too.
    """
    every = max((t[2] for t in tokens if not t[1]), default=0)
    marks = frozenset(t[0] for t in tokens if t[0].endswith("!") and not t[1] and t[2] >= MARK_PAGES) if every >= MARK_PAGES else None
    paths = [t for t in tokens if not t[1] and t[2] >= SUPPORT * every]
    # Lines of all pages are text of the template, not of its slots.
    fixed = [t for t in tokens if t[1] and t[2] == every >= LINE_PAGES]
    whole, shared = sum(t[4] for t in paths if t[0] == ""), sum(t[4] for t in fixed)
    if shared > COPY_SHARE * whole:
        fixed = []
    varying = defaultdict(int)
    for t in paths:
        varying[t[0]] += t[4] if t[0] else 0
    for t in fixed:
        varying[t[0]] -= t[4]
    classes = defaultdict(list)
    for t in paths:
        classes[t[3]].append(t)
    valid = {t[0] for c in classes.values() if len(c) > 1 or c[0][2] == every for t in c}
    template: set[str] = set()
    for path in sorted(valid, key=lambda p: (p.count("/"), p)):
        if path == "" or path.rpartition("/")[0] in template:
            template.add(path)
    slots = {p: varying[p] for p in template if varying[p] > 0}
    return Template(_main_slots(template, slots), frozenset(t[1] for t in fixed), marks)


def _main_slots(template: set[str], slots: dict[str, int]) -> list[str]:
    """The articles among the slots, else the innermost container that holds most of their words."""
    articles = sorted({r for p in slots if (r := article_root(p))})
    if articles:
        inner = [r for r in articles if "article" in r.rpartition("/")[2].split(".")[0]]
        return inner or articles
    total = left = sum(slots.values())
    at = best = ""
    for path in sorted(template, key=lambda p: (p.count("/"), p)):
        if path.rpartition("/")[2].split(".")[0] in CONTAINER and (inside(path, [at]) or at == ""):
            words = sum(w for p, w in slots.items() if inside(p, [path]))
            if words > MAIN_SHARE * total:
                at = path
                if best == "" or words < left:  # one that holds as much as the element around it leaves nothing out
                    best, left = path, words
    return [best] if total and best else []


_TEMPLATES = "host string, roots array<string>, lines array<long>, marks array<string>"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [deduce([(t["path"], t["line"], t["pages"], (t["low"], t["high"]), t["words"], t["linked"]) for t in tokens]) for tokens in batch.column("tokens").to_pylist()]
        columns = [batch.column("host"), pa.array([t.roots for t in found], pa.list_(pa.string())), pa.array([sorted(t.lines) for t in found], pa.list_(pa.int64())), pa.array([None if t.marks is None else sorted(t.marks) for t in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "roots", "lines", "marks"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, Template] = {}
        texts = []
        for html, host, roots, lines, marks in zip(*(batch.column(c) for c in ("html", "host", "roots", "lines", "marks")), strict=True):
            if (name := host.as_py()) not in known:
                known[name] = Template(roots.as_py() or [], frozenset(lines.as_py() or ()), None if marks.as_py() is None else frozenset(marks.as_py()))
            texts.append(main_text(html.as_py(), known[name]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame) -> DataFrame:
    """host, roots, lines and marks (see :class:`Template`) from page_id, host and html, over all pages of each host.

    Pages are counted where they are; a host with a third of all pages sends
    on its tokens, counted for each task, and they are summed up by token.
    What is gathered for a host are the tokens on a fair share of its pages,
    so it has the size of some pages.
    """
    counted = pages.select("page_id", "host", "html").mapInArrow(tidy(_count), _TOKENS)
    tokens = counted.groupBy("host", "path", "line").agg(*(F.sum(c).alias(c) for c in ("pages", "low", "high", "words", "linked")))
    tokens = scratch.stage(tokens.where((F.col("line") == 0) | (F.col("pages") >= LINE_PAGES)), "op6-tokens")
    n = tokens.where("path = '' and line = 0").select("host", F.col("pages").alias("n"))
    enough = F.when(F.col("line") != 0, F.col("pages") == F.col("n")).otherwise(
        (F.col("pages") >= F.lit(SUPPORT) * F.col("n")) | (F.col("path").endswith("!") & (F.col("pages") >= F.greatest(F.lit(float(MARK_PAGES)), F.lit(MARK_SUPPORT) * F.col("n")))))
    frequent = tokens.join(n, "host").where(enough)
    gathered = frequent.groupBy("host").agg(F.collect_list(F.struct("path", "line", "pages", "low", "high", "words", "linked")).alias("tokens"))
    return gathered.mapInArrow(_choose, _TEMPLATES)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    A null html counts as empty and has an empty text; so has a page without
    text outside of what stands apart.  Pages without a url, or with one that
    names no host, share the host of that empty name.  Character references
    are decoded after markup is removed.  The contents of script, style,
    textarea, title, iframe, noembed, noframes, xmp, svg, template and noscript
    are no text, up to the end tag or the end of the page (a self-closed svg is
    empty); the text in math is text.  A line that all pages of a host have, from
    LINE_PAGES pages on, is the template's; an element that its class or id
    marks is cut where MARK_PAGES pages repeat it (on a host of one page: where
    it stands outside of an article).  White space in a block becomes one
    space, and blocks follow each other by page order, one to a line.  Other
    columns are ignored; repeated rows are repeated; no rows give no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = scratch.stage(templates(rows), "op6-templates")
    small = found.count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(found) if small else found, "host", "left")
    return joined.select("page_id", "url", "host", "html", "roots", "lines", "marks").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
