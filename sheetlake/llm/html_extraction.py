"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a row of tokens.  Words score zero to one, tags less than zero; the weights come from labelled
pages, those that mark their article themselves with an ``article`` or ``main`` element.  Words of a
kind of element that was content as often as not, or that is unknown, count in full, and less down to a
quarter the more often they stood outside; a tag costs the more, the more often it stood outside.  One linear scan
finds the contiguous region of greatest score; what lies in elements learned as no content inside the
region is left out of the text.  No element that holds the page's main article, or most of its words, is
left out, whatever its names say.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map

#: Labelled pages used for the weights: about so many, drawn by hash over all pages.
LABELLED = 2000
#: Rows of the learned table, those with the greatest counts; kinds beyond them weigh what their names say.
LEARNED = 100_000
#: Counts added to what labelled pages show, so that a corpus without them has weights too.
PRIOR = 20.0
#: Cost of a tag, by its log odds of standing outside: least, most and step.
TAG_LEAST, TAG_MOST, TAG_STEP = 0.1, 3.0, 1.0

#: Elements read as raw text up to their end tag, and elements that are left out with all they hold.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "iframe")}
APART = frozenset("svg foreignobject button select noscript template".split())
#: Parts of a page that no button or select holds, and inline tags that end an svg.
SECTIONS = frozenset("article aside body footer form header main nav section table".split())
AFTER_SVG = frozenset("b big br code em embed i img meta nobr ruby s small span strike strong sub sup tt u var".split())
#: Elements that start a block, elements without end tag.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "address article aside blockquote body details dialog div dl fieldset figure footer form head header html main "
    "menu nav ol section table ul".split()
)
CONTENT_NAMES = frozenset("article main".split())
OUTSIDE_NAMES = frozenset("nav aside footer header form menu head dialog fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer "
    "header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related "
    "reply replies reviews share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Parts of a class that make it say something about another element (has-sidebar, share-enabled).
ABOUT_OTHERS = frozenset("disabled enabled fixed has no with without".split())
#: Least score of a word that is not left out.
WORD_LEAST = 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|(?P<cut></?[a-zA-Z].*)|(?P<text>[^<]+|<)",
    re.S,
)
LABELS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLANK = re.compile(r"\s+")


@dataclass(slots=True, eq=False)
class Node:
    """An open container: what its names say, and what is known once its page has been read."""

    parent: Node | None
    name: str
    kind: str
    marked: bool = False  # an article or main that is not named as something else
    again: bool = False  # an ancestor is of the same kind
    words: int = 0  # in the subtree
    kept: bool = False  # holds the main article or most words, or is a header of that article
    article: bool = False  # is, or lies in, an article or main
    suspect: str = ""  # kind of the outermost ancestor that names say is no content
    out: bool = False
    stopped: bool = False
    content: bool = False
    spared: bool = False


@dataclass(slots=True)
class Token:
    """A tag (name, end, kind) or a stretch of text; ``node``: the innermost open container, ``own``: the tag's."""

    text: str | None
    node: Node
    name: str = ""
    end: bool = False
    kind: str = ""
    own: Node | None = None


def classes_of(rest: str) -> list[str]:
    """Whole words of class, id and role, in lower case."""
    return [w for m in LABELS.findall(rest) for w in "".join(m).lower().split()]


def kind_of(name: str, rest: str) -> str:
    """Name of an element with the parts of all words of its class, id and role.

    A word that speaks of other elements (has-sidebar) stays one part.
    """
    words = set()
    for word in classes_of(rest):
        parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
        words.update(["_".join(parts)] if ABOUT_OTHERS.intersection(parts) else parts)
    return ".".join([name, *sorted(words)])


def lexed(page: str) -> list[tuple[str | None, str, bool, str]]:
    """Texts, and names, ends and attributes of tags, in page order, without raw texts.

    Within an svg no element is raw; a tag that the page's end cuts short is dropped.
    """
    row: list[tuple[str | None, str, bool, str]] = []
    drawing: list[str] = []
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            row.append((m["text"], "", False, ""))
        elif m["name"] is not None:
            name, end, rest = m["name"].lower(), bool(m["end"]), m["rest"]
            if name == "svg" or name == "foreignobject" and drawing:
                if not end and not rest.endswith("/"):
                    drawing.append(name)
                elif end and name in drawing:
                    while drawing.pop() != name:
                        pass
            elif drawing and (name in BLOCK or name in AFTER_SVG and not end):
                while drawing and drawing[-1] == "svg":
                    drawing.pop()
            if name in RAW and not end and drawing[-1:] != ["svg"]:
                close = RAW[name].search(page, at)
                at = close.end() if close else n
            row.append((None, name, end, rest))
    return row


def closed(row: list[tuple[str | None, str, bool, str]]) -> set[int]:
    """Places of the start tags of elements left out that have an end tag of their own.

    A button or select ends at the next one, the others may nest.
    """
    found: set[int] = set()
    ends: Counter = Counter()
    for i in range(len(row) - 1, -1, -1):
        _, name, end, rest = row[i]
        if name not in APART:
            continue
        alone = name in ("button", "select")
        if end:
            ends[name] = 1 if alone else ends[name] + 1
        elif alone or not rest.endswith("/"):
            if ends[name]:
                found.add(i)
            ends[name] = 0 if alone else max(0, ends[name] - 1)
    return found


class Stack:
    """Open elements: names, nodes of containers, and where elements to be left out are."""

    def __init__(self, root: Node):
        self.rows: list[tuple[str, str, bool, Node]] = []  # name, kind, whether blocks may stand within, node
        self.root, self.apart = root, []
        self.names: Counter = Counter()
        self.kinds: Counter = Counter()

    @property
    def node(self) -> Node:
        return self.rows[-1][3] if self.rows else self.root

    def push(self, name: str, kind: str, holds: bool, node: Node) -> None:
        if name in APART:
            self.apart.append(len(self.rows))
        self.rows.append((name, kind, holds, node))
        self.names[name] += 1
        self.kinds[kind] += 1

    def cut(self, at: int) -> None:
        while len(self.rows) > at:
            name, kind, _, _ = self.rows.pop()
            self.names[name] -= 1
            self.kinds[kind] -= 1
        while self.apart and self.apart[-1] >= at:
            self.apart.pop()

    def last(self, name: str) -> int:
        """Place of the innermost open element of this name, -1 if a closed template or the like hides it."""
        if not self.names[name]:
            return -1
        for i in range(len(self.rows) - 1, -1, -1):
            if self.rows[i][0] == name:
                return i
            if self.rows[i][0] in ("template", "noscript", "select") and self.rows[i][2]:
                break
        return -1


def tokens(page: str) -> tuple[list[Token], list[Node]]:
    """Tags and texts in page order, and the containers; scripts, svgs and the like are gone; bad nesting is mended.

    An element left out whose end tag is missing ends with its parent or at the next block; an svg always
    does, as in browsers, but for what its foreignObject holds.
    """
    row = lexed(page)
    ended = closed(row)
    root = Node(None, "", "")
    nodes, out, stack = [root], [], Stack(root)
    for at, (text, name, end, rest) in enumerate(row):
        if text is not None:
            if not stack.apart:
                token = Token(html.unescape(text), stack.node)
                token.node.words += len(token.text.split())
                out.append(token)
            continue
        kind, own = name, None
        if stack.apart and (name in BLOCK or name in AFTER_SVG and not end):
            while stack.apart:
                x, _, holds, _ = stack.rows[stack.apart[-1]]
                if x != "svg" and (name not in BLOCK or holds and (end or name not in SECTIONS or x not in ("button", "select"))):
                    break
                stack.cut(stack.apart[-1])
        elif not end and name in ("button", "select", "input", "textarea"):
            i = stack.last(name if name == "button" else "select")
            if i >= 0:
                stack.cut(i)
        if name in CONTAINERS or name in APART:
            if not end:
                node = stack.node
                if name in CONTAINERS:
                    kind = kind_of(name, rest)
                    marked = name in CONTENT_NAMES and not OUTSIDE_WORDS.intersection(classes_of(rest))
                    own = node = Node(stack.node, name, kind, marked, stack.kinds[kind] > 0)
                    nodes.append(node)
                if name not in ("svg", "foreignobject") or not rest.endswith("/") and (stack.apart or name == "svg"):
                    stack.push(name, kind, at in ended, node)
            else:
                i = stack.last(name)
                if i >= 0:
                    _, kind, _, node = stack.rows[i]
                    own = node if name in CONTAINERS else None
                    stack.cut(i)
        if not stack.apart and name not in APART and (end or name not in RAW):
            out.append(Token(None, stack.node, name, end, kind, own))
    _keep(nodes)
    return out, nodes


def _keep(nodes: list[Node]) -> None:
    """Sum words up, and mark what may not be left out: the way to the main article and what holds most words."""
    for node in reversed(nodes[1:]):
        node.parent.words += node.words
    most = max((n.words for n in nodes if n.marked), default=0)
    for node in reversed(nodes):
        if node.name in ("html", "body") or node.marked and 2 * node.words >= most or 2 * node.words > nodes[0].words:
            node.kept = True
        if node.kept and node.parent is not None and (node.marked or node.article):
            node.parent.kept = node.parent.article = True  # for now: on the way to an article
    for node in nodes:
        node.article = node.name in CONTENT_NAMES or node.parent is not None and node.parent.article
        if node.name == "header" and node.parent.kept and node.parent.article:
            node.kept = node.kept or not OUTSIDE_WORDS.intersection(node.kind.split(".")[1:])
        node.suspect = node.parent.suspect if node.parent is not None else ""
        if not node.suspect and not node.kept and prior(node.kind) < 0:
            node.suspect = node.kind


def prior(kind: str) -> float:
    """What the names alone say: above zero for content, below for the rest of a page."""
    name, *words = kind.split(".")
    if name in OUTSIDE_NAMES or OUTSIDE_WORDS.intersection(words):
        return -1.0
    return 1.0 if name in CONTENT_NAMES or CONTENT_WORDS.intersection(words) else 0.0


@dataclass
class Weights:
    """Log odds of content for words by container kind and for tags, from labelled pages."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def odds(self, table: dict[str, float], kind: str) -> float:
        found = table.get(kind)
        return prior(kind) * math.log(PRIOR) if found is None else found

    def settle(self, nodes: list[Node]) -> None:
        """What is left out: containers of a kind that holds no content, and all within them.

        ``spared``: left out of a content container, or within what is left out of one; tags of ``html`` and
        ``body`` stand outside any article, whatever their classes say.
        """
        for node in nodes[1:]:
            up = node.parent
            own = not node.kept and self.odds(self.words, node.kind) < -1
            node.out, node.stopped, node.content, node.spared = up.out or own, up.stopped, up.content, up.spared
            if not node.stopped:
                if own:
                    node.stopped, node.spared = True, up.content
                else:
                    node.content |= node.name not in ("html", "body") and self.odds(self.tags, node.kind) > 1

    def word(self, node: Node) -> float:
        """Score of a word in a container."""
        if node.out:
            return 0.0
        return max(WORD_LEAST, 1.0 + min(0.0, self.odds(self.words, node.kind))) if node.kind and not node.kept else 1.0

    def tag(self, t: Token) -> float:
        """Cost of a tag; none for those of what is left out within content, which would cut it at its edges."""
        if (t.own if t.end and t.own is not None else t.node).spared:
            return 0.0
        held = t.node.parent is not None and t.node.parent.out
        odds = 0.0 if held else self.odds(self.tags, t.kind)
        if t.own is not None and t.own.kept:
            odds = max(odds, 0.0)
        return -min(TAG_MOST, max(TAG_LEAST, -odds * TAG_STEP))


def learned(counts: Counter) -> Weights:
    """Weights from counts of (``w`` or ``t``, kind, inside the article or not)."""
    weights = Weights()
    for what, kind in {(w, k) for w, k, _ in counts}:
        believed = PRIOR * prior(kind)
        into = counts[what, kind, True] + max(believed, 0) + 1
        out = counts[what, kind, False] + max(-believed, 0) + 1
        (weights.words if what == "w" else weights.tags)[kind] = math.log(into / out)
    return weights


def label_counts(page: str) -> Counter | None:
    """Counts of one page that marks its article, None for any other page."""
    counts: Counter = Counter()
    row, nodes = tokens(page)
    if not any(n.name in CONTENT_NAMES for n in nodes):
        return None
    held: dict[int, int] = {}
    for t in row:
        inside = t.node.article and not t.node.suspect
        if t.text is not None:
            n = len(t.text.split())
            # outside the article only the outermost suspect is to blame, else the innermost container
            if inside:
                held[id(t.node)] = held.get(id(t.node), 0) + n
            elif t.node.kind:
                counts["w", t.node.suspect or t.node.kind, False] += n
        elif not t.node.suspect or t.kind == t.node.suspect:
            counts["t", t.kind, inside or t.name in CONTENT_NAMES] += 1
    for node in reversed(nodes[1:]):
        n = held.get(id(node), 0)
        if n:
            held[id(node.parent)] = held.get(id(node.parent), 0) + n
            if not node.again:
                counts["w", node.kind, True] += n
    return counts


def best_span(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch of greatest sum over zero, the first of equals; empty if there is none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    row, nodes = tokens(page or "")
    weights.settle(nodes)
    span = best_span([weights.tag(t) if t.text is None else weights.word(t.node) * len(t.text.split()) for t in row])
    blocks, parts = [], []
    for t in row[slice(*span)]:
        if t.text is not None:
            if not t.node.out:
                parts.append(t.text)
        elif t.name in BLOCK:
            blocks.append("".join(parts))
            parts = []
        elif t.name == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    return "\n\n".join(b for b in (BLANK.sub(" ", x).strip() for x in blocks) if b)


def learn_weights(pages: DataFrame, sample: int = LABELLED) -> Weights:
    """Weights from about ``sample`` pages drawn by hash from all of ``pages`` (html)."""
    total = pages.count()
    share = min(1.0, sample / total) if total else 1.0
    drawn = pages.select("html").where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                met.update(label_counts(page.as_py() or "") or {})
        if met:
            rows = [(w, k, i, n) for (w, k, i), n in met.items()]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                  names=["what", "kind", "held", "n"])

    rows = arrow_map(drawn, count, "what string, kind string, held boolean, n long")
    summed = rows.groupBy("what", "kind").agg(*(F.sum(F.when(F.col("held") == h, F.col("n"))).alias(str(h)) for h in (True, False)))
    n = F.coalesce("True", F.lit(0)) + F.coalesce("False", F.lit(0))
    top = summed.orderBy(n.desc(), "what", "kind").limit(LEARNED).collect()
    return learned(Counter({(r["what"], r["kind"], h): r[str(h)] for r in top for h in (True, False) if r[str(h)] is not None}))


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without content, give an empty text.  Repeated rows and null ids come
    back as they are; of equally good regions the first is taken; an empty table gives no rows.
    """
    weights = weights or learn_weights(pages)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(p.as_py(), weights) for p in part.column(2)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return arrow_map(pages.select("page_id", "url", "html"), emit, "page_id long, url string, text string, n_chars long")
