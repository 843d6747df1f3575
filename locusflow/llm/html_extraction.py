"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes a row of text blocks with their place in the element tree.  A linear
classifier over a block's surroundings, links and words gives the cost of calling it
content or boilerplate: the capacities to the two terminals.  Neighbouring blocks, and
blocks of one parent element, are joined by smoothness edges that are the stronger the
nearer they are in the tree.  The minimum cut is the cheapest labelling.

The classifier is fitted on a bounded sample of the pages themselves.  Pages that mark
their main part (``article``, ``main``) teach what content looks like elsewhere; what
the pages do not show is left to prior weights.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_and_text, sliced, texts_of

# Element names of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html".split())
PARAGRAPHS = frozenset("p pre blockquote td figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies"
    " footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo"
    " promoted related search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe"
    " subscription tags teaser toc toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond shoutbox".split())
#: Words that may follow in a name of comments; others make it a name of something else (a policy, a state).
COMMENT_PARTS = frozenset(
    "area author avatar block body bottom box button container content count counter date entry feed footer form header holder inner item label"
    " link links list main meta section single text thread threads title tools top tree wrap wrapper".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text".split())
#: A class name that begins so says what a page has or does, not what an element is.
MODIFIERS = frozenset("has hide is no not show with without".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
DELIMITER = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("bias", "length", "short", "links", "paragraph", "heading", "item", "sentence", "sign", "content name", "boilerplate name", "comment name")
#: Weights (log-odds of content) where the pages do not say otherwise, and those of what marks the pages that teach.
PRIOR = np.array([-1.0, 2.0, -0.5, -4.0, 1.0, 0.5, 0.2, 0.5, -1.5, 1.5, -5.5, -9.0])
#: Places that the words of a block are hashed to; what each says is learnt from the pages alone, so their prior weights are 0.
WORD_PLACES = 256
PRIOR = np.concatenate([PRIOR, np.zeros(WORD_PLACES)])
#: What is left of a comment's name inside a marked main part.
INSIDE_MAIN = 0.8
MAIN, BOILERPLATE, UNSEEN = 1.5, -5.5, -9.0
#: How many of the pages' blocks weigh as much as the prior.
PRIOR_BLOCKS = 50
#: What a name loses with each element between it and the block.
FADE = 0.9
#: An element that has more than this share of a page's words wraps the page, whatever its name.
WRAPPER = 0.6
LONGEST = 40
NEIGHBOUR, SIBLING = 300, 120


@dataclass
class Named:
    """An element with a telling name, or a form."""

    kind: str  # content, boilerplate, comment or form
    outer: int  # the one around it, or -1
    depth: int
    words: int = 0
    holds_main: bool = False  # it is or holds a marked main part


@dataclass
class Block:
    text: str
    words: int
    tag: str
    depth: int
    parent: int  # number of the element around it
    apart: int  # steps in the tree to the block before
    named: int  # the innermost named element around it, or -1
    part: str  # main, boilerplate, unseen or empty
    linked: float  # share of the characters that are in links


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    named: list[Named] = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), values[0] or values[1] or values[2])
    return out


def name_kind(attributes: dict[str, str]) -> str:
    """What the class names and the id of an element say about it (empty: nothing, or both)."""
    kinds = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = WORDS.findall(CAMEL.sub(" ", name).lower())
        if not words or words[0] in MODIFIERS:
            continue
        said = [k for k, w in enumerate(words) if w in COMMENT_WORDS]
        if said and COMMENT_PARTS.issuperset(words[said[-1] + 1 :]):
            return "comment"
        if BOILERPLATE_WORDS.intersection(words):
            kinds.add("boilerplate")
        elif MAIN_WORDS.intersection(words):
            kinds.add("content")
    return kinds.pop() if len(kinds) == 1 else ""


def part_of(tag: str, attributes: dict[str, str], outer: str) -> str:
    """The part of a page that an element opens inside a part ``outer``; boilerplate holds no main part."""
    style = attributes.get("style", "")
    if outer == "unseen" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or (style and INVISIBLE.search(style)):
        return "unseen"
    role = attributes.get("role", "").lower()
    if outer == "boilerplate" or tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or (tag == "header" and outer != "main"):
        return "boilerplate"
    return "main" if tag in MAIN_TAGS or role in ("main", "article") else outer


class Tags:
    """The markup of a page, each character of which is passed a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place after the tag that begins at ``at``, or -1: it is not closed."""
        page, i = self.page, at
        while self.quotes:
            mark = DELIMITER.search(page, i)
            if mark is None:
                break
            if mark[0] == ">":
                return mark.end()
            i = page.find(mark[0], mark.end()) + 1
            if not i:
                break
        self.quotes = False  # quotes do not match up: from here on they are letters
        return page.find(">", at) + 1 or -1

    def after_raw(self, tag: str, at: int) -> int:
        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        return (self.page.find(">", close.end()) + 1 if close else 0) or len(self.page)


def read_page(page: str) -> Page:
    """Text blocks in page order.  Only block-level tags part them; unclosed elements end with their parent."""
    out, tags = Page(), Tags(page)
    # tag, number, part, named
    stack: list[tuple[str, int, str, int]] = [("", 0, "", -1)]
    open_tags: Counter[str] = Counter()
    blocks_open = [0]  # places in the stack of what is not inline
    texts: list[str] = []
    linked = size = number = 0
    low, former = 0, 0  # least depth since the last block, and that one's depth

    def flush() -> None:
        nonlocal linked, size, low, former
        text = "".join(texts)
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            place = blocks_open[-1]
            tag, parent, part, named = stack[place]
            depth = len(blocks_open)
            words = text.count(" ") + 1
            outer = stack[blocks_open[-2]][1] if tag in PARAGRAPHS | HEADINGS | ITEMS and depth > 1 else parent
            out.blocks.append(Block(text, words, tag, depth, outer, former + depth - 2 * min(low, depth), named, part, linked / max(size, 1)))
            if named >= 0:
                out.named[named].words += words
            low = former = depth
        texts.clear()
        linked = size = 0

    def add(text: str) -> None:
        nonlocal linked, size
        if text:
            texts.append(text)
            letters = len(text) - text.count(" ")
            size += letters
            if open_tags["a"]:
                linked += letters

    def close(names: tuple[str, ...], scope: frozenset[str] = frozenset()) -> None:
        nonlocal low
        if not any(open_tags[n] for n in names):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                for tag, *_ in stack[at:]:
                    open_tags[tag] -= 1
                del stack[at:]
                while blocks_open[-1] >= len(stack):
                    blocks_open.pop()
                low = min(low, len(blocks_open))
                return
            if stack[at][0] in scope:
                return

    at = begin = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = COMMENT.match(page, at).end()
            tag = None
        elif page.startswith(("<!", "<?"), at):
            end, tag = page.find(">", at) + 1 or len(page), None
        elif (name := NAME.match(page, at)) is not None:
            end = tags.end(name.end())
            if end < 0:
                end = len(page)  # the page ends inside a tag
                add(page[begin:at])
                begin = at = end
                break
            ending = page[at + 1] == "/"
            tag = name[0][2 if ending else 1 :].lower()
        else:
            at += 1
            continue
        add(page[begin:at])
        inside = page[name.end() : end - 1] if tag is not None else ""
        begin = at = end
        if tag is None:
            continue
        if tag in RAW:
            if not ending and not inside.endswith("/"):
                begin = at = tags.after_raw(tag, at)
            flush() if tag not in ("script", "style") else None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if ending:
            close((tag,))
        elif tag not in VOID:
            if tag in ENDS_PARAGRAPH:
                close(("p",))
            if tag in CLOSES:
                close(CLOSES[tag], SCOPES)
            number += 1
            open_tags[tag] += 1
            _, _, part, named = stack[-1]
            if tag not in INLINE:
                attributes = attributes_of(inside) if inside.strip(" /") else {}
                outer = part
                part = part_of(tag, attributes, part)
                kind = "form" if tag == "form" else name_kind(attributes) if attributes and tag not in ("body", "html") else ""
                if kind:
                    out.named.append(Named(kind, named, len(blocks_open) + 1))
                    named = len(out.named) - 1
                around = named if part == "main" != outer else -1
                while around >= 0 and not out.named[around].holds_main:
                    out.named[around].holds_main = True
                    around = out.named[around].outer
                blocks_open.append(len(stack))
            stack.append((tag, number, part, named))
    add(page[begin:])
    flush()
    return out


def features(page: Page) -> np.ndarray:
    """A row for each block: ``FEATURES``, then all its words at the places they are hashed to, as square roots of their shares."""
    total = sum(b.words for b in page.blocks)
    for x in reversed(page.named):
        if x.outer >= 0:
            page.named[x.outer].words += x.words
    telling: list[int] = [*range(len(page.named)), -1]  # itself, or what is around it; -1 stays
    for k, x in enumerate(page.named):
        wraps = x.kind in ("boilerplate", "form") or (x.kind == "comment" and x.holds_main)
        if wraps and x.words > WRAPPER * total:
            telling[k] = telling[x.outer]
    column = {"content": 9, "boilerplate": 10, "form": 10, "comment": 11}
    out = np.zeros((len(page.blocks), len(FEATURES) + WORD_PLACES))
    for row, block in zip(out, page.blocks, strict=True):
        row[:9] = (
            1.0, np.log1p(min(block.words, LONGEST)) / np.log1p(LONGEST), block.words < 4, block.linked, block.tag in PARAGRAPHS, block.tag in HEADINGS,
            block.tag in ITEMS, block.text[-1] in ".!?:;\"')\u201d\u2026\u3002" and block.words > 3, block.text[0] == "\N{COPYRIGHT SIGN}",
        )
        named = block.named
        for _ in range(2):  # the two innermost names that do not wrap the page
            named = telling[named]
            if named < 0:
                break
            x = page.named[named]
            here = INSIDE_MAIN if x.kind == "comment" and block.part == "main" else 1.0
            row[column[x.kind]] = max(row[column[x.kind]], here * FADE ** min(block.depth - x.depth, 5))
            named = x.outer
        places = [crc32(w) % WORD_PLACES for w in block.text.lower().encode("utf-8", "surrogatepass").split()]
        row[len(FEATURES) :] = np.bincount(places, minlength=WORD_PLACES) / len(places)
    np.sqrt(out[:, len(FEATURES) :], out=out[:, len(FEATURES) :])
    return out


def content_scores(page: Page, weights: np.ndarray) -> list[int]:
    """The log-odds of content of each block, in hundredths."""
    if not page.blocks:
        return []
    part = {"main": MAIN, "boilerplate": BOILERPLATE, "unseen": UNSEEN, "": 0.0}
    scores = features(page) @ weights + [part[b.part] for b in page.blocks]
    return np.rint(100 * scores).astype(int).tolist()


def smoothness_edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity) for neighbours, and for each block and the last one before it with its parent."""
    edges, last = [], {}
    for j, block in enumerate(blocks):
        if j:
            edges.append((j - 1, j, NEIGHBOUR // (block.apart + 2)))
        if block.parent in last:
            edges.append((last[block.parent], j, SIBLING))
        last[block.parent] = j
    return edges


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (Dinic's maximum flow).

    A positive score is a node's capacity from the source, a negative one its capacity to
    the sink.  A node whose terminal outweighs all its edges is on that side in every
    minimum cut, so it is settled beforehand, and its edges become terminal capacities.
    """
    n = len(scores)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    terminal = list(scores)
    side: list[bool | None] = [None] * n
    rest = [sum(c for _, c in x) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(terminal[i]) > rest[i]:
            side[i] = terminal[i] > 0
            for j, c in near[i]:
                if side[j] is None:
                    terminal[j] += c if side[i] else -c
                    rest[j] -= c
                    queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return [bool(s) for s in side]
    number = {node: k for k, node in enumerate(left)}
    source, sink = len(left), len(left) + 1
    graph: list[list[int]] = [[] for _ in range(len(left) + 2)]
    to: list[int] = []
    capacity: list[int] = []

    def join(a: int, b: int, forward: int, backward: int) -> None:
        for x, y, c in ((a, b, forward), (b, a, backward)):
            graph[x].append(len(to))
            to.append(y)
            capacity.append(c)

    for i in left:
        if terminal[i] > 0:
            join(source, number[i], terminal[i], 0)
        elif terminal[i] < 0:
            join(number[i], sink, -terminal[i], 0)
    for a, b, c in edges:
        if side[a] is None and side[b] is None and c:
            join(number[a], number[b], c, c)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if capacity[e] and to[e] not in level:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if sink not in level:
            break
        place = [0] * len(graph)
        path: list[int] = []
        x = source
        while True:  # augmenting paths along the levels, by an explicit stack
            if x == sink:
                flow = min(capacity[e] for e in path)
                for e in path:
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not capacity[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while place[x] < len(graph[x]):
                e = graph[x][place[x]]
                if capacity[e] and level.get(to[e]) == level[x] + 1:
                    break
                place[x] += 1
            if place[x] < len(graph[x]):
                path.append(graph[x][place[x]])
                x = to[path[-1]]
            elif path:
                e = path.pop()
                x = to[e ^ 1]
                place[x] += 1
            else:
                break
    for i in left:
        side[i] = number[i] in level
    return [bool(s) for s in side]


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to ``PRIOR`` as if by ``PRIOR_BLOCKS`` blocks; both classes weigh the same.  Steps that go too far are halved."""
    w = PRIOR.copy()
    if len(set(y.tolist())) < 2:
        return w
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * PRIOR_BLOCKS

    def loss(w: np.ndarray) -> float:
        return balance @ np.logaddexp(0, (1 - 2 * y) * (x @ w)) + (w - PRIOR) @ (w - PRIOR) / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (balance * (y - p)) - (w - PRIOR)
        bend = (x * (balance * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(bend, pull)
        while np.abs(step).max() >= 1e-6 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(pages: DataFrame, html: str = "html", sample: int = 500, blocks: int = 64) -> np.ndarray:
    """Weights of the classifier, fitted on about ``sample`` pages chosen by hash and up to ``blocks`` blocks of each.

    Never over twice ``sample`` pages.  The blocks inside and outside of a marked main part
    are the two classes; pages without one teach nothing.
    """
    rows = pages.select(F.col(html).cast("string").alias("html")).where("html is not null")
    share = min(1.0, sample / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64("html", F.lit(13)), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * sample)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            xs, ys = [], []
            for text in texts_of(batch.column("html")):
                page = read_page(text)
                own = [k for k, b in enumerate(page.blocks) if b.part != "unseen"]
                if not any(page.blocks[k].part == "main" for k in own):
                    continue
                chosen = [own[k * len(own) // blocks] for k in range(blocks)] if len(own) > blocks else own
                xs.append(features(page)[chosen].astype(np.float32).tobytes())
                ys.append(bytes(page.blocks[k].part == "main" for k in chosen))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    found = sorted((bytes(r["x"]), bytes(r["y"])) for r in drawn.mapInArrow(task, "x binary, y binary").collect())
    x = np.frombuffer(b"".join(a for a, _ in found), np.float32).reshape(-1, len(PRIOR)).astype(np.float64)
    return fit_weights(x, np.frombuffer(b"".join(b for _, b in found), np.uint8).astype(int))


def labels(page: Page, weights: np.ndarray) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    return minimum_cut(content_scores(page, weights), smoothness_edges(page.blocks))


def main_text(html: str, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page in order, joined by one space (empty if there are none)."""
    page = read_page(html)
    return " ".join(b.text for b, content in zip(page.blocks, labels(page, weights), strict=True) if content)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: np.ndarray | None = None) -> DataFrame:
    """``keep``, text and n_chars (code points) for every page; null or empty html gives an empty text.

    Broken markup (unclosed elements, quotes that do not match up, a page cut off) is read
    as far as it goes.  ``weights`` are fitted on ``pages`` if none are given.  ``keep``
    columns must not be named text or n_chars.
    """
    fitted = fit(pages, html) if weights is None else weights
    rows, names, schema = kept_and_text(pages, keep, html)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html):
            texts = [main_text(page, fitted) for page in texts_of(batch.column(html))]
            columns = [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return rows.mapInArrow(task, f"{schema}, text string, n_chars long")
