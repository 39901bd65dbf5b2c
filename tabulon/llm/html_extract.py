"""Main-text extraction by minimum-cut labelling.

A page is parsed into text blocks, in page order, each with its path in the
document tree. A linear classifier on features of a block (length, share of
linked words, tags and names on its path) gives the cost of calling it content
and the cost of calling it boilerplate. These become capacities to the two
terminals of a graph; blocks next to each other, and blocks that share a near
ancestor, are joined by smoothness edges. A maximum flow yields the minimum
cut, and the blocks on the source's side are the main text.

Text that can never be shown as an article (scripts, styles, forms' controls,
comments, templates) is not parsed into blocks. Blocks inside an element that
declares itself navigation, header, footer, dialog or hidden by its tag, role
or style have a cost that no neighbour outweighs. A class or id that sounds so
is only a cost: layout wrappers are named alike, so the cut decides. It does
not count in the only article or main element within the named one, unless
another article has no such name around it.

Defined cases: a null or empty page, and one without content, gives an empty
text; unclosed and misnested tags are closed by their ancestors' ends; ties of
the cut go to boilerplate; pages of any length are read whole, with work per
page that grows about linearly with its blocks; repeated rows get the same
text; extra columns are ignored by the report. The pages are independent, so
the job is one map without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by what they mean for the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title svg math canvas iframe object select option textarea button datalist audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = frozenset("nav header footer aside menu dialog form".split())
CONTENT_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an open element of the first kind is closed by, besides its end.
CLOSED_BY = {
    "p": BLOCK - {"html", "body"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
}
# What may stand in a head; any other element ends it.
IN_HEAD = frozenset("head html meta link title base basefont bgsound noframes style script noscript template".split())
# Drawings and formulas, and the HTML elements that cannot stand in one and so end it.
FOREIGN = frozenset("svg math".split())
NOT_FOREIGN = frozenset("article aside b blockquote body br center code dd div dl dt em figure footer h1 h2 h3 h4 h5 h6 header hr i img li main nav ol p pre section small span strong sub sup table u ul".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|alert|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget\w*|cookies?\w*|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|search|share\w*|social\w*|comments?|comment\w*|disqus|repl(?:y|ies)|respond|related\w*|recommend\w*|pagination|pager|toolbar|copyright|legal|skip)(?:$|[\s_-])",
    re.I,
)
# Words of names that say nothing of the element itself: what a page has or lacks, and the heads of content.
SAYS_LITTLE = re.compile(r"(?<![^\s_-])(?:(?:has|no|with|without)[_-][\w-]*|(?:post|entry|article|story|content|main)[_-]+header)(?![\w-])", re.I)
HEADER_NAME = re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|prose)(?:$|[\s_-])", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())

# Weights of the block classifier, in units of the log-odds of content.
BIAS, PER_LOG_WORD, LINKED, IN_CONTENT, IN_NAMED, IN_BOILER, NAMED_BOILER, TEXT_TAG, SENTENCES, RIGHTS, COOKIES = -2.0, 1.1, -5.0, 4.0, 2.0, -40.0, -8.0, 1.0, 0.8, -4.0, -8.0
NEXT, SIBLING, COUSIN = 0.9, 0.6, 0.3

_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")
_COOKIES = re.compile(r"\bcookies\b", re.I)
_CONSENT = re.compile(r"\b(?:accept|agree|consent|by (?:using|continuing)|privacy policy|preferences|your experience)\b", re.I)
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses?|repl(?:y|ies))\s*(?:\(\d+\))?:?", re.I)
_UNCLOSED = re.compile(r"<[a-zA-Z/!?]")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.I)


@dataclass
class Node:
    tag: str
    up: Node | None
    depth: int
    hard: bool = False  # in an element that is boilerplate whatever is in it
    form: Node | None = None  # the outermost form around it
    content: bool = False
    named: bool = False
    mark: Node | None = None  # the element whose name sounds like boilerplate
    wholes: int = 0  # articles and main elements directly below such a mark; at the top, articles below none
    whole: bool = False  # in one of these
    words: int = 0  # of a form: words of the blocks in it
    block: Node | None = None  # the nearest block element

    @property
    def boiler(self) -> bool:
        return self.hard or self.form is not None


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    marked: bool = False
    boiler: bool = False


class BlockParser(HTMLParser):
    """Cuts a page into text blocks with their place in the tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", None, 0)
        self.blocks: list[Block] = []
        self.now: Block | None = None
        self.skip = self.links = 0
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip and not self._skipped_start(tag):
            return
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self._close(self.at.tag)
        if tag in BLOCK and self._inside("p", until=BLOCK - {"p"}) and tag in CLOSED_BY["p"]:
            self._close("p")
        if tag in BLOCK:
            self._end_block()
        if tag in VOID:
            if tag in ("br", "hr") and self.now:
                self.now.parts.append(" ")
            return
        self._open(tag, dict(attrs))
        if tag in DROPPED:
            self._end_block()
            self.skip += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:  # nothing is in it
            self._leave_skipped(tag)
            if not self.skip:
                self._end_block()
        elif not self.skip or not self._foreign():
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.skip:
            self._end_block()
        if self._inside(tag, until=frozenset() if tag in BLOCK else BLOCK - {tag}):
            self._close(tag)
        elif tag == "br" and self.now and not self.skip:
            self.now.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and not data.isspace():
            self._close("head")
        if self.skip or not data:
            return
        if not self.now:
            if data.isspace():
                return
            self.now = Block(self._block_node())
            self.blocks.append(self.now)
        self.now.parts.append(data)
        if self.links:
            self.now.linked += len(data.split())

    # ------------------------------------------------------------ the tree

    def _foreign(self) -> Node | None:
        """The drawing or formula that is open where no HTML may stand."""
        node = self.at if any(self.open[t] for t in FOREIGN) else self.top
        while node.up is not None and node.tag not in FOREIGN:
            if node.tag in INTEGRATION:
                return None
            node = node.up
        return node if node.up is not None else None

    def _leave_skipped(self, tag: str) -> None:
        """Close the dropped elements that a start tag ends."""
        if self.at.tag == "head" and tag not in IN_HEAD or tag == "body" and self.open["head"]:
            self._close("head")
        elif tag in NOT_FOREIGN and (node := self._foreign()):
            self._close(node.tag)
        elif tag == self.at.tag and tag in ("button", "option"):
            self._close(tag)

    def _skipped_start(self, tag: str) -> bool:
        """A start tag in a dropped element; true if that ends with it.

        All elements are kept on the path here too, so that an end tag is known
        as that of an element inside or of an ancestor.
        """
        self._leave_skipped(tag)
        if self.skip and tag not in VOID and tag not in ("html", "head", "body"):
            while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
                self._close(self.at.tag)
            self._enter(Node(tag, self.at, self.at.depth + 1))
            self.skip += tag in DROPPED
            self.links += tag == "a"
        return not self.skip

    def _enter(self, node: Node) -> None:
        node.block = node if node.tag in BLOCK else node.up.block
        self.at = node
        self.open[node.tag] += 1

    def _open(self, tag: str, attrs: dict[str, str | None]) -> None:
        up = self.at
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        role = (attrs.get("role") or "").lower()
        whole = up.form is not None and (tag in CONTENT_TAGS or role == "main")  # the article of a form that wraps the page
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        is_form = tag == "form" or role == "form"
        hard = up.hard and not whole or hidden or tag in BOILER_TAGS and not is_form and not (tag == "header" and up.content) or role in BOILER_ROLES and not is_form
        content = up.content or tag in CONTENT_TAGS or role == "main"
        named = up.named or bool(CONTENT_NAMES.search(names))
        mark, inside = up.mark, up.whole
        sounds = tag not in ("html", "body") and names.strip() != "" and self._sounds(names, up.content)
        if sounds and tag not in CONTENT_TAGS:  # what is around it says nothing of what is in it
            mark, inside, content, named = None, False, False, False
        elif mark and not inside and not sounds and (tag in CONTENT_TAGS or role == "main"):
            mark.wholes += 1
            inside = True
        elif sounds and mark and not inside:  # a comment or teaser that is an article of its own
            content, named = up.content, up.named
        elif not mark and tag == "article":
            self.top.wholes += 1
        node = Node(tag, up, up.depth + 1, hard, None if whole else up.form, content, named, mark, 0, inside)
        if is_form and not up.boiler:
            node.form = node
        if sounds and tag not in CONTENT_TAGS:
            node.mark = node
        self._enter(node)

    @staticmethod
    def _sounds(names: str, in_content: bool) -> bool:
        """True if a class or id sounds like boilerplate."""
        if not BOILER_NAMES.search(names):
            return False
        names = SAYS_LITTLE.sub(" ", names)
        return bool(BOILER_NAMES.search(HEADER_NAME.sub(" ", names) if in_content else names))

    def _inside(self, tag: str, until: frozenset[str] = frozenset()) -> bool:
        node = self.at if self.open[tag] else self.top
        while node.up is not None:
            if node.tag == tag:
                return True
            if node.tag in until:
                return False
            node = node.up
        return False

    def _close(self, tag: str) -> None:
        while self.at.up is not None:
            gone, self.at = self.at.tag, self.at.up
            self.open[gone] -= 1
            self.skip -= bool(self.skip) and gone in DROPPED
            self.links -= gone == "a"
            if gone == tag:
                return

    def _block_node(self) -> Node:
        node = self.at.block or self.top
        return self.at if self.at.boiler > node.boiler or self.at.mark is not node.mark else node

    def _end_block(self) -> None:
        self.now = None

    def finished(self) -> list[Block]:
        for b in self.blocks:
            b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
            mark = b.node.mark
            b.marked = mark is not None and not (b.node.whole and mark.wholes == 1 and not self.top.wholes)
            if b.node.form:
                b.node.form.words += len(b.text.split())
        blocks = [b for b in self.blocks if b.text]
        total = sum(len(b.text.split()) for b in blocks)
        for b in blocks:  # a form that holds most of the page's words wraps it; then the cut decides
            b.boiler = b.node.hard or b.node.form is not None and 2 * b.node.form.words <= total
        self._mark_comments(blocks)
        return blocks

    @staticmethod
    def _mark_comments(blocks: list[Block]) -> None:
        """What follows a heading like "12 Comments" within the same element is said by readers."""
        section: Node | None = None
        for b in blocks:
            if section is not None:
                node = b.node
                while node.up is not None and node.depth > section.depth:
                    node = node.up
                section = section if node is section else None
            if b.node.tag in HEADINGS and _COMMENTS.fullmatch(b.text):
                section = b.node.up
            b.marked = b.marked or section is not None


def parse_blocks(html: str) -> list[Block]:
    parser = BlockParser()
    parser.feed(html)
    if _UNCLOSED.match(parser.rawdata):  # a tag or comment that the page does not end is no text, as in browsers
        parser.rawdata = ""
    parser.close()
    return parser.finished()


# ---------------------------------------------------------------- the labelling


def content_score(block: Block) -> float:
    """Log-odds of content by the block alone."""
    words = len(block.text.split())
    node = block.node
    score = BIAS + PER_LOG_WORD * math.log1p(words) + LINKED * min(1.0, block.linked / max(1, words))
    score += IN_CONTENT * node.content + IN_NAMED * node.named + IN_BOILER * block.boiler + NAMED_BOILER * block.marked + TEXT_TAG * (node.tag in TEXT_TAGS)
    score += SENTENCES * min(3, len(_SENTENCE.findall(block.text))) + RIGHTS * bool(words < 40 and _RIGHTS.search(block.text))
    return score + COOKIES * bool(words < 80 and _COOKIES.search(block.text) and _CONSENT.search(block.text))


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: next in the page, and last block under the same parent or grandparent."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            out.append((k - 1, k, NEXT))
        up = b.node.up or b.node
        for node, weight in ((up, SIBLING), (up.up or up, COUSIN)):
            if (j := last.get(id(node))) is not None and j != k:
                out.append((j, k, weight))
            last[id(node)] = k
    return out


def min_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    A node with a positive score is tied to the source by it, one with a
    negative score to the sink. Shortest augmenting paths by levels; a node
    that is tied more strongly than all its edges together is decided by that
    alone, so what is searched are the doubtful nodes between.
    """
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    pull = [0.0] * n
    for a, b, w in links:
        pull[a] += w
        pull[b] += w
    for k, v in enumerate(scores):
        v = max(-pull[k] - 1, min(pull[k] + 1, v))  # more than all its edges decides it anyway
        if v > 0:
            arc(s, k, v, 0.0)
        elif v < 0:
            arc(k, t, -v, 0.0)
    for a, b, w in links:
        arc(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def main_text(html: str | None) -> str:
    """The main text of a page, one line per block."""
    blocks = parse_blocks(html or "")
    if not blocks:
        return ""
    labels = min_cut([content_score(b) for b in blocks], edges(blocks))
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each row in place of its html; a column of the text's name is replaced."""
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*kept, F.col(html_col).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], [*kept, out_col])

    return rows.mapInArrow(run, schema)


def extraction_report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    found = extract_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
