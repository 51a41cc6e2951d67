"""Main text of HTML pages by site template removal.

Every page is parsed into a tree. Spark counts per host on how many pages each block subtree stands, in two
forms: as it is, by a hash of its tags, names and texts; and as a slot, by a hash of the tags and names on
the way to it, with the words it holds. A subtree on many pages of its host is template, whatever its tag;
so is a named or sectioning slot that most pages fill, each time with other words, but with little of the
text of the host (adverts, menus, footers). Both are deleted first. Text blocks inside an article or main
element are template only where most distinct articles of the host have them, so that copied articles
stay whole and sentences that some articles share stay in them; a table cell goes with its row or not at
all. Elements that are never article by their tag, role or whole class name go too, for hosts of few pages.
Of what is left, the article or main elements (the body where there are none) are the main text, block by
block.

Defined cases: null html counts as empty and gives an empty text; markup cut off at the end of a page
is dropped as browsers do, the text before it stays; a null url has the empty host; a very long or deeply
nested page is parsed whole, without recursion; repeated rows are extracted alike and count once each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.url_reputation import split_url
from lexivec.session import materialise

#: A subtree is template on at least so many pages and this share of the pages of its host.
MIN_PAGES = 5
MIN_SHARE = 0.2
#: Or, unless it is a text block, beside so many distinct main texts, however large the host.
MIN_ARTICLES = 30
#: A text block inside the article is template in this share of the distinct main texts of its host.
TEXT_SHARE = 0.5
#: A slot is template on this share of the pages of its host, with at most that share of the host's words.
SLOT_SHARE = 0.5
SLOT_WORDS = 0.2
#: Told apart from the same block outside an article, and from slots, by these in their hashes.
WITHIN = 0x5555555555555555
#: Template hashes that are broadcast at most (16 bytes each); more are joined by host.
BROADCAST_ROWS = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody tfoot thead tr ul".split()
)
#: Blocks that hold running text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr figcaption caption br hr".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup".split())
NOT_ARTICLE = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe svg canvas object"
    " embed dialog menu title xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: A class name or id says what is never article if all of its parts are here, one of them in the first line.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr"
    " notice nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer comment comments disqus respond share sharing"
    " social subscribe newsletter popup modal related widget widgets".split()
)
BESIDE = frozenset(
    "site page main global top bottom left right header primary secondary block box item items list wrapper container inner outer"
    " content section area group bar link links button buttons form text post posts article articles reader user bio js".split()
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\W\d_]+")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """An element: ``children`` are strings and nodes. ``annotate`` fills the last five."""

    __slots__ = ("tag", "names", "role", "hidden", "children", "digest", "slot", "words", "inside", "heads")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.hidden = tag, "", "", False
        self.children: list = []
        self.digest = self.slot = self.words = 0
        self.inside = self.heads = False
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "role":
                    self.role = value.strip().lower()
                elif name in ("class", "id"):
                    self.names += " " + value
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    self.hidden = True


def parse(source: str) -> Node:
    """The tree of a page: void, raw and optional-end-tag rules of HTML, wrong nesting closed."""
    root = Node("#root")
    open_ = [root]
    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            open_[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            open_[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or source[at - 1] != ">":
            continue
        if m[1] or m[4]:
            _close(open_, tag)
            continue
        _imply(open_, tag)
        attributes = m[3] or m[6] or ""
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            node.children.append(source[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID:
            open_.append(node)
    return root


def _close(open_: list[Node], tag: str) -> None:
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag == tag:
            del open_[i:]
            return
        if open_[i].tag in ("article", "main", "body", "table", "div", "section") and tag not in BLOCKS:
            return


#: Open elements that a new one ends, and the elements beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}


def _imply(open_: list[Node], tag: str) -> None:
    if tag in CLOSES_P:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag == "p":
                del open_[i:]
                break
            if open_[i].tag in BLOCKS:
                break
    if tag in ENDS:
        ended, limit = ENDS[tag]
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in limit:
                break
            if open_[i].tag in ended:
                del open_[i:]
                break


def annotate(root: Node) -> list[Node]:
    """The elements of a page in order, with their hashes, words and whether they are inside an article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        inside = node.inside or is_root(node)
        for c in reversed(node.children):
            if not isinstance(c, str):
                c.inside = inside
                c.slot = xxhash.xxh64_intdigest(f"{node.slot}>{c.tag}{c.names}")
                stack.append(c)
    for node in reversed(order):
        parts = [node.tag, node.names]
        node.heads = node.tag == "h1"
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                node.words += len(words)
                parts.append(" ".join(words))
            else:
                node.words += c.words if c.tag not in RAW else 0
                node.heads = node.heads or c.heads
                parts.append(f"<{c.digest}>")
        node.digest = xxhash.xxh64_intdigest("\x00".join(parts)) - 2**63
    return order


def is_root(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article")


def says_beside(names: str) -> bool:
    """Whether one of the class names or ids tells, as a whole, that an element is not article."""
    for name in names.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if any(p in TELLING for p in parts) and all(p in TELLING or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


def not_article(node: Node) -> bool:
    """Whether an element is never part of the article, by what it says of itself."""
    if node.tag in NOT_ARTICLE or node.role in ROLES or node.hidden or (node.tag == "header" and not node.inside):
        return True
    return bool(node.names) and node.tag not in ("html", "body", "main") and says_beside(node.names)


#: Kinds of rows that are counted: other blocks, text blocks outside and inside an article, slots, whole pages.
OTHER, TEXT, INSIDE, SLOT, PAGE = range(5)


def block_kind(node: Node) -> int | None:
    """How recurrence judges an element as it is; None: not at all."""
    if node.tag not in BLOCKS or node.tag in ("html", "body") or is_root(node) or (node.inside and node.tag == "hr"):
        return None
    return OTHER if node.tag not in TEXT_BLOCKS else INSIDE if node.inside else TEXT


def block_key(node: Node, kind: int) -> int:
    return node.digest ^ WITHIN if kind == INSIDE else node.digest


def slot_key(node: Node) -> int | None:
    """The hash of the slot that an element fills; None if it isn't judged as one.

    Blocks with a name and sections have slots; those inside an article, or with its title, don't.
    """
    named = node.tag in BLOCKS and node.names and node.tag not in ("html", "body")
    if node.inside or node.heads or not (named or node.tag in ("nav", "aside", "footer", "header", "form")):
        return None
    return (node.slot ^ (WITHIN << 1)) - 2**63


def judged(order: list[Node]) -> dict[int, tuple[int, int]]:
    """Hashes of what recurrence may delete from a page: their kinds, and the words of slots."""
    found: dict[int, tuple[int, int]] = {}
    for node in order:
        kind = block_kind(node)
        if kind is not None:
            found[block_key(node, kind)] = kind, 0
        slot = slot_key(node)
        if slot is not None:
            found[slot] = SLOT, found.get(slot, (SLOT, 0))[1] + node.words
    return found


def main_text(root: Node, template: frozenset[int] | set[int], by_name: bool = True, by_root: bool = True) -> str:
    """The blocks of the article that are left, one per line. ``root`` is annotated.

    ``by_name`` and ``by_root`` switch off the rules beside recurrence, to see what that does alone.
    """

    def gone(node: Node) -> bool:
        if template:
            kind = block_kind(node)
            if kind is not None and block_key(node, kind) in template:
                return True
            slot = slot_key(node)
            if slot is not None and slot in template:
                return True
        return not_article(node) if by_name else node.tag in RAW or node.tag == "head"

    roots: list[Node] = []
    stack = [root]
    while stack and by_root:
        node = stack.pop()
        if is_root(node):
            roots.append(node)
            continue
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not gone(c)]
    roots = [r for r in roots if not gone(r)]
    starts = {id(r) for r in roots}
    inside = bool(roots)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    work: list = list(reversed(roots or [root]))
    while work:
        item = work.pop()
        if item is flush:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif id(item) in starts or item is root or not gone(item):
            if item.tag in BLOCKS or item.tag == "#root":
                flush()
                work.append(flush)
            elif item.tag in ("br", "td", "th", "img", "wbr"):
                line.append("" if item.tag == "wbr" else " ")
            work += reversed(item.children)
        elif inside and item.tag in BLOCKS and item.tag in TEXT_BLOCKS:
            flush()
    flush()
    return "\n".join(blocks)


def parsed(page: str) -> tuple[Node, list[Node]]:
    root = parse(page)
    return root, annotate(root)


COUNTED = "host long, subtree long, kind int, article long, words long"


def _hash_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows: list[tuple[int, int, int, int, int]] = []
        for host, page in zip(part.column("host").to_pylist(), part.column("html")):
            root, order = parsed(page.as_py())
            article = xxhash.xxh64_intdigest(main_text(root, frozenset())) - 2**63
            rows += [(host, key, kind, 0 if kind == SLOT else article, words) for key, (kind, words) in judged(order).items()]
            rows.append((host, 0, PAGE, article, root.words))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "subtree", "kind", "article", "words"])


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree): what recurs on many pages of a host. ``pages`` has host (a hash) and html."""
    words = F.sum("words").alias("words")
    by_article = pages.mapInArrow(_hash_batches, COUNTED).groupBy("host", "subtree", "kind", "article").agg(F.count("*").alias("n"), words)
    counts = by_article.groupBy("host", "subtree", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("articles"), words)
    counts = materialise(counts.where((F.col("n") >= min_pages) | (F.col("kind") == PAGE)), "subtree-counts")
    sizes = counts.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"), F.col("articles").alias("texts"), F.col("words").alias("whole"))
    often = counts.where(F.col("kind") != PAGE).join(sizes, "host")
    inside = (F.col("articles") >= min_pages) & (F.col("articles") >= F.col("texts") * TEXT_SHARE)
    slot = (F.col("n") >= F.col("pages") * SLOT_SHARE) & (F.col("words") <= F.col("whole") * SLOT_WORDS)
    shared = F.col("n") >= F.col("pages") * min_share
    spread = (F.col("kind") == OTHER) & (F.col("articles") >= MIN_ARTICLES)
    is_template = F.when(F.col("kind") == INSIDE, inside).when(F.col("kind") == SLOT, slot).otherwise(shared | spread)
    return often.where(is_template).select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host, _ = split_url(F.col("url"))
    own = pages.select("page_id", "url", F.xxhash64(host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = materialise(template_subtrees(own, min_pages, min_share), "templates")
    schema = "page_id long, url string, text string, n_chars long"
    rows = own.withColumn("page_id", F.col("page_id").cast("long"))
    names = ["page_id", "url", "text", "n_chars"]

    def result(part: pa.RecordBatch, sets: Iterator[set[int]]) -> pa.RecordBatch:
        texts = [main_text(parsed(page.as_py())[0], own) for page, own in zip(part.column("html"), sets)]
        columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(map(len, texts)), pa.int64())], names)

    if found.count() <= BROADCAST_ROWS:
        table = found.toArrow()
        by_host: dict[int, set[int]] = {}
        for h, s in zip(table.column("host").to_pylist(), table.column("subtree").to_pylist()):
            by_host.setdefault(h, set()).add(s)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def with_sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none: set[int] = set()
            for part in parts:
                yield result(part, (sent.value.get(h, none) for h in part.column("host").to_pylist()))

        return rows.mapInArrow(with_sent, schema)

    sets = found.groupBy("host").agg(F.collect_set("subtree").alias("template"))
    joined = rows.join(sets, "host", "left").select("page_id", "url", "html", "template")

    def with_joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield result(part, (set(t or ()) for t in part.column("template").to_pylist()))

    return joined.mapInArrow(with_joined, schema)

