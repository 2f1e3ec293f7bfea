"""Main text of web pages by consensus paths of their hosts.

1. Each page's containers are scored by the running text below them: a block counts fully for its parent and half as
   much for each step further up, link text counts against it. The best container votes for its path, the tags and
   classes from the root down, with numbers in class names generalised.
2. Votes are summed for each host and path in Spark (map-side first, so a host with a third of all pages is no
   burden), and the path with the most votes wins its host.
3. Each page is read again: the text of the elements on its host's winning path, or of its own best container where
   it has none there.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden text and reader comments are
left out wherever they stand. Class and id names that may as well belong to an article (a banner figure, related work)
are evidence, not a verdict: inside an article or main element, such a part goes only if most of its text is links or
it holds inputs. A form that holds an article, or most of a page's text (frameworks wrap whole pages in one), stays;
its inputs go. Formulas keep their text. Each block element is a line: white space inside it is folded, empty lines
are dropped.

An element's path is kept as a hash of its parent's and its own step, so that a page costs memory in proportion to its
length however deeply it is nested.

Defined results: a null or empty html has an empty text. A url without a host votes under an empty host. Broken
markup is read as far as it goes: unclosed elements end with their parent, an unfinished tag at the end is dropped.
Repeated rows get equal results, an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import map_rows

#: Hosts whose winners are broadcast at most; beyond, pages and winners meet by host.
BROADCAST_HOSTS = 200_000
DECAY = 0.5
BONUS = 1.5
#: Below this, a text's share in a container's score is nothing.
LEAST_GAIN = 1e-6

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*+>|<(?P<raw>{_RAW})\b[^>]*+>(?:.*?)(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[a-zA-Z/][^>]*+\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img object"
    " math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover semantics annotation annotation-xml".split()
)
#: What the start of an element closes, if it is open.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = frozenset("table ul ol dl select article section div body main nav aside".split())
_OUT_TAGS = frozenset("nav aside footer button head dialog menu audio video canvas annotation annotation-xml".split())
_INPUTS = frozenset("input button select textarea fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|masthead|site-?header|page-?header|"
    r"topbar|cookies?|consent|gdpr|popup|modal|newsletter|subscri(?:be|ption)|signup|login|comments?|commentlist|replies|respond|disqus|share|sharing|"
    r"social|toolbar|pagination|pager|hidden|skip-?link)(?:$|[\s_-])",
    re.I,
)
#: Names that are a verdict outside of articles and mere evidence inside.
_MAYBE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:sponsor(?:ed)?|promo(?:tion)?|banner|side|aside|widget|footer|foot|notices?|alert|overlay|search|reply|discussion|"
    r"related|recommend(?:ed|ations)?|more-?posts|disclaimer|copyright)(?:$|[\s_-])",
    re.I,
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
_DIGITS = re.compile(r"\d+")


#: What is to be decided of a node once its contents are known.
MAYBE, FORM = 1, 2


class Node:
    __slots__ = ("parent", "tag", "path", "out", "main", "inside", "link", "score", "items", "doubt")

    def __init__(self, parent, tag, names, out, main, link):
        self.parent, self.tag, self.out, self.main, self.link = parent, tag, out, main, link
        self.path = xxhash.xxh3_128_digest(parent.path + f">{tag}{names}".encode("utf-8", "replace")) if parent else b""
        self.inside = bool(parent) and (parent.inside or parent.main and parent.tag in ("article", "main"))
        self.score = 0.0
        self.doubt = FORM if tag == "form" else 0
        self.items = []  # text, children and breaks, in order


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _open(parent: Node, tag: str, attrs: str) -> Node:
    if not attrs or attrs.isspace():
        return Node(parent, tag, "", parent.out or tag in _OUT_TAGS or tag == "header" and not _inside(parent), tag in ("article", "main"), parent.link or tag == "a")
    a = _attributes(attrs)
    names = f"{a.get('class', '')} {a.get('id', '')}"
    role = a.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop") == "articleBody" or bool(_MAIN.search(names))
    plain = tag not in ("html", "body", "article", "main")
    out = (
        parent.out or tag in _OUT_TAGS or role in _OUT_ROLES and tag != "form" or "hidden" in a or a.get("aria-hidden") == "true"
        or "display:none" in a.get("style", "").replace(" ", "") or tag == "header" and not _inside(parent)
        or plain and tag != "form" and bool(_OUT_NAMES.search(names))
    )
    classes = ".".join(sorted(_DIGITS.sub("#", a.get("class", "")).split()))
    node = Node(parent, tag, f".{classes}" if classes else "", out, main, parent.link or tag == "a")
    if plain and not node.doubt and _MAYBE_NAMES.search(names):
        if node.inside:
            node.doubt = MAYBE
        else:
            node.out = True
    return node


def _inside(node: Node) -> bool:
    """Whether node is an article or stands in one: a header there is the article's own."""
    return node.inside or node.main and node.tag in ("article", "main")


def settle(nodes: list[Node], page: int) -> None:
    """Put out the doubtful nodes that their contents speak against. nodes: in page order; page: its characters of text."""
    sums: dict[Node, tuple[int, int, int, bool]] = {}
    for node in reversed(nodes):  # children stand behind their parents
        text = links = inputs = 0
        holds = False
        for item in node.items:
            if isinstance(item, str):
                size = len(item) - item.count(" ")
                text += size
                links += size * node.link
            elif item is not None and not item.out:
                own = sums[item]
                text, links, inputs = text + own[0], links + own[1], inputs + own[2] + (item.tag in _INPUTS)
                holds |= own[3] or item.tag in ("article", "main")
        sums[node] = text, links, inputs, holds
        if node.doubt == FORM:
            node.out |= not holds and 2 * text <= page
        elif node.doubt == MAYBE:
            node.out |= 2 * links > text or inputs > 0


def parse(page: str) -> Node:
    root = at = Node(None, "", "", False, False, False)
    last = size = 0
    nodes, doubts = [], False
    opened: dict[str, int] = {}
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            at.items.append(page[last : m.start()])
            size += 0 if at.out else m.start() - last - page.count(" ", last, m.start())
        last = m.end()
        if m["cdata"]:
            at.items.append(m["cdata"])
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if not opened.get(tag):
                continue  # nothing to close: no walk up a deep page
            node = at
            while node is not root and node.tag != tag:
                # an inline end tag never closes a block
                if tag in _INLINE and node.tag not in _INLINE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                opened[tag] -= 1
                at = node.parent
            continue
        if tag in _VOID:
            at.items.append(" " if tag in ("br", "wbr", "img") else None)
            if tag == "input" and not at.out:
                nodes.append(child := Node(at, tag, "", False, False, at.link))
                at.items.append(child)
            continue
        if tag not in _INLINE:
            # a block ends an open paragraph and what is open inside it
            node = at
            while node is not root and node.tag in _INLINE:
                node = node.parent
            if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                at = node.parent
        if ends := _ENDS.get(tag):
            node = at
            while node is not root and node.tag not in ends and node.tag not in _SCOPE:
                node = node.parent
            while node is not root and node.tag in ends:
                at = node = node.parent
        at.items.append(child := _open(at, tag, m["attrs"] or m["attrs2"] or ""))
        opened[tag] = opened.get(tag, 0) + 1
        nodes.append(child)
        doubts |= child.doubt > 0
        at = child
    if last < len(page):
        at.items.append(page[last:])
    if doubts:
        settle(nodes, size)
    return root


def blocks(node: Node) -> list[str]:
    """The lines of a node: text between the borders of block elements."""
    lines, current = [], []

    def end():
        if current:
            line = " ".join(entities.unescape("".join(current)).split())
            if line:
                lines.append(line)
            current.clear()

    stack = [iter(node.items)]
    borders = [True]
    while stack:
        for item in stack[-1]:
            if item is None:
                end()
            elif isinstance(item, str):
                current.append(item)
            elif not item.out:
                block = item.tag not in _INLINE
                if block:
                    end()
                stack.append(iter(item.items))
                borders.append(block)
                break
            elif item.tag not in _INLINE:
                end()
        else:
            stack.pop()
            if borders.pop():
                end()
    return lines


def score(root: Node) -> Node:
    """The best container of a page."""
    best = root
    walk = [root]
    while walk:
        node = walk.pop()
        own = 0
        for item in node.items:
            if isinstance(item, str):
                own += len(item) - item.count(" ")
            elif item is not None and not item.out:
                walk.append(item)
        if own:
            holder = node
            while holder.parent and holder.tag in _INLINE:
                holder = holder.parent
            # the block itself is no container: what holds it is
            holder, gain = holder.parent or holder, -own if node.link else own
            while holder and abs(gain) > LEAST_GAIN:
                holder.score += gain
                gain *= DECAY
                holder = holder.parent
    walk = [root]
    top = 0.0
    while walk:
        node = walk.pop()
        value = node.score * (BONUS if node.main else 1)
        if value > top:
            best, top = node, value
        walk += [x for x in node.items if isinstance(x, Node) and not x.out]
    return best


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _voter():
    def step(batch: pa.RecordBatch) -> dict:
        return {"host": batch.column(0), "path": [score(parse(x)).path.hex() for x in batch.column(1).to_pylist()]}

    return step


def consensus(pages: DataFrame) -> DataFrame:
    """(host, winner): the path most pages of a host vote for, the smallest of equals."""
    votes = map_rows(pages.select("host", "html"), "host string, path string", _voter)
    counted = votes.groupBy("host", "path").count()
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("count"), "path")).alias("winner"))


def matching(root: Node, path: str) -> list[Node]:
    """The outermost elements on a path, in page order."""
    found, walk, own = [], [root], bytes.fromhex(path)
    while walk:
        node = walk.pop()
        if node.path == own:
            found.append(node)
        else:
            walk += [x for x in reversed(node.items) if isinstance(x, Node) and not x.out]
    return found


def main_text(page: str, winner: str | None) -> str:
    root = parse(page)
    found = matching(root, winner) if winner else []
    lines = [line for node in found for line in blocks(node)]
    return "\n".join(lines or blocks(score(root)))


def _reader():
    def step(batch: pa.RecordBatch) -> dict:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        texts = [main_text(page, winner) for page, winner in rows]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

    return step


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (columns page_id, url, html)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    winners = consensus(pages)
    known = pages.select("host").distinct().limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = pages.join(F.broadcast(winners) if known else winners, "host", "left").select("page_id", "url", "html", "winner")
    return map_rows(rows, "page_id long, url string, text string, n_chars long", _reader)
