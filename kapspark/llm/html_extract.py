"""Main text of web pages by tree scoring.

A tolerant parser builds the page's tree. Elements that are never text of an article
(scripts, forms, menus, page headers and footers, sidebars, adverts, notices, reader
comments, hidden parts) go first, by element or by words in class, id and role. Below an
article only boxes named as menus, comments, adverts, notices, forms or share bars can go by
name, and only where their links or their share of the article's text agree. Then
every paragraph hands points to its ancestors: up to one point for being there, one for
each comma, up to three for its length; the parent gets them whole, the grandparent half,
each one above a third of what is left per level. An element's points are discounted by
its link density, the share of its letters inside links. The best container is the main
text, together with those of its siblings that score well or are plain paragraphs.

Blocks (runs of text between block-level tags) are written in page order, white space
in a block as one space, blocks joined by a line feed; character references are decoded.

Pages are independent, so the work is one pass over the table without a shuffle.

Defined cases: null or empty html gives the empty text; text without any markup is the
text itself; broken markup is read as browsers do (open elements end with their parent,
an unfinished tag at the end is dropped); repeated rows give repeated results; whole
pages are read however long they are, nesting of any depth needs no recursion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?:[!?]|/[^A-Za-z])[^>]*+(?:>|\Z)|<(?P<loose>/?[A-Za-z])(?:[^>]*+>|[^>]*+\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp svg math".split())
# Elements in which a slash closes the tag.
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption head".split()
)
# an opening tag on the left ends an open element on the right
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
TABLE_SCOPE = {"table"}
ENDED = frozenset().union(*ENDS.values())
# scope element -> what it hides of the elements around it
SCOPED = {
    scope: frozenset().union(*(ENDS[name] for name in ENDS if scope in SCOPES.get(name, TABLE_SCOPE)))
    for scope in TABLE_SCOPE.union(*SCOPES.values())
}
NEVER = frozenset(
    "script style noscript iframe template svg math head title nav footer aside form button select option input textarea "
    "label fieldset object embed canvas audio video map dialog menu noembed noframes xmp".split()
)
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"sidebar|side|aside|rail|widget|menu|nav|navbar|navigation|navi|breadcrumbs?|crumbs?|pager|pagination|paging|toc|"
    r"header|masthead|topbar|toolbar|footer|foot|copyright|legal|imprint|disclaimer|"
    r"comments?|commentlist|replies|reply|respond|discussion|disqus|reactions|"
    r"share|sharing|social|related|recommend\w*|more|trending|popular|teasers?|newsletter|subscribe|signup|login|search|"
    r"tags|taglist|meta|byline|skip|hidden|print|rating|poll|outbrain|taboola|shoutbox|donate|paywall|feedback|form)"
    r"(?:$|[\s_-]|\d)",
    re.I,
)
# Of those words, the ones that may also name a frame around the article ("layout with-sidebar").
FRAME = re.compile(r"(?:^|[\s_-])(?:sidebar|side|aside|rail|header|masthead|more|meta|form|print|banner|widget|toc|legal)(?:$|[\s_-]|\d)", re.I)
# Names by which a box inside an article may go, if its links or its size agree.
BOX = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"sidebar|widget|menu|nav|navbar|navigation|navi|breadcrumbs?|crumbs?|pager|pagination|paging|footer|copyright|"
    r"comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|teasers?|"
    r"newsletter|subscribe|signup|login|search|poll|outbrain|taboola|shoutbox|paywall|feedback|form)(?:$|[\s_-]|\d)",
    re.I,
)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|disqus)(?:$|[\s_-]|\d)", re.I)
MANY_LINKS = 0.3
BOX_SHARE, REMARKS_SHARE = 0.5, 0.95
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
LIKELY = re.compile(r"article|main|content|story|post|entry|body|text|page", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption h2 h3 h4 div section article main".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "dropped", "score", "letters", "linked", "commas", "own", "depth", "near")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list = []
        self.dropped = False
        self.score = 0.0
        self.letters = self.linked = self.commas = self.own = 0
        self.depth = 0 if parent is None else parent.depth + 1
        # open elements that a later tag may end, by tag, as far as their scope reaches
        near = {} if parent is None else parent.near
        if tag in SCOPED:
            near = {t: n for t, n in near.items() if t not in SCOPED[tag]}
        if tag in ENDED:
            near = {**near, tag: self}
        self.near = near


def parse(html: str) -> list[Node]:
    """All elements in page order; the first is the root. The time is linear in the page's length:
    an element is walked over only when it is closed."""
    root = Node("#root", "", None)
    nodes, node, at, size = [root], root, 0, len(html)
    opened: Counter[str] = Counter()

    def end_of(last: Node) -> Node:
        """End the open elements up to and with `last`; what is open then."""
        up = node
        while True:
            opened[up.tag] -= 1
            if up is last:
                return up.parent
            up = up.parent

    while at < size:
        found = TOKEN.search(html, at)
        end = found.start() if found else size
        if end > at:
            node.kids.append(html[at:end])
        if not found:
            break
        at = found.end()
        name = found["name"]
        if name is None:
            if found["loose"] is not None and found.group().endswith(">") is False:
                break  # an unfinished tag at the end
            continue
        name = name.lower()
        if found["end"]:
            if opened[name]:
                up = node
                while up.tag != name:
                    up = up.parent
                node = end_of(up)
            elif name == "p":
                node.kids.append(Node("p", "", node))
            continue
        if opened["p"] and name in BLOCK and name != "body" and name != "html":
            # a block ends an open paragraph; there is no block in between
            up = node
            while up is not root and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                node = end_of(up)
        if name in ENDS:
            ended = [node.near[t] for t in ENDS[name] if t in node.near]
            if ended:
                node = end_of(min(ended, key=lambda n: n.depth))
        new = Node(name, found["attrs"], node)
        node.kids.append(new)
        nodes.append(new)
        closed = name in FOREIGN and found["attrs"].endswith("/")
        if name in RAW and not closed:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else size
        elif name not in VOID and (name in BLOCK or not found["attrs"].endswith("/")):
            node = new  # a slash does not close an HTML block
            opened[name] += 1
    return nodes


def _unlikely(node: Node, inside_article: bool, holds_article: bool, boxes: list[Node]) -> bool:
    """Whether the element goes; a named box inside an article is only added to `boxes`."""
    if node.tag in NEVER:
        return True
    if node.tag in ("html", "body", "#root"):
        return False
    if node.tag == "header":
        return not inside_article
    if not node.attrs:
        return False
    names = []
    for key, value in ATTRIBUTE.findall(node.attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden":
            return True
        if key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and HIDDEN.search(value):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            names.append(CAMEL.sub("-", value))
    text = " ".join(names)
    if not text or not UNLIKELY.search(text):
        return False
    if inside_article:
        if BOX.search(text):
            boxes.append(node)
        return False
    # a frame around an article, or the article itself, whatever it has beside it
    return not (holds_article and not UNLIKELY.search(FRAME.sub(" ", FRAME.sub(" ", text))))


def _drop(nodes: list[Node]) -> list[Node]:
    """Drop what is never article text; returns the named boxes inside articles, in page order."""
    holders, boxes = set(), []
    for node in nodes:
        if node.tag in ("article", "main"):
            up = node
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
    inside = {id(nodes[0]): False}
    for node in nodes[1:]:
        up = node.parent
        if up.dropped:
            node.dropped = True
            continue
        article = inside[id(up)]
        inside[id(node)] = article or node.tag in ("article", "main")
        node.dropped = _unlikely(node, article, id(node) in holders, boxes)
    return boxes


def _drop_boxes(nodes: list[Node], boxes: list[Node]) -> bool:
    """Drop those boxes whose links or whose share of the article's text agree with their name."""
    any_dropped = False
    for box in boxes:
        article = box.parent
        while article.parent is not None and article.tag not in ("article", "main"):
            article = article.parent
        names = CAMEL.sub("-", " ".join(v.strip("\"'") for k, v in ATTRIBUTE.findall(box.attrs) if k.lower() in ("class", "id")))
        share = REMARKS_SHARE if REMARKS.search(names) else BOX_SHARE
        if box.linked > MANY_LINKS * box.letters or box.letters < share * article.letters:
            box.dropped = any_dropped = True
    if any_dropped:
        for node in nodes[1:]:
            node.dropped = node.dropped or node.parent.dropped
    return any_dropped


def _measure(nodes: list[Node]) -> None:
    """Letters, letters in links and commas of each element, from the leaves up."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.letters = node.linked = node.commas = node.own = 0
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(" ".join(kid.split()))
                node.letters += n
                node.own += n
                node.commas += kid.count(",") + kid.count("，") + kid.count("、")
            elif not kid.dropped:
                node.letters += kid.letters
                node.linked += kid.letters if kid.tag == "a" else kid.linked
                node.commas += kid.commas
                if kid.tag not in BLOCK:
                    node.own += kid.own


def _best(nodes: list[Node]) -> Node:
    candidates = []
    for node in nodes:
        if node.dropped or node.tag not in PARAGRAPHS or not node.own:
            continue
        points = min(1.0, node.own / 25) + node.commas * (node.own / max(1, node.letters)) + min(node.own / 100, 3.0)
        points *= 1 - min(1.0, node.linked / max(1, node.letters))
        if node.tag not in ("p", "pre", "blockquote", "li", "dd", "td", "figcaption", "h2", "h3", "h4"):
            node.score += points  # text that stands in a container itself
            candidates.append(node)
        up, level = node.parent, 0
        while up is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            candidates.append(up)
            up, level = up.parent, level + 1
    best, most = nodes[0], -1.0
    seen = set()
    for node in candidates:
        if id(node) in seen:
            continue
        seen.add(id(node))
        if node.tag in ("article", "main"):
            node.score += 25
        elif node.tag in ("ul", "ol", "dl", "table", "tr", "tbody"):
            node.score *= 0.5
        if node.attrs and LIKELY.search(node.attrs):
            node.score *= 1.25
        node.score *= 1 - min(1.0, node.linked / max(1, node.letters))
        if node.score > most:
            best, most = node, node.score
    return best


def _kept(best: Node) -> list[Node]:
    """The best container and those of its siblings that belong to the text, in page order."""
    if best.parent is None:
        return [best]
    enough = max(3.0, best.score * 0.2)
    kept = []
    for kid in best.parent.kids:
        if kid is best:
            kept.append(kid)
        elif isinstance(kid, str) or kid.dropped or not kid.letters:
            continue
        else:
            density = kid.linked / kid.letters
            if kid.score >= enough and density < 0.3 or kid.tag in ("p", "pre", "blockquote", "h1") and (
                density < 0.25 if kid.letters > 80 else density == 0 and best.tag not in ("article", "main")
            ):
                kept.append(kid)
    return kept


def _blocks(top: Node) -> list[str]:
    """Texts between block-level tags of a tree, in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    # (node, next child); an explicit stack, as nesting has no limit
    stack = [(top, iter(top.kids))]
    while stack:
        node, kids = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                run.append(kid)
                continue
            if kid.dropped:
                if kid.tag in BLOCK:
                    close()
                continue
            if kid.tag == "br":
                run.append(" ")
            elif kid.tag in BLOCK:
                close()
            if kid.kids:
                stack.append((kid, iter(kid.kids)))
                break
        else:
            stack.pop()
            if node.tag in BLOCK:
                close()
    close()
    return out


def _link_lists(nodes: list[Node]) -> None:
    """Drop lists and boxes that are nearly all links."""
    for node in nodes:
        if not node.dropped and node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.letters:
            if node.linked / node.letters > 0.6:
                node.dropped = True


def main_text(html: str | None) -> str:
    if not html:
        return ""
    if "<" not in html:
        return " ".join(unescape(html).split())
    nodes = parse(html)
    boxes = _drop(nodes)
    _measure(nodes)
    if boxes and _drop_boxes(nodes, boxes):
        _measure(nodes)
    _link_lists(nodes)
    best = _best(nodes)
    return "\n".join(block for node in _kept(best) for block in _blocks(node))


def extract(df: DataFrame, html_col: str = "html", keep_cols: Sequence[str] | None = None) -> DataFrame:
    """`keep_cols` (default: all but html_col), `text` and `n_chars` for every row."""
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c not in ("text", "n_chars", html_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    schema = T.StructType(
        [*(df.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return df.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)
