"""Main text of web pages by tree scoring.

A tolerant parser builds a light tree. Paragraphs pass points for their length
and their commas to their ancestors, less with each level; a container's points
are discounted by its link density. The best container is kept along with those
of its siblings that score near it or read like prose, and the text of what is
left, block by block, is the result.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import batch_of, id_type, map_batches, schema

# Fixed values of HTML: elements without content, with raw text, that begin blocks, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "summary"} | {"dir"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = {  # an opening tag closes an open one of these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Elements that are never the article's text, and names that mark such parts.
DROPPED = frozenset("nav footer aside form button input select textarea script style noscript template iframe object embed svg annotation annotation-xml canvas audio video dialog head title menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar advertisement".split())
UNLIKELY = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|breadcrumbs?|comments?|commentlist|comment-\w+|cookies?\w*|consent|disqus\w*|footer\w*|footnav|gdpr|"
    r"masthead|menus?|menubar|nav|navbar|navigation|newsletter|notices?|notification|outbrain|pager|pagination|popup|"
    r"remark|replies|reply|respond|rss|share|sharing|sharebar|shoutbox|side-?bar\w*|signup|social\w*|"
    r"subscribe\w*|taboola\w*|toolbar|alert|disclaimer)(?:$|[-_ ])", re.I)
# Names that articles also give to their own sections: inside an article they count only for parts that are no prose.
DOUBTFUL = re.compile(r"(?:^|[-_ ])(?:banner\w*|discussion|header|modal|promo\w*|recommend\w*|related\w*|search\w*|skip|sponsor\w*|widgets?)(?:$|[-_ ])", re.I)
LIKELY = re.compile(r"(?:^|[-_ ])(?:article\w*|body|content|entry|main|page|post|text|story|hentry)(?:$|[-_ ])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TOKEN = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_TAG_LAX = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: White space, no-break spaces included once references are decoded; zero-width characters are text.
_SPACE = re.compile(r"\s+")
_COMMAS = re.compile("[,،，、﹐؛;]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "chars", "linked", "commas")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked, self.commas = 0.0, 0, 0, 0

    @property
    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".strip()


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(value.strip("\"'")) if value else "")
    return out


def parse(source: str) -> Node:
    """The page's tree. Comments, declarations and the content of raw-text elements are left out."""
    root = node = Node("#root", {}, None)
    at, n = 0, len(source)

    def text(chunk: str) -> None:
        if chunk:
            node.children.append(entities.unescape(chunk) if "&" in chunk else chunk)

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            text(source[at:])
            break
        m = _TOKEN.match(source, begin) or _TAG_LAX.match(source, begin)
        if m is None:
            text(source[at : begin + 1])
            at = begin + 1
            continue
        text(source[at:begin])
        at = m.end()
        if m.re is _TAG_LAX:
            close, tag, raw = None, m[1].lower(), m[2]
        else:
            close, tag, raw = m[1], m[2] and m[2].lower(), m[3]
        if close:
            close = close.lower()
            up = node
            while up is not root and up.tag != close and not (close not in BLOCK and up.tag in BLOCK):
                up = up.parent
            if up is not root and up.tag == close:
                node = up.parent
            continue
        if not tag:
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = m.end() if m else n
            continue
        if tag in CLOSES_P:
            up = node
            while up is not root and up.tag != "p" and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in HEADINGS and node.tag in HEADINGS:
            node = node.parent
        if tag in SELF_CLOSING:
            ends, stops = SELF_CLOSING[tag]
            up, last = node, None
            while up is not root and up.tag not in stops:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        if tag in ("body", "html") and any(c.tag == tag for c in _line(node)):
            continue
        child = Node(tag, _attributes(raw) if raw and not raw.isspace() else {}, node)
        node.children.append(child)
        if tag not in VOID:
            node = child
    return root


def _line(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _unwanted(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED:
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")) or a.get("role", "").lower() in DROPPED_ROLES:
        return True
    if node.tag in ("html", "body", "article", "main", "p", *HEADINGS):
        return False
    names = node.names
    if not names or LIKELY.search(names) and re.search(r"(?:^|[-_ ])(?:article|main|entry|story)", names):
        return False
    return bool(UNLIKELY.search(names) or DOUBTFUL.search(names) and not (in_article and _prose(node)))


def _prose(node: Node) -> bool:
    """Whether most of a part's text is in paragraphs, and little of it in links."""
    every, linked, told = 0, 0, 0
    stack: list = [(node, False, False)]
    while stack:
        x, in_link, in_paragraph = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                n = len(c.strip())
                every, linked, told = every + n, linked + n * in_link, told + n * in_paragraph
            else:
                stack.append((c, in_link or c.tag == "a", in_paragraph or c.tag in ("p", "blockquote", "li", "dd", "pre")))
    return every > 0 and told >= 0.5 * every and linked <= 0.3 * every


def _prune(root: Node) -> None:
    """Take out what is never the article's text. A header inside an article keeps its headings."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(c)
            elif c.tag == "header" or c.attrs.get("role", "").lower() == "banner":
                if inside:
                    kept += [h for h in _walk(c) if h.tag in HEADINGS]
            elif not _unwanted(c, inside):
                kept.append(c)
        for c in kept:
            if not isinstance(c, str):
                c.parent = node
                stack.append((c, inside))
        node.children = kept


def _walk(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if not isinstance(c, str)]


def _measure(root: Node) -> list[Node]:
    """Fill in characters, linked characters and commas bottom up; nodes in page order."""
    order = list(_walk(root))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip()) if not c.isspace() else 0
                node.commas += len(_COMMAS.findall(c))
            else:
                node.chars += c.chars
                node.linked += c.chars if c.tag == "a" else c.linked
                node.commas += c.commas
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_block(node: Node) -> bool:
    return node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or node.tag in ("div", "section", "article", "main", "body", "#root") and any(isinstance(c, str) and not c.isspace() for c in node.children)


def best_container(order: list[Node]) -> Node | None:
    """The node with the most points after the discount for links; the earliest of equals."""
    scored: dict[int, Node] = {}
    for node in order:
        if not _own_block(node) or node.chars < 20:
            continue
        inner = any(not isinstance(c, str) and c.tag in BLOCK for c in node.children)
        chars = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if inner else node.chars
        points = 1.0 + (node.commas if not inner else 0) + min(chars / 100.0, 3.0)
        up, level = node.parent if node.tag not in ("div", "section", "article", "main", "body", "#root") else node, 0
        while up is not None and level < 5:
            share = 1.0 if level == 0 else 0.5 if level == 1 else 1.0 / (3 * level)
            if id(up) not in scored:
                scored[id(up)] = up
                up.score += 25.0 if up.tag in ("article", "main") else 5.0 if up.tag in ("div", "section", "td", "blockquote") else 0.0
                if up.attrs and LIKELY.search(up.names):
                    up.score += 25.0
            up.score += points * share
            up, level = up.parent, level + 1
    best, most = None, -1.0
    for node in order:
        if id(node) in scored:
            node.score *= 1.0 - _density(node)
            if node.score > most:
                best, most = node, node.score
    return best


def _kept(best: Node) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    if best.parent is None:
        return [best]
    least, kept = max(10.0, best.score * 0.2), []
    for s in best.parent.children:
        if isinstance(s, str):
            continue
        if s is best or s.score >= least or s.tag in HEADINGS and s.chars and _density(s) < 0.5 and best.tag not in ("article", "main"):
            kept.append(s)
        elif s.tag in ("p", "blockquote", "pre") and (s.chars > 80 and _density(s) < 0.25 or 0 < s.chars <= 80 and not s.linked and s.commas + s.chars >= 20):
            kept.append(s)
    return kept


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "table", "div", "p") and node.chars > 0 and _density(node) > 0.66 and node.commas < 3 and sum(1 for x in _walk(node) if x.tag == "a") > 2


def blocks_of(node: Node, links: bool = False) -> list[str]:
    """The text of each block below node, with white space runs as one blank. Lists of links are left out unless links is set."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if t:
            out.append(t)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not links and x is not node and _link_list(x):
            flush()
        elif x.tag in ("br", "wbr", "img", "hr"):
            if x.tag == "hr":
                flush()
            elif x.tag == "br":
                run.append(" ")
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    flush()
    return out


def main_text(source: str | None) -> str:
    """The article's blocks joined by a blank line. Empty for null, empty and text-free pages; plain text is its own article.

    Inside an article or main element nothing goes but what is never the article's: navigation, forms, asides, parts with
    telling names (of a doubtful name only what is no prose), and of a header all but its headings. Lists of links and formulas stay.
    """
    if not source or not source.strip():
        return ""
    root = parse(source)
    _prune(root)
    order = _measure(root)
    best = best_container(order) or next((x for x in order if x.tag in ("article", "main")), None) or next((x for x in order if x.tag == "body"), root)
    # An article or main element that holds the best container holds the whole text.
    outer = [x for x in _line(best) if x.tag == "article"] or [x for x in _line(best) if x.tag == "main"]
    own = bool(outer) and _density(outer[0]) < 0.5
    if own:
        best = outer[0]
    return "\n\n".join(b for x in _kept(best) for b in blocks_of(x, links=own and x is best))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages, repeated ones included.

    Other columns are ignored; an empty table gives no rows.
    """
    out = schema(("page_id", id_type(pages, "page_id")), ("url", "string"), ("text", "string"), ("n_chars", "long"))

    def extract(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield batch_of(out, [batch.column(0), batch.column(1), text, [len(t) for t in text]])

    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), extract, out)
