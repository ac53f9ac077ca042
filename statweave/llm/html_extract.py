"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by the share of their text
that is in links; an article or main element gets the points of all paragraphs in it undiminished. The best
container is kept, whole, with the siblings of it and of its ancestors that belong to it: paragraphs, headings
and lists beside it, elements of the same kind, others that score well, and what lies between two that are kept.

Menus, forms, notices, adverts, comments and the like are left out, by tag, role, class and id; a name says so only
if all its words do, and weak ones only of what has links, form controls or few words. Comments are also told without
names, as repeated elements with an author and a date after the text. A name alone never takes the article away: an element so marked stays if it is the page's largest article or main element, or
if it holds most of the page's points and nothing comparable stands outside. What is left out ends where its
parent ends, so a forgotten end tag costs no more than that.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import bound_batches, by_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that never hold text of the article.
NEVER = frozenset("noscript template button select svg math object canvas audio video dialog menu map".split())
#: Elements that stand beside the article.
BESIDE = frozenset("nav header footer aside form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "html body article section main div p pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "figure figcaption address details summary fieldset legend hr center hgroup nav header footer aside form".split()
)
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
CLOSES_P = BLOCK - (TABLE - {"table"})
#: An end tag of another element doesn't reach out of these, and one of the text's own marks out of no block.
CELLS = ("td", "th", "caption")
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose end tag may be left out.
OPEN_ENDED = TABLE - {"table"} | frozenset("p li dt dd option".split())
#: A start tag closes open elements of the tags before the bar, if none of those after it was opened since.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "select"),
}
IMPLIED = {k: (a.split(), b.split()) for k, (a, b) in IMPLIED.items()}
#: Words of a class or id that mark readers' comments; others that mark what isn't the article if all the name's words
#: are marks or neutral; and others that do so only where links, form controls or a few words bear them out.
COMMENTS = frozenset("comment comments commentlist disqus".split())
MARKS = COMMENTS | frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe "
    "sidebar sidebars nav navbar navigation breadcrumb breadcrumbs masthead footer pagination pager disclaimer".split()
)
WEAK = frozenset("header menu notice notices notification overlay sponsor signup widget widgets replies reply respond share sharing social related recommended toolbar login search skip".split())
NEUTRAL = frozenset("box bar block area list item items wrapper wrap container inner outer content section posts post articles links link buttons button form site page global top bottom left right main primary secondary bg col column row js id u icons tools row group panel".split())
LIKELY = frozenset("article content entry main post story text body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
SEMANTIC = frozenset(("article", "main"))
CONTAINERS = SEMANTIC | frozenset("section div body #root td ul ol dl table tbody blockquote center html form header aside footer nav".split())
PROSE = HEADINGS | frozenset("p pre blockquote ul ol dl table figure address details".split())
#: Elements of which all that stand side by side belong together.
PARTS = TABLE - {"table"} | frozenset("li dt dd section".split())
#: Share of the best container's score that other siblings need, and the share of links that none may reach.
SIBLING_SHARE, LINK_SHARE = 0.2, 0.3
#: Characters of text below which a weak mark needs no more to bear it out.
FEW = 80
CONTROLS = frozenset("input button select textarea".split())
#: What says who wrote an entry of a thread, and when: words of a class, itemprop or rel, and dates in the text.
SIGNED = frozenset("author user username byline vcard commenter nickname poster".split())
DATED = frozenset("date time timestamp datetime ago posted published".split())
DATE = re.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d\d\b|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}\b", re.IGNORECASE)

#: Names are possessive: what follows a name can't be part of it, so no start is tried twice.
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORDS = re.compile(r"[a-z0-9]+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE | re.ASCII) for tag in RAW}


class Node:
    """mark: why the element may not belong to the article ("" if nothing says so); gone: it or an ancestor is
    left out; kind: its tag and class, by which siblings are told alike."""

    __slots__ = ("block", "bonus", "children", "closed", "controls", "dated", "gone", "headed", "kind", "link", "linked", "mark", "parent", "points", "score", "semantic", "signed", "size", "tag", "titled", "total")

    def __init__(self, tag: str, parent: Node | None, mark: str = "", bonus: float = 0.0, kind: str = "") -> None:
        self.tag, self.parent, self.mark, self.bonus, self.kind = tag, parent, mark, bonus, kind
        self.children: list = []
        self.score = self.points = self.total = 0.0
        self.size = self.linked = self.controls = 0
        self.dated = tag == "time"
        self.signed = False
        self.headed = tag in HEADINGS
        self.closed = tag in OPEN_ENDED
        self.gone = self.titled = False
        self.link = tag == "a" or (parent is not None and parent.link)
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.semantic = self if tag in SEMANTIC else parent.semantic if parent is not None else None


def _named(name: str, tag: str) -> str:
    """What one class or id says: comments, beside, perhaps beside (weak), or nothing."""
    words = WORDS.findall(name.lower())
    if tag in PROSE and len(words) > 1:  # of paragraphs and headings only plain marks count
        return ""
    if COMMENTS.intersection(words):
        return "comments"
    if all(w in MARKS or w in WEAK or w in NEUTRAL or w.isdigit() for w in words):
        return "beside" if MARKS.intersection(words) else "weak" if WEAK.intersection(words) else ""
    return ""


def judge(tag: str, attributes: str) -> tuple[str, float, str]:
    """An element's mark, the bonus that its class or id earns, and its kind."""
    mark = "never" if tag in NEVER else tag if tag in BESIDE else ""
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return mark, 0.0, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return "never", 0.0, ""
    names = found.get("class", "").split()
    bonus = 2.0 if LIKELY.intersection(WORDS.findall(f"{' '.join(names)} {found.get('id', '')}".lower())) else 0.0
    if not mark and found.get("role", "").lower() in ROLES:
        mark = "nav"
    said = {_named(x, tag) for x in names}
    if tag not in HEADINGS:  # a heading's id repeats its text
        said.add(_named(found.get("id", ""), tag))
    if "comments" in said:
        mark = mark or "comments"
    elif "beside" in said or "weak" in said:
        mark = mark or ("beside" if "beside" in said else "weak")
    return mark, bonus, f"{tag} {' '.join(sorted(names))}" if names else ""


def parse(html: str) -> list[Node]:
    """The elements in page order, the root first; children are elements and strings. Each tag takes a time that
    doesn't depend on how many are open: where the open elements of a tag, and the open blocks, stand is kept."""
    root = Node("#root", None)
    nodes, stack = [root], [root]
    open_at: dict[str, list[int]] = {}
    blocks = [0]
    at, end = 0, len(html)

    def nearest(tags: list[str] | tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            open_at[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            stack[-1].children.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag == "head":
            continue
        if tag in CONTROLS and not (m[1] or m[4]):
            stack[-1].controls += 1
        if (m[1] or m[4]) == "/":
            of = tuple(HEADINGS) if tag in HEADINGS else (tag,)
            i = nearest(of)
            limit = 0 if tag == "table" else nearest(("table",)) if tag in TABLE else blocks[-1] if tag in INLINE else nearest(CELLS)
            if i and i >= limit:
                stack[i].closed = True
                close(i)
            continue
        if tag in RAW:
            found = ENDS[tag].search(html, at)
            at = found.end() if found else end
            continue
        if tag in CLOSES_P and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            limit = nearest(stops)
            if tag in ("tr", "thead", "tbody", "tfoot"):  # all of them, from the outermost
                i = min((at_[k] for t in closes if (at_ := open_at.get(t)) and (k := bisect_right(at_, limit)) < len(at_)), default=0)
            else:
                i = nearest(closes)
            if i > limit:
                close(i)
        if tag in VOID:
            if tag == "hr":
                node = Node("hr", stack[-1])
                stack[-1].children.append(node)
                nodes.append(node)
            elif tag in ("br", "img", "input"):
                stack[-1].children.append(" ")
            continue
        attributes = m[3] or m[6] or ""
        node = Node(tag, stack[-1], *judge(tag, attributes))
        if attributes:
            said = {w for a in ATTRIBUTE.finditer(attributes) if a[1].lower() in ("class", "itemprop", "rel") for w in WORDS.findall((a[2] or a[3] or a[4] or "").lower())}
            node.signed, node.dated = not SIGNED.isdisjoint(said), node.dated or not DATED.isdisjoint(said)
        stack[-1].children.append(node)
        nodes.append(node)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)
    return nodes


def paragraphs(nodes: list[Node]) -> None:
    """Sizes of text and linked text, each block's own points, and each element's total of them; what is gone has none."""
    found: dict[int, list] = {}
    for node in nodes:
        node.size = node.linked = 0
        node.points = node.total = 0.0
        if node.gone:
            continue
        own = [c for c in node.children if isinstance(c, str)]
        node.size = sum(len(c.strip()) for c in own)
        node.linked = node.size if node.link else 0
        if node.size:  # a block with the inline text in it is a paragraph
            entry = found.setdefault(id(node.block), [node.block, 0, 0, 0])
            entry[1] += node.size
            entry[2] += node.linked
            entry[3] += sum(c.count(",") + c.count("、") + c.count("，") for c in own)
    for block, size, linked, commas in found.values():
        block.points = block.total = (1 + commas + min(size / 100, 3)) * (1 - linked / size)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.total += node.total


def threads(nodes: list[Node]) -> None:
    """Marks comments that no name tells: two or more elements of one kind side by side, each signed and dated and none
    with a heading, after paragraphs that are none of theirs."""
    for node in reversed(nodes):
        up = node.parent
        node.dated = node.dated or any(isinstance(c, str) and len(c) < FEW and DATE.search(c) is not None for c in node.children)
        if up is not None:
            up.controls += node.controls
            up.dated, up.signed, up.headed = up.dated or node.dated, up.signed or node.signed, up.headed or node.headed
    prose = 0  # characters of paragraphs so far
    for node in nodes:
        inside = [c for c in node.children if isinstance(c, Node)]
        kinds: dict[str, int] = {}
        for c in inside:
            if c.signed and c.dated and not c.headed and c.tag in BLOCK:
                kinds[c.kind or c.tag] = kinds.get(c.kind or c.tag, 0) + 1
        for kind, n in kinds.items():
            if n > 1 and prose >= FEW and n == sum((c.kind or c.tag) == kind for c in inside):
                for c in inside:
                    if (c.kind or c.tag) == kind:
                        c.mark = c.mark or "comments"
        if node.block.tag in PROSE:
            prose += sum(len(c.strip()) for c in node.children if isinstance(c, str))


def leave_out(nodes: list[Node]) -> None:
    """Decides for every marked element whether it is left out, from the points that all elements hold."""
    threads(nodes)
    for node in nodes[1:]:
        node.gone = node.parent.gone or (node.mark == "never" and node.closed)
    paragraphs(nodes)
    for node in nodes:
        if node.mark == "weak":  # whole paragraphs with few links and no controls are text, whatever their name
            node.mark = "beside" if node.controls or node.size < FEW or node.linked >= LINK_SHARE * node.size else ""
    page = nodes[0].total
    inside: dict[int, bool] = {}  # whether an element or an ancestor is marked
    clean = largest = 0.0
    holds: set[int] = set()  # elements with an article, main element or first heading in them, comments apart
    for node in nodes:
        marked = inside[id(node)] = bool(node.mark) or (node.parent is not None and inside[id(node.parent)])
        if not marked:
            clean += node.points
            if node.tag in SEMANTIC:
                largest = max(largest, node.total)
        if node.tag in SEMANTIC and node.mark != "comments" and not node.gone:
            up = node.parent
            while up is not None and id(up) not in holds and up.mark != "comments":
                holds.add(id(up))
                up = up.parent
    for node in nodes[1:]:
        if node.parent.gone:
            node.gone = True
        elif node.mark and not node.gone:
            most = node.total > 0.5 * page
            alone = clean <= 0.25 * node.total
            if node.mark == "never":  # an end tag was forgotten
                stays = most and alone
            elif node.mark == "comments":
                stays = node.total > 0 and not clean and id(node) in holds
            elif node.tag in SEMANTIC:
                stays = node.total > 0 and node.total >= largest
            elif id(node) in holds:
                stays = not largest and most
            elif node.mark in ("nav", "footer"):
                stays = most and alone and not node.closed and node.mark != "footer"
            else:
                stays = most and alone
            node.gone = not stays
    paragraphs(nodes)
    seen: set[int] = set()
    for node in nodes:  # the headings of an article's first header are its own, where it has no other first heading
        if node.mark == "header" and node.gone and not node.parent.gone and node.parent.semantic is not None:
            whole = node.parent.semantic
            if id(whole) not in seen and not any(isinstance(c, Node) and c.tag == "h1" and not c.gone for c in whole.children):
                _titles(node)
            seen.add(id(whole))


def _titles(header: Node) -> None:
    titles = []
    todo = [header]
    while todo:
        node = todo.pop()
        for c in reversed(node.children):
            if isinstance(c, Node) and not c.mark:
                (titles if c.tag in HEADINGS else todo).append(c)
    titles.reverse()
    if titles:
        header.gone, header.children = False, titles
        todo = list(titles)
        while todo:
            node = todo.pop()
            node.gone = bool(node.mark)
            todo += [c for c in node.children if isinstance(c, Node) and not node.gone]


def score(nodes: list[Node]) -> None:
    for node in nodes:
        node.score = node.bonus if node.size else 0.0
    for block in nodes:
        if not block.points:
            continue
        holder = block if block.tag in CONTAINERS or block.parent is None else block.parent
        share, up = 1.0, holder
        for _ in range(4):
            if up is None:
                break
            if up.tag not in SEMANTIC:
                up.score += block.points * share
            share /= 2
            up = up.parent
    for node in nodes:
        if node.tag in SEMANTIC:
            node.score += node.total
        if node.size:
            node.score *= 1 - node.linked / node.size
    for node in reversed(nodes):
        node.titled = not node.gone and (node.titled or node.tag == "h1")
        if node.titled and node.parent is not None:
            node.parent.titled = True


def _belongs(node: Node, centre: Node, best: Node, near: bool, title: bool) -> bool:
    """Whether a sibling of centre, which is the best container or holds it, is part of the article."""
    if node.gone or not node.size or node.linked >= LINK_SHARE * node.size:
        return False
    if node.kind and node.kind == centre.kind:
        return True
    if node.tag in PROSE and (near or (node.tag == "h1" and title)):
        return True
    if (near and node.tag == "section" and centre.tag == "div") or (node.tag == centre.tag and node.tag in PARTS):
        return True
    return best.score > 0 and max(node.score, node.total) >= max(3.0, SIBLING_SHARE * best.score)


def _beside(centre: Node, best: Node, near: bool, title: bool) -> tuple[list, list]:
    """What is kept of the siblings before and after centre, in page order."""
    siblings = centre.parent.children
    place = next(i for i, c in enumerate(siblings) if c is centre)
    kept = [i for i, c in enumerate(siblings) if c is centre or (isinstance(c, Node) and _belongs(c, centre, best, near, title))]
    first, last = kept[0], kept[-1]
    chosen = set(kept)
    between = [c for c in range(first, last + 1) if c in chosen or isinstance(siblings[c], str) or (not siblings[c].gone and siblings[c].linked < 0.5 * max(1, siblings[c].size))]
    return [siblings[i] for i in between if i < place], [siblings[i] for i in between if i > place]


def article(nodes: list[Node]) -> list:
    """The elements and strings that make up the article, in page order."""
    candidates = [n for n in nodes if n.tag in CONTAINERS and n.size and not n.gone]
    if not candidates:
        return []
    best = max(candidates, key=lambda n: n.score)
    if best.semantic is not None:
        return [best.semantic]
    title = best.tag not in ("body", "html", "#root") and not best.titled
    centre, earlier, later, near = best, [], [], True
    while centre.parent is not None:
        before, after = _beside(centre, best, near, title)
        near = near and centre.tag in PROSE | PARTS  # a table or list stands among paragraphs
        title = title and not any(isinstance(c, Node) and c.titled for c in before)
        earlier.append(before)
        later.append(after)
        centre = centre.parent
    return [c for part in reversed(earlier) for c in part] + [best] + [c for part in later for c in part]


def extract(html: str) -> str:
    """The blocks of the main text, each with its white space turned into single spaces, joined by line feeds."""
    nodes = parse(html)
    leave_out(nodes)
    score(nodes)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    for top in article(nodes):
        if isinstance(top, str):
            run.append(top)
            continue
        stack: list = [(top, 0)]
        while stack:
            node, i = stack.pop()
            block = node.tag in BLOCK or node is top and node.tag == "#root"
            if i == 0 and block:
                flush()
            while i < len(node.children):
                child = node.children[i]
                i += 1
                if isinstance(child, str):
                    run.append(child)
                elif not child.gone:
                    stack.append((node, i))
                    stack.append((child, 0))
                    break
                elif child.tag in BLOCK:
                    flush()
            else:
                if block:
                    flush()
    flush()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages of nothing but menus and the like, have an empty text. Repeated rows each
    get their own; an empty table gives an empty result; long pages are read whole, without recursion; other
    columns, whatever their names, are ignored.
    """

    def run(html: pa.Array) -> pa.Array:
        return pa.array([extract(x or "") for x in html.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def column(html: pa.Array) -> pa.Array:
        return by_slices(run)(html)

    bound_batches(pages.sparkSession)
    texts = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), column(F.col(f"`{html_col}`").cast("string")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
