"""Main text of web pages through container paths that a host's pages agree on.

Each page scores its containers and names the best by a generalised path of tags and classes.
The paths are counted per host in Spark; pages are then read again with the paths that won
on their host. A page without any of them uses its own best container. An article counts
with all its text, and other containers give way to one around them that holds more of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from supportlens.llm.common import text_of
from supportlens.llm.url_filter import host_and_path
from supportlens.session import materialize

#: A host keeps the paths with at least this share of its votes, so at most five.
WINNING_SHARE = 0.2
#: Text around the best container, as a share of its own, from which the one around it is taken instead.
RICH_SHARE = 0.2

# Elements of HTML by their role; fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe")
#: Elements of other languages, in which "/>" ends an element.
FOREIGN = frozenset(("svg", "math"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements of svg and math that hold HTML.
EMBEDDING = frozenset("foreignobject annotation-xml mtext mi mo mn ms desc".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Containers that are made for one text; a body or a table cell may hold anything.
WRAPPERS = frozenset("article div main section".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that a start tag ends implicitly, up to the nearest of the elements after the bar.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Of each tag the endings it counts for, and whether it is a scope of theirs.
SCOPES: dict[str, list[tuple[str, bool]]] = {}
for _ending, (_ended, _within) in ENDED_BY.items():
    for _tag in (*_ended, *_within):
        SCOPES.setdefault(_tag, []).append((_ending, _tag in _within))
#: Elements, roles and name parts of what is not part of an article.
DROPPED = frozenset(
    "annotation annotation-xml aside audio button canvas dialog footer form head input menu nav object search select svg "
    "video".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Words of class and id names. What readers wrote and notices to them are never an article's text.
READER_NAMES = frozenset("comment comments commentlist consent cookie cookies disqus gdpr".split())
READERS_IDS = frozenset("comment comments commentlist disqus".split())
#: Furniture of a page by any word of a class, or by an id of such words alone.
FURNITURE_NAMES = frozenset(
    "ad ads adsense adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs footer login masthead "
    "menu modal nav navbar navigation newsletter overlay pager pagination popup promo sidebar signup skyscraper sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
#: Furniture if the whole name is made of such words; beside other words they may be a topic.
TOPIC_NAMES = frozenset(
    "notice promoted promotion recommended related replies reply respond response responses search share sharing social".split()
)
DROPPED_NAMES = READER_NAMES | FURNITURE_NAMES | TOPIC_NAMES
#: Words that say nothing of the content.
PLAIN_NAMES = frozenset(
    "area article articles bar block blog body bottom box button buttons col column container content entry form header "
    "icons inner item items js left link links list main media module outer page panel post posts right row section site "
    "stories story strip title top user wrap wrapper".split()
)
#: Before such a word these only say what else there is: has-sidebar.
MODIFIERS = frozenset("has hide no with without".split())
#: Elements whose id names a place in the text.
NAMED_ANCHORS = frozenset("a b blockquote code dd dt em figure h1 h2 h3 h4 h5 h6 i li p pre span strong td th tr".split())
#: Between the steps of a path; no tag or class holds it.
STEP = "\n"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"""|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:(?:[^>]*[\s"'])?/>|[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"""
    r"|<xmp(?=[\s/>])[^>]*>(?P<sample>.*?)(?:</xmp(?=[\s/>])[^>]*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*)>"""
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "depth", "block", "embeds")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.depth = 0 if parent is None else parent.depth + 1
        #: The nearest block, itself included.
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        #: Whether blocks may stand here inside a foreign element.
        self.embeds = parent is not None and (tag in EMBEDDING or parent.embeds and tag not in FOREIGN)

    def step(self) -> str:
        """Tag and classes, numbers generalised; classes of the whole page vary and are left out."""
        if self.tag in ("html", "body"):
            return self.tag
        classes = sorted(set(DIGITS.sub("#", self.attrs.get("class", "")).split()))
        return ".".join([self.tag, *classes])


class _Open:
    """The open elements: how many of each tag, and of those that a tag ends, in each scope of theirs."""

    def __init__(self):
        self.tags: dict[str, int] = {}
        self.scopes = {tag: [0] for tag in ENDED_BY}

    def enter(self, tag: str) -> None:
        self.tags[tag] = self.tags.get(tag, 0) + 1
        for ending, is_scope in SCOPES.get(tag, ()):
            if is_scope:
                self.scopes[ending].append(0)
            else:
                self.scopes[ending][-1] += 1

    def leave(self, node: Node, outer: Node) -> Node:
        """Go up to ``outer``; every element is left once, so all ways up together are linear."""
        while node is not outer:
            self.tags[node.tag] -= 1
            for ending, is_scope in SCOPES.get(node.tag, ()):
                if is_scope:
                    self.scopes[ending].pop()
                else:
                    self.scopes[ending][-1] -= 1
            node = node.parent
        return outer

    def closed(self, node: Node, tag: str) -> Node:
        if not self.tags.get(tag):
            return node
        at = node
        while at.tag != tag:
            at = at.parent
        return self.leave(node, at.parent)

    def paragraph_ended(self, node: Node) -> Node:
        """An open paragraph ends where a block starts, with the inline elements in it."""
        return self.leave(node, node.block.parent) if node.block.tag == "p" else node

    def implied_end(self, node: Node, tag: str) -> Node:
        left = self.scopes[tag][-1]
        found = at = node
        while left:
            if at.tag in ENDED_BY[tag][0]:
                found = at.parent
                left -= 1
            at = at.parent
        return self.leave(node, found)


def parse(text: str) -> Node:
    root = node = Node("#page", {}, None)
    opened = _Open()
    foreign = None  # the outermost svg or math element that is open
    at = 0
    for m in TOKEN.finditer(text):
        if m.start() > at:
            node.parts.append(text[at : m.start()])
        at = m.end()
        if m["sample"] is not None:
            sample = Node("xmp", {}, node := opened.paragraph_ended(node))
            sample.parts.append(m["sample"].replace("&", "&amp;"))
            node.parts.append(sample)
            continue
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            node = opened.closed(node, tag)
            if foreign and node.depth < foreign.depth:
                foreign = None
            continue
        if tag in BLOCKS:
            # Blocks end a foreign element outside of the places made for them.
            if foreign and not node.embeds:
                node, foreign = opened.leave(node, foreign.parent), None
            node = opened.paragraph_ended(node)
        if tag in ENDED_BY:
            node = opened.implied_end(node, tag)
        if foreign and node.depth < foreign.depth:
            foreign = None
        attrs = {}
        for name, a, b, c in ATTRIBUTE.findall(m["attrs"]):
            attrs.setdefault(name.lower(), html.unescape(a or b or c))
        new = Node(tag, attrs, node)
        node.parts.append(new)
        if tag in VOID or (foreign or tag in FOREIGN) and m["attrs"].endswith("/"):
            continue
        node = new
        opened.enter(tag)
        foreign = foreign or (new if tag in FOREIGN else None)
    if at < len(text):
        node.parts.append(text[at:])
    return root


def _words(name: str) -> list[str]:
    """The words of a class or id, without those that a modifier stands before."""
    words = [word.lower() for word in NAME_PARTS.findall(name)]
    return [word for before, word in zip(["", *words], words, strict=False) if not {before, word} & MODIFIERS]


def _only_furniture(words: list[str]) -> bool:
    return not DROPPED_NAMES.isdisjoint(words) and all(w in DROPPED_NAMES or w in PLAIN_NAMES or w.isdigit() for w in words)


class Names:
    """What the class and id of an element say of it; the id of an element that is text says nothing."""

    def __init__(self, node: Node):
        classes = [_words(name) for name in node.attrs.get("class", "").split()]
        ids = [] if node.tag in NAMED_ANCHORS else [_words(name) for name in node.attrs.get("id", "").split()]
        self.named = any(not DROPPED_NAMES.isdisjoint(words) for words in classes + ids)
        #: Reader comments and notices.
        self.reader = any(not READER_NAMES.isdisjoint(words) for words in classes) or any(
            not READERS_IDS.isdisjoint(words) for words in ids
        )
        #: Furniture, whatever its length.
        self.furniture = any(map(_only_furniture, classes)) or any(
            _only_furniture(words) and not (READER_NAMES | FURNITURE_NAMES | {"responses", "replies"}).isdisjoint(words) for words in ids
        )
        #: Furniture unless most of the text is in it.
        self.furnished = any(not FURNITURE_NAMES.isdisjoint(words) for words in classes)


class Page:
    """A parsed page: which elements count, and its containers with their scores.

    Container paths are numbers; ``step_of`` has the last step of each and the path before it.
    """

    def __init__(self, text: str):
        self.root = parse(text)
        self.holds_article: set[int] = set()
        self.holds_body: set[int] = set()
        #: The article or main element around an element, if there is one.
        self.article_of: dict[int, Node] = {}
        #: Characters outside and in links, of each element with all in it.
        self.sizes: dict[int, list[int]] = {}
        self._mark(self.root)
        self.step_of: list[tuple[int, str]] = [(-1, "")]
        self.path_of: dict[tuple[int, str], int] = {}
        #: Characters of each path, written out.
        self.lengths: list[int] = [0]
        self.scores: dict[int, float] = {}
        self.nodes: dict[int, list[Node]] = {}
        #: Of each container path the text in it at any depth, links taken off by half.
        self.whole: dict[int, float] = {}
        #: The same of the text that articles hold.
        self.in_articles: dict[int, float] = {}
        #: Of each container path the text of its own headings and paragraphs, links left out.
        self.prose: dict[int, int] = {}
        self.around: dict[int, int | None] = {}
        self._score(self.root)

    def _below(self, path: int, step: str) -> int:
        key = (path, step)
        if key not in self.path_of:
            self.path_of[key] = len(self.step_of)
            self.step_of.append(key)
            self.lengths.append(self.lengths[path] + 1 + len(step))
        return self.path_of[key]

    def written(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step = self.step_of[path]
            steps.append(step)
        return STEP.join(reversed(steps))

    def known(self, written: str) -> int:
        """The number of a path of any page, -1 if this one has it not."""
        path = 0
        for step in written.split(STEP) if written else ():
            path = self.path_of.get((path, step), -1)
            if path < 0:
                break
        return path

    def _mark(self, root: Node) -> None:
        """Note the text in and outside links of each element, and what holds an article.

        ``holds_article`` are elements around a heading of first rank, an article or a main
        element, ``holds_body`` those around an article or main element.
        """
        order, stack = [], [(root, False, None, False)]
        while stack:
            node, in_link, article, gone = stack.pop()
            gone = gone or self._hidden(node) or node.tag in DROPPED and node.tag != "form" or node.tag == "header" and article is None
            order.append((node, gone))
            if article is not None:
                self.article_of[id(node)] = article
            in_link = in_link or node.tag == "a"
            article = node if node.tag in ("article", "main") else article
            size = self.sizes[id(node)] = [0, 0]
            for part in node.parts:
                if isinstance(part, Node):
                    stack.append((part, in_link, article, gone))
                elif not gone:
                    size[in_link] += len(part.strip())
        for node, gone in reversed(order):
            if node.parent is None:
                continue
            size, outer = self.sizes[id(node)], self.sizes[id(node.parent)]
            outer[0] += size[0]
            outer[1] += size[1]
            body = node.tag == "main" or node.tag == "article" and not Names(node).named
            if body and not gone or id(node) in self.holds_body:
                self.holds_body.add(id(node.parent))
            if body or node.tag == "h1" or id(node) in self.holds_article:
                self.holds_article.add(id(node.parent))

    def _hidden(self, node: Node) -> bool:
        attrs = node.attrs
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
            return True
        return bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.IGNORECASE))

    def _holds_most(self, node: Node, share: float = 0.5) -> bool:
        """Whether the text of the article around, or of a page without one, is mostly in this element."""
        around = self.article_of.get(id(node))
        if around is None and id(self.root) in self.holds_body:
            return False
        return self.sizes[id(node)][0] > share * self.sizes[id(around or self.root)][0]

    def dropped(self, node: Node, in_article: bool) -> bool:
        """Whether an element is left out; ``in_article`` if it is inside an article or main element."""
        if node.tag == "form":
            if id(node) in self.holds_body:
                return self._hidden(node)
            if not self._holds_most(node):
                return True
        elif node.tag in DROPPED or node.tag == "header" and not in_article:
            return True
        if self._hidden(node):
            return True
        if node.tag in ("html", "body", "main") or id(node) in self.holds_article:
            return False
        if node.attrs.get("role", "").lower() in DROPPED_ROLES and not self._holds_most(node):
            return True
        return ("class" in node.attrs or "id" in node.attrs) and self._dropped_by_name(node)

    def _dropped_by_name(self, node: Node) -> bool:
        """By a word of a class or id, but not what is part of the text.

        Comments, notices to readers and what is furniture by its whole name go at every length, but
        for a page's only article; furniture by a part of its name goes unless it holds most of the text
        around; a name that may be a topic goes if the element is mostly links.
        """
        names = Names(node)
        if not names.named:
            return False
        if node.tag == "article" and id(self.root) not in self.holds_body:
            return False
        if names.reader:
            return True
        if names.furniture:
            return not self._holds_most(node, 0.8)
        if names.furnished:
            return not self._holds_most(node)
        text, links = self.sizes[id(node)]
        return links >= text

    def _score(self, root: Node) -> None:
        """A block's own text counts for its container, half for the one above; links not. Articles pass nothing on.

        An article or main element takes all text in it up to the next article. Links count
        against it only if they are more than its text. Of several articles with one path the best one counts.
        """
        held: dict[int, tuple[int, list[int]]] = {}
        order: list[int] = []
        stack = [(root, 0, None, None, None, False, False, False)]
        while stack:
            node, path, container, above, article, in_link, in_article, in_prose = stack.pop()
            if node is not root:
                if self.dropped(node, in_article):
                    continue
                path = self._below(path, node.step())
            if node.tag in CONTAINERS or node is root:
                above, container = container, path
                if path not in self.nodes:
                    self.nodes[path], self.scores[path], self.whole[path], self.prose[path] = [], 0.0, 0.0, 0
                    self.around[path] = above
                    order.append(path)
                self.nodes[path].append(node)
                in_prose = False
                if node.tag in ("article", "main"):
                    held[id(node)] = (path, [0, 0])
                    article = node
            in_link = in_link or node.tag == "a"
            in_article = in_article or node.tag in ("article", "main")
            in_prose = in_prose or node.tag in PROSE
            for part in node.parts:
                if isinstance(part, Node):
                    stack.append((part, path, container, above, article, in_link, in_article, in_prose))
                    continue
                n = len(part.strip())
                own = held[id(article)] if article is not None else (None, None)
                self.whole[container] += -n / 2 if in_link else n
                if article is not None:
                    own[1][in_link] += n
                if container != own[0]:
                    self.scores[container] += -n / 2 if in_link else n
                if above is not None and own[0] not in (above, container) and not in_link:
                    self.scores[above] += n / 2
                if in_prose and not in_link:
                    self.prose[container] += n
        best: dict[int, float] = {}
        for path, (text, links) in held.values():
            best[path] = max(best.get(path, -1e300), 200.0 + text - (links / 2 if links > text else 0))
        for path, score in best.items():
            self.scores[path] += score
        self.in_articles = dict.fromkeys(order, 0.0)
        for path, (text, links) in held.values():
            self.in_articles[path] += text - links / 2
        # A container comes after those around it.
        for path in reversed(order):
            around = self.around[path]
            if around is not None:
                self.whole[around] += self.whole[path]
                self.in_articles[around] += self.in_articles[path]

    def best(self) -> int:
        """The path of the best container, or of one around it that holds more of the article.

        The one around is taken if the text that it adds is rich, or holds headings or
        paragraphs of its own; a whole body is only taken for rich text. Around an article, other
        articles do not count.
        """
        top = max((self.scores[path], -self.lengths[path]) for path in self.scores)
        equal = [path for path in self.scores if (self.scores[path], -self.lengths[path]) == top]
        best = equal[0] if len(equal) == 1 else max(equal, key=self.written)
        around = self.around[best]
        while around is not None:
            added = self.whole[around] - self.whole[best]
            if self.nodes[best][0].tag == "article":
                added -= self.in_articles[around] - self.in_articles[best]
            own = self.prose[around] > 0 and self.nodes[around][0].tag in WRAPPERS
            if added > 0 and (own or added >= RICH_SHARE * self.whole[best]):
                best = around
            around = self.around[around]
        return best

    def chosen(self, paths: list[str]) -> int:
        """The first of the host's paths that holds text, or the page's own best container.

        The own best is also taken where it is around the host's: this page's article has
        parts that most others lack. For a whole body the host must have voted, too.
        """
        best = self.best()
        voted = [self.known(path) for path in paths]
        found = next((path for path in voted if self.scores.get(path, 0) > 0), best)
        outer = found
        while outer > best:
            outer = self.step_of[outer][0]
        wider = outer == best != found and (best in voted or self.nodes[best][0].tag in WRAPPERS)
        return best if wider else found

    def text(self, path: int) -> str:
        blocks: list[str] = []
        for node in self.nodes[path]:
            blocks += _blocks(self, node)
        return "\n\n".join(blocks)


def _blocks(page: Page, top: Node) -> list[str]:
    blocks: list[str] = []
    current: list[str] = []
    in_article = top.tag in ("article", "main") or id(top) in page.article_of

    def flush() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if text:
            blocks.append(text)

    stack: list = [(top, True, in_article)]
    while stack:
        part, opening, inside_article = stack.pop()
        if isinstance(part, str):
            current.append(part)
            continue
        if not opening:
            flush()
            continue
        if part is not top and page.dropped(part, inside_article):
            # What is left out still parts the text around it, if it is a block.
            if part.tag in BLOCKS:
                flush()
            continue
        if part.tag == "br":
            current.append(" ")
            continue
        inside_article = inside_article or part.tag in ("article", "main")
        if part.tag in BLOCKS or part is top:
            flush()
            stack.append((part, False, inside_article))
        stack.extend((child, True, inside_article) for child in reversed(part.parts))
    return blocks


VOTES = pa.schema([("host", pa.string()), ("path", pa.string())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = (Page(text.as_py()) for text in batch.column("html"))
        paths = [page.written(page.best()) for page in pages]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], schema=VOTES)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, paths in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True):
            page = Page(text.as_py())
            texts.append(page.text(page.chosen(paths or [])))
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, schema=TEXTS)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of each row of ``pages`` (page_id, url, html).

    Null or empty html has an empty text; pages without a host (null url, no ://) vote
    together. Paths of equal votes are tried in order of their text. Repeated rows vote and
    are returned each. Further columns are ignored; an empty table gives an empty result.

    Only (host, path) votes are shuffled, added up before. The winners are written first, so
    Spark knows their size: below its broadcast threshold they go to the pages, above it
    pages and winners are joined by host, and the join splits large hosts.
    """
    host, _ = host_and_path(F.col("url"))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), text_of("html").alias("html"))
    votes = plain.select("host", "html").mapInArrow(_vote, "host string, path string").groupBy("host", "path").count()
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("count", "path"))))
    totals = votes.groupBy("host").agg(F.sum("count").alias("total")).withColumnRenamed("host", "_host")
    strong = votes.join(totals, F.col("host") == F.col("_host")).where(F.col("count") >= WINNING_SHARE * F.col("total"))
    winners = materialize(strong.groupBy("host").agg(ranked.getField("path").alias("paths")), "host-paths")
    known = plain.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return known.mapInArrow(_extract, "page_id long, url string, text string")
