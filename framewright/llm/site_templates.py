"""Main text of web pages by removing what a site repeats.

Every element subtree outside a page's article is hashed and counted per host, once for
copies of a page, in Spark; subtrees that recur on many pages of their host are its template and are
deleted, as are elements that name themselves as furniture (menus, forms, adverts,
comments). What is left is read block by block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import prepare
from framewright.session import materialize

#: Elements that never hold the main text.
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input iframe svg "
    "canvas object embed audio video dialog menu title".split()
)
#: Whole names in class, id or role that say the same, of elements that don't hold the main content.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice popup modal newsletter subscribe "
    "comment comments disqus related share sharing social search contentinfo complementary toolbar pagination".split()
)
#: Names that say so as the last part of a hyphenated name (``article-comments``), or as its first before a container's.
FURNITURE_PARTS = frozenset(
    "ad ads advert advertisement comment comments cookie cookies consent sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer newsletter subscribe banner promo sponsored popup modal disqus pagination".split()
)
CONTAINERS = frozenset("area bar block body box container content form item items links list notice section slot text thread unit wrap wrapper".split())
#: A hyphenated name that begins so says what the element lacks or has beside it.
LACKS = frozenset("no has with without hide hidden".split())
#: Elements whose subtrees are the page's own, however often they recur.
MAIN = frozenset(("article", "main"))
#: A page whose copies are one in so many rows is dealt out to several tasks.
SALTS = 1000
#: So many recurring subtrees are sent to all workers at once (a few dozen MB); more are joined by shuffling.
RECURRING_ROWS = 500_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
_ENDS_P = BLOCKS - {"html", "body", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
_SCOPES = frozenset("table td th ul ol dl div article section main aside nav form body blockquote".split())
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "children", "key", "kept", "main", "spare")

    def __init__(self, tag: str, words: frozenset[str] = frozenset()):
        self.tag, self.words, self.children, self.key = tag, words, [], 0
        self.kept = self.main = self.spare = False


class _Builder(HTMLParser):
    """Elements and texts of a page, closing what authors leave open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def _close(self, names, scope) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in names:
                del self.open[i:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, _SCOPES)
        if tag in ENDS:
            self._close(ENDS[tag], {"table", "ul", "ol", "dl", "select"} - ENDS[tag])
        named = " ".join(v.lower() for k, v in attrs if k in ("class", "id", "role") and v)
        node = Node(tag, frozenset(named.split()) if named else frozenset())
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """The page as a tree. A tag or comment that the page's end cuts off is dropped."""
    builder = _Builder()
    builder.feed(_CUT_TAG.sub("", html))
    if builder.rawdata.startswith("<!"):
        builder.rawdata = ""
    builder.close()
    _keep_main(builder.root)
    return builder.root


def names_furniture(words: frozenset[str]) -> bool:
    """Whether a class, id or role names a menu, advert, comment section or the like."""
    if words & FURNITURE_WORDS:
        return True
    for word in words:
        parts = [part for part in re.split("[-_]+", word) if part]
        if len(parts) > 1 and parts[0] not in LACKS:
            if parts[-1] in FURNITURE_PARTS or (parts[0] in FURNITURE_PARTS and CONTAINERS.issuperset(parts[1:])):
                return True
    return False


def _keep_main(root: Node) -> None:
    """Mark what holds an article or main element or, on pages without any, more than half of the text.

    Articles that are comments or teasers by their own or an outer element's name are main content only
    where the page has no other. Where it has main content, headers outside it are spare.
    """
    order, stack, mains = [], [(root, False)], []
    while stack:
        node, named = stack.pop()
        order.append(node)
        named = named or names_furniture(node.words)
        if node.tag in MAIN:
            mains.append((node, named))
        stack.extend((c, named) for c in node.children if isinstance(c, Node))
    clean = [node for node, named in mains if not named]
    for node in clean or [node for node, _ in mains]:
        node.main = True
    sizes: dict[int, int] = {}
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node)]
        node.kept = node.main or any(c.kept for c in inner)
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        # A form may be wrapped around the page; other furniture holds none of it.
        none = node.tag in FURNITURE and node.tag != "form"
        sizes[id(node)] = 0 if none else own + sum(sizes[id(c)] for c in inner)
    if root.kept:
        stack = [root]
        while stack:
            node = stack.pop()
            node.spare = not node.kept and (node.tag == "header" or bool(node.words & {"header", "site-header", "page-header"}))
            if not node.main:
                stack.extend(c for c in node.children if isinstance(c, Node))
    else:
        for node in order:
            node.kept = 2 * sizes[id(node)] > sizes[id(root)]


def is_furniture(node: Node) -> bool:
    if node.kept and node.tag in ("form", "header", "aside", "footer", "nav"):
        return False
    return node.tag in FURNITURE or node.spare or (not node.kept and node.tag not in ("html", "body") and names_furniture(node.words))


def hash_subtrees(root: Node) -> None:
    """Give every element the hash of its tag, its text and its children, bottom up."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        parts = [node.tag]
        for child in node.children:
            if isinstance(child, Node):
                parts.append(f"<{child.key}>")
            elif text := _SPACE.sub(" ", child).strip():
                parts.append(text)
        node.key = xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def template_candidates(root: Node) -> set[int]:
    """Hashes of the subtrees with text, outside the article and whatever holds it."""
    found: set[int] = set()

    def walk(node: Node) -> tuple[bool, bool]:
        """Whether the subtree has text, and whether it holds main content."""
        text, main = False, node.main
        if main:
            return True, True
        for child in node.children:
            if isinstance(child, Node):
                t, m = walk_all(child)
                text, main = text or t, main or m
            elif child.strip():
                text = True
        if text and not main and node.tag not in ("", "html", "body", "head"):
            found.add(node.key)
        return text, main

    results: dict[int, tuple[bool, bool]] = {}

    def walk_all(node: Node) -> tuple[bool, bool]:
        return results[id(node)]

    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if not node.main:
            stack.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        results[id(node)] = walk(node)
    return found


def page_spans(root: Node, candidates: set[int]) -> tuple[list[str], list[int], list[int], list[int]]:
    """The page's text without furniture, as spans: texts, the candidate each lies in, keys and outer candidates.

    A line feed in a span ends a block. Candidates are numbered in page order, -1 is the page itself; an element
    of the main content is none.
    """
    texts: list[list[str]] = []
    owners: list[int] = []
    keys: list[int] = []
    parents: list[int] = []

    def add(text: str, owner: int) -> None:
        if not owners or owners[-1] != owner:
            owners.append(owner)
            texts.append([])
        if text != "\n" or not texts[-1] or texts[-1][-1] != "\n":
            texts[-1].append(text)

    stack: list = [(root, False, -1)]
    while stack:
        item, own, owner = stack.pop()
        if item is None:
            add("\n", owner)
        elif isinstance(item, str):
            add(_SPACE.sub(" ", item), owner)
        elif item.tag in ("br", "wbr"):
            add(" " if item.tag == "br" else "", owner)
        elif not is_furniture(item):
            if not own and item.key in candidates:
                keys.append(item.key)
                parents.append(owner)
                owner = len(keys) - 1
            own = own or item.main
            if item.tag in BLOCKS:
                add("\n", owner)
                stack.append((None, own, owner))
            stack.extend((child, own, owner) for child in reversed(item.children))
    return ["".join(parts) for parts in texts], owners, keys, parents


def join_spans(texts, owners, keys, parents, template) -> str:
    """The blocks of the spans that lie in no element of the template, one to a line."""
    gone = [False]  # the page itself, as number -1
    for key, parent in zip(keys, parents, strict=True):
        gone.insert(len(gone) - 1, key in template or gone[parent])
    text = "".join(t for t, owner in zip(texts, owners, strict=True) if not gone[owner])
    lines = (_SPACE.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def main_text(root: Node, template: frozenset[int] | set[int]) -> str:
    """Text of the blocks that are neither template nor furniture, one to a line."""
    return join_spans(*page_spans(root, template), template)


SPANS = "texts array<string>, owners array<int>, keys array<long>, parents array<int>, found array<long>, tree long"


def read_pages(html: pd.Series) -> pd.DataFrame:
    """A page's spans, the hashes of its subtrees that may be template, and that of the whole."""
    rows = []
    for page in html:
        root = parse(page)
        hash_subtrees(root)
        found = template_candidates(root)
        rows.append((*page_spans(root, found), list(found), root.key))
    return pd.DataFrame(rows, columns=["texts", "owners", "keys", "parents", "found", "tree"])


def extract_main_text(
    pages: DataFrame,
    min_pages: int = 5,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """page id, url, text and ``n_chars`` (code points) of every page.

    A page is parsed once, and only its text and hashes are kept. A subtree outside the article is template if at least ``min_pages`` distinct pages of its host have it,
    however many pages the host has. A page meets only those of its own subtrees that recur. Pages that
    have no host (null url, no ``://``) form one site.

    Null html and pages without text give an empty text. Copies of a page count as one page and each give a
    row; null ids and urls stay. Other columns play no part; an empty table gives no rows. Whole pages are read.
    """
    spark = pages.sparkSession
    prepare(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_column), r"^.*?://([^/?#]*)", 1), F.lit("")))
    html = F.coalesce(F.col(html_column), F.lit(""))
    # Each page is parsed once; what follows reads its spans and hashes.
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url_column).alias("url"),
        host.alias("host"),
        F.xxhash64(html).alias("page"),
        F.pandas_udf(read_pages, SPANS)(html).alias("read"),
    ).select("id", "url", "host", "page", "read.*")
    rows = materialize(rows, "spans")
    # copies of a page are one page: each subtree once per distinct tree of its host
    held = rows.select("host", "tree", F.explode("found").alias("key")).distinct()
    recurring = held.groupBy("host", "key").count().where(F.col("count") >= min_pages).select("host", "key")
    recurring = materialize(recurring, "recurring")
    spans = [F.col(c) for c in ("texts", "owners", "keys", "parents")]
    if recurring.count() <= RECURRING_ROWS:
        by_host: dict[str, set[int]] = {}
        for name, key in recurring.toLocalIterator():
            by_host.setdefault(name, set()).add(key)
        shared = spark.sparkContext.broadcast(by_host)

        @F.pandas_udf("string")
        def text_of(host: pd.Series, *parts: pd.Series) -> pd.Series:
            none: set[int] = set()
            told = [join_spans(*page, shared.value.get(name, none)) for name, *page in zip(host, *parts, strict=True)]
            return pd.Series(told, dtype=object)

        told = rows.select("id", "url", text_of(F.col("host"), *spans).alias("text"))
    else:
        told = _by_shuffling(rows, recurring, spans)
    return told.select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.char_length("text").cast("long").alias("n_chars")
    )


def _by_shuffling(rows: DataFrame, recurring: DataFrame, spans: list) -> DataFrame:
    """id, url and text where the recurring subtrees are too many for every worker: a page meets its own.

    Pages with a thousandth of all rows as copies, at most SALTS of them, are dealt out to as many pieces
    as they have thousandths; their templates go to each piece, at most 2 * SALTS rows in all.
    """
    held = rows.select("host", "page", F.explode("keys").alias("key")).distinct()
    templates = held.join(recurring, ["host", "key"]).groupBy("host", "page").agg(F.collect_set("key").alias("template"))
    sizes = materialize(rows.groupBy("host", "page").agg(F.count("*").alias("copies")), "copies")
    total = sizes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    large = sizes.where((F.col("copies") * SALTS >= total) & (F.col("copies") > 1)).select(
        "host", "page", F.ceil(F.col("copies") * SALTS / max(total, 1)).cast("int").alias("pieces")
    )
    of_page = ["host", "page"]
    piece = F.pmod(F.xxhash64("id", "url"), F.coalesce("pieces", F.lit(1)))
    rows = rows.join(F.broadcast(large), of_page, "left").withColumn("piece", piece.cast("int")).drop("pieces")
    pieces = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
    templates = templates.join(F.broadcast(large), of_page, "left").withColumn("piece", F.explode(pieces)).drop("pieces")

    @F.pandas_udf("string")
    def text_of(template: pd.Series, *parts: pd.Series) -> pd.Series:
        found = (set() if t is None else set(t.tolist()) for t in template)
        return pd.Series([join_spans(*page, own) for own, *page in zip(found, *parts, strict=True)], dtype=object)

    return rows.join(templates, [*of_page, "piece"], "left").select("id", "url", text_of(F.col("template"), *spans).alias("text"))
