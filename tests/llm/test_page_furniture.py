"""Furniture around, beside and within articles, and the registered pages against a plain recount."""

import collections
import re

import pytest

from framewright.llm import site_templates as st
from framewright.llm.site_templates import extract_main_text, main_text, parse


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<form action=x><div>menu</div><article><p>story</p><form><p>vote</p></form></article></form>", "menu\nstory"),
        ("<form><p>all of the story</p><input></form>", "all of the story"),
        ("<article>story</article><section class='comments'><article class='comment'>me too</article></section>", "story"),
        ("<article>story</article><div id='comments'><article>me too</article></div>", "story"),
        ("<article class='comment'>only this</article>", "only this"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header>story</article>", "Title\nstory"),
        ("<div class='header'>Site</div><main>story</main>", "story"),
        ("<article>story</article><div class='article-comments'>c</div><div class='ad-slot'>a</div><div id='cookie-banner'>k</div>", "story"),
        ("<article>story<div class='cookie_notice'>k</div><p class='has-comments'>more</p></article>", "story\nmore"),
        ("<p>story</p><p class='no-sidebar'>a</p><p class='menu-card'>b</p>", "story\na\nb"),
        ("<p>story</p><!-- never closed <p>x", "story"),
        ("<p>story</p><script>if (a <!-- b) {}</script><p>on</p>", "story\non"),
        ("<title>t</title><p>story</p>", "story"),
        ("a<div><b></b></div>b", "a\nb"),
    ],
)
def test_furniture(html, text):
    assert main_text(parse(html), set()) == text


def recount(pages, least=5):
    """Texts by page: the subtrees of each host counted in a loop, the tree read element by element."""
    host_of = lambda url: (re.match(r"(?s).*?://([^/?#]*)", url or "") or [None, ""])[1].lower()
    trees, holders = [], collections.defaultdict(set)
    for page, url, html in pages:
        root = parse(html or "")
        st.hash_subtrees(root)
        trees.append((page, host_of(url), root))
        for key in st.template_candidates(root):
            holders[host_of(url), key].add(root.key)
    told = collections.Counter()
    for page, host, root in trees:
        lines, line = [], []

        def flush():
            lines.append(re.sub(r"\s+", " ", "".join(line)).strip())
            line.clear()

        def read(node, own):
            if isinstance(node, str):
                line.append(node)
            elif node.tag == "br":
                line.append(" ")
            elif not st.is_furniture(node) and (own or len(holders[host, node.key]) < least):
                if node.tag in st.BLOCKS:
                    flush()
                for child in node.children:
                    read(child, own or node.main)
                if node.tag in st.BLOCKS:
                    flush()

        read(root, False)
        flush()
        told[page, "\n".join(x for x in lines if x)] += 1
    return told


@pytest.mark.parametrize("most", [500_000, -1])
def test_pages_equal_a_plain_recount(spark, monkeypatch, most):
    monkeypatch.setattr(st, "RECURRING_ROWS", most)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(None, None, "<p>x"), (1, rows[0][1], None), rows[3], rows[3]] + [(9000 + i, "http://h.x/", f"<p>same</p><div>n{i}</div>") for i in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_main_text(df).collect()
    assert collections.Counter((r["page_id"], r["text"]) for r in got) == recount(rows)


def test_long_page(spark):
    body = "".join(f"<p>line {i} of a long page</p>" for i in range(60_000))
    df = spark.createDataFrame([(1, "http://a.x/1", f"<div>{body}</div>")], "page_id long, url string, html string")
    row = extract_main_text(df).first()
    assert row["text"].count("\n") == 59_999 and row["n_chars"] == len(row["text"])
