"""Site templates are what distinct pages of a host share."""

from framewright.llm.site_templates import extract_main_text, main_text, parse

PAGES = "page_id long, url string, html string"


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_copies_keep_their_text(spark):
    rows = [(i, f"http://a.example/{i}", "<div><p>one story</p><p>its end</p></div>") for i in range(40)]
    rows += [(100 + i, f"http://a.example/x{i}", f"<div><div>Banner</div><p>story {i}</p></div>") for i in range(8)]
    told = texts_of(spark, rows)
    assert {told[i] for i in range(40)} == {"one story\nits end"}
    assert [told[100 + i] for i in range(8)] == [f"story {i}" for i in range(8)]


def test_the_size_of_the_host_plays_no_part(spark):
    page = "<div>{}<p>story {}</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format("<div>Notice</div>" if i < 6 else "", i)) for i in range(900)]
    told = texts_of(spark, rows)
    assert [told[i] for i in range(900)] == [f"story {i}" for i in range(900)]


def test_class_words_delete_no_main_content():
    for html in (
        "<div class='layout no-sidebar'><article>story</article></div>",
        "<div class='sidebar'><main>story</main></div>",
        "<article><section class='related-work'>story</section></article>",
        "<div class='comments'><p>story</p></div><p>x</p><div class='ad'>b</div>",
    ):
        assert main_text(parse(html), set()).split("\n")[0] == "story"
    assert main_text(parse("<article>story<div class='x ad'>b</div></article>"), set()) == "story"
