import collections
import math
import re

import pytest

from framewright.llm import url_model as um
from framewright.llm.site_templates import extract_main_text, main_text, parse
from framewright.llm.url_model import Rule, judge_urls

RULES = [Rule("net/", False), Rule("example.net/en/", True), Rule("example.com/de/", False), Rule("org/fr/", True)]


def text_of(html):
    return main_text(parse(html), set())


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c<b>d</p>e", "a\nb cd\ne"),
        ("<html><head><title>t</title></head><body><article><h1>H</h1>\n <p> x \n y&nbsp;z</p></article>", "H\nx y z"),
        ("<nav>m</nav><header><h1>T</h1></header><aside>s</aside><footer>f</footer><p>k</p>", "T\nk"),
        ("<div class='post-body'>a</div><div class='ad'>b</div><div id='comments'>c</div>", "a"),
        ("<script>var t='</p><p>no</p>';</script><style>p{}</style><p>yes", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1\n2\n3"),
        ("<p>cut &am", "cut &am"),
        ("<p>cut <a href='x", "cut"),
        ("<!-- c --><p>a<!-- d -->b</p>", "ab"),
        ("<p>" + "<b>" * 3000 + "deep", "deep"),
        ("</div></p>loose</article>", "loose"),
        ("<form><p>x</form><p>1 &lt; 2 &#8364; &copy;</p>", "1 < 2 € ©"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


def test_recurring_subtrees_go_and_own_text_stays(spark):
    page = "<div><div>Welcome to our site</div><ul><li>Home</li><li>News</li></ul></div><div><p>story {}</p><p>Yes.</p></div><p>bye</p>"
    rows = [(i, f"http://A.example/{i}", page.format(i), "x") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", page.format(i), "x") for i in range(2)]  # too few pages to tell
    rows += [(200, "http://a.example/m", "<main><div>Welcome to our site</div></main>", "x")]
    rows += [(300, None, "<p>only", "x"), (301, "no host", None, "x"), (None, "http://a.example/q", "", "x"), (5, "http://a.example/5", page.format(5), "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(set)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        texts[r["page_id"]].add(r["text"])
    assert texts[3] == {"story 3"} and texts[5] == {"story 5"}
    assert texts[100] == {"Welcome to our site\nHome\nNews\nstory 0\nYes.\nbye"}
    assert texts[200] == {"Welcome to our site"} and texts[300] == {"only"} and texts[301] == {""} and texts[None] == {""}
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_article_of_every_page(spark):
    got = extract_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert all("track(" not in r["text"] and "©" not in r["text"] for r in got.collect())


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def plain_verdicts(urls):
    """The same models and threshold, one character after the other."""
    counts = {True: collections.Counter(), False: collections.Counter()}
    seen = set()
    order = um.ORDER
    told = []
    for url in urls:
        host, path = plain_parts(url)
        told.append((host, path, plain_rule(host, path)))
    grams = lambda a: [(um.PAD * (order - 1) + a)[i : i + order] for i in range(len(a))]
    for host, path, rule in told:
        for g in grams(host + path):
            seen.add(g)
            if rule is not None:
                for n in range(1, order + 1):
                    counts[rule.allow][g[-n:]] += 1
    contexts = {k: collections.Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            contexts[k][len(g), g[:-1]] += n

    def chance(kind, g):
        p = 1.0 / um.ALPHABET
        for n in range(1, order + 1):
            p = (counts[kind][g[-n:]] + um.PRIOR * p) / (contexts[kind][n, g[-n:-1]] + um.PRIOR)
        return p

    ratio = {g: math.log(chance(True, g)) - math.log(chance(False, g)) for g in seen}
    score = lambda a: sum(ratio[g] for g in grams(a)) / len(a) if a else None
    bins = collections.defaultdict(lambda: [0, 0])
    for host, path, rule in told:
        if rule is not None and host + path:
            s = score(host + path)
            bins[math.floor((min(max(s, -um.WIDEST), um.WIDEST) + um.WIDEST) / (2 * um.WIDEST) * um.BINS)][not rule.allow] += 1
    a, r = (sum(v[i] for v in bins.values()) for i in (0, 1))
    least = 0.0
    if a and r:
        place = lambda b: (1 - sum(v[0] for c, v in bins.items() if c < b) / a) + sum(v[1] for c, v in bins.items() if c < b) / r
        least = min(bins, key=lambda b: (-place(b), abs(b - um.BINS / 2), b)) / um.BINS * 2 * um.WIDEST - um.WIDEST
    out = []
    for host, path, rule in told:
        allow = rule.allow if rule else (score(host + path) or least) >= least
        out.append((host, path, rule and rule.name, "allow" if allow else "block"))
    return out


def test_urls_equal_a_plain_loop(spark):
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "http://net", "http://x.NET/EN/", "https://example.net/en/1?a=://b", "x://y#z",
             "http://notexample.net/en/2", "http://a.org/fr/", "http://ÄÖ.org/é?q", "http://long.com/" + "ab" * 3000]
    urls += ["http://spam.com/win-casino"] * 3
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, score string"), RULES)
    mine = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    want = plain_verdicts(urls)
    assert [mine[i] for i in range(len(urls))] == want
    assert {v for *_, v in want} == {"allow", "block"}


def test_urls_without_examples(spark):
    schema = "page_id long, url string"
    docs = spark.createDataFrame([(1, "http://a.com/x"), (None, None)], schema)
    assert [r["verdict"] for r in judge_urls(docs, RULES).collect()] == ["allow", "allow"]
    assert judge_urls(spark.createDataFrame([], schema), RULES).count() == 0
