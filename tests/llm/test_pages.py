"""Operators on pages and vectors."""

import random

import numpy as np
import pytest

from loomline.llm import html_extract, queries, topk, url_filter

PAGE = "<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a='</p>';</script><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li><a href='/x'>X</a></ul></nav><div class='ad'>Buy</div>%s<aside>Side</aside><div id=\"comments\"><p>First!</p></div><form><p>Mail</p></form><footer>&copy; y</footer></body></html>"


def test_article_without_what_surrounds_it(spark):
    rows = [
        (1, "http://a.com/1", PAGE % "<article><h1>Head  &lt;1&gt;</h1><p><b>Some\n <span class='ad x'>Buy <span>now</span> ok</span>text<br>more<p>And&nbsp;&#233;<ul><li>one<li>two</ul><div class='share'>Tweet</div><!-- <p>no</p> --></article>"),
        (2, "http://a.com/2", PAGE % "<article><h1>Other</h1><p>Line <span class='ad'>Buy</span><div class='share'>Post</div></article>"),
        (3, "http://b.com/1", PAGE % "<div class='content'><p>No article here, but much text in it.</p><p>Second line.</p></div>"),
        (4, "http://b.com/2", PAGE % "<div class='content'><p>Another one of the same host here.</p></div>"),
        (5, None, None), (6, "no host", ""), (7, "http://a.com/3", "<article><p>cut off <b>he"), (8, "http://a.com/4", "a < b <"), (None, "http://a.com/2", PAGE % "<article><p>Line</article>"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, roots string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "Head <1>\nSome text\nmore\nAnd é\none\ntwo"
    assert got[2].text == "Other\nLine" and got[2].url == "http://a.com/2" and got[2].n_chars == 10
    assert got[3].text == "No article here, but much text in it.\nSecond line."
    assert (got[5].text, got[6].text, got[7].text, got[8].text, got[None].text) == ("", "", "cut off he", "a < b <", "Line")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_template_of_equal_occurrence():
    token = lambda path, pages, vector, words=0, line=0: (path, line, pages, (vector, 0), words, 0)
    tokens = [token("", 4, 0, 600), token("/html", 4, 1), token("/html/body", 4, 1), token("/html/body/div.x", 4, 1, 90), token("/html/body/div.y", 4, 1, 10), token("/html/body/div.z/p", 3, 9, 500), token("/html/body/div.ad!", 2, 8)]
    assert html_extract.deduce(tokens) == (["/html/body/div.x"], frozenset(), {"/html/body/div.ad!"})
    assert html_extract.deduce([*tokens, token("/html/body/article", 4, 1, 5)]).roots == ["/html/body/article"]
    # What all pages say is the template's, and no reason to take its element for the main slot; but not if that is most of what they say.
    assert html_extract.deduce([*tokens[:4], token("/html/body/div.y", 4, 1, 60), token("/html/body/div.x", 4, 0, 70, 7)]) == (["/html/body/div.y"], {7}, frozenset())
    assert html_extract.deduce([*tokens, token("/html/body/div.x", 4, 0, 350, 7)]).lines == frozenset()
    assert html_extract.deduce([]) == ([], frozenset(), None)


def own_hosts():
    """Hosts without article, menu or footer elements, with what an editor would keep of each page."""
    r = random.Random(12)
    words = lambda n: " ".join(r.choice("river stone under light carries seven north wind paper along green hills quietly older".split()) + str(r.randrange(50)) for _ in range(n))
    rows, truth = [], {}
    for host in range(6):
        menu, foot = f"Home News Contact {host}", f"Copyright {host} by the publisher, all rights reserved"
        for k in range(5):
            body = [words(r.choice([5, 13, 60])) for _ in range(r.randint(1, 4))]
            notice = "<div class='notice'>" + words(4) + "</div>"
            inner = "".join(f"<p class='{r.choice(['share-price', 'notice-board', 'plain'])}{k}'>{x}</p>" for x in body)
            if host % 3 == 0:
                page = f"<div>{menu}</div><div>{inner}</div><div>{foot}</div>"
            elif host % 3 == 1:
                page = f"<div class='top{host}'><span>{menu}</span></div>{notice}<section>{inner}</section><div>{foot}</div>"
            else:
                page = f"<table><tr><td>{menu}</td></tr></table>{inner}<center>{foot}</center>"
            rows.append((host * 10 + k, f"http://own{host}.org/{k}", f"<html><body>{page}</body></html>"))
            truth[host * 10 + k] = body
    return rows, truth


def test_the_template_decides(spark):
    """Lines kept and cut on hosts of plain elements; without their templates, most pages would read otherwise."""
    rows, truth = own_hosts()
    rows += [rows[7], rows[7]]  # repeated rows
    got = {}
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert got.setdefault(r.page_id, r.text) == r.text and r.n_chars == len(r.text)
    found, kept = sum(len(t.split("\n")) for t in got.values()), sum(len(set(t.split("\n")) & set(truth[k])) for k, t in got.items())
    assert kept / found > 0.98 and kept / sum(map(len, truth.values())) > 0.98
    bare = {k: html_extract.main_text(html, html_extract.Template([])) for k, _, html in rows}
    assert sum(bare[k] != got[k] for k in got) > 0.9 * len(got)


def test_marks_on_a_single_page_are_content(spark):
    html = "<article><h1>Head</h1><div class='notice-board'>Board</div><p class='menu-engineering'>Menus</p><p id='share price'>Price</p><p>%s</p></article>"
    rows = [(1, "http://one.org/1", html % "Text"), (2, "http://two.org/1", html % "A"), (3, "http://two.org/2", "<article><p>Other</p></article>"), (4, "http://three.org/", html % ("long " * 200_000)), (5, "http://four.org/", "<div class='ad'>Buy now</div><div><p>Only text of it</p></div>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head\nBoard\nMenus\nPrice\nText" and got[2] == "Head\nBoard\nMenus\nPrice\nA" and got[3] == "Other"
    assert len(got[4]) == len("Head\nBoard\nMenus\nPrice\n") + 5 * 200_000 - 1 and got[5] == "Only text of it"


def test_content_of_every_kind_without_an_article(spark):
    """Headings, lists, quotes, tables and pre blocks stay, as do a heading, a lead and a quote beside the slot; a list of links does not."""
    body = "<h2>Part %d</h2><p>%s</p><ul><li>one thing<li>two</ul><blockquote>Quote</blockquote><table><tr><td>cell</table><pre>code</pre>"
    want = "Part %d\n%s\none thing\ntwo\nQuote\ncell\ncode"
    p = "a word and another one " * 20
    links = "<div class='left'><a href='/1'>first page</a> <a href='/2'>second page</a></div>"
    rows = [(k, f"http://a.com/{k}", PAGE % f"<div class='content'>{body % (k, p)}</div>") for k in range(4)]
    rows += [(10 + k, f"http://b.com/{k}", PAGE % f"{links}<div class='content'><h1>Title {k}</h1><div class='lead'>A lead.</div><div class='body'>{body % (k, p)}</div>{'<blockquote>Seldom</blockquote>' * (k == 3)}{links}</div>") for k in range(4)]
    rows += [(20, "http://c.com/", PAGE % f"<h1>Alone</h1><div class='content'>{body % (0, p)}</div>")]
    rows += [(30 + k, f"http://d.com/{k}", PAGE % f"{links}<div class='content'><div class='para'>{p}</div><div class='para'>{p}</div><div class='cite'>Cited</div></div>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert got[k] == want % (k, p.strip())
        assert got[10 + k] == f"Title {k}\nA lead.\n" + want % (k, p.strip()) + "\nSeldom" * (k == 3)
    assert got[20] == "Alone\n" + want % (0, p.strip())
    assert got[30] == got[32] == f"{p.strip()}\n{p.strip()}\nCited"


def test_elements_that_look_like_raw_text(spark):
    """Self-closed svg and math, math's text, and names that only begin like those of raw elements."""
    texts = {
        "<p>one <svg viewBox='0 0 1 1'/> two</p><p>three</p>": "one two\nthree", "<p>one <math/> two</p><p>three</p>": "one two\nthree",
        "<p>one <svg a=\"/>\"><text>no</text></svg> two": "one two", "<p>if <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> then": "if x<2 then",
        "<title-card>a card</title-card><p>and <template-x>more</template-x>": "a card\nand more", "<script src='x'/>no</script><p>yes": "yes", "<p>one<style\n>no</style > two": "one two",
    }
    rows = [(k, "http://a.com/", f"<article>{html}</article>") for k, html in enumerate(texts)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


RULES = [url_filter.parse_rule(x) for x in queries.URL_RULES]


def plain_scores(hosts, edges):
    out = {"trust": {}, "distrust": {}}
    for kind, flip in (("trust", False), ("distrust", True)):
        seeds = [h for h, (trusted, blocked) in hosts.items() if (blocked if flip else trusted)]
        start = {h: 1.0 for h in seeds}
        flow = [(d, s, w) if flip else (s, d, w) for s, d, w in edges]
        total = {}
        for s, _, w in flow:
            total[s] = total.get(s, 0) + w
        rank = dict(start)
        for _ in range(url_filter.ROUNDS):
            fresh = {h: v * (1 - url_filter.DAMPING) for h, v in start.items()}
            for s, d, w in flow:
                if s in rank:
                    fresh[d] = fresh.get(d, 0) + rank[s] * w / total[s] * url_filter.DAMPING
            rank = fresh
        out[kind] = rank
    return out


def test_urls(spark):
    link = lambda *hosts: "".join(f"<a href='//{h}/p'>x</a>" for h in hosts)
    rows = [
        (1, "http://Spam.example.com/en/1", link("x.com")), (2, "https://example.com/en/77?q", link("good.org")), (3, "ftp://a.example.net/de/8", link("spam.example.com")), (4, "http://b.net/de/9#a/b", ""),
        (5, "http://c.org/es/", None), (6, "http://c.org?x=/es/", link("b.net")), (7, "good.org/x", ""), (8, None, ""), (9, "http://friend.io/", link("spam.example.com", "spam.example.com", "b.net")),
        (10, "http://good.org/", link("other.org")), (11, "http://other.org", ""), (12, "://h#f", ""), (13, "http://notexample.com.evil/en/7", ""), (None, "http://dÉ.com/en/", ""),
    ]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, host string, trust double")
    got = {r.page_id: r for r in url_filter.judge(df, RULES).collect()}
    want = {1: ("spam.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/77", "example.com/en/7", "allow"), 3: ("a.example.net", "/de/8", "example.net/de/8", "block"), 4: ("b.net", "/de/9", "net/de/", "allow"),
            5: ("c.org", "/es/", "org/es/", "block"), 6: ("c.org", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("friend.io", "/", None, "block"),
            10: ("good.org", "/", None, "allow"), 11: ("other.org", "", None, "allow"), 12: ("h", "", None, "allow"), 13: ("notexample.com.evil", "/en/7", None, "allow"), None: ("dÉ.com", "/en/", "com/en/", "block")}
    for page, line in want.items():
        assert (got[page].host, got[page].path, got[page].rule, got[page].verdict) == line, page
    hosts = {"spam.example.com": (False, True), "example.com": (True, False), "a.example.net": (False, True), "b.net": (True, False), "dÉ.com": (False, True)}
    edges = [("spam.example.com", "x.com", 1), ("example.com", "good.org", 1), ("a.example.net", "spam.example.com", 1), ("c.org", "b.net", 1), ("friend.io", "spam.example.com", 2), ("friend.io", "b.net", 1), ("good.org", "other.org", 1)]
    scores = plain_scores(hosts, edges)
    for r in got.values():
        assert r.trust == pytest.approx(scores["trust"].get(r.host, 0), abs=1e-9) and r.distrust == pytest.approx(scores["distrust"].get(r.host, 0), abs=1e-9), r
    assert url_filter.judge(df.limit(0), RULES).count() == 0


@pytest.mark.parametrize("n", [3, 2000])
def test_verdicts_do_not_depend_on_the_number_of_hosts(spark, n):
    """Blocked seeds, hosts that link to them, and a host with as much trust as distrust, among few and many seeds."""
    link = lambda *hosts: "".join(f"<a href='//{h}/p'>x</a>" for h in hosts)
    rows = [(None, f"http://s{k}.com/en/{j}", "") for k in range(n) for j in (1, 2)] + [(k, f"http://s{k}.com/x", "") for k in range(n)]
    rows += [(10_000 + k, f"http://near{k}.io/", link(f"s{k}.com", "other.org")) for k in range(n)]
    rows += [(20_000 + k, f"http://far{k}.io/", link(f"near{k}.io")) for k in range(n)]
    rows += [(30_000, "http://other.org/", ""), (30_001, "http://good.net/de/1", link("good.io")), (30_002, "http://good.io/", link("s0.com"))]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect() if r.page_id is not None}
    for k in range(n):
        assert (got[k], got[10_000 + k], got[20_000 + k]) == ("block", "block", "block"), k
    assert (got[30_000], got[30_001], got[30_002]) == ("allow", "allow", "allow")


def plain_top(rows, k, every):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vectors if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 1000])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 17)
    r = random.Random(6)
    rows = [(k, [r.choice([0.0, 0.5, -0.25, r.random()]) for _ in range(8)]) for k in range(120)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, None), (203, [1.0, None]), (210, [float("nan")] * 8), (211, [float("inf")] * 8), (220, []), (230, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*x, "a") for x in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted(tuple(x) for x in topk.top_k(df, 5, 10).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain_top(rows, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0
    few = df.where("vec_id in (10, 11, 20)")
    assert topk.top_k(few, 5, 10).count() == 4


def test_scores_are_exact_however_large(spark):
    r = random.Random(9)
    rows = [(k, [r.choice([0.0, 4e6, -3.7e6, 1234567.8, r.random()]) for _ in range(6)]) for k in range(60)]
    rows += [(70, [4e6] * 6), (71, [4e6] * 6), (72, [100000.0]), (73, [200000.0]), (74, [3e-7, -3e-7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = plain_top(rows, 5, 10)
    assert sorted(tuple(x) for x in topk.top_k(df, 5, 10).collect()) == want and max(x[3] for x in want) > topk.EXACT
    rows = [(0, [2.0, -2.0]), (1, [1e18, 1e18]), (2, [1e15, 1e15]), (3, [-1e300, -1e300]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_k(df, 5).collect()) == plain_top(rows, 5, 50)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e13]), (1, [1e13])], "vec_id long, embedding array<double>")).collect()
