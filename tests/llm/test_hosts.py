"""Main text of pages of one host: hidden inline elements, names inside articles, unlike templates, copies."""

import random
from functools import reduce

import pytest
import xxhash

from evenground.llm import wrappers


def texts(*pages):
    wrapper = reduce(wrappers.align, map(wrappers.page_wrapper, pages))
    return [wrappers.extract(p, wrapper) for p in pages]


def test_hidden_inline_elements_end_where_their_end_tag_stands():
    for page, want in (
        ('<p>foo <span style="display:none">x</span> bar</p>', "foo bar"),
        ('<p><i class="fa fa-info" aria-hidden="true"></i> text</p><p>more</p>', "text\nmore"),
        ('<a class="visually-hidden" href="#x">skip</a><p>one</p><p>two</p>', "one\ntwo"),
        ("<p>a <span hidden>x <span>y</span> z</span> b</p>", "a b"),
        ("<div>a <span hidden>x<div><span>y</div>z</span>b</div>", "a b"),
        ("<p>a <span hidden>x <p>b</p>", "a\nb"),
        ('<p>a<img aria-hidden="true"> b</p>', "a b"),
        ("<p>a <span hidden>never ended</p><p>b</p>", "a\nb"),
    ):
        assert texts(f"<article>{page}</article>") == [want]
    skip = '<a class="visually-hidden" href="#x">skip</a>'
    assert texts(f"{skip}<article><p>one</p></article>{skip}") == ["one"]


def test_names_inside_an_article_need_evidence():
    body = '<section id="discussion"><h2 id="related-work">Work {0}</h2><p>first {0}</p></section><section id="search-algorithms"><p>second {0}</p></section>'
    body += '<h2 id="social-history">History {0}</h2><div id="legal-basis"><p>law {0}</p></div><div class="warning"><p>hot {0}</p></div>'
    gone = '<div class="related-posts"><a href="/{0}">see {0}</a></div><div class="notice-box">always so</div><div class="ad-slot">buy {0}</div><div class="comments">said {0}</div>'
    pages = [f"<article>{(body + gone).format(i)}</article>" for i in range(4)]
    want = ["Work {0}", "first {0}", "second {0}", "History {0}", "law {0}", "hot {0}"]
    assert texts(*pages) == ["\n".join(want).format(i) for i in range(4)]
    assert texts(pages[0]) == ["\n".join([*want, "always so"]).format(0)]


def unlike_pages():
    made = [(f"<nav>menu</nav><article><p>story {i}</p></article><div>rest {i}</div>", f"story {i}") for i in range(4)]
    made += [(f"<nav>menu</nav><main><p>guide {i}</p></main><div>rest {i}</div>", f"guide {i}") for i in range(4)]
    return made + [(f"<nav>menu</nav><div><p>plain {i}</p></div>", f"plain {i}") for i in range(4)]


def test_unlike_templates_on_one_host_and_on_none(spark):
    made = unlike_pages()
    rows = [(i, url, page) for url in ("http://one.example/", "no host") for i, (page, _) in enumerate(made)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text == made[r.page_id][1] for r in got)


def test_copies_of_a_page_are_one_page_and_lists_of_links_stay():
    one = "<div><h3>Heading</h3><p>the only paragraph</p><ul><li>item</li></ul></div>"
    for copies in (1, 2, 3, 50):
        assert texts(*[one] * copies) == ["Heading\nthe only paragraph\nitem"] * copies
    listed = [f"<p>see {i}</p><ul><li><a href=x>first {i}</a></li><li><a href=y>second {i}</a></li></ul>" for i in range(5)]
    assert texts(*listed) == [f"see {i}\nfirst {i}\nsecond {i}" for i in range(5)]
    same = [f"<div class=top><p>constant</p></div><div class=menu{'' if i % 2 else 's'}>{i}</div>" for i in range(6)]
    assert texts(*same) == [""] * 6  # header and menu by name
    alike = [f"<div><p>constant</p></div><nav>{i}</nav>" for i in range(6)]
    assert texts(*alike) == ["constant"] * 6  # nothing else on them varies but the menu


def test_layout_names_inside_an_article_are_kept():
    body = '<h1>Title {0}</h1><div class="side-by-side"><p>left {0}</p><p>right</p></div><p class="warning">mind the gap</p><div class="col2 search-results"><p>found {0}</p></div>'
    pages = [f"<article>{body.format(i)}</article>" for i in range(12)]
    assert texts(*pages) == ["\n".join(["Title {0}", "left {0}", "right", "mind the gap", "found {0}"]).format(i) for i in range(12)]


def test_tables_without_an_article_lose_menu_and_advert():
    page = "<html><body><table><tr><td class=c1>Home News</td><td class=c2><p>story {0}</p>{1}</td><td class=c3>Buy now Offer</td></tr></table></body></html>"
    pages = [page.format(i, f"<p>more of {i}</p>" * (i % 3)) for i in range(12)]
    assert texts(*pages) == ["\n".join([f"story {i}", *[f"more of {i}"] * (i % 3)]) for i in range(12)]


def test_like_elements_are_told_apart_by_the_template_s_text():
    page = "<body><div>Home News About</div>{1}<div>story number {0}</div><div>All contents ours</div></body>"
    pages = [page.format(i, f"<div>extra {i}</div>" * (i % 2)) for i in range(10)]
    assert texts(*pages) == ["\n".join([*[f"extra {i}"] * (i % 2), f"story number {i}"]) for i in range(10)]


def test_long_irregular_lists_and_many_keys_lose_nothing():
    draw = random.Random(5)
    pages, want = [], []
    for i in range(6):
        blocks = [(draw.choice(["p", "h2", "blockquote", f"p class=k{draw.randrange(90)}"]), f"text {i} {j}") for j in range(300)]
        pages.append("<nav>menu</nav><article>" + "".join(f"<{t}>{x}</{t.split()[0]}>" for t, x in blocks) + "</article>")
        want.append("\n".join(x for _, x in blocks))
    assert texts(*pages) == want
    deep = "<div>" * 400 + "at the bottom" + "</div>" * 400 + "<p>after</p>"
    assert texts(f"<article>{deep}</article>", f"<article>{deep.replace('after', 'behind')}</article>") == ["at the bottom\nafter", "at the bottom\nbehind"]


def dealt_texts(spark, rows, how):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame = {1: lambda: frame.coalesce(1), 3: lambda: frame.repartition(3, "page_id"), 5: lambda: frame.orderBy("page_id", ascending=False).repartition(5, "url"), 7: lambda: frame.repartition(7)}[how]()
    return {r.page_id: r.text for r in wrappers.main_text(frame).collect()}


def random_hosts(hosts, pages):
    """Pages without an article whose blocks come and go, with lines that only some share."""
    draw, rows = random.Random(9), []
    for k in range(hosts):
        lines = [f"line {k} {j}" for j in range(4)] + ["Footer like line", "Home News", "All ours"]
        for i in range(pages):
            blocks = [f"<{t}>{x}</{t}>" for t, x in ((draw.choice(["p", "div", "td", "span"]), draw.choice([*lines, f"own {k} {i} {j}"])) for j in range(draw.randint(1, 9)))]
            rows.append((len(rows), f"http://h{k}.example/{i}", f"<div>{''.join(blocks)}</div><p>Footer like line</p>"))
    return rows + [(len(rows) + i, "http://h0.example/copy", rows[0][2]) for i in range(30)]


@pytest.mark.parametrize("leaf", [64, 2])
def test_texts_do_not_depend_on_how_pages_are_dealt(spark, monkeypatch, leaf):
    monkeypatch.setattr(wrappers, "LEAF", leaf)
    monkeypatch.setattr(wrappers, "ROUND_BITS", 6 if leaf > 2 else 1)
    rows = random_hosts(20, 10)
    found = [dealt_texts(spark, rows, how) for how in (1, 3, 5, 7)]
    assert found[0] == found[1] == found[2] == found[3]
    assert len(found[0]) == len(rows)


def test_texts_are_those_of_one_pass_in_the_order_of_hashes(spark):
    rows = [*random_hosts(6, 10), *((5000 + i, "no host", page) for i, (page, _) in enumerate(unlike_pages()))]
    hosts = {}
    for _, url, page in rows:
        hosts.setdefault(url.split("/")[2] if "//" in url else "", {})[page] = xxhash.xxh64_intdigest(page.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(page.encode(), 42) >> 63)
    known = {h: reduce(wrappers.align, map(wrappers.page_wrapper, sorted(pages, key=pages.get))) for h, pages in hosts.items()}
    want = {i: wrappers.extract(page, known[url.split("/")[2] if "//" in url else ""]) for i, url, page in rows}
    assert dealt_texts(spark, rows, 3) == want


def test_merging_in_rounds_gives_the_same_texts(spark, monkeypatch):
    made = unlike_pages()
    rows = [(i, "http://one.example/", page) for i, (page, _) in enumerate(made)]
    monkeypatch.setattr(wrappers, "LEAF", 2)
    monkeypatch.setattr(wrappers, "ROUND_BITS", 1)
    assert dealt_texts(spark, rows, 7) == {i: text for i, (_, text) in enumerate(made)}


def test_a_group_of_very_many_keys_is_remembered_whole():
    pages = ["<nav>menu</nav>" + "".join(f"<div class=k{j}>told {j}</div><p>text {i} {j}</p><div class=k{j}>again {i}</div>" for j in range(1500)) for i in range(4)]
    assert texts(*pages) == ["\n".join(x for j in range(1500) for x in (f"text {i} {j}", f"again {i}")) for i in range(4)]
