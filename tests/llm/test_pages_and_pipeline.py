"""Main text of pages, and the pipeline's stages."""

import os
import sys

import pytest

from evenground.llm import quality, queries, toxicity, wrappers
from evenground.runtime import read_table
from tests.llm.test_near_copies import plain_components
from tests.llm.test_texts import check_packing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

PAGE = """<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var a = "</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>{title}</h1>{body}<form><label>Mail</label><input></form></article>
<aside class="sidebar">Most read</aside><div class="comments"><p>A reader says so</p></div><footer>Copyright</footer></body></html>"""


def page(title, *blocks):
    return PAGE.format(title=title, body="".join(f"<p>{b}</p>" for b in blocks))


def test_the_article_remains(spark):
    rows = [(i, f"https://h{i % 2}.example/p/{i}", page(f"Title {i}", f"first  of\n{i} &amp; caf&eacute;", "a <b>bold</b> word", *["more"] * (i % 4))) for i in range(30)]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        want = "\n".join([f"Title {i}", f"first of {i} & café", "a bold word", *["more"] * (i % 4)])
        assert (got[i].text, got[i].n_chars) == (want, len(want))


def test_without_an_article_the_constant_text_goes(spark):
    frame = "<html><body><div class=bar>Always the same</div><div><p>{}</p><ul><li><a href=x>all</a></li><li><a href=y>links</a></li></ul></div></body></html>"
    rows = [(i, "http://plain.example/", frame.format(f"story number {i}")) for i in range(8)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"story number {i}" for i in range(8)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.b/", "<p>open <div>text"), (3, "http://a.b/", "<<<>>> &#x0; &bogus; </p></p>"), (3, "http://a.b/", "<div>" * 3000 + "deep"), (4, "http://c.d/", "word " * 200_000)]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, slots string")
    got = wrappers.main_text(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert wrappers.main_text(frame.limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression():
    one, two = (wrappers.page_wrapper(f"<article><h1>{t}</h1>{'<p>x</p>' * n}{extra}</article>") for t, n, extra in (("a", 2, ""), ("b", 3, "<hr><table><tr><td>1</td></tr></table>")))
    merged = wrappers.align(one, two)
    shown = wrappers.as_regex(merged)
    assert "|" not in shown and "<p>" in shown and ")+" in shown and ")?" in shown and "#" in shown


def test_query_keeps_every_page(spark, llm_dir):
    got = queries.queries()["op2_html_extraction"](spark, llm_dir)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == read_table(spark, llm_dir, "pages").count()
    assert sum(bool(r.text) for r in rows) > 0.9 * len(rows)
    assert not any(x in r.text for r in rows for x in ("track(", "margin:0", "</p>"))


def test_pipeline_stages_are_the_operators(spark, llm_dir):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from evenground.llm.common import tokenizer_path

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]
    docs = read_table(spark, llm_dir, "documents")
    labels = read_table(spark, llm_dir, "labels")
    civil = {r.doc_id for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).where("score < 0.5").collect()}
    good = {r.doc_id for r in quality.quality(docs, quality.fit(docs, labels)).where("score >= 0.3").collect()} & civil
    kept = docs.where(docs.doc_id.isin(sorted(good)))
    first = set(plain_components(sorted((r.doc_id, r.text or "") for r in kept.collect())).values())
    rows = corpus_pipeline.run(spark, llm_dir).collect()
    assert {r.doc_id for r in rows} == first and len(first) < len(good)
    held = [(r.doc_id, r.text or "") for r in kept.collect() if r.doc_id in first]
    check_packing(rows, held, Tokenizer.from_file(tokenizer_path()))


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_stages_keep_the_columns_and_survive_odd_rows(spark, llm_dir, odd_docs, no_docs, stage):
    import corpus_pipeline

    out = corpus_pipeline.STAGES[stage][1](spark, odd_docs, llm_dir)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) <= odd_docs.count()
    if stage == 2:
        assert sorted(x for x in ids if x is not None) == [-9, 1, 4, 5, 6, 7, 8]
    assert corpus_pipeline.STAGES[stage][1](spark, no_docs, llm_dir).count() == 0
