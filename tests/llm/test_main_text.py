import pytest

from noticeflow.llm import main_text


@pytest.fixture(scope="module")
def chain():
    return main_text.train()


def test_held_out_pages(chain):
    right = total = 0
    for found, y in main_text.labelled_pages(150, seed=77):
        got = chain.decode(main_text.features(found))
        right += sum(a == b for a, b in zip(got, y))
        total += len(y)
    assert right >= 0.98 * total


def test_viterbi_is_the_best_of_all_sequences(chain):
    from itertools import product
    for found, _ in main_text.labelled_pages(12, seed=5):
        rows = main_text.features(found[:9])
        e = chain.emissions(rows)

        def value(y):
            return chain.steps[2][y[0]] + sum(x for x, k in zip(e, y) if k) + sum(
                chain.steps[a][b] for a, b in zip(y, y[1:]))

        if rows:
            best = max(product((0, 1), repeat=len(rows)), key=value)
            assert abs(value(chain.decode(rows)) - value(best)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><script>var t="</p><p>no";</script><style>p{}</style></head>
<body><header><h2>The Site</h2><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav></header>
<div class="cookie-consent">We use cookies. <button>OK</button></div><!-- <p>no</p> -->
<article><h1>Caf&eacute; opens&nbsp;late</h1><p>The first
 paragraph, with <b>bold</b> words &lt;and&gt; a <a href=x>link</a>, goes on for a while.
<p>The second one is <i>un</i>closed, but long enough to be read as text.
<div class="advertisement">Buy shoes now!</div><p>A third paragraph ends the story, as it should.</p></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story a lot, thanks for writing it.</p></div></section>
<aside class="sidebar"><h3>Related</h3><a href=y>Another story</a></aside><form><label>Email</label><input></form>
<footer>&copy; 2024 The Site</footer></body></html>"""
TEXT = ("Café opens late\n\nThe first paragraph, with bold words <and> a link, goes on for a while.\n\n"
        "The second one is unclosed, but long enough to be read as text.\n\nA third paragraph ends the story, as it should.")


def test_article_without_the_rest(chain):
    assert main_text.main_text(PAGE, chain) == TEXT


def test_blocks_of_odd_markup():
    texts = [b.text for b in main_text.blocks("a < b &am <p>x<br>y <script>z</p>")]
    assert texts == ["a < b &am", "x y"]
    assert [b.text for b in main_text.blocks("<p title='a>b'>t</p> end <!-- open <p>no")] == ["t", "end"]
    assert [b.text for b in main_text.blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")] == ["a", "b", "c", "d"]
    assert main_text.blocks(None) == main_text.blocks("") == main_text.blocks("<p") == []


def test_deep_nesting_and_long_text(chain):
    page = "<article>" + "<div><b>" * 5_000 + "<p>" + "deep words, " * 20_000 + "</p>"
    assert len(main_text.main_text(page, chain)) in (0, 12 * 20_000 - 1)
    assert sum(len(b.text) for b in main_text.blocks(page)) == 12 * 20_000 - 1


def test_query_shape_and_edges(spark, chain):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (3, "v", "", 3), (3, "v", "", 3), (None, "w", "<p>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = main_text.extract(df, chain).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in out] == [(1, "u", len(TEXT)), (2, None, 0), (3, "v", 0), (3, "v", 0),
                                                           (None, "w", 0)]
    assert out[0].text == TEXT and out[1].text == ""
    assert main_text.extract(df.limit(0), chain).collect() == []
