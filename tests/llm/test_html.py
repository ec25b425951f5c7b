"""Block splitting and the trained labeller on pages with known articles."""

import random

import pytest

from noteframe.llm import html_text as H

PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href='/'>Home</a><li><a>News</a></ul></nav><div class='ad'>Buy now</div>{article}"
    "<aside class='sidebar'>More here</aside><footer>&copy; me</footer></body></html>"
)


def page(rnd):
    words = lambda n: " ".join("".join(rnd.choice("abcdetno") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    body = [words(rnd.randint(3, 60)) for _ in range(rnd.randint(1, 6))]
    title = words(5)
    html = f"<article><h1>{title}</h1>" + "".join(f"<p><b>{b}<br>" for b in body) + "</article>"
    return PAGE.replace("{article}", html), "\n".join([title, *body])


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(6)
    return [page(rnd) for _ in range(260)]


@pytest.fixture(scope="module")
def weights(pages):
    return H.train([p for p, _ in pages[:120]])


def test_blocks_are_split_at_block_elements_only():
    got = [b[1] for b in H.blocks("<p>a <b>b</b>\n c<br>d<p>e &amp; f<div>g</div>h</p><ul><li>i<li>j</ul><!-- no --><script>k</script>")]
    assert got == ["a b c d", "e & f", "g", "h", "i", "j"]
    assert H.blocks(None) == H.blocks("") == H.blocks("<p> \n </p>") == []
    assert H.blocks("<p>broken &am")[0][1] == "broken &am"


def test_articles_are_found_on_unseen_pages(pages, weights):
    assert H.main_texts([p for p, _ in pages[120:]], weights) == [t for _, t in pages[120:]]


def test_unknown_containers_and_boilerplate_inside(weights):
    html = PAGE.replace(
        "{article}",
        "<main><h1>The head</h1><p>First words of the text.</p><div class='newsletter'>Subscribe to us</div><p>Second part of it.</p>"
        "<section class='comments'><div class='comment'><p>Nice post</p></div></section></main>",
    )
    assert H.main_texts([html], weights) == ["The head\nFirst words of the text.\nSecond part of it."]


def test_tags_that_may_be_left_out(pages, weights):
    assert [b.text for b in H.blocks("<html><head><title>T</title><p>Hello</p><p>There")] == ["Hello", "There"]
    assert [b.text for b in H.blocks("<head><meta charset=x><script src='a'/><style>p</style>Bare words<p>More")] == ["Bare words", "More"]
    assert [b.text for b in H.blocks("<head>\n<script>var head</script>\n</head><body><p>x</p></body>")] == ["x"]
    assert [b.text for b in H.blocks("<p>area <math><mi>a</mi><mo>=</mo><mn>2</mn></math> and <svg><path d='z'/><text>label</text></svg> on")] == [
        "area a=2 and label on"
    ]
    bare = [p.replace("</head>", "").replace("<body>", "") for p, _ in pages[120:180]]
    assert H.main_texts(bare, weights) == [t for _, t in pages[120:180]]


def test_names_around_a_block_equal_a_list_of_all_open_elements(pages):
    html = "<main class='Ad x'><div id=post><p>a<section class=post><article>b<p>c</section>d</main>e<td>f<td>g</div>h"
    got = {b.text: (b.box, b.other) for b in H.blocks(html)}
    assert got["a"] == (("main",), True) and got["b"] == (("article", "main"), True) and got["h"] == ((), False)
    names = {b.text: b.names for b in H.blocks(html)}
    assert names["a"] == H._bits(["ad", "x", "div", "post", "p"]) and names["d"] == H._bits(["ad", "x", "div", "post"])
    assert names["b"] == H._bits(["ad", "x", "div", "post", "section"]) and names["h"] == H._bits(["td"])


def test_a_table_without_marks_is_learned_from_the_names_of_the_rest(pages):
    bare = [p.replace("article>", "div>") for p, _ in pages]
    weights = H.train(bare[:120])
    assert H.main_texts(bare[120:], weights) == [t for _, t in pages[120:]]


def test_long_and_deep_pages(weights):
    import time

    start = time.time()
    assert len(H.blocks("<div>x" * 50_000)) == 50_000
    assert len(H.blocks("<b><p>x</i></table>" * 20_000)) == 20_000
    assert time.time() - start < 20
    page = "<nav>menu</nav><main>" + "<p>some words of it</p>" * 130 + "</main><footer>the end</footer>"
    parsed = H.blocks(page)
    whole = H._forward(weights, *H._padded([H.features(parsed)]))[0][0]
    assert H._forward_long(weights, parsed, 17) == pytest.approx(whole, abs=1e-5)
    assert H.main_texts([page, "<p>x"], weights, piece=17) == H.main_texts([page, "<p>x"], weights)


def test_gradients_equal_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    w, u, b = rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), rng.normal(size=8)
    goal = rng.normal(size=(2, 4, 2))
    loss = lambda w, u, b: float((H._lstm(x, w, u, b, mask)[0] * goal).sum())
    tape = []
    H._lstm(x, w, u, b, mask, tape)
    dw, du, db = H._lstm_back(x, u, tape, goal)
    for at, name, slope in (((1, 5), 0, dw), ((1, 2), 1, du), ((6,), 2, db)):
        args = [w.copy(), u.copy(), b.copy()]
        args[name][at] += 1e-2
        up = loss(*args)
        args[name][at] -= 2e-2
        assert slope[at] == pytest.approx((up - loss(*args)) / 2e-2, rel=5e-2, abs=5e-3)


def test_extract_rows(spark, pages):
    rows = [(k, f"u{k}", p, "x") for k, (p, _) in enumerate(pages[:80])]
    rows += [(None, None, None, "x"), (7, "again", pages[7][0], "x"), (900, "u", "", "x"), (901, "u", "<nav>menu</nav>" * 3, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(frame).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[None] == texts[900] == texts[901] == "" and all(texts[k] == pages[k][1] for k in range(80))
    assert H.extract(frame.limit(0)).collect() == []
    # Copies count once in the sample, unmarked pages only where no page is marked.
    many = spark.createDataFrame([(pages[0][0],)] * 500 + [(p,) for p, _ in pages[1:20]] + [("<p>bare</p>",), (None,), ("",)], "html string")
    assert sorted(H.sample(many)) == sorted(p for p, _ in pages[:20])
    assert H.sample(many.where("html = '<p>bare</p>'")) == ["<p>bare</p>"] and len(H.sample(many, H.Labeller(sample_pages=3))) == 3
    assert [r.text for r in H.extract(frame.where("page_id = 901")).collect()] == [""]
