"""Main text and exact search."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pages, vafile


def site(body, i):
    return (f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            f"<div id='wrap'><div class='content'>{body}<p>All rights are reserved here</p></div><div class='sidebar'><p>Side {i}</p></div></div>"
            f"<div id=\"comments\"><p>Nice {i}</p></div><footer>F {i}</footer></body></html>")


def test_articles_menus_and_references():
    page = ("<!DOCTYPE html><body><nav>menu</nav><article><h1>A &amp; B&nbsp;&eacute;</h1><p>one <b>two</b>\n  three<p>four<br>five"
            "<aside>side</aside><form>f<input></form><script>var x='</p>';</script><ul><li>x<li>y</ul><!-- no --><div class='ad'>buy</div>"
            "<section class='comments'><p>c</p></section><p hidden>h</p><p>a < b</p></article><footer>foot</footer>")
    assert pages.main_text(page) == "A & B é\none two three\nfour\nfive\nx\ny\na < b"
    assert pages.main_text("") == "" and pages.main_text("<p>open <b>end") == "open end"
    assert pages.main_text("<b>x<article>in</b>side</article>") == "inside"


def test_names_count_as_a_whole():
    for name in ("content no-sidebar", "post has-sidebar", "entry share-buttons-on", "page layout-side", "post hidden-xs"):
        assert pages.main_text(f"<body><div class='{name}'><p>the article</p></div></body>") == "the article", name
    for name in ("sidebar", "site-footer", "cookie-notice", "comments_list", "x main-nav", "ad-slot-2"):
        assert pages.main_text(f"<body><p>text</p><div class='{name}'><p>gone</p></div></body>") == "text", name


def test_a_form_around_the_page():
    assert pages.main_text("<body><form><nav>menu</nav><h1>A title</h1><p>the article</p></form></body>") == "A title\nthe article"
    assert pages.main_text("<body><p>the whole article</p><form>your mail<input></form></body>") == "the whole article"
    assert pages.main_text("<form>ab</form><p>cd</p>") == "cd"  # half is not most
    assert pages.main_text("<form><input></form>") == ""


def test_template_of_a_host(spark):
    rows = [(i, f"http://h.example/{i}", site(f"<p>Own text number {i} of the page</p><p>more {i}</p>", i), "x") for i in range(12)]
    rows += [(100, "http://h.example/n", None, "x"), (101, None, "<p>lone</p>", "x"), (None, "bad", "", "x"),
             (102, "http://small.example/", site("<p>only</p>", 1), "x"), (103, "http://long.example", "<article>" + "<p>long text</p>" * 5000, "x")]
    rows.append(rows[0])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = pages.extract(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    # what stands on every page is the template's wording; a host with few pages has none
    assert text[3] == "Own text number 3 of the page\nmore 3"
    assert text[102] == "only\nAll rights are reserved here"
    assert text[100] == "" and text[101] == "lone" and text[None] == "" and text[103].count("\n") == 4999
    assert pages.extract(frame.limit(0)).count() == 0


def test_the_region_holds_all_text():
    teaser = "<main><h1>Head</h1><p>The long text of the page</p><article>teaser</article></main>"
    assert pages.main_text(teaser) == "Head\nThe long text of the page\nteaser"
    assert pages.main_text("<div class=post><h1>Head</h1><p class=lead>Lead of it</p><div class=entry><p>a longer text than both</p></div></div>") == (
        "Head\nLead of it\na longer text than both")
    deep = "<article>" + "<blockquote>" * 60 + "<p>deep</p>" + "</blockquote>" * 60 + "<p>after</p></article>"
    assert pages.main_text(deep) == "deep\nafter"


def test_no_text_of_a_host_is_lost_to_its_layout(spark):
    """No ``article`` and no ``main``: lead, entry and a quotation 40 elements deep belong to the text."""
    body = lambda i: (f"<body><div class=post><h1>Head {i}</h1><p class=lead>Lead {i}</p><div class=entry><p>Entry {i} is longer than the lead and the head</p>"
                      + "<blockquote>" * 40 + f"<p>Quote {i}</p>" + "</blockquote>" * 40 + "</div></div></body>")
    frame = spark.createDataFrame([(i, f"http://d.example/{i}", body(i)) for i in range(10)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert got == {i: f"Head {i}\nLead {i}\nEntry {i} is longer than the lead and the head\nQuote {i}" for i in range(10)}


def test_copies_of_an_article_keep_it(spark):
    """Host a: 10 captures of one article and one other page; host b: near copies with a counter; host c: one row 12 times."""
    copy = "<article><h1>Head</h1><p>The first paragraph of the article</p><p>The second one of it</p></article><footer>f</footer>"
    near = "<article><h1>Head</h1><p>The first paragraph of the article</p><p>The second one of it</p><p>views {}</p></article>"
    rows = [(i, f"http://a.example/{i}", copy) for i in range(10)] + [(10, "http://a.example/x", "<article><p>Another page</p></article>")]
    rows += [(100 + i, f"http://b.example/{i}", near.format(i)) for i in range(10)] + [(200, "http://c.example/", copy)] * 12
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    whole = "Head\nThe first paragraph of the article\nThe second one of it"
    assert len(got) == len(rows)
    assert all(r.text == ("Another page" if r.page_id == 10 else f"{whole}\nviews {r.page_id - 100}" if 100 <= r.page_id < 200 else whole) for r in got)


def test_classes_on_part_of_the_pages(spark):
    """Two layouts and an optional box on one host, a host of five pages; a passage that some articles quote is text."""
    own = lambda i: f"<p>Own text number {i} of this page</p>"
    left = lambda i: f"<body><div class=a><p>Left layout says this</p><div class=text>{own(i)}</div></div></body>"
    right = lambda i: f"<body><section class=b>{own(i)}<div class=z>Right layout says that</div></section></body>"
    box = lambda i: left(i).replace("<div class=text>", "<div class=box><h4>Under review</h4></div><div class=text>")
    quote = lambda i: left(i).replace("</div></div></body>", "<p>A passage that is quoted</p></div></div></body>")
    kinds = [*[left] * 6, *[right] * 9, *[box] * 5, *[quote] * 4]
    rows = [(i, f"http://two.example/{i}", kind(i)) for i, kind in enumerate(kinds)]
    rows += [(100 + i, f"http://five.example/{i}", left(100 + i)) for i in range(5)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {i: f"Own text number {i} of this page" for i, _, _ in rows}
    want |= {i: want[i] + "\nA passage that is quoted" for i, kind in enumerate(kinds) if kind is quote}
    assert got == want


def test_search_equals_comparing_all(spark):
    pick = np.random.default_rng(1)
    x = pick.normal(size=(300, 8)).astype(float)
    x[50:150] = x[7]                       # a vector that a third of all rows share
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8),
             (305, [0.5, -0.25]), (350, [1.0, 2.0]), (100, [float(v) for v in x[3]])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(4)
    got = vafile.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    fine = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            scores = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert vafile.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vafile.top_k(frame.filter("vec_id = 350"), F.col("vec_id") % 50 == 0).count() == 0
