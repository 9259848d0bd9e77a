import random

import numpy as np
import pytest

from postlytics.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div class="site-header">Site</div><nav><ul><li><a href="/a">Menu</a></li></ul></nav>%s
<aside>Side</aside><form>Form <p>x</p></form><div class="notice">We use cookies</div><section id="comments"><p>Nice!</p></section>
<footer>&copy; me</footer><script>var t="</p>";</script></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><header><h1>A &amp; B</h1></header><p>One\n two<br>three<p><b>Fo</b>ur &#233;</p></article>", "A & B One two three Four é"),
        ("<main><p>Body</p><div class='share-bar'>Share</div><!-- <p>no</p> --><p title='a > b'>More</main>", "Body More"),
        ("<article><p>Ad</p><div class=ad>Buy</div><ul><li>x<li>y</ul></article>", "Ad x y"),
        ("<article><p>1 < 2 and a<b</p></article>", "1 < 2 and a"),
    ],
)
def test_markup_decides(body, text):
    assert " ".join(t for t, _ in html.page_lines(PAGE % body)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p style="overflow:hidden">Kept', "Kept"),
        ('<article><p title="hidden gem">Kept', "Kept"),
        ('<body class="has-sidebar"><article><p>Kept', "Kept"),
        ('<article data-id="nav" data-role=menu><p>Kept', "Kept"),
        ('<main class="no-comments"><p>Kept', "Kept"),
        ('<html class="js no-search"><body><main><p>Kept', "Kept"),
        ('<div class="layout with-sidebar"><article id="search" class="related"><p alt="class=ad">Kept', "Kept"),
        ('<article><p>Kept</p><p hidden>Gone</p><p HIDDEN="">Gone</p><p aria-hidden=true>Gone</p><p aria-hidden="false">Kept</p></article>', "Kept Kept"),
        ('<article><p>Kept</p><article class="comment"><p>Gone</p></article></article>', "Kept"),
        ('<div CLASS="Ad"><p>Gone</p></div><div Role=navigation>Gone</div><p>Kept', "Kept"),
    ],
)
def test_attributes_are_read_by_name(page, text):
    assert " ".join(t for t, _ in html.page_lines(page)) == text


def slow_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_longest():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = html.common_lines(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        assert len(pairs) == slow_common(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_shared_lines_of_nearest_pages_go(spark):
    page = "<body><div>Welcome</div><div>{}</div><article><p>All rights reserved.</p></article><div>Contact</div></body>"
    rows = [
        (1, "http://h.org/a/1?x=2", page.format("one")),
        (2, "https://H.org/a/2#y", page.format("two")),
        (3, "http://other.org/a/2", page.format("three")),
        ((1 << 53) + 1, None, None),
        (None, "http://h.org", ""),
        (6, "nonsense", "<div>plain</div> text &lt;"),
    ]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, at int, lines string")
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html.extract_text(pages).collect()}
    assert found == {
        1: (rows[0][1], "one All rights reserved.", 24),
        2: (rows[1][1], "two All rights reserved.", 24),
        3: (rows[2][1], "Welcome three All rights reserved. Contact", 42),
        (1 << 53) + 1: (None, "", 0),
        None: ("http://h.org", "", 0),
        6: ("nonsense", "plain text <", 12),
    }
    assert html.extract_text(pages.limit(0)).count() == 0
    assert html.extract_text(pages.unionAll(pages)).count() == 12


def test_very_long_page(spark):
    body = "<article>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</article>"
    pages = spark.createDataFrame([(1, "http://h.org", body)], "page_id long, url string, html string")
    assert html.extract_text(pages).first().text == " ".join(f"line {i}" for i in range(30_000))
