from ledgerloom.llm import html_extract
from ledgerloom.llm.common import table

from .conftest import SMALL

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- ad --><div class="ad">Buy</div><article><header><h1>Title &amp; more</h1></header><p><b>First   para <br>goes on<p>Second&nbsp;one &lt;3
</p><form><input name=q><label>Search</label></form><blockquote>Quoted</blockquote><p>No.</p><aside>See also</aside><p>End</p></article>
<section id="comments"><p>A reader says so</p></section><div class="sidebar">Side</div><footer>&copy; x</footer></body></html>"""


def test_page_with_an_article():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst para goes on\nSecond one <3\nQuoted\nNo.\nEnd"


def test_page_without_an_article_keeps_the_surge():
    body = "".join(f"<p>{'long words of the text ' * 6}{i}</p>" for i in range(4))
    page = f"<body><ul class=menu><li>a<li>b</ul><h1>Head</h1>{body}<div class='comments'><p>no</p></div><div class='footer-links'>x</div><p>tiny</p></body>"
    text = html_extract.main_text(page)
    assert text.startswith("Head\nlong words") and text.count("\n") == 4 and "tiny" not in text and "no" not in text.split("\n")


def test_broken_pages():
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == "" and html_extract.main_text("<") in ("", "<")
    assert html_extract.main_text("<article><p>cut of") == "cut of"
    assert html_extract.main_text("<article><p>a</b></i></p></div></article></article><p>x") == "a"
    assert html_extract.main_text("<p>" * 3000 + "deep") == "deep"
    assert len(html_extract.main_text("<article><p>" + "w " * 200000)) == 399999


def test_windows_bound_the_body_and_lose_nothing_in_it():
    body = "".join(f"<p>{'long words of the text ' * 20}{i}</p>" for i in range(6))
    closing = "<p>" + "c" * 80 + "</p>"
    for between in ("<aside>Ad</aside>", "<form>Mail</form>", "<div class=ad>a</div><div class=ad>b</div><div class=ad>c</div>"):
        page = f"<ul class=menu><li>a<li>b<li>c</ul><div>Up</div><ul class=menu><li>a<li>b<li>c</ul>{body}{between}{closing}<p>z</p><footer>x</footer>"
        text = html_extract.main_text(page).split("\n")
        assert len(text) == 8 and text[0].startswith("long words") and text[-2:] == ["c" * 80, "z"]
    assert html_extract.main_text("".join(f"<p>p{i}</p>" for i in range(9))).count("\n") == 8
    assert html_extract.regions([2, 2, 2, 50, 60, 1, 1, 1, 2, 0], 3, 40) == [(1, 7)]


def test_names_around_and_inside_the_article():
    for name in ("class='page has-sidebar'", "id='content-with-sidebar'", "class=no-comments", "class='sidebar-left'", "id=search"):
        assert html_extract.main_text(f"<div {name}><article><p>Body</p></article><div class=sidebar-left>Side</div></div>") in ("Body",), name
        assert html_extract.main_text(f"<div {name}><p>{'body ' * 40}</p><p>Short</p></div>").endswith("Short"), name
    page = "<article><section class='related-work'>Work</section><p class='search-method'>Method</p><div class='ad-slot-2'>Buy</div><p class=advert_box>Buy</p></article>"
    assert html_extract.main_text(page) == "Work\nMethod"
    assert html_extract.main_text(f"<main><p>{'body ' * 9}</p><section id=comments><article>A reader</article></section></main>") == ("body " * 9).strip()
    assert html_extract.main_text("<main><div class=sidebar-left><p>Only</p></div></main>") == "Only"


def test_regions():
    assert html_extract.regions([0, 0, 0, 5, 0, 7, 0, 0, 0, 2], 3) == [(3, 6), (9, 10)]
    assert html_extract.regions([], 3) == [] and html_extract.regions([1], 3) == [(0, 1)]


def test_table(spark):
    pages = table(spark, SMALL, "pages")
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        text = out[r.page_id].text
        assert text == html_extract.main_text(r.html) and out[r.page_id].n_chars == len(text)
        assert "track(" not in text and "©" not in text
    odd = spark.createDataFrame([(1, None, None, "own"), (1, "u", "<p>x</p>", "own"), (None, "u", "", "own")], "page_id bigint, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract(odd).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert html_extract.extract(odd.limit(0)).count() == 0
