"""Main text of pages, and licence scans against direct forms."""

import html as entities
import re

import pytest

from drainrules.llm import html, licenses, queries

SF001 = "/root/testdata/sf0.001"


def test_query_gives_the_article_of_each_page(spark):
    rows = {r["page_id"]: r for r in queries.op1_html_extraction(spark, SF001).collect()}
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        text = entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\n", article).replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)
        r = rows[p["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], want, len(want))


BODY = "".join(f"<p>Paragraph {i}, with some words, and a comma or two, that make it long enough to count.</p>" for i in range(6))
WANT = "\n".join(f"Paragraph {i}, with some words, and a comma or two, that make it long enough to count." for i in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='menu'><a href=a>Home, sweet, home</a></div><div id=content>{BODY}</div><div class='comments'>{BODY}</div></body>",
        f"<header><p>Site, name</p></header><main>{BODY}</main><aside><p>An aside, with, commas.</p></aside><footer>f</footer>",
        f"<div><div class=post>{BODY}<div class='advert'>Buy, buy, buy!</div><form>Name: <input></form></div><div class=sidebar>{BODY}</div></div>",
        f"<article>{BODY}<section id='comments'><p>First, reader, comment.</p></section></article>",
        f"<article>{BODY.replace('</p>', '')}</article><div class='cookie-notice'><p>We use cookies, many, many.</p></div>",
        f"<table><tr><td class=nav><a href=x>One</a><td>{BODY}</table>",
        f"<script>if (a < b) document.write('<p>no, no</p>')</script><style>p {{}}</style><!-- <p>no, no, no</p> -->{BODY}<noscript>{BODY}</noscript>",
        f"<div>{BODY}</div><ul class=related><li><a href=1>Other, article</a></li></ul><div hidden>{BODY}</div><div style='display: none'>x, y</div>",
    ],
)
def test_boilerplate_goes(page):
    assert html.main_text(page) == WANT


END = "<h2>End</h2><p>Short, final conclusion.</p>"
LINKS = "<ul><li><a href=1>Other one</a></li><li><a href=2>Other two</a></li></ul>"


@pytest.mark.parametrize(
    "page, more",
    [
        (f"<article><h1>T</h1><section>{BODY * 9}</section><section>{END}</section></article>", "End\nShort, final conclusion."),
        (f"<article><h1>T</h1><div><section>{BODY * 9}</section></div><div><section>{END}</section></div>{LINKS}</article>", "End\nShort, final conclusion."),
        (f"<main><h1>T</h1><div>{BODY * 9}</div>bare <a href=x>text</a> after it<ul><li>one<li>two</ul></main>", "bare text after it\none\ntwo"),
        (f"<article><h1>T</h1><section>{BODY * 9}</section><table><tr><td>a<td>1</table><pre>x = 1</pre><blockquote>So said.</blockquote></article>", "a\n1\nx = 1\nSo said."),
        (f"<body><div id=a><h1>T</h1><section>{BODY * 9}</section><ol><li>one</ol><section>{END}</section>{LINKS}</div></body>", "one\nEnd\nShort, final conclusion."),
        (f"<body><h1>T</h1><div class=r id=r1><div>{BODY * 9}</div></div><div class=r id=r2><div>{END}</div></div>{LINKS}<div class=menu>{BODY}</div></body>", "End\nShort, final conclusion."),
    ],
)
def test_short_parts_beside_a_long_one_stay(page, more):
    text = html.main_text(page)
    assert text.removeprefix("T\n") == "\n".join([WANT] * 9) + "\n" + more
    assert text.startswith("T\n") or "id=r1" in page


def test_references_white_space_and_breaks():
    page = "<article><h1>T &amp; t</h1><p>a&nbsp;&lt;b&gt;\n\t c<br>d <b>e</b>f &eacute;&#233;&#x1F600; &amp;amp;</p><ul><li>one, two, three<li>four</ul></article>"
    assert html.main_text(page) == "T & t\na <b> c d ef éé😀 &amp;\none, two, three\nfour"


@pytest.mark.parametrize("page", ["", "plain words, no markup", "<p>unclosed <b>bold <i>text", "</div></p>stray", "<", "<!--", "<a", "&#xFFFFFFFF;", "<div " * 50, "\x00<p>x"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html.main_text(page), str)


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 20000 + "deep, text" + "</div>" * 100) == "deep, text"
    assert html.main_text("<article>" + "<p>word, word word.</p>" * 20000 + "</article>").count("\n") == 19999


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<article><p>A, b.</p></article>", None)], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()) == [(0, "A, b.", 5), (1, "", 0), (1, "", 0)]
    assert html.extract_pages(df.limit(0)).count() == 0


def slow_scan(text, templates, threshold):
    """Dice of every unit with every template: no bounds, no anchors."""
    norm = re.sub(r"[.!?]+([ \n])", "\x1e\\1", (text or "").lower())
    norm = "".join(c if c.isalnum() or c in "\n\x1e" else " " for c in norm)
    units = {*re.split("[\n\x1e]", norm), *norm.split("\n"), *re.split("\n[ \n]*\n", norm), norm}

    def grams(words):
        return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}

    best = {}
    for unit in units:
        words = re.split("[ \n\x1e]+", unit.strip(" \n\x1e"))
        for license_id, body in templates:
            a, b = grams(words), grams("".join(c if c.isalnum() else " " for c in body.lower()).split())
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                found = (2 * len(a & b) / (len(a) + len(b)), " ".join(words))
                best[license_id] = max(best.get(license_id, found), found)
    return {k: (round(d, 6), u) for k, (d, u) in best.items()}


ALL = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts]


def variants():
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][1]
    words = mit.split()
    return [
        (1, f"Some text.\n{mit}\nMore text here."), (2, mit.upper().replace(" ", "  \n")), (3, " ".join(words[: len(words) * 3 // 4])), (4, " ".join(words[::2])),
        (5, "Intro, words. Released under the MIT License. Outro"), (6, "released under the mit-license!"), (7, "\n\n" + apache.replace(". ", ".\n") + "\n\nrest of it"),
        (8, ""), (9, None), (10, "under the license"), (11, " ".join([mit] * 3)), (None, "Licensed under CC BY-NC 4.0."), (12, "x " * 20000 + "\nReleased under the MIT License.\n" + "y " * 9),
        (13, "Released under the MIT License"), (13, "Released under the MIT License"), (14, "Licensed under CC BY 4.0\n\nLicensed under CC BY SA 4 0"),
    ]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_scan_equals_slow_form(spark, threshold):
    rows = variants()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, dice string")
    got = sorted(((r["doc_id"] or 0, r["license_id"], r["dice"], r["unit"]) for r in licenses.scan_licenses(df, threshold=threshold).collect()))
    want = sorted({(i or 0, k, d, u) for i, t in rows for k, (d, u) in slow_scan(t, ALL, threshold).items()})
    assert got == want


def test_notices_wrapped_or_embedded_in_prose(spark):
    prose = "this part of the book tells of rivers and of the people who lived beside them for many years"
    apache, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT"][1]
    texts = [
        (1, f"{prose}.\nLicensed under the Apache License,\nVersion 2.0.\nMore {prose}.", "Apache-2.0"),
        (2, f"{prose}\nLicensed under the Apache License,\nVersion 2.0, {prose}", "Apache-2.0"),
        (3, f"{prose}. {apache[1]} {prose}. {prose}. {prose}.", "Apache-2.0"),
        (4, f"{prose} {mit} {prose}, {prose}, {prose}", "MIT"),
        (5, f"{prose} {prose}. " * 3, None),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["dice"]) for r in licenses.scan_licenses(df, embedded=True).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, _, k in texts if k}
    assert all(got[i][1] == 1.0 for i in (1, 2, 3))
    assert {r["doc_id"] for r in licenses.scan_licenses(df).collect()} >= {1}  # a wrapped sentence is a unit


def test_bounds_lose_nothing():
    for n in range(1, 60):
        for t in (0.3, 0.5, 0.8, 1.0):
            lo, hi = licenses.size_bounds(n, t)
            for a in range(1, 500):
                assert (lo <= a <= hi) == (2 * min(a, n) / (a + n) >= t - 1e-9)


def test_license_odd_input(spark, odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0 and licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd_docs, [("x", "one")])


KEPT = ["The first paragraph of the article is long enough, with commas, to be found by its points.", "A second paragraph follows, and it goes on for a while, as they do.", "Short end."]
ARTICLE = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in KEPT)
NEVER_KEPT = (
    "id='header'", "class='copyright'", "class='comment-body'", "class='comments-content'", "class='sidebar-content'", "class='cookie-text'", "class='main-menu'",
    "class='blog-sidebar'", "class='page-footer'", "class='footer-content'", "class='main-nav'", "class='post-comments'", "class='content-ad'", "class='page-header'",
    "class='site-header'", "class='header'", "class='topbar'", "class='legal'", "class='login'", "class='search'", "class='outbrain'", "class='recommended'", "class='ad-text'",
)


@pytest.mark.parametrize("named", NEVER_KEPT)
@pytest.mark.parametrize("layout", ["<body>{part}<div class='content'>{article}</div>{part}</body>", "<body><div>{part}{article}</div>{part}</body>",
                                    "<body><div class='page has-sidebar'><section>{article}</section>{part}</div></body>"])
def test_named_boilerplate_goes_whatever_else_its_name_says(named, layout):
    part = f"<div {named}><p>Some words of the site, no article at all.</p></div>"
    text = html.main_text(layout.format(part=part, article=ARTICLE))
    assert text == "\n".join(["Title", *KEPT])


@pytest.mark.parametrize("opening", ["<div class='post-header'>", "<div class='entry-content no-comments'>", "<div class='main with-sidebar'>", "<div class='content-widget'>", "<div id=text>"])
def test_article_containers_stay(opening):
    page = f"<body><div class='nav'>Menu</div>{opening}{ARTICLE}</div></body>"
    assert html.main_text(page) == "\n".join(["Title", *KEPT])


def test_quotes_open_after_an_equals_sign_only():
    for odd in ("<p title=Tom's>", "<p title=Tom's class=\"x\">", "<p data-x='a>b' \">", "<a href=x'y>link</a><p>"):
        text = html.main_text(f"<body><article>{odd}Before it, all is well, and long enough.</p>{ARTICLE}</article></body>")
        assert "Before it, all is well, and long enough." in text and text.endswith("Short end.")


def test_raw_elements_do_not_close_themselves():
    page = f"<body><script src='a.js'/>var x=1;</script><article>{ARTICLE}</article><style/>p {{}}</style></body>"
    assert html.main_text(page) == "\n".join(["Title", *KEPT])
