import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bookloom.llm.html_extract import Page, extract, host_of, host_templates, main_text, tokens

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{{margin:0}}</style>
<script>var t="</p><article>no</article>";</script></head><body class="comment-page"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div>{body}<aside>Side</aside><form><p>Mail</p><input value="x>y"></form>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; x &middot; y</footer></body></html>"""


def page(inner):
    return PAGE.format(body=f"<article><header><h1>Head</h1></header>{inner}</article>")


def test_blocks_references_and_blanks():
    body = '<p><b>One &amp;amp; two<br>three\n &#233;&nbsp;x<p title="a>b">Next <i>in</i>line</p>tail &amp<ul><li>a<li>b</ul><div class="social-share">Share</div>'
    assert main_text(Page(page(body)), set()) == "Head\nOne &amp; two three é x\nNext inline\ntail &\na\nb"
    assert main_text(Page(""), set()) == ""
    assert main_text(Page("plain < text"), set()) == "plain < text"
    assert main_text(Page("<p>cut off <b"), set()).startswith("cut off")


def test_pages_without_article_use_the_richest_element():
    body = "<div id='wrap'><div class='x'>Tiny</div><div class='story'><p>" + "long words " * 30 + "</p><p>and more text here</p></div></div>"
    text = main_text(Page(PAGE.format(body=body)), set())
    assert text.endswith("and more text here") and "Tiny" not in text and "Side" not in text and "cookies" not in text


def test_templates_and_extraction(spark):
    rows = [(i, f"http://Site.example.org:80/{i}", page(f"<p>Story {i} {'word ' * 40}</p><p>Subscribe now</p>")) for i in range(6)]
    rows += [(10 + i, "https://copy.example.org/a", page(f"<p>{'same text ' * 30}</p>")) for i in range(3)]
    rows += [(20, None, None), (21, "", "<article>lone</article>"), (None, "http://solo/x", page("<p>x</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    out = {r.page_id: r for r in extract(df).collect()}
    assert len(out) == len(rows)
    for i in range(6):
        assert out[i].text == "\n".join([f"Story {i} {'word ' * 40}".strip()]), out[i].text
    for i in range(3):
        assert out[10 + i].text == "Head\n" + ("same text " * 30).strip()
    assert out[20].text == "" and out[21].text == "lone" and out[None].text == "Head\nx"
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert extract(df.limit(0)).collect() == []
    classes = host_templates(df).filter("host = 'site.example.org'").collect()
    assert {(r.class_pages, r.pages) for r in classes} == {(6, 6)}
    hosts = df.select(host_of(F.col("url")).alias("h")).distinct().collect()
    assert {r.h for r in hosts} == {"site.example.org", "copy.example.org", "", "solo"}


def test_many_open_brackets_end_quickly():
    assert Page("<" * 20_000 + "<p>x").blocks
    Page("<p " * 3000)


def rich(i, k):
    """A page without article: heading, list, quote, table and two sibling sections, of which one holds most text."""
    parts = [f"Title {i}", f"Intro {i}", f"Item a {i}", f"Item b {i}", f"Long {i} " + "word " * k, f"Second {i}", f"Cell {i}", f"Quote {i}"]
    parts = [p.strip() for p in parts]
    h, intro, a, b, long, second, cell, quote = parts
    body = (
        f"<div class='top'><ul><li>Start page</li><li>All stories</li></ul></div><div class='content'><h1>{h}</h1><div class='one'><p>{intro}</p>"
        f"<ul><li>{a}<li>{b}</ul></div><div class='two'><p>{long}</p><p>{second}</p><table><tr><td>{cell}</table><blockquote>{quote}</blockquote></div></div>"
    )
    return f"<html><body>{body}</body></html>", "\n".join(parts)


def test_pages_without_article_keep_headings_lists_and_sections(spark):
    lone, want = rich(0, 60)
    assert main_text(Page(lone.replace("<div class='top'><ul><li>Start page</li><li>All stories</li></ul></div>", "")), set()) == want
    pages = {i: rich(i, 30 + i) for i in range(1, 5)}
    rows = [(i, f"http://many/{i}", html) for i, (html, _) in pages.items()] + [(9, "http://lone/", lone)]
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: out[i] for i in pages} == {i: text for i, (_, text) in pages.items()}
    assert out[9] == "Start page\nAll stories\n" + want


def test_a_leaf_is_no_container():
    assert main_text(Page("<body><div><div>Some longer bare text</div><div>Tail</div></div></body>"), set()) == "Some longer bare text\nTail"
    assert main_text(Page("<body><h2>Head</h2><ul><li>" + "long " * 50 + "<li>b</ul></body>"), set()).startswith("Head\nlong")


def test_template_survives_an_empty_and_an_odd_page(spark):
    box = "<div class='x7'><p>Read on in our shop</p></div>"
    inner = {i: f"<p>Story {i} {'word ' * 40}</p>".replace(" </p>", "</p>") for i in range(5)}
    bare = {i: f"<html><body><div class='a'><ul><li>Start page</li></ul></div><div class='b'><h1>Own {i}</h1><p>{'text ' * 20}{i}</p></div></body></html>" for i in range(5)}
    rows = [(i, f"http://art/{i}", f"<html><body><article>{p}{box}</article></body></html>") for i, p in inner.items()]
    rows += [(10 + i, f"http://bare/{i}", p) for i, p in bare.items()]
    for k, host in ((20, "art"), (30, "bare")):
        rows += [(k, f"http://{host}/empty", None), (k + 1, f"http://{host}/blank", "  "), (k + 2, f"http://{host}/odd", "<p>Odd page with other text")]
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert out[i] == f"Story {i} {'word ' * 40}".strip()
        assert out[10 + i] == f"Own {i}\n{'text ' * 20}{i}"
    assert out[20] == out[21] == "" and out[22] == out[32] == "Odd page with other text"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.pages for r in host_templates(df).collect()} == {6}


def test_names_inside_an_article_hide_only_what_they_name():
    body = """<article><p>Intro</p><div class="search results-table"><p>Body about search</p></div><p class="alert-level">River alert level
    rose</p><div class="ad">Buy</div><div class="reader-comments"><p>First!</p></div><p class="notice">Closed</p></article>"""
    assert main_text(Page(body), set()) == "Intro\nBody about search\nRiver alert level rose"


def test_boxes_of_an_article_that_are_no_text():
    boxes = {
        "class='comment-list'": 0, "id=comments-section": 0, "class='ad-slot wide'": 0, "class='share-buttons'": 0, "class='related-posts'": 0, "role=search": 0,
        "class='newsletter-signup-form'": 0, "class='cookie-notice'": 0, "class='article-body'": 1, "class='header-image'": 1, "class='share-price'": 1,
        "class='notice-period'": 1, "class='content-list'": 1, "class=search-results": 1, "class='no-comments'": 1, "role=note": 1, "id='ad-hoc-tests'": 1,
    }
    for box, stays in boxes.items():
        html = f"<article><p>Intro</p><div {box}><p>Inside</p></div></article>"
        assert main_text(Page(html), set()) == ("Intro\nInside" if stays else "Intro"), box


def test_boxes_around_an_article_hide_nothing():
    for name in ("has-sidebar", "menu-open", "page-with-comments wrap", "no-footer"):
        html = f"<body><div class='{name}'><div class='sidebar'>Side</div><article><p>Story</p></article></div></body>"
        assert main_text(Page(html), set()) == "Story", name
    assert main_text(Page("<body><section class='comments'><article><p>First!</p></article></section></body>"), set()) == ""


def test_blocks_that_recur_beside_data_are_data(spark):
    """Half of a host's pages share two of many paragraphs; all of them share a box, half of them another one."""
    box, half = "<div class='q1'><p>Read on in our shop</p><p>Open daily</p></div>", "<div class='q2'><p>Only some have this</p></div>"
    rows, want = [], {}
    for i in range(8):
        shared = ["Shared paragraph one", "Shared paragraph two " + "long " * 90] if i < 5 else []
        own = [x.strip() for x in [f"Own {i}", *shared, f"Last of {i}"]]
        inner = "".join(f"<p>{x}</p>" for x in own)
        rows.append((i, "http://h/", f"<body><article>{inner}{half if i < 4 else ''}{box}</article></body>"))
        rows.append((100 + i, "http://k/", f"<body><div class='a'>{inner}</div>{half if i < 4 else ''}{box}</body>"))
        want[i] = want[100 + i] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == want
    off = main_text(Page(rows[0][2]), set())
    assert off == want[0] + "\nOnly some have this\nRead on in our shop\nOpen daily"


def test_copies_of_a_page_are_no_template(spark):
    story = "".join(f"<p>Paragraph {k} of the story</p>" for k in range(5))
    rows = [(i, "http://c/", f"<nav>{i}</nav><article><h1>Title</h1>{story}</article>") for i in range(9)]
    rows += [(20 + i, "http://c/", f"<article><h1>Other {i}</h1><p>Text {i}</p></article>") for i in range(2)]
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(9)} == {"\n".join(["Title", *(f"Paragraph {k} of the story" for k in range(5))])}
    assert out[20] == "Other 0\nText 0"


def test_classes_equal_whole_occurrence_vectors(spark):
    rng = random.Random(12)
    part = lambda: rng.choice(["<p>a</p>", "<p>b</p>", "<div class='x'><p>c</p></div>", "<ul><li>d<li>e</ul>", f"<p>{rng.random()}</p>"])
    rows = [(i, f"http://h{i % 3}/", "".join(part() for _ in range(rng.randint(0, 7)))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = defaultdict(set)
    for r in host_templates(df, least_pages=2).collect():
        got[r.host].add((r.class_pages, r.uses, frozenset(r.tokens)))
    want = defaultdict(set)
    for host in ("h0", "h1", "h2"):
        vectors, pages = defaultdict(dict), set()
        for _, url, html in rows:
            if url == f"http://{host}/":
                page = Page(html)
                own = frozenset(Counter(t for _, t in page.slots()).items())
                counts = tokens(page)
                pages |= {own} if counts else set()
                for token, n in counts.items():
                    vectors[token][own] = n
        classes = defaultdict(set)
        for token, vector in vectors.items():
            if len(vector) >= 2 and 2 * len(vector) >= len(pages):
                classes[frozenset(vector.items())].add(token)
        want[host] = {(len(v), sum(n for _, n in v), frozenset(c)) for v, c in classes.items()}
    assert got == want and any(len(c) > 1 for v in want.values() for _, _, c in v)


def test_tokens_out_of_order_or_of_their_gap_are_no_template(spark):
    """Two texts that change places in every page; one text before and behind a fixed one."""
    rows = []
    for i in range(6):
        a, b = ("<p>Lines of one</p>", "<p>Lines of two</p>")[:: 1 if i % 2 else -1]
        rows.append((i, "http://o/", f"<article><p>Own {i}</p>{a}{b}</article>"))
        c, d = ("<h3>Fixed words</h3>", "<h4>Some words</h4>")[:: 1 if i % 2 else -1]
        rows.append((10 + i, "http://n/", f"<article><h2>Top</h2><p>Own {i}</p>{c if i < 4 else '<h3>Fixed words</h3>'}{d if i < 4 else ''}<h5>End</h5></article>"))
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert out[i].split("\n") == [f"Own {i}", *("Lines of one", "Lines of two")[:: 1 if i % 2 else -1]]
        assert out[10 + i] == f"Own {i}" + ("\nSome words" if i < 4 else "")
