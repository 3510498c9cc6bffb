import pyarrow as pa
from pyspark.sql import functions as F

from pageloom.operators import html
from pageloom.operators.clean import clean_pages, clean_summary
from pageloom.operators.html import parse_blocks

A = F.col("a")


def blocks(page, nested="all"):
    return [(b["tag"], b["text"]) for b in parse_blocks(page, nested)["blocks"]]


def test_dropped_elements_leave_no_text():
    page = (
        "<body><nav><p>n</p></nav><p>a<script>var x='<p>';</script>b</p><p role=search>c</p>"
        "<div aria-hidden=true><p>d</p></div><article2><p>e<!-- <p>f</p> -->g</p></article2>"
        "<form><p>h</p></form><p aria-hidden=false role=note>i</p></body>"
    )
    assert blocks(page) == [("p", "ab"), ("p", "eg"), ("p", "i")]


def test_main_region_rules_in_order():
    parts = ["<div class='x main-content'><p>6</p></div>", "<div class='a content'><p>5</p></div>",
             "<div id=content><p>4</p></div>", "<div role=main><p>3</p></div>",
             "<article><p>2</p></article>", "<main><p>1</p></main>"]
    for n in range(1, len(parts) + 1):
        assert blocks("<body>" + "".join(parts[:n]) + "</body>") == [("p", str(7 - n))]
    assert blocks("<p>out</p><body><p>in</p></body><p>after</p>") == [("p", "in")]
    assert blocks("<p>whole</p>") == [("p", "whole")]
    assert blocks("<article><p>a</p></article><article><p>b</p></article>") == [("p", "a")]


def test_nested_blocks_repeat_or_not():
    page = "<ul><li>x<p>y</p></li></ul><p>a<p>b"
    assert blocks(page) == [("li", "xy"), ("p", "y"), ("p", "ab"), ("p", "b")]
    assert blocks(page, "outermost") == [("li", "xy"), ("p", "ab")]


def test_blocks_end_where_the_standard_ends_them():
    pages = {
        "<p>a<p>b<div>c</div><p>d</p>": ["a", "b", "d"],
        "<p>a<b>b<p>c</b>d": ["ab", "cd"],
        "<ul><li>a<li>b<ul><li>c<li>d</ul>e<li>f</ul>": ["a", "bcde", "f"],
        "<table><tr><td>a<td>b<tr><th>c<p>d<p>e</table><p>f": ["a", "b", "c\td\te", "f"],
        "<p>a<button><p>b</button>c<p>d": ["ac", "d"],
        "<p>a<table><tr><td>b</table>c<p>d": ["a", "b", "d"],
        "<li>x<p>y<dl><dt>t<dd>u</dl></li><pre> p </pre>": ["xytu", "p"],
        "<p>a<span><p>b</span>c</p>d": ["a", "bc"],
    }
    assert {p: [t for _, t in blocks(p, "once")] for p in pages} == pages


def test_unclosed_blocks_give_no_more_text_than_the_page(spark):
    """Of 1 MB of paragraphs, items, cells or emphases that nothing closes, each character comes once, and in linear time."""
    for unit in ("<p>some text", "<p><b>text", "<ul><li>item", "<li>item", "<table><tr><td>cell", "<div><p>in", "<p><table><td>x", "<button><p>y", "<b><div>z"):
        n = (1 << 20) // len(unit)
        text = "".join(t for _, t in blocks(unit * n, "once"))
        assert len(text) <= 2 * n * len(unit), unit
    clean = clean_pages(spark.createDataFrame([("<p>some text" * 50_000, "html")], "content string, type string"))
    assert clean.select(F.length("text")).first()[0] == 50_000 * 10 - 1


def test_close_tags_fit_or_are_ignored():
    assert blocks("<p><b>a<i>b</p>c</i><p>d</span></p>") == [("p", "ab"), ("p", "d")]
    assert blocks("<p>a<br>b<img src=x>c</p>") == [("p", "abc")]
    assert blocks("<div><p>a</div><p>b</p>") == [("p", "a"), ("p", "b")]


def test_cells_know_the_last_of_their_row():
    page = "<table><tr><td>1<td>1</td></tr><tr><th>h</th><td><i>x</i> <b>y</b></td></tr></table><td>loose</td>"
    got = parse_blocks(page)["blocks"]
    assert [(b["text"], b["last_cell"]) for b in got] == [
        ("1\t1", False), ("1", True), ("h", False), ("x\ty", True), ("loose", False)
    ]


def test_many_unclosed_rows_stay_linear():
    page = "<table>" + "<tr><td>x" * 3000
    assert len(parse_blocks(page)["blocks"]) == 3000


def test_entities_and_muted_text():
    assert blocks("<p>&lt;a&gt; &amp; &#233;&nbsp;</p>") == [("p", "<a> & é")]
    assert blocks("<p>a<ruby>b<rt>c</rt></ruby><template>d</template></p>") == [("p", "ab")]
    assert blocks("<p>x<![CDATA[y]]>z</p>")[0][0] == "p"


def test_rendering(spark):
    page = (
        "<h1>T</h1><h3> S <b>s</b></h3><p> a </p><p> </p><ul><li>b</li></ul><pre>  c\n\n\n\n   d  </pre>"
        "<table><tr><td>e</td><td>f</td></tr></table>"
    )
    df = spark.createDataFrame([(page,)], "a string")
    text = df.select(html.clean_html(html.page_blocks(A))).first()[0]
    assert text == "# T\n\n### Ss\n\na\n* b\n\n---\nCODE BLOCK:\nc\n\n d\n---\n\ne\nf"


def test_clean_statuses(spark):
    rows = [
        (1, "<p>x</p>", "html"), (2, None, "html"), (3, "", "markdown"), (4, " ", "markdown"), (5, "a", "pdf"),
        (6, "<nav>a</nav>", None), (7, "# raw <p>", "markdown"), (8, "<p>y</p>", None),
    ]
    clean = clean_pages(spark.createDataFrame(rows, "id int, content string, type string"))
    got = {r.id: (r.status, r.text, r.n_tokens) for r in clean.collect()}
    assert got == {
        1: ("ok", "x", 0), 2: ("no_content", None, 0), 3: ("no_content", None, 0), 4: ("ok", " ", 0),
        5: ("unknown_type", None, 0), 6: ("empty_after_clean", None, 0), 7: ("ok", "# raw <p>", 2), 8: ("ok", "y", 0),
    }
    assert clean_summary(clean).first().asDict() == {"n_input": 8, "n_processed": 4, "n_no_content": 2, "n_empty": 2}


def test_plain_text_fallback():
    assert html.plain_text("<p> a </p><script>b</script><i>c</i>") == "a\nc"


def test_titles(column):
    titles = {
        "Intro Guide | Site Name": ("Intro Guide", "Intro Guide"), "Streams - The Docs": ("Streams", "Streams"),
        "Catalog": ("Catalog", None), "Data Format Guide": ("Data Format Guide", None),
        "Cooking by Ann": ("Cooking", "Cooking"), "abc": (None, None), "| Site": (None, None),
    }
    pages = [f"<head><title> {t} </title></head>" for t in titles]
    assert column(html.page_title(A), *pages) == [v[0] for v in titles.values()]
    assert column(html.page_title(A, strict=True), *pages) == [v[1] for v in titles.values()]
    assert column(html.page_title(A), "<title>Caf&eacute; &#8217;s &amp; more</title>") == ["Café ’s & more"]


def test_headings(column):
    pages = ["<h1 class=x>A <b>bold</b>\n one</h1><h1>no</h1>", "<h1>abc</h1>", "<p>none</p>", "<H1>x<!-- y -->z&amp;w</H1>"]
    assert column(html.page_heading(A), *pages) == ["A bold one", None, None, "xz&w"]


def test_links(spark):
    page = (
        "<a href='/a'>1</a><A class=x HREF=\"b?x=1&amp;y=2#f\">2</A><a href=/c>3</a><a href='#top'>4</a>"
        "<a href='MAILTO:x@y'>5</a><a href=' javascript:void(0)'>6</a><a href=''>7</a><a name=q>8</a>"
        "<!-- <a href='/no'> --><script>'<a href=\"/no\">'</script><a data-href='/no' href='/a'>9</a>"
        "<nav><a href='../up'>10</a></nav><abbr href='/no'>11</abbr><a\nhref = 'https://z.org/'>12</a>"
    )
    pages = spark.createDataFrame([("http://h.com/d/e", page), ("http://h.com/none", None)], "url string, html string")
    assert sorted(r.dst_url for r in html.extract_links(pages).collect()) == [
        "http://h.com/a", "http://h.com/c", "http://h.com/d/b?x=1&y=2", "http://h.com/up", "https://z.org/"
    ]
    near = html.with_links(pages, same_site=True).filter("html is not null").first().links
    assert "https://z.org/" not in near and len(near) == 4


def test_unusual_anchors(column):
    from pageloom.operators.html import page_hrefs

    page = (
        '<a title="a>b" href="/one">1</a><a class="c"href="/three">3</a><a href="/t&#119;o">2</a><a href="/k&ouml;ln">k</a>'
        '<a title="see href=/bad" href="/four">4</a><A\nHREF = /five>5</a><abbr href="/no">x</abbr><a data-href="/no" href=\'/six?a=1&amp;b=2\'>6</a>'
        '<a name="x">7</a><a disabled href="/&#xe9;/&#128512;">8</a><a href="&#99999999;/nine">9</a><a href="#top">t</a>'
    )
    assert column(page_hrefs(F.col("a")), page) == [[
        "/one", "/three", "/two", "/köln", "/four", "/five", "/six?a=1&b=2", "/é/😀", "&#99999999;/nine",
    ]]


LONG = 1 << 20


def test_long_and_unclosed_markup_is_read_once(column):
    """Tags of a megabyte, very many attributes, and whatever is left open: in linear time, without a deep stack."""
    pages = {
        f"<a data-x={'x' * LONG} href='/one'>1</a>": ["/one"],
        f"<a data-x=\"{'>' * LONG}\" href='/two'>2</a><a href=/three>": ["/two", "/three"],
        f"<a {'d' * 200}=\"z\">no href</a><a href='/four'>4</a>": ["/four"],
        "<a " + " ".join(f"name{i}='v{i}'" for i in range(200)) + ">none</a>": [],
        "<a " + "n " * (LONG // 4) + ">none</a><a href='/five'>": ["/five"],
        "<a " + "q='\"' " * (LONG // 8) + "href='/six'>": ["/six"],
        "<a href='/seven'>7</a>" + "<a " * (LONG // 4): ["/seven"],
        "<a href='/eight'>8</a>" + "<script>" * (LONG // 8): ["/eight"],
        "<a href='/nine'>9</a>" + "<!-- " * (LONG // 8) + "<a href='/no'>": ["/nine"],
        "<" * LONG + "a href='/ten'>": ["/ten"],
        "<a href='/eleven'>" + "<p title='" * (LONG // 16): ["/eleven"],
    }
    assert column(html.page_hrefs(F.col("a")), *pages) == list(pages.values())


def test_all_named_references(column):
    from html import unescape
    from html.entities import html5

    names = sorted(n for n in html5 if n.endswith(";"))
    page = "".join(f'<a href="/x&{n}y">' for n in names)
    assert column(html.page_hrefs(F.col("a")), page) == [[f"/x{html5[n]}y" for n in names]]
    texts = ["a &amp;lt; b", "&unknown; &copy=1 &", "&#65;&#x42;&#0;&#xD800;&#1114112;", "no reference", "&&amp;;", "x" * 1000 + "&eacute;"]
    expected = ["a &lt; b", "&unknown; &copy=1 &", "AB&#0;&#xD800;&#1114112;", "no reference", "&&;", "x" * 1000 + "é"]
    assert column(html.decode_references(A), *texts) == expected
    assert unescape(texts[0]) == expected[0]


def test_links_as_a_parser_finds_them(column):
    """Random markup of attributes, comments and scripts against the standard parser."""
    import random
    from html.parser import HTMLParser

    class Hrefs(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                found.extend([v for k, v in attrs if k == "href" and v and v.strip()][:1])

    rng = random.Random(2)
    values = ["/a", "'/b c'", '"/d>e"', '"/f\'g"', "/h?i=1&amp;j=2", "' /k '", '""', "&quot;l", '"<a href=/m>"']
    pieces = ["<!-- <a href=/n> -->", "<script>'<a href=/o>'</script>", "text < b > c", "<style>a{}</style>", "<br/>", "</a>", "<!DOCTYPE html>", "\n"]
    pages, expected = [], []
    for _ in range(60):
        page = ""
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.3:
                page += rng.choice(pieces)
            else:
                names = [rng.choice(["href", "HREF", "title", "data-href", "x"]) + rng.choice(["=", " = ", "=\n"]) + rng.choice(values) for _ in range(rng.randint(0, 3))]
                page += "<" + rng.choice(["a", "A", "p", "abbr"]) + "".join(rng.choice([" ", "\n", " disabled "]) + n for n in names) + rng.choice([">", " >"])
        found = []
        Hrefs().feed(page)
        pages.append(page)
        expected.append([v.strip() for v in found])
    assert column(html.page_hrefs(F.col("a")), *pages) == expected


def test_a_batch_of_pages_is_not_held_parsed():
    page = "".join(f"<p>{i}</p>" for i in range(500))
    long = "<p>" + "x" * (2 * html.PARSED_BYTES) + "</p>"
    pages = [None, "", *[page] * 1000, long, None, page]
    parts = list(html.parsed_batches(iter([pa.array(pages), pa.array([], pa.string()), pa.array(pages[:3])]), "once"))
    assert max(len(p) for p in parts) <= html.PARSED_BYTES // len(page) + 3
    got = [b for p in parts for b in p.to_pylist()]
    expected = [parse_blocks(p, "once") or {"blocks": None, "fallback": None} for p in pages + pages[:3]]
    assert got == expected


def test_a_column_of_many_batches_keeps_its_rows(spark):
    n = 2500
    df = spark.range(n).repartition(1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("<p>"), F.repeat(F.col("id").cast("string"), 400), F.lit("</p>"))).alias("a"))
    rows = df.select("id", html.page_blocks(F.col("a")).alias("b")).select("id", F.col("b.blocks")[0]["text"].alias("t")).collect()
    assert len(rows) == n
    assert all(r["t"] == (None if r["id"] % 7 == 0 else str(r["id"]) * 400) for r in rows)
