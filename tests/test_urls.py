import itertools
import os
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from pageloom.functions import urls

A, B = F.col("a"), F.col("b")

BASES = (
    "http://a.com", "http://a.com/", "http://a.com/docs", "http://a.com/docs/", "https://a.com/docs/intro?x=1#f",
    "HTTPS://a.com:80/b//c/d", "http://a.com/b/../c/d",
)
HREFS = (
    "x", "/x", "../x", "../../x", "./x", ".", "..", "//h.com/y?z#q", "?q=1", "http://b.com", "https:foo", "http:foo",
    "/a/../b", "/a/./b/..", "ftp://x", "a/b/../c", "a//b", "/a//b", "x?y#z", "HTTP://Q.com/P", "#f", "a:b", "x/../",
    " padded\n", "http://[bad", "...", "/..", "a/..b", "x?",
)


def joined(base, href):
    try:
        whole = urljoin(base, href.strip())
        if urlsplit(whole).scheme not in ("http", "https"):
            return None
        return urlsplit(whole)._replace(fragment="").geturl()
    except ValueError:
        return None


def test_links_are_joined_like_the_standard_library_does(column):
    pairs = list(itertools.product(BASES, HREFS))
    got = column(urls.resolve_link(A, B), *pairs)
    wrong = [(p, joined(*p), g) for p, g in zip(pairs, got) if joined(*p) != g]
    assert wrong == []


def test_base_path(column):
    cases = {
        "https://a.com/docs/intro": "https://a.com/docs/", "https://a.com/docs": "https://a.com/",
        "https://a.com": "https://a.com/", "https://a.com/x/y/?q=/z/#/w/": "https://a.com/x/y/",
    }
    assert column(urls.base_path(A), *cases) == list(cases.values())


def test_parts(column):
    got = column(urls.url_parts(A), "HTTP://u@h.com:8/p/q;r?s=t#f", "/only/path", "mailto:x@y")
    assert [tuple(g) for g in got] == [
        ("http", "u@h.com:8", "/p/q;r", "s=t"), ("", "", "/only/path", ""), ("mailto", "", "x@y", "")
    ]


def test_valid_url(column):
    assert column(urls.valid_url(A), "http://a", "https://a/b", "ftp://a", "http://", "a.com", None) == [
        True, True, False, False, False, False
    ]


def test_queue_decision_first_rule_wins(column):
    def decide(depth, seen=False):
        return urls.queue_decision(A, F.lit(depth), F.lit("http://a.com/docs/"), 1, F.lit(seen))

    inside = ("http://a.com/docs/x", "http://a.com/other", "http://a.com/docs/x.PDF?y", "http://a.com/docs/x.pdf/z")
    assert column(decide(1), *inside) == [None, "outside_base", "excluded_type", None]
    assert column(decide(2), *inside) == ["too_deep"] * 4
    assert column(decide(2, True), *inside) == ["visited"] * 4
    ftp = urls.queue_decision(A, F.lit(0), F.lit("ftp://a/"), 1)
    assert column(ftp, "ftp://a/x") == ["not_http"]


def test_repo_url(column):
    cases = {
        "https://github.com/o/r": (True, "o", "r"), "https://GitHub.com/o/r/": (True, "o", "r"),
        "https://github.com/o/r/tree/main/d": (True, "o", "r"), "https://github.com/o//r/blob/x": (True, "o", "r"),
        "https://github.com/o/r/issues": (False, None, None), "https://github.com/topics/x": (False, None, None),
        "https://github.com/orgs/x": (True, "orgs", "x"), "https://github.com/o": (False, None, None),
        "https://www.github.com/o/r": (False, None, None),
    }
    assert [tuple(g) for g in column(urls.repo_url(A), *cases)] == list(cases.values())


def test_path_extension(column):
    paths = ("a/b.MD", "a.b/c", ".md", "a/.md", "x.tar.gz", "x.", "a/..md", "a.b/.c.d", "")
    assert column(urls.path_extension(A), *paths) == [os.path.splitext(p)[1].lower() for p in paths]


def test_safe_names(column):
    assert column(urls.safe_file_part(A), 'http://x/y*?z  a__b"', "__", "p" * 200) == ["x_y_z_a_b", "", "p" * 180]
    assert column(urls.safe_topic_part(A), "Using A/B Streams", "", "Q" * 120) == [
        "using_a_b_streams", "untitled", "q" * 100
    ]
    assert column(urls.document_file_name(A, B), ("Intro: API", "docs.x.io:80"), ("*", "?")) == [
        "intro_api_docs.x.io_80.txt", column(urls.document_file_name(A, B), ("*", "?"))[0]
    ]
    assert column(urls.document_file_name(A, B), ("*", "?"))[0].startswith("output_")


def test_raw_names_keep_hash_and_extension(column):
    long = "https://a.com/" + "x" * 400
    names = column(urls.raw_file_name(A), "https://a.com:8/d/e?q=1", "https://a.com/", long + "1", long + "2")
    assert names[0].startswith("raw_a_com_8_d_e_q=1_") and names[0].endswith(".html")
    assert names[1].startswith("raw_a_com_index_")
    assert names[2] != names[3] and all(len(n) <= 180 and n.endswith(".html") for n in names)
    assert column(urls.raw_file_name(A, B), ("https://g/x", "docs/a b.MDX"), ("https://g/x", "README"))[0].endswith(".MDX")
    assert column(urls.raw_file_name(A, B), ("https://g/x", "README"))[0].endswith(".md")
