"""URLs, pages and claims: equivalent forms, RFC 3986 examples, malformed input."""

import hashlib

import pytest
from pyspark.sql import functions as F

from placeloom.functions import payload, text, web
from placeloom.operators import curation


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("x"))).collect())]


def test_canonical_forms(spark):
    cases = {
        "HTTPS://WWW.Example.COM:443/a/b/?utm_source=x&b=2&a=1#part": "https://example.com/a/b?a=1&b=2",
        "http://m.www.example.com": "http://example.com",
        "example.com/p?_ga=1&fbclid=2&gclid=3&igshid=4&mc_cid=5&mc_eid=6&ref=7&source=8&dclid=9": "https://example.com/p?dclid=9",
        "//example.com:8080/x/": "https://example.com:8080/x",
        "https://example.com/?a-b=2&a=1&A=0&empty=&bare": "https://example.com?A=0&a=1&a-b=2&bare=&empty=",
        "https://example.com/q?x=%C3%A9+y%20z&w=%zz&v=a~b*c": "https://example.com/q?v=a~b%2Ac&w=%25zz&x=%C3%A9+y+z",
        "https://user:pw@example.com./x": "https://example.com/x",
        "https://[2001:DB8::1]:8443/x": "https://[2001:db8::1]:8443/x",
        "https://example.com:99999/": "",
        "https://exa mple.com/": "",
        "  https://example.com/a\n": "https://example.com/a",
        "": "",
        "   ": "",
        "https:///path": "",
    }
    got = one(spark, list(cases), web.canonical_url)
    assert dict(zip(cases, got)) == cases
    identity = one(spark, ["http://www.x.vn/a?b=1", "https://x.vn/a/?b=1"], web.canonical_identity)
    assert identity == ["x.vn/a?b=1"] * 2


def test_normal_form_private_and_spam(spark):
    urls = ["http://WWW.x.vn:80/a/?b=1&B=2&utm_x=1&si=3#Part-1", "https://x.vn:80", "https://content-mill.viral-news.link/", "http://x.vn/1/2/3/4/5/6/7/8?q=1", "ftp://x.vn/", "x.vn", None, "https://x.vn/a;v=1#not an anchor"]
    got = one(spark, urls, web.normal_url)
    assert [g and (g.canonical, round(g.spam_score, 6), g.is_spam) for g in got] == [("http://x.vn/a?B=2&b=1#Part-1", 0.0, False), ("https://x.vn:80/", 0.0, False), ("https://content-mill.viral-news.link/", 1.0, True), ("http://x.vn/1/2/3/4/5/6/7/8?q=1", 0.3, False), None, None, None, ("https://x.vn/a", 0.0, False)]
    assert got[0].content_hash == hashlib.sha256(got[0].canonical.encode()).hexdigest()[:16]
    private = ["http://127.0.0.1/", "http://10.1.2.3:80/", "http://172.31.0.1/", "http://192.168.0.1", "http://169.254.1.1", "http://0.0.0.0/", "http://[::1]/", "http://[fc00::1]:80/", "http://[fe80::2]/", "http://localhost:8000/x", "localhost.localdomain"]
    public = ["http://172.32.0.1/", "http://1270.vn", "https://x.vn/10.1.2.3", "http://[2001:db8::1]/"]
    assert one(spark, private + public, web.is_private) == [True] * len(private) + [False] * len(public)


def test_equivalent_pages_have_one_digest(spark):
    same = [
        "<p>Tom &amp; Jerry’s café</p><div>5 ½ stars</div>",
        "<P>Tom &#38; Jerry&rsquo;s caf&eacute;</P>\n\n<DIV class='a>b'>5 &frac12;​ stars",
        "<script>if (a < b) { x('</p>') }</script><p>Tom &#x26; Jerry’s <b>ca</b>fé<br>5 ½ <!-- no -->stars</p><style>p{}</style>",
        "<template><p>not <template>shown</template></p></template>Tom &amp;amp; Jerry’s café﻿<hr/>5 ½　stars</noscript>",
        "Tom & Jerry’s café 5 1⁄2 stars",
    ]
    texts = one(spark, same, web.visible_text)
    assert texts == ["Tom & Jerry’s café 5 1⁄2 stars"] * len(same)
    assert len(set(one(spark, same, web.content_fingerprint))) == 1
    odd = [None, "", "<", "<p", "a < b", "<![x", "<!-- open", "&#0; &bogus; &notit;", "</p></script>x", "<noscript>all <p>hidden", "x" * 300_000 + "<b>" * 3000]
    assert one(spark, odd, web.visible_text)[:2] == ["", ""] and len(one(spark, odd, web.visible_text)) == len(odd)


BASE = "http://a/b/c/d;p?q"
NORMAL = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "g#s": "http://a/b/c/g",
    "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
}


def test_links_resolve_as_the_standard_says(spark):
    pages = [f"<a href='{target}'>x</a>" for target in NORMAL]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = [r[1] for r in sorted(rows.select("i", web.page_links(F.col("html"), F.lit(BASE))).collect())]
    assert got == [[v] for v in NORMAL.values()]


def test_links_of_odd_pages(spark):
    pages = [
        ('<A HREF=b.html>1</A><a class="x" href = "b.html#top">2</a><a href="c?x=1&amp;y=2">3</a>', "http://x.vn/a/", ["http://x.vn/a/b.html", "http://x.vn/a/c?x=1&y=2"]),
        ('<base target="_top"><base href="/other/"><base href="/late/"><a href="d">1</a>', "http://x.vn/a/", ["http://x.vn/other/d"]),
        ('<a href="#s">1</a><a href="">2</a><a href="http://x.vn/a#s">3</a><a href="a">4</a>', "http://x.vn/a", []),  # the page itself
        ('<a href="mailto:x@y">1</a><a href="javascript:go()">2</a><a href="tel:1">3</a><a href="ftp://x/y">4</a><a href="http://">5</a><a href="http://[bad">6</a><a href="ok">7</a>', "https://x.vn", ["https://x.vn/ok"]),
        ("<a href='one'>open<a href=two>more<p", "http://x.vn/", ["http://x.vn/one", "http://x.vn/two"]),
        ("<!-- <a href='no'> --><script>'<a href=no>'</script><noscript><a href='yes'></noscript>", "http://x.vn/", ["http://x.vn/yes"]),
        (None, "http://x.vn/", []),
        ("<a href='x'>", None, []),
    ]
    rows = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(pages)], "i int, html string, url string")
    got = [r[1] for r in sorted(rows.select("i", web.page_links(F.col("html"), F.col("url"))).collect())]
    assert got == [p[2] for p in pages]
    found = curation.discovered(rows.withColumn("depth", F.lit(1)), "html", "depth")
    assert "http://x.vn/other/d" in {r.url for r in found.collect()}


def test_images(spark):
    page = "<img src='a.png' alt='A'><IMG class=x SRC=\"b.png\"><img alt=\"\" src='data:x'><img src='blob:y'><img><img src=''>"
    got = one(spark, [page], lambda c: web.images(c, F.lit("http://p")))[0]
    assert [(i.src, i.alt) for i in got] == [("a.png", "A"), ("b.png", "")]
    assert got[0].image_id == "img_" + hashlib.md5(b"http://p:a.png").hexdigest()[:16]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("The tower is 330 metres tall. Really? Yes it was.", ["The tower is 330 metres tall.", "Yes it was."]),
        ("# Heading is here\n[1]\nSource: it is said\nnguồn: có 5\n- [2] it is\nshort\nno facts at all here", []),
        ("Hà Nội có nhiều hồ.\n\nTheo báo cáo giá tăng! Ok 1.", ["Hà Nội có nhiều hồ.", "Theo báo cáo giá tăng!"]),
        ("Visit Paris soon", ["Visit Paris soon"]),
        ("thisis wasabi canned", []),
        ("it is so! " * 12, ["it is so!"] * 8),
        (None, None),
        ("", []),
    ],
)
def test_claims(spark, answer, want):
    assert one(spark, [answer], text.claims) == [want]


def test_date_names(spark):
    got = one(spark, ['{"publicationDate": "a", "OG:updated_time": "b"}', '{"x": {"published-time": "c", "modified_at": "d"}}', '{"date": "no", "pubdate": "no"}', '{"meta": [{"property": "og:published_time", "content": "e"}]}'], payload.metadata_dates)
    assert [(g.published, g.updated) for g in got] == [("a", "b"), ("c", "d"), (None, None), ("e", None)]
