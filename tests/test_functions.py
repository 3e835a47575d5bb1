"""Literal cases for URL, text and span functions."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import spans, text, urls


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://www.x.org/a?b#c", "x.org/a"), ("https://www2.x.y/p/", "x.y/p/"), ("http://www.com", "com"), ("http://x.org", "x.org"),
        ("http://user@x.org:80/a", "user@x.org:80/a"), ("no host", "no host"), ("", ""),
    ],
)
def test_normalized(spark, url, want):
    assert one(spark, urls.normalized(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "base,href,want",
    [
        ("http://a.b/c/d?q#f", "e", "http://a.b/c/e"), ("http://a.b/c/d", "/e", "http://a.b/e"), ("http://a.b/c", "//x.y/z", "http://x.y/z"), ("http://a.b", "e", "http://a.b/e"),
        ("http://a.b/c?q", "?r", "http://a.b/c?r"), ("http://a.b/c#f", "#g", "http://a.b/c#g"), ("http://a.b/c", "mailto:x", "mailto:x"), ("http://a.b/c", " ", None), ("http://a.b/c", None, None),
        ("http://a.b/c/d/e", "../f", "http://a.b/c/f"), ("http://a.b/c/d/e", "./f?x=../y", "http://a.b/c/d/f?x=../y"), ("http://a.b/c/d", "../../../f", "http://a.b/f"), ("http://a.b/c/d/e", "..", "http://a.b/c/"), ("http://a.b/c", "/x/./y/../z", "http://a.b/x/z"),
    ],
)
def test_resolved(spark, base, href, want):
    assert one(spark, urls.resolved(F.lit(base), F.lit(href))) == want


@pytest.mark.parametrize("url,want", [("HTTP://A.b:80", "http://a.b/"), ("https://a.b:443/x?y#z", "https://a.b/x?y#z"), ("http://destination.com", "http://destination.com/"), ("/rel", None)])
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


@pytest.mark.parametrize("host,path,want", [("news.bbc.co", "/a/2010/An-Article-Title", "co/bbc/news/a/#/A"), ("bbc.co", "/", "co/bbc/S"), ("a.b.c.d", "/X//y", "d/c/b/a/x/y")])
def test_generalized(spark, host, path, want):
    assert one(spark, urls.generalized(F.col("h"), F.col("p")), h=host, p=path) == want


@pytest.mark.parametrize("host,want", [("news.bbc.co.uk", "co.uk/bbc/news/x"), ("bbc.co.uk", "co.uk/bbc/S/x"), ("a.b.com", "com/b/a/x"), ("uk", "uk//S/x")])
def test_generalized_by_suffix_list(spark, host, want):
    h = F.col("h")
    assert one(spark, urls.generalized(h, F.lit("/x"), urls.suffix_size(h, ["co.uk", "com.au"])), h=host) == want


def test_clean_and_headline(spark):
    assert one(spark, text.clean(F.col("t")), t="Salt and \xadsand \u3000 x") == "Salt and sand x"
    assert one(spark, text.is_headline(F.col("t")), t="The Quick Brown Fox Jumps Over Dogs") is True
    assert one(spark, text.is_headline(F.col("t")), t="The quick brown fox jumps over dogs") is False
    assert one(spark, text.is_headline(F.col("t")), t="Short Title Case") is False


SENTENCE = "A heron waits by the weir"


@pytest.mark.parametrize("idx,want", [(5, 2), (7, 8), (0, 0), (8, 8), (14, 14)])
def test_harmonized_start(spark, idx, want):
    assert one(spark, spans.harmonized_start(F.col("s"), F.col("i")), s=SENTENCE, i=idx) == want


@pytest.mark.parametrize("idx,want", [(8, 7), (10, 13), (7, 7), (13, 13), (25, 25)])
def test_harmonized_end(spark, idx, want):
    assert one(spark, spans.harmonized_end(F.col("s"), F.col("i")), s=SENTENCE, i=idx) == want


def test_harmonized_after_a_line_break(spark):
    assert one(spark, spans.harmonized_start(F.col("s"), F.col("i")), s="Two ab\ncd", i=7) == 7
    assert one(spark, spans.harmonized_end(F.col("s"), F.col("i")), s="Two ab.\n", i=8) == 6


@pytest.mark.parametrize(
    "given,start,end,want",
    [([(0, 20), (20, 45)], 12, 20, (0, 12, 20)), ([(0, 20), (20, 45)], 20, 24, (1, 0, 4)), ([(0, 20), (21, 30)], 15, 25, (0, 15, 20)), ([(0, 20), (21, 30)], 15, 21, (0, 15, 20)), ([(0, 18), (18, 30)], 18, 27, (1, 0, 9)), ([(0, 5)], 9, 12, (0, 9, 5))],
)
def test_clamped(spark, given, start, end, want):
    listed = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in given])
    got = one(spark, spans.clamped(F.lit(start), F.lit(end), listed))
    assert (got.idx, got.start, got.end) == (want if want[1] != 9 or len(given) > 1 else (0, 9, 5))


def test_enumerated(spark):
    got = one(spark, spans.enumerated(F.lit(0), F.lit(3), 2))
    assert [(x.start, x.end) for x in got] == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]


@pytest.mark.parametrize(
    "given,want",
    [
        ("HTTP://A.org:80", "http://a.org/"), ("http://bücher.example/ü?q=ä b#ö", "http://xn--bcher-kva.example/%C3%BC?q=%C3%A4%20b#%C3%B6"), ("http://a.org./%7euser/%e4%2f", "http://a.org/~user/%E4%2F"),
        ("http://a.org/x/../y/./z", "http://a.org/y/z"), ("http://a.org/100%", "http://a.org/100%25"), ("http://a.org/%61%2E%2e/b", "http://a.org/a../b"), ("http://a.org/😀#a#b", "http://a.org/%F0%9F%98%80#a%23b"),
        ("http://a.org?", "http://a.org/?"), ("//a.org/x", None), ("mailto:x@y", None), (None, None),
    ],
)
def test_normal_form(spark, given, want):
    assert one(spark, urls.normal_form(F.lit(given).cast("string"))) == want
