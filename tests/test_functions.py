"""Scalar functions against values from the blueprint's fixtures."""

import pytest
from pyspark.sql import functions as F

from cataloom.functions import geo, text, urls
from cataloom.operators import present, report


def value(spark, column, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x"))).first()[0]


NAMES = [
    ("Advantest Co., Ltd.", "advantest", "advantest", "advantest"),
    ("ADVANTEST CORPORATION", "advantest", "advantest", "advantest"),
    ("ASML Korea", "asml korea", "asml korea", "asml korea"),
    ("ASML Netherlands B.V.", "asml netherlands", "asml netherlands", "asml netherlands b v"),
    ("Foo GmbH & Co. KG", "foo gmbh and", "foo", "foo kg"),
    ("X S.p.A.", "x", "x", "x s p a"),
    ("Co., Ltd.", "co", "", ""),
    ("AB", "ab", "", "ab"),
    ("Acme India Technologies Pvt. Ltd.", "acme india technologies", "acme india technologies", "acme"),
    ("ＡＳＭＬ，Ｌｔｄ．", "asml", "ａｓｍｌ ｌｔｄ", "asml"),
    (None, "", "", ""),
]


def test_name_keys(spark):
    df = spark.createDataFrame([(n[0],) for n in NAMES], "x string")
    x = F.col("x")
    got = [tuple(r) for r in df.select(text.name_key(x), text.fallback_key(x), text.portal_key(x)).collect()]
    assert got == [n[1:] for n in NAMES]


@pytest.mark.parametrize(
    ("url", "host", "full"),
    [
        ("www.asml.com/en", "asml.com", "asml.com"),
        ("http://www.asml.com:80/x", "asml.com", "asml.com:80"),
        ("http://zeiss.co.jp", "zeiss.co.jp", "zeiss.co.jp"),
        ("https://www2.foo.com", "www2.foo.com", "foo.com"),
        ("https://izm.fraunhofer.de", "izm.fraunhofer.de", "izm.fraunhofer.de"),
        ("https://www.linkedin.com/company/x", "linkedin.com", None),
        ("gmail.com", None, "gmail.com"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_domains(spark, url, host, full):
    assert (value(spark, urls.website_domain, url), value(spark, urls.full_domain, url)) == (host, full)


@pytest.mark.parametrize(("place", "country"), [("Hsinchu, Taiwan", "Taiwan"), ("Wonju-si, Korea (South)", "South Korea"), ("Brussels", "United States"), (None, "Unknown"), ("", "Unknown"), ("Narnia", "Unknown")])
def test_country(spark, place, country):
    assert value(spark, geo.country_of, place) == country


def test_places(spark):
    assert value(spark, geo.deduped_place, "United Kingdom, United Kingdom") == "United Kingdom"
    assert value(spark, geo.deduped_place, "Hsinchu City, Taiwan, Taiwan") == "Hsinchu City, Taiwan"
    assert tuple(value(spark, geo.headquarters_of, "12, MG Road, Bengaluru 560001, Karnataka, India")) == ("Bengaluru, Karnataka", "India")
    assert tuple(value(spark, geo.headquarters_of, "Pune, India")) == ("Pune", "India")
    assert tuple(value(spark, geo.headquarters_of, "Japan")) == ("Japan", "Japan")
    assert tuple(value(spark, geo.headquarters_of, "")) == ("India", "India")


@pytest.mark.parametrize(
    ("loc", "country", "card"),
    [("San Jose, CA", "USA", "San Jose, CA, United States"), ("Shanghai, China", "Netherlands", "Netherlands"), ("京都市", "Japan", "Japan"), ("#N/A", "Japan", "Japan"), (None, "Unknown", None), ("Taipei", None, "Taipei")],
)
def test_card_headquarters(spark, loc, country, card):
    got = spark.createDataFrame([(loc, country)], "l string, c string").select(geo.card_headquarters(F.col("l"), F.col("c"))).first()[0]
    assert got == card


def test_sentences_and_cleaning(spark):
    assert value(spark, text.sentences, "We make pumps. Visit us at booth R7705. e.g. this stays.") == ["We make pumps.", "Visit us at booth R7705. e.g. this stays."]
    c = value(spark, text.cleaned_overview, "We design vacuum pumps for etch tools. X is located at booth R7705.")
    assert (c["cleaned"], len(c["removed"]), c["fallback_used"]) == ("We design vacuum pumps for etch tools.", 1, False)
    c = value(spark, text.cleaned_overview, "Booth: R7705")
    assert (c["cleaned"], c["fallback_used"]) == ("Booth: R7705", True)
    assert value(spark, text.cleaned_overview, None)["cleaned"] == ""


def test_truncation_hashes_tokens(spark):
    assert value(spark, lambda x: text.truncated(x, 12), "alpha beta gamma delta") == "alpha beta ...[truncated]"
    assert value(spark, lambda x: text.truncated(x, 5), "abcdefghij") == "abcde ...[truncated]"
    h = value(spark, lambda x: text.digest(F.lit("a"), x, F.lit("b")), None)
    assert h == "8036271ac3d78f16afba"
    assert value(spark, lambda x: text.cache_key(x, F.lit(h)), "Acme") == "d0cea4596ab5a1d2c8b22e80"
    assert value(spark, text.query_tokens, "semiconductor equipment supplier") == []
    assert value(spark, text.query_tokens, "CMP  slurry!!") == ["cmp", "slurry"]
    assert value(spark, text.without_fences, "```json\n{}\n```") == "{}"


def test_slugs(spark):
    for name, slug in [("3D Glass Solutions", "3d-glass-solutions"), ("AC&C Technology Pte Ltd", "ac&c-technology-pte-ltd"), ("Accurex Solutions Pvt. Ltd", "accurex-solutions-pvt.-ltd"), ("Advance Panels & Switchgears P Ltd", "advance-panels-&-switchgears-p-ltd")]:
        assert value(spark, text.slug, name) == slug


def test_chunks(spark):
    long = "A sentence of some words. " * 60
    parts = value(spark, text.chunks, long + "x" * 900)
    assert all(len(p) <= 800 for p in parts) and "".join(parts).replace(" ", "") == (long + "x" * 900).replace(" ", "")
    assert value(spark, text.chunks, None) == []


def test_overview(spark):
    o = value(spark, present.parsed_overview, "Makes pumps. Booth: A12. Value Chain Role: Equipment. Key Capabilities: dry pumps, abatement.")
    assert (o["summary"], o["booth"], o["valueChain"], o["capabilities"]) == ("Makes pumps.", "A12", "Equipment", ["dry pumps", "abatement"])
    o = value(spark, present.parsed_overview, "Booth: A12. Capital equipment supplier for fabs.")
    assert (o["summary"], o["structured"], o["booth"]) == ("Booth: A12. Capital equipment supplier for fabs.", False, None)
    assert value(spark, present.parsed_overview, None)["summary"] == ""


def test_inferred(spark):
    df = spark.sql("SELECT array('x (Inferred)') AS s, array('a', 'b (inferred)') AS c, array('y (inferred)') AS r")
    assert df.select(report.inferred(F.col("s"), F.col("c"), F.col("r"))).first()[0] == 3


def test_listing_and_websites(spark):
    assert value(spark, text.is_listing, "Show all exhibitors") and not value(spark, text.is_listing, "Acme")
    assert not value(spark, urls.is_company_website, "https://www.linkedin.com/x") and value(spark, urls.is_company_website, "https://acme.com")
    assert value(spark, urls.tidy_website, "acme.com/") == "https://acme.com"
    assert value(spark, urls.booth_id, "x?boothid=17&y") == "17"
    assert value(spark, urls.digits_id, "CatID=      203") == 203
    df = spark.createDataFrame([("https://a.example/x/", "../y/"), ("https://a.example", "mailto:x")], "b string, l string")
    assert [r[0] for r in df.select(urls.external_url(F.col("b"), F.col("l"))).collect()] == ["https://a.example/y", None]


def test_blocked_urls(spark):
    rows = [("https://www.facebook.com/x", True), ("//linkedin.com/y", True), ("https://b.example/x#y", True), ("https://b.example/ebooth/1", True), ("TEL:12", True), ("https://b.example/?u=facebook.com", False), ("https://b.example", False), (None, False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    assert [r[0] for r in df.select(urls.is_blocked(F.col("u"))).collect()] == [w for _, w in rows]
    links = spark.createDataFrame([("https://a.example/p", x) for x in ("//facebook.com/me", "#top", " https://b.example/ ", "eventmap", "tel:1", "mailto:a@b.c", "q/")], "b string, l string")
    assert [r[0] for r in links.select(urls.external_url(F.col("b"), F.col("l"))).collect()] == [None, None, "https://b.example", None, None, None, "https://a.example/q"]


def test_cleaning_twice_changes_nothing(spark):
    texts = ["Visit us at booth A12. We make pumps and valves for dairies. Come and see us at booth 7!", "Visit us at booth A12.", "", None, "Pumps. " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.cleaned_overview(F.col("t")).alias("c"))
    once = [r.c for r in df.collect()]
    assert [r.cleaned for r in once] == [r[0] for r in df.select(text.cleaned_overview(F.col("c.cleaned"))["cleaned"]).collect()]
    assert once[0].cleaned.startswith("We make pumps") and len(once[0].removed) >= 1 and once[1].fallback_used and once[1].cleaned == texts[1]
