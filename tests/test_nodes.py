"""Node tables and the rules of profiles on pages made for each rule."""

import pytest
from pyspark.sql import functions as F

from cataloom.operators import nodes


def table(spark, pages):
    rows = [(k, h) for k, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("pos", F.lit("clash"))
    return nodes.node_table(df, "page_id")


def by(df, *columns):
    return {r["page_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_nodes_have_places_and_ranges(spark):
    page = "<!-- c --><body><p id=x class='a b'>one <b>two</b> three<br>four</p><script>var p='<p>';</script><div>five<p>six</body>"
    rows = sorted(table(spark, [page, None, ""]).collect(), key=lambda r: r["pos"])
    assert [(r["tag"], r["text"]) for r in rows] == [("body", None), ("p", None), (None, "one "), ("b", None), (None, "two"), (None, " three"), ("br", None), (None, "four"), ("div", None), (None, "five"), ("p", None), (None, "six")]
    assert [r["close"] for r in rows] == [11, 7, 2, 4, 4, 5, 6, 7, 11, 9, 11, 11] and [r["depth"] for r in rows][:5] == [0, 1, 2, 2, 3]
    assert rows[1]["id"] == "x" and rows[1]["cls"] == "a b" and {r["page_id"] for r in rows} == {0}
    assert by(nodes.page_lines(table(spark, [page]), "page_id"), "lines") == {0: ["one two three", "four", "five", "six"]}


PROFILES = [
    # an English page: two lines below the name, a redirector link, tabs without a pane
    """<html><body><h1>Acme <b>Saws</b></h1><div>Taipei, Taipei</div><div>Taiwan</div><p>Booth: A-12</p><ul><li>Home</li><li>Products</li></ul><div>#</div>
       <div>We make <em>fine</em> saws.</div><div>Since 1970.</div><h2>Products</h2><div>Saw</div>
       <a href="https://x.example">https://linkedin.com/acme</a><a href="/a">www.plain.example</a><a href="/Boothurl.aspx?u=1">WWW.acme.example</a></body></html>""",
    # a Japanese page with a pane; a url follows the name at once
    """<body><h1>  </h1><h1>東京精機</h1>https://t.example<p>小間番号：1234</p><div id="HOME"><p>ホーム</p><p>半導体<span>装置</span>の会社です。</p><p>カテゴリ</p><p>x</p></div></body>""",
    # the booth marks where the overview begins; one line of place; the own host isn't a website
    "<h1>Solo</h1><p>Osaka</p><p>booth 77</p><p>Short text here</p><p>More of it</p><a href=/x>http://www.semi.org/solo</a>",
    # nothing to read
    "<div>only a line</div>",
    "<p> </p>",
]


def test_profiles(spark):
    got = by(nodes.profiles(table(spark, PROFILES), "page_id"), "name", "booth", "city_region", "country", "website", "about", "page_lang")
    assert got == {
        0: ("Acme Saws", "A-12", "Taipei", "Taiwan", "https://WWW.acme.example", "We make fine saws.\nSince 1970.", "en"),
        1: ("東京精機", "1234", None, None, None, "半導体装置の会社です。", "ja"),
        2: ("Solo", "77", "Osaka", None, None, "Short text here\nMore of it\nhttp://www.semi.org/solo", "en"),
        3: (None, None, None, None, None, None, "en"),
    }


def test_texts_behind_a_heading_are_bounded(spark):
    far = "<h1>N</h1>" + "<p> </p>" * 13 + "<p>City</p><p>Land</p>"
    near = "<h1>N</h1>" + "<p> </p>" * 10 + "<p>City</p><p>Land</p>"
    # the heading's own text is one of the fourteen
    assert by(nodes.places(table(spark, [far, near]), "page_id"), "city_region", "country") == {1: ("City", "Land")}


def test_headquarters(spark):
    pages = [
        "<span id='ctl00_LBLCity_1'>Hsinchu</span><span class=BoothContactCity>Wrong</span><b id=x_lblCountry>Taiwan</b><a href=/r>http://a.example</a>",
        "<i class='x BoothContactCity'>Paris</i><i class=BoothContactCountry>Paris</i>",
        "<title>t</title><h1>Acme Co</h1><p>www.acme.example</p><p>mail.acme.com</p><p>Munich</p><p>Germany</p><p>Booth: 3</p><a href=x>https://www.semi.org</a><a href=y>HTTPS://acme.example/</a>",
        "<h1>Acme Co</h1><p>Kyoto</p><p>Send Email</p><p>Japan</p>",
        "<h1>Other</h1><p>Kyoto</p>",
    ]
    names = spark.createDataFrame([(i, "Acme Co") for i in range(5)], "page_id long, name string")
    got = by(nodes.headquarters(table(spark, pages), "page_id", names), "hq_location", "website")
    assert got == {0: ("Hsinchu, Taiwan", "http://a.example"), 1: ("Paris", None), 2: ("Munich, Germany", "HTTPS://acme.example/"), 3: ("Kyoto", None), 4: (None, None)}


def test_each_pass_finds_its_website(spark):
    pages = [
        "<a href='https://first.example/'>first</a><p>Website</p><a href='https://said.example/'>here</a><a class=globe href='https://icon.example'>x</a>",
        "<a href='https://first.example/'>first</a><a class='fa-globe' href='https://icon.example'></a>",
        "<a href='/co/self'>self</a><a href='mailto:x@y'>mail</a><a href='https://any.example/a/'>any</a>",
        "<a href='https://v.example'>Visit   Website</a>",
        "<p>none</p>",
    ]
    sites = spark.createDataFrame([(i, "https://portal.example/co/x") for i in range(5)], "page_id long, url string")
    got = by(nodes.linked_websites(table(spark, pages), "page_id", sites), "website", "found_by")
    assert got == {0: ("https://said.example", 1), 1: ("https://icon.example", 2), 2: ("https://portal.example/co/self", 3), 3: ("https://v.example", 1)}


@pytest.mark.parametrize("cut", [4000])
def test_each_fallback_finds_its_overview(spark, cut):
    long, text = "long " * 1000, "An overview of more than thirty characters."
    pages = [
        f"<div class='company-profile'>{text}<p>two</p></div><p>{'x' * 90}</p>",
        f"<div class=about>short</div><h3>About us</h3><span>no</span><p>tiny</p><h4>Company Profile</h4><div>{text}</div>",
        f"<meta property='og:description' content='og {text}'><meta name=description content='  {text} '><p>{'y' * 90}</p>",
        f"<p>{'z' * 81}</p><p>{long}</p><p>{'z' * 100}</p>",
        f"<p>{'z' * 80}</p>",
    ]
    got = by(nodes.portal_overviews(table(spark, pages), "page_id"), "overview", "found_by")
    assert got == {0: (f"{text} two", 1), 1: (text, 2), 2: (text, 3), 3: (long.strip()[:cut], 4)}


def test_empty_table(spark):
    none = nodes.node_table(spark.createDataFrame([], "page_id long, html string"), "page_id")
    assert nodes.profiles(none, "page_id").count() == 0 and nodes.portal_overviews(none, "page_id").count() == 0


def test_rows_of_a_directory(spark):
    page = """<table><tr><th>Company Name</th><th>Booth</th></tr><tr><td><a href='/co/acme'>Acme</a></td><td> A-12 </td></tr><tr><td>760</td><td>Beta  Co</td></tr>
    <tr><td>Gamma</td><td>1 2</td><td><a href='eBooth.aspx?x=1'>map</a><a href='/co/g'>g</a></td></tr><tr><td>only</td></tr><tr><td></td><td>B 7</td></tr><tr><td>Delta</td><td><a href='/other'>x</a></td></tr></table>"""
    pages = spark.createDataFrame([(0, "https://e.example/list/", page)], "page_id long, url string, html string")
    got = sorted(tuple(r)[2:] for r in nodes.directory_rows(nodes.node_table(pages, "page_id"), "page_id", pages).collect())
    assert got == [
        ("Acme", "A-12", None, "https://e.example/co/acme", "ok"), ("Beta Co", "760", None, None, "no-portal-listed"), ("Delta", "", None, None, "no-portal-listed"),
        ("Gamma", "", "https://e.example/list/eBooth.aspx?x=1", None, ""),
    ]


def test_each_strategy_finds_its_about(spark):
    long, text = "This line has far more than thirty characters.", "A description of more than forty characters in all."
    pages = [
        f"<div class='x co-description'>{text} 2</div><p id=lblDescription1>{text}</p>",
        f"<p id=Description>short</p><div id=ctl00_dvContent><p>Acme</p><p>{long} no</p><h3> overview </h3><p>{long}</p><p>tiny</p><p>Another line, of 20 and more.</p><p>Categories</p><p>{long}</p></div>",
        f"<p>{long} before</p><p>Booth: 12</p><p>{long} head</p><p>Overview</p><p>{long}</p><p>{long[:30]}</p><p>Send Mail</p><p>{long} after</p>",
        f"<p>Booth: 12</p><p>{long}</p><p>Categories</p>",
        f"<p>{long}</p>",
    ]
    got = by(nodes.abouts(table(spark, pages), "page_id"), "about", "found_by")
    assert got == {0: (text, 1), 1: (f"{long} Another line, of 20 and more.", 2), 2: (long, 3), 3: (long, 3)}


def test_portal_pages_use_all_passes(spark):
    from cataloom.operators.profiles import portal_pages

    page = "<h1>Acme</h1><a href='https://first.example'>x</a><p>Website</p><a href='https://acme.example/'>here</a><address>1 Road, Tokyo, Japan</address><p>" + "words " * 20 + "</p>"
    pages = spark.createDataFrame([(1, "https://portal.example/co/acme", page), (2, "https://portal.example/co/none", "<p>nothing</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in portal_pages(pages, "page_id").collect()}
    assert (got[1]["name"], got[1]["website"], got[1]["website_by"], got[1]["overview"], got[1]["overview_by"], got[1]["country"]) == ("Acme", "https://acme.example", 1, ("words " * 20).strip(), 4, "Japan")
    assert (got[2]["website"], got[2]["overview"], got[2]["website_by"]) == ("", "", None)
