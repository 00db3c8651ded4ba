"""Company pages, languages, translation, portal records and stems."""

from pyspark.sql import functions as F

from cataloom.functions.stem import stem, stemmed_terms
from cataloom.operators import profiles
from cataloom.schema import REFINED


def test_portal_profile(spark):
    page = """<html><head><meta name="description" content="Meta text"></head><body><h1> Acme  Ltd</h1><a href="https://www.linkedin.com/x">in</a><a href="http://acme.example/">site</a>
    <address>1 Road, Pune, India</address><p>Booth No. H12</p><p>short</p><p>mail: a.b@acme.example, +91 20 1234 5678</p></body></html>"""
    got = {r["id"]: r for r in profiles.portal_profiles(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id").collect()}
    r = got[1]
    assert (r["name"], r["website"], r["booth"], r["address"], r["overview"]) == ("Acme Ltd", "http://acme.example", "H12", "1 Road, Pune, India", "Meta text")
    assert (r["email"], r["phone"], r["country"]) == ("a.b@acme.example", "+91 20 1234 5678", "India")
    assert (got[2]["name"], got[2]["website"], got[2]["country"]) == ("", "", "")


def test_preferred_page(spark):
    rows = [(1, 0, "ja", 1), (1, 1, "en", 1), (2, 0, "ja", 2), (3, 0, "en", 9), (3, 1, "ja", None)]
    got = {r["booth_id"]: (r["ordinal"], r["warnings"]) for r in profiles.preferred_pages(spark.createDataFrame(rows, "booth_id int, ordinal int, page_lang string, landed_id int")).collect()}
    assert got == {1: (1, []), 2: (0, ["page_not_english"]), 3: (1, ["redirected_to_booth_9", "page_not_english"])}


def test_translation(spark):
    class Upper:  # local, so that it is sent to the workers by value
        def translate(self, text, source):
            if "失" in text:
                raise ConnectionError
            return f"{source}:{text}"

    rows = spark.createDataFrame([(1, "plain"), (2, "カナ"), (3, "漢字"), (4, "失敗"), (5, None), (6, "既知")], "id int, t string")
    cache = rows.filter("id = 6").select(F.sha1(F.col("t").cast("binary")).alias("key"), F.lit("known").alias("english"))
    got = {r["id"]: r["t_en"] for r in profiles.translated(rows, "t", cache, Upper).collect()}
    assert got == {1: "plain", 2: "ja:カナ", 3: "auto:漢字", 4: None, 5: "", 6: "known"}


def test_portal_records(spark):
    rows = spark.createDataFrame([("Acme", "u", "acme.example", "1, Pune, Maharashtra, India", "B1"), (" ", "", "", "", "")], "company_name string, ebooth_url string, website string, address string, booth string")
    got = profiles.portal_records(rows, F.lit(None).cast(REFINED)).collect()
    assert len(got) == 1 and (got[0]["website"], got[0]["hq_location"], got[0]["hq_country"], got[0]["about"], got[0]["locations"]) == ("https://acme.example", "Pune, Maharashtra", "India", "Booth: B1.", ["India expo"])


def test_stems(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control", "sky": "sky"}
    assert {w: stem(w) for w in want} == want
    got = spark.createDataFrame([("The motoring cats",), (None,)], "t string").select(stemmed_terms(F.col("t"), ["the"])).collect()
    assert [r[0] for r in got] == [["motor", "cat"], []]
