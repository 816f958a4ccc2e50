"""Hand-written cases for single values."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import common as C
from parcelgrid.functions import scalar as S
from parcelgrid.functions.responses import parse_llm_response
from parcelgrid.operators import extract as E
from parcelgrid.operators import quality as Q
from parcelgrid.operators import valuation as V
from parcelgrid.operators.places import normalize_place_name
from parcelgrid.plans.features import feature_names


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [("€250,000", 250000.0), ("250.000", 250000.0), ("1.200.000", 1200000.0), ("99.5", 99.5), ("call", None)])
def test_price_text(spark, text, value):
    assert one(spark, S.parse_price_text(F.lit(text))) == value


def test_euro_amount_with_spaces(spark):
    assert one(spark, S.parse_eur_bgn_prices(F.lit("15 338.76 €")))["eur"] == 15338.76


def test_currency(spark):
    got = one(spark, S.convert_currency(F.lit(195583.0), F.lit("BGN")))
    assert (got["price"], got["currency"]) == (100000.0, "EUR")


@pytest.mark.parametrize("country,value", [("MT", 97.0), ("BG", 93.0), ("XX", 95.0)])
def test_adjusted_price(spark, country, value):
    assert one(spark, S.adjusted_price(F.lit(100.0), F.lit(country))) == value


def test_listing_dates(spark):
    assert one(spark, S.parse_listing_date(F.lit("2026-02-16T10:34:49.443"))) == dt.datetime(2026, 2, 16, 10, 34, 49, 443000)
    assert one(spark, S.parse_listing_date(F.lit("5 април, 2026"))) == dt.datetime(2026, 4, 5)
    assert one(spark, S.parse_listing_date(F.lit("soon"))) is None
    assert one(spark, S.listing_time_from_url(F.lit("/obiava-1b1768396082xyz"))) == dt.datetime(2026, 1, 14, 13, 8, 2)


def test_clean_item_bounds(spark):
    df = spark.createDataFrame([(1.0, "EUR", a, f) for a, f in ((4.0, -6), (5.0, 100), (10000.0, 101), (10001.0, 0))] + [(0.0, "EUR", 50.0, 1)],
                               "price double, price_currency string, area_sqm double, floor int")
    assert [(r["area_sqm"], r["floor"]) for r in S.clean_item(df).collect()] == [(None, None), (5.0, 100), (10000.0, None), (None, 0)]


@pytest.mark.parametrize("price,kind,flag", [(50.0, "apartment", "price_placeholder"), (500.0, "apartment", "price_suspiciously_low"), (500.0, "parking", None),
                                             (0.5, "apartment", "price_zero_or_negative"), (10_000_001.0, "apartment", "price_extreme_high")])
def test_price_flags(spark, price, kind, flag):
    df = spark.createDataFrame([(price, None, kind, "sale", "t", "x")],
                               "price_eur double, area_sqm double, property_type string, listing_type string, title string, locality string")
    medians = spark.createDataFrame([], "locality string, median double")
    assert Q.flag_suspicious(df, medians).first()["suspicious"] == ([flag] if flag else [])


def test_title_price(spark):
    assert one(spark, Q.title_price_mismatch(F.lit("480.000 €"), F.lit(480.0))) == "price_title_mismatch:480000vs480"


@pytest.mark.parametrize("name,norm", [("Tas-Sliema", "sliema"), ("Il-Gżira", "gzira"), ("Iż-Żejtun", "zejtun"), ("Birżebbuġa", "birzebbuga"),
                                       ("Il-Mellieħa", "mellieha"), ("", "")])
def test_place_names(spark, name, norm):
    assert one(spark, normalize_place_name(F.lit(name))) == norm


def test_response(spark):
    ok = one(spark, parse_llm_response(F.lit('```json\n{"condition": 8, "view": "sea", "floor": null}\n```')))
    assert (ok["condition"], ok["view"], ok["floor"]) == (5, "sea", None)
    for bad in ("not json", "[1]", "{}", '{"other": 1}'):
        assert one(spark, parse_llm_response(F.lit(bad))) is None


def test_scores(spark):
    assert [one(spark, V.certainty_score(F.lit(n))) for n in (0, 1, 3, 5, 10)] == [0, 25, 50, 80, 100]
    assert one(spark, V.band_width(F.lit(0.118), F.lit(0))) == pytest.approx(0.1475)
    assert one(spark, V.band_width(F.lit(0.118), F.lit(20))) == pytest.approx(0.45)


def test_idw_single_comparable(spark):
    req = spark.createDataFrame([(1, 100.0)], "request_id long, area_sqm double")
    comps = spark.createDataFrame([(1, 2000.0, 50.0)], "request_id long, price_per_sqm double, distance_m double")
    row = V.idw_estimate(req, comps).first()
    assert (row["estimate"], row["low"], row["high"]) == (200000.0, 200000.0, 200000.0)


def test_json_ld_snippet(spark):
    html = ('<script type="application/ld+json">{"@type":"Offer","price":100,"itemOffered":{"sku":"x","image":"u"}}</script><h1>A  B</h1>')
    row = E.extract_detail_jsonld(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (row["price_original"], row["images"], row["title"]) == (100.0, ["u"], "A B")


def test_feature_lists():
    assert (len(feature_names()), len(feature_names(serve_consistent=True))) == (97, 79)


def test_values_are_worked_out_once(spark):
    """The cost of a page: a text that several branches need is matched once."""
    def passes(column):
        plan = spark.createDataFrame([("x",)], "t string").select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("regexp_replace(")

    text = F.regexp_replace("t", "a", "b")
    assert passes(E.absolute(text)) == 1
    assert passes(C.number_at(text, "(b+)")) == 1
    assert passes(C.first_match(text, [("x", 1), (("y", "z"), 2)])) == 1


def test_blocks_and_stretches(spark):
    html = ('<DIV class="item">a<b>1</b></DIV><div>between</div><div  class=\'top item\'>2 < 3<p>x</p><div class="xitem">in</div></div>'
            '<div class="item">last <a href="/obiava-x">&amp;lt;\t \n y</a>')
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    rows = df.select(E.blocks("h", "div", E.has_class("item")).alias("b"), E.inner("h", "a").alias("i"),
                     E.squeeze(E.html_text(E.inner("h", "a"))).alias("t")).collect()
    assert [len(x) for x in rows[0]["b"]] == [len(p) for p in (html[:html.index("<div  ")], html[html.index("<div  "):html.index('<div class="item">last')],
                                                             html[html.index('<div class="item">last'):])]
    assert (rows[0]["i"], rows[0]["t"]) == ("&amp;lt;\t \n y", "&lt; y")
    assert (rows[1]["b"], rows[1]["i"], rows[2]["b"], rows[2]["t"]) == ([], "", None, None)


def test_api_answer_is_parsed_once(spark):
    df = spark.createDataFrame([('{"MLS": "", "Id": 7, "Price": "1,200", "TotalSqm": 0, "TotalIntArea": 50, "Town": "Sliema", "Coordinates": {"lat": 35.9}}',),
                                ("{broken",), (None,)], "raw_json string")
    out = E.normalize_api_listing(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("json_tuple(") == 1
    rows = out.collect()
    assert [rows[0][c] for c in ("external_id", "price_eur", "price_per_sqm", "locality", "lat", "lon")] == ["7", 1200.0, 24.0, "Sliema", 35.9, None]
    assert [r["doc_id"] for r in rows[1:]] == [None, None]


def test_response_is_stripped_once(spark):
    """The fences' pattern is matched once a text, however often the body is named."""
    from parcelgrid.functions.responses import with_text_features
    rows = [(1, '```json\n{"condition": 9, "quality_tier": "luxury"}\n```'), (2, '{"condition": null}'), (3, '{"other": 1}'), (4, "not json"), (5, None), (6, "")]
    df = with_text_features(spark.createDataFrame(rows, "id int, response string"), "response", with_images=True)
    got = {r["id"]: r["text"] and (r["text"]["condition"], r["text"]["quality_tier"]) for r in df.collect()}
    assert got == {1: (5, "luxury"), 2: (None, None), 3: None, 4: None, 5: None, 6: None}
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 1
