"""Storage, streaming and the registered queries."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelgrid.session import fresh_path
from parcelgrid.sources import sinks
from parcelgrid.streaming import streams as S


def test_small_publish_leaves_the_table(spark):
    root = fresh_path(spark, "t")
    sinks.write_collection(spark.range(5), root)
    with pytest.raises(ValueError):
        sinks.load_staging_swap(spark.range(0), root, min_rows=1)
    assert sinks.read_current(spark, root).count() == 5


def test_global_cap_against_brute_force(spark):
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=37 * i // 2)) for i in range(300)]
    got = {r["event_id"] for r in S.global_daily_cap(spark.createDataFrame(rows, "event_id long, ts timestamp"), 40).filter("within_cap").collect()}
    start, used, want = None, 0, set()
    for i, t in rows:
        if start is None or (t - start).total_seconds() >= 86400:
            start, used = t, 0
        used += 1
        if used <= 40:
            want.add(i)
    assert got == want


def test_quota_against_brute_force(spark):
    path = fresh_path(spark, "asks")
    rows = [(i, "ab"[i % 2], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, identifier string, ts timestamp").write.parquet(path)
    out = fresh_path(spark, "quota")
    stream = spark.readStream.schema("event_id long, identifier string, ts timestamp").parquet(path)
    S.run_available(S.quota_windows(stream), f"{out}/d", f"{out}/c").awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{out}/d").collect()}
    state, want = {}, {}
    for i, who, t in rows:
        h, hn, d, dn = state.get(who, (None, 0, None, 0))
        h, hn = (t, 1) if h is None or (t - h).total_seconds() >= 3600 else (h, hn + 1)
        d, dn = (t, 1) if d is None or (t - d).total_seconds() >= 86400 else (d, dn + 1)
        state[who], want[i] = (h, hn, d, dn), hn <= 5 and dn <= 20
    assert got == want


def test_quota_state_is_carried_given_back_and_expires(spark):
    path, out = fresh_path(spark, "asks"), fresh_path(spark, "quota")
    schema = "event_id long, identifier string, ts timestamp, release boolean"
    rows = [(i, "ab"[i % 2], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=7 * i), i % 9 == 4) for i in range(500)]
    rows[0], rows[490] = (0, "c", rows[0][2], False), (490, "c", rows[490][2], None)
    for n in range(0, 500, 125):
        spark.createDataFrame(rows[n:n + 125], schema).coalesce(1).write.mode("append").parquet(path)
    S.run_available(S.quota_windows(S.read_event_stream(spark, path, schema), watermark="1 minute"), f"{out}/d", f"{out}/c").awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{out}/d").collect()}
    state, want = {}, {}
    for i, who, t, back in rows:
        h, hn, d, dn = state.get(who, (t, 0, t, 0))
        if back:
            state[who] = h, max(0, hn - 1), d, max(0, dn - 1)
            continue
        h, hn = (t, 1) if hn == 0 or (t - h).total_seconds() >= 3600 else (h, hn + 1)
        d, dn = (t, 1) if dn == 0 or (t - d).total_seconds() >= 86400 else (d, dn + 1)
        state[who], want[i] = (h, hn, d, dn), hn <= 5 and dn <= 20
    assert got == want and False in want.values()


def test_pages_are_parsed_again_with_all_fields_and_errors_counted(spark):
    from parcelgrid.plans.pipelines import reparse_pages
    page = ("<script type='application/ld+json'>{\"@type\":\"Offer\",\"itemOffered\":{\"image\":[\"u1\",\"u2\"]}}</script><h1>t</h1>"
            "<div class='adParams'></div><div class='carExtri'><div>Асансьор</div><div>Гараж</div></div><div class='moreInfo'>d</div>")
    at = dt.datetime(2026, 1, 1)
    pages = spark.createDataFrame([(1, "x1", page, at), (2, "x2", "<p>no title</p>", at)], "page_id long, listing_id string, html string, scraped_at timestamp")
    done, bad, counts = reparse_pages(pages, None)
    row = done.state.first()
    assert (row["doc_id"], row["url"], row["price_type"], row["image_urls"]) == ("bg_board:x1", "https://example.org/obiava-x1", "asking", ["u1", "u2"])
    assert [row[n] for n in ("has_elevator", "has_parking", "has_garage", "has_balcony", "has_furnishing", "has_garden")] == [1, 0, 1, 0, 0, 0]
    assert [r["page_id"] for r in bad.collect()] == [2]
    assert counts.first().asDict() == {"items_new": 1, "items_updated": 0, "parse_errors": 1}


def test_entry_and_registry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"flag", "n"} == set(rows[0].asDict())
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 140
    # the optional training-data part brings all of its queries or none
    assert sum(n == "pipeline" or n[:2] == "op" and n[2].isdigit() for n in queries) in (0, 14)


@pytest.mark.parametrize("name", ["market_stats", "mark_duplicates", "price_changes", "target_encode"])
def test_registered_query_matches_its_sql(spark, name):
    import duckdb

    from parcelgrid.checks.compare import compare
    from parcelgrid.testbed import BASE_TABLES
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text, _, good = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert good, text


def test_events_follow_changes(spark):
    path, out = fresh_path(spark, "s"), fresh_path(spark, "e")
    rows = [("a", dt.datetime(2026, 1, d), p, t) for d, p, t in ((1, 10.0, "x"), (2, 10.0, "x "), (3, 12.0, "x"), (4, None, "y"))]
    spark.createDataFrame(rows, "doc_id string, scraped_at timestamp, price_eur double, title string").write.parquet(path)
    stream = spark.readStream.schema("doc_id string, scraped_at timestamp, price_eur double, title string").parquet(path)
    S.run_available(S.stream_change_events(stream, ["price_eur", "title"]), f"{out}/d", f"{out}/c").awaitTermination()
    got = [(r["date"].day, r["event"]) for r in spark.read.parquet(f"{out}/d").orderBy("date").collect()]
    assert got == [(1, "created"), (3, "price_change"), (4, "content_change")]


def test_late_rows_are_kept_apart(spark):
    root = fresh_path(spark, "u")
    schema = "doc_id string, source string, country string, scraped_at timestamp, price_eur double"
    for n, (day, price) in enumerate(((5, 10.0), (3, 99.0))):
        spark.createDataFrame([("a", "s", "MT", dt.datetime(2026, 1, day), price)], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        S.stream_upsert(stream, root, f"{root}/checkpoint").awaitTermination()
    assert sinks.read_current(spark, f"{root}/state").first()["price_eur"] == 10.0
    assert spark.read.parquet(f"{root}/late").filter(F.col("price_eur") == 99.0).count() == 1


def test_a_batch_that_runs_again_gives_the_same_events(spark):
    root = fresh_path(spark, "again")
    schema = "doc_id string, source string, country string, scraped_at timestamp, price_eur double"

    def run():
        S.stream_upsert(spark.readStream.schema(schema).parquet(f"{root}/in"), root, f"{root}/checkpoint").awaitTermination()

    def outcome():
        events = spark.read.parquet(f"{root}/events").collect()
        return sorted((r["batch"], r["doc_id"], r["event"]) for r in events), sinks.read_current(spark, f"{root}/state").first()["price_eur"]

    for day, price in ((5, 10.0), (6, 11.0)):
        spark.createDataFrame([("a", "s", "MT", dt.datetime(2026, 1, day), price)], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        run()
    want = ([(0, "a", "created"), (1, "a", "price_change")], 11.0)
    assert outcome() == want
    for name in ("1", ".1.crc"):
        os.remove(f"{root}/checkpoint/commits/{name}")
    run()
    assert outcome() == want


def test_nested_blocks_belong_to_the_description(spark):
    from parcelgrid.operators import extract as E
    page = "<h1>t</h1><DIV class='moreInfo'>a<div>b<div>c</div></div> d <div>e</div></DIV><div>f</div>"
    rows = [(1, page), (2, "<h1>t</h1><div class='moreInfo'>open <div>x</div>"), (3, "<h1>t</h1>"), (4, None),
            (5, "<div class='moreInfo'>" + "<div>n</div>" * 50_000 + "</div><div>after</div>")]
    got = {r["page_id"]: r["description"] for r in E.extract_detail_fields(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("a b c d e", "open x", None, None)
    assert got[5].split() == ["n"] * 50_000


def test_rentals_on_one_point_are_reduced_before_the_search(spark):
    from parcelgrid.operators.spatial import similar_rentals
    schema = "doc_id string, lat double, lon double, rooms double, area_sqm double, condition double, price_eur double"
    rentals = [(f"r{i:05d}", 35.9, 14.5, 2.0, 80.0, 3.0, 500.0 + i) for i in range(5000)] + [("z", 35.91, 14.5, 2.0, 80.0, 3.0, 1.0)]
    sales = [("s1", 35.9, 14.5, 2.0, 80.0, 3.0, 1.0), ("s2", 35.9101, 14.5, 2.0, 81.0, 3.0, 1.0)]
    got = similar_rentals(spark.createDataFrame(sales, schema), spark.createDataFrame(rentals, schema)).collect()
    by_sale = {s: [r["rental_id"] for r in sorted((r for r in got if r["sale_id"] == s), key=lambda r: r["rank"])] for s in ("s1", "s2")}
    assert by_sale == {"s1": ["r00000", "r00001", "r00002"], "s2": ["z", "r00000", "r00001"]}


def test_documents_of_mixed_types_all_survive(spark, tmp_path):
    import json

    from parcelgrid.sources import collections as C
    rows = [{"_id": "a", "current": {"bedrooms": 2.0, "price_eur": 5}}, {"_id": "b", "current": {"price_eur": "12,000", "agent": {"name": "x"}}},
            {"_id": "c", "current": {"floor": "3", "is_active": 1}}, {"_id": "d", "current": {"title": 7, "amenities": ["lift"]}}, {"_id": "e"}]
    (tmp_path / "docs.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n[1]\n")
    docs = C.flatten_documents(C.read_collection(spark, str(tmp_path)))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert docs.count() == len(got) == 5
    assert (got["a"]["bedrooms"], got["a"]["price_eur"], got["b"]["price_eur"], got["c"]["floor"], got["d"]["title"]) == (2, 5.0, None, 3, "7")
    assert got["b"]["extra"] == {"agent": '{"name":"x"}'} and got["d"]["extra"] == {"amenities": '["lift"]'}
    assert C.corrupt_lines(spark, str(tmp_path)).count() == 2


def test_pages_with_very_many_tags(spark):
    from parcelgrid.operators import extract as E
    page = "<html><h1>t</h1><div class='adParams'><div>Площ: " + "<b>x</b>" * 100_000 + "</div></div><p>" + "word <br>" * 100_000 + "</p></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert E.extract_detail_fields(pages).count() == 1 and len(E.extract_detail_fields(pages).collect()) == 1
    assert len(E.extract_agency_detail(pages).collect()) == 1


def test_page_size_is_not_cut_silently(spark):
    import pytest

    from parcelgrid.operators.market import bbox_filter
    with pytest.raises(ValueError):
        bbox_filter(spark.range(1).toDF("id"), 0, 1, 0, 1, limit=501)


def test_large_tables_are_not_dealt_anew(spark, monkeypatch):
    """Files that Spark splits itself are read as they are; a small single file is spread."""
    from parcelgrid import testbed
    root = fresh_path(spark, "tables")
    spark.range(1000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{root}/orders.parquet")
    exchanges = lambda: testbed.base(spark, root, "orders")._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges() == 1
    monkeypatch.setattr(testbed, "SPREAD_BYTES", 100)
    assert exchanges() == 0 and testbed.base(spark, root, "orders").count() == 1000


def test_change_events_of_batches_equal_those_of_the_per_listing_state(spark):
    """Nulls, times that are missing, rows without an id and several rows of a listing in one batch, over two batches; no Python call per listing."""
    out = fresh_path(spark, "both")
    schema = "doc_id string, scraped_at timestamp, price_eur double, title string"
    day = lambda n: dt.datetime(2026, 1, n)
    batches = [[("a", day(1), 10.0, "x"), ("a", day(2), None, "y"), ("b", day(1), None, None), ("c", None, 5.0, None), ("c", day(3), 4.0, "z"), (None, day(1), 1.0, "n")],
               [("a", day(4), 11.0, "y"), ("b", day(4), 3.0, "t"), ("c", day(5), 5.0, " z "), ("d", day(5), 7.0, "w"), (None, day(6), 2.0, "n")]]
    got = {"states": [], "batches": []}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = lambda: spark.readStream.schema(schema).parquet(f"{out}/in")
        S.run_available(S.stream_change_events(stream(), ["price_eur", "title"]), f"{out}/s", f"{out}/sc").awaitTermination()
        S.stream_change_events(stream(), ["price_eur", "title"], f"{out}/b", f"{out}/bc").awaitTermination()
    for name, at in (("states", "s"), ("batches", "b")):
        got[name] = sorted(str((r["doc_id"], r["date"], r["event"], r["changes"] and sorted(r["changes"].items()))) for r in spark.read.parquet(f"{out}/{at}").collect())
    assert got["states"] == got["batches"] and len(got["batches"]) > 8
