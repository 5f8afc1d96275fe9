"""Readers, sinks, vulnerability lookups and scores on small hand-made inputs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vouchlake.functions import columns as C
from vouchlake.operators import graph, matching, vulnerabilities
from vouchlake.sources import readers, sinks
from vouchlake.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_products_csv(spark, tmp_path):
    head = ",".join(f"h{i}" for i in range(14))
    row = "Cat,{n},Maker,DE,EAL4,,{d},05/01/2027,http://a/r.pdf,http://a/s.pdf,{m}"
    (tmp_path / "a.csv").write_text("\n".join([head, row.format(n="P", d="05/01/2020", m=",,,"), row.format(n="P", d="", m="06/01/2021,Fix,r,s"), "bad,row"]))
    (tmp_path / "b.csv").write_text("\n".join([head, row.format(n="P", d="2022-03-04", m=",,,")]))
    base, updates = readers.products_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [r["not_valid_before"] for r in base.collect()] == [date(2022, 3, 4)]
    assert [(r["maintenance_title"], r["maintenance_date"]) for r in updates.collect()] == [("Fix", date(2021, 6, 1))]


def test_encoding_of(spark, tmp_path):
    head, row = ",".join(f"h{i}" for i in range(14)), "Cat,Caf\u00e9 \u201320\u20ac,M,DE,EAL4,,,,r,s,,,,"
    for name, code in (("a", "utf-8"), ("b", "windows-1252")):
        (tmp_path / f"{name}.csv").write_bytes(f"{head}\n{row}\n".encode(code))
        assert readers.encoding_of(spark, str(tmp_path / f"{name}.csv")) == ("UTF-8" if name == "a" else "windows-1252")
        base, _ = readers.products_csv(spark, [str(tmp_path / f"{name}.csv")])
        assert [r["name"] for r in base.collect()] == ["Caf\u00e9 \u201320\u20ac"]


def test_html_tables_and_fill_down(spark):
    page = "<table id='t'><tr><th>V</th></tr><tr><td>A &amp; B<a href='/x'>l</a><td>1</tr><tr><td></td><td>2</td></tr></table>"
    rows = readers.html_table_rows(spark.createDataFrame([("p", page), ("q", None)], "k string, h string"), "k", "h")
    got = {r["row"]: (r["table_id"], r["cells"], r["links"]) for r in rows.collect()}
    assert got == {0: ("t", ["V"], []), 1: ("t", ["A & Bl", "1"], ["/x"]), 2: ("t", ["", "2"], [])}
    filled = readers.fill_down(rows.where("row > 0").select("key", "row", F.col("cells")[0].alias("v")), ["v"], "key", "row")
    assert {r["v_filled"] for r in filled.collect()} == {"A & Bl"}


def test_dumps(spark, tmp_path):
    (tmp_path / "queue_undated.html").write_text("x")
    (tmp_path / "queue_2021-02-19T06+0100.html").write_text("y")
    got = {r["content"]: r["taken_at"] is not None for r in readers.dumps(spark, str(tmp_path)).collect()}
    assert got == {"x": False, "y": True}


def test_feeds_lookup_and_validity(spark, tmp_path):
    metric = [{"source": "nvd", "type": "Secondary", "cvssData": {"version": "3.1", "baseScore": 5.0, "baseSeverity": "LOW"}}, {"source": "o", "type": "Primary", "cvssData": {"version": "3.1", "baseScore": 9.0, "baseSeverity": "HIGH"}}]
    node = lambda *ids: {"operator": "OR", "cpeMatch": [{"vulnerable": True, "matchCriteriaId": i} for i in ids]}
    cve = lambda i, conf, status="Analyzed", **k: {"cve": {"id": i, "vulnStatus": status, "published": "2021-01-01T00:00:00", "configurations": conf, **k}}
    (tmp_path / "cve.json").write_text(json.dumps({"vulnerabilities": [
        cve("C1", [{"nodes": [node("A")]}], metrics={"cvssMetricV31": metric}, weaknesses=[{"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-Other"}]}]),
        cve("C5", [{"nodes": [node("A"), node("B")]}]), cve("C6", [{"nodes": [{"cpeMatch": [{"vulnerable": False, "matchCriteriaId": "B"}]}]}]),
        cve("C2", [{"operator": "AND", "nodes": [node("A"), node("B", "X")]}]), cve("C3", [{"operator": "AND", "nodes": [node("A"), node("Z")]}]), cve("C4", [{"nodes": [node("A")]}], "Rejected"),
    ]}))
    m = lambda i, uri, status="Active": {"matchString": {"criteria": i, "matchCriteriaId": i, "status": status, "matches": [{"cpeName": uri}] if uri else []}}
    (tmp_path / "match.json").write_text(json.dumps({"matchStrings": [m("A", "ua"), m("B", "ub"), m("Z", "ua", "Inactive"), m("X", None)]}))
    cves, matches = readers.cve_feed(spark, str(tmp_path / "cve.json")), readers.match_feed(spark, str(tmp_path / "match.json"))
    assert {(r["cve_id"], r["cvss"]["base_score"], r["cvss"]["severity"]) for r in cves.collect()} == {("C1", 9.0, "HIGH"), ("C2", 0.0, "UNKNOWN"), ("C3", 0.0, "UNKNOWN"), ("C5", 0.0, "UNKNOWN"), ("C6", 0.0, "UNKNOWN")}
    certs = spark.createDataFrame([("d1", ["ua", "ub"], date(2020, 1, 1), date(2022, 1, 1)), ("d2", ["ua"], date(2021, 6, 1), date(2022, 1, 1)), ("d3", None, None, None)], "dgst string, uris array<string>, valid_from date, valid_to date")
    pairs = vulnerabilities.related_cves(certs, cves, matches)
    assert {tuple(r) for r in pairs.collect()} == {("d1", "C1"), ("d1", "C2"), ("d1", "C5"), ("d1", "C6"), ("d2", "C1")}
    assert {tuple(r) for r in vulnerabilities.within_validity(pairs, certs, cves).collect()} == {("d1", "C1"), ("d1", "C2"), ("d1", "C5"), ("d1", "C6")}
    assert {r["cwe_id"] for r in vulnerabilities.weaknesses(pairs, cves).collect()} == {"CWE-79"}


def test_dictionary_upsert_and_catalogue(spark, tmp_path):
    p = lambda i, t, gone: {"cpe": {"deprecated": gone, "cpeName": f"cpe:{i}", "cpeNameId": i, "titles": [{"title": "x", "lang": "ja"}, {"title": t, "lang": "en"}], "lastModified": "2024-01-01T00:00:00"}}
    (tmp_path / "c.json").write_text(json.dumps({"products": [p("1", "new", False), p("2", "off", True)]}))
    fresh = readers.cpe_feed(spark, str(tmp_path / "c.json"))
    held = fresh.withColumn("title", F.lit("old")).withColumn("deprecated", F.lit(False))
    assert [(r["cpe_id"], r["title"]) for r in readers.upsert(held, fresh, "cpe_id", "deprecated").collect()] == [("1", "new")]
    assert readers.high_water_mark(held, F.lit("2024-02-01").cast("timestamp"))[1] is False
    assert readers.high_water_mark(held.limit(0))[1] is True
    (tmp_path / "w.xml").write_text('<C><Weakness ID="79" Name="X"><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="74"/><Related_Weakness Nature="PeerOf" CWE_ID="1"/></Related_Weaknesses></Weakness><Weakness ID="74" Name="Y"/></C>')
    assert {r["cwe_id"]: r["parents"] for r in readers.weakness_catalogue(spark, str(tmp_path / "w.xml")).collect()} == {"CWE-79": ["CWE-74"], "CWE-74": []}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["b", "a"], None)], "id long, names array<string>, x string")
    sinks.to_json(df, str(tmp_path / "j"), True, "Thing")
    assert spark.read.json(str(tmp_path / "j")).first()["_type"] == "Thing"
    sinks.to_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["names"] == "a;b"
    assert sinks.dot_lines(spark.createDataFrame([("a", 'b"')], "src string, dst string")).first()["value"] == '"a" -> "b\\"";'
    with pytest.raises(ValueError, match="x"):
        sinks.check_schema(df, StructType([StructField("id", LongType()), StructField("x", LongType()), StructField("z", StringType())]))


def test_columns(spark):
    stamp = F.date_format(F.to_utc_timestamp(C.pdf_date(F.lit("D:20200102030405+01'00'")), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, stamp) == "2020-01-02 02:04:05"
    assert one(spark, C.pdf_date(F.lit("no"))) is None
    assert one(spark, C.plain_contact(F.lit("a [at] b [dot] c"))) == "a@b.c"
    assert tuple(one(spark, C.type_and_number(F.lit("HMAC DRBG 12")))) == ("HMAC DRBG", "12")
    assert [one(spark, C.type_and_number(F.lit(s))) for s in ("", "123", "AES", "!!!", "  456  ")] == [None] * 5
    assert one(spark, C.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    fits = lambda *a: one(spark, C.platform_fits(*map(F.lit, a)))
    assert fits("x", "*", "any") and not fits("x", "windows", "any")
    assert fits("x for Linux", "*", "y linux") and not fits("x for Linux", "*", "y")
    assert fits("x for Linux", "linux", "y") and not fits("x for Linux", "windows", "y linux") and fits("x for Linux", "x86", "y linux")


def test_scores(spark):
    cols = ["scheme", "cert_id", "canonical_id", "product", "vendor", "category", "report_hash", "target_hash", "level", "valid_from"]
    base = dict(scheme="DE", cert_id=None, canonical_id=None, product="card one", vendor="maker", category=None, report_hash=None, target_hash=None, level=None, valid_from=None)

    def score(e, c):
        sides = [(f"{s}_{k}", {**base, **v}[k]) for s, v in (("e", e), ("c", c)) for k in cols]
        kinds = [f"{n} {'date' if n.endswith('valid_from') else 'string'}" for n, _ in sides]
        return spark.createDataFrame([tuple(v for _, v in sides)], ", ".join(kinds)).select(matching.scheme_score("e", "c").alias("s")).first()["s"]

    assert score({"scheme": "FR"}, {}) == 0
    assert score({"canonical_id": "i", "product": None}, {"cert_id": "i"}) == 100
    assert score({}, {}) == 99
    assert score({"report_hash": "r"}, {"report_hash": "r", "product": "q"}) == 95
    assert score({"product": None}, {}) == 0
    assert score({}, {"product": "Card One", "vendor": "Maker"}) == 98
    assert score({"valid_from": date(2020, 1, 2)}, {"product": "Card One", "vendor": "Maker", "valid_from": date(2020, 1, 3)}) == pytest.approx((1200 + 2 * 67) / 14 - 2)
    q = spark.createDataFrame([("140-2", "a b", "v", date(2020, 1, 1), "140-2", "A B", "V", [date(2021, 1, 1)]), ("140-2", "a b", "v", date(2020, 1, 1), "140-2", "A B", "V", [date(2019, 1, 1)])], "e_standard string, e_product string, e_vendor string, e_date date, c_standard string, c_product string, c_vendor string, c_validations array<date>")
    assert [r["s"] for r in q.select(matching.queue_score("e", "c").alias("s")).collect()] == [99, 0]


def test_keywords_and_tfidf(spark):
    d = spark.createDataFrame([(1, "EAL3, AES AES\nCBC."), (2, None), (3, "xAES")], "doc_id long, text string")
    got = {(r["key"], r["match"], r["n"]) for r in vulnerabilities.keyword_counts(d, [("l.eal", "EAL[1-7]"), ("c.sym", "AES|CBC")]).collect()}
    # the blank between the two is taken by the first
    assert got == {(1, "EAL3", 1), (1, "AES", 1), (1, "CBC", 1)}
    rows = vulnerabilities.tfidf(d).groupBy("key").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r["key"] for r in rows} == {1, 3} and all(abs(r["s"] - 1) < 1e-9 for r in rows)


def test_graph_rounds(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 4), (7, 6), (6, 7)], "src long, dst long")
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)}
    assert {tuple(r) for r in graph.hops_to(edges, 1).collect()} == {(1, 0), (2, 1), (3, 2)}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 12)] + [(5, 100), (50, 51), (51, 50)], "node long, parent long")
    want = {(i, 0) for i in range(1, 12)} | {(i, 100) for i in range(5, 12)}
    assert {tuple(r) for r in graph.top_parents(chain).collect()} == want


def test_flows_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").dropDuplicates(["user_id", "ts"])
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = flows.state_flows(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("flows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = flows.state_flows(events)
    assert spark.table("flows").exceptAll(batch).count() == 0 and spark.table("flows").count() == batch.count() > 0
