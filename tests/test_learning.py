"""Classifiers, projection, splits and the small readers, on small inputs."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from vouchlake.functions import cert_ids
from vouchlake.functions import columns as C
from vouchlake.operators import assurance, learning
from vouchlake.sources import readers, sinks


def rows(n=240):
    rnd = random.Random(2)
    return [(i, rnd.gauss(i % 2 * 2.0, 1), rnd.gauss(0, 3), i % 2) for i in range(n)]


def test_trees_beat_the_baseline(spark):
    df = spark.createDataFrame(rows(), "id long, f_a double, f_b double, y int")
    features = learning.chosen(df, ("f_",))
    assert features == ["f_a", "f_b"] and learning.baseline(df, "y") == 0
    got = learning.predicted(learning.train(df, features, "y", rounds=5), df)
    assert got.where("prediction = y").count() > 180 and got.where("p < 0 or p > 1").count() == 0
    _, f1 = learning.searched(df, features, "y", (2,), (0.3,), 2)
    assert f1 > 0.6


def test_projection_keeps_the_variance(spark):
    df = spark.createDataFrame(rows(), "id long, f_a double, f_b double, y int")
    got = np.array([r["pca"].toArray() for r in learning.projected(df, ["f_a", "f_b"]).orderBy("id").collect()])
    x = np.array([(a, b) for _, a, b, _ in rows()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(np.sort(got.var(0, ddof=1)), np.sort(np.linalg.eigvalsh(np.cov(z.T))))


def test_split_shares(spark):
    df = spark.range(104).selectExpr("id", "if(id < 100, 'a', 'b') AS kind")
    got = {(r["kind"], r["part"]): r["count"] for r in learning.split(df, ["kind"], "id").groupBy("kind", "part").count().collect()}
    assert got == {("a", "train"): 30, ("a", "valid"): 20, ("a", "test"): 50, ("b", "test"): 4}
    odd = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(40)], "id long, kind string")
    cut = learning.split(odd, ["kind"], "id").withColumn("h", F.xxhash64("id")).toPandas()
    for _, group in cut.groupby("kind", dropna=False):
        assert group.sort_values("h")["part"].tolist() == ["train"] * 6 + ["valid"] * 4 + ["test"] * 10


def test_readers(spark, tmp_path):
    sinks.to_json(spark.createDataFrame([(1, "x"), (2, None)], "id long, name string"), str(tmp_path / "j"), True, "Thing")
    assert sorted(tuple(r) for r in readers.tagged_json(spark, str(tmp_path / "j"), "Thing", "id long, name string").collect()) == [(1, "x"), (2, None)]
    assert readers.tagged_json(spark, str(tmp_path / "j"), "Other").count() == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    assert [(r["bytes"], r["sha256"]) for r in readers.file_digests(spark, str(tmp_path / "f")).collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]
    page = '<a href="/certificate/9">no</a><table id="searchResultsTable"><a href="/certificate/12">12</a><a href="/certificate/12">12</a></table>'
    assert [r["cert_id"] for r in readers.listed_numbers(spark.createDataFrame([(page,), (None,)], "h string"), "h").collect()] == ["12"]
    (tmp_path / "w.xml").write_text('<C><Category ID="8" Name="K"><Relationships><Has_Member CWE_ID="79" View_ID="1"/></Relationships></Category></C>')
    assert [(r["category_id"], r["members"]) for r in readers.weakness_categories(spark, str(tmp_path / "w.xml")).collect()] == [("CWE-8", ["CWE-79"])]


def test_ids_and_rules(spark):
    ids = [("ANSSI-CC-PP-2014/16-M01", "FR", "ANSSI-CC-PP-2014/16-M01"), ("Rapport de certification 2001/02v2", "FR", "ANSSI-CC-2001/02v2"), ("NSCIB-CC-98209", "NL", "NSCIB-CC-98209-CR"), ("522 EWA 2020", "CA", "522-EWA-2020"), ("383-4-123P", "CA", "383-4-123"), ("CERTIFICATION REPORT No. P123A", "UK", "CRP123A"), ("2006-4-INF-98 v2", "ES", "2006-4-INF-98"), ("Certification No. C0090", "JP", "JISEC-CC-CRP-C0090"), ("ISCB-5-RPT-C046-CR-V1a", "MY", "ISCB-5-RPT-C046-CR-v1a"), ("OCSI/CERT/SYS/04/2018/RC", "IT", "OCSI/CERT/SYS/04/2018/RC"), ("IC3S/KOL01/ADVA/EAL2/0520/0021/CR", "IN", "IC3S/KOL01/ADVA/EAL2/0520/0021"), ("CCEVS-VR-04-0082", "US", "CCEVS-VR-0082-2004"), ("SERTIT-7", "NO", "SERTIT-007"), ("1/PC1/AC223/2022", "PL", "1/PC1/AC223/2022"), ("SERTIT-7", "DE", "SERTIT-7"), (None, "DE", None)]
    got = spark.createDataFrame(ids, "raw string, scheme string, want string").select("want", cert_ids.canonical(F.col("raw"), F.col("scheme")).alias("got")).collect()
    assert [(r["want"], r["got"]) for r in got if r["want"] != r["got"]] == []
    rules = assurance.flat_rules({"a": {"b": ["x", "y"], "c": []}, "ab": ["z"]})
    assert rules == [("a.b", "x"), ("a.b", "y"), ("ab", "z")] and assurance.subset(rules, "a") == rules[:2]


def test_more_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(C.long_sentences(F.array(F.lit("x" * 24), F.lit("x" * 25)), F.array(F.lit("abcde"), F.lit("longer one")))) == ["x" * 25]
    assert one(C.module_type(F.lit("hARDware"))) == "Hardware"
    assert one(C.html_plain(F.lit(" a­b  c\n"))) == "ab c" and one(C.match_plain(F.lit("AES-128,  x)."))) == "AES-128, x"
    assert (one(C.service_pack(F.lit("OS SP3 service pack 2"))), one(C.release(F.lit("v1"))), one(C.release(F.lit("Release 12")))) == (2, None, 12)
    assert one(C.is_composite(F.lit("A Composite Product Evaluation."))) is True and one(C.is_composite(F.lit(None).cast("string"))) is False


def test_reports_of_odd_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), (None, "a"), ("b", None)], "y string, g string")
    counts = learning.crosstab(df, "y", "g", {"c": "a"})
    got = {r.label: (r.prec, r.rec, r.f1, r.support) for r in learning.report(counts).collect()}
    assert got == {"a": (1.0, 1 / 3, 0.5, 3), "b": (0.0, 0.0, 0.0, 0)}
    one = learning.weighted_f1(learning.report(counts)).first()
    assert (one.f1, one.balanced_accuracy, one.accuracy) == (0.5, 1 / 3, 1 / 3)
    assert learning.report(learning.crosstab(df.limit(0), "y", "g")).count() == 0


def test_texts_without_packages(spark):
    rows = [(None,), ("",), ("EAL4 ALC_FLR.1 EAL4 ADV_IMP",)]
    d = spark.createDataFrame(rows, "t string").select(C.packages(F.col("t")), C.first_level(F.col("t")), C.first_link(F.col("t")), C.front_page(F.col("t"), [("(EAL.)", {"x": 1})]).x)
    assert [tuple(r) for r in d.collect()] == [(None, "", "", None), ({}, "", "", None), ({"EAL4": ["ADV_IMP"]}, "EAL4", "", "EAL4")]
