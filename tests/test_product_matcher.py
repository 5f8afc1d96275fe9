"""The product matcher: steps, filters, saved models, and its blocking against all pairs."""

import random

from pyspark.sql import functions as F

from vouchlake.functions import columns
from vouchlake.operators import product_matcher as pm

SSO = "cpe:2.3:a:ibm:security_access_manager_for_enterprise_single_sign-on:8.2.2:*:*:*:*:*:*:*"
DICTIONARY = [
    (SSO, "IBM Security Access Manager For Enterprise Single Sign-On 8.2.2"),
    (SSO, None),
    ("cpe:2.3:a:ibm:security_key_lifecycle_manager:2.6.0.1:*:*:*:*:*:*:*", "IBM Security Key Lifecycle Manager 2.6.0.1"),
    ("cpe:2.3:a:ibm:db2:-:*:*:*:*:*:*:*", "IBM DB2 9"),
    ("cpe:2.3:a:ibm:websphere:-:*:*:*:*:*:*:*", "IBM WebSphere"),
    ("cpe:2.3:a:hp:printer_suite:4.1:sp1:*:*:*:*:*:*", "HP Printer Suite 4.1 SP1"),
    ("cpe:2.3:a:hp:printer_suite:4.1:sp3:*:*:*:*:*:*", "HP Printer Suite 4.1 SP3"),
    ("cpe:2.3:a:hp:printer_suite:4.1:*:*:*:*:*:windows:*", "HP Printer Suite 4.1"),
    ("cpe:2.3:a:hp:scanner_suite:-:*:*:*:*:*:*:*", None),
    ("cpe:2.3:o:microsoft:windows:-:*:*:*:*:*:x64:*", "Microsoft Windows on X64"),
    (None, "nothing"), ("", "nothing"),
]
PRODUCTS = [
    (1, "IBM Corporation", "IBM Security Access Manager for Enterprise Single Sign-On Version 8.2 with IMS Server"),
    (2, "Hewlett-Packard", "HP Printer Suite 4.1 Service Pack 2"),
    (3, "Hewlett-Packard", "HP Printer Suite 4.1"),
    (4, "IBM", "IBM DB2 9 for z/OS Version 12"),
    (5, "Microsoft", "Windows"),
    (6, None, "IBM DB2 9"), (7, "IBM", None), (8, "IBM, HP", "Printer Suite 4.1 SP1"), (8, "IBM, HP", "Printer Suite 4.1 SP1"), (9, "unknown", "x"),
]


def tables(spark):
    products = spark.createDataFrame([(*p, "clash") for p in PRODUCTS], "key long, vendor string, name string, uri string")
    return spark.createDataFrame(DICTIONARY, "uri string, title string"), products.withColumn("versions", columns.versions(F.col("name")))


def test_steps_and_filters(spark, tmp_path):
    dictionary, products = tables(spark)
    model = pm.ProductMatcher().fit(dictionary)
    got = {(r["key"], r["uri"].split(":", 4)[4].split(":*")[0]): (r["score"], r["step"]) for r in model.predict(products).collect()}
    assert got[1, SSO.split(":", 4)[4].split(":*")[0]][1] == 1
    assert (2, "printer_suite:4.1:sp3") in got and (2, "printer_suite:4.1:sp1") not in got
    assert {k for k in got if k[0] == 3} == {(3, "printer_suite:4.1:sp1"), (3, "printer_suite:4.1:sp3")}  # the third is bound to a platform
    assert (8, "printer_suite:4.1:sp1") in got and not any(k[0] in (4, 5, 6, 7, 9) for k in got)
    path = f"file://{tmp_path}/model"
    model.save(path)
    again = pm.ProductMatcherModel.load(spark, path)
    assert sorted(again.predict(products).collect()) == sorted(model.predict(products).collect())
    rows = {r["key"]: r["matches"] for r in again.transform(products).collect()}
    assert rows[1] == [SSO] and rows[5] is None and len(rows) == 9
    one = pm.ProductMatcher(threshold=100.0, most=1).fit(dictionary)
    assert one.predict(products).groupBy("key").count().where("count > 1").isEmpty()


def test_empty_tables(spark):
    dictionary, products = tables(spark)
    assert pm.ProductMatcher().fit(dictionary.limit(0)).predict(products).count() == 0
    assert pm.ProductMatcher().fit(dictionary).predict(products.limit(0)).count() == 0


def test_entries_without_a_version_are_met_as_by_all_pairs(spark):
    rng = random.Random(4)
    some = ["alpha", "beta", "alphabet", "ta", "et", "big", "ip", "cards", "card", "x"]
    pick = lambda least, most: " ".join(rng.choice(some) for _ in range(rng.randint(least, most)))
    entries = [(f"cpe:2.3:a:acme:{pick(1, 2).replace(' ', '_')}_{i % 3}:-:*:*:*:*:*:*:*", rng.choice([None, pick(1, 3) + " 1"])) for i in range(60)]
    products = [(i, "acme", pick(1, 4)) for i in range(60)]
    table = spark.createDataFrame(products, "key long, vendor string, name string").withColumn("versions", F.array(F.lit("77")))
    model = pm.ProductMatcher(most=1000).fit(spark.createDataFrame(entries, "uri string, title string"))
    got = {(r["key"], r["uri"]) for r in model.predict(table).collect()}
    free = pm._wanted(table).drop("vendor", "versions").crossJoin(model.items)
    want = {(r["key"], r["uri"]) for r in free.where(pm._exact("loose") | pm._bare()).select("key", "uri").collect()}
    assert got == want and len(want) > 50


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_before_they_are_read(spark):
    dictionary, products = tables(spark)
    for df, key in ((pm.dictionary_items(dictionary), "uri"), (pm._wanted(products), "key")):
        lines = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
        assert len(lines) == 1 and f"({key}#" in lines[0] and f", {pm.PARTS})" in lines[0]


def test_the_first_steps_meet_entries_once(spark):
    dictionary, products = tables(spark)
    items, asked = pm.dictionary_items(dictionary), pm._wanted(products)
    makers = spark.createDataFrame([(1, "ibm"), (2, "hp")], "key long, vendor string")
    got = pm._by_version(asked, makers, items.select("vendor", "version").distinct(), items, 92.0)
    assert plan(got).count("ArrowEvalPython") == 1
    assert got.where("step = 2").select("key", "uri").distinct().count() == got.where("step = 2").count() > 0


def test_stretches_are_cut_only_in_lengths_that_keys_have(spark):
    df = spark.createDataFrame([("abcde xy", [2, 4]), ("abc", [])], "t string, sizes array<int>")
    got = [sorted(r[0]) for r in df.select(pm._grams(["t"], F.col("sizes"))).collect()]
    assert got == [["ab", "abcd", "bc", "bcde", "cd", "de", "xy"], []]
    # texts of short words alone are still met
    dictionary = spark.createDataFrame([("cpe:2.3:a:ibm:ab_c_1:-:*:*:*:*:*:*:*", "ab c 1"), ("cpe:2.3:a:ibm:websphere:-:*:*:*:*:*:*:*", "IBM WebSphere 2")], "uri string, title string")
    products = spark.createDataFrame([(1, "IBM", "the ab c 1 set"), (2, "IBM", "c 1 ab")], "key long, vendor string, name string").withColumn("versions", columns.versions(F.col("name")))
    found = pm.ProductMatcher().fit(dictionary).predict(products)
    assert sorted((r.key, r.uri.split(":")[4], r.step) for r in found.collect()) == [(1, "ab_c_1", 3), (2, "ab_c_1", 3)]
