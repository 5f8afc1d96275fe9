"""Literals of patterns, and counts of many rules against a pass a rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vouchlake.operators import patterns, vulnerabilities

E = patterns.EDGE


@pytest.mark.parametrize(("pattern", "literals"), [
    ("AES", {f"{E}aes{E}"}), ("(?i)Triple-?DES", {f"{E}triple"}), ("(?:RSA|ECC)-?[0-9]+", {"rsa", "ecc"}), ("EAL[1-7]\\+?", {f"{E}eal"}),
    ("[A-Z]{3}", None), ("x?", None), ("a|[0-9]", None), ("(?<name>x)", None), ("\\Qa.b\\E", None), ("two words", {f"{E}two{E}words{E}"}), ("(?:ab){2,}c*", {"ab"}),
])
def test_literals_that_every_match_holds(pattern, literals):
    assert patterns.required_literals(pattern) == (literals and frozenset(literals))


RULES = [
    ("a.aes", "AES"), ("a.des", "(?i)triple-?des"), ("a.any", "[A-Z]{3}[0-9]"), ("b.id", "BSI-DSZ-CC-[0-9]{4}(?:-V[0-9])?"), ("b.two", "two words"), ("b.q", "\\Qa+b\\E"),
    ("c.alt", "(?:RSA|ECC)-?[0-9]+"), ("c.same", "AES"), ("c.opt", "x?yz"), ("c.uni", "straße"), ("c.kelvin", "(?i)kelvin"),
]
WORDS = ["AES", "aes", "Triple-DES", "tripledes", "ABC1", "BSI-DSZ-CC-0683-V2", "two", "words", "a+b", "RSA2048", "ECC-256", "xyz", "yz", "straße", "STRASSE", "Kelvin", "\n", "\r\n", ".", ",", "(", ")", "”"]


def test_counts_are_those_of_a_pass_for_each_rule(spark):
    rng = random.Random(2)
    texts = [None, "", "AES", "AES AES AES", "AES "] + ["".join(rng.choice(WORDS) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, body string, rule string")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\\r?\\n", " ")
    one = [docs.select(F.col("doc_id").alias("key"), F.lit(path).alias("path"), F.explode(patterns.matches(body, F.lit(p))).alias("match")) for path, p in RULES]
    every = one[0]
    for df in one[1:]:
        every = every.union(df)
    want = sorted(map(tuple, every.groupBy("key", "path", F.trim("match")).count().collect()))
    assert sorted(map(tuple, vulnerabilities.keyword_counts(docs, RULES).collect())) == want and len(want) > 300
    assert vulnerabilities.keyword_counts(docs.limit(0), RULES).count() == 0
    assert vulnerabilities.keyword_counts(docs, []).count() == 0


def test_few_rules_are_chosen(spark):
    rules = [f"term{i:04d}" for i in range(911)]
    pick = patterns.promising(rules)
    row = spark.createDataFrame([("about term0007, term0500 and xterm0008",)], "t string").select(pick(F.col("t")).alias("r")).first()
    assert row["r"] == [7, 500] and all(re.fullmatch(r, r) for r in rules)


def test_keyword_counts_hold_few_texts_at_once(spark):
    """Whatever the session had, Python gets whole texts in batches of at most 512, and of about 16 MB."""
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")]
    for name in names:
        spark.conf.unset(name)
    vulnerabilities.keyword_counts(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), [("p", "b")])
    assert [int(spark.conf.get(name)) for name in names] == [512, 16 << 20]
