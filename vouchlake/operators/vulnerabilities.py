"""Products to vulnerabilities: exact and configured matches, weaknesses, validity.

Inputs are the readers' tables: cves (cve_id, criteria, configurations, cwe_ids,
published), matches (criteria_id, uris), and certs (dgst, uris, valid_from,
valid_to). Nulls match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlake.llm.scratch import small_batches
from vouchlake.operators import patterns
from vouchlake.staging import cut

#: Parts that certificates are dealt in, and the names of configurations that are sent to each of them at most.
PARTS, FEW = 200, 20_000


def uri_of_criteria(matches: DataFrame, used: DataFrame) -> DataFrame:
    """(criteria_id, uri) of the product names in use; the feed is cut down before any join."""
    every = matches.select("criteria_id", F.explode("uris").alias("uri"))
    return every.join(used.select("uri").distinct(), "uri", "left_semi").distinct()


def exact_lookup(cves: DataFrame, lookup: DataFrame) -> DataFrame:
    """(uri, cve_id): names that a vulnerability's plain criteria cover."""
    return cves.select("cve_id", F.explode("criteria").alias("criteria_id")).join(lookup, "criteria_id").select("uri", "cve_id").distinct()


def _names(certs: DataFrame) -> DataFrame:
    """(dgst, uris) with a row for each certificate that has names, dealt by certificate."""
    return certs.select("dgst", F.explode("uris").alias("uri")).repartition(PARTS, "dgst").groupBy("dgst").agg(F.collect_set("uri").alias("uris"))


def configured(certs: DataFrame, cves: DataFrame, lookup: DataFrame) -> DataFrame:
    """(dgst, cve_id): every component of some configuration is met by one of the certificate's names."""
    return _configured(_names(certs), cves, lookup)


def _configured(names: DataFrame, cves: DataFrame, lookup: DataFrame) -> DataFrame:
    """As `configured`, of one row a certificate.

    A name that meets the component with the fewest names brings the configuration to its
    certificate; the other components are looked up in the certificate's own names.
    """
    parts = cves.select("cve_id", F.posexplode("configurations").alias("conf", "parts")).select("cve_id", "conf", F.size("parts").alias("asked"), F.posexplode("parts").alias("part", "any_of"))
    wanted = parts.select("cve_id", "conf", "asked", "part", F.explode("any_of").alias("criteria_id")).join(lookup, "criteria_id")
    each = wanted.groupBy("cve_id", "conf", "asked", "part").agg(F.collect_set("uri").alias("any_of"))
    whole = each.groupBy("cve_id", "conf", "asked").agg(F.array_sort(F.collect_list(F.struct(F.size("any_of").alias("n"), "any_of"))).alias("parts")).where(F.size("parts") == F.col("asked"))
    lead = cut(whole.select("cve_id", F.col("parts.any_of").alias("parts"), F.explode(F.col("parts")[0]["any_of"]).alias("uri")))
    few = lead.limit(FEW + 1).count() <= FEW
    have = names.select("dgst", "uris", F.explode("uris").alias("uri"))
    met = have.join(F.broadcast(lead) if few else lead, "uri").where(F.forall("parts", lambda p: F.arrays_overlap(p, F.col("uris"))))
    return met.select("dgst", "cve_id").distinct()


def related_cves(certs: DataFrame, cves: DataFrame, matches: DataFrame) -> DataFrame:
    """(dgst, cve_id) by exact match or configuration."""
    names = cut(_names(certs))
    have = names.select("dgst", F.explode("uris").alias("uri"))
    lookup = cut(uri_of_criteria(matches, have))
    direct = have.join(exact_lookup(cves, lookup), "uri").select("dgst", "cve_id")
    return direct.union(_configured(names, cves, lookup)).repartition(PARTS, "dgst").distinct()


def within_validity(pairs: DataFrame, certs: DataFrame, cves: DataFrame) -> DataFrame:
    """The pairs whose vulnerability was published on a day strictly inside the
    certificate's validity. A certificate without both ends is an error."""
    dated = pairs.join(certs.select("dgst", "valid_from", "valid_to"), "dgst").join(cves.select("cve_id", "published"), "cve_id")
    day, start, end = (F.col(c).cast("date") for c in ("published", "valid_from", "valid_to"))
    missing = F.raise_error(F.concat(F.lit("no validity: "), "dgst")).cast("boolean")
    return dated.where(F.when(start.isNull() | end.isNull(), missing).otherwise((start < day) & (day < end))).select("dgst", "cve_id")


def weaknesses(pairs: DataFrame, cves: DataFrame) -> DataFrame:
    """(dgst, cve_id, cwe_id); the database's own placeholders count as no weakness."""
    w = cves.select("cve_id", F.explode("cwe_ids").alias("cwe_id")).where("cwe_id not like 'NVD-CWE-%'")
    return pairs.join(w, "cve_id").select("dgst", "cve_id", "cwe_id")


def keyword_counts(docs: DataFrame, rules: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, path, match, n): how often each rule's matches stand between separators.

    `rules` are (dotted path, pattern), Java expressions. Line ends count as spaces; a
    separator belongs to one match only. A text is read once for all rules and then once
    for each rule that can match there (patterns.promising). Null texts have no matches.
    """
    if not rules:
        return docs.select(F.col(key).alias("key"), F.lit("").alias("path"), F.lit("").alias("match"), F.lit(0).cast("long").alias("n")).limit(0)
    small_batches(docs.sparkSession)  # whole texts
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\r?\\n", " ")
    texts = docs.select(F.col(key).alias("key"), body.alias("body"))
    each = texts.select("key", "body", F.explode(patterns.promising([p for _, p in rules])(F.col("body"))).alias("rule"))
    named = lambda at: F.get(F.array(*[F.lit(r[at]) for r in rules]), F.col("rule"))
    hits = each.select("key", named(0).alias("path"), F.explode(patterns.matches(F.col("body"), named(1))).alias("match"))
    return hits.groupBy("key", "path", F.trim("match").alias("match")).agg(F.count("*").alias("n"))


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 1) -> DataFrame:
    """(key, term, weight): smoothed inverse frequency ln((1 + n) / (1 + df)) + 1, rows of length one."""
    terms = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))).alias("term"))
    tf = terms.groupBy("key", "term").agg(F.count("*").alias("tf"))
    total = docs.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_docs)
    raw = tf.join(df, "term").select("key", "term", (F.col("tf") * (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("weight"))
