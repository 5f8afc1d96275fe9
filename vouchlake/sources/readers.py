"""Readers: register CSV and HTML tables, paged feeds, catalogues, dumps, labels.

All take paths (a folder, a file or a glob) and stay distributed: HTML and dumps
are read as whole files by executors, feeds as JSON with a declared schema.
Malformed rows are dropped or kept as null by the mode each docstring names.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The canonical columns of the products CSV, by position.
PRODUCT_COLUMNS = [
    "category", "name", "manufacturer", "scheme", "security_level", "protection_profiles", "not_valid_before",
    "not_valid_after", "report_link", "st_link", "maintenance_date", "maintenance_title", "maintenance_report_link", "maintenance_st_link",
]

#: Feed states of vulnerabilities that are taken over.
TAKEN_STATES = ["Analyzed", "Modified", "Deferred"]


def encoding_of(spark: SparkSession, path: str, otherwise: str = "windows-1252") -> str:
    """UTF-8, or `otherwise` where some file of the path is no valid UTF-8."""
    bad = spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string")))
    return "UTF-8" if bad.isEmpty() else otherwise


def products_csv(spark: SparkSession, paths: list[str], encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, maintenance updates); a later path wins where products share a key.

    Without an encoding, each path is read by `encoding_of`. Columns are taken by position, rows with another column count are dropped,
    dates that do not parse are null.
    """
    schema = ", ".join(f"{c} string" for c in PRODUCT_COLUMNS)
    # Spark's CSV knows no windows-1252: its signs where iso-8859-1 has control characters are put in afterwards
    signs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    odd, right = "".join(a for a, b in signs if b), "".join(b for _, b in signs)
    read = []
    for i, p in enumerate(paths):
        code = encoding or encoding_of(spark, p)
        west = code.lower() in ("windows-1252", "cp1252")
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "DROPMALFORMED").option("encoding", "iso-8859-1" if west else code).option("multiLine", True).option("escape", '"').csv(p)
        rows = rows.select(*[F.translate(c, odd, right).alias(c) for c in PRODUCT_COLUMNS]) if west else rows
        read.append(rows.withColumn("source_order", F.lit(i)))
    rows = read[0]
    for more in read[1:]:
        rows = rows.unionByName(more)
    for c in ("not_valid_before", "not_valid_after", "maintenance_date"):
        rows = rows.withColumn(c, F.coalesce(F.try_to_date(c, "MM/dd/yyyy"), F.try_to_date(c, "yyyy-MM-dd")))
    key = product_key(F.col("category"), F.col("name"), F.col("report_link"), F.col("st_link"))
    rows = rows.withColumn("dgst", key)
    newest = F.row_number().over(Window.partitionBy("dgst").orderBy(F.desc("source_order"), F.desc("not_valid_before")))
    base = rows.where("maintenance_title is null").withColumn("rn", newest).where("rn = 1").drop("rn", "source_order", *PRODUCT_COLUMNS[10:])
    updates = rows.where("maintenance_title is not null").select(F.col("dgst").alias("related_dgst"), *PRODUCT_COLUMNS[10:])
    return base, updates.distinct()


def product_key(category: Column, name: Column, report: Column, target: Column) -> Column:
    """16 hex digits over category, name and the links' file names; missing parts count as None."""
    file = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    parts = [F.coalesce(c, F.lit("None")) for c in (category, name, file(report), file(target))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


class _Tables(HTMLParser):
    """Rows of every table of a page: (table id, row, cells, links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, list[str], list[str]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        if tag == "table":
            self.open.append({"id": have.get("id") or "", "n": 0, "cells": None, "links": []})
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1].update(cells=[], links=[])
        elif self.open and tag in ("td", "th") and self.open[-1]["cells"] is not None:
            self.open[-1]["cells"].append("")
        elif self.open and tag == "a" and have.get("href"):
            self.open[-1]["links"].append(have["href"])

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cells"]:
            self.open[-1]["cells"][-1] += data

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("tr", "table"):
            self._end_row()
            if tag == "table":
                self.open.pop()

    def _end_row(self) -> None:
        t = self.open[-1]
        if t["cells"]:
            self.rows.append((t["id"], t["n"], [" ".join(c.split()) for c in t["cells"]], t["links"]))
            t["n"] += 1
        t["cells"] = None


_TABLE_ROWS = "key string, table_id string, row int, cells array<string>, links array<string>"


def html_table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_id, row, cells, links) of all tables of `pages`; null pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["key"], pdf["html"], strict=True):
                p = _Tables()
                p.feed(text or "")
                p.close()
                out += [(k, *r) for r in p.rows]
            yield pd.DataFrame(out, columns=["key", "table_id", "row", "cells", "links"])

    return pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(run, _TABLE_ROWS)


def dumps(spark: SparkSession, path: str) -> DataFrame:
    """(name, taken_at, content) of a folder of page dumps; the file's name carries the time.

    Names end like `2021-02-19T06+0100`, with minutes or without. Hadoop paths hold
    no colon, so colons of the time are left out or written %3A. Other names give
    a null time.
    """
    raw = spark.read.format("binaryFile").load(path)
    name, colon = F.regexp_extract("path", "([^/]*)$", 1), "(?:%(?:25)?3A)?"
    p = rf"(\d{{4}}-\d{{2}}-\d{{2}})T(\d{{2}}){colon}(\d{{2}})?([+-]\d{{2}}){colon}(\d{{2}})"
    g = lambda i: F.regexp_extract(name, p, i)
    stamp = F.concat(g(1), F.lit(" "), g(2), F.lit(":"), F.coalesce(F.nullif(g(3), F.lit("")), F.lit("00")), g(4), F.lit(":"), g(5))
    return raw.select(name.alias("name"), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mmXXX")).alias("taken_at"), F.decode("content", "UTF-8").alias("content"))


def fill_down(rows: DataFrame, columns: list[str], group: str, order: str) -> DataFrame:
    """Continuation rows take the last value given before them in their page."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w).alias(f"{c}_filled") for c in columns])


_CPE_ROW = "products array<struct<cpe: struct<deprecated: boolean, cpeName: string, cpeNameId: string, titles: array<struct<title: string, lang: string>>, lastModified: timestamp>>>"
_MATCH_ROW = (
    "matchStrings array<struct<matchString: struct<criteria: string, matchCriteriaId: string, status: string, lastModified: timestamp, "
    "versionStartIncluding: string, versionStartExcluding: string, versionEndIncluding: string, versionEndExcluding: string, "
    "matches: array<struct<cpeName: string, cpeNameId: string>>>>>"
)
_METRIC = "array<struct<source: string, type: string, baseSeverity: string, cvssData: struct<version: string, baseScore: double, baseSeverity: string>>>"
_CVE_ROW = (
    "vulnerabilities array<struct<cve: struct<id: string, vulnStatus: string, published: timestamp, lastModified: timestamp, "
    f"metrics: struct<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}, cvssMetricV40: {_METRIC}>, "
    "weaknesses: array<struct<description: array<struct<lang: string, value: string>>>>, "
    "configurations: array<struct<operator: string, nodes: array<struct<operator: string, negate: boolean, "
    "cpeMatch: array<struct<vulnerable: boolean, criteria: string, matchCriteriaId: string>>>>>>>>>"
)


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def cpe_feed(spark: SparkSession, path: str) -> DataFrame:
    """(cpe_id, uri, title, deprecated, modified) of pages of the product dictionary."""
    c = _pages(spark, path, _CPE_ROW).select(F.explode("products.cpe").alias("c"))
    english = F.filter("c.titles", lambda t: t["lang"] == "en")
    return c.select(F.col("c.cpeNameId").alias("cpe_id"), F.col("c.cpeName").alias("uri"), F.get(english, F.lit(0))["title"].alias("title"), F.col("c.deprecated").alias("deprecated"), F.col("c.lastModified").alias("modified"))


def match_feed(spark: SparkSession, path: str) -> DataFrame:
    """(criteria_id, criteria, four bounds, uris) of active match strings that have matches."""
    m = _pages(spark, path, _MATCH_ROW).select(F.explode("matchStrings.matchString").alias("m")).where("m.status <> 'Inactive' and size(m.matches) > 0")
    bounds = [F.col(f"m.version{k}").alias(k) for k in ("StartIncluding", "StartExcluding", "EndIncluding", "EndExcluding")]
    return m.select(F.col("m.matchCriteriaId").alias("criteria_id"), "m.criteria", *bounds, F.array_distinct("m.matches.cpeName").alias("uris"), F.col("m.lastModified").alias("modified"))


def cvss(metrics: Column) -> Column:
    """The metric to use: by version 3.1, 3.0, 2, 4.0; there the first primary, the
    first of the database's own, or the first; else 0.0, UNKNOWN and N/A."""
    groups = [F.coalesce(metrics[k], F.array()) for k in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2", "cvssMetricV40")]

    def pick(ms: Column) -> Column:
        first = lambda p: F.get(F.filter(ms, p), F.lit(0))
        return F.coalesce(first(lambda m: m["type"] == "Primary"), first(lambda m: m["source"].contains("nvd")), F.get(ms, F.lit(0)))

    best = F.coalesce(*[pick(g) for g in groups])
    return F.struct(
        F.coalesce(best["cvssData"]["baseScore"], F.lit(0.0)).alias("base_score"),
        F.coalesce(best["cvssData"]["baseSeverity"], best["baseSeverity"], F.lit("UNKNOWN")).alias("severity"),
        F.coalesce(best["cvssData"]["version"], F.lit("N/A")).alias("version"),
    )


def cve_feed(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, published, cvss, cwe_ids, criteria, configurations, modified) of settled vulnerabilities.

    `criteria` are the ids of plain configurations: one node, without operator, with OR, or
    with a single match. The others give `configurations`: arrays of components, each an
    array of criteria ids. Nodes that ask for all of their matches are left out, and
    configurations of such nodes alone.
    """
    v = _pages(spark, path, _CVE_ROW).select(F.explode("vulnerabilities.cve").alias("v")).where(F.col("v.vulnStatus").isin(TAKEN_STATES))
    confs = F.filter(F.coalesce("v.configurations", F.array()), lambda c: F.size(c["nodes"]) > 0)
    head = lambda c: F.get(c["nodes"], F.lit(0))["cpeMatch"]
    simple = lambda c: (F.size(c["nodes"]) == 1) & head(c).isNotNull() & ((F.coalesce(c["operator"], F.lit("OR")) == "OR") | (F.size(head(c)) == 1))
    listed = F.flatten(F.transform(F.filter(confs, simple), lambda c: head(c)["matchCriteriaId"]))
    any_of = lambda c: F.filter(c["nodes"], lambda n: F.coalesce(n["operator"], F.lit("OR")) == "OR")
    parts = F.transform(F.filter(confs, lambda c: ~simple(c) & (F.size(any_of(c)) > 0)), lambda c: F.transform(any_of(c), lambda n: n["cpeMatch"]["matchCriteriaId"]))
    weak = F.array_distinct(F.flatten(F.transform(F.coalesce("v.weaknesses", F.array()), lambda w: w["description"]["value"])))
    return v.select(F.col("v.id").alias("cve_id"), "v.published", cvss(F.col("v.metrics")).alias("cvss"), weak.alias("cwe_ids"), F.array_distinct(listed).alias("criteria"), parts.alias("configurations"), F.col("v.lastModified").alias("modified"))


def upsert(held: DataFrame, fresh: DataFrame, key: str, gone: str | None = None) -> DataFrame:
    """`held` with the rows of `fresh` put in or over it; rows where `gone` is true leave.

    One shuffle: both sides are unioned and the newest row of a key is taken.
    """
    rows = held.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc("modified")))
    out = rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "__new")
    return out.where(~F.coalesce(F.col(gone), F.lit(False))) if gone else out


def high_water_mark(held: DataFrame, now: Column | None = None, oldest_days: int = 120) -> tuple[object, bool]:
    """(time of the last change, whether everything must be loaded anew)."""
    row = held.agg(F.max("modified").alias("m")).select("m", (F.col("m").isNull() | (F.datediff(now if now is not None else F.current_timestamp(), "m") >= oldest_days)).alias("full")).first()
    return row["m"], bool(row["full"])


def weakness_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(cwe_id, name, parents) of the weaknesses of the catalogue's XML."""
    link = "array<struct<_Nature: string, _CWE_ID: string>>"
    schema = f"_ID string, _Name string, Related_Weaknesses struct<Related_Weakness: {link}>"
    x = spark.read.format("xml").option("rowTag", "Weakness").schema(schema).load(path)
    up = F.filter("Related_Weaknesses.Related_Weakness", lambda r: r["_Nature"] == "ChildOf")
    return x.select(F.concat(F.lit("CWE-"), "_ID").alias("cwe_id"), F.col("_Name").alias("name"), F.coalesce(F.array_distinct(F.transform(up, lambda r: F.concat(F.lit("CWE-"), r["_CWE_ID"]))), F.array()).alias("parents"))


def labels_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ground truth with a declared schema; bad rows are dropped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).csv(path)


def tagged_json(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """The rows of a JSON sink that carry `_type` = `kind`, compressed or not, without the tag."""
    reader = spark.read.schema(f"{schema}, _type string") if schema else spark.read
    return reader.json(path).where(F.col("_type") == kind).drop("_type")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def listed_numbers(pages: DataFrame, html: str, table: str = "searchResultsTable") -> DataFrame:
    """(cert_id) named by links of the result tables of listing pages, each once."""
    body = F.regexp_extract(F.col(html), rf'(?is)<table[^>]*id="{table}".*?</table>', 0)
    return pages.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?i)certificate/(\d+)"), F.lit(1))).alias("cert_id")).distinct()


def weakness_categories(spark: SparkSession, path: str) -> DataFrame:
    """(category_id, name, members) of the catalogue's XML."""
    schema = "_ID string, _Name string, Relationships struct<Has_Member: array<struct<_CWE_ID: string, _View_ID: string>>>"
    x = spark.read.format("xml").option("rowTag", "Category").schema(schema).load(path)
    members = F.coalesce(F.array_distinct(F.transform("Relationships.Has_Member", lambda m: F.concat(F.lit("CWE-"), m["_CWE_ID"]))), F.array().cast("array<string>"))
    return x.select(F.concat(F.lit("CWE-"), "_ID").alias("category_id"), F.col("_Name").alias("name"), members.alias("members"))


def verified_matches(labels: DataFrame, dictionary: DataFrame, certs: DataFrame) -> DataFrame:
    """(dgst, verified_uris) from labelling results (text, options, wrong).

    `options` maps an option's name to a dictionary title, `wrong` lists the names an annotator
    rejected (with or without a leading $). `No good match` is no title; titles that the
    dictionary (title, uri) lacks are passed over. The text is a certificate's name, or holds
    it in a line `Module name: ...`. Every labelled certificate (dgst, name) has a row, with
    null where nothing was confirmed.
    """
    line = F.regexp_extract("text", r"\nModule name: ([^\n]*)", 1)
    name = F.when(F.contains("text", F.lit("\n")), line).otherwise(F.col("text"))
    off = F.transform(F.coalesce("wrong", F.array()), lambda w: F.ltrim(w, F.lit("$")))
    given = labels.select(name.alias("name"), F.explode_outer(F.map_values(F.map_filter("options", lambda k, v: (v != "No good match") & ~F.array_contains(off, k)))).alias("title"))
    uris = given.join(dictionary.select("title", "uri"), "title", "left").groupBy("name").agg(F.array_sort(F.collect_set("uri")).alias("uris"))
    return certs.select("dgst", "name").join(uris, "name").select("dgst", F.when(F.size("uris") > 0, F.col("uris")).alias("verified_uris"))
