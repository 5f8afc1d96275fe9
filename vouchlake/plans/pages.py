"""Queries that write the star tables as pages of the registers and parse them again; the
SQL of each says from the tables alone what the pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.functions import columns
from vouchlake.sources import pages

BASE = "https://register.org"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out before each becomes a page: a small file is read by one task, whatever its pages come to."""
    return rows.repartition(max(48, 2 * spark.sparkContext.defaultParallelism), key)


def _page(lines: DataFrame, by: str, order: str, line: str, before: str, after: str) -> DataFrame:
    """(page, html): the lines of a page in order, between two fixed texts."""
    held = F.array_sort(F.collect_list(F.struct(F.expr(order).alias("at"), F.expr(line).alias("line"))))
    return _dealt(lines.sparkSession, lines.withColumn("page", F.expr(by)), "page").groupBy("page").agg(F.concat(F.expr(before), F.array_join(F.transform(held, lambda x: x.line), ""), F.lit(after)).alias("html"))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products, a page for each size and thousand parts; every third has a maintenance report."""
    line = """concat('<tr><td><b>', p_name, '</b><a href="/files/', p_partkey, '.pdf" title="Certification Report ', p_partkey, '">report</a> <a href="/st/', p_partkey, '.pdf" title="Security Target">target</a>',
        if(p_partkey % 2 = 0, '<a href="/files/ppfiles/p.pdf">profile</a>', ''),
        if(p_partkey % 3 = 0, concat('<div><div>Maintenance Report(s)<ul><li>2020-02-03 – Update &amp; fix ', p_partkey, ' <a href="/m/', p_partkey, '" title="Maintenance Report: x">Maintenance Report</a></li></ul></div></div>'), ''),
        '</td><td>', p_brand, '<a title="Vendor''s web site" href="http://v', p_partkey, '">www</a></td><td><a href="/c/', p_partkey, '">c</a></td><td>2019-0', p_partkey % 9 + 1, '-11</td><td>', if(p_partkey % 4 = 0, '', '2024-10-05'),
        '</td><td>EAL', p_partkey % 7 + 1, '<br>ALC_FLR.', p_partkey % 3, '</td><td>', p_type, '</td></tr>')"""
    html = _page(_read(spark, sf_dir, "part"), "concat(p_size, '-', p_partkey div 1000)", "p_partkey", line, "concat('<html><body><p>x<table id=\"tblIC\"><tr><th>Product</th></tr><tr><td>made', max(p_size), '</td></tr>')", "</table></body></html>")
    x = pages.products(pages.rows(html, "page", "html"), BASE)
    m = F.get("maintenance", F.lit(0))
    return x.select(
        "key", "category", "name", "manufacturer", "manufacturer_web", "scheme", F.array_join("security_level", ",").alias("security_level"), F.size("profile_links").alias("n_profiles"),
        F.date_format("not_valid_before", "yyyy-MM-dd").alias("valid_from"), F.date_format("not_valid_after", "yyyy-MM-dd").alias("valid_to"), "report_link", "st_link", "cert_link", m.title.alias("maintenance_title"),
        m.report_link.alias("maintenance_link"), F.date_format(m.date, "yyyy-MM-dd").alias("maintained"),
    )


def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as archived profiles, a page for each nation and thousand suppliers; every seventh row lacks its link and goes."""
    line = """concat('<tr><td>', if(s_suppkey % 7 = 0, s_name, concat('<a href="/pp/', s_suppkey, '.pdf">', s_name, '</a>')), '</td><td>1.', s_suppkey, '</td><td>EAL4+<br>ADV_IMP.2</td><td>2010-01-0', s_suppkey % 9 + 1,
        '</td><td>2015-01-01</td><td>DE</td><td><a href="/r/', s_suppkey, '">r</a></td></tr>')"""
    html = _page(_read(spark, sf_dir, "supplier"), "concat(s_nationkey, '-', s_suppkey div 1000)", "s_suppkey", line, "'<table id=tblOS><thead><tr><th>Profile</th></tr></thead><tbody>'", "</tbody></table>")
    x = pages.profiles(pages.rows(html, "page", "html"), BASE, "archived")
    return x.select("key", "category", "status", "name", "version", F.array_join("security_level", ",").alias("security_level"), F.date_format("not_valid_before", "yyyy-MM-dd").alias("valid_from"), F.date_format("not_valid_after", "yyyy-MM-dd").alias("valid_to"), "report_link", "pp_link", "scheme")


def algorithm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as validated algorithms, one page a customer; two of three rows go on with the
    vendor and product above them, or have none."""
    line = """concat('<tr>', if(o_orderkey % 3 = 0, concat('<td>Vendor ', o_orderkey, '</td><td><a id="product-name-1" href="details?product=', o_orderkey + 7, '&amp;x=1">Lib ', o_orderkey, '</a></td>'), ''),
        '<td><a id="validation-number-2">AES ', o_orderkey, '</a></td><td>', date_format(o_orderdate, 'MM/dd/yyyy'), '</td></tr>')"""
    html = _page(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", line, "'<table><thead><tr><th>Vendor</th></tr></thead><tbody>'", "</tbody></table>")
    return pages.algorithm_list(pages.rows(html, "page", "html")).withColumn("validated", F.date_format("validated", "yyyy-MM-dd"))


def capability_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as validations of a nation's product page, with one environment and two capabilities each."""
    line = """concat('<form method="get"><h4><a href="details?validation=', s_suppkey, '">SHS #', s_suppkey, '</a></h4><table><tr><th>OE</th></tr><tr><td>', if(s_suppkey % 3 = 0, 'N/A', concat('Linux ', s_suppkey % 5)), ' Expand </td>
        <td><a href="/Validation-Notes#a">SHA-', s_suppkey % 4, ':</a> <a href="/other">no</a> <a href="/Validation-Notes#b">SHA-9:</a></td></tr></table></form>')"""
    html = _page(_read(spark, sf_dir, "supplier"), "concat(s_nationkey, '-', s_suppkey div 1000)", "s_suppkey", line, "'<h1>Product</h1>'", "")
    return pages.capabilities(pages.rows(html, "page", "html"))


def module_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as validated modules, one page each."""
    row = lambda label, value: f"'<div class=\"row padrow\"><div class=\"col-md-3\">{label}</div><div class=\"col-md-9\">', {value}, '</div></div>'"
    panel = lambda *inner: ", ".join(["'<div class=\"panel panel-default\"><div class=\"panel-body\">'", *inner, "'</div></div>'"])
    table = "'<table><tbody><tr><td>AES</td><td>Cert. #', c_custkey, ' and #A ', c_custkey + 1, '</td></tr></tbody></table>'"
    details = [
        row("Module Name", "c_name"), row("Status", "'  Active '"), row("Overall Level", "c_custkey % 4 + 1"), row("Sunset Date", "'9/21/2026'"), row("Module Type", "'software-HYBRID'"), row("Embodiment", "'Multi-chip  standalone'"),
        row("Caveat", "'When used with Cert. #', c_custkey, ' and AES Cert. #77, Certificate ', c_custkey"), row("Security Level Exceptions", "'<ul><li>Roles: ', c_mktsegment, '</li><li>EMI</li></ul>'"), row("Tested Configuration(s)", "'<ul><li>N/A</li></ul>'"), row("Approved Algorithms", table), row("Other", "'x'"),
    ]
    maker = "if(c_custkey % 2 = 0, concat('<a href=\"http://v', c_custkey, '\">Maker ', c_nationkey, '</a>'), concat('Maker ', c_nationkey))"
    vendor = "'<div class=\"row padrow\"><div class=\"col-md-12\">', " + maker + ", '</div></div>'"
    files = "'<div class=\"row padrow\"><div class=\"col-md-12\"><a href=\"/p\">Policy</a><a href=\"/cert/', c_custkey, '\">Certificate</a></div></div>'"
    history = "'<table><thead><tr><th>Date</th></tr></thead><tbody><tr><td>2/3/2020</td><td>Initial</td><td>Lab ', c_nationkey, '</td></tr><tr><td>4/5/2021</td><td>Update</td><td>LAB</td></tr></tbody></table>'"
    html = _dealt(spark, _read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.expr(f"concat({panel(*details)}, {panel(vendor)}, {panel(files)}, {panel(history)})").alias("html"))
    x = pages.modules(pages.rows(html, "c_custkey", "html"), BASE)
    ids = F.array_sort(F.transform(F.map_entries("mentioned_certs"), lambda m: F.concat_ws(":", m["key"], m["value"].cast("string"))))
    return x.select(
        "key", "module_name", "status", "level", F.date_format("date_sunset", "yyyy-MM-dd").alias("sunset"), "module_type", "embodiment", F.array_join(ids, " ").alias("mentioned"), F.array_join("exceptions", "|").alias("exceptions"),
        F.array_join("tested_conf", "|").alias("tested"), F.array_join("algorithms", "|").alias("algorithms"), "vendor", "vendor_url", "certificate_pdf_url", F.array_join(F.transform("history", lambda h: F.concat_ws(" ", h["date"].cast("string"), h["type"], h["lab"])), "|").alias("history"),
    )


def queue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as modules under test, a page a day, with the footer's counts and the page's own day."""
    line = "concat('<tr><td>Module ', o_orderkey, '</td><td>V', o_custkey, '</td><td>140-3</td><td>', date_format(o_orderdate, 'M/d/yyyy'), '</td></tr>')"
    before = "concat('<p>Last Updated: ', max(date_format(o_orderdate, 'M/d/yyyy')), '</p><table><thead><tr><th>Module</th></tr></thead><tbody>')"
    after = '</tbody><tfoot id="IUTFooter"><tr><td>Displayed</td><td>12</td></tr><tr><td>Not</td><td>3</td></tr><tr><td>Total</td><td>15</td></tr></tfoot></table>'
    html = _page(_read(spark, sf_dir, "orders"), "cast(o_orderdate AS date)", "o_orderkey", line, before, after).withColumn("updated", pages.last_updated(F.col("html")))
    found = pages.rows(html, "page", "html")
    own = html.select(F.col("page").cast("string").alias("key"), F.date_format("updated", "yyyy-MM-dd").alias("updated"))
    entries = pages.queue(found).withColumn("listed", F.date_format("listed", "yyyy-MM-dd"))
    return entries.join(own, "key").join(pages.footer_counts(found, "IUTFooter"), "key")


_TAKEN = ["2020-10-27", "2021-04-19", "2022-03-22", "2025-01-01", "2026-04-01"]
_STATES = ["In Review", "Review Pending", "Coordination", "Finalization"]


def process_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as modules in process, each page in one of the five layouts."""
    state = f"element_at(array({', '.join(map(repr, _STATES))}), cast(o_orderkey % 4 + 1 AS int))"
    old = "concat_ws('', transform(array(0, 1, 2, 3), i -> concat('<td class=\"', if(i = o_orderkey % 4, 'x mip-highlight', 'x'), '\">*</td>')))"
    vendor = "concat('V', o_orderkey % 9, if(o_custkey % 5 < 2, '', concat('<div id=\"S', o_orderkey, '\">contact</div>')))"
    cells = f"CASE WHEN o_custkey % 5 = 0 THEN {old} WHEN o_custkey % 5 < 3 THEN concat('<td>', {state}, '</td>') ELSE concat('<td>', {state}, '  (', date_format(o_orderdate, 'M/d/yyyy'), ')</td>') END"
    line = f"concat('<tr><td>Module ', o_orderkey, '</td><td>', {vendor}, '</td><td>140-2</td>', {cells}, '</tr>')"
    html = _page(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", line, "'<table><thead><tr><th>Module</th></tr></thead><tbody>'", "</tbody></table>")
    taken = F.expr(f"element_at(array({', '.join(map(repr, _TAKEN))}), cast(key % 5 + 1 AS int))").cast("timestamp")
    x = pages.in_process(pages.rows(html, "page", "html").withColumn("taken_at", taken))
    return x.select("key", F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot"), "module", "vendor", "standard", "status", F.date_format("since", "yyyy-MM-dd").alias("since"), "submission_id")


def key_value_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as certificate pages of labels and values; a label that comes twice counts once."""
    html = _dealt(spark, _read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.expr("""concat('<table><tr><td>Name:</td><td>', c_name, '</td></tr><tr><td>Unknown</td><td>1</td></tr><tr><th>Holder</th><td>', if(c_custkey % 3 = 0, '', c_mktsegment),
        '</td></tr><tr><td>Name:</td><td>again</td></tr></table>')""").alias("html"))
    return pages.key_values(pages.rows(html, "c_custkey", "html"), {"Name": "name", "Holder": "holder"})


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of some pages; one of four lists its tables."""
    body = "array_join(transform(sequence(1, 5), p -> concat('text\n', if(p = o_orderkey % 5 + 1, concat('Table ', p, '\n'), ''), if(p < 5, '\f', ''))), '')"
    listed = "if(o_orderkey % 4 = 0, concat('List of Tables\nTable 1 Approved algorithms ... ', o_orderkey % 90 + 3, '\nTable 2 Roles 4\n\f'), '')"
    text = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"concat({listed}, {body})").alias("text"))
    return text.select("o_orderkey", F.array_join(columns.pages_with_tables(F.col("text")), ",").alias("pages"))


_Q = (product_pages, profile_pages, algorithm_pages, capability_pages, module_pages, queue_pages, process_pages, key_value_pages, table_pages)
QUERIES = {f.__name__: f for f in _Q}

ORACLE_SQL = {
    "product_pages": f"""SELECT concat(p_size, '-', p_partkey // 1000) AS key, 'ICs, Smart Cards and Smart Card-Related Devices and Systems' AS category, p_name AS name, p_brand AS manufacturer, concat('http://v', p_partkey) AS manufacturer_web, p_type AS scheme,
        concat('ALC_FLR.', p_partkey % 3, ',EAL', p_partkey % 7 + 1) AS security_level, cast(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS integer) AS n_profiles, concat('2019-0', p_partkey % 9 + 1, '-11') AS valid_from,
        CASE WHEN p_partkey % 4 <> 0 THEN '2024-10-05' END AS valid_to, concat('{BASE}/files/', p_partkey, '.pdf') AS report_link, concat('{BASE}/st/', p_partkey, '.pdf') AS st_link, concat('{BASE}/c/', p_partkey) AS cert_link,
        CASE WHEN p_partkey % 3 = 0 THEN concat('Update & fix ', p_partkey) END AS maintenance_title, CASE WHEN p_partkey % 3 = 0 THEN concat('{BASE}/m/', p_partkey) END AS maintenance_link, CASE WHEN p_partkey % 3 = 0 THEN '2020-02-03' END AS maintained FROM part""",
    "profile_pages": f"""SELECT concat(s_nationkey, '-', s_suppkey // 1000) AS key, 'Operating Systems' AS category, 'archived' AS status, s_name AS name, concat('1.', s_suppkey) AS version, 'ADV_IMP.2,EAL4+' AS security_level, concat('2010-01-0', s_suppkey % 9 + 1) AS valid_from,
        '2015-01-01' AS valid_to, concat('{BASE}/r/', s_suppkey) AS report_link, concat('{BASE}/pp/', s_suppkey, '.pdf') AS pp_link, 'DE' AS scheme FROM supplier WHERE s_suppkey % 7 <> 0""",
    "algorithm_pages": """SELECT cast(o_custkey AS varchar) AS key, 'AES' AS algorithm_type, cast(o_orderkey AS varchar) AS alg_number, coalesce('Vendor ' || h, '') AS vendor, coalesce('Lib ' || h, '') AS implementation_name,
        cast(h + 7 AS varchar) AS product_id, strftime(o_orderdate, '%Y-%m-%d') AS validated
        FROM (SELECT *, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS h FROM orders) t""",
    "capability_pages": """SELECT concat(s_nationkey, '-', s_suppkey // 1000) AS key, 'SHS' AS algorithm_type, cast(s_suppkey AS varchar) AS alg_number, c AS capability, CASE WHEN s_suppkey % 3 <> 0 THEN concat('Linux ', s_suppkey % 5) END AS environment
        FROM (SELECT s_suppkey, s_nationkey, concat('SHA-', s_suppkey % 4) AS c FROM supplier UNION ALL SELECT s_suppkey, s_nationkey, 'SHA-9' FROM supplier) t""",
    "module_pages": f"""SELECT cast(c_custkey AS varchar) AS key, c_name AS module_name, 'active' AS status, cast(c_custkey % 4 + 1 AS integer) AS level, '2026-09-21' AS sunset, 'Software-Hybrid' AS module_type, 'Multi-Chip Stand Alone' AS embodiment,
        concat(c_custkey, ':2') AS mentioned, concat('Roles: ', c_mktsegment, '|EMI') AS exceptions, cast(NULL AS varchar) AS tested, concat('AES#', c_custkey, '|AES#A ', c_custkey + 1) AS algorithms,
        concat('Maker ', c_nationkey) AS vendor, CASE WHEN c_custkey % 2 = 0 THEN concat('http://v', c_custkey) END AS vendor_url, concat('{BASE}/cert/', c_custkey) AS certificate_pdf_url, concat('2020-02-03 Initial Lab ', c_nationkey, '|2021-04-05 Update LAB') AS history FROM customer""",
    "queue_pages": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS key, concat('Module ', o_orderkey) AS module, concat('V', o_custkey) AS vendor, '140-3' AS standard, strftime(o_orderdate, '%Y-%m-%d') AS listed, strftime(o_orderdate, '%Y-%m-%d') AS updated,
        cast(12 AS integer) AS displayed, cast(3 AS integer) AS not_displayed, cast(15 AS integer) AS total FROM orders""",
    "process_pages": f"""SELECT cast(o_custkey AS varchar) AS key, ({_TAKEN})[o_custkey % 5 + 1] AS snapshot, concat('Module ', o_orderkey) AS module, concat('V', o_orderkey % 9) AS vendor, '140-2' AS standard, ({_STATES})[o_orderkey % 4 + 1] AS status,
        CASE WHEN o_custkey % 5 > 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS since, CASE WHEN o_custkey % 5 = 4 THEN cast(o_orderkey AS varchar) END AS submission_id FROM orders""",
    "key_value_pages": "SELECT cast(c_custkey AS varchar) AS key, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS holder FROM customer",
    "table_pages": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN cast(o_orderkey % 90 + 3 AS varchar) ELSE (['1,2', '2,3', '2,3,4', '3,4', '4,6'])[o_orderkey % 5 + 1] END AS pages FROM orders""",
}
