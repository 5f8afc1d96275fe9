"""Plans over certificates, their references and vulnerabilities.

The star tables stand in: an order is a certificate (scheme, status, validity
window), its lines are vulnerabilities and references to other certificates. One
text serves both engines, with DAYS(a; b) for the days from a to b and RX(a; p)
for a regular expression's search; a pair holds two texts of different plans.
"""

from __future__ import annotations

import re

from vouchlake.plans import relational

_CERTS = """certs AS (SELECT o_orderkey AS dgst, o_orderpriority AS scheme, o_orderstatus AS status, o_custkey AS vendor, o_totalprice AS score,
    cast(o_orderdate AS date) AS nvb, cast(o_orderdate AS date) + cast(o_orderkey % 2500 AS int) AS nva FROM orders)"""
_REFS = "refs AS (SELECT DISTINCT l_orderkey AS src, l_partkey * 7 AS dst FROM lineitem WHERE l_orderkey <> l_partkey * 7)"
_DEALT_REFS = """refs AS (SELECT DISTINCT src, dst FROM (SELECT /*+ REPARTITION(200, src, dst) */ l_orderkey AS src, l_partkey * 7 AS dst FROM lineitem) d WHERE src <> dst)"""
_CVES = "cves AS (SELECT l_orderkey AS dgst, l_partkey AS cve, l_suppkey AS cwe, l_extendedprice AS score, cast(l_shipdate AS date) AS published FROM lineitem)"

PLANS: dict[str, str | tuple[str, str]] = {
    "drop_unnamed": "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL",
    "drop_placeholder": "SELECT p_partkey, p_type FROM part WHERE p_type <> 'ECONOMY'",
    # which documents to fetch anew, to fetch again, to convert, to analyse
    "document_states": f"""WITH {_CERTS} SELECT dgst, status = 'O' AS to_fetch, status = 'O' AND score > 100000 AS to_retry, status = 'P' AS to_convert,
        status = 'F' AND nva > nvb AS to_analyse FROM certs""",
    "weak_entries": "SELECT p_partkey, p_name FROM part WHERE NOT (NOT RX(p_name; '[0-9]') AND p_size IN (1, 10)) AND NOT RX(p_type; 'rc[0-9]?[0-9]?$')",
    "short_names": "SELECT p_partkey FROM part WHERE length(p_name) > 10",
    "membership": f"WITH {_CERTS} SELECT dgst FROM certs WHERE scheme = '1-URGENT' AND status = 'F' AND vendor IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    # an ordered category compared by its place
    "ordered_level_filter": f"WITH {_CERTS} SELECT dgst, scheme FROM certs WHERE CASE scheme WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END >= 3",
    "record_projection": f"WITH {_CERTS} SELECT dgst, scheme, status, year(nvb) AS year_from, nvb, nva FROM certs",
    "category_buckets": """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'popular' WHEN RX(p_type; '^(PROMO|SMALL)') THEN 'related' ELSE 'others' END AS bucket FROM part""",
    "algorithm_chain": """SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey
        LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey""",
    "aligned_series": f"""WITH {_CERTS}, {_CVES}, n AS (SELECT dgst + 7 AS dgst, count(*) AS n FROM cves GROUP BY 1)
        SELECT coalesce(certs.dgst, n.dgst) AS dgst, scheme, n FROM certs FULL OUTER JOIN n ON certs.dgst = n.dgst""",
    "archived_at_issue": f"WITH {_CERTS}, {_REFS} SELECT src, dst FROM refs JOIN certs a ON a.dgst = src JOIN certs b ON b.dgst = dst WHERE a.nvb > b.nva",
    # earlier and later certificates of one vendor and scheme
    "neighbour_versions": f"""WITH {_CERTS} SELECT dgst, row_number() OVER w - 1 AS n_previous, count(*) OVER (PARTITION BY vendor, scheme) - row_number() OVER w AS n_next,
        lag(dgst) OVER w AS previous_one FROM certs WINDOW w AS (PARTITION BY vendor, scheme ORDER BY nvb, dgst)""",
    "split_membership": """SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.n_chars > 20""",
    "fixing_updates": f"""WITH {_CERTS} SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM certs WHERE dgst = l_orderkey AND nva = cast(l_shipdate AS date))""",
    "vectors_with_metadata": "SELECT vec_id, label, lang, n_chars FROM embeddings JOIN documents ON vec_id = doc_id",
    "all_in_use": "SELECT DISTINCT l_partkey AS uri FROM lineitem",
    # per family: how many, from where to where, and the second most common level
    "family_support": """WITH n AS (SELECT p_brand AS family, p_size AS level, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, level) AS rn FROM n)
        SELECT family, cast(sum(n) AS bigint) AS support, min(level) AS lowest, max(level) AS highest, max(CASE WHEN rn = 2 THEN level END) AS second FROM r GROUP BY 1""",
    "family_levels": "SELECT p_brand AS family, p_type AS holder, max(p_size) AS level FROM part GROUP BY 1, 2",
    # mean share of the true matches in true and predicted ones together
    "matching_precision": (
        """WITH b AS (SELECT l_orderkey AS k, l_partkey AS v, max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS t, max(CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END) AS p FROM (SELECT /*+ REPARTITION(200, l_orderkey) */ l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem) d GROUP BY 1, 2),
        s AS (SELECT k, sum(t) AS n_true, sum(greatest(t, p)) AS n_any, sum(CASE WHEN t = 1 AND p = 0 THEN 1 ELSE 0 END) AS lost, sum(CASE WHEN p = 1 AND t = 0 THEN 1 ELSE 0 END) AS added FROM b GROUP BY 1)
        SELECT round(avg(n_true * 1e0 / n_any), 8) AS matching_precision, cast(sum(lost) AS bigint) AS lost, cast(sum(added) AS bigint) AS added FROM s WHERE n_any > 0""",
        """WITH b AS (SELECT l_orderkey AS k, l_partkey AS v, max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS t, max(CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1, 2),
        s AS (SELECT k, sum(t) AS n_true, sum(greatest(t, p)) AS n_any, sum(CASE WHEN t = 1 AND p = 0 THEN 1 ELSE 0 END) AS lost, sum(CASE WHEN p = 1 AND t = 0 THEN 1 ELSE 0 END) AS added FROM b GROUP BY 1)
        SELECT round(avg(n_true * 1e0 / n_any), 8) AS matching_precision, cast(sum(lost) AS bigint) AS lost, cast(sum(added) AS bigint) AS added FROM s WHERE n_any > 0""",
    ),
    # share of pairs at or over each threshold; buckets and a running sum against a cross join
    "threshold_sweep": (
        """WITH n AS (SELECT l_returnflag AS scheme, cast(floor(l_quantity / 5) * 5 AS int) AS threshold, count(*) AS n FROM lineitem GROUP BY 1, 2),
           g AS (SELECT scheme, explode(sequence(0, 50, 5)) AS threshold FROM (SELECT DISTINCT l_returnflag AS scheme FROM lineitem) s)
           SELECT g.scheme, g.threshold, round(sum(coalesce(n, 0)) OVER (PARTITION BY g.scheme ORDER BY g.threshold DESC) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.scheme) * 1e0), 8) AS rate
           FROM g LEFT JOIN n ON g.scheme = n.scheme AND g.threshold = n.threshold""",
        """SELECT l_returnflag AS scheme, cast(threshold AS integer) AS threshold, round(avg(CASE WHEN l_quantity >= threshold THEN 1e0 ELSE 0e0 END), 8) AS rate
           FROM lineitem CROSS JOIN (SELECT unnest(range(0, 51, 5)) AS threshold) t GROUP BY 1, 2""",
    ),
    "short_lived": f"""WITH {_CERTS} SELECT scheme, count(*) FILTER (WHERE DAYS(nvb; nva) < 365) AS short_lived, count(*) FILTER (WHERE nvb = nva) AS zero_days,
        count(*) FILTER (WHERE DAYS(nvb; nva) < 365 AND score > 200000) AS short_and_hit FROM certs GROUP BY 1""",
    "vulnerability_timing": f"""WITH {_CERTS}, {_CVES} SELECT scheme, round(avg(CASE WHEN published < nvb THEN 1e0 ELSE 0e0 END), 8) AS before_share, round(avg(CASE WHEN published > nva THEN 1e0 ELSE 0e0 END), 8) AS after_share,
        round(avg(CASE WHEN published BETWEEN nvb AND nva THEN 1e0 ELSE 0e0 END), 8) AS inside_share, round(avg(DAYS(nvb; published) * 1e0), 6) AS days_after_issue, round(avg(DAYS(nva; published) * 1e0), 6) AS days_after_end
        FROM certs JOIN cves ON certs.dgst = cves.dgst GROUP BY 1""",
    "stale_references": f"""WITH {_CERTS}, {_REFS} SELECT a.scheme, round(avg(CASE WHEN DAYS(b.nvb; a.nvb) > 547 THEN 1e0 ELSE 0e0 END), 8) AS stale, count(*) AS n
        FROM refs JOIN certs a ON a.dgst = src JOIN certs b ON b.dgst = dst GROUP BY 1""",
    "active_to_historical": f"""WITH {_CERTS}, {_REFS}, {_CVES}, hit AS (SELECT dgst, count(DISTINCT cve) AS n FROM cves GROUP BY 1)
        SELECT src, count(*) AS n_historical, cast(sum(coalesce(n, 0)) AS bigint) AS n_inherited FROM refs JOIN certs a ON a.dgst = src JOIN certs b ON b.dgst = dst LEFT JOIN hit ON hit.dgst = dst
        WHERE a.nva >= date '2000-01-01' AND b.nva < date '2000-01-01' GROUP BY 1""",
    "referencing_share": f"""WITH {_CERTS}, {_REFS} SELECT year(nvb) AS y, round(avg(CASE WHEN r.src IS NOT NULL THEN 1e0 ELSE 0e0 END), 8) AS share
        FROM certs LEFT JOIN (SELECT src FROM refs GROUP BY 1 HAVING count(*) > 3) r ON dgst = r.src GROUP BY 1""",
    "first_chunk": """SELECT DISTINCT user_id, event_type, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS nearest FROM events""",
    # of the same entry in one snapshot, the newest status, then the later state
    "snapshot_dedup": """SELECT user_id, d, event_type, value FROM (SELECT user_id, cast(ts AS date) AS d, event_type, value,
        row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY value DESC, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 1 END DESC, event_id) AS rn FROM events) t WHERE rn = 1""",
    # how much of each day's top ten was ever new
    "daily_top_ten": f"""WITH {_CERTS}, r AS (SELECT nvb, vendor, row_number() OVER (PARTITION BY nvb ORDER BY score DESC, dgst) AS rn FROM certs)
        SELECT count(DISTINCT vendor) AS ever, count(*) AS places, round(count(DISTINCT vendor) * 1e0 / count(*), 8) AS share FROM r WHERE rn <= 10""",
    "natural_order": (
        """SELECT id, row_number() OVER (PARTITION BY y ORDER BY cast(element_at(split(id, '-'), 3) AS int)) AS place FROM (SELECT concat('CVE-', year(o_orderdate), '-', o_orderkey) AS id, year(o_orderdate) AS y FROM orders) t""",
        """SELECT id, row_number() OVER (PARTITION BY y ORDER BY cast(split_part(id, '-', 3) AS int)) AS place FROM (SELECT concat('CVE-', year(o_orderdate), '-', o_orderkey) AS id, year(o_orderdate) AS y FROM orders) t""",
    ),
    # counts of distinct values and a running sum, so that no group is held whole
    "ecdf": (
        """SELECT l_returnflag, l_quantity, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / (sum(n) OVER (PARTITION BY l_returnflag) * 1e0), 8) AS share
           FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) t""",
        "SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 8) AS share FROM lineitem",
    ),
    "invert_mapping": (
        "SELECT p_name, array_join(array_sort(collect_set(p_brand)), ',') AS brands FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1",
        "SELECT p_name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1",
    ),
    "path_test": (
        "SELECT event_id, get_json_object(props, '$.k') IS NOT NULL AS has_k, get_json_object(props, '$.k.x') IS NOT NULL AS has_deeper FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.k.x') IS NOT NULL AS has_deeper FROM events",
    ),
    "list_literals": (
        "SELECT p_partkey, cast(aggregate(from_json(concat('[', p_size, ', ', p_partkey, ']'), 'array<bigint>'), cast(0 AS bigint), (a, b) -> a + b) AS bigint) AS total FROM part",
        "SELECT p_partkey, cast(p_size + p_partkey AS bigint) AS total FROM part",
    ),
    "explode_together": (
        """SELECT p_partkey, z.word, z.at FROM (SELECT p_partkey, explode(arrays_zip(word, at)) AS z
           FROM (SELECT p_partkey, split(p_name, ' ') AS word, sequence(1, size(split(p_name, ' '))) AS at FROM part) s) t""",
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, cast(unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS integer) AS at FROM part",
    ),
    # two reference graphs kept apart by a label
    # in Spark rows are dealt before pairs are told apart, as few tasks read a small file
    "labelled_graphs": (
        f"WITH {_DEALT_REFS}, e AS (SELECT 'policy' AS graph, src, dst FROM refs UNION ALL SELECT 'module', dst, src FROM refs) SELECT graph, src AS node, count(*) AS n FROM e GROUP BY 1, 2",
        f"WITH {_REFS}, e AS (SELECT 'policy' AS graph, src, dst FROM refs UNION ALL SELECT 'module', dst, src FROM refs) SELECT graph, src AS node, count(*) AS n FROM e GROUP BY 1, 2",
    ),
    "cluster_lookup": "SELECT n_name AS cwe, n_regionkey AS secondary, r_name AS primary_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey",
    "ego_graph": f"WITH {_REFS} SELECT src, dst FROM refs WHERE src = 7 OR dst = 7",
    # 30, 20 and 50 percent of every class; classes under five documents go to the
    # test part; ranks are summed over 4,096 spans of the hash, so that no class lies in one task
    "stratified_split": (
        """WITH d AS (SELECT doc_id, source, lang, md5(cast(doc_id AS string)) AS h FROM documents),
        r AS (SELECT source, lang, substr(h, 1, 3) AS span, count(*) AS c FROM d GROUP BY source, lang, substr(h, 1, 3)),
        s AS (SELECT source, lang, span, sum(c) OVER (PARTITION BY source, lang) AS n, sum(c) OVER (PARTITION BY source, lang ORDER BY span) - c AS below FROM r),
        x AS (SELECT d.doc_id, s.n, s.below + row_number() OVER (PARTITION BY d.source, d.lang, s.span ORDER BY d.h, d.doc_id) AS rn
              FROM d JOIN s ON d.source <=> s.source AND d.lang <=> s.lang AND substr(d.h, 1, 3) = s.span)
        SELECT doc_id, CASE WHEN n < 5 OR rn > n / 2e0 THEN 'test' WHEN rn <= n * 3e-1 THEN 'train' ELSE 'valid' END AS part FROM x""",
        """SELECT doc_id, CASE WHEN n < 5 OR rn > n / 2e0 THEN 'test' WHEN rn <= n * 3e-1 THEN 'train' ELSE 'valid' END AS part FROM (SELECT doc_id, count(*) OVER (PARTITION BY source, lang) AS n,
        row_number() OVER (PARTITION BY source, lang ORDER BY md5(cast(doc_id AS varchar(20))), doc_id) AS rn FROM documents) t""",
    ),
    "labs_of_reports": """SELECT DISTINCT c_mktsegment AS scheme, upper(substr(c_name, 1, 8)) AS lab FROM customer""",
}


def _days(text: str, spark: bool) -> str:
    text = re.sub(r"DAYS\(([^;]+); ([^)]+)\)", r"datediff(\2, \1)" if spark else r"date_diff('day', \1, \2)", text)
    return re.sub(r"RX\((\w+); ('[^']*')\)", r"\1 RLIKE \2" if spark else r"regexp_matches(\1, \2)", text)


_SPARK = {n: _days(t if isinstance(t, str) else t[0], True) for n, t in PLANS.items()}
QUERIES = {n: (lambda spark, sf_dir, n=n: relational.run(spark, sf_dir, n, _SPARK)) for n in PLANS}
ORACLE_SQL = {n: _days(t if isinstance(t, str) else t[1], False) for n, t in PLANS.items()}
