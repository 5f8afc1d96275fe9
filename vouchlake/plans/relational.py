"""Relational plans of the analytics surface over the star tables.

Each entry is one SQL text; a pair holds a Spark text and the oracle's where the
dialects differ.
"""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents labels pages embeddings".split()

PLANS: dict[str, str | tuple[str, str]] = {
    # count by year and category
    "count_by_year_category": """
        SELECT cast(year(o_orderdate) AS bigint) AS year_from, c_mktsegment AS category, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    # counts and mean level code by year
    "avg_rank_by_year": """
        SELECT cast(year(o_orderdate) AS bigint) AS year_from, count(*) AS n, round(avg(cast(substr(o_orderpriority, 1, 1) AS double)), 6) AS avg_level
        FROM orders GROUP BY 1""",
    "value_counts_normalized": """
        SELECT o_orderpriority AS value, n, round(n / cast(sum(n) OVER () AS double), 8) AS share
        FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) t""",
    "normalized_subset_counts": """
        SELECT a.k AS k, round(coalesce(b.n, 0) / cast(a.n AS double), 8) AS share
        FROM (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1) a
        LEFT JOIN (SELECT c_mktsegment AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""",
    "maintenance_counts": """
        SELECT o_orderkey, count(l_orderkey) AS n_updates FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "per_entity_event_stats": """
        SELECT user_id, count(*) AS n, min(ts) AS earliest, max(value) AS worst, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""",
    # strictly inside the validity window, both ends open
    "filter_within_validity_window": (
        """SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_shipdate > o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAYS""",
        """SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_shipdate > o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY""",
    ),
    "earliest_after": (
        """SELECT event_id, first_after FROM (SELECT event_id, event_type,
             min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '0.000001' SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS first_after
             FROM events) t WHERE event_type = 'error' AND first_after IS NOT NULL""",
        """
        SELECT e.event_id, min(p.ts) AS first_after
        FROM (SELECT * FROM events WHERE event_type = 'error') e JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
          ON e.user_id = p.user_id AND p.ts > e.ts GROUP BY 1""",
    ),
    "first_last_seen": (
        """WITH t AS (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2)
        SELECT user_id, event_type, first_seen, last_seen, last_seen = newest AS present FROM t CROSS JOIN (SELECT max(ts) AS newest FROM events) m""",
        """
        SELECT user_id, event_type, first_seen, last_seen, last_seen = max(last_seen) OVER () AS present
        FROM (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2) t""",
    ),
    # runs of one status per entity; a run's date is its last one
    "state_flows": """
        SELECT user_id, run, min(event_type) AS status, max(ts) AS run_end, count(*) AS n FROM (
          SELECT *, cast(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM (
            SELECT user_id, ts, event_id, event_type,
              CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS changed FROM events) a) b
        GROUP BY 1, 2""",
    # intervals as +1/-1 events and one running sum over the calendar
    "active_over_time_sweep": """
        SELECT d, cast(sum(sum(delta)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS bigint) AS n_active FROM (
          SELECT cast(o_orderdate AS date) AS d, 1 AS delta FROM orders
          UNION ALL SELECT cast(max(l_shipdate) AS date) AS d, -1 AS delta FROM lineitem GROUP BY l_orderkey) t GROUP BY d""",
    "dedup_keep_first": (
        """SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha2(text, 256)""",
        """
        SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1""",
    ),
    "dedup_duplicates": (
        """SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY sha2(text, 256) HAVING count(*) > 1""",
        """
        SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""",
    ),
    "exact_join_chain": """
        SELECT p_brand, count(DISTINCT s_suppkey) AS n_suppliers FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
    "semi_join_prune": """
        SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""",
    "anti_join_unknown": """
        SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "anti_join_parts": """
        SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)""",
    # all of an entity's required components are met
    "relational_division": """
        SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2""",
    "full_outer_merge_prefer_right": """
        SELECT coalesce(b.k, a.k) AS k, coalesce(nullif(b.seg, ''), a.seg) AS seg FROM
          (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) a
          FULL OUTER JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) END AS seg FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""",
    "pp_link_collect_set": (
        """SELECT r_name, array_join(array_sort(collect_set(n_name)), ',') AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""",
        """SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""",
    ),
    "digest16_key": (
        "SELECT c_custkey, substr(sha2(concat_ws('|', c_name, c_mktsegment), 256), 1, 16) AS dgst FROM customer",
        "SELECT c_custkey, substr(sha256(concat_ws('|', c_name, c_mktsegment)), 1, 16) AS dgst FROM customer",
    ),
    "top_n_per_group": """
        SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS rn FROM part) t WHERE rn <= 5""",
    "lowest_level": """
        SELECT o_custkey, min(o_orderpriority) AS lowest FROM orders GROUP BY 1""",
    "weighted_vote": """
        SELECT l_partkey, flag, w FROM (
          SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, flag) AS rn FROM (
            SELECT l_partkey, l_returnflag AS flag, round(sum(CASE WHEN l_linestatus = 'F' THEN 1.5e0 ELSE 1e0 END), 2) AS w FROM
              (SELECT l_partkey, l_returnflag, l_linestatus FROM lineitem) x GROUP BY 1, 2) y) z WHERE rn = 1""",
    "pearson_by_group": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
    "confusion_matrix": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    "sanitize_string_full": (
        r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-zA-Z0-9 .]', ' ')) AS clean FROM part",
        r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-zA-Z0-9 .]', ' ', 'g')) AS clean FROM part",
    ),
    "url_basename": (
        r"SELECT page_id, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS base FROM pages",
        r"SELECT page_id, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS base FROM pages",
    ),
    "keyword_counts_long": (
        r"""SELECT lang, k.kw, k.n FROM (SELECT lang, explode(array(struct('License' AS kw, a AS n), struct('the' AS kw, b AS n), struct('que' AS kw, c AS n), struct('der' AS kw, d AS n))) AS k
            FROM (SELECT lang, sum(size(regexp_extract_all(text, 'License', 0))) AS a, sum(size(regexp_extract_all(text, 'the', 0))) AS b, sum(size(regexp_extract_all(text, 'que', 0))) AS c,
                         sum(size(regexp_extract_all(text, 'der', 0))) AS d FROM documents GROUP BY 1) x) y""",
        r"SELECT lang, kw, cast(sum(len(regexp_extract_all(text, kw))) AS bigint) AS n FROM documents CROSS JOIN (SELECT unnest(['License', 'the', 'que', 'der']) AS kw) k GROUP BY 1, 2",
    ),
    "keyword_share_by_lang": """
        SELECT lang, round(avg(CASE WHEN text LIKE '%License%' THEN 1e0 ELSE 0e0 END), 6) AS share, count(*) AS n FROM documents GROUP BY 1""",
    "gap_fill_years": (
        """SELECT y, coalesce(n, 0) AS n FROM (SELECT explode(sequence(1990, 2000)) AS y) a
        LEFT JOIN (SELECT year(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1) b ON y = k""",
        """SELECT cast(y AS integer) AS y, coalesce(n, 0) AS n FROM (SELECT unnest(range(1990, 2001)) AS y) a
        LEFT JOIN (SELECT year(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1) b ON y = k""",
    ),
}


def run(spark, sf_dir: str, name: str, plans: dict | None = None):
    plan = (plans or PLANS)[name]
    text = plan if isinstance(plan, str) else plan[0]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in text}
    return spark.sql(_named(text, used), **used) if used else spark.sql(text)


def _named(text: str, used: dict) -> str:
    """Table names become parameters, so that no view outlives a query."""
    import re

    return re.sub(rf"(?i)\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", text)


QUERIES = {n: (lambda spark, sf_dir, n=n: run(spark, sf_dir, n)) for n in PLANS}
ORACLE_SQL = {n: (t if isinstance(t, str) else t[1]) for n, t in PLANS.items()}
