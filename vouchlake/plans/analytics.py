"""Further plans of the analytics surface: pivots, priorities, ranks, sets, features.

As in ``relational``: one SQL text, or a pair where the dialects differ.
"""

from __future__ import annotations

from vouchlake.plans import relational

# parts, folded over all suppliers, that refer to the suppliers of their lines
_REFS = """(SELECT DISTINCT l_partkey % m AS src, l_suppkey AS dst FROM (SELECT l_partkey, l_suppkey, (SELECT count(*) FROM supplier) AS m FROM lineitem) x
        WHERE l_partkey % m <> l_suppkey)"""
_TOKENS = ("split(text, ' ')", "string_split(text, ' ')")

PLANS: dict[str, str | tuple[str, str]] = {
    "keyword_matrix_pivot": """
        SELECT lang, count(*) FILTER (WHERE text LIKE '%License%') AS n_license, count(*) FILTER (WHERE text LIKE '%@%') AS n_at,
               count(*) FILTER (WHERE text LIKE '%http%') AS n_http FROM documents GROUP BY 1""",
    # comma list split, noise tokens away
    "security_level_split": (
        "SELECT o_orderkey, array_join(array_sort(array_except(split(replace(o_orderpriority, '-', ','), ','), array('4', 'NOT SPECIFIED'))), ',') AS levels FROM orders",
        "SELECT o_orderkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(replace(o_orderpriority, '-', ','), ','), lambda x: x NOT IN ('4', 'NOT SPECIFIED')))), ','), '') AS levels FROM orders",
    ),
    "version_extract": (
        r"SELECT s_suppkey, coalesce(nullif(regexp_extract(s_name, '([0-9]+)', 1), ''), '-') AS version FROM supplier",
        r"SELECT s_suppkey, coalesce(nullif(regexp_extract(s_name, '([0-9]+)', 1), ''), '-') AS version FROM supplier",
    ),
    "maintenance_dates_list": (
        "SELECT l_orderkey, array_join(array_sort(collect_list(date_format(l_shipdate, 'yyyy-MM-dd'))), ',') AS dates FROM lineitem GROUP BY 1",
        "SELECT l_orderkey, string_agg(strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY l_shipdate) AS dates FROM lineitem GROUP BY 1",
    ),
    # the latest earlier purchase of the same user; one sort, no join
    "asof_latest_before": (
        """SELECT event_id, last_purchase FROM (SELECT event_id, event_type,
             last(CASE WHEN event_type = 'purchase' THEN ts END, true) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase
             FROM events) t WHERE event_type = 'error'""",
        """SELECT e.event_id, p.ts AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
           ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    ),
    "fill_down": (
        """SELECT event_id, last(CASE WHEN event_id % 3 = 0 THEN event_type END, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""",
        """SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""",
    ),
    "argmax_tiebreak": """
        SELECT n AS nation, s_suppkey FROM (SELECT s_nationkey AS n, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, length(s_name) DESC, s_suppkey DESC) AS rn FROM supplier) t WHERE rn = 1""",
    # a value from the strongest source that has one; inside a source the highest
    "priority_resolution": """
        SELECT p_brand, coalesce(max(CASE WHEN p_size > 45 THEN p_size END), max(CASE WHEN p_type = 'ECONOMY' THEN p_size END), max(p_size)) AS size,
               CASE WHEN max(CASE WHEN p_size > 45 THEN 1 END) = 1 THEN 'first' WHEN max(CASE WHEN p_type = 'ECONOMY' THEN 1 END) = 1 THEN 'second' ELSE 'third' END AS origin
        FROM part GROUP BY 1""",
    "union_exact_and_config": """
        SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_totalprice > 300000
        UNION SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2""",
    "weaker_reference_pairs": f"""
        SELECT r.src, r.dst FROM {_REFS} r JOIN (SELECT s_suppkey, s_acctbal FROM supplier) a ON a.s_suppkey = r.src
        JOIN (SELECT s_suppkey, s_acctbal FROM supplier) b ON b.s_suppkey = r.dst WHERE b.s_acctbal < a.s_acctbal""",
    "mutual_references": f"SELECT a.src, a.dst FROM {_REFS} a JOIN {_REFS} b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
    "group_matrix": f"""
        SELECT a.s_nationkey AS from_group, b.s_nationkey AS to_group, count(*) AS n FROM {_REFS} r
        JOIN supplier a ON a.s_suppkey = r.src JOIN supplier b ON b.s_suppkey = r.dst GROUP BY 1, 2""",
    # average ranks, then Pearson's coefficient of the ranks; rows are counted by value first, and
    # a value's rank is the rows in lower ranges of values, those below it in its range, and half its own
    "spearman_by_group": (
        """
        WITH pairs AS (SELECT l_returnflag AS f, l_quantity AS q, l_extendedprice AS p, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
        v AS (SELECT f, 'q' AS c, q AS v, sum(n) AS n FROM pairs GROUP BY 1, 2, 3 UNION ALL SELECT f, 'p' AS c, p AS v, sum(n) AS n FROM pairs GROUP BY 1, 2, 3),
        r AS (SELECT f, c, floor(v / 1000) AS part, sum(n) AS n FROM v GROUP BY 1, 2, 3),
        below AS (SELECT f, c, part, sum(n) OVER (PARTITION BY f, c ORDER BY part) - n AS n FROM r),
        ranks AS (SELECT v.f, v.c, v.v, below.n + sum(v.n) OVER (PARTITION BY v.f, v.c, below.part ORDER BY v.v) - v.n + (v.n + 1) / 2e0 AS rk
                  FROM v JOIN below ON below.f = v.f AND below.c = v.c AND below.part = floor(v.v / 1000)),
        x AS (SELECT pairs.f, cast(pairs.n AS double) AS n, a.rk AS a, b.rk AS b FROM pairs JOIN ranks a ON a.f = pairs.f AND a.c = 'q' AND a.v = pairs.q JOIN ranks b ON b.f = pairs.f AND b.c = 'p' AND b.v = pairs.p),
        m AS (SELECT f, sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b FROM x GROUP BY 1)
        SELECT x.f AS l_returnflag, round(sum(x.n * (x.a - m.a) * (x.b - m.b)) / sqrt(sum(x.n * (x.a - m.a) * (x.a - m.a)) * sum(x.n * (x.b - m.b) * (x.b - m.b))), 6) AS rho, cast(sum(x.n) AS bigint) AS n
        FROM x JOIN m ON m.f = x.f GROUP BY 1""",
        """
        SELECT l_returnflag, round(corr(rq, rp), 6) AS rho, count(*) AS n FROM (SELECT l_returnflag,
          rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0 AS rq,
          rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2e0 AS rp FROM lineitem) t GROUP BY 1""",
    ),
    "describe_quantiles": (
        """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS lo,
           percentile(l_quantity, 0.25D) AS q25, percentile(l_quantity, 0.5D) AS q50, percentile(l_quantity, 0.75D) AS q75, max(l_quantity) AS hi FROM lineitem GROUP BY 1""",
        """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS lo,
           quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS hi FROM lineitem GROUP BY 1""",
    ),
    "histogram_bins": "SELECT cast(floor(l_extendedprice / 10000) AS bigint) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "pivot_counts": """
        SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_f, count(*) FILTER (WHERE l_linestatus = 'O') AS n_o FROM lineitem GROUP BY 1""",
    "unpivot_counts": """
        SELECT l_returnflag, 'low' AS kind, count(*) FILTER (WHERE l_quantity < 25) AS n FROM lineitem GROUP BY 1
        UNION ALL SELECT l_returnflag, 'high' AS kind, count(*) FILTER (WHERE l_quantity >= 25) AS n FROM lineitem GROUP BY 1""",
    "top_n_weakness": """
        SELECT p_type, p_brand, n FROM (SELECT p_type, p_brand, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rn
          FROM (SELECT p_type, p_brand, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2) a) b WHERE rn <= 10""",
    "set_ops_arrays": (
        f"""SELECT doc_id, size(array_distinct(w)) AS n_distinct, size(array_intersect(w, array('the', 'and', 'que', 'der'))) AS n_both,
            size(array_except(array('the', 'and', 'que', 'der'), w)) AS n_missing, size(array_union(w, array('the', 'and', 'que', 'der'))) AS n_union
            FROM (SELECT doc_id, {_TOKENS[0]} AS w FROM documents WHERE text IS NOT NULL) t""",
        f"""SELECT doc_id, cast(len(list_distinct(w)) AS integer) AS n_distinct, cast(len(list_intersect(list_distinct(w), ['the', 'and', 'que', 'der'])) AS integer) AS n_both,
            cast(4 - len(list_intersect(list_distinct(w), ['the', 'and', 'que', 'der'])) AS integer) AS n_missing, cast(len(list_distinct(list_concat(w, ['the', 'and', 'que', 'der']))) AS integer) AS n_union
            FROM (SELECT doc_id, {_TOKENS[1]} AS w FROM documents WHERE text IS NOT NULL) t""",
    ),
    # multiset overlap of character pairs between neighbours; a part's pairs are counted once for
    # itself and once for the part before it, so that counts meet by
    # grouping and nothing is broadcast; dealt before they are counted, as few tasks read the table
    "ngram_overlap": (
        """SELECT p_partkey, cast(sum(least(n, m)) AS bigint) AS overlap FROM
           (SELECT p_partkey, g, count_if(own) AS n, count_if(NOT own) AS m FROM
             (SELECT s.k AS p_partkey, g, s.own FROM
               (SELECT p_partkey AS k, explode(transform(sequence(1, greatest(1, length(p_name) - 1)), i -> substr(p_name, i, 2))) AS g FROM part) x
               LATERAL VIEW inline(array(struct(x.k AS k, true AS own), struct(x.k - 1 AS k, false AS own))) s WHERE s.k IS NOT NULL AND g IS NOT NULL DISTRIBUTE BY p_partkey) z GROUP BY 1, 2) y
           WHERE n > 0 AND m > 0 GROUP BY 1""",
        """WITH c AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(range(1, greatest(1, length(p_name) - 1) + 1), lambda i: substr(p_name, i, 2))) AS g FROM part) GROUP BY 1, 2)
           SELECT a.p_partkey, cast(sum(least(a.n, b.n)) AS bigint) AS overlap FROM c a JOIN c b ON a.p_partkey + 1 = b.p_partkey AND a.g = b.g GROUP BY 1""",
    ),
    "name_features": """
        SELECT a.p_partkey, abs(length(a.p_name) - length(b.p_name)) AS length_gap, substr(a.p_name, 1, 3) = substr(b.p_name, 1, 3) AS same_start,
               right(a.p_name, 3) = right(b.p_name, 3) AS same_end, levenshtein(a.p_name, b.p_name) AS edits
        FROM (SELECT p_partkey, p_name FROM part) a JOIN (SELECT p_partkey, p_name FROM part) b ON a.p_partkey + 1 = b.p_partkey""",
    "json_pick_metric": (
        "SELECT event_id, coalesce(cast(get_json_object(props, '$.score') AS double), cast(get_json_object(props, '$.k') AS double)) AS metric FROM events",
        "SELECT event_id, coalesce(cast(json_extract_string(props, '$.score') AS double), cast(json_extract_string(props, '$.k') AS double)) AS metric FROM events",
    ),
    "html_links_titles": (
        r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_join(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links FROM pages""",
        r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links FROM pages""",
    ),
    # a sentence with its neighbours on both sides
    "context_segments": (
        """SELECT doc_id, cast(pos AS bigint) AS at, md5(array_join(slice(s, greatest(pos, 1), least(pos, 1) + 2), ' ')) AS segment_md5
           FROM (SELECT doc_id, s, posexplode(s) AS (pos, one) FROM (SELECT doc_id, split(text, '[.] ') AS s FROM documents) a) b WHERE one LIKE '%License%'""",
        """SELECT doc_id, pos AS at, md5(array_to_string(s[greatest(pos, 1):pos + 2], ' ')) AS segment_md5
           FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents)) WHERE s[pos + 1] LIKE '%License%'""",
    ),
    # agreement of two annotators, raw and beyond chance
    "label_agreement_kappa": """
        SELECT round(po, 8) AS agreement, round((po - pe) / (1 - pe), 8) AS kappa FROM (
          SELECT avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END) AS po,
                 avg(quality * 1e0) * avg(toxic * 1e0) + (1 - avg(quality * 1e0)) * (1 - avg(toxic * 1e0)) AS pe FROM labels) t""",
    "classifier_metrics": """
        SELECT round(tp / (tp + fp), 8) AS prec, round(tp / (tp + fn), 8) AS rec, round(2 * tp / (2 * tp + fp + fn), 8) AS f1,
               round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) AS balanced_accuracy FROM (
          SELECT sum(CASE WHEN guess = 1 AND quality = 1 THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN guess = 1 AND quality = 0 THEN 1e0 ELSE 0e0 END) AS fp,
                 sum(CASE WHEN guess = 0 AND quality = 1 THEN 1e0 ELSE 0e0 END) AS fn, sum(CASE WHEN guess = 0 AND quality = 0 THEN 1e0 ELSE 0e0 END) AS tn
          FROM (SELECT quality, CASE WHEN length(text) > 200 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d ON l.doc_id = d.doc_id) a) b""",
}

QUERIES = {n: (lambda spark, sf_dir, n=n: relational.run(spark, sf_dir, n, PLANS)) for n in PLANS}
ORACLE_SQL = {n: (t if isinstance(t, str) else t[1]) for n, t in PLANS.items()}
