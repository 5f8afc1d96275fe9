"""Record linkage: name similarity, greedy assignment, dictionary cascade.

Candidates come from blocking on shared tokens, never from all pairs. Nulls
match nothing. Scores lie between 0 and 100.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.functions import columns
from vouchlake.staging import cut


def tokens(text: Column) -> Column:
    """Sorted distinct lower-case words."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))))


def edit_share(a: Column, b: Column) -> Column:
    """100 minus the edits' share of the longer text."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / longer))


def _indel(a: str, b: str) -> float:
    """Twice the longest common subsequence's share of both texts, in percent."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for ch in b:
        u = v & at.get(ch, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def _sorted_words(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _word_sets(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    sides = [f"{both} {s}".strip() for s in (left, right)]
    return max(_indel(*sides), *(_indel(both, s) for s in sides)) if both else _indel(left, right)


def _pairwise(score):
    """A column function of two texts from a Python one, in Arrow batches; null for a null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts by insertions and deletions alone, 0 to 100."""
    return _pairwise(_indel)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The ratio of the sorted words, repeats kept, in lower case."""
    return _pairwise(_sorted_words)(F.lower(a), F.lower(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best of: common words against either side, and side against side, in lower
    case; 100 where one side's words are all common."""
    return _pairwise(_word_sets)(F.lower(a), F.lower(b))


def name_rating(a: Column, b: Column) -> Column:
    """Best of the token-set ratio and 100 where one text, or its sorted words, lies inside the other; null for a null."""
    inside = lambda x, y: F.when(F.length(x) <= F.length(y), y.contains(x)).otherwise(x.contains(y))
    words = lambda c: F.array_join(F.array_sort(F.split(F.trim(F.lower(c)), "\\s+")), " ")
    some = (F.length(a) > 0) & (F.length(b) > 0)
    rating = F.when(some & (inside(a, b) | inside(words(a), words(b))), F.lit(100.0)).otherwise(token_set_ratio(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), rating)


#: Weights of the parts of a scheme entry's score, and what is taken off.
SCHEME_WEIGHTS, PENALTY = {"product": 6, "vendor": 6, "id": 4, "date": 2, "level": 2}, 2


def scheme_score(e: str, c: str, categories: tuple[str, ...] = ()) -> Column:
    """Score of a national scheme's entry (columns `e`_...) and a certificate (`c`_...), 0 to 100.

    Columns: scheme, cert_id, canonical_id (entry), product, vendor, category,
    report_hash, target_hash, level, valid_from. Certainties come first (same id 100,
    same names 99, same report 95, same target 93), then the weighted mean of the
    ratings whose two sides are known, less the penalty. An entry of another category
    scores 0 if its own is one of `categories` (any, where none are given).
    """
    at = lambda side, name: F.col(f"{side}_{name}")
    same = lambda name: F.coalesce(at(e, name) == at(c, name), F.lit(False))
    clean = lambda name: columns.plain_name(at(c, name))
    days = [f(at(e, "valid_from")) == f(at(c, "valid_from")) for f in (F.year, F.month, F.dayofmonth)]
    rated = {
        "product": name_rating(at(e, "product"), clean("product")),
        "vendor": name_rating(at(e, "vendor"), clean("vendor")),
        "id": name_rating(at(e, "cert_id"), at(c, "cert_id")),
        "date": F.lit(1) + sum((F.when(d, 33).otherwise(0) for d in days), F.lit(0)) + F.when(at(e, "valid_from").isNull() | at(c, "valid_from").isNull(), F.lit(None)).otherwise(0),
        "level": name_rating(at(e, "level"), at(c, "level")),
    }
    total = sum((F.when(r.isNotNull(), F.lit(w)).otherwise(0) for r, w in ((rated[k], w) for k, w in SCHEME_WEIGHTS.items())), F.lit(0))
    mean = sum((F.coalesce(rated[k] * w, F.lit(0.0)) for k, w in SCHEME_WEIGHTS.items()), F.lit(0.0)) / total
    named = at(e, "product").isNotNull() & at(e, "vendor").isNotNull() & at(c, "product").isNotNull() & at(c, "vendor").isNotNull()
    other_kind = at(e, "category").isNotNull() & ~same("category") & (at(e, "category").isin(*categories) if categories else F.lit(True))
    return (
        F.when(~same("scheme"), 0.0)
        .when(F.coalesce(at(e, "canonical_id") == at(c, "cert_id"), F.lit(False)), 100.0)
        .when(~named | other_kind, 0.0)
        .when(same("product") & same("vendor"), 99.0)
        .when(same("report_hash"), 95.0)
        .when(same("target_hash"), 93.0)
        .otherwise(F.greatest(F.lit(0.0), mean - PENALTY))
    )


def queue_score(e: str, c: str) -> Column:
    """Score of a queue entry and a certificate: standards must agree, some validation
    (`c`_validations, an array of dates) must come after the entry unless none is known."""
    at = lambda side, name: F.col(f"{side}_{name}")
    product, vendor = columns.plain_name(at(c, "product")), columns.plain_name(at(c, "vendor"))
    later = F.coalesce(F.size(at(c, "validations")) <= 0, F.lit(True)) | F.exists(at(c, "validations"), lambda d: d > at(e, "date"))
    fits = F.coalesce((at(e, "standard") == at(c, "standard")) & at(c, "product").isNotNull() & at(c, "vendor").isNotNull() & later, F.lit(False))
    rated = 0.5 * name_rating(at(e, "product"), product) + 0.5 * name_rating(at(e, "vendor"), vendor)
    exact = (at(e, "product") == product) & (at(e, "vendor") == vendor)
    return F.when(~fits, 0.0).when(exact, 99.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(rated, F.lit(0.0)) - PENALTY))


def blocked_pairs(left: DataFrame, right: DataFrame, key: str = "token") -> DataFrame:
    """(l, r) that share a token, for (l, l_name) and (r, r_name)."""
    a = left.select("l", F.explode(tokens(F.col("l_name"))).alias(key))
    b = right.select("r", F.explode(tokens(F.col("r_name"))).alias(key))
    return a.join(b, key).select("l", "r").distinct()


def greedy_assignment(pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """One-to-one pairs of each group: best score first, ties by (l, r).

    `pairs` has group, l, r, score; only scores at or over the threshold take part.
    Each round takes the pairs that are the best left for both their sides, which is
    what taking the best pair again and again comes to, and drops what they use up.
    """
    left = cut(pairs.where(F.col("score") >= threshold).select(group, "l", "r", "score"))
    taken = left.limit(0)
    order = F.struct((-F.col("score")).alias("s"), "l", "r")
    while not left.isEmpty():
        by_l = left.groupBy(group, "l").agg(F.min(order).alias("best")).select(group, "best.l", "best.r")
        by_r = left.groupBy(group, "r").agg(F.min(order).alias("best")).select(group, "best.l", "best.r")
        won = cut(left.join(by_l, [group, "l", "r"], "left_semi").join(by_r, [group, "l", "r"], "left_semi"))
        taken = taken.union(won)
        left = cut(left.join(won.select(group, "l"), [group, "l"], "left_anti").join(won.select(group, "r"), [group, "r"], "left_anti"))
    return taken


#: Steps of a value that are told apart where values are compared by nearness.
STEPS = 10_000


def _run(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy pairs by key inside a run of values an equal step apart, sides in turn."""
    held = {at: deque(own["key"]) for at, own in rows.sort_values("key").groupby("at")}
    sides = rows.groupby("at")["side"].first()
    at_of = rows[rows["side"] == "l"].sort_values("key")[["key", "at"]]
    won = []
    for key, at in at_of.itertuples(index=False):
        near = [held[o] for o in (at - 1, at + 1) if o in held and sides[o] == "r" and held[o]]
        if near:
            won.append((rows["group"].iloc[0], key, min(near, key=lambda q: q[0]).popleft()))
    return pd.DataFrame(won, columns=["group", "l", "r"])


def greedy_by_nearness(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """What `greedy_assignment` makes of all pairs of (group, l, value) and (group, r, value)
    with score round(100 - |difference|, 4), without those pairs.

    The best pair of all is next to each other among the values left. So a round takes all
    neighbours that are each other's nearest: equal values first, then two values by rank of
    their keys; runs of three or more values an equal step apart, whose ties are settled one
    after the other, each in a task. Values must be multiples of a STEPSth and keys distinct.
    """
    of = lambda df, key: df.select("group", F.lit(key).alias("side"), F.col(key).cast("long").alias("key"), F.round(F.col("value") * STEPS).cast("long").alias("u"))
    rest = cut(of(left, "l").union(of(right, "r")).where("group is not null and key is not null and u is not null"))
    most, taken = int(round((100 - threshold) * STEPS)), []

    def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
        """Pairs of the same rank of both sides."""
        own = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "side").orderBy("key")))
        side = lambda x: own.where(F.col("side") == x).select(*by, "rank", F.col("key").alias(x), F.col("u").alias(f"{x}_u"))
        return side("l").join(side("r"), [*by, "rank"]).select("group", "l", "r", "l_u", "r_u")

    def without(rows: DataFrame, won: DataFrame) -> DataFrame:
        gone = won.select("group", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("key")), F.struct(F.lit("r").alias("side"), F.col("r").alias("key")))).alias("x")).select("group", "x.*")
        return cut(rows.join(gone, ["group", "side", "key"], "left_anti"))

    if most >= 0:
        taken.append(cut(ranked(rest, ["group", "u"])))
        rest = without(rest, taken[-1])
    line = Window.partitionBy("group").orderBy("u")
    up, down = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    while most >= 0:
        # each value has one side now; its nearest of the other side, below and above
        sides = rest.groupBy("group", "u").agg(F.min("side").alias("side"))
        at = lambda x, w, pick: pick(F.when(F.col("side") == x, F.col("u")), ignorenulls=True).over(w)
        other = lambda w, pick: F.when(F.col("side") == "l", at("r", w, pick)).otherwise(at("l", w, pick))
        below, above = F.col("u") - other(up, F.last), other(down, F.first) - F.col("u")
        gaps = sides.select("group", "u", "side", F.least(below, above).alias("gap"), F.coalesce(below == above, F.lit(False)).alias("tied")).where(F.col("gap") <= most)
        joined = (F.lag("u").over(line) + F.col("gap") == F.col("u")) & (F.lag("gap").over(line) == F.col("gap")) & (F.lag("side").over(line) != F.col("side"))
        linked = gaps.withColumn("linked", F.coalesce(joined, F.lit(False)))
        # a value as near to one below as to one above waits until both have it as their nearest
        waits = F.col("tied") & ~(F.col("linked") & F.lead("linked", 1, False).over(line))
        runs = linked.withColumn("waits", waits).withColumn("run", F.sum((~F.col("linked")).cast("int")).over(line))
        whole = Window.partitionBy("group", "run")
        sized = runs.withColumn("size", F.when(~F.max("waits").over(whole), F.count("*").over(whole)).otherwise(0)).withColumn("at", F.row_number().over(whole.orderBy("u")))
        # values out of reach of all others are left out for good
        met = cut(rest.join(sized.select("group", "u", "run", "size", "at"), ["group", "u"]))
        if met.isEmpty():
            break
        rest = met.select("group", "side", "key", "u")
        two = ranked(met.where("size = 2"), ["group", "run"])
        long = met.where("size > 2")
        by_key = long.groupBy("group", "run").applyInPandas(_run, "group string, l long, r long")
        value = lambda x: long.where(F.col("side") == x).select("group", F.col("key").alias(x), F.col("u").alias(f"{x}_u"))
        taken.append(cut(two.union(by_key.join(value("l"), ["group", "l"]).join(value("r"), ["group", "r"]).select("group", "l", "r", "l_u", "r_u"))))
        rest = without(rest, taken[-1])
    none = rest.select("group", F.col("key").alias("l"), F.col("key").alias("r"), F.col("u").alias("l_u"), F.col("u").alias("r_u")).limit(0)
    return reduce(DataFrame.union, taken or [none]).select("group", "l", "r", F.round(100 - F.abs(F.col("l_u") - F.col("r_u")) / STEPS, 4).alias("score"))


def cascade_match(products: DataFrame, dictionary: DataFrame, most: int = 99, threshold: float = 92.0) -> DataFrame:
    """(id, key, score, step): dictionary names of the same vendor and version, at
    or over the threshold; where none, of any version marked '-' with exact score.

    products: id, vendor, name, version; dictionary: key, vendor, title, version.
    Candidates share vendor and version, or vendor and the longest word of the one
    whose words all lie in the other, so that no vendor meets its whole catalogue.
    """
    d = dictionary.select("key", F.col("vendor").alias("d_vendor"), "title", F.col("version").alias("d_version"))
    same = products.join(d, (F.col("vendor") == F.col("d_vendor")) & (F.col("version") == F.col("d_version")))
    first = same.withColumn("score", token_set_ratio(F.col("name"), F.col("title"))).where(F.col("score") >= threshold).withColumn("step", F.lit(1)).select("id", "key", "score", "step")
    first = cut(first)
    words = lambda c: F.array_distinct(F.split(F.trim(F.lower(c)), "\\s+"))
    longest = lambda c: F.array_max(F.transform(words(c), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rest = products.join(first.select("id").distinct(), "id", "left_anti").select("id", "vendor", "name")
    free = d.where("d_version = '-'").select("key", F.col("d_vendor").alias("vendor"), "title")
    inner = rest.select("id", "vendor", "name", F.explode(words(F.col("name"))).alias("w")).join(free.withColumn("w", longest(F.col("title"))), ["vendor", "w"])
    outer = rest.withColumn("w", longest(F.col("name"))).join(free.select("key", "vendor", "title", F.explode(words(F.col("title"))).alias("w")), ["vendor", "w"])
    met = inner.select("id", "key", "name", "title").union(outer.select("id", "key", "name", "title")).distinct()
    whole = (F.size(F.array_except(words(F.col("name")), words(F.col("title")))) == 0) | (F.size(F.array_except(words(F.col("title")), words(F.col("name")))) == 0)
    second = met.where(whole).select("id", "key", F.lit(100.0).alias("score"), F.lit(2).alias("step"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.desc("key")))
    return first.union(second).withColumn("rank", rank).where(F.col("rank") <= most).select("id", "key", F.round("score", 4).alias("score"), "step")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def fuzzy_pairs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit ratio between the names of neighbouring parts."""
    p = _parts(spark, sf_dir).select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.round(edit_share(F.col("p_name"), F.col("other")), 6).alias("score"))


def greedy_assignment_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts assigned to odd ones of their brand and size, price likeness as the score."""
    p = _parts(spark, sf_dir).select("p_partkey", "p_brand", "p_size", "p_retailprice")
    known = p.where("p_brand is not null and p_size is not null").select(F.concat_ws("|", "p_brand", "p_size").alias("group"), "p_partkey", F.col("p_retailprice").alias("value"))
    l = known.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "l")
    r = known.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "r")
    fine = (F.round(F.col("value") * STEPS) / STEPS == F.col("value")) & (F.abs("value") < 1e9)
    repeated = known.groupBy("p_partkey").count().where("count > 1")
    if known.where("value is not null").where(~fine).isEmpty() and repeated.isEmpty():
        return greedy_by_nearness(l, r, 0.0)
    pairs = l.withColumnRenamed("value", "a").join(r.withColumnRenamed("value", "b"), "group").withColumn("score", F.round(100 - F.abs(F.col("a") - F.col("b")), 4))
    return greedy_assignment(pairs, "group", 0.0)


def name_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ratios between the names of neighbouring parts."""
    p = _parts(spark, sf_dir).select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    a, b = F.col("p_name"), F.col("other")
    return both.select("p_partkey", F.round(ratio(a, b), 6).alias("ratio"), F.round(token_sort_ratio(a, b), 6).alias("sort_ratio"), F.round(token_set_ratio(a, b), 6).alias("set_ratio"))


def cpe_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a dictionary made of the parts' own brands, names and sizes."""
    p = _parts(spark, sf_dir)
    products = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"))
    entries = p.groupBy(F.col("p_brand").alias("vendor"), F.col("p_name").alias("title")).agg(F.min("p_size").alias("v"))
    dictionary = entries.select(F.concat_ws(":", "vendor", "title").alias("key"), "vendor", "title", F.when(F.col("v") % 2 == 0, F.lit("-")).otherwise(F.col("v").cast("string")).alias("version"))
    return cascade_match(products, dictionary)


def _lcs(a: str, b: str) -> str:
    """SQL of the longest common subsequence's length, row by row of the usual table."""
    codes = lambda x: f"list_transform(range(1, length({x}) + 1), lambda i: [ascii(substr({x}, i, 1))::BIGINT])"
    start = f"[list_transform(range(0, length({b}) + 1), lambda i: 0::BIGINT)]"
    cell = f"CASE WHEN c[1] = ascii(substr({b}, j[1], 1)) THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], new[-1]) END"
    line = f"list_reduce([[0::BIGINT]] || list_transform(range(1, length({b}) + 1), lambda k: [k]), lambda new, j: list_append(new, {cell}))"
    return f"list_reduce({start} || {codes(a)}, lambda old, c: {line})[-1]"


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE 200e0 * {_lcs(a, b)} / (length({a}) + length({b})) END"


#: Of pairs x (k, a, b): their sorted words, the words of both, and of either alone.
_WORDS = """SELECT *, list_sort(string_split_regex(lower(a), '\\s+')) AS wa, list_sort(string_split_regex(lower(b), '\\s+')) AS wb FROM x"""
_SIDES = f"""SELECT *, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, array_to_string(list_sort(list_filter(list_distinct(wa), lambda w: list_contains(wb, w))), ' ') AS c,
    array_to_string(list_sort(list_filter(list_distinct(wa), lambda w: NOT list_contains(wb, w))), ' ') AS l, array_to_string(list_sort(list_filter(list_distinct(wb), lambda w: NOT list_contains(wa, w))), ' ') AS r FROM ({_WORDS})"""
_RATED = f"""SELECT *, CASE WHEN c = '' THEN {_sql_ratio("l", "r")} WHEN l = '' OR r = '' THEN 100e0
    ELSE greatest({_sql_ratio("cl", "cr")}, {_sql_ratio("c", "cl")}, {_sql_ratio("c", "cr")}) END AS set_ratio FROM (SELECT *, trim(c || ' ' || l) AS cl, trim(c || ' ' || r) AS cr FROM ({_SIDES}))"""
QUERIES = {f.__name__: f for f in (fuzzy_pairs_score, name_ratios, greedy_assignment_brands, cpe_cascade_match)}
ORACLE_SQL = {
    "fuzzy_pairs_score": """
        SELECT a.p_partkey, round(100.0e0 * (1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))), 6) AS score
        FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey""",
    # names are few, so that each pair of them is rated once
    "name_ratios": f"""
        WITH n AS (SELECT a.p_partkey AS k, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey), x AS (SELECT DISTINCT a, b FROM n), y AS ({_RATED})
        SELECT k AS p_partkey, round({_sql_ratio("n.a", "n.b")}, 6) AS ratio, round({_sql_ratio("sa", "sb")}, 6) AS sort_ratio, round(set_ratio, 6) AS set_ratio FROM n JOIN y USING (a, b)""",
    # the pairs of a group in order, each taken unless one of its sides is taken
    "greedy_assignment_brands": """
        WITH e AS (SELECT concat(a.p_brand, '|', a.p_size) AS g, a.p_partkey AS l, b.p_partkey AS r, round(100 - abs(a.p_retailprice - b.p_retailprice), 4) AS score
                   FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1),
        o AS (SELECT g, list({'l': l, 'r': r, 'score': score} ORDER BY score DESC, l, r) AS pairs FROM e WHERE score >= 0 GROUP BY 1),
        t AS (SELECT g, unnest(list_reduce(list_transform(pairs, lambda p: [p]), lambda had, p: CASE WHEN len(list_filter(had, lambda h: h.l = p[1].l OR h.r = p[1].r)) > 0 THEN had ELSE list_concat(had, p) END)) AS p FROM o)
        SELECT g AS "group", p.l AS l, p.r AS r, p.score AS score FROM t""",
    "cpe_cascade_match": f"""
        WITH d AS (SELECT concat_ws(':', p_brand, p_name) AS key, p_brand AS v, p_name AS title, CASE WHEN min(p_size) % 2 = 0 THEN '-' ELSE min(p_size)::VARCHAR END AS version FROM part GROUP BY 2, 3),
        x AS (SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT p_name AS n FROM part) a, (SELECT DISTINCT p_name AS n FROM part) b), y AS ({_RATED}),
        one AS (SELECT p_partkey AS id, key, set_ratio AS score, 1 AS step FROM part JOIN d ON v = p_brand AND version = p_size::VARCHAR JOIN y ON a = p_name AND b = title WHERE set_ratio >= 92),
        two AS (SELECT p_partkey AS id, key, 100e0 AS score, 2 AS step FROM part JOIN d ON v = p_brand AND version = '-' JOIN y ON a = p_name AND b = title
                WHERE p_partkey NOT IN (SELECT id FROM one) AND (l = '' OR r = '')),
        z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, key DESC) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two))
        SELECT id, key, round(score, 4) AS score, step FROM z WHERE n <= 99""",
}
