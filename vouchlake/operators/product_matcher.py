"""Products to dictionary entries, as a Spark ML estimator and its model.

`ProductMatcher.fit` takes a dictionary (uri, title) and leaves out entries that say
nothing (weak names, short items); the model holds two tables, the versions of each
vendor and the items of each vendor and version, and writes and reads them as Parquet.

`predict` takes products (key, vendor, name, versions) through four steps, the first
with a match deciding: (1) entries of a vendor candidate and a fitting version whose title
is as like the name as the threshold asks; (2) the same with titles made up from the
entry's parts where it has none, and with the item's name alone if it fits exactly;
(3) as (2) among entries without a version, exact fits only; (4) as (1) among those,
which can add nothing to (3). Platforms named by the title must fit; a service pack or
release that the name asks for is the least that an entry may have, and entries that
name none pass only if no candidate names one.

An exact fit means that all words of one text are words of the other, or that one text,
or its sorted words, lies inside the other. The longest word of the inner text then lies
inside a word of the outer one: entries without a version, of which a vendor may have
many, are met by its first characters, and never vendor by vendor.

Null names, vendors and titles match nothing; nulls in `versions` are passed over.
Repeated entries count once. An empty dictionary or table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.functions import columns
from vouchlake.operators.matching import token_set_ratio
from vouchlake.staging import written

LEAST_ITEM, LEAST_TITLE, GRAM = 4, 5, 4
#: So many parts products and entries are dealt in before their texts are read: a small file is one task of the scan.
PARTS = 48
#: Entries too weak to count, and the item whose bare name says nothing.
WEAK_URIS = ("cpe:2.3:o:microsoft:windows:-:*:*:*:*:*:x64:*", "cpe:2.3:o:microsoft:windows:-:*:*:*:*:*:x86:*")
BARE_ITEM = "big-ip"
#: Mentions of service packs and releases.
UPDATES = {"pack": r"(?i)(?:sp|service pack)\s?(\d{1,2})", "release": r"(?i)(?:r|release)\s?(\d{1,2})"}


def weak_entry(uri: Column, title: Column, item: Column, version: Column, update: Column) -> Column:
    """Whether an entry says too little: no version and no digit in its name, a release candidate, or a known one."""
    name = F.coalesce(F.nullif(title, F.lit("")), item)
    return (version.isin("-", "*") & (name != "") & ~name.rlike("[0-9]")) | update.rlike(r"^rc\d{0,2}$") | uri.isin(*WEAK_URIS)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


def _inside(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & F.when(F.length(a) <= F.length(b), b.contains(a)).otherwise(a.contains(b))


def same_words(a: Column, b: Column) -> Column:
    """Whether all words of one text, and some, are words of the other."""
    x, y = words(a), words(b)
    return F.arrays_overlap(x, y) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def exact_fit(a: Column, b: Column) -> Column:
    return same_words(a, b) | _inside(a, b) | _inside(_sorted(a), _sorted(b))


def plain_versions(name: Column, versions: Column) -> Column:
    """A name in which `version 1.2` and `v1.2` are the bare version."""
    form = lambda v: F.concat(F.lit(r"(?i)(?:\bversion\s*"), v, F.lit(r"+) | (?:\bv\s*"), v, F.lit("+)"))
    return F.aggregate(F.array_compact(versions), name, lambda text, v: F.regexp_replace(text, form(v), F.concat(F.lit(" "), v, F.lit(" "))))


def platform_text(text: Column) -> Column:
    """The platforms a text names, as a text that names the same."""
    return F.replace(F.array_join(columns.platforms(F.coalesce(text, F.lit(""))), " "), F.lit("_"), F.lit(" "))


def dictionary_items(dictionary: DataFrame) -> DataFrame:
    """The entries that count, with the texts and numbers that matching reads."""
    uri, title = F.col("uri"), F.coalesce("title", F.lit(""))
    parts = dictionary.where("uri is not null").repartition(PARTS, "uri").groupBy("uri").agg(F.max("title").alias("title")).select(
        "uri", title.alias("title"), columns.cpe_name(uri, 3).alias("vendor"), columns.cpe_name(uri, 4).alias("item"),
        columns.cpe_version(uri).alias("version"), columns.cpe_part(uri, 6).alias("update"), columns.cpe_part(uri, 11).alias("hardware"),
    )
    kept = parts.where(~weak_entry(F.col("uri"), F.col("title"), F.col("item"), F.col("version"), F.coalesce("update", F.lit(""))) & (F.length("item") >= LEAST_ITEM))
    made = columns.plain_name(F.when(F.col("title") != "", F.col("title")).otherwise(F.concat_ws(" ", "vendor", "item", "version", "update", "hardware")))
    stripped = F.regexp_replace("loose", F.concat(F.lit(r"\b\Q"), F.col("vendor"), F.lit(r"\E\b")), F.lit(""))
    said = F.concat(F.coalesce("update", F.lit("")), F.col("title"))
    numbers = [F.nullif(F.regexp_extract(F.coalesce("update", F.lit("")), p, 1), F.lit("")).cast("int").alias(f"{k}_of") for k, p in UPDATES.items()]
    return kept.withColumn("loose", made).where(F.length("loose") >= LEAST_TITLE).select(
        "uri", "vendor", "version", "hardware", "title", "loose", (F.col("title") != "").alias("titled"), stripped.alias("stripped"),
        columns.plain_name(F.col("item")).alias("item"), (F.col("item") != BARE_ITEM).alias("telling"),
        *numbers, *[said.rlike(p).alias(f"{k}_said") for k, p in UPDATES.items()],
    )


def _wanted(products: DataFrame) -> DataFrame:
    name = columns.plain_name(F.col("name"))
    p = products.select("key", "vendor", "name", F.coalesce("versions", F.array().cast("array<string>")).alias("versions")).where("key is not null and name is not null and vendor is not null")
    p = p.repartition(PARTS, "key").dropDuplicates(["key"]).withColumn("plain", name).withColumn("std", plain_versions(F.col("plain"), F.col("versions")))
    return p.withColumns({"pack": columns.service_pack(F.col("plain")), "release": columns.release(F.col("plain"))})


def _updated(any_pack: Column, any_release: Column) -> Column:
    """Whether an entry is as new as the name asks; where it names none, whether no candidate does."""
    by = lambda kind, some: F.when(F.col(f"{kind}_of").isNotNull(), F.col(f"{kind}_of") >= F.col(kind)).otherwise(~some)
    return F.when(F.col("pack").isNotNull(), by("pack", any_pack)).when(F.col("release").isNotNull(), by("release", any_release)).otherwise(True)


def _fits() -> Column:
    return columns.platform_fits(F.col("name"), F.col("hardware"), F.col("title"))


def _exact(text: str) -> Column:
    return exact_fit(F.col("plain"), F.col(text)) | exact_fit(F.col("std"), F.col(text))


def _bare() -> Column:
    """The fits that the second step adds: the title without its vendor, or the item's name."""
    one = lambda t: same_words(F.col("plain"), F.col(t)) | _inside(F.col("plain"), F.col(t))
    return F.col("telling") & (one("stripped") | one("item"))


def _keys(texts: list[str]) -> Column:
    """How the longest word of each text begins."""
    longest = [F.array_max(F.transform(words(F.col(t)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"] for t in texts]
    return F.array_distinct(F.array_compact(F.array(*[F.substring(w, 1, GRAM) for w in longest])))


def _grams(texts: list[str], sizes: Column) -> Column:
    """All stretches of the texts' words that have so many characters (an array)."""
    every = F.array_distinct(F.flatten(F.array(*[words(F.col(t)) for t in texts])))
    cuts = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(every, lambda w: F.flatten(F.transform(sizes, lambda n: cuts(w, n))))))


def _sizes(keys: DataFrame) -> DataFrame:
    """vendor and the lengths its keys have, GRAM at most: no others are looked for."""
    return keys.groupBy("vendor").agg(F.collect_set(F.length("g")).alias("sizes"))


def _by_version(asked: DataFrame, makers: DataFrame, versions: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(key, uri, score, step) of the first two steps."""
    pairs = makers.join(versions, "vendor").join(asked.select("key", "versions"), "key").where(columns.version_fits(F.col("version"), F.col("versions"))).select("key", "vendor", "version")
    # an entry has one vendor and version, so that each product meets it once
    met = pairs.join(items, ["vendor", "version"]).repartition(PARTS, "key").join(asked.drop("vendor", "versions"), "key").where(_fits())
    group = Window.partitionBy("key")
    met = met.withColumns({f"any_{k}": F.bool_or(f"{k}_said").over(group) for k in UPDATES}).where(_updated(F.col("any_pack"), F.col("any_release")))
    exact, score = F.col("exact"), F.col("score")
    # texts that fit exactly, and the second of two equal ones, are not rated: nulls pass the rating by
    rated = lambda t, needed: token_set_ratio(F.when(needed, F.col(t)), F.col("loose"))
    ratio = F.greatest(rated("plain", ~exact), rated("std", ~exact & (F.col("std") != F.col("plain"))))
    scored = met.withColumn("exact", _exact("loose")).withColumn("score", F.when(exact, 100.0).otherwise(ratio))
    scored = scored.withColumn("eased", F.when(exact | _bare(), 100.0).otherwise(score))
    firm = F.when(F.col("titled") & (score >= threshold), F.struct(score.alias("score"), F.lit(1).alias("step")))
    eased = F.when(F.col("eased") >= threshold, F.struct(F.col("eased").alias("score"), F.lit(2).alias("step")))
    return scored.select("key", "uri", F.explode(F.array_compact(F.array(firm, eased))).alias("s")).select("key", "uri", "s.*")


def _by_name(asked: DataFrame, makers: DataFrame, items: DataFrame) -> DataFrame:
    """(key, uri, score, step) of the third step."""
    free = items.where("version = '-'")
    # whether any entry of the vendor that fits the platform names an update: by a few kinds of entries a vendor
    kinds = free.groupBy("vendor", F.when(F.col("hardware") == "*", F.lit("*")).otherwise(platform_text(F.col("hardware"))).alias("hardware"), platform_text(F.col("title")).alias("title")).agg(
        *[F.bool_or(f"{k}_said").alias(f"{k}_said") for k in UPDATES]
    )
    named = makers.join(kinds, "vendor").join(asked.select("key", "name"), "key").where(_fits()).groupBy("key").agg(*[F.bool_or(f"{k}_said").alias(f"any_{k}") for k in UPDATES])
    mine = makers.join(asked.select("key", "plain", "std"), "key")
    theirs, ours = ["loose", "stripped", "item"], ["plain", "std"]
    sought, asking = (df.select(k, "vendor", F.explode(_keys(t)).alias("g")) for df, k, t in ((free, "uri", theirs), (mine, "key", ours)))
    outer = mine.join(_sizes(sought), "vendor").select("key", "vendor", F.explode(_grams(ours, F.col("sizes"))).alias("g")).join(sought, ["vendor", "g"])
    inner = asking.join(free.join(_sizes(asking), "vendor").select("uri", "vendor", F.explode(_grams(theirs, F.col("sizes"))).alias("g")), ["vendor", "g"])
    met = outer.select("key", "uri").union(inner.select("key", "uri")).distinct()
    met = met.join(free.drop("vendor", "version"), "uri").join(asked.drop("vendor", "versions"), "key").where((_exact("loose") | _bare()) & _fits())
    return met.join(named, "key").where(_updated(F.col("any_pack"), F.col("any_release"))).select("key", "uri", F.lit(100.0).alias("score"), F.lit(3).alias("step"))


class _Settings(Params):
    threshold = Param(Params._dummy(), "threshold", "least score of the first two steps, 0 to 100", TypeConverters.toFloat)
    most = Param(Params._dummy(), "most", "most matches of a product", TypeConverters.toInt)


class ProductMatcher(Estimator, _Settings):
    """Fits on a dictionary with the columns uri and title."""

    @keyword_only
    def __init__(self, *, threshold: float = 92.0, most: int = 99):
        super().__init__()
        self._setDefault(threshold=92.0, most=99)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ProductMatcherModel:
        items = written(dictionary_items(dataset))
        return ProductMatcherModel(items, threshold=self.getOrDefault("threshold"), most=self.getOrDefault("most"))


class ProductMatcherModel(Model, _Settings):
    def __init__(self, items: DataFrame, versions: DataFrame | None = None, *, threshold: float = 92.0, most: int = 99):
        super().__init__()
        self._set(threshold=threshold, most=most)
        self.items = items
        self.versions = items.select("vendor", "version").distinct() if versions is None else versions

    def save(self, path: str) -> None:
        spark = self.items.sparkSession
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        self.versions.write.mode("overwrite").parquet(f"{path}/versions")
        settings = json.dumps({"threshold": self.getOrDefault("threshold"), "most": self.getOrDefault("most")})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProductMatcherModel:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return cls(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/versions"), **settings)

    def predict(self, products: DataFrame) -> DataFrame:
        """(key, uri, score, step, rank): each product's matches, best and greatest uri first."""
        asked = written(_wanted(products))
        candidates = columns.vendor_candidates(F.lower(F.regexp_replace("vendor", "[®™]", "")))
        makers = written(asked.select("key", F.explode(candidates).alias("vendor")).distinct().join(self.versions.select("vendor").distinct(), "vendor", "left_semi"))
        first = written(_by_version(asked, makers, self.versions, self.items, self.getOrDefault("threshold")))
        matched = first.select("key").distinct()
        rest = lambda df: df.join(matched, "key", "left_anti")
        every = first.unionByName(_by_name(rest(asked), rest(makers), self.items))
        deciding = every.withColumn("least", F.min("step").over(Window.partitionBy("key"))).where("step = least")
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("uri")))
        return deciding.select("key", "uri", "score", "step", rank.alias("rank")).where(F.col("rank") <= self.getOrDefault("most"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The products with `matches`, an array of uris, null where there are none."""
        best = self.predict(dataset).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "uri"))).alias("found"))
        return dataset.join(best.select("key", F.col("found.uri").alias("matches")), "key", "left")


def product_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a dictionary made of them: each maker has forty parts, and the part's
    number decides which step, if any, must find its entry."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").repartition(PARTS, "p_partkey").selectExpr(
        "p_partkey k", "concat('firma', p_partkey div 40) vendor", "concat(p_partkey % 40 + 1, '.', p_partkey % 7) version",
        "concat('z', translate(cast(p_partkey as string), '0123456789', 'abcdefghij'), 'ware') word", "p_name", "p_partkey % 8 c",
    )
    uri = """concat('cpe:2.3:a:', vendor, ':', if(c = 6, 'abc', word), ':', if(c in (2, 6), '-', version), ':',
        case c when 4 then 'sp1' when 5 then 'sp3' when 7 then 'rc1' else '*' end, ':*:*:*:*:', if(c = 3, 'windows', '*'), ':*')"""
    title = "case when c = 1 then null when c = 2 then concat(vendor, ' ', word, ' edition 7') else concat(vendor, ' ', p_name, ' ', word, ' ', version) end"
    name = "concat(vendor, ' ', p_name, ' ', word, ' edition 7', if(c in (4, 5), ' sp2', ''), ' ', version, if(c = 3, ' for linux', ''))"
    products = p.selectExpr("k key", "concat(vendor, ', Inc.') vendor", f"{name} name").withColumn("versions", columns.versions(F.col("name")))
    return ProductMatcher().fit(p.selectExpr(f"{uri} uri", f"{title} title")).predict(products)


def dictionary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary entries with and without titles, versions and digits: which say too little, and which items are too short."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey k", "case p_partkey % 4 when 0 then null when 1 then '' when 2 then p_name else concat(p_name, ' ', p_size) end title",
        "case p_partkey % 3 when 0 then substr(p_name, 1, 1 + p_partkey % 5) when 1 then concat('item', p_size) else p_type end item",
        "case p_partkey % 5 when 0 then '-' when 1 then '*' else concat(p_size, '.0') end version", "case p_partkey % 7 when 0 then 'rc1' when 1 then 'rc' when 2 then 'rc123' when 3 then 'src1' else '*' end update",
    )
    weak = weak_entry(F.concat(F.lit("cpe:"), F.col("k")), F.col("title"), F.col("item"), F.col("version"), F.col("update"))
    return p.select("k", weak.alias("weak"), (F.length("item") < LEAST_ITEM).alias("short"))


QUERIES = {"product_matches": product_matches, "dictionary_filter": dictionary_filter}
_STEP = "CASE c WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END"
ORACLE_SQL = {
    "product_matches": f"""
        SELECT k AS key, 'cpe:2.3:a:firma' || k // 40 || ':' || word || ':' || CASE c WHEN 2 THEN '-' ELSE version END || ':' || CASE c WHEN 5 THEN 'sp3' ELSE '*' END || ':*:*:*:*:*:*' AS uri,
               100.0::DOUBLE AS score, {_STEP} AS step, 1 AS rank
        FROM (SELECT p_partkey AS k, p_partkey % 8 AS c, (p_partkey % 40 + 1) || '.' || p_partkey % 7 AS version,
                     'z' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') || 'ware' AS word FROM part)
        WHERE c IN (0, 1, 2, 5)""",
    "dictionary_filter": """
        WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 < 2 THEN NULL ELSE p_name END AS title, p_partkey % 4 = 3 AS numbered, p_partkey % 3 AS i, p_name, p_type,
                          p_partkey % 5 < 2 AS bare, p_partkey % 7 < 2 AS candidate FROM part)
        SELECT k, candidate OR (bare AND NOT numbered AND (title IS NOT NULL OR i <> 1)) AS weak, i = 0 AND k % 5 < 3 AS short FROM e""",
}
