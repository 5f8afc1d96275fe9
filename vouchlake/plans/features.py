"""Queries that apply the column functions and operators of certificates to inputs
made of the star tables, each with SQL of its own that says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.functions import cert_ids, columns
from vouchlake.operators import assurance, learning, vulnerabilities
from vouchlake.sources import readers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of six kinds, spelled as reports do, in their schemes' form."""
    raw = F.expr("""CASE k % 6 WHEN 0 THEN concat('BSI_DSZ_CC_', k % 9000 + 1000, '-v2-', k % 20 + 2000) WHEN 1 THEN concat('DCSSI-0', k % 9 + 1, '/', k % 50 + 10)
        WHEN 2 THEN concat('CSEC 2019', k % 89 + 10) WHEN 3 THEN concat('KECS‐NISS‐', k % 89 + 10, '‐2017') WHEN 4 THEN concat('Certificate Number: ', k % 89 + 10, '/2006') ELSE concat(' report ', k, ' ') END""")
    scheme = F.expr("element_at(array('DE', 'FR', 'SE', 'KR', 'AU', 'FR'), cast(k % 6 + 1 AS int))")
    return _orders(spark, sf_dir).select("k", cert_ids.canonical(raw, scheme).alias("cert_id"))


#: An id of each scheme as reports spell it, and in its scheme's form; n has two digits, m four, y is a year.
SPELLINGS = [
    ("DE", "concat('BSI_DSZ_CC_', m, '_', y, '_MA_', n)", "concat('BSI-DSZ-CC-', m, '-', y, '-MA_', n)"),
    ("FR", "concat('ANSSI-CC ', y, '_', n, '-M01')", "concat('ANSSI-CC-', y, '/', n, '-M01')"),
    ("NL", "concat('CC-22-', m)", "concat('NSCIB-CC-22-', m, '-CR')"), ("NO", "concat('SERTIT-', n)", "concat('SERTIT-0', n)"),
    ("US", "concat('CCEVS-VR-VID', m, '-2008')", "concat('CCEVS-VR-VID-', m, '-2008')"), ("CA", "concat(m, ' EWA ', y)", "concat(m, '-EWA-', y)"),
    ("UK", "concat('CERTIFICATION REPORT No. P', m)", "concat('CRP', m)"), ("ES", "concat(y, '-', n, '-INF-', m, '-v1')", "concat(y, '-', n, '-INF-', m)"),
    ("KR", "concat('KECS-CISS-', n, '-2023')", "concat('KECS-CISS-00', n, '-2023')"), ("JP", "concat('Certification No. C0', m)", "concat('JISEC-CC-CRP-C0', m)"),
    ("MY", "concat('ISCB-3-RPT-C0', n, '-CR-1-V1a')", "concat('ISCB-3-RPT-C0', n, '-CR-v1a')"), ("IT", "concat('OCSI/CERT/TEC/', n, '/2009/RC')", "concat('OCSI/CERT/TEC/', n, '/2009/RC')"),
    ("TR", "concat('21.0.03/TSE-CCCS-', n)", "concat('21.0.03/TSE-CCCS-', n)"), ("SE", "concat('CSEC 2010', n)", "concat('CSEC20100', n)"),
    ("IN", "concat('IC3S/KOL01/ADVA/EAL2/', m, '/0021 /CR')", "concat('IC3S/KOL01/ADVA/EAL2/', m, '/0021')"), ("SG", "concat('CSA_CC_210', n)", "concat('CSA_CC_210', n)"),
    ("AU", "concat('Certification Report 97/', n)", "concat('Certificate Number: 1997/', n)"), ("PL", "concat(n, '/PC1/AC223/', y)", "concat(n, '/PC1/AC223/', y)"),
]


def _spelled(at: int) -> str:
    return "CASE k % 18 " + " ".join(f"WHEN {i} THEN {row[at]}" for i, row in enumerate(SPELLINGS)) + " END"


def canonical_ids_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all eighteen schemes, spelled as reports do, in their schemes' form."""
    ids = _orders(spark, sf_dir).selectExpr("k", "k % 89 + 10 n", "k % 9000 + 1000 m", "k % 20 + 2000 y")
    scheme = F.expr(f"element_at(array({', '.join(repr(r[0]) for r in SPELLINGS)}), cast(k % 18 + 1 AS int))")
    return ids.select("k", scheme.alias("scheme"), cert_ids.canonical(F.expr(_spelled(1)), scheme).alias("cert_id"))


def id_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines vote for an id of their order: four sources, five ids in two spellings."""
    source = F.expr("element_at(array('frontpage', 'metadata', 'filename', 'keywords'), l_linenumber % 4 + 1)")
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dgst"), F.lit("NO").alias("scheme"), source.alias("source"), F.expr("concat(if(l_suppkey % 2 = 0, 'SERTIT-', 'SERTIT-0'), l_partkey % 5)").alias("cert_id"), F.col("l_quantity").alias("n"))
    return cert_ids.vote(rows)


def level_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.expr("array(concat('package EAL', k % 7 + 1, '+ augmented'), concat('EAL', k * 3 % 7 + 1), 'none')")
    return _orders(spark, sf_dir).select("k", columns.lowest_level(levels).alias("level"))


def title_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE k % 3 WHEN 0 THEN concat('Build', k, '.4 and v1.', k % 5, ', 1.', k % 5) WHEN 1 THEN concat('Card ', k % 9, ' x', k) ELSE 'Card' END")
    return _orders(spark, sf_dir).select("k", F.array_join(columns.versions(name), ",").alias("versions"))


_FIT = {"title": ["x", "x for Linux", "x Windows and Linux"], "hardware": ["*", "linux", "windows", "x86"], "entry": ["y", "y linux"]}


def platform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda name, by: F.element_at(F.array(*map(F.lit, _FIT[name])), F.expr(f"cast({by} % {len(_FIT[name])} + 1 AS int)"))
    return _orders(spark, sf_dir).select("k", columns.platform_fits(pick("title", "k"), pick("hardware", "(k div 3)"), pick("entry", "(k div 12)")).alias("fits"))


def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry, wanted = F.expr("concat(k % 12, if(k % 5 = 0, '', concat('.', k % 3)), if(k % 7 = 0, '.1', ''))"), F.expr("array(concat(k % 4, '.', k % 3), cast(k % 12 AS string))")
    return _orders(spark, sf_dir).select("k", columns.version_fits(entry, wanted).alias("fits"), columns.version_fits(entry, F.slice(wanted, 1, 1)).alias("fits_first"))


def _certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(F.col("k").alias("dgst"), F.col("day").alias("valid_from"), F.expr("date_add(day, cast(k % 90 AS int))").alias("valid_to"))


def published_while_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten in the morning of a boundary day is not inside."""
    lines = _read(spark, sf_dir, "lineitem").withColumn("cve_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    cves = lines.groupBy("cve_id").agg((F.max("l_shipdate").cast("timestamp_ntz") + F.expr("INTERVAL 10 HOURS")).alias("published"))
    pairs = lines.select(F.col("l_orderkey").alias("dgst"), "cve_id").distinct()
    return vulnerabilities.within_validity(pairs, _certs(spark, sf_dir), cves)


def configured_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a vulnerability of two components; an order's parts are its products."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dgst"), F.expr("concat('u', l_partkey % 200)").alias("uri"))
    certs = lines.repartition(vulnerabilities.PARTS, "dgst").groupBy("dgst").agg(F.collect_set("uri").alias("uris"))
    conf = "array(concat('c', s_suppkey), concat('c', s_suppkey + 1)), array(concat('c', s_suppkey + 7))"
    cves = _read(spark, sf_dir, "supplier").select(F.expr("concat('v', s_suppkey)").alias("cve_id"), F.expr(f"array(array({conf}))").alias("configurations"), F.array().cast("array<string>").alias("criteria"))
    matches = spark.range(200).select(F.expr("concat('c', id)").alias("criteria_id"), F.expr("array(concat('u', id))").alias("uris"))
    return vulnerabilities.related_cves(certs, cves, matches)


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr("element_at(array('security_level', 'target', 'report'), l_linenumber % 3 + 1)")
    text = F.expr("concat(element_at(array('ALC_FLR', 'AVA_VAN', 'ADV_FSP', 'ATE_DPT', 'XXX_ABC'), cast(l_partkey % 5 + 1 AS int)), if(l_suppkey % 4 = 0, '', concat('.', l_suppkey % 5)))")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dgst"), source.alias("source"), text.alias("text"))


def requirement_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assurance.resolve(_requirements(spark, sf_dir))


def actual_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = _orders(spark, sf_dir).select(F.col("k").alias("dgst"), F.expr("concat('EAL', substr(o_orderpriority, 1, 1), if(k % 2 = 0, '+', ''))").alias("eal"))
    return assurance.actual(certs, assurance.resolve(_requirements(spark, sf_dir)))


RULES = {"words": {"en": ["the", "that"], "fr": ["que", "l[ae]"]}, "terms": {"license": ["[Ll]icensed under", "License"]}}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vulnerabilities.keyword_counts(_read(spark, sf_dir, "documents"), assurance.flat_rules(RULES))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


#: Nine hundred patterns in four shapes, of words of three syllables.
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "ou", "is", "of", "to")
SHAPES = ("{0}", "(?i){0}(?:ing|ed)", "{0} th[a-z]+", "{0}[a-z]{{2,4}}")


def _many_rules() -> list[tuple[str, str]]:
    words = [a + b + SYLLABLES[(i + 2 * j) % 15] for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES)]
    return [(f"s{k}.{w}", shape.format(w)) for k, shape in enumerate(SHAPES) for w in words]


def many_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine hundred rules at once, over all documents: matches and documents of each rule."""
    counts = vulnerabilities.keyword_counts(_read(spark, sf_dir, "documents"), _many_rules())
    return counts.groupBy("path").agg(F.sum("n").alias("n"), F.countDistinct("key").alias("docs"), F.countDistinct("match").alias("matches"))


def rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assurance.keyword_matrix(_counts(spark, sf_dir), ["words.en", "words.fr", "terms", "words"])


def rule_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assurance.sums_under(spark, _counts(spark, sf_dir), _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), "words")


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders name ids; every third order shares its id with another, some ids are nobody's."""
    ids = _orders(spark, sf_dir).select(F.col("k").alias("dgst"), F.expr("concat('id', k div if(k % 3 = 0, 2, 1))").alias("cert_id"))
    found = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dgst"), F.expr("concat('id', l_partkey * 11)").alias("named"))
    return assurance.references(found, ids)


def archival_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.expr("date_add(day, cast(k % 4000 AS int))")
    return _orders(spark, sf_dir).select("k", columns.archived_on(F.col("day"), until, 1827, "1997-06-01").alias("archived"), F.round(columns.validity_years(F.col("day"), until), 6).alias("years"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("if(k % 4 = 0, ' Review Pending ', concat('In Review  (', month(day), '/', day(day), '/', year(day), ')'))")
    return _orders(spark, sf_dir).select("k", columns.status_line(line).alias("x")).select("k", "x.status", "x.since")


def plain_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat(c_name, '(R) North-West, Card+Chip ', c_mktsegment, ' Inc')")
    return _read(spark, sf_dir, "customer").select("c_custkey", columns.fips_vendor(name).alias("vendor"), columns.only_words(name, ["inc", "building"]).alias("known"))


def plain_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('user', c_custkey, if(c_custkey % 2 = 0, ' [at] ', '(AT)'), 'maker', '[dot]', 'org')")
    return _read(spark, sf_dir, "customer").select("c_custkey", columns.plain_contact(text).alias("contact"))


def dictionary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.expr(r"concat('cpe:2.3:a:ven\\:dor_', s_suppkey, ':item\\\\:', if(s_suppkey % 2 = 0, '*', concat('1.', s_suppkey)), ':x')")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", columns.cpe_name(uri, 3).alias("vendor"), columns.cpe_name(uri, 4).alias("item"), columns.cpe_version(uri).alias("version"))


def soft_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = columns.softmax(F.expr("array(s_acctbal / 1e3, s_suppkey % 7 * 1e0, 1e0)"))
    return _read(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(p[i], 8).alias(f"p{i}") for i in range(3)], F.array_position(p, F.array_max(p)).alias("winner"))


def stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat('acme ', p_name, ' v', p_size, '.1')")
    return _read(spark, sf_dir, "part").select("p_partkey", columns.without_maker_and_version(name, F.array(F.lit("acme")), F.array(F.expr("concat('v', p_size, '.1')"))).alias("name"))


def spaced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of the documents in one line."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(columns.one_spaced(F.regexp_replace("text", "[^a-zA-Z0-9 \\n]", ""))).alias("plain_md5"))


def level_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("if(k % 5 = 0, 'none', concat('EAL ', k % 7 + 1, ' augmented by ALC_FLR.', k % 3, ' and AVA_VAN.5, ALC_FLR.', k % 3))")
    return _orders(spark, sf_dir).select("k", columns.level_package(text).alias("x")).select("k", "x.level", F.array_join("x.augmented_by", " ").alias("augmented_by"))


def written_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('The TOE', k % 3, ' and the TOE of [1] and [3]')")
    ids = F.expr("array(concat('id', k), 'b')")
    return _orders(spark, sf_dir).select("k", columns.cited(columns.expanded(text, {"TOE": "target of evaluation"}), ids).alias("text"))


def host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.expr("concat('https://', if(k % 2 = 0, '195.0.2.7', 'a.org'), '/files/', k, '.pdf')")
    return _orders(spark, sf_dir).select("k", columns.named_host(link, "195.0.2.7", "portal.org").alias("link"))


def vendor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers' candidate names that a list of vendors holds."""
    maker = F.expr("concat(element_at(array('the ', '', 'hewlett packard, '), cast(c_custkey % 3 + 1 AS int)), lower(c_mktsegment), ' group / maker', c_custkey % 50)")
    asked = _read(spark, sf_dir, "customer").select("c_custkey", F.explode(columns.vendor_candidates(maker)).alias("vendor"))
    known = spark.range(40).select(F.expr("concat('maker', id)").alias("vendor")).union(spark.createDataFrame([("hp",), ("building",), ("householdgroup",)], "vendor string"))
    return asked.join(known, "vendor", "left_semi").select("c_custkey", "vendor")


def label_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the first two dimensions of each label's vectors."""
    v = _read(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return v.groupBy("label").agg(
        F.count("*").alias("n"), r(F.avg("x"), "mean_x"), r(F.var_samp("x"), "var_x"), r(F.stddev_samp("y"), "sd_y"), r(F.max("x") - F.min("x"), "range_x"), r(F.covar_samp("x", "y"), "cov"),
        r(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), "mean_distance"), r((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), "box"),
    )


def security_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of two levels, the first level, the holder's site and the scheme of an id."""
    text = F.expr("concat('EAL ', k % 7 + 1, ' with ALC_FLR.', k % 3, ' or EAL5', if(k % 2 = 0, ' plus AVA_VAN.5, ADV_IMP', ''), ' see https://holder.org/', k, ' (site)')")
    found = F.map_entries(columns.packages(text))
    listed = F.array_join(F.array_sort(F.transform(found, lambda m: F.concat(m["key"], F.lit("="), F.array_join(m["value"], "+")))), ";")
    schemes = {"NL": [r"NSCIB-CC-\d{2}"], "DE": [r"BSI-\d+", r"CC-\d"]}
    cert_id = F.expr("element_at(array('NSCIB-CC-12', 'xNSCIB-CC-12', 'BSI-77', 'CC-5'), cast(k % 4 + 1 AS int))")
    return _orders(spark, sf_dir).select("k", listed.alias("packages"), columns.first_level(text).alias("level"), columns.first_link(text).alias("site"), columns.scheme_of(cert_id, schemes).alias("scheme"))


FRONT = [
    (r"(?s)Certificate\s+(BSI-\d+)\s+for\s+(.+?)\s+from\s+(.+?)\n", {"cert_id": 1, "item": 2, "developer": 3}),
    (r"Number\s*:\s*(\S+)\s+Lab\s*:\s*(.+)", {"cert_id": 1, "lab": 2}),
]


def front_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two layouts, and some without either."""
    text = F.expr("CASE k % 3 WHEN 0 THEN concat('Report\\nCertificate BSI-', k, ' for\\n Card \\n ', k % 7, ' from Maker ', k % 5, '\\nrest') WHEN 1 THEN concat('x Number : N', k, ' Lab: Some  lab ', k % 4) ELSE 'none' END")
    return _orders(spark, sf_dir).select("k", columns.front_page(text, FRONT).alias("x")).select("k", "x.*")


_SIMPLE = {"fr": "romance", "es": "romance", "it": "romance"}


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("text").contains(" the "), "en").when(F.col("text").contains(" der "), "de").otherwise(F.element_at(F.array(F.lit("fr"), F.lit("en")), F.expr("cast(doc_id % 2 + 1 AS int)")))
    return _read(spark, sf_dir, "documents").withColumn("guess", guess)


def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages against a plain guess, the Romance ones as one label."""
    return learning.crosstab(_guesses(spark, sf_dir), "lang", "guess", _SIMPLE)


def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = learning.report(learning.crosstab(_guesses(spark, sf_dir), "lang", "guess", _SIMPLE))
    return x.select("label", *[F.round(c, 8).alias(c) for c in ("prec", "rec", "f1")], "support")


def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that an order's lines were given."""
    return learning.prediction_counts(_read(spark, sf_dir, "lineitem").withColumn("label", F.col("l_partkey") % 3), "l_orderkey", "label", 3)


def verified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three options a product; annotators reject the second of every fourth, or find none good."""
    part = _read(spark, sf_dir, "part")
    labels = part.select(
        F.expr("if(p_partkey % 2 = 0, concat('n', p_partkey), concat('Vendor: x\\nModule name: n', p_partkey, '\\nmore'))").alias("text"),
        F.expr("map('option_1', if(p_partkey % 5 = 0, 'No good match', concat('t', p_partkey % 9)), 'option_2', concat('t', p_partkey % 12), 'option_3', 'unknown')").alias("options"),
        F.expr("if(p_partkey % 4 = 0, array('$option_2'), null)").alias("wrong"),
    )
    dictionary = spark.range(20).select(F.expr("concat('t', id div 2)").alias("title"), F.expr("concat('u', id)").alias("uri"))
    certs = part.select(F.col("p_partkey").alias("dgst"), F.expr("concat('n', p_partkey)").alias("name"))
    return readers.verified_matches(labels, dictionary, certs).withColumn("verified_uris", F.array_join("verified_uris", ","))


_Q = (
    canonical_ids, canonical_ids_all, id_vote, level_floor, title_versions, platform_filter, version_pairs, published_while_valid, configured_vulnerabilities, requirement_resolution, actual_requirements,
    rule_counts, many_rule_counts, rule_matrix, rule_sums, reference_edges, archival_dates, status_lines, plain_vendors, plain_contacts, dictionary_parts, soft_votes,
    stripped_names, spaced_texts, level_packages, written_out, host_names, vendor_matches, label_shapes,
    security_packages, front_pages, label_crosstab, label_report, prediction_counts, verified_labels,
)
QUERIES = {f.__name__: f for f in _Q}

_LIST = lambda name: "[" + ", ".join(f"'{x}'" for x in _FIT[name]) + "]"
_FOUND = """found AS (SELECT l_orderkey AS dgst, 3 - l_linenumber % 3 AS rank, (['ALC_FLR', 'AVA_VAN', 'ADV_FSP', 'ATE_DPT'])[l_partkey % 5 + 1] AS family, cast(l_suppkey % 5 AS integer) AS level
    FROM lineitem WHERE l_partkey % 5 < 4 AND l_suppkey % 4 <> 0),
    resolved AS (SELECT dgst, family, level FROM (SELECT *, row_number() OVER (PARTITION BY dgst, family ORDER BY rank DESC, level DESC) AS rn FROM found) t WHERE rn = 1)"""
_IMPLIED = ", ".join(f"('{eal}', '{x.split('.')[0]}', {x.split('.')[1]})" for eal, xs in assurance.IMPLIED.items() for x in xs.split())
_RULES = ", ".join(f"('{path}', '{p}')" for path, p in assurance.flat_rules(RULES))
_SEP = "[ ,;\\[\\]”\"'')(.]"
_HITS = f"""hits AS (SELECT doc_id AS key, path, trim(unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\r?\\n', ' ', 'g'), concat('(?:^|{_SEP})(', pattern, ')(?:$|{_SEP})'), 1))) AS match
    FROM documents CROSS JOIN (VALUES {_RULES}) r(path, pattern)), counts AS (SELECT key, path, match, count(*) AS n FROM hits GROUP BY 1, 2, 3)"""
_PAIR = """pair AS (SELECT CASE WHEN lang IN ('fr', 'es', 'it') THEN 'romance' ELSE lang END AS label, CASE WHEN text LIKE '% the %' THEN 'en' WHEN text LIKE '% der %' THEN 'de' WHEN doc_id % 2 = 0 THEN 'romance' ELSE 'en' END AS guess
    FROM documents WHERE lang IS NOT NULL)"""
ORACLE_SQL = {
    "security_packages": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 4 THEN concat('EAL5=', CASE WHEN o_orderkey % 2 = 0 THEN 'AVA_VAN.5+ADV_IMP' ELSE '' END)
          ELSE array_to_string(list_sort([concat('EAL', o_orderkey % 7 + 1, '=ALC_FLR.', o_orderkey % 3), concat('EAL5=', CASE WHEN o_orderkey % 2 = 0 THEN 'AVA_VAN.5+ADV_IMP' ELSE '' END)]), ';') END AS packages,
        'EAL5' AS level, concat('https://holder.org/', o_orderkey) AS site, (['NL', NULL, 'DE', 'DE'])[o_orderkey % 4 + 1] AS scheme FROM orders""",
    "front_pages": """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat('BSI-', o_orderkey) WHEN 1 THEN concat('N', o_orderkey) END AS cert_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('Card ', o_orderkey % 7) END AS item,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('Maker ', o_orderkey % 5) END AS developer, CASE WHEN o_orderkey % 3 = 1 THEN concat('Some lab ', o_orderkey % 4) END AS lab FROM orders""",
    "label_crosstab": f"WITH {_PAIR} SELECT label, guess, count(*) AS n FROM pair GROUP BY 1, 2",
    "label_report": f"""WITH {_PAIR}, x AS (SELECT label FROM pair UNION SELECT guess FROM pair),
        t AS (SELECT x.label, (SELECT count(*) FROM pair p WHERE p.label = x.label AND p.guess = x.label) AS hit, (SELECT count(*) FROM pair p WHERE p.label = x.label) AS support, (SELECT count(*) FROM pair p WHERE p.guess = x.label) AS guessed FROM x)
        SELECT label, round(CASE WHEN guessed > 0 THEN hit * 1e0 / guessed ELSE 0 END, 8) AS prec, round(CASE WHEN support > 0 THEN hit * 1e0 / support ELSE 0 END, 8) AS rec, round(2e0 * hit / (support + guessed), 8) AS f1, support FROM t""",
    "prediction_counts": """SELECT l_orderkey, count(*) FILTER (WHERE l_partkey % 3 = 0) AS pred_0, count(*) FILTER (WHERE l_partkey % 3 = 1) AS pred_1, count(*) FILTER (WHERE l_partkey % 3 = 2) AS pred_2 FROM lineitem GROUP BY 1""",
    "verified_labels": """WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 9 END AS a, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 12 < 10 THEN p_partkey % 12 END AS b FROM part),
        u AS (SELECT DISTINCT k, unnest([concat('u', x * 2), concat('u', x * 2 + 1)]) AS uri FROM (SELECT k, a AS x FROM t UNION SELECT k, b FROM t) y WHERE x IS NOT NULL)
        SELECT p_partkey AS dgst, (SELECT string_agg(uri, ',' ORDER BY uri) FROM u WHERE k = p_partkey) AS verified_uris FROM part""",
    "canonical_ids": """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat('BSI-DSZ-CC-', o_orderkey % 9000 + 1000, '-V2-', o_orderkey % 20 + 2000) WHEN 1 THEN concat('ANSSI-CC-200', o_orderkey % 9 + 1, '/', o_orderkey % 50 + 10)
        WHEN 2 THEN concat('CSEC20190', o_orderkey % 89 + 10) WHEN 3 THEN concat('KECS-NISS-00', o_orderkey % 89 + 10, '-2017') WHEN 4 THEN concat('Certificate Number: 2006/', o_orderkey % 89 + 10) ELSE concat('report ', o_orderkey) END AS cert_id FROM orders""",
    "canonical_ids_all": f"""SELECT k, ([{', '.join(repr(r[0]) for r in SPELLINGS)}])[k % 18 + 1] AS scheme, {_spelled(2)} AS cert_id
        FROM (SELECT o_orderkey AS k, o_orderkey % 89 + 10 AS n, o_orderkey % 9000 + 1000 AS m, o_orderkey % 20 + 2000 AS y FROM orders)""",
    "id_vote": """WITH c AS (SELECT l_orderkey AS dgst, l_linenumber % 4 AS source, concat('SERTIT-00', l_partkey % 5) AS cert_id, l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber % 4) AS share FROM lineitem),
        v AS (SELECT dgst, cert_id, round(sum(share * CASE source WHEN 0 THEN 1.5e0 WHEN 1 THEN 1.2e0 ELSE 1e0 END), 9) AS weight FROM c GROUP BY 1, 2)
        SELECT dgst, cert_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY dgst ORDER BY weight DESC, length(cert_id) DESC, cert_id DESC) AS rn FROM v) t WHERE rn = 1""",
    "level_floor": """SELECT o_orderkey AS k, CASE WHEN o_orderkey * 3 % 7 <= o_orderkey % 7 THEN concat('EAL', o_orderkey * 3 % 7 + 1) ELSE concat('EAL', o_orderkey % 7 + 1, '+') END AS level FROM orders""",
    "title_versions": """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat(right(cast(o_orderkey AS varchar), 5), '.4,1.', o_orderkey % 5) WHEN 1 THEN cast(o_orderkey % 9 AS varchar) ELSE '-' END AS versions FROM orders""",
    "platform_filter": f"""WITH x AS (SELECT o_orderkey AS k, ({_LIST("title")})[o_orderkey % 3 + 1] AS title, ({_LIST("hardware")})[o_orderkey // 3 % 4 + 1] AS hw, ({_LIST("entry")})[o_orderkey // 12 % 2 + 1] AS entry FROM orders)
        SELECT k, CASE WHEN title = 'x' THEN hw = '*' WHEN hw = '*' THEN entry = 'y linux' WHEN hw = 'linux' THEN true WHEN hw = 'windows' THEN title LIKE '%Windows%' ELSE entry = 'y linux' END AS fits FROM x""",
    "version_pairs": """WITH x AS (SELECT o_orderkey AS k, concat(o_orderkey % 12, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('.', o_orderkey % 3) END, CASE WHEN o_orderkey % 7 = 0 THEN '.1' ELSE '' END) AS e,
          concat(o_orderkey % 4, '.', o_orderkey % 3) AS v, cast(o_orderkey % 12 AS varchar) AS w FROM orders),
        y AS (SELECT k, length(e) >= 3 AND ((regexp_matches(e, concat('^', replace(v, '.', '\\.'), '($|[^0-9])')) AND regexp_matches(e, '[0-9]\\.[0-9]')) OR regexp_matches(v, concat('^', replace(e, '.', '\\.'), '($|[^0-9])'))) AS a,
          (regexp_matches(e, concat('^', w, '($|[^0-9])')) AND regexp_matches(e, '[0-9]\\.[0-9]')) OR regexp_matches(w, concat('^', replace(e, '.', '\\.'), '($|[^0-9])')) AS b FROM x)
        SELECT k, a OR b AS fits, a AS fits_first FROM y""",
    "published_while_valid": """SELECT DISTINCT l_orderkey AS dgst, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cve_id
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(cast(l_shipdate AS date)) AS d FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey
        WHERE d > cast(o_orderdate AS date) AND d < cast(o_orderdate AS date) + cast(o_orderkey % 90 AS integer)""",
    "configured_vulnerabilities": """WITH have AS (SELECT DISTINCT l_orderkey AS dgst, l_partkey % 200 AS u FROM lineitem)
        SELECT DISTINCT a.dgst, concat('v', s_suppkey) AS cve_id FROM supplier JOIN have a ON a.u IN (s_suppkey, s_suppkey + 1) JOIN have b ON b.dgst = a.dgst AND b.u = s_suppkey + 7""",
    "requirement_resolution": f"WITH {_FOUND} SELECT dgst, family, level FROM resolved",
    "actual_requirements": f"""WITH {_FOUND}, implied AS (SELECT o_orderkey AS dgst, family, level FROM orders JOIN (VALUES {_IMPLIED}) i(eal, family, level) ON eal = concat('EAL', substr(o_orderpriority, 1, 1)))
        SELECT dgst, family, level FROM resolved UNION ALL SELECT dgst, family, level FROM implied i WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.dgst = i.dgst AND r.family = i.family)""",
    "many_rule_counts": f"""WITH s AS (SELECT [{', '.join(repr(x) for x in SYLLABLES)}] AS x), words AS (SELECT x[i + 1] || x[j + 1] || x[(i + 2 * j) % 15 + 1] AS w FROM s, range(15) a(i), range(15) b(j)),
        rules AS (SELECT 's0.' || w AS path, w AS p, w FROM words UNION ALL SELECT 's1.' || w, '(?i)' || w || '(?:ing|ed)', w FROM words
            UNION ALL SELECT 's2.' || w, w || ' th[a-z]+', w FROM words UNION ALL SELECT 's3.' || w, w || '[a-z]{{2,4}}', w FROM words),
        body AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r?\n', ' ', 'g') AS t FROM documents),
        found AS (SELECT doc_id, path, trim(unnest(regexp_extract_all(t, concat('(?:^|{_SEP})(', p, ')(?:$|{_SEP})'), 1))) AS match FROM body JOIN rules ON contains(lower(t), w))
        SELECT path, count(*) AS n, count(DISTINCT doc_id) AS docs, count(DISTINCT match) AS matches FROM found GROUP BY 1""",
    "rule_counts": f"WITH {_HITS} SELECT key, path, match, n FROM counts",
    "rule_matrix": f"""WITH {_HITS} SELECT key, cast(sum(CASE WHEN path = 'words.en' THEN n ELSE 0 END) AS bigint) AS words_en, cast(sum(CASE WHEN path = 'words.fr' THEN n ELSE 0 END) AS bigint) AS words_fr,
        cast(sum(CASE WHEN path LIKE 'terms.%' THEN n ELSE 0 END) AS bigint) AS terms, cast(sum(CASE WHEN path LIKE 'words.%' THEN n ELSE 0 END) AS bigint) AS words FROM counts GROUP BY 1""",
    "rule_sums": f"WITH {_HITS} SELECT doc_id AS key, (SELECT cast(sum(n) AS bigint) FROM counts WHERE key = doc_id AND path LIKE 'words.%') AS total FROM documents",
    "reference_edges": """WITH ids AS (SELECT o_orderkey AS dgst, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 ELSE o_orderkey END AS id FROM orders), f AS (SELECT id, min(dgst) AS dst FROM ids GROUP BY 1)
        SELECT DISTINCT l_orderkey AS src, coalesce(cast(dst AS varchar), concat('id', l_partkey * 11)) AS dst, dst IS NOT NULL AS known
        FROM lineitem LEFT JOIN f ON f.id = l_partkey * 11 LEFT JOIN ids o ON o.dgst = l_orderkey WHERE o.id IS NULL OR o.id <> l_partkey * 11""",
    "archival_dates": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4000 > 1827 THEN greatest(date '1997-06-01', cast(o_orderdate AS date) + 1827) ELSE cast(o_orderdate AS date) + cast(o_orderkey % 4000 AS integer) END AS archived,
        round(o_orderkey % 4000 / 365e0, 6) AS years FROM orders""",
    "status_lines": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'Review Pending' ELSE 'In Review' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderdate AS date) END AS since FROM orders""",
    "plain_vendors": """SELECT c_custkey, concat(c_name, ' North West Card') AS vendor, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING Inc' ELSE 'Inc' END AS known FROM customer""",
    "plain_contacts": "SELECT c_custkey, concat('user', c_custkey, '@maker.org') AS contact FROM customer",
    "dictionary_parts": r"SELECT s_suppkey, concat('ven:dor ', s_suppkey) AS vendor, 'item\' AS item, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE concat('1.', s_suppkey) END AS version FROM supplier",
    "soft_votes": """WITH x AS (SELECT s_suppkey, exp(s_acctbal / 1e3) AS a, exp(s_suppkey % 7 * 1e0) AS b, exp(1e0) AS c FROM supplier)
        SELECT s_suppkey, round(a / (a + b + c), 8) AS p0, round(b / (a + b + c), 8) AS p1, round(c / (a + b + c), 8) AS p2, cast(CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS bigint) AS winner FROM x""",
    "stripped_names": "SELECT p_partkey, trim(p_name) AS name FROM part",
    "spaced_texts": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9 \\n]', '', 'g'), '[ \\n]+', ' ', 'g'))) AS plain_md5 FROM documents",
    "level_packages": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN concat('EAL', o_orderkey % 7 + 1) END AS level, CASE WHEN o_orderkey % 5 <> 0 THEN concat('ALC_FLR.', o_orderkey % 3, ' AVA_VAN.5') END AS augmented_by FROM orders""",
    "written_out": "SELECT o_orderkey AS k, concat('The TOE', o_orderkey % 3, ' and the target of evaluation of id', o_orderkey, ' and [3]') AS text FROM orders",
    "host_names": "SELECT o_orderkey AS k, concat('https://', CASE WHEN o_orderkey % 2 = 0 THEN 'portal.org' ELSE 'a.org' END, '/files/', o_orderkey, '.pdf') AS link FROM orders",
    "vendor_matches": """SELECT c_custkey, concat('maker', c_custkey % 50) AS vendor FROM customer WHERE c_custkey % 50 < 40 UNION ALL SELECT c_custkey, 'hp' FROM customer WHERE c_custkey % 3 = 2
        UNION ALL SELECT c_custkey, 'building' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'householdgroup' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""",
    "label_shapes": """WITH v AS (SELECT label, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings)
        SELECT label, count(*) AS n, round(avg(x), 6) AS mean_x, round(var_samp(x), 6) AS var_x, round(stddev_samp(y), 6) AS sd_y, round(max(x) - min(x), 6) AS range_x, round(covar_samp(x, y), 6) AS cov,
        round(avg(sqrt(x * x + y * y)), 6) AS mean_distance, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS box FROM v GROUP BY 1""",
}
