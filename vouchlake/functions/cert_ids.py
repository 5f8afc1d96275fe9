"""Certificate ids in canonical form, and the vote between candidate ids."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of certificate ids by scheme; the first that fits at the start counts.
PATTERNS = {
    "DE": ["BSI[-_]DSZ[-_]CC[-_](?:(?P<s>S)[-_])?(?P<counter>[0-9]{3,5})[-_]?(?:(?P<version>[vV][0-9])[-_])?(?P<year>[0-9]{4})?(?:[-_](?P<doc>(?:RA|MA)(?:[-_][0-9]+)?))?"],
    "FR": [
        "DCSS[Ii]-(?P<year>[0-9]{2,4})/(?P<counter>[0-9]+)([vV](?P<version>[0-9]))?",
        "Rapport de certification (?P<year>[0-9]{2,4})/(?P<counter>[0-9]+)([vV](?P<version>[0-9]))?",
        "Certification Report (?P<year>[0-9]{2,4})/(?P<counter>[0-9]+)([vV](?P<version>[0-9]))?",
        "ANSS[Ii](?:-CC)?(?:-(?P<type>PP|SITE))?[ -](?P<year>[0-9]{2,4})[/_-](?P<counter>[0-9]+)(?:-(?P<doc>(?:[MSR][0-9]+)))?([vV](?P<version>[0-9]))?",
    ],
    "NL": ["(?:NSCIB-|CC-|NSCIB-CC-)(?P<core>((?P<year>[0-9]{2})-)?(?:-?[0-9]+)+)(?:-?(?P<doc>(?:CR|MA|MR)(?P<version>[0-9]*)))?"],
    "NO": ["SERTIT-(?P<counter>[0-9]+)"],
    "US": [
        "CCEVS-VR-(?:(?P<cc>CC)-)?(?:(?P<VID>VID)-?)?(?P<year>[0-9]{2})-(?P<counter>[0-9]+)",
        "CCEVS-VR-(?:(?P<cc>CC)-)?(?:(?P<VID>VID)-?)?(?P<counter>[0-9]{4,5})(?:-(?P<year>[0-9]{4}))?",
    ],
    "CA": ["(?P<number1>383)[ -](?P<digit>[0-9])[ -](?P<number2>[0-9]+)(?:-CR|P)?", "(?P<number>[0-9]+)[ -](?P<lab>EWA|LSS|CCS)(?:[ -](?P<year>[0-9]+))?"],
    "UK": ["CRP(?P<counter>[0-9]+[A-Z]?)", "CERTIFICATION REPORT No. P(?P<counter>[0-9]+[A-Z]?)"],
    "ES": ["(?P<year>[0-9]{4})[-‐](?P<project>[0-9]+)[-‐]INF[-‐](?P<counter>[0-9]+)(?:[ -‐]{1,2}[vV](?P<version>[0-9]))?"],
    "KR": ["KECS[-‐](?P<word>ISIS|NISS|CISS)[-‐](?P<counter>[0-9]{2,4})[-‐](?P<year>[0-9]{4})"],
    "JP": ["(?:CRP|ACR)-C(?P<counter>[0-9]+)-(?P<digit>[0-9]+)", "JISEC-CC-CRP-C(?P<counter>[0-9]+)(?:-(?P<digit>[0-9]{2}))?(?:-(?P<year>[0-9]{4}))?", "Certification No. [cC](?P<counter>[0-9]+)"],
    "MY": ["ISCB-(?P<digit>[0-9])-RPT-C(?P<counter>[0-9]{3})-CR(?:-[0-9])?-(?P<version>[vV][0-9][a-z]?)"],
    "IT": ["OCSI/CERT/(?:(?P<lab>[A-Z]{3})/)?(?P<counter>[0-9]{2,3})/(?P<year>[0-9]{4})/RC"],
    "TR": [r"(?P<prefix>[0-9\.]+)/TSE-CCCS-(?P<number>[0-9]+)"],
    "SE": ["CSEC ?(?P<year>[0-9]{4})(?P<counter>[0-9]{2,3})"],
    "IN": ["IC3S/(?P<lab>[A-Z]+[0-9]+)/(?P<vendor>[a-zA-Z_]+)/(?P<level>[a-zA-Z0-9]+)/(?P<number1>[0-9]+)/(?P<number2>[0-9]+) ?(?:/CR)?"],
    "SG": ["CSA_CC_(?P<year>[0-9]{2})(?P<counter>[0-9]{3})"],
    "AU": ["(?:Certificate Number:|Certification Report) (?P<year>[0-9]{2,4})/(?P<counter>[0-9]+)"],
    "PL": ["(?P<number>[0-9]+)/PC1/(?:(?P<ac>AC223)/)?(?P<year>[0-9]{4})"],
}
#: What each source of candidate ids counts in the vote.
WEIGHTS = {"frontpage": 1.5, "metadata": 1.2, "filename": 1.0, "keywords": 1.0}

Get = Callable[[str], Column]


def _year(get: Get) -> Column:
    """Four digits of a year; two digits under 50 lie after 2000."""
    y = get("year").cast("int")
    return F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y).cast("string")


def _joined(*parts: Column | str) -> Column:
    """Parts put together; a part with a null in it is left out."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _after(sign: str, part: Column) -> Column:
    return F.concat(F.lit(sign), part)


def _padded(part: Column, width: int) -> Column:
    n = part.cast("int").cast("string")
    return F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0"))


def _australian(g: Get) -> Column:
    swapped = F.length(g("year")) < F.length(g("counter"))  # some reports turn the two round
    year = lambda _: F.when(swapped, g("counter")).otherwise(g("year"))
    return _joined("Certificate Number: ", _year(year), "/", F.when(swapped, g("year")).otherwise(g("counter")))


#: How each scheme writes its ids.
FORMS: dict[str, Callable[[Get], Column]] = {
    "DE": lambda g: _joined("BSI-DSZ-CC", _after("-", g("s")), "-", g("counter"), _after("-", F.upper(g("version"))), _after("-", _year(g)), _after("-", g("doc"))),
    "FR": lambda g: _joined("ANSSI-CC-", F.concat(g("type"), F.lit("-")), _year(g), "/", g("counter"), _after("-", g("doc")), _after("v", g("version"))),
    "NL": lambda g: _joined("NSCIB-CC-", g("core"), "-", F.coalesce(g("doc"), F.lit("CR"))),
    "NO": lambda g: _joined("SERTIT-", _padded(g("counter"), 3)),
    "US": lambda g: _joined("CCEVS-VR", _after("-", g("cc")), _after("-", g("VID")), "-", g("counter"), _after("-", _year(g))),
    "CA": lambda g: F.when(g("lab").isNotNull(), _joined(g("number"), "-", g("lab"), _after("-", _year(g)))).otherwise(_joined(g("number1"), "-", g("digit"), "-", g("number2"))),
    "UK": lambda g: _joined("CRP", g("counter")),
    "ES": lambda g: _joined(_year(g), "-", g("project"), "-INF-", g("counter")),
    "KR": lambda g: _joined("KECS-", g("word"), "-", _padded(g("counter"), 4), "-", _year(g)),
    "JP": lambda g: _joined("JISEC-CC-CRP-C", g("counter"), _after("-", g("digit")), _after("-", _year(g))),
    "MY": lambda g: _joined("ISCB-", g("digit"), "-RPT-C", g("counter"), "-CR-", F.lower(g("version"))),
    "IT": lambda g: _joined("OCSI/CERT/", F.concat(g("lab"), F.lit("/")), g("counter"), "/", _year(g), "/RC"),
    "TR": lambda g: _joined(g("prefix"), "/TSE-CCCS-", g("number")),
    "SE": lambda g: _joined("CSEC", _year(g), _padded(g("counter"), 3)),
    "IN": lambda g: _joined("IC3S/", g("lab"), "/", g("vendor"), "/", g("level"), "/", g("number1"), "/", g("number2")),
    "SG": lambda g: _joined("CSA_CC_", g("year"), g("counter")),
    "AU": _australian,
    "PL": lambda g: _joined(g("number"), "/PC1/", F.concat(g("ac"), F.lit("/")), g("year")),
}


def canonical(cert_id: Column, scheme: Column) -> Column:
    """The id as its scheme writes it; an id of no known form, or of another scheme, only
    trimmed and with plain hyphens. Null for a null."""
    clean = F.trim(F.regexp_replace(cert_id, "‐", "-"))
    cases = F.when(F.lit(False), clean)
    for name, patterns in PATTERNS.items():
        for p in patterns:
            at, java = re.compile(p).groupindex, "^(?:" + p.replace("?P<", "?<") + ")"

            def get(group: str, at=at, java=java) -> Column:
                return F.nullif(F.regexp_extract(clean, java, at[group]), F.lit("")) if group in at else F.lit(None).cast("string")

            cases = cases.when((scheme == name) & clean.rlike(java), FORMS[name](get))
    return cases.otherwise(clean)


def vote(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(dgst, cert_id, weight): the candidate with most votes, among equals the longest, then the last in order.

    `candidates` has dgst, scheme, source, cert_id, n: how often a source names an id.
    A source's counts are taken by its greatest, weighed, and summed over the forms of
    one canonical id. Unknown sources and nulls do not vote.
    """
    rows = [(k, float(v)) for k, v in (weights or WEIGHTS).items()]
    weigh = F.create_map(*[F.lit(x) for kv in rows for x in kv])
    # dealt once by certificate, in enough parts that no task counts much: the window and both groupings follow
    known = candidates.where("cert_id is not null and n > 0").withColumn("w", F.try_element_at(weigh, "source")).where("w is not null").repartition(200, "dgst")
    top = F.max("n").over(Window.partitionBy("dgst", "source"))
    votes = known.withColumn("share", F.col("w") * F.col("n") / top).groupBy("dgst", canonical(F.col("cert_id"), F.col("scheme")).alias("cert_id")).agg(F.round(F.sum("share"), 9).alias("weight"))
    best = F.max(F.struct("weight", F.length("cert_id").alias("long"), "cert_id")).alias("best")
    return votes.groupBy("dgst").agg(best).select("dgst", "best.cert_id", "best.weight")
