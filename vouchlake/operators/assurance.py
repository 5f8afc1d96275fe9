"""Assurance requirements of certificates, and keyword rules.

Rules are data: a nested mapping whose leaves are lists of patterns, read from a
file or given as such. No catalogue is part of this library.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.functions import columns

#: Requirements that a level implies.
IMPLIED = {
    "EAL1": "ADV_FSP.1 AGD_OPE.1 AGD_PRE.1 ALC_CMC.1 ALC_CMS.1 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.1 ASE_REQ.1 ASE_TSS.1 ATE_IND.1 AVA_VAN.1",
    "EAL2": "ADV_ARC.1 ADV_TDS.1 AGD_OPE.1 AGD_PRE.1 ALC_CMC.2 ALC_CMS.2 ALC_DEL.1 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.2 ASE_REQ.2 ASE_SPD.1 ASE_TSS.1 ATE_COV.1 ATE_FUN.1 ATE_IND.2 AVA_VAN.2",
    "EAL3": "ADV_ARC.1 ADV_FSP.3 ADV_TDS.2 AGD_PRE.1 ALC_CMC.3 ALC_CMS.3 ALC_DEL.1 ALC_DVS.1 ALC_LCD.1 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.2 ASE_REQ.2 ASE_SPD.1 ASE_TSS.1 ATE_COV.2 ATE_DPT.1 ATE_FUN.1 ATE_IND.2 AVA_VAN.2",
    "EAL4": "ADV_ARC.1 ADV_FSP.4 ADV_IMP.1 ADV_TDS.3 AGD_OPE.1 AGD_PRE.1 ALC_CMC.4 ALC_CMS.4 ALC_DEL.1 ALC_DVS.1 ALC_LCD.1 ALC_TAT.1 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.2 ASE_REQ.2 ASE_SPD.1 ASE_TSS.1 ATE_COV.2 ATE_DPT.1 ATE_FUN.1 ATE_IND.2 AVA_VAN.3",
    "EAL5": "ADV_ARC.1 ADV_FSP.5 ADV_IMP.1 ADV_INT.2 ADV_TDS.4 AGD_OPE.1 AGD_PRE.1 ALC_CMC.4 ALC_CMS.5 ALC_DEL.1 ALC_DVS.1 ALC_LCD.1 ALC_TAT.2 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.2 ASE_REQ.2 ASE_SPD.1 ASE_TSS.1 ATE_COV.2 ATE_DPT.3 ATE_FUN.1 ATE_IND.2 AVA_VAN.4",
    "EAL6": "ADV_ARC.1 ADV_FSP.5 ADV_IMP.2 ADV_INT.3 ADV_SPM.1 ADV_TDS.5 AGD_OPE.1 AGD_PRE.1 ALC_CMC.5 ALC_CMS.5 ALC_DEL.1 ALC_DVS.2 ALC_LCD.1 ALC_TAT.3 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.2 ASE_REQ.2 ASE_SPD.1 ASE_TSS.1 ATE_COV.3 ATE_DPT.3 ATE_FUN.2 ATE_IND.2 AVA_VAN.5",
    "EAL7": "ADV_ARC.1 ADV_FSP.6 ADV_IMP.2 ADV_INT.3 ADV_SPM.1 ADV_TDS.6 AGD_OPE.1 AGD_PRE.1 ALC_CMC.5 ALC_CMS.5 ALC_DEL.1 ALC_DVS.2 ALC_LCD.2 ALC_TAT.3 ASE_CCL.1 ASE_ECD.1 ASE_INT.1 ASE_OBJ.2 ASE_REQ.2 ASE_SPD.1 ASE_TSS.1 ATE_COV.3 ATE_DPT.4 ATE_FUN.2 ATE_IND.3 AVA_VAN.5",
}


def resolve(found: DataFrame) -> DataFrame:
    """(dgst, family, level): one level a family, from (dgst, source, text).

    Sources by rank: security_level, target, report; inside one the highest level.
    Texts that are no requirement, or lack a level, are passed over.
    """
    rank = F.when(F.col("source") == "security_level", 3).when(F.col("source") == "target", 2).when(F.col("source") == "report", 1)
    rows = found.select("dgst", rank.alias("rank"), columns.assurance(F.col("text")).alias("a")).where("rank is not null and a is not null")
    best = rows.groupBy("dgst", "a.family").agg(F.max(F.struct("rank", "a.level")).alias("best"))
    return best.select("dgst", "family", "best.level")


def actual(certs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(dgst, family, level): what the certificate's level (`eal`) implies, and the
    extracted ones, which hold even where they are lower."""
    table = F.create_map(*[F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x.split())) for kv in IMPLIED.items() for i, x in enumerate(kv)])
    implied = certs.select("dgst", F.explode(F.try_element_at(table, F.regexp_replace("eal", r"\+$", ""))).alias("text")).select("dgst", columns.assurance(F.col("text")).alias("a"))
    rows = implied.select("dgst", "a.family", F.lit(0).alias("own"), "a.level").union(resolved.select("dgst", "family", F.lit(1), "level"))
    return rows.groupBy("dgst", "family").agg(F.max(F.struct("own", "level")).alias("best")).select("dgst", "family", "best.level")


def flat_rules(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, pattern) of a nested mapping whose leaves are lists of patterns."""
    out: list[tuple[str, str]] = []
    for name, sub in tree.items():
        path = f"{prefix}.{name}" if prefix else str(name)
        out += flat_rules(sub, path) if isinstance(sub, dict) else [(path, p) for p in sub or []]
    return out


def read_rules(path: str) -> list[tuple[str, str]]:
    """Rules of a JSON file, or of a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return flat_rules(yaml.safe_load(f))
        return flat_rules(json.load(f))


def subset(rules: list[tuple[str, str]], path: str) -> list[tuple[str, str]]:
    """The rules at or under a dotted path."""
    return [r for r in rules if r[0] == path or r[0].startswith(f"{path}.")]


def keyword_matrix(counts: DataFrame, paths: list[str]) -> DataFrame:
    """A row for each key, a column for each path: how often anything under it was found; 0 if never.

    `counts` are the long counts (key, path, match, n) of vulnerabilities.keyword_counts.
    """
    under = lambda p: F.coalesce(F.sum(F.when((F.col("path") == p) | F.col("path").startswith(f"{p}."), F.col("n"))), F.lit(0))
    return counts.groupBy("key").agg(*[under(p).alias(p.replace(".", "_")) for p in paths])


def sums_under(spark: SparkSession, counts: DataFrame, keys: DataFrame, path: str) -> DataFrame:
    """(key, total) for every key: the count under a path, null where nothing was found there."""
    sums = counts.where((F.col("path") == path) | F.col("path").startswith(f"{path}.")).groupBy("key").agg(F.sum("n").alias("total"))
    return keys.select("key").distinct().join(sums, "key", "left")


def references(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, known): references between certificates by digest, from named ids.

    `found` has dgst, named (canonical ids its texts name); `ids` has dgst, cert_id. Of
    certificates that share an id the first digest holds. A certificate's own id is no
    reference. A name that no certificate bears keeps the name as dst and is not known.
    """
    first = ids.where("cert_id is not null").groupBy("cert_id").agg(F.min("dgst").alias("dst"))
    own = ids.select("dgst", F.col("cert_id").alias("own"))
    named = found.select("dgst", "named").distinct().join(own, "dgst", "left").where("own is null or named <> own")
    out = named.join(first.withColumnRenamed("cert_id", "named"), "named", "left")
    return out.select(F.col("dgst").alias("src"), F.coalesce(F.col("dst").cast("string"), "named").alias("dst"), F.col("dst").isNotNull().alias("known")).distinct()
