"""The subpackage's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm import (
    conversation_repair, exact_dedup, fingerprint, langid, license_scan, mixing, near_dedup, packing, piece_bpe, quality, sharding, token_alignment, token_count,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _docs(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, _docs(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(spark, _docs(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, _docs(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    learned = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(spark, docs.select("doc_id", "text"), learned)
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(spark, _docs(spark, sf_dir), _vocab("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _docs(spark, sf_dir), _vocab("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _docs(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(spark, conversation_repair.damage(turns))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_alignment.align_tokens(spark, _docs(spark, sf_dir), _vocab("byte_bpe_50k.json"), _vocab("piece_bpe_32k.model"))
    return got.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocab("piece_bpe_32k.model")
    got = piece_bpe.decode(spark, piece_bpe.encode(spark, _docs(spark, sf_dir), path), path)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_exact_dedup, op3_fingerprints, op4_sharding, op5_language_id, op6_token_counts, op7_quality,
        op8_packing, op9_license_scan, op10_mixing, op11_conversation_repair, op12_token_alignment, op13_piece_bpe,
    )
}

#: The least edits up to a turn, by the role retained last, as (cost, audit, text): the
#: least of structs is that of the cost, then of the audit.
_NONE = "CAST(NULL AS STRUCT(c BIGINT, d VARCHAR, t VARCHAR))"


def _way(last: str, cost: str, letters: str, text: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {last} IS NOT NULL AND {when} THEN {{'c': {last}.c + {cost}, 'd': {last}.d || {letters}, 't': {last}.t || {text}}} ELSE {_NONE} END"


def _stay(last: str, role: str, inserts: int) -> str:
    """One turn more is kept or reroled to `role`, after as many inserts."""
    other = {"user": "assistant", "assistant": "user"}.get(role, "")
    added = f"chr(10) || '{other}:' || " if inserts else ""
    own = f"left(role, 1) = '{role[0]}'"
    line = f"{added}chr(10) || CASE WHEN {own} THEN role ELSE '{role}' END || ':' || text"
    cost = f"CASE WHEN {own} THEN 0 ELSE 3 END + CASE WHEN truncated THEN 3 ELSE 0 END + {3 * inserts}"
    when = "NOT blank AND NOT duplicate" + (f" AND {own}" if role == "system" else "")
    return _way(last, cost, f"'{'I' * inserts}' || CASE WHEN {own} THEN 'K' ELSE 'R' END", line, when)


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _gone(last: str) -> str:
    return _way(last, "4", "'D'")


_REPAIR = rf"""
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS v
        FROM range(256) AS r(i)
    ), keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
    ), hashed AS (
        SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
               lambda c, b: xor(c // 256, v[xor(c, b) % 256 + 1]))) % 20 AS h FROM keyed, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM hashed WHERE h <> 0
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
               regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final FROM damaged
    ), marked AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen FROM numbered
    ), judged AS (
        SELECT *, final = '' AS blank, final <> '' AND seen AS duplicate, final <> '' AND NOT seen AND final NOT IN ('.', '!', '?') AS truncated,
               left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair FROM marked
    ), steps AS (
        SELECT conv_id AS conv, 0::BIGINT AS done, {{'c': 0::BIGINT, 'd': '', 't': ''}} AS o, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv, n, {_gone("o")}, {_least(_gone("s"), _stay("o", "system", 0))},
               {_least(_gone("u"), _stay("o", "user", 0), _stay("s", "user", 0), _stay("u", "user", 1), _stay("a", "user", 0))},
               {_least(_gone("a"), _stay("o", "assistant", 1), _stay("s", "assistant", 1), _stay("u", "assistant", 0), _stay("a", "assistant", 1))}
        FROM steps JOIN judged ON conv_id IS NOT DISTINCT FROM conv AND n = done + 1
    ), final AS (
        SELECT conv, {_least("o", "a", _way("u", "3", "'I'", "chr(10) || 'assistant:'"), _way("s", "6", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"))} AS best
        FROM steps QUALIFY row_number() OVER (PARTITION BY conv ORDER BY done DESC) = 1
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum(duplicate::BIGINT) AS duplicate,
               sum(truncated::BIGINT) AS truncated, coalesce(sum((pair NOT IN ('su', 'ua', 'au'))::BIGINT), 0) AS illegal FROM judged GROUP BY conv_id
    )
    SELECT conv AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.d AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
    FROM final LEFT JOIN counted ON conv_id IS NOT DISTINCT FROM conv"""

ORACLE_SQL = {
    "op11_conversation_repair": _REPAIR,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY d) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY d) AS kept, d AS text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents)""",
}
