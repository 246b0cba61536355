"""The queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import alignment, bpe, chat, exact_dedup, fingerprints, jaccard_join, language_id, licences, mixing, paragraphs, repair, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    conversations, edits = repair.repair_conversations(repair.damage(turns))
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    out = ids.join(conversations, ids["_id"].eqNullSafe(conversations["conv_id"]), "left").drop("conv_id")
    digests = repair.repaired_digests(edits)
    out = out.join(digests, out["_id"].eqNullSafe(digests["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return chat.read_back(chat.format_conversations(chat.event_log(turns.unionByName(own))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_read(spark, sf_dir, "documents"), columns=("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": op2_mixing,
        "op3_licences": op3_licences,
        "op4_bpe": op4_bpe,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_warc": op7_warc,
        "op8_fingerprints": op8_fingerprints,
        "op9_toxicity": op9_toxicity,
        "op10_paragraphs": op10_paragraphs,
        "op11_repair": op11_repair,
        "op12_chat": op12_chat,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op2_mixing": rf"""
            WITH sized AS (
              SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
            sources AS (
              SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS w
              FROM sized GROUP BY source),
            filled AS (
              SELECT *, source_size * 3.0::DOUBLE / w AS ratio,
                     ((SELECT sum(source_size) FROM sources)
                       - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM sources),
            wanted AS (
              SELECT source, source_size,
                     round(least(source_size * 3.0::DOUBLE, w * (SELECT level FROM filled WHERE level < ratio ORDER BY ratio, source NULLS LAST LIMIT 1)), 6) AS target
              FROM filled),
            placed AS (
              SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
                     CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * {mixing.UNIT} + 0.5) AS BIGINT) ELSE 0 END AS units
              FROM sized s JOIN wanted t ON s.source IS NOT DISTINCT FROM t.source),
            laid AS (
              SELECT *, CAST(sum(units) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) + {mixing.offset_units(42)} AS upto
              FROM placed)
            SELECT doc_id, size, source_size, target, ((upto >> {mixing.UNIT_BITS}) - ((upto - units) >> {mixing.UNIT_BITS})) * size AS taken FROM laid""",
        "op5_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {folded} AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
            FROM t""",
        "op7_warc": """
            WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            f AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
                         min(page_id) OVER (PARTITION BY body) AS first FROM t)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
            FROM f""",
        "op12_chat": r"""
            WITH c AS (
              SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e AS (
              SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g') AS shown,
                     regexp_replace(role, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g') AS named FROM c)
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(length(shown) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 19 + length(named) END) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
    }
