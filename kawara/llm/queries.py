"""The training-data operators over the tables of a folder, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kawara.llm import bpe, chat, fingerprints, html, minhash, packing, quality, substrings, toxicity, warc
from kawara.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -7L AS conv_id, inline(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role)))")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(rows.unionByName(extra.withColumn("text", F.lit(said))))


QUERIES = (
    op1_minhash_dedup,
    op2_bpe,
    op3_substring_dedup,
    op4_quality,
    op5_fingerprints,
    op6_toxicity,
    op7_html,
    op8_packing,
    op9_warc,
    op10_chat,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


NEAR_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word, len(w) AS n FROM d),
 g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM t),
 c AS (SELECT doc_id, s, count(*) AS k FROM g WHERE i <= greatest(n - 4, 1) GROUP BY 1, 2), z AS (SELECT doc_id, sum(k) AS k FROM c GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.k, b.k)) AS common FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN z u ON u.doc_id = x JOIN z v ON v.doc_id = y WHERE common::DOUBLE / (u.k + v.k - common)::DOUBLE >= 0.8e0
  UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM d),
 l AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
 r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id WHERE r.root < l.y)
 SELECT id AS doc_id, min(root) AS class_id FROM r GROUP BY 1"""

SUBSTRING_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word, len(w) AS n FROM d),
 s AS (SELECT doc_id, i, word, CASE WHEN i <= n - 12 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS run FROM t),
 h AS (SELECT doc_id, i, word, CASE WHEN run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id THEN 1 ELSE 0 END AS hit FROM s),
 c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
 r AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
 SELECT doc_id, coalesce(n_words, 0) AS n_words, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
 SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM f"""

CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS esc FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
 cast(sum(12 + length(role) + 1 + length(esc) + 11) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are tested against plain Python.

    The SQL of op1 compares all pairs that share a shingle, so it holds where the signatures miss no link.
    """
    return {"op1_minhash_dedup": NEAR_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op9_warc": WARC_SQL, "op10_chat": CHAT_SQL}
