"""The opN_<name> queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, embedding_dedup, fingerprints, mixing, packing, prefix_trie, quality, secrets, simhash_dedup, suffix_dedup, warc


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), radius=3)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=1000)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), rate=0.05)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


OP2_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE ok),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
  SELECT a, min(b) AS low FROM r GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, reach.low AS component_id,
  v.vec_id = reach.low AS kept
FROM v JOIN reach ON reach.a = v.vec_id
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.public_vocabulary())


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    planted = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{tricky}' AS text")
    return chat.digests(said.unionByName(planted))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(n)
), m AS (
  SELECT *, contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') OR contains(role, chr(92))
      OR contains(role, chr(10)) OR contains(role, '<|im_start|>') OR contains(role, '<|im_end|>') AS conflict,
    length(role) - length(replace(replace(role, chr(92), ''), chr(10), '')) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS marks
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 24) + CASE WHEN bool_or(conflict) THEN sum(marks) ELSE 0 END AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), radius=4, words=4)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.public_vocabulary("word_bpe_49k.json"), capacity=4096, end=1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), period=5, most=9)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment.align(docs, bpe.public_vocabulary("byte_bpe_50k.json"), bpe.public_vocabulary("piece_bpe_32k.model"))


OP12_SQL = """
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(length(r) || ':' || r || x ORDER BY turn NULLS FIRST, r, x) AS k, list(octet_length(encode(x)) ORDER BY turn NULLS FIRST, r, x) AS s
  FROM raw GROUP BY conv_id
), steps AS (
  SELECT *, [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM own
), hashed AS (
  SELECT *, xor(list_reduce(steps, lambda c, b: CASE WHEN b < 0 THEN xor(c >> 1, (c & 1) * 3988292384) ELSE xor(c, b) END), 4294967295) % 9 AS h FROM steps
), rebuilt AS (
  SELECT a.conv_id, coalesce(b.k[1:a.h], []) || a.k[a.h + 1:] AS k, coalesce(b.s[1:a.h], []) || a.s[a.h + 1:] AS s
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
  SELECT conv_id, k, s, unnest(range(0, len(k) + 1)) AS d FROM rebuilt
), nodes AS (
  SELECT d, k[1:d] AS key, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN d > 0 THEN s[d] ELSE 0 END) AS size,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(k) = d), '') AS ends
  FROM prefixes GROUP BY 1, 2
), children AS (
  SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), counted AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, key)
), sums AS (
  SELECT a AS d, key[1:a] AS key, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1, 2
)
SELECT c.conv_id, c.d AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums ON sums.d = c.d AND sums.key = c.key LEFT JOIN nodes up ON up.d = c.d - 1 AND up.key = c.key[1:c.d - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op6_chat_formatting": OP6_SQL, "op12_prefix_trie": OP12_SQL}
