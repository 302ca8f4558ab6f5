"""The registered queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, html_text, packing, quality, sentence_pieces, simhash, suffix_dedup, token_counts, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary-crossing tokens going to where most of them lies."""
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(_table(spark, sf_dir, "embeddings"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every conversation turn, decoded again."""
    import public_tokenizers

    return sentence_pieces.sample_segmentations(_table(spark, sf_dir, "conversations"), ("conv_id", "turn"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    gone = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_simhash_near_dedup, op3_html_extraction, op4_warc, op5_packing, op6_quality_classifier, op7_embedding_near_dedup, op8_exact_top_k, op9_sentencepiece, op10_suffix_array_dedup)
}

#: Where SQL can say the same over whole tables.
ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS main FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN main <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN main <> page_id THEN main END AS refers_to
        FROM m""",
    "op7_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op8_exact_top_k": """
        WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_suffix_array_dedup": """
        WITH n AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM n WHERE n >= 100),
        x AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k FROM w),
        r AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
        runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY 1, 2),
        parts AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS p FROM runs
                  UNION ALL SELECT doc_id, n + 1, coalesce(max(z), 1) FROM n LEFT JOIN runs USING (doc_id) GROUP BY doc_id, n),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2 * (a - p)), '' ORDER BY a) AS k FROM parts JOIN n USING (doc_id) GROUP BY 1),
        gone AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY 1)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
}
