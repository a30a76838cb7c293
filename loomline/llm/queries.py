"""The registered queries of this subpackage, with production parameters over whole tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import code_compression, conversation_trie, decontaminate, embedding_dedup, html_extract, packing, pii, quality, secret_scan, simhash_dedup, toxicity, vantage_search, warc
from loomline.llm.spark_io import read


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back, as captures with the digest of their payload."""
    return warc.captures(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at two differing bits or fewer."""
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage similar to a benchmark item, and which."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the factorisation machine."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal labels at a cosine of 0.98."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without the templates of its host."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.scan(read(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by compression distance."""
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return vantage_search.nearest(read(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie.trie(read(spark, sf_dir, "conversations"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 16 codes of its parts."""
    return code_compression.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_code_compression": op13_code_compression,
}


def _round(n: int) -> str:
    """One round over the codebooks c{n}: the nearest entry of each part (distance * 64 + index, the least), and the entries after it."""
    return f"""a{n} AS (
            SELECT vec_id, s.p, any_value(q) AS q, min(list_sum(list_transform(range(1, len(q) + 1), lambda j: (q[j] - c[j]) * (q[j] - c[j])))::BIGINT * 64 + k) AS best
            FROM s JOIN c{n} USING (p) GROUP BY vec_id, s.p
        ), m{n} AS (
            SELECT p, k, list((t - ((t % n) + n) % n) // n ORDER BY j) AS c FROM (
                SELECT p, best % 64 AS k, j, sum(q[j])::BIGINT AS t, count(*) AS n FROM (SELECT p, best, q, unnest(range(1, len(q) + 1)) AS j FROM a{n}) GROUP BY ALL
            ) GROUP BY p, k
        ), c{n + 1} AS (SELECT p, k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (p, k))"""


ORACLES: dict[str, str] = {
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), u AS (
            SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v
            WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= CAST(0.98 AS DOUBLE)
        ), r AS (
            SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a
        ), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON a = node
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (
            SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hx,
                min(page_id) OVER (PARTITION BY sha1(body)) AS first_id
            FROM p
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hx, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d
    """,
    "op11_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), d AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d QUALIFY rank <= 10
    """,
    "op12_conversation_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), n AS (
            SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
                list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT),
                lambda crc, b: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, b)), 4294967295)) % 9 AS h
            FROM t GROUP BY conv_id
        ), f AS (SELECT n.*, least(n.h, coalesce(b.own, 0)) AS first FROM n LEFT JOIN n b ON b.conv_id = n.base),
        r AS (
            SELECT f.conv_id, pos AS depth, role, text FROM f JOIN t ON t.conv_id = base WHERE pos <= h
            UNION ALL SELECT f.conv_id, first + pos - h, role, text FROM f JOIN t ON t.conv_id = f.conv_id WHERE pos > h
        ), m AS (
            SELECT conv_id, depth, octet_length(encode(text)) AS bytes, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r
            UNION ALL SELECT conv_id, 0, 0, 'root' FROM n
        ), node AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY depth, k),
        kids AS (SELECT a.depth, a.k, count(DISTINCT b.k) AS n_children FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1 GROUP BY ALL),
        up AS (SELECT DISTINCT b.depth, b.k, a.k AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
        below AS (SELECT DISTINCT a.depth, a.k, b.depth AS to_depth, b.k AS to_k FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        sums AS (
            SELECT o.depth, o.k, sum((x.n_convs - 1) * x.bytes) AS saved, sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS leaves
            FROM below o JOIN node x ON x.depth = to_depth AND x.k = to_k LEFT JOIN kids c ON c.depth = to_depth AND c.k = to_k GROUP BY ALL
        ), last AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
        ends AS (SELECT m.depth, m.k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last JOIN m USING (conv_id, depth) GROUP BY m.depth, m.k)
        SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
            sha256(coalesce(ids, '')) AS ends_sha256
        FROM node x JOIN sums USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN node p ON p.depth = x.depth - 1 AND p.k = up.parent
    """,
    "op13_code_compression": f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (SELECT vec_id, p, e[1 + p * (len(e) // 16) : (p + 1) * (len(e) // 16)] AS q FROM v, range(16) t(p)),
        c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, q AS c FROM s QUALIFY k < 64),
        {_round(0)}, {_round(1)}, {_round(2)},
        w AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM w JOIN v USING (vec_id), h
    """,
}
