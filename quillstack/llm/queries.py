"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts without words link with nothing; rows with equal ids are one document, a row without an id is kept."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts hold nothing; repeated rows stay as they are; items without words match nothing."""
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; repeated rows and ids stay as they are."""
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; repeated rows are each other's repeats, so copies of 400 bytes lose all of them."""
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400, passage_words=51).drop("spans")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids; repeated rows stay as they are."""
    import public_tokenizers

    from .piece_codec import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null HTML is an empty payload; of equal payloads the largest page_id responds."""
    from .warc import capture_histories

    return capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without words have no perplexity and are accepted; repeated rows stay as they are."""
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the model's bias; a document is toxic if any of its labels says so; repeated rows stay."""
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts stay null; of equal lines the earliest by id and place stays; repeated rows don't count as earlier than each other."""
    from .line_dedup import drop_duplicate_lines

    return drop_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_equal=1)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a direction link with nothing; a row without an id has no component and is kept; ids are whole numbers."""
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, non-finite components and rows without an id take no part; ties go to the smaller id; repeated rows are candidates of each other."""
    from .exact_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have zeros and an empty digest; repeated rows are documents of their own."""
    import public_tokenizers

    from .alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a conv_id are left out; null roles and texts are empty; turns that tie go by role and text; no conversations give no node."""
    from .prefix_trie import prefix_trie, with_shared_heads

    return prefix_trie(table(spark, sf_dir, "conversations"), with_shared_heads)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_topk": op13_exact_topk,
}

#: One bit of a CRC-32, and the whole of a conversation id's, modulo 6.
_BIT = "xor({0} >> 1, 3988292384 * ({0} & 1))"
_BYTE = "xor(a, b)"
for _ in range(8):
    _BYTE = _BIT.format(f"({_BYTE})") if _ == 0 else f"list_transform([{_BYTE}], lambda z: {_BIT.format('z')})[1]"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {_BYTE}), 4294967295) % 6"

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
        ),
        reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, vec_id <= coalesce(low.y, vec_id) AS kept
        FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
        d AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT + 1, 1)), '') AS payload_digest
            FROM h
        ),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k
    """,
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        k AS (SELECT c, c - c % 100 AS b, {_CRC} AS h FROM (SELECT DISTINCT c FROM t)),
        r AS (
            SELECT k.c, 0 AS part, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.b AND t.pos <= k.h
            UNION ALL SELECT k.c, 1, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h
        ),
        d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, role, text FROM r),
        s AS (SELECT c, depth, text, string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth) AS way FROM d),
        m AS (
            SELECT c, depth, length(text) AS size, sha256(way) AS node, coalesce(lag(sha256(way)) OVER (PARTITION BY c ORDER BY depth), '') AS parent, depth = max(depth) OVER (PARTITION BY c) AS last FROM s
            UNION ALL SELECT k.c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM s WHERE s.c = k.c) FROM k
        ),
        n AS (
            SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(size) AS size,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
            FROM m GROUP BY node
        ),
        kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
        below AS (
            SELECT m.node, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE kids.node IS NULL) AS leaves
            FROM n JOIN m ON m.c = n.conv_id AND m.depth <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY m.node
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children,
            below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN below USING (node) LEFT JOIN n p ON p.node = n.parent LEFT JOIN kids ON kids.node = n.node
    """,
    "op13_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) <= 5
    """,
}
