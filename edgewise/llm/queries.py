"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, fingerprint, langid, mixing, ngram_join, pii, \
    prefix_trie, repeats, secret_scan, toxicity, whitening
from .common import held_out, load


def tokenizer_path() -> str:
    """Place of the public word-level BPE file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(load(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                        secret_scan.spans_text().alias("spans"), "n_copied", "n_live")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.scores(docs, lexicon, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    vocabulary = bpe.read_vocabulary(tokenizer_path())
    return bpe.encoded(docs, vocabulary, bpe.compile_lexicon(docs, vocabulary), ["doc_id"], digests=True)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(load(spark, sf_dir, "conversations"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.dealt(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.size("shards")).alias("taken"), F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(load(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predictions(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(load(spark, sf_dir, "conversations"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.learn(docs), ["doc_id"])
    return found.withColumn("spans", pii.spans_text())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(load(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_secret_scan, op3_toxicity, op4_bpe_encode,
                                op5_chat_format, op6_mix_sources, op7_repeated_passages, op8_ngram_jaccard,
                                op9_exact_dedup, op10_language_id, op11_prefix_trie,
                                op12_pii, op13_whitening)}

SQL = {
    "op5_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        step AS (
            SELECT conv_id, turn, string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3)
                                             ORDER BY role, text) AS s
            FROM t GROUP BY conv_id, turn),
        prefix AS (
            SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS whole,
                   md5(string_agg(coalesce(turn::VARCHAR, '') || chr(4) || s, chr(5)) OVER (
                       PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS h
            FROM step),
        kept AS (
            SELECT min(conv_id) AS conv_id FROM prefix
            WHERE whole AND h NOT IN (SELECT h FROM prefix WHERE NOT whole) GROUP BY h)
        SELECT conv_id, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
               || '<|im_end|>' || chr(10) AS rendered
        FROM t WHERE conv_id IN (SELECT conv_id FROM kept)""",
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op11_prefix_trie": """
        WITH own AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
                   coalesce(role, '') AS r, coalesce(text, '') AS x
            FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (
            -- crc32, bit by bit over the decimal digits
            SELECT c, n, xor(4294967295, list_reduce(
                       [4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
                       lambda a, b: list_reduce([xor(a, b)] || range(8),
                                                lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
            FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
        family AS (
            SELECT a.c, a.h, a.c - a.c % 5 AS head, least(a.h, coalesce(b.n, 0)) AS q
            FROM ids a LEFT JOIN ids b ON b.c = a.c - a.c % 5),
        rebuilt AS (
            SELECT f.c, o.i + 1 AS d, o.r, o.x FROM family f JOIN own o ON o.c = f.head AND o.i < f.q
            UNION ALL
            SELECT f.c, o.i - f.h + f.q + 1, o.r, o.x FROM family f JOIN own o ON o.c = f.c AND o.i >= f.h),
        prefix AS (
            SELECT c, d, strlen(x) AS size, string_agg(sha256(r) || sha256(x), '') OVER (
                       PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
            UNION ALL SELECT c, 0, 0, '' FROM ids),
        last AS (SELECT c, max(d) AS n FROM prefix GROUP BY c),
        node AS (
            SELECT p.d, p.path, min(p.c) AS conv_id, count(*) AS n, any_value(p.size) AS size,
                   string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (p.d = l.n) AS ends
            FROM prefix p JOIN last l USING (c) GROUP BY p.d, p.path),
        edge AS (SELECT DISTINCT a.path AS up, b.path AS path
                 FROM prefix a JOIN prefix b ON a.c = b.c AND b.d = a.d + 1),
        kids AS (SELECT up, count(*) AS k FROM edge GROUP BY up),
        below AS (SELECT DISTINCT a.path AS top, b.path AS path FROM prefix a JOIN prefix b ON a.c = b.c AND b.d >= a.d),
        sums AS (
            SELECT top, sum((n.n - 1) * n.size)::BIGINT AS saved, count(*) FILTER (k.k IS NULL) AS leaves
            FROM below b JOIN node n ON n.path = b.path LEFT JOIN kids k ON k.up = b.path GROUP BY top)
        SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children,
               s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM node n JOIN sums s ON s.top = n.path LEFT JOIN kids k ON k.up = n.path
             LEFT JOIN edge e ON e.path = n.path LEFT JOIN node u ON u.path = e.up""",
}
