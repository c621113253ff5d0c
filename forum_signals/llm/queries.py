"""The registered query of every operator, with its production parameters, and the DuckDB SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forum_signals.llm import byte_bpe, collocations, decontamination, exact_dedup, lm_scoring, merkle, quality, sharding, simhash, substring_dedup, suffix_dedup, token_output, url_filter
from forum_signals.llm.common import id_bucket, record_batch, slices, table
from forum_signals.session import scratch_path

BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Ids of its vocabulary.
VOCABULARY = 50_256
WORD_BPE = "word_bpe_49k.json"
END_ID = 2
SHARDS = 8

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; digests of the ids and of the decoded bytes."""
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, path, pattern).select(F.col("row.doc_id").alias("doc_id"), "ids")
    return bpe_digest(byte_bpe.decode(encoded, path, pattern))


def bpe_digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, ids, decoded) as doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    schema = T.StructType().add("doc_id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimals = pa.array([f"{i} ".encode() for i in range(VOCABULARY)], type=pa.large_binary())
        for part in slices(batches, text=2):
            shas = [hashlib.sha256(x[:-1]).hexdigest() for x in byte_bpe.joined(part.column(1), decimals)]
            sizes = np.diff(part.column(1).offsets.to_numpy())
            yield record_batch(schema, [part.column(0), sizes, shas, [hashlib.sha256(x).hexdigest() for x in part.column(2).to_pylist()]])

    return decoded.select("doc_id", "ids", "decoded").mapInArrow(digested, schema)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified leak."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_texts(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit_documents(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, net, ["doc_id"]).select("row.doc_id", "score")
    return scored.select(
        "doc_id", (id_bucket(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.page_links(pages))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), END_ID)
    return token_output.token_digest(spark, path)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), shards=SHARDS)
    return written.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve", "run",
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all rows by source; every row's leaf, or for tampered rows the changed one, is folded to the root."""
    return manifest_digest(table(spark, sf_dir, "documents"))


def manifest_digest(docs: DataFrame, height: int = merkle.HEIGHT) -> DataFrame:
    tampered = F.when(id_bucket(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        F.col("source").cast("string").alias("group"), F.col("doc_id").alias("id"),
        merkle.leaf_digest(*before, F.col("text")).alias("leaf"), merkle.leaf_digest(*before, tampered).alias("claim"),
    )
    checked = merkle.check(merkle.build(leaves, height=height))
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return checked.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text when the byte strings of earlier documents are removed."""
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_token_output": op8_token_output,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

#: DuckDB SQL of the queries that SQL can express, over the whole tables.
ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), named AS (
            SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
                row_number() OVER same = 1 AS kept, sha256(body) AS text_sha256
            FROM normal WINDOW same AS (PARTITION BY body ORDER BY points DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM named
    """,
    # the given pages declare no canonical or refresh link, so the rules decide alone and the default is to allow
    "op7_url_filter": r"""
        WITH rests AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rests
        ), ruled AS (
            SELECT *, '.' || host AS h, CASE
                WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/'
                WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict,
            CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS reason
        FROM ruled
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), lists AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces
        ), totals AS (
            SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM lists GROUP BY lang
        ), places AS (
            SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists
        ), grams AS (
            SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a
            FROM places, (VALUES (1), (2), (3), (4)) AS sizes(size) WHERE i + size - 1 <= len(ws)
            GROUP BY ALL HAVING count(*) >= 30
        ), candidates AS (
            SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1
        ), hidden AS (
            SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates g
            ON g.lang = c.lang AND g.size > c.size AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * g.a >= 80 * c.a
        ), cuts AS (
            SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM candidates ANTI JOIN hidden USING (lang, phrase)
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (l.a + r.a) AS BIGINT) AS score
            FROM cuts JOIN grams l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:k], ' ')
            JOIN grams r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
