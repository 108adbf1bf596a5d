"""The text operators applied to their whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hamming, negatives, orderhash, packing, quality, secrets, sharding, simhash, substrings, tokencount, transcripts, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the box keeps the public vocabularies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_secrets", secrets.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, vocabulary_path())
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab).select("doc_id", "ids"), vocab)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


HAMMING_SQL = f"""
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS bits FROM embeddings WHERE embedding IS NOT NULL),
packed AS (SELECT vec_id, CAST(array_to_string(bits[1:{hamming.WIDTH}], '') AS BIT) AS code FROM codes),
pairs AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, n.code)) AS INTEGER) AS distance
  FROM packed q, packed n WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= {hamming.TOP}"""


@query("op4_hamming", HAMMING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(codes, codes.where("id % 50 = 0"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "score", "expected_grade", "tail", (F.col("tail") >= quality.LEAST_TAIL).alias("selected"))


@query("op6_transcripts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    raw = turns.select("conv_id", "turn", "role", transcripts.transcript(F.col("role"), F.col("conv_id"), F.col("turn"), F.col("text")).alias("text"))
    return transcripts.parse(raw.drop("role"), transcripts.fit(raw))


@query("op7_substrings")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, vocabulary_path())
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocab))


@query("op10_orderhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = orderhash.with_edits(table(spark, sf_dir, "documents"))
    return pairs.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@query("op11_tokencount")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, vocabulary_path("byte_bpe_50k.json"))
    counted = tokencount.counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op12_negatives", negatives.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), negatives.quantized(F.col("embedding")).alias("x"))
    return negatives.mine(rows, rows.where("id % 100 = 0"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", negatives.quantized(F.col("embedding")).alias("x"))
    return whitening.whiten(rows, id="vec_id", vector="x")
