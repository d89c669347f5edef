"""The corpus operators over the test tables, with production parameters, and SQL where it can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import extraction, fixity, images, mixing, negatives, phrases, pieces, pivots, rollups, sharding, simhash, spelling, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The SentencePiece model of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.page_audit(table(spark, sf_dir, "pages"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rollups.maintained(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), "byte_bpe_50k", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model(), keep=False)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.copies(images.drawn(table(spark, sf_dir, "pages")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_substrings": op4_substrings,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_media": op9_media,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_extraction": op12_extraction,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op1_embeddings": pivots.ORACLE_SQL, "op3_warc": fixity.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op11_negatives": negatives.ORACLE_SQL, "op12_extraction": extraction.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
