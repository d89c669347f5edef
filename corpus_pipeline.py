"""A corpus pipeline of the operators in tracklens.llm: from raw documents to token ids."""

from pyspark.sql import DataFrame, SparkSession

from tracklens.llm import copies, mixing, phrases, pieces, toxicity
from tracklens.llm.common import scratch, written
from tracklens.llm.queries import piece_model, table

#: Trained models, decoders and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None

#: Documents that Spark and a Python worker hand each other at once. Documents are long: by Spark's own 10,000 a batch has tens of
#: megabytes, which each task holds several times on both sides.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands over BATCH_ROWS at once. What a stage returns is computed after it returned, so this stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose restored text scores as toxic go."""
    small_batches(spark)
    with scratch(spark):
        model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, with five words and a check of the whole sets: fingerprints within four bits meet by its multi-index
    search, pairs of a Jaccard similarity of 0.8 at least link, one document of each group stays. As such pairs often
    differ in more bits, MinHash bands find what the fingerprints leave."""
    small_batches(spark)
    return copies.without_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages that recur in what is left are cut out of the texts."""
    small_batches(spark)
    return phrases.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sources are mixed to their target weights; a document may be taken twice."""
    small_batches(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the texts as ids, with the digest of what these decode to."""
    small_batches(spark)
    return pieces.encode_decode(docs, piece_model()).drop("decoded")


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("substrings", substrings), ("mixing", mix), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs if name == STAGES[0][0] else written(docs, f"before-{name}"), sf_dir)
    return docs
