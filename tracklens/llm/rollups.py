"""Operator 7: token counts in rollups maintained by deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import shared_dir, written

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("documents", "tokens", "chars")


def token_counts(docs: DataFrame, ranks: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars for every row of ``docs`` (doc_id, text, source,
    lang): the number of byte-level BPE tokens of the whole text.

    ``ranks`` is a path of a tiktoken rank file that every executor can read; ``tokenizer`` names the
    version that the counts belong to. Null and empty texts have none. Texts of any length are
    cut only where the pattern of the encoding cuts them. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), batch.column(4)], names=["doc_id", "source", "lang", "tokens", "chars"])

    some = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    counted = some.mapInArrow(run, "doc_id long, source string, lang string, tokens long, chars long")
    return counted.withColumn("tokenizer", F.lit(tokenizer)).select("doc_id", *KEYS, "tokens", "chars")


_ENCODINGS: dict = {}


def _encoding(ranks: str):
    """One for each file and Python process."""
    if ranks not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[ranks] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[ranks]


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, lang, tokenizer and the signed change of documents, tokens and chars that turns the
    counted rows ``before`` into ``after``: an insert is +, a delete is -, a revised count or a moved
    document is both. Groups without a change are left out. Sums combine before the shuffle, so a
    source that holds most rows is one row of each task."""
    signed = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    sums = [F.sum("sign").cast("long").alias("documents"), *[F.sum(F.col("sign") * F.col(c)).cast("long").alias(c) for c in ("tokens", "chars")]]
    return signed.groupBy(*KEYS).agg(*sums).where(" OR ".join(f"{c} != 0" for c in TOTALS))


class Rollup:
    """Totals kept as one folder of signed deltas for each committed batch.

    A batch is written to its own folder under a name that its id gives, and counts once Spark's
    commit marker is there. Committing an id again changes nothing: a job that is run again after
    a failure can repeat all its commits.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/tracklens/rollup").rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _has(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def committed(self, batch: str) -> bool:
        return self._has(f"{self.path}/batch={batch}/_SUCCESS")

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Adds the deltas ``change`` as ``batch`` (a plain word); False if it is there already. What a
        failed attempt left is overwritten."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self.committed(batch):
            return False
        change.select(*KEYS, *TOTALS).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens, chars: the sums of all committed batches; groups
        that have come to nothing are left out."""
        fs, where = self._fs(self.path)
        schema = ", ".join([*(f"{c} string" for c in KEYS), *(f"{c} long" for c in TOTALS)])
        done = [x.getPath().toString() for x in (fs.listStatus(where) if fs.exists(where) else [])]
        done = [x for x in done if self._has(f"{x}/_SUCCESS")]
        rows = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS]).where(" OR ".join(f"{c} != 0" for c in TOTALS))


def maintained(docs: DataFrame, ranks: str, tokenizer: str, revised: str | None = None) -> DataFrame:
    """source, lang, tokenizer, documents, tokens, chars of ``docs``, arrived at by deltas.

    All rows are inserted, those whose doc_id leaves 7 modulo 10 with the first half of their text
    and under another source, and these are revised and moved by the next batch, which has counts
    before and after. Rows whose doc_id leaves 3 are deleted and put back; that batch is committed
    twice. With ``revised``, the ranks of a second tokenizer, its counts come in as a version of their own. The totals equal those of one count over all rows:
    null sources and languages are groups of their own; null doc_ids, repeated rows and empty
    texts count as rows. An empty table has no groups.
    """
    import uuid

    rollup = Rollup(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/tracklens/rollup-{uuid.uuid4().hex}")
    rows = written(token_counts(docs, ranks, tokenizer), "token-counts")
    none = rows.limit(0)
    turned = rows.where(F.coalesce(F.col("doc_id") % 10 == 3, F.lit(False)))
    changed = F.coalesce(F.col("doc_id").cast("long") % 10 == 7, F.lit(False))
    half = F.expr("substring(text, 1, CAST(length(text) / 2 AS INT))")
    drafts = docs.where(changed).withColumn("text", half).withColumn("source", F.concat(F.lit("draft-"), F.col("source").cast("string")))
    before = written(token_counts(drafts, ranks, tokenizer), "draft-counts")
    rollup.commit("inserts", deltas(none, rows.where(~changed).unionByName(before)))
    rollup.commit("revisions", deltas(before, rows.where(changed)))
    rollup.commit("deletes", deltas(turned, none))
    rollup.commit("back", deltas(none, turned))
    rollup.commit("back", deltas(none, turned))
    if revised:
        rollup.commit("revised", deltas(none, token_counts(docs, revised, f"{tokenizer}-revised")))
    return rollup.totals()
