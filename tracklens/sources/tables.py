"""Where tables come from and go to: Parquet tables of a folder, JSON lines, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Classification records as JSON lines: fixed fields, open features.
CLASSIFICATIONS = "sid_path string, song_index int, ratings struct<e:double,m:double,c:double,p:double>, features map<string,string>, vector array<double>, classified_at string, source string, render_engine string, degraded boolean, _corrupt string"
#: Feedback records as JSON lines, in folders by day.
FEEDBACK = "ts string, sid_path string, song_index int, action string, uuid string, _corrupt string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all .jsonl files under ``path``; lines that are no JSON keep their text in _corrupt."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)
