"""A compact table of tracks: elements of vectors as codes of four bits, ratings packed, paths from a dictionary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions.ranks import quantiles

#: Levels of a codebook, and tracks of a block.
LEVELS, BLOCK = 16, 4096
COLUMNS = {"vec_id": "long", "v": "array<double>", "e": "int", "m": "int", "c": "int", "p": "int", "path": "string"}


def codebooks(rows: DataFrame) -> DataFrame:
    """i, levels: for each element of the vectors of ``rows`` (v) its exact quantiles at the middles of LEVELS equal shares."""
    long = rows.select(F.posexplode("v").alias("element", "value"))
    books = quantiles(long, ["element"], "value", [(k + 0.5) / LEVELS for k in range(LEVELS)])
    return books.select(F.col("element").alias("i"), F.transform("breaks", lambda x: F.round(x, 9)).alias("levels"))


def nearest(v: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of ``v`` (rows x elements): the nearest level of each element's book (elements x levels, rising); ties go to the lower."""
    codes = np.empty(v.shape, dtype=np.uint8)
    for i, book in enumerate(books):
        codes[:, i] = np.searchsorted((book[1:] + book[:-1]) / 2, v[:, i], side="left")
    return codes


def _halves(codes: np.ndarray) -> bytes:
    """Two codes in a byte, the first in the high half."""
    flat = np.pad(codes.ravel(), (0, codes.size % 2))
    return (flat[::2] << 4 | flat[1::2]).tobytes()


def _whole(raw: bytes, rows: int, width: int) -> np.ndarray:
    packed = np.frombuffer(raw, dtype=np.uint8)
    return np.stack([packed >> 4, packed & 15], axis=1).ravel()[: rows * width].reshape(rows, width)


def _block(frame: pd.DataFrame, books: np.ndarray) -> dict:
    paths, place = np.unique(frame["path"].fillna("").to_numpy(dtype=str), return_inverse=True)
    packed = sum(frame[r].fillna(0).to_numpy(dtype=np.uint16) << (3 * i) for i, r in enumerate("emcp"))
    return {
        "tracks": len(frame),
        "ids": frame["vec_id"].to_numpy(dtype="<i8").tobytes(),
        "codes": _halves(nearest(np.stack(frame["v"].to_list()), books)),
        "ratings": packed.astype("<u2").tobytes(),
        "files": "\n".join(paths.tolist()),
        "places": np.where(frame["path"].isna(), 0xFFFF, place).astype("<u2").tobytes(),
    }


def write_lite(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` (vec_id long, v, ratings e m c p of 0 to 7, path) to a new folder: the codebooks, one row for each
    element, and blocks of about BLOCK tracks of one path's neighbourhood.

    A block is a row of binary columns, so a reader that asks for ratings reads no vectors. Null ratings are written as
    0 and read as null, null paths as null. Paths hold no line breaks. Vectors are neither null nor of different lengths.
    """
    spark = rows.sparkSession
    codebooks(rows).write.parquet(f"{path}/codebooks")
    books = np.array([r["levels"] for r in spark.read.parquet(f"{path}/codebooks").orderBy("i").collect()])  # elements x LEVELS
    count = max(1, -(-rows.count() // BLOCK))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame])
            while len(rest) >= BLOCK:
                yield pd.DataFrame([_block(rest.iloc[:BLOCK], books)])
                rest = rest.iloc[BLOCK:]
        if rest is not None and len(rest):
            yield pd.DataFrame([_block(rest, books)])

    near = rows.select(*COLUMNS).repartitionByRange(count, "path", "vec_id").sortWithinPartitions("path", "vec_id")  # paths of a folder share a dictionary
    near.mapInPandas(pack, "tracks int, ids binary, codes binary, ratings binary, files string, places binary").write.parquet(f"{path}/blocks")


def read_lite(spark: SparkSession, path: str, columns: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    """``columns`` of what write_lite wrote; elements of vectors are the levels that stand for them. Only the parts of a
    block that hold these are read."""
    needed = {"vec_id": ["ids"], "v": ["codes"], "path": ["files", "places"]}
    parts = ["tracks", *dict.fromkeys(p for c in columns for p in needed.get(c, ["ratings"]))]
    books = np.array([r["levels"] for r in spark.read.parquet(f"{path}/codebooks").orderBy("i").collect()]) if "v" in columns else None
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in columns)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                n, out = block["tracks"], []
                for c in columns:
                    if c == "vec_id":
                        out.append(pa.array(np.frombuffer(block["ids"], dtype="<i8")))
                    elif c == "v":
                        codes = _whole(block["codes"], n, len(books))
                        values = books[np.arange(len(books)), codes]
                        out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(books), pa.int32()), pa.array(values.ravel())))
                    elif c == "path":
                        names, places = block["files"].split("\n"), np.frombuffer(block["places"], dtype="<u2")
                        out.append(pa.array([None if p == 0xFFFF else names[p] for p in places.tolist()], pa.string()))
                    else:
                        x = np.frombuffer(block["ratings"], dtype="<u2") >> (3 * "emcp".index(c)) & 7
                        out.append(pa.array(x.astype(np.int32), mask=x == 0))
                yield pa.RecordBatch.from_arrays(out, names=list(columns))

    return spark.read.parquet(f"{path}/blocks").select(*parts).mapInArrow(unpack, schema)
