"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.sources.staging import shared_folder

#: A side of a join is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows go to Python in Arrow batches of few rows, as texts can be long; a setting other than Spark's default is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that all executors share, and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, folders: str | None = None) -> DataFrame:
    """As cut, but written as Parquet: smaller for wide or repetitive rows; on demand with a folder for each value of a column. The table is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    (df.write.partitionBy(folders) if folders else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that named (doc_id, text_hash, gone) calls gone; of the other rows that it names, one of each stays. Columns as before.

    Rows are told apart by their id, null included, and their text, and pass straight through if they aren't named.
    """
    named = cut(named)
    private = {c: f"__{c}_{uuid.uuid4().hex}" for c in ("doc_id", "text_hash", "gone")}
    named = named.select(*(F.col(c).alias(p) for c, p in private.items()))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(private["doc_id"])) & (text_key(F.col(text_col)) == F.col(private["text_hash"]))
    rest = docs.join(small_side(named, named.count()), same, "left_anti")
    twice = named.where(~F.col(private["gone"]))
    again = docs.join(small_side(twice, twice.count()), same, "left_semi").dropDuplicates([id_col, text_col])
    return rest.unionByName(again)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. Texts of ASCII only take the faster built-in function."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def crc32_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def batches(frames: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The frames in slices of at most so many rows, so that what a worker derives from one slice stays small."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def text_slices(texts: pd.Series, chars: int = 1 << 19) -> Iterator[pd.Series]:
    """The texts in slices of about so many characters; a longer text is a slice of its own."""
    at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // chars
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(texts)], strict=True):
        yield texts.iloc[a:b]


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_rows: Callable[[Column], Column], id_col: str, text_col: str, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample for fitting (text, label) in one partition: of each class the ids with the smallest hashes, and of rows of equal id the least text. Texts are whole.

    Also how many labelled rows each class has in all.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fit_rows(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for value in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # 2 x max_rows rows at most
    rows = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).where(F.col("label").isin(0, 1)).collect()}
    one = text.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return one.orderBy("doc_id").limit(2 * max_rows), rows  # the limit holds for all ids and brings them into one partition


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], dict | None]) -> dict | None:
    """What fit(texts, labels) gives on a bounded sample (text, label), made in one task of an executor; the driver gets the model only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        labels: list[int] = []
        for f in frames:
            texts += f["text"].tolist()
            labels += f["label"].tolist()
        yield pd.DataFrame({"model": [pickle.dumps(fit(texts, labels))]})

    found = sample.select("text", "label").coalesce(1).mapInPandas(run, "model binary").collect()  # one row
    return pickle.loads(found[0]["model"]) if found else None
