"""Exact deduplication by two passes of Bloom filtering.

Pass one hashes each text and sets k bits per hash in a bit array; bits that were set twice form
the second array. Pass two tests each hash against that second array: only where all k bits were set
twice can the text be repeated, and only those rows are shuffled and compared by SHA-256. All other
rows pass straight through. A false alarm costs a shuffled row, never a wrong result.

Null texts count as empty, empty texts are equal to each other, and of rows that are equal in text
and id one stays. An empty table gives an empty result. Other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import BROADCAST_ROWS, cut, cut_table, keep_rows, text_key

#: Bits that each row gets in the array, and how many of them its hash sets.
BITS_PER_ROW, HASHES = 16, 3
#: The array is cut into segments of this many bits; offsets in a segment fit two bytes.
SEGMENT_BITS = 1 << 16
#: An array is for at most so many rows (32 MB of bits); more rows take several arrays, one after another.
SLICE_ROWS = 1 << 24
#: Tasks for each slice that write the hashes into the slices' folders.
WRITERS = 8


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _positions(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The k bit positions of each 64-bit hash, a row each."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    bits = np.uint64(segments * SEGMENT_BITS)
    return np.stack([(h + np.uint64(k) * step * np.uint64(0x9E3779B97F4A7C15)) % bits for k in range(HASHES)], axis=1)


def _seen(segments: int):
    """Per task: which offsets of each segment its rows set, once or more often."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_positions(f["h"].to_numpy(), segments).ravel() for f in frames]
        if not parts:
            return
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        segment = (at // np.uint64(SEGMENT_BITS)).astype(np.int64)
        offset = (at % np.uint64(SEGMENT_BITS)).astype("<u2")
        edges = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
        rows = [(int(segment[a]), offset[a:b].tobytes(), offset[a:b][n[a:b] > 1].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        yield pd.DataFrame(rows, columns=["segment", "once", "twice"])

    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Bits of one segment that two rows or more set."""
    count = np.zeros(SEGMENT_BITS, np.int64)
    for once, twice in zip(rows["once"], rows["twice"], strict=True):
        count[np.frombuffer(once, "<u2")] += 1
        count[np.frombuffer(twice, "<u2")] += 1
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [np.packbits(count > 1).tobytes()]})


def _flag(segments: int, bits):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = bits.value
        for f in frames:
            at = _positions(f["h"].to_numpy(), segments)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
            hit = (array[byte] >> (np.uint8(7) - bit)) & 1
            yield f.assign(repeated=hit.all(axis=1))

    return run


def possibly_repeated(hashed: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """hashed (with a long h) plus the boolean repeated: false only for hashes that occur once.

    The hashes are taken in slices of about slice_rows, one array after another, so that no array outgrows its bound and
    none fills up, however many rows there are. With several slices the hashes are written once, a folder a slice, and
    each slice reads its own folder only.
    """
    spark = hashed.sparkSession
    rows = hashed.count()
    slices = max(1, -(-rows // slice_rows))
    segments = int(max(1, -(-rows * BITS_PER_ROW // (slices * SEGMENT_BITS))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hashed.schema) + ", repeated boolean"
    if slices > 1:
        writers = max(spark.sparkContext.defaultParallelism, WRITERS * slices)  # so that folders don't fill up with small files
        sliced = cut_table(hashed.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("int")).coalesce(writers), "slice")
    out = None
    for i in range(slices):
        own = hashed if slices == 1 else sliced.where(F.col("slice") == i).drop("slice")
        seen = own.select("h").mapInPandas(_seen(segments), "segment long, once binary, twice binary")
        merged = seen.groupBy("segment").applyInPandas(_merged, "segment long, bits binary")
        array = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
        for row in merged.toLocalIterator():
            at = row["segment"] * SEGMENT_BITS // 8
            array[at : at + SEGMENT_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
        bits = spark.sparkContext.broadcast(array)
        flagged = own.mapInPandas(_flag(segments, bits), schema)
        if slices > 1:
            flagged = cut(flagged)
            bits.destroy()
        out = flagged if out is None else out.unionByName(flagged)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The text is read once; what goes on is the id, the digest and a row number that is fixed by being
    written. Of equal texts the row with the largest id stays; of equal ids, one row.
    """
    return _groups(docs, id_col, text_col, slice_rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _groups(docs: DataFrame, id_col: str, text_col: str, slice_rows: int = SLICE_ROWS, large_groups: int = BROADCAST_ROWS) -> DataFrame:
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), text_key(F.col(text_col)).alias("text_hash"))
    hashed = cut(hashed.withColumns({"h": F.xxhash64("digest"), "row": F.monotonically_increasing_id()}))
    flagged = possibly_repeated(hashed, slice_rows)
    alone = flagged.where(~F.col("repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "text_hash"
    )
    again = cut(flagged.where("repeated").select("doc_id", "digest", "row", "text_hash"))
    best = again.groupBy("digest").agg(
        F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "row", "doc_id")).alias("best"), F.count("*").alias("group_size")
    )
    best = cut(best)
    # The largest groups are broadcast, so that no group meets in one task; by their share of the rows they are BROADCAST_ROWS at most.
    is_large = F.col("group_size") * F.lit(large_groups) >= F.lit(again.count())
    large = F.broadcast(best.where(is_large))
    rest = again.join(large, "digest", "left_anti").join(best.where(~is_large), "digest")
    joined = again.join(large, "digest").unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest", "text_hash"
    )
    return alone.unionByName(joined)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated texts; columns as before. Only rows that go, or stand for rows that are equal in id as well, are named and looked up."""
    again = _groups(docs, id_col, text_col).where(F.col("group_size") > 1)
    # A row is gone if its id isn't the one that stays; rows of equal id and text are told apart by none of them.
    gone = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    named = again.groupBy("doc_id", "text_hash", gone.alias("gone")).agg(F.count("*").alias("times")).where(F.col("gone") | (F.col("times") > 1))
    return keep_rows(docs, named.select("doc_id", "text_hash", "gone"), id_col, text_col)
