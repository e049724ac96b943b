"""Sharding by vector bin packing.

Groups of equal texts are placed so that bytes, tokens and rows of all shards come out jointly balanced: the
groups go, from the largest on, to the shard where the dot product of the group's sizes with the shard's
residual capacity is highest. Sizes are shares of the totals; bytes weigh more, as the law that holds is
`bytes`: sizes near equal.

What is packed on the driver is bounded whatever the input: groups above 1/16384 of a total count singly (at
most 3 x 16384 of them), all others are packed by hash bucket (16384 of them). Both are summed by Spark. A group
larger than a shard's capacity can't stay whole and is split by a hash of the ids. Moves that even out the bytes afterwards
are chosen so that tokens and rows come closer as well, or drift least. Tokens are counted with a public vocabulary.

Null texts count as empty. Texts that are empty form a group like any other. An empty table gives an empty result;
equal ids are put in order by the text's checksum. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.best_fit_packing import ids_of
from terraloom.llm.common import cut, small_batches

#: Groups are counted singly from this share of a total on; all others share so many buckets.
FINE = 1 << 14
ROW_BYTES = 16
DIMENSIONS = ("bytes", "tokens", "rows")
WEIGHTS = (4.0, 1.0, 1.0)


def _token_counts(tokenizer: str | None, ranks: str | None):
    @F.pandas_udf("long")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = ids_of(tokenizer, ranks)
        for part in texts:
            yield pd.Series([len(ids(t)) for t in part], dtype="int64")

    return counts


def pack(sizes: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item; sizes holds a row of shares of the totals for each item."""
    weighted = sizes * np.asarray(weights)
    left = np.full((shards, sizes.shape[1]), 1.0 / shards) * np.asarray(weights)
    where = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-weighted.max(axis=1), kind="stable"):
        where[i] = k = int(np.argmax(left @ weighted[i]))
        left[k] -= weighted[i]
    return where


def even_bytes(sizes: np.ndarray, where: np.ndarray, shards: int, rounds: int = 20_000) -> np.ndarray:
    """Move or swap items between the fullest shard and the emptiest while that brings their bytes closer.

    Of the moves that halve the gap at least (or else narrow it), that is made which leaves the least gaps in all dimensions.
    """
    held = np.zeros((shards, sizes.shape[1]))
    np.add.at(held, where, sizes)
    members = [list(np.flatnonzero(where == k)) for k in range(shards)]
    for _ in range(rounds):
        a, b = int(held[:, 0].argmax()), int(held[:, 0].argmin())
        gaps = held[a] - held[b]
        gap = gaps[0]
        if gap <= 1e-5 / shards or not members[a]:
            break
        ours, theirs = np.array(members[a]), np.array([*members[b], -1])
        back_sizes = np.where(theirs[:, None] >= 0, sizes[theirs], 0.0)
        order = np.argsort(back_sizes[:, 0], kind="stable")
        own, other = sizes[ours, 0], back_sizes[order, 0]
        at = np.clip(np.searchsorted(other, own - gap / 2), 0, len(other) - 1)
        near = order[np.where((at > 0) & (np.abs(own - other[at - 1] - gap / 2) < np.abs(own - other[at] - gap / 2)), at - 1, at)]
        shift = sizes[ours] - back_sizes[near]
        off = np.abs(shift[:, 0] - gap / 2)
        fits = next((f for f in (off <= gap / 4, off <= gap * 0.4999) if f.any()), None)
        if fits is None:
            break
        left = np.abs(gaps - 2 * shift).sum(axis=1)
        i = int(np.argmin(np.where(fits, left, np.inf)))
        out, back = int(ours[i]), int(theirs[near[i]])
        members[a].remove(out)
        members[b].append(out)
        where[out] = b
        if back >= 0:
            members[b].remove(back)
            members[a].append(back)
            where[back] = a
        held[a], held[b] = held[a] - shift[i], held[b] + shift[i]
    return where


def _plan(cells: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Of each cell (unit, sub): its shard and its first slot there. A unit's cells stay together where a shard can hold them."""
    total = cells[list(DIMENSIONS)].sum().to_numpy(float)
    share = cells[list(DIMENSIONS)].to_numpy(float) / np.maximum(total, 1)
    parts = pd.DataFrame(share).groupby(cells["unit"].to_numpy()).transform("sum").max(axis=1).to_numpy()
    parts = np.where(parts > 1 / shards, np.ceil(parts * shards * 8), 1).astype(np.int64)
    key = pd.MultiIndex.from_arrays([cells["unit"], cells["sub"].to_numpy() % parts])
    item, _ = pd.factorize(key)
    sizes = np.zeros((item.max() + 1, len(DIMENSIONS)))
    np.add.at(sizes, item, share)
    where = even_bytes(sizes, pack(sizes, shards), shards)
    out = cells[["unit", "sub"]].assign(shard=where[item], rows=cells["rows"])
    out = out.sort_values(["shard", "unit", "sub"], kind="stable")
    out["first"] = out.groupby("shard")["rows"].cumsum() - out["rows"]
    return out[["unit", "sub", "shard", "first"]].astype("int64")


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", fine: int = FINE, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard. tokenizer and ranks are paths that all executors can open."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("bytes"),
            _token_counts(tokenizer, ranks)(text).alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("unit"),
        )
    )
    groups = rows.groupBy("unit").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = groups.agg(*(F.sum(d).alias(d) for d in DIMENSIONS)).first().asDict()
    if not total["rows"]:
        return rows.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    least = {d: total[d] / fine for d in DIMENSIONS}
    is_large = F.greatest(*(F.col(d) / F.lit(least[d]) for d in DIMENSIONS)) >= 1
    # At most 3 x fine rows by construction: fewer than fine groups can each hold 1/fine of a total, in each dimension.
    large = groups.where(is_large).select("unit", F.ceil(F.col("rows") / F.lit(max(1.0, least["rows"]))).alias("subs"))
    cell = rows.join(F.broadcast(large), "unit", "left").select(
        "doc_id", "bytes", "tokens", "text_crc32",
        F.when(F.col("subs").isNull(), F.pmod(F.xxhash64("unit"), F.lit(fine))).otherwise(F.col("unit")).alias("unit"),
        F.when(F.col("subs").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("subs"))).cast("long").alias("sub"),
    )
    sums = cell.groupBy("unit", "sub").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = spark.createDataFrame(_plan(sums.toPandas(), shards), "unit long, sub long, shard long, first long")
    placed = cell.join(F.broadcast(plan), ["unit", "sub"])  # as many rows as sums: bounded as above
    order = Window.partitionBy("unit", "sub").orderBy("doc_id", "text_crc32")
    return placed.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

