"""Best-two-fit packing of token counts into sequences of a fixed capacity.

Documents are tokenised where they lie; what is packed is the count of pieces of each length, which is at most as
long as the capacity. The plan is made on those counts: a bin is filled greedily with the longest piece that
fits, again and again; then its smallest piece is replaced by the two unpacked pieces that fit the widened gap
most tightly. A pattern that was found is used as often as the counts allow, so the plan has a few thousand
patterns at any size of the input. Each piece then finds its sequence from its rank among the pieces of its length.

Null texts count as empty; an empty text is the closing id alone. An empty table gives an empty result. Equal ids
and repeated rows are packed each on their own. Other columns are ignored. Lost executors cost a recomputation
only: the table of pieces is written to the shared folder before ranks are given.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import batches, cut, small_batches

CAPACITY = 2048
END_ID = 0
#: Pieces of a length are ranked in so many parts, so that a frequent length isn't ranked by one task.
RANK_PARTS = 256


@cache
def _tokenizer(path: str, ranks_path: str | None):
    """A function from text to ids. The rank file holds the same vocabulary and is read several times faster."""
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(path)

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return plain
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as failed:  # the faster library's pattern matcher gives up on some very long runs
            if isinstance(failed, KeyboardInterrupt | SystemExit):
                raise
            return plain(text)

    return ids


def ids_of(tokenizer: str | None = None, ranks: str | None = None) -> Callable[[str], list[int]]:
    """The function from text to ids; both are paths that all executors can open, by default of the same public vocabulary."""
    import public_tokenizers

    return _tokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or (None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken")))


def piece_starts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces at the end, the first may be shorter."""
    count = -(-n // capacity)
    first = n - (count - 1) * capacity
    return [(0, first)] + [(first + i * capacity, capacity) for i in range(count - 1)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; tokenizer and ranks are paths that all executors can open."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ids_of(tokenizer, ranks)
        for f in batches(frames):
            out = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                codes = np.append(np.asarray(ids(text), "<u4"), np.uint32(END_ID)).astype("<u4")
                out += [(doc_id, i, start, n, zlib.crc32(codes[start : start + n].tobytes())) for i, (start, n) in enumerate(piece_starts(len(codes), capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _closest_pair(left: np.ndarray, most: int, least: int) -> tuple[int, int] | None:
    """The two lengths still there whose sum is the largest up to most, if it is above least."""
    best, pair = least, None
    lengths = np.flatnonzero(left)
    lo, hi = 0, len(lengths) - 1
    while lo <= hi:
        a, b = int(lengths[lo]), int(lengths[hi])
        if a + b > most:
            hi -= 1
        elif a == b and left[a] < 2:
            lo += 1
        else:
            if a + b > best:
                best, pair = a + b, (b, a)
                if best == most:
                    break
            lo += 1
    return pair


def plan_patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), from counts[length]."""
    left = counts.astype(np.int64).copy()
    plan = []
    while left.any():
        used: list[int] = []
        gap = capacity
        while gap > 0 and (fits := np.flatnonzero(left[: gap + 1])).size:
            used.append(int(fits[-1]))
            left[used[-1]] -= 1
            gap -= used[-1]
        if gap > 0 and len(used) > 1:
            least = used[-1]
            pair = _closest_pair(left, gap + least, least)
            if pair:
                left[least] += 1
                left[pair[0]] -= 1
                left[pair[1]] -= 1
                used = [*used[:-1], *pair]
        kinds, n = np.unique(used, return_counts=True)
        more = int((left[kinds] // n).min())
        left[kinds] -= n * more
        plan.append((used, 1 + more))
    return plan


def _ranges(plan: list[tuple[list[int], int]], capacity: int) -> pd.DataFrame:
    """For each length and pattern: from which rank on, how often in a sequence, the first sequence, and the places in it."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for used, times in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for n in used:
            places.setdefault(n, []).append(at)
            at += n
        for n, offsets in places.items():
            rows.append((n, int(taken[n]), len(offsets), sequence, offsets))
            taken[n] += len(offsets) * times
        sequence += times
    return pd.DataFrame(rows, columns=["length", "from_rank", "uses", "first_sequence", "offsets"])


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, parts: int = RANK_PARTS) -> DataFrame:
    """pieces (with a long length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # At most capacity x parts rows, whatever the input.
    first = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first_rank"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        histogram[row["length"]] = row["n"]
    plan = _ranges(plan_patterns(histogram, capacity), capacity)
    ordered = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("in_part", F.row_number().over(ordered) - 1).join(first, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("first_rank") + F.col("in_part"))
    by_length = plan.groupby("length").agg(list).reset_index() if len(plan) else pd.DataFrame({c: [] for c in plan.columns})
    schema = "length long, from_rank array<long>, uses array<long>, first_sequence array<long>, offsets array<array<long>>"
    lookup = spark.createDataFrame(list(by_length.itertuples(index=False, name=None)), schema)
    # One row per length; a piece's pattern is the last one whose first rank isn't above its own.
    found = ranked.join(F.broadcast(lookup), "length").withColumn(
        "k", F.aggregate("from_rank", F.lit(-1), lambda n, start: n + F.when(start <= F.col("rank"), 1).otherwise(0))
    )
    at = F.col("rank") - F.get("from_rank", F.col("k"))
    uses = F.get("uses", F.col("k"))
    return found.select(
        *pieces.columns,
        (F.get("first_sequence", F.col("k")) + F.floor(at / uses)).cast("long").alias("sequence_id"),
        F.get(F.get("offsets", F.col("k")), F.pmod(at, uses).cast("int")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    capacity = options.get("capacity", CAPACITY)
    return pack_pieces(cut(token_pieces(docs, **options)), capacity)
