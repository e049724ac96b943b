"""Whitening of embeddings by a polarisation covariance.

Every entry becomes a long, x = floor(64 * entry) + 1000000. With n vectors and sums S, the centred value of a dimension
is y = n * x - S, a whole number. For every dimension, and for the sum of every two dimensions, the squares of the centred
values are added up exactly; half of what the square of a sum has more than its two parts is the cross-covariance
(times n^3), again exact. Only then is it divided, once, and the matrix goes to eigh. Whitened values are the
projections of y / n on the unit eigenvectors over the roots of their eigenvalues.

Spark deals the rows: each task adds up its own rows and gives one row for each pair of dimensions, whose sums are
decimals. The driver gets as many numbers as there are pairs of dimensions, whatever the number of rows.

Rows whose vector is null or holds null or non-finite entries are left out. Vectors shorter than the longest (empty ones too)
count as if the missing entries were 0. Repeated rows and ids are rows of their own. Components without variance (fewer
rows than dimensions, equal vectors) have whitened values of 0 and take no part in the identity's error; when no
component has any, that error is 0. An empty table gives an empty result. Other columns are ignored. A deviation or an
entry beyond a long raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import cut_table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Vectors are handled in blocks of so many rows.
BLOCK = 1 << 12
LIMB = 20
DECIMAL = "decimal(38,0)"


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id (as text), x (array of long) of the rows that count."""
    vector = F.col(vector_col).cast("array<double>")
    # Ids travel as text: pandas would make floats of longs among nulls.
    rows = embeddings.select(F.col(id_col).cast("string").alias("vec_id"), vector.alias("v")).where(usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _blocks(frames: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Ids and vectors, all of one width."""
    zero = SHIFT  # what an entry of 0 becomes
    for frame in frames:
        for at in range(0, len(frame), BLOCK):
            part = frame.iloc[at : at + BLOCK]
            out = np.full((len(part), width), zero, np.int64)
            if (part["x"].map(len) == width).all():
                out[:] = np.stack(part["x"].to_numpy())
            else:
                for row, x in zip(out, part["x"], strict=True):
                    row[: len(x)] = x
            yield part["vec_id"], out


def square_sums(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each column of a block of longs, by two limbs."""
    if len(y) == 0:
        return [0] * y.shape[1]
    if max(abs(int(y.max())), abs(int(y.min()))) >= 1 << 44 or len(y) > BLOCK:
        return [sum(int(v) * int(v) for v in column) for column in y.T]
    low, high = y & ((1 << LIMB) - 1), y >> LIMB
    parts = [(a * b).sum(axis=0) for a, b in ((high, high), (high, low), (low, low))]
    return [(int(hh) << (2 * LIMB)) + (int(hl) << (LIMB + 1)) + int(ll) for hh, hl, ll in zip(*parts, strict=True)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, else as whole numbers of Python."""
    largest = max(abs(int(x.max())), abs(int(x.min())), 1) if x.size else 1
    kind = np.int64 if largest * n < 1 << 60 and max(map(abs, sums), default=0) < 1 << 60 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _added(rows: DataFrame, width: int, add: Callable[[Iterator[np.ndarray]], pd.DataFrame], names: list[str], kind: str) -> list:
    """What add gives for each task's blocks (names and a value), summed by the names: one row for each combination."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield add(x for _, x in _blocks(frames, width))

    cast = "string" if kind == DECIMAL else kind
    schema = ", ".join(f"{c} int" for c in names) + f", value {cast}"
    parts = rows.mapInPandas(run, schema)
    return parts.groupBy(*names).agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()


def column_sums(rows: DataFrame, width: int) -> list[int]:
    def add(blocks: Iterator[np.ndarray]) -> pd.DataFrame:
        total = [0] * width
        for x in blocks:
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
        return pd.DataFrame({"i": np.arange(width, dtype=np.int32), "value": np.array([str(v) for v in total], object)})

    found = {r["i"]: int(r["value"]) for r in _added(rows, width, add, ["i"], DECIMAL)}
    return [found.get(i, 0) for i in range(width)]


def pair_squares(rows: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """The exact sums of squared centred values: of dimension i at (i, i), of the sum of i and j at (i, j), i < j."""
    width = len(sums)

    def add(blocks: Iterator[np.ndarray]) -> pd.DataFrame:
        total: dict[tuple[int, int], int] = {}
        for x in blocks:
            y = _centred(x, n, sums)
            for i in range(width):
                own = y[:, i : i + 1]
                both = np.concatenate([own, y[:, i + 1 :] + own], axis=1)
                for j, value in enumerate(square_sums(both)):
                    total[i, i + j] = total.get((i, i + j), 0) + value
        keys = list(total)
        return pd.DataFrame({"i": np.array([k[0] for k in keys], np.int32), "j": np.array([k[1] for k in keys], np.int32), "value": np.array([str(total[k]) for k in keys], object)})

    return {(r["i"], r["j"]): int(r["value"]) for r in _added(rows, width, add, ["i", "j"], DECIMAL)}


def covariance(squares: dict[tuple[int, int], int], n: int, width: int) -> np.ndarray:
    """The covariance matrix; each entry is one division of exact whole numbers."""
    out = np.zeros((width, width))
    for (i, j), value in squares.items():
        cross = 2 * value if i == j else value - squares[i, i] - squares[j, j]
        out[i, j] = out[j, i] = cross / (2 * n**3)  # Python divides whole numbers with one rounding
    return out


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and which of them have variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    real = values > max(values[0], 0) * len(cov) * np.finfo(float).eps * 4 if len(values) else np.zeros(0, bool)
    return values, vectors, real


def whiten(embeddings: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = cut_table(whole_vectors(embeddings, id_col, vector_col))  # read four times below
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = seen["n"], seen["width"] or 0
    id_type = embeddings.schema[id_col].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double"
    if n == 0 or width == 0:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {id_type}, {schema}, identity_error double")
    sums = column_sums(rows, width)
    cov = covariance(pair_squares(rows, n, sums), n, width)
    values, vectors, real = components(cov, most)
    count, trace = len(values), float(np.trace(cov))
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = np.where(trace > 0, values / (trace or 1.0), 0.0)
    turn = vectors * scale

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(x, n, sums)
        return y, (y.astype(np.float64) / n) @ turn

    def products(blocks: Iterator[np.ndarray]) -> pd.DataFrame:
        total = np.zeros((count + 1, count))
        for x in blocks:
            w = whitened(x)[1]
            total[:count] += w.T @ w
            total[count] += w.sum(axis=0)
        i, j = np.indices(total.shape, np.int32)
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    total = np.zeros((count + 1, count))
    for r in _added(rows, width, products, ["i", "j"], "double"):
        total[r["i"], r["j"]] = r["value"]
    mean = total[count] / n
    off = np.abs(total[:count] / n - np.outer(mean, mean) - np.eye(count))[np.ix_(real, real)]
    error = float(off.max()) if off.size else 0.0

    def out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _blocks(frames, width):
            y, w = whitened(x)
            small = y.dtype != object and max(abs(int(y.max())), abs(int(y.min()))) < np.sqrt(2.0**62 / width)
            deviation = (y * y).sum(axis=1) if small else [sum(int(v) * int(v) for v in row) for row in y]
            yield pd.DataFrame({
                "vec_id": ids.repeat(count).to_numpy(), "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(ids)), "n": n,
                "deviation": np.repeat(np.asarray(deviation), count), "whitened": w.ravel(), "explained": np.tile(explained, len(ids)),
            })

    found = rows.mapInPandas(out, f"vec_id string, {schema}").withColumn("identity_error", F.lit(error))
    return found.withColumn("vec_id", F.col("vec_id").cast(id_type))
