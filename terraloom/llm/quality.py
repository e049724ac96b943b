"""Quality classifier by supervised subword embeddings.

A document is the mean of the learned vectors of its features: each word and its character n-grams of 3 to 5, hashed into
one table of buckets, and the pairs of equal words at a distance of 1 to 3. These have a bucket for each distance, whatever
the word, so that repetition can be learned; n-grams of unlike words aren't features. The output is a softmax
over two classes; table and output are trained together by stochastic gradient descent in numpy.

Since document vectors are means and the output is linear, a feature's share in the difference of the two outputs is
one number; scoring adds these numbers up, word by word. Every word of every text counts. The fit uses a
bounded sample of labelled rows, whole texts of MAX_ROWS rows of each class, chosen by a hash of the id, in one executor task.

Null and empty texts have no features and score by the bias alone. An empty table gives an empty result; without labels
of both classes all scores are 0.5. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import batches, fitted, labelled

#: The fit uses at most so many labelled rows of each class.
MAX_ROWS = 2000
BUCKETS, DIMENSIONS = 1 << 17, 8
NGRAMS = (3, 4, 5)
DISTANCES = (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 4.0
REMEMBERED = 200_000
_PRIME = np.uint64(0x100000001B3)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words, and the word that each belongs to."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the word's end
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    buckets, owners = [whole], [np.arange(len(words))]
    rolling = np.zeros(len(points), np.uint64)
    for k in range(max(NGRAMS)):
        ahead = np.zeros_like(points)
        ahead[: len(points) - k] = points[k:]
        rolling = (rolling ^ (ahead + np.uint64(k))) * _PRIME
        if k + 1 in NGRAMS:
            fits = room > k
            buckets.append(rolling[fits] ^ (rolling[fits] >> np.uint64(29)))
            owners.append(word[fits])
    mixed = np.concatenate(buckets) * np.uint64(0x9E3779B97F4A7C15)
    free = BUCKETS - len(DISTANCES) - 1
    return ((mixed >> np.uint64(32)) % np.uint64(free)).astype(np.int64) + len(DISTANCES) + 1, np.concatenate(owners)


def repeats(words: list[str]) -> list[int]:
    """How many word n-grams of equal words there are, at each distance."""
    return [sum(map(str.__eq__, words, words[k:])) for k in DISTANCES]


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of a document's features."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    distinct, times = np.unique(np.array(words, object), return_counts=True)
    buckets, owner = word_features(distinct.tolist())
    weight = times[owner].astype(np.float64)
    # Buckets 1 to 3 are the repeated n-grams; they weigh as much as the features of a word do.
    per_word = weight.sum() / len(words)
    buckets = np.append(buckets, np.arange(1, len(DISTANCES) + 1))
    weight = np.append(weight, np.array(repeats(words)) * per_word)
    found, at = np.unique(buckets, return_inverse=True)
    return found, (np.bincount(at, weight) / weight.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 11) -> dict | None:
    """The share of each bucket in the output and the bias; None without rows of both classes."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    documents = [_document(t) for t in texts]
    y = np.asarray(labels)
    table = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps, done = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            rate, done = RATE * (1 - done / steps), done + 1
            ids = np.concatenate([documents[i][0] for i in rows])
            share = np.concatenate([documents[i][1] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(documents[i][0]) for i in rows])
            held = table[ids] * share[:, None]
            vectors = np.stack([np.bincount(owner, held[:, d], len(rows)) for d in range(DIMENSIONS)], axis=1)
            logits = vectors @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ output.T
            found, at = np.unique(ids, return_inverse=True)
            change = np.stack([np.bincount(at, back[owner, d] * share, len(found)) for d in range(DIMENSIONS)], axis=1)
            table[found] -= (rate * 25 * change / len(rows)).astype(np.float32)
            output -= (rate * vectors.T @ p / len(rows)).astype(np.float32)
            bias -= (0.1 * rate * p.sum(axis=0) / len(rows)).astype(np.float32)
    return {"share": (table @ (output[:, 1] - output[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def _word_shares(words: list[str], share: np.ndarray) -> list[tuple[float, int]]:
    """Of each word: the sum of its features' shares, and how many they are."""
    out: list[tuple[float, int]] = []
    for at in range(0, len(words), 8192):
        part = words[at : at + 8192]
        buckets, owner = word_features(part)
        out += zip(np.bincount(owner, share[buckets], len(part)).tolist(), np.bincount(owner, minlength=len(part)).tolist(), strict=True)
    return out


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows=lambda doc_id: F.lit(True), id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1). Labels are learned only from rows where fit_rows(doc_id) holds."""
    model = fitted(labelled(docs, labels, "quality", fit_rows, id_col, text_col, max_rows)[0], train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for f in batches(frames):
            if model is None:
                yield pd.DataFrame({"doc_id": f["doc_id"], "score": 0.5}).astype({"doc_id": "Int64"})
                continue
            lists = [t.split() for t in f["text"]]
            if len(known) > REMEMBERED:
                known = {}
            new = list(set().union(*lists).difference(known))
            known.update(zip(new, _word_shares(new, model["share"]), strict=True))
            score = []
            for words in lists:
                value = 0.0
                if words:
                    sums, counts = zip(*map(known.__getitem__, words), strict=True)
                    total, features = sum(sums), sum(counts)
                    per_word = features / len(words)
                    again = repeats(words)
                    total += per_word * sum(n * float(model["share"][k + 1]) for k, n in enumerate(again))
                    value = total / (features + per_word * sum(again))
                score.append(1 / (1 + np.exp(-np.clip(value + model["bias"], -30, 30))))
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": score}).astype({"doc_id": "Int64", "score": "float64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")
