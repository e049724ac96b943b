"""Language identification in two steps: the family first, then the language within it.

Texts are cut into terms (runs of letters; lower-cased), and a text is the mean of its features: each term as a whole and
its byte n-grams of 1 to 4, with marks at its ends, hashed into one table. Linear support vector machines, trained by
dual coordinate descent, tell each family from the rest; within the likeliest family, one machine for each two of its languages
casts a vote, and the language with most votes wins, ties going to the larger sum of the machines' probabilities. The score is the family's probability times that of
the language within it, from logistic curves fitted to the machines' margins.

As vectors are means and machines linear, a term's share in each margin is one number; scoring finds the shares of a slice's
distinct terms and adds them up. Every term of every text counts. The fit uses a bounded sample: ROWS texts of each
language, chosen by a hash of id and text, and PIECES of 1 to 64 terms of each, so that short texts are learned as well. Executors turn
the sample into vectors; one task trains on these, never on texts.

Languages that the family table doesn't name are families of their own. Texts that are null or have no letter give `und` with a
score of 0; so do all when no language could be learned. With one language learned, all others give it with a score of 1.
Rows without a language aren't learned from. Repeated rows score alike. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import small_batches, small_side
from terraloom.llm.terms import byte_parts, cut_terms, slices, whole

# Families of languages by their codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "semitic": ("ar", "he", "mt", "am"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "sinitic": ("zh",),
    "austronesian": ("id", "ms", "tl", "jv"),
}
UNKNOWN = "und"
#: The fit uses at most so many texts of each language, and of each text the whole and so many pieces.
ROWS, PIECES = 400, 6
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
#: Means are scaled by this, and machines are held to weights of this cost of a fault.
GAIN, COST, EPOCHS = 30.0, 1.0, 12
#: n-grams are cut out of so many bytes at a time.
STRETCH = 1 << 20
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"own {lang}")


def term_features(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all terms, and the number of the term that each belongs to."""
    data, offsets = byte_parts(terms)
    length = np.diff(offsets) + 2
    starts = np.cumsum(length) - length
    points = np.full(int(length.sum()), 0x3C, np.uint8)  # '<' before and '>' after each term; neither occurs in one
    points[starts + length - 1] = 0x3E
    edge = np.zeros(len(points), bool)
    edge[starts] = edge[starts + length - 1] = True
    points[~edge] = data
    owner = np.repeat(np.arange(len(terms)), length)
    ends = starts + length
    buckets, owners = [], []
    for at in range(0, len(points), STRETCH):
        seen = points[at : at + STRETCH + max(NGRAMS)].astype(np.uint64)
        own = owner[at : at + STRETCH]
        room = ends[own] - np.arange(at, at + len(own))
        rolling = np.full(len(own), 0xCBF29CE484222325, np.uint64)
        for k in range(max(NGRAMS)):
            ahead = np.zeros(len(own), np.uint64)
            part = seen[k : k + len(own)]
            ahead[: len(part)] = part
            rolling = (rolling ^ (ahead + np.uint64(k << 8))) * _PRIME
            if k + 1 in NGRAMS:
                fits = room > k
                hashed = rolling[fits]
                buckets.append(((hashed ^ (hashed >> np.uint64(29))) * _MIX >> np.uint64(40)) % np.uint64(BUCKETS))
                owners.append(own[fits])
    # A term as a whole: its bytes' polynomial, over differences of running sums, modulo 2^64.
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()) if len(length) else 0, _PRIME)]))
    weight = (points.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(points)) - np.repeat(starts, length)]
    total = np.add.reduceat(weight, starts) if len(starts) else np.zeros(0, np.uint64)
    buckets.append(((total ^ (total >> np.uint64(31))) * _MIX >> np.uint64(40)) % np.uint64(BUCKETS))
    owners.append(np.arange(len(terms)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def vector(features: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and shares of a list of terms; features holds each term's buckets."""
    found, n = np.unique(np.concatenate([features[c] for c in codes]), return_counts=True)
    return found.astype(np.int32), (n / n.sum()).astype(np.float32)


def _sampled(docs: DataFrame, rows: int) -> DataFrame:
    """lang, text: of each language at most so many rows, those of the smallest hashes."""
    keyed = docs.withColumn("__at", F.xxhash64("doc_id", "text") / F.lit(2.0**64) + F.lit(0.5))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("__n"))
    few = keyed.join(small_side(sizes, sizes.count()), "lang").where(F.col("__at") * F.col("__n") <= 4 * rows + 50)  # so that no language meets in one task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__at", "doc_id", "text"))
    return few.withColumn("__rank", rank).where(F.col("__rank") <= rows).select("lang", "text")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, buckets, shares of each text and of its pieces."""
    for rows in slices(batches):
        terms, code, row = cut_terms(pc.utf8_lower(whole(rows, "text")))
        buckets, owner = term_features(terms)
        order = np.argsort(owner, kind="stable")
        features = np.split(buckets[order], np.cumsum(np.bincount(owner, minlength=len(terms)))[:-1]) if len(terms) else []
        at = np.searchsorted(row, np.arange(len(rows) + 1))
        out: dict[str, list] = {"lang": [], "buckets": [], "shares": []}
        for i, lang in enumerate(rows.column("lang").to_pylist()):
            own = code[at[i] : at[i + 1]]
            if not len(own):
                continue
            rng = np.random.default_rng(len(own))
            pieces = [own]
            for k in range(PIECES):
                length = int(rng.integers(1, 2 * 4 ** (k // 2)))
                begin = int(rng.integers(0, max(len(own) - length, 0) + 1))
                pieces.append(own[begin : begin + length])
            for piece in pieces:
                found, shares = vector(features, piece)
                out["lang"].append(lang)
                out["buckets"].append(found.tobytes())
                out["shares"].append(shares.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["buckets"], pa.binary()), pa.array(out["shares"], pa.binary())], list(out))


def _machine(examples: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Weights and bias of a linear support vector machine, by dual coordinate descent, and its logistic curve."""
    rng = np.random.default_rng(seed)
    weight, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(sign))
    size = np.array([float(s @ s) + 1.0 for _, s in examples])
    # Both sides weigh alike, however many examples they have.
    most = COST * np.where(sign > 0, len(sign) / (2 * max((sign > 0).sum(), 1)), len(sign) / (2 * max((sign < 0).sum(), 1)))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sign)):
            at, share = examples[i]
            step = (sign[i] * (weight[at] @ share + bias) - 1) / size[i]
            new = min(max(alpha[i] - step, 0.0), most[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                weight[at] += change * share
                bias += change
                alpha[i] = new
    margin = np.array([weight[at] @ share + bias for at, share in examples])
    slope, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        fault = p - (sign > 0)
        slope -= 0.5 * float(np.mean(fault * margin))
        shift -= 0.5 * float(np.mean(fault))
    return weight, bias, (slope, shift)


def train(langs: list[str], examples: list[tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """The families with their languages, and the machines: weights (a column each), biases, curves."""
    if not langs:
        return None
    examples = [(at, GAIN * share) for at, share in examples]
    of = np.array(langs, object)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    names = sorted(families)
    group = np.array([family_of(x) for x in langs], object)
    made, keys = [], []
    if len(names) > 1:
        for i, name in enumerate(names):
            keys.append(("family", name))
            made.append(_machine(examples, np.where(group == name, 1.0, -1.0), i))
    for name in names:
        for a, b in combinations(families[name], 2):
            rows = np.flatnonzero((of == a) | (of == b))
            keys.append((a, b))
            made.append(_machine([examples[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0), len(keys)))
    weights = np.stack([m[0] for m in made], axis=1).astype(np.float32) if made else np.zeros((BUCKETS, 0), np.float32)
    return {"families": {n: families[n] for n in names}, "keys": keys, "weights": weights * np.float32(GAIN), "bias": np.array([m[1] for m in made]), "curve": np.array([m[2] for m in made]).reshape(-1, 2)}


def fit(docs: DataFrame, rows: int = ROWS) -> dict | None:
    """The machines, from docs (doc_id, lang, text); None when there is nothing to learn from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs: list[str] = []
        examples: list[tuple[np.ndarray, np.ndarray]] = []
        for f in batches:
            langs += f["lang"].tolist()
            examples += [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(f["buckets"], f["shares"], strict=True)]
        order = sorted(range(len(langs)), key=lambda i: (langs[i], examples[i][0].tobytes(), examples[i][1].tobytes()))  # whatever the order of rows
        yield pd.DataFrame({"model": [pickle.dumps(train([langs[i] for i in order], [examples[i] for i in order]))]})

    vectors = _sampled(docs, rows).mapInArrow(_examples, "lang string, buckets binary, shares binary")
    found = vectors.coalesce(1).mapInPandas(run, "model binary").collect()  # one row
    return pickle.loads(found[0]["model"]) if found else None


def judge(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of margins the language and its probability."""
    odds = 1 / (1 + np.exp(-np.clip(margins * model["curve"][:, 0] + model["curve"][:, 1], -30, 30)))
    at = {k: i for i, k in enumerate(model["keys"])}
    names = list(model["families"])
    shares = np.stack([odds[:, at["family", n]] for n in names], axis=1) if len(names) > 1 else np.ones((len(margins), 1))
    shares = shares / shares.sum(axis=1, keepdims=True)
    family = shares.argmax(axis=1)
    lang, score = np.empty(len(margins), object), shares[np.arange(len(margins)), family]
    for i, name in enumerate(names):
        own, members = np.flatnonzero(family == i), model["families"][name]
        votes, belief = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
        for a, b in combinations(range(len(members)), 2):
            p = odds[own, at[members[a], members[b]]]
            votes[:, a] += margins[own, at[members[a], members[b]]] >= 0
            votes[:, b] += margins[own, at[members[a], members[b]]] < 0
            belief[:, a] += p
            belief[:, b] += 1 - p
        pairs = max(len(members) * (len(members) - 1) / 2, 1)
        best = (votes + belief / (len(members) + 1)).argmax(axis=1)
        lang[own] = np.array(members, object)[best]
        score[own] *= belief[np.arange(len(own)), best] / pairs if len(members) > 1 else 1.0
    return lang, score


def identify(docs: DataFrame, fit_rows: Callable[[Column], Column] = lambda doc_id: F.lit(True), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row. Languages are learned only from rows where fit_rows(doc_id) holds."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    model = fit(named.where(F.col("lang").isNotNull() & lettered & F.coalesce(fit_rows(F.col("doc_id")), F.lit(False))), rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            n = len(part)
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            own = part.column("lettered").to_numpy().astype(bool) if model else np.zeros(n, bool)
            if own.any():
                terms, code, row = cut_terms(pc.utf8_lower(whole(part, "text")))
                buckets, owner = term_features(terms)
                features = np.bincount(owner, minlength=len(terms)).astype(np.float64)
                total = np.maximum(np.bincount(row, features[code], n), 1)
                margins = np.empty((n, len(model["keys"])))
                for m in range(len(model["keys"])):
                    of_term = np.bincount(owner, model["weights"][buckets, m], len(terms))
                    margins[:, m] = np.bincount(row, of_term[code], n) / total + model["bias"][m]
                found, sure = judge(model, margins)
                lang[own], score[own] = found[own], sure[own]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    asked = named.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lettered.alias("lettered"))
    return asked.mapInArrow(run, "doc_id long, lang_pred string, score double")
