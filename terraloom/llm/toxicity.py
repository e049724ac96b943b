"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nystrom landmarks.

Subsequences of 3 and 4 letters that span at most SPAN places count, each weighted by DECAY to the power of its span. A run
of signs or marks of any length is one place, a gap; a run of blanks is one place and stands for the edge of a word. So
`i*d*i*o*t`, `i****d****i****o****t`, `i d i o t` and `id iot` hold the subsequences of the plain word, as does `idxiot`;
only their weights shrink. The kernel of two strings is the
sum over their common subsequences of the product of the weights. An instance is a stretch of a sentence: all subsequences
that start in WINDOWS places in a row, divided by the root of the sum of their squared weights, so that gapped spellings
weigh as plain ones do. A sentence's value is the highest of its stretches.

Landmarks are runs of one or two words of the training sentences (of longer runs the first MARK characters), those that are likelier in toxic documents and usual ones
of the others. A stretch's features are its kernel values with them, whitened by the landmarks' own kernel matrix. The
machine is trained on labelled sentences: a toxic document holds at least one toxic sentence and a clean one holds none;
the witness of a toxic document is chosen anew in each round as its highest stretch, and the highest stretches of clean
documents join the counter-examples. As the machine is linear in the weights of subsequences, it is folded into one table of
weights by subsequence; looking these up equals the sum over the landmarks exactly. A document's probability comes from a
logistic fit on the values of its sentences. Every sentence of every text counts, whatever its length.

The fit takes whole texts of a bounded sample of labelled rows (MAX_ROWS of each class, chosen by a hash of the id) and runs in
one task of an executor; the driver gets the landmarks and their weights only.

Null and empty texts, and those without letters, hold no sentence and score 0. An empty table gives an empty result; without labels of both
classes all scores are 0. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import fitted, labelled, text_slices

#: The fit uses at most so many labelled rows of each class.
MAX_ROWS = 1500
#: Kernel: sizes of subsequences, places that one may span, and the weight that each place costs.
SIZES, SPAN, DECAY = (3, 4), 9, 0.7
#: Places in which the subsequences of a stretch start; so many empty places stand between sentences.
WINDOWS = (6, 12)
REST = max(WINDOWS)
#: Added to a stretch's squared norm, so that stretches of two or three letters stay small.
LEAST_NORM = 0.1
#: Codes: 0 no letter, 1 to 26 Latin letters, the edge of a word, then 26 that the letters of all other scripts are dealt to.
EDGE, LATIN, LETTERS = 27, 28, 54
LANDMARKS, MARK, ROUNDS, WITNESSES = 192, 24, 3, 3
RIDGE = 1e-3
#: How much more a missed toxic document counts than a false alarm, in the logistic fit.
MISSED = 1.5
#: Stretches of clean documents in the fit: chosen at random, and added in each round.
RANDOM_STRETCHES, HARD_STRETCHES = 3000, 1000
#: Places looked up at a time, so that what is in use stays in a core's cache.
PLACES = 1 << 15
#: Characters and places worked on at a time, so that little memory is in use.
BLOCK = 1 << 18


def _letter(char: str) -> int:
    """1..26 by the base letter, LATIN.. by the code point for letters of other scripts, 0 for signs, marks and blanks."""
    base = unicodedata.normalize("NFKD", char.casefold())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    if not base.isalpha():
        return 0
    # Latin letters that don't decompose go by their name, as "O WITH STROKE" and "AE".
    named = re.fullmatch(r"LATIN SMALL LETTER (\w{1,2})(?: WITH .*)?", unicodedata.name(base, ""))
    return ord(named[1][0]) - 64 if named else LATIN + ord(base) % (LETTERS - LATIN)


TABLE = np.array([_letter(chr(point)) for point in range(0x20000)], np.int8)


def _letters(points: np.ndarray) -> np.ndarray:
    """Codes of code points; beyond the table lie ideographs, and from 0xE0000 on signs."""
    far = np.where(points < 0xE0000, LATIN + points % (LETTERS - LATIN), 0)
    return np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], far).astype(np.int8)


def sentence_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the sentences of all texts in a row with REST empty places behind each, where each begins, and whose it is.

    Sentences end at a line end, or at a stop that a blank follows. Those without letters are left out.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(points):
        return np.zeros(REST, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (points <= 32) | (points == 0xA0)
    ends = ((points == 46) | (points == 33) | (points == 63)) & np.append(blank[1:], True) | (points == 10)
    letters = _letters(points)
    at = np.flatnonzero(letters)
    sentence = np.cumsum(ends)[at]
    new = np.diff(sentence, prepend=-1) > 0
    # An edge ends the sentence before, one starts the new sentence.
    before = np.where(new, REST + 2, np.diff(at, prepend=-1) > 1)
    place = np.arange(len(at)) + np.cumsum(before)
    codes = np.zeros((place[-1] + 2 if len(at) else 0) + REST, np.int8)
    codes[place] = letters[at]
    begins = place[new] - 1
    edge = np.diff(np.cumsum(blank)[at], prepend=0) > 0
    codes[place[edge & ~new] - 1] = codes[begins] = codes[np.append(begins[1:] - REST - 1, len(codes) - REST - 1)[: len(begins)]] = EDGE
    text = np.searchsorted(np.cumsum(lengths + 1), at[new], side="right")
    return codes, begins, text


def _patterns() -> Iterator[tuple[int, ...]]:
    """The places of the letters of a subsequence behind its first."""
    for size in SIZES:
        yield from combinations(range(1, SPAN), size - 1)


def _keys(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern, the key of the subsequence at each of the starts (-1 where a letter is missing), and its weight."""
    for pattern in _patterns():
        picked = [codes[starts], *(codes[starts + p] for p in pattern)]
        key = np.zeros(starts.shape, np.int64)
        for c in picked:
            key = key * LETTERS + c
        yield np.where(np.logical_and.reduce([c > 0 for c in picked]), key + (LETTERS**4 if len(picked) == 3 else 0), -1), DECAY ** (pattern[-1] + 1)


def fold(marks: np.ndarray, alpha: np.ndarray, letters: int = LETTERS) -> list[np.ndarray]:
    """A table of weights for each size: the sum over landmarks (rows of codes) of alpha times the landmark's weights."""
    padded = np.pad(marks.astype(np.int64), ((0, 0), (0, SPAN)))
    starts = np.arange(marks.shape[1])
    tables = {size: np.zeros(letters**size) for size in SIZES}
    for pattern in _patterns():
        picked = [padded[:, starts], *(padded[:, starts + p] for p in pattern)]
        ok = np.logical_and.reduce([(c > 0) & (c < letters) for c in picked])
        key = np.zeros(ok.shape, np.int64)
        for c in picked:
            key = key * letters + c
        np.add.at(tables[len(picked)], key[ok], np.broadcast_to(alpha[:, None], ok.shape)[ok] * DECAY ** (pattern[-1] + 1))
    return [tables[size].astype(np.float32) for size in SIZES]


def start_sums(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """At each place, the sum of weights of the subsequences that start there."""
    three, four = tables
    a = round(len(three) ** (1 / 3))
    out = np.zeros(len(codes), np.float32)
    padded = np.concatenate([codes, np.zeros(SPAN, codes.dtype)])
    for at in range(0, len(codes), PLACES):
        own = padded[at : at + PLACES + SPAN].astype(np.int64)
        n = min(PLACES, len(codes) - at)
        c = [own[p : p + n] for p in range(SPAN)]
        found, key, held = np.empty(n, np.float32), np.empty(n, np.int64), [np.zeros(n, np.float32) for _ in range(SPAN)]
        for p in range(1, SPAN - 1):
            pair = (c[0] * a + c[p]) * a
            for q in range(p + 1, SPAN):
                triple = pair + c[q]
                np.take(three, triple, out=found, mode="clip")
                held[q] += found
                triple *= a
                for r in range(q + 1, SPAN):
                    np.add(triple, c[r], out=key)
                    np.take(four, key, out=found, mode="clip")
                    held[r] += found
        for last in range(1, SPAN):
            out[at : at + n] += held[last] * np.float32(DECAY ** (last + 1))
    return out


def start_norms(codes: np.ndarray) -> np.ndarray:
    """At each place, the sum of squared weights of the subsequences that start there."""
    is_letter = np.concatenate([codes > 0, np.zeros(SPAN, bool)])
    n, between = len(codes), np.zeros(len(codes), np.float32)
    out = np.zeros(n, np.float32)
    for last in range(1, SPAN):
        ends = is_letter[last : last + n].astype(np.float32)
        out += ends * (between + between * (between - 1) / 2) * np.float32(DECAY ** (2 * last + 2))
        between += ends
    return out * is_letter[:n]


def stretch_values(codes: np.ndarray, tables: list[np.ndarray], bias: float) -> np.ndarray:
    """The machine's value of the stretch from each place on, for each of the WINDOWS."""
    sums = np.concatenate([[0], np.cumsum(start_sums(codes, tables), dtype=np.float64)])
    squares = np.concatenate([[0], np.cumsum(start_norms(codes), dtype=np.float64)])
    out = np.empty((len(WINDOWS), len(codes)), np.float32)
    for k, width in enumerate(WINDOWS):
        end = np.minimum(np.arange(len(codes)) + width, len(codes))
        out[k] = bias + (sums[end] - sums[:-1]) / np.sqrt(squares[end] - squares[:-1] + LEAST_NORM)
    return out


def highest_stretches(codes: np.ndarray, tables: list[np.ndarray], bias: float) -> tuple[np.ndarray, np.ndarray]:
    """At each place, the higher value of its stretches, and which of the WINDOWS it is; in blocks, so that little memory is in use."""
    values, which = np.empty(len(codes), np.float32), np.empty(len(codes), np.int8)
    for at in range(0, len(codes), BLOCK):
        n = min(BLOCK, len(codes) - at)
        both = stretch_values(codes[at : at + n + REST + SPAN], tables, bias)[:, :n]
        which[at : at + n] = both.argmax(axis=0)
        values[at : at + n] = both.max(axis=0)
    return values, which


def sentence_values(texts: list[str], machine: dict) -> tuple[np.ndarray, np.ndarray]:
    """The values of the texts' sentences, and the text that each belongs to."""
    codes, begins, text = sentence_codes(texts)
    if not len(begins):
        return np.zeros(0, np.float32), text
    letters = LATIN if codes.max() < LATIN else LETTERS
    if letters not in machine["tables"]:
        machine["tables"][letters] = fold(machine["marks"], machine["alpha"], letters)
    values, _ = highest_stretches(codes, machine["tables"][letters], machine["bias"])
    return np.maximum.reduceat(values, begins), text


def _features(values: np.ndarray) -> list[float]:
    """Of a document's sentences."""
    if not len(values):
        return [1.0, -1.0, -3.0, 0.0, 0.0]
    top = np.sort(values)[-3:]
    beyond = int((values > 0).sum())
    return [1.0, float(top[-1]), float(np.pad(top, (3 - len(top), 0), constant_values=-1).clip(-1).sum()), float(np.log1p(beyond)), beyond / len(values) ** 0.5]


def document_scores(texts: list[str], model: dict) -> np.ndarray:
    """The probability that each text is toxic."""
    values, text = sentence_values(texts, model)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    x = np.array([_features(values[a:b]) for a, b in zip(edges, edges[1:], strict=False)]).reshape(len(texts), -1)
    return np.where(edges[1:] > edges[:-1], 1 / (1 + np.exp(-np.clip(x @ model["logistic"], -30, 30))), 0.0)


def _machine(features: np.ndarray, sign: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton's method on the rows within the margin."""
    x = np.column_stack([features, np.ones(len(features))])
    share = weight / weight.sum()
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    w, within = np.zeros(x.shape[1]), None
    for _ in range(50):
        now = sign * (x @ w) < 1
        if within is not None and (now == within).all():
            break
        within = now
        part = x[within] * share[within, None]
        w = 0.5 * w + 0.5 * np.linalg.lstsq(part.T @ x[within] + penalty, part.T @ sign[within], rcond=None)[0]
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 3000) -> np.ndarray:
    w = np.zeros(x.shape[1])
    rate = 4 / (1 + (x**2).sum(axis=1).mean())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += rate * ((y - p) @ x / len(y) - 1e-4 * w)
    return w


def _runs(text: str) -> set[str]:
    """Runs of one or two words of a text, as landmarks: of a longer one the start."""
    words = text.lower().split()
    return {" ".join(words[i : i + n])[:MARK] for n in (1, 2) for i in range(len(words) - n + 1)}


def _slot(run: str, slots: int) -> int:
    return zlib.crc32(run.encode("utf-8", "surrogatepass")) % slots


def _landmarks(texts: list[str], y: np.ndarray, count: int, rng: np.random.Generator) -> tuple[list[str], list[float], list[int]]:
    """Runs of words, by how much likelier each is in toxic documents, and in how many it is: the likeliest, and usual words of the others."""
    toxic, clean = [t for t, label in zip(texts, y, strict=True) if label], [t for t, label in zip(texts, y, strict=True) if not label]
    seen = np.zeros(1 << 22, np.uint8)  # so that runs that occur in one document take no memory
    hot: Counter = Counter()
    for count_them in (False, True):
        for text in toxic:
            runs = _runs(text)
            if count_them:
                hot.update(r for r in runs if len(r) > 2 and seen[_slot(r, len(seen))] >= min(2, len(toxic) // 5))
            else:
                places = np.unique(np.array([_slot(r, len(seen)) for r in runs], np.int64))
                seen[places] = np.minimum(seen[places], 254) + 1
    cold, words = Counter(), Counter()
    for text in clean:
        own = _runs(text)
        cold.update(r for r in own if r in hot)
        words.update(r for r in own if " " not in r and len(r) > 2)
    lift = {r: np.log((n + 0.1) / (len(toxic) + 1)) - np.log((cold[r] + 0.5) / (len(clean) + 1)) + 0.5 * min(0, np.log(n / 5)) for r, n in hot.items()}
    best = sorted(lift, key=lambda r: (-lift[r] * np.log1p(hot[r]), len(r), r))[: count // 2]
    common = sorted(words, key=lambda w: (-words[w], w))
    head, rest = common[: count // 4], common[count // 4 :]
    picked = [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), count - len(best) - len(head)), replace=False))]
    chosen = [r for r in dict.fromkeys([*best, *head, *picked]) if len(sentence_codes([r])[1])]
    telling = set(best)
    return chosen, [float(lift[r]) if r in telling else -9.0 for r in chosen], [hot[r] if r in telling else 0 for r in chosen]


def _marks(runs: list[str]) -> np.ndarray:
    """Codes of the landmarks, a row each."""
    out = np.zeros((len(runs), MARK + 2), np.int8)
    for row, run in zip(out, runs, strict=True):
        codes, begins, _ = sentence_codes([run])
        codes = codes[begins[0] : np.flatnonzero(codes)[-1] + 1]
        row[: len(codes)] = codes[: len(row)]
    return out


class _Kernel:
    """Kernel values of stretches with the landmarks."""

    def __init__(self, marks: np.ndarray):
        codes = np.pad(marks, ((0, 0), (0, SPAN))).ravel()
        starts = np.arange(len(marks))[:, None] * (marks.shape[1] + SPAN) + np.arange(marks.shape[1])
        found = [(key, weight) for key, weight in _keys(codes, starts)]
        self.keys = np.unique(np.concatenate([k[k >= 0] for k, _ in found]))
        weights = np.zeros((len(self.keys), len(marks)), np.float32)
        for key, weight in found:
            row, _ = np.nonzero(key >= 0)
            np.add.at(weights, (np.searchsorted(self.keys, key[key >= 0]), row), weight)
        self.norm = np.sqrt(np.einsum("km,km->m", weights, weights, dtype=np.float64))
        self.norm[self.norm == 0] = 1
        weights /= self.norm
        self.by_key = weights

    def gram(self) -> np.ndarray:
        return (self.by_key.T @ self.by_key).astype(np.float64)

    def __call__(self, codes: np.ndarray, begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(begins), self.by_key.shape[1]))
        for at in range(0, len(begins), 64):
            starts = begins[at : at + 64, None] + np.arange(REST)
            inside = np.arange(REST) < widths[at : at + 64, None]
            starts = np.minimum(starts, len(codes) - SPAN - 1)
            rows = np.broadcast_to(np.arange(len(starts))[:, None], starts.shape)
            flat, places, weights = [], [], []
            for key, weight in _keys(codes, starts):
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = inside & (self.keys[place] == key)
                flat.append(rows[ok])
                places.append(place[ok])
                weights.append(np.full(len(flat[-1]), weight))
            row = np.concatenate(flat)
            order = np.argsort(row, kind="stable")
            edges = np.flatnonzero(np.diff(row[order], prepend=-1))
            if not len(edges):  # no subsequence of a landmark: all values are 0
                continue
            held = self.by_key[np.concatenate(places)[order]] * np.concatenate(weights)[order, None].astype(np.float32)
            out[at + row[order[edges]]] = np.add.reduceat(held, edges)
            own = np.array([start_norms(codes[a : a + w + SPAN])[:w].sum() for a, w in zip(begins[at : at + 64], widths[at : at + 64], strict=True)])
            out[at : at + 64] /= np.sqrt(own + LEAST_NORM)[:, None]
        return out


def _all_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As sentence_codes, made a slice of the texts at a time."""
    codes, begins, text, places, first = [], [], [], 0, 0
    for part in text_slices(pd.Series(texts, dtype=object), BLOCK):
        c, b, t = sentence_codes(part.tolist())
        codes.append(c)
        begins.append(b + places)
        text.append(t + first)
        places, first = places + len(c), first + len(part)
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.int8), *codes]), np.concatenate([none, *begins]), np.concatenate([none, *text])


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, odds: float = 1.0, seed: int = 7) -> dict | None:
    """Landmarks with their weights, the bias and the logistic fit; None without rows of both classes that hold letters.

    odds: how much likelier a toxic row is among all rows than in the sample, which may hold all rows of one class only.
    """
    y = np.asarray(labels)
    codes, begins, text = _all_codes(texts)
    if len(set(y[np.unique(text)].tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    runs, lift, often = _landmarks(texts, y, landmarks, rng)
    marks = _marks(runs)
    kernel = _Kernel(marks)
    value, vector = np.linalg.eigh(kernel.gram() + 1e-3 * np.eye(len(marks)))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    codes = np.pad(codes, (0, REST + SPAN))
    is_toxic = y[text] == 1
    ends = np.append(begins[1:], len(codes) - REST - SPAN)
    letters = LATIN if codes.max() < LATIN else LETTERS

    def stretches(values: np.ndarray, which: np.ndarray, sentences: np.ndarray) -> np.ndarray:
        """Kernel features of the highest stretch of each of the sentences."""
        places = np.array([begins[i] + int(np.argmax(values[begins[i] : ends[i]])) for i in sentences], np.int64)
        return kernel(codes, places, np.array(WINDOWS)[which[places]]) @ whiten

    # Random places of clean sentences: a sentence by its length, then a letter of it.
    clean = np.flatnonzero(~is_toxic)
    length = (ends - begins)[clean]
    picked = clean[rng.choice(len(clean), RANDOM_STRETCHES, p=length / length.sum())]
    negative = begins[picked] + (rng.random(RANDOM_STRETCHES) * (ends - begins)[picked]).astype(np.int64)
    negative = negative[codes[negative] > 0]
    against = kernel(codes, negative, rng.choice(WINDOWS, len(negative))) @ whiten
    # The first machine learns from the landmarks that are likelier in toxic documents.
    lift = np.array(lift)
    telling = lift > 1 if (lift > 1).any() else lift > 0 if (lift > 0).any() else lift == lift.max()
    witnesses, times = kernel.gram()[telling] @ whiten, np.log1p(np.array(often))[telling]
    for round_ in range(ROUNDS):
        sign = np.repeat([1.0, -1.0], [len(witnesses), len(against)])
        weight = np.concatenate([times / times.sum(), np.full(len(against), 2 / len(against))])
        w, bias = _machine(np.concatenate([witnesses, against]), sign, weight)
        alpha = whiten @ w / kernel.norm
        if round_ + 1 == ROUNDS:
            break
        values, which = highest_stretches(codes, fold(marks, alpha, letters), bias)
        top = np.maximum.reduceat(values, begins)
        # The highest sentences of each document. Labels can be wrong: a toxic document without a sentence above 0 gives no witness.
        order = np.lexsort((-top, text))
        rank = np.arange(len(order)) - np.searchsorted(text, text[order])
        ours = order[is_toxic[order] & (rank < WITNESSES) & (top[order] > 0)]
        hard = order[~is_toxic[order] & (rank == 0)]
        hard = hard[np.argsort(-top[hard], kind="stable")[:HARD_STRETCHES]]
        witnesses, times = np.concatenate([witnesses, stretches(values, which, ours)]), np.append(times, np.ones(len(ours)))
        against = np.concatenate([against, stretches(values, which, hard)])
    values = np.maximum.reduceat(highest_stretches(codes, fold(marks, alpha, letters), bias)[0], begins)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    x = np.array([_features(values[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
    scale = np.maximum(x.std(axis=0), 1e-6)
    scale[0] = 1
    logistic = _logistic(x / scale, y) / scale
    logistic[0] += np.log(MISSED * odds)
    return {"marks": marks, "alpha": alpha, "bias": float(bias), "logistic": logistic}


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows=lambda doc_id: F.lit(True), id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> dict | None:
    """The model. Labels are learned only from rows where fit_rows(doc_id) holds."""
    sample, rows = labelled(docs, labels, "toxic", fit_rows, id_col, text_col, max_rows)
    taken = {label: min(n, max_rows) for label, n in rows.items()}
    odds = (rows[1] / taken[1]) / (rows[0] / taken[0]) if len(rows) == 2 else 1.0
    return fitted(sample, partial(train, odds=odds))


def toxicity(model: dict | None, text: Column) -> Column:
    """The score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = model and model | {"tables": {}}
        for texts in series:
            parts = [document_scores(part.tolist(), worker) if worker else np.zeros(len(part)) for part in text_slices(texts)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows=lambda doc_id: F.lit(True), id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1). Labels are learned only from rows where fit_rows(doc_id) holds."""
    model = fit_toxicity(docs, labels, fit_rows, id_col, text_col, max_rows)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), toxicity(model, F.col(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows=lambda doc_id: F.lit(True), least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows that score less; columns as before. Each row is judged by its own text."""
    model = fit_toxicity(docs, labels, fit_rows, id_col, text_col, max_rows)
    return docs.where(toxicity(model, F.col(text_col)) < least)
