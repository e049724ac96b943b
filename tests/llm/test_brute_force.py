"""Secrets, quality, shards and packing against plain versions that share no code with the operators."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import best_fit_packing, common, quality, registry, secret_scan, sharding

from .test_operators import TEST, columns

# 1

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LOWER + LOWER.upper() + DIGITS


def _skip(text, at, chars, most=None):
    end = at
    while end < len(text) and text[end] in chars and (most is None or end - at < most):
        end += 1
    return end


def _assign_at(text, at):
    """(end, length of the value) of an assignment that starts here, or None."""
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        head = text[at : at + len(word)]
        if not head.isascii() or head.lower() != word:
            continue
        end = _skip(text, _skip(text, at + len(word), "\"'", 1), " ")
        if _skip(text, end, ":=", 1) == end:
            return None
        start = _skip(text, _skip(text, end + 1, " "), "\"'", 1)
        end = _skip(text, start, ALNUM + "+/_.=-")
        return (end, end - start) if end > start else None
    return None


def _base(text):
    """kind:start:end of the fixed patterns, read letter by letter."""
    found = []
    at = 0
    while at < len(text):
        hit = _assign_at(text, at)
        if hit and hit[1] >= 6:
            found.append((at, 0, hit[0]))
        at = hit[0] if hit else at + 1
    at = 0
    while at < len(text):
        end = _skip(text, at + 4, ALNUM[26:]) if text[at : at + 4] == "AKIA" else at
        if end > at and end - at >= 20:
            found.append((at, 1, end))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = _skip(text, at, DIGITS + "abcdef")
        if end - at >= 24:
            found.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(found)


def test_base_spans_equal_a_scanner():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", ":", "=", " ", "  ", '"', "'", "abc", "longvalue/1", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "-", ".", "é", "ſ", "K", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(24)))
        assert secret_scan.base_spans(text) == _base(text), text


def test_base_spans_of_all_documents(spark):
    found = {r["doc_id"]: r for r in registry.op1_secret_scan(spark, TEST).collect()}
    rows = columns(spark, TEST).select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        base = _base(r["text"] or "")
        got, want = found[r["doc_id"]], [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base]
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got["spans"].split(",")) | {""}


def test_random_strings_planted_in_documents(spark):
    rng = random.Random(8)
    texts = [r["text"].split(" ") for r in columns(spark, TEST).select("text").orderBy("doc_id").collect() if r["text"]]
    planted = []
    for words in texts:
        key, at = "".join(rng.choices(ALNUM, k=32)), rng.randrange(len(words) + 1)
        start = len(" ".join(words[:at])) + (at > 0)
        planted.append((" ".join([*words[:at], key, *words[at:]]), start, start + len(key)))
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted)], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.secret_spans(docs).collect()}
    hits, others = 0, 0
    for i, (_, start, end) in enumerate(planted):
        spans = [tuple(map(int, s.split(":")[1:])) for s in rows[i].split(",") if s.startswith("random:")]
        hits += any(a <= start + 4 and b >= end - 4 for a, b in spans)
        others += sum(b <= start or a >= end for a, b in spans)
    assert hits >= 0.98 * len(planted) and others <= 0.005 * len(planted)


# 5


def _features(text):
    """Bucket of every feature of a text, one for each occurrence; and the weight of a repeated pair."""
    free, mask = quality.BUCKETS - 4, (1 << 64) - 1
    place = lambda h: (((h * 0x9E3779B97F4A7C15) & mask) >> 32) % free + 4
    words, out = text.split(), []
    for w in words:
        out.append(place(zlib.crc32(w.encode())))
        marked = f"<{w}>"
        for n in (3, 4, 5):
            for at in range(len(marked) - n + 1):
                h = 0
                for k, c in enumerate(marked[at : at + n]):
                    h = ((h ^ (ord(c) + k)) * 0x100000001B3) & mask
                out.append(place(h ^ (h >> 29)))
    shares = {}
    for b in out:
        shares[b] = shares.get(b, 0.0) + 1.0
    for d in (1, 2, 3):
        same = sum(a == b for a, b in zip(words, words[d:], strict=False))
        shares[d] = same * len(out) / len(words) if words else 0.0
    total = sum(shares.values())
    return {b: v / total for b, v in shares.items()} if words else {}


def _plain_sgd(texts, labels, seed=11):
    """Table, output and bias by one loop over features, in double precision."""
    rng = np.random.default_rng(seed)
    docs, size = [_features(t) for t in texts], quality.DIMENSIONS
    table = rng.uniform(-1, 1, (quality.BUCKETS, size)) / size
    output, bias = np.zeros((size, 2)), np.log(np.bincount(labels, minlength=2) / len(labels))
    batches = -(-len(labels) // quality.BATCH)
    done = 0
    for _ in range(quality.EPOCHS):
        for rows in np.array_split(rng.permutation(len(labels)), batches):
            rate = quality.RATE * (1 - done / (quality.EPOCHS * batches))
            done += 1
            steps, turn, shift = {}, np.zeros_like(output), np.zeros(2)
            for i in rows:
                vector = sum((share * table[b] for b, share in docs[i].items()), np.zeros(size))
                p = np.exp(vector @ output + bias)
                p /= p.sum()
                p[labels[i]] -= 1
                for b, share in docs[i].items():
                    steps[b] = steps.get(b, 0) + share * (output @ p)
                turn += np.outer(vector, p)
                shift += p
            for b, step in steps.items():
                table[b] -= 25 * rate * step / len(rows)
            output -= rate * turn / len(rows)
            bias -= 0.1 * rate * shift / len(rows)
    return table, output, bias


def test_quality_equals_table_and_softmax(spark):
    rows = columns(spark, TEST).join(columns(spark, TEST, "labels"), "doc_id").where("quality is not null and text is not null").orderBy("doc_id").select("doc_id", "text", "quality").limit(140).collect()
    odd = [(900_001, None), (900_002, ""), (900_003, "a a a a é 中文 x"), (900_004, "one")]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in rows], "doc_id long, quality int")
    sample = [tuple(r) for r in common.labelled(docs, labels, "quality", lambda i: F.lit(True), "doc_id", "text", quality.MAX_ROWS)[0].select("text", "label").collect()]
    assert len(sample) == len(rows) and len({y for _, y in sample}) == 2
    table, output, bias = _plain_sgd(*map(list, zip(*sample, strict=True)))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    for doc_id, text in [(r["doc_id"], r["text"]) for r in rows] + odd:
        vector = sum((share * table[b] for b, share in _features(text or "").items()), np.zeros(quality.DIMENSIONS))
        p = np.exp(vector @ output + bias)
        assert got[doc_id] == pytest.approx(p[1] / p.sum(), abs=2e-3)


# 7


@pytest.mark.parametrize(("fine", "shards", "tokens", "rows"), [(sharding.FINE, 40, 0.08, 3), (200, 5, 0.05, 10)])
def test_shards_are_balanced_in_all_dimensions(spark, fine, shards, tokens, rows):
    """All groups singly; and by buckets, 40 of them a shard, where a full table has 410."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path("byte_bpe_50k.json")).encode
    docs = columns(spark, TEST)
    ids = {r["doc_id"]: len(encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    out = sharding.assign_shards(docs, shards, fine=fine).toPandas()
    held = out.assign(tokens=out["doc_id"].map(ids)).groupby("shard").agg(bytes=("size", "sum"), tokens=("tokens", "sum"), rows=("size", "size"))
    spread = held.max() - held.min()
    print(fine, spread.to_dict(), held.mean().to_dict())
    assert spread["bytes"] <= 0.02 * held["bytes"].mean()
    assert spread["tokens"] <= tokens * held["tokens"].mean()
    assert spread["rows"] <= rows


# 8


def test_each_sequence_is_the_best_of_two(spark):
    rng = np.random.default_rng(6)
    for n, capacity in itertools.product((1, 9, 60), (10, 37)):
        for _ in range(6):
            counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
            left = [k for k in range(capacity + 1) for _ in range(counts[k])]
            for used, times in best_fit_packing.plan_patterns(counts, capacity):
                for _ in range(times):  # each sequence by itself, from what is left then
                    rest, filled = list(left), []
                    while fits := [x for x in rest if x <= capacity - sum(filled)]:
                        filled.append(max(fits))
                        rest.remove(filled[-1])
                    want = sum(filled)
                    if len(filled) > 1 and want < capacity:
                        room = capacity - want + filled[-1]
                        want += max([0, *(a + b - filled[-1] for a, b in itertools.combinations(rest, 2) if a + b <= room)])
                    assert sum(used) == want <= capacity
                    assert used[: len(filled) - 1] == filled[:-1]
                    for x in used:
                        left.remove(x)
            assert not left
