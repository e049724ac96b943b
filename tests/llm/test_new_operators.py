"""Language identification, the audit of sources and whitening, against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraloom.llm import embedding_whitening as white
from terraloom.llm import language_id, registry, terms
from terraloom.llm import source_divergence as audit

from ..conftest import SF_SMALL, SF_TEST

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", "Aé b-c 1x", "É中文 x\U0001f600Y", "_a__B ", "a" * 70_000, "9", "ab\nAB\x00ab"]


@pytest.mark.parametrize("texts", [ODD, ODD[::-1], [""], ["", "", "x", ""], []])
def test_terms_equal_the_pattern(texts):
    distinct, code, row = terms.cut_terms(pa.array(texts, pa.string()))
    names = [t.decode() for t in distinct.to_pylist()]
    found = defaultdict(list)
    for c, r in zip(code, row, strict=True):
        found[int(r)].append(names[c])
    assert [found[i] for i in range(len(texts))] == [TERM.findall(t.translate(UPPER)) for t in texts]


def test_slices_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(terms, "SLICE_BYTES", 10)
    texts = ["abc", "", "x" * 40, "de", "f" * 9, "", "g"]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"]) for part in (texts[:2], [], texts[2:5], texts[5:])]
    out = list(terms.slices(iter(batches)))
    assert [t for table in out for t in terms.whole(table, "text").to_pylist()] == texts and len(out) == 3


# Vocabulary


def _vocabulary(words: list[str], most: int):
    """Transducers of sorted words, in runs of at most so many."""
    rows, base = [], 0
    for at in range(0, len(words), most):
        part = [w.encode() for w in words[at : at + most]]
        made = audit.Transducer()
        for w in part:
            made.add(w)
        rows.append({"lang": "x", "first": part[0], "last": part[-1], "base": base, **{k: v.tobytes() for k, v in made.done().items()}})
        base += len(part)
    return rows


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(st.sampled_from("abcé中"), min_size=1, max_size=14), min_size=1, max_size=60), st.integers(1, 20))
def test_ordinals_are_places_in_byte_order_and_lead_back(words, most):
    ordered = sorted(words, key=str.encode)
    rows = _vocabulary(ordered, most)
    other = [w + "z" for w in ordered] + ["zz", "a" * 40]
    asked = ordered + [w for w in other if w not in words]
    got = audit.Vocabulary(rows).ordinals(pa.array([w.encode() for w in asked], pa.large_binary()), np.array(["x"] * len(asked), object))
    assert got.tolist() == [*range(len(ordered)), *[-1] * (len(asked) - len(ordered))]
    for r in rows:
        parts = {k: np.frombuffer(r[k], kind) for k, kind in audit.PARTS.items()}
        assert [audit.term_of(parts, i).decode() for i in range(min(most, len(ordered) - r["base"]))] == ordered[r["base"] : r["base"] + most]


@pytest.mark.parametrize("words", [["a"], ["tap", "taps", "top", "tops"], ["car", "cars", "cat", "cats", "do", "done", "dos"]])
def test_the_transducer_is_minimal(words):
    made = audit.Transducer()
    for w in words:
        made.add(w.encode())
    # States of the minimal automaton are the distinct sets of endings of all prefixes.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(made.done()["ends"]) == len(endings)


def _audit_by_hand(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for lang, source, text in rows]
    seen = Counter((lang, t) for lang, _, words in docs for t in set(words))
    count = Counter((lang, source, t) for lang, source, words in docs for t in words)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted((t for (x, t), n in seen.items() if x == lang and n >= least), key=str.encode)
        sources = {d[1] for d in docs if d[0] == lang}
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))  # noqa: B023, E731
        p = {s: [share(count[lang, s, t], n[s]) for t in kept] for s in sources}
        q = [share(sum(count[lang, s, t] for s in sources), sum(n.values())) for t in kept]
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s]
            best = [(-((a - b) ** 2 // b), t.encode(), t) for a, b, t in zip(p[s], q, kept, strict=True) if a > b and count[lang, s, t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)}
    return out


ROWS = [
    *[("en", "a", "the cat the dog é"), ("en", "b", "The cat sat"), ("en", "c", "the É zebra dog"), ("en", None, "dog dog 中文"), ("en", "a", None), ("en", "silent", ""), ("en", "b", "the 中文 é cat")],
    *[("de", "a", f"nur{i} einmal") for i in range(2)], ("de", "b", "nichts"), (None, None, "x x x"), (None, "a", "x y"), ("", "a", "x"), ("fr", "only", "un un"), ("fr", "only", "un"), ("fr", "only", "un deux"),
]


@pytest.mark.parametrize(("segment", "block", "tile", "chunk"), [(1 << 16, 1 << 26, 128, 1 << 13), (2, 1, 2, 1), (1, 300, 1, 2)])
def test_audit_equals_brute_force(spark, segment, block, tile, chunk):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string").withColumn("rank", F.lit("clash")).repartition(3)
    found = {tuple(r) for r in audit.audit(docs, segment=segment, block=block, tile=tile, chunk=chunk).collect()}
    assert found == _audit_by_hand(ROWS)
    assert {r[:2] for r in found if r[2] == "pair"} >= {("de", "a"), ("", "")}  # no kept term, null names


def test_audit_of_nothing(spark):
    assert audit.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_audit_top_and_ties(spark):
    rows = [("x", s, " ".join(f"w{'abc'[i % 3]}{chr(97 + i)}" for i in range(20)) + (" extra" if s == "a" else "")) for s in "abc"]
    found = {tuple(r) for r in audit.audit(spark.createDataFrame(rows, "lang string, source string, text string"), top=4).collect()}
    assert found == _audit_by_hand(rows, top=4)


def test_audit_equals_sql_on_the_small_tables(spark):
    found = registry.op12_source_divergence(spark, SF_SMALL)
    want = duckdb.execute(registry.OP12_SQL.replace("from documents", f"from '{SF_SMALL}/documents.parquet'"))
    columns = [c[0] for c in want.description]
    assert found.columns == columns
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(want.fetchall()) and got


# Whitening


def _whitened_by_hand(vectors, most):
    x = np.array([[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    cov = np.array([[float(sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True))) / float(n) ** 3 for j in range(y.shape[1])] for i in range(y.shape[1])])
    values, parts = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return (y**2).sum(axis=1), (y.astype(float) / n) @ parts[:, order], values[order], np.trace(cov)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [1.0] * 6 + [None]), (1002, [float("nan")] + [0.0] * 6), (1003, [float("inf")] * 7), (1004, [float("-inf")] + [0.0] * 6)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"component": F.lit(9), "x": F.lit("clash")})
    found = white.whiten(table.repartition(5), 4).toPandas().sort_values(["vec_id", "component"])
    deviation, projected, values, trace = _whitened_by_hand(vectors, 4)
    assert found["vec_id"].tolist() == [i for i in range(300) for _ in range(4)] and (found["n"] == 300).all()
    assert found["deviation"].tolist() == [int(d) for d in deviation for _ in range(4)]
    got = found["whitened"].to_numpy().reshape(300, 4)
    want = projected / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, rtol=1e-8, atol=1e-9)
    assert np.allclose(found["explained"].to_numpy().reshape(300, 4)[0], values / trace, rtol=1e-10)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9
    assert np.allclose(np.cov(got.T, bias=True), np.eye(4), atol=1e-9)


@given(st.lists(st.lists(st.integers(-(1 << 50), 1 << 50), min_size=3, max_size=3), min_size=0, max_size=20))
def test_square_sums_are_exact(rows):
    y = np.array(rows, np.int64).reshape(-1, 3)
    assert white.square_sums(y) == [sum(int(v) ** 2 for v in column) for column in y.T]


def test_polarisation_gives_the_exact_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(999_900, 1_000_100, (50, 5))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "vec_id string, x array<long>").repartition(4)
    sums = white.column_sums(rows, 5)
    assert sums == x.sum(axis=0).tolist()
    squares = white.pair_squares(rows, 50, sums)
    y = 50 * x - x.sum(axis=0)
    for i, j in product(range(5), repeat=2):
        if i < j:
            assert squares[i, j] - squares[i, i] - squares[j, j] == 2 * int(y[:, i] @ y[:, j])


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert white.whiten(make([])).count() == 0 and white.whiten(make([(1, None)])).columns[-1] == "identity_error"
    assert white.whiten(make([(1, [])])).count() == 0
    same = white.whiten(make([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert len(same) == 6 and {r["whitened"] for r in same} == {0.0} and {r["identity_error"] for r in same} == {0.0} and None in {r["vec_id"] for r in same}
    uneven = white.whiten(make([(1, [0.5, 1.0]), (2, [0.5]), (3, []), (2**60 + 1, [0.25, 3.0])])).toPandas()
    padded = white.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 0.0]), (3, [0.0, 0.0]), (2**60 + 1, [0.25, 3.0])])).toPandas()
    order = ["vec_id", "component"]
    assert np.allclose(uneven.sort_values(order).to_numpy(float), padded.sort_values(order).to_numpy(float)) and 2**60 + 1 in set(uneven["vec_id"])


# Languages


@pytest.fixture(scope="module")
def guessed(spark):
    docs = spark.read.parquet(f"{SF_TEST}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    return registry.op11_language_id(spark, SF_TEST).toPandas().merge(docs, on="doc_id")


def test_languages_of_held_out_documents(guessed):
    assert (guessed["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in guessed["doc_id"]]).all()
    held = guessed[guessed["held_out"]]
    right = held["lang"] == held["lang_pred"]
    assert held.groupby("lang").size().min() > 10
    for lang, own in right.groupby(held["lang"]):
        assert own.mean() > 0.97, lang
    assert guessed["score"].between(0, 1).all()


def test_short_texts_are_told_apart(spark, guessed):
    """The first few words of held-out documents; the model is fitted on whole rows as before."""
    docs = spark.read.parquet(f"{SF_TEST}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    short = docs.where(held).select((-F.col("doc_id") - 1).alias("doc_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 5), " ").alias("text"), F.lit(None).cast("string").alias("lang"))
    own = docs.where(~held).select("doc_id", "text", "lang").unionByName(short)
    found = {-r["doc_id"] - 1: r["lang_pred"] for r in language_id.identify(own).collect() if r["doc_id"] < 0}
    truth = dict(zip(guessed["doc_id"], guessed["lang"], strict=True))
    assert np.mean([found[i] == truth[i] for i in found]) > 0.85


def test_scores_equal_a_plain_reading_of_the_machines(spark):
    """Margins by dictionaries over each text's features, whole texts, no slices."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es")] * 5)]
    rows += [(100, "the hund", None), (101, "x" * 3000, None), (102, "le perro 123 --", None), (103, "É", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("lang is not null"))
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for i, text, _ in rows:
        words = TERM.findall(text.lower())
        buckets = [b for w in words for b in language_id.term_features(pa.array([w.encode()], pa.large_binary()))[0]]
        margins = model["weights"][buckets].astype(float).sum(axis=0) / max(len(buckets), 1) + model["bias"]
        lang, score = language_id.judge(model, margins[None])
        assert (found[i]["lang_pred"], found[i]["score"]) == (lang[0], pytest.approx(float(score[0]), rel=1e-6))
    assert {k[0] for k in model["keys"]} == {"family", "de", "es"} and [found[i]["lang_pred"] for i in range(4)] == ["en", "de", "fr", "es"]


def test_features_do_not_depend_on_stretches(monkeypatch):
    words = pa.array([b"abcdefgh", b"x", b"", "été".encode(), b"q" * 50], pa.large_binary())
    one = sorted(zip(*map(list, language_id.term_features(words)), strict=True))
    monkeypatch.setattr(language_id, "STRETCH", 7)
    assert sorted(zip(*map(list, language_id.term_features(words)), strict=True)) == one


def test_languages_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.identify(make([])).count() == 0
    nothing = language_id.identify(make([(1, "abc", None), (2, None, "en"), (3, "12 -", "en")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    single = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(make([(1, "abc", "xx"), (1, "abc", "xx"), (None, "q" * 100_000, None), (3, "12", "xx"), (4, None, "xx")])).collect()}
    assert single == {1: ("xx", 1.0), None: ("xx", 1.0), 3: ("und", 0.0), 4: ("und", 0.0)}
    unlike = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(make([(1, "aaa", "qq"), (2, "bbb", "zz"), (3, "aa a", None)]).withColumn("score", F.lit("clash"))).collect()}
    assert unlike == {1: "qq", 2: "zz", 3: "qq"}


def test_the_sample_is_bounded_and_whole_where_few(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 5, "aa").otherwise("bb").alias("lang"))
    n = {r["lang"]: r["count"] for r in language_id._sampled(docs, 100).groupBy("lang").count().collect()}
    assert n == {"aa": 5, "bb": 100}


# Chat formatting: equal turns


def test_equal_turns_go_by_their_text_before_it_is_escaped(spark, tmp_path):
    """Escaping puts a backslash into `<s>`, which would move it behind `<a`; null turns and texts take part."""
    rows = [(1, 0, "user", "<s>"), (1, 0, "user", "<a"), (1, 0, "user", "[INST]"), (1, 0, "user", "[A"), (1, 1, "assistant", "<s>"), (1, 1, "assistant", "<"), (2, None, "user", None), (2, 0, "user", "\\"), (2, 0, "user", "[")]
    rows += [(3, 0, "user", "x" * 200_000), (3, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = registry.op6_chat_format(spark, str(tmp_path))
    want = duckdb.execute(registry.OP6_SQL.replace("from conversations", f"from '{tmp_path}/conversations.parquet/*.parquet'"))
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(want.fetchall())
