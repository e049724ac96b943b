"""The training-data operators against brute force, round trips and planted cases; edge cases of each."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import best_fit_packing, chat_format, common, components, decontamination, exact_dedup, ngram_join, quality, registry, secret_scan, sharding, toxicity, url_filter

SMALL, TEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, digest string, n int"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "wort " * 20_000
EDGE = [None, "", "  ", "one", "One", "one", LONG, LONG, "a b c d e f g h i j k l", "é" * 50, "😀 \x00 x"]


def columns(spark, sf, table="documents"):
    return spark.read.parquet(f"{sf}/{table}.parquet")


# 1


def test_secret_spans(spark):
    key = "AKIA" + "Z" * 16
    text = f"Password : 'hunter22' é token=short {key} x\"api_key\"=abc.def {'0f' * 12} 9f8KqLmZ2xWv7TtRbPq3Ys1Jd0Ha {'ab' * 20}"
    row = secret_scan.secret_spans(docs_of(spark, [text])).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"], row["n_random"]) == (2, 1, 2, 2)  # 24 hexadecimal digits are no known digest
    base = [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(((k, m) for k, p in zip(("assign", "access", "hex"), (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX), strict=True) for m in p.finditer(text) if k != "assign" or len(m[2]) >= 6), key=lambda x: x[1].start())]
    assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) < set(row["spans"].split(","))


def test_a_short_value_consumes_what_follows(spark):
    row = secret_scan.secret_spans(docs_of(spark, ["token: secret: abcdefgh", "token: abc secret=abcdef", "pa\u017f\u017fword=abcdefgh"])).orderBy("doc_id").collect()
    assert [r["n_assign"] for r in row] == [1, 1, 0]


def test_random_strings_behind_words_and_short_ones():
    encoding, rng = secret_scan._vocabulary(None), np.random.default_rng(2)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    for before in ("documentation/articles/download/", "authorization_header=", "services/webhooks/incoming/", ""):
        for n in (16, 20, 24, 32):
            keys = ["".join(rng.choice(letters, n)) for _ in range(50)]
            keys = [k for k in keys if any(map(str.isdigit, k)) and any(map(str.isalpha, k))]
            found = [secret_scan.random_spans(before + k, encoding) for k in keys]
            assert sum(any(b >= len(before) + 0.8 * n and a <= len(before) + 0.2 * n for a, _, b in spans) for spans in found) >= 0.9 * len(keys)
    assert not secret_scan.random_spans("documentation/2024/articles-of-the-day/download-page-2/index", encoding)
    assert not secret_scan.random_spans("archive/sha1=" + hashlib.sha1(b"x").hexdigest(), encoding)


def test_random_strings_of_letters_only():
    encoding, rng = secret_scan._vocabulary(None), np.random.default_rng(4)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"):
        keys = ["".join(rng.choice(list(letters), 24)) for _ in range(100)]
        assert sum(bool(secret_scan.random_spans(k, encoding)) for k in keys) >= 85
    for name in ("getHttpResponseCodeFromServer", "internationalization-of-documents", "maximum_number_of_connections", "20240131-20240228-00000001"):
        assert not secret_scan.random_spans(name, encoding)


def test_known_digests_are_left_out():
    encoding = secret_scan._vocabulary(None)
    assert not secret_scan.is_random(hashlib.sha1(b"x").hexdigest(), encoding)
    assert not secret_scan.is_random("0F8FAD5B-D9CB-469F-A165-70867728950E", encoding)
    assert not secret_scan.is_random("internationalization-of-documents-2", encoding)
    assert secret_scan.is_random("9f8KqLmZ2xWv7TtRbPq3Ys1Jd0Ha", encoding)


# 2


def test_exact_groups_equal_sql_on_edges(spark):
    ids = [5, 3, 8, 1, 2, 9, 4, 7, 6, 11, 10]
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs_of(spark, EDGE, ids)).collect()}
    groups = defaultdict(list)
    for i, t in zip(ids, EDGE, strict=True):
        groups[t or ""].append(i)
    for text, members in groups.items():
        for i in members:
            assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (max(members), len(members), i == max(members))
            assert found[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_of_repeated_rows_one_stays(spark):
    docs = docs_of(spark, ["same"] * 4 + [None, None], [7, 7, 7, 2, None, None])
    out = exact_dedup.exact_groups(docs).collect()
    assert sum(r["kept"] for r in out) == 2 and len(out) == 6
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(-1, ""), (7, "same")]


def test_large_groups_and_others_join_alike(spark):
    docs = docs_of(spark, ["hot"] * 50 + [f"twice {i // 2}" for i in range(20)] + EDGE, [*range(70), *range(100, 100 + len(EDGE))])
    rows = lambda n: sorted(map(tuple, exact_dedup._groups(docs, "doc_id", "text", large_groups=n).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert rows(0) == rows(3) == rows(200_000)


def test_bloom_flags_every_repeated_hash(spark):
    hashed = spark.range(20_000).select(F.xxhash64(F.col("id") % 15_000).alias("h"), "id")
    flagged = exact_dedup.possibly_repeated(hashed.repartition(5))
    assert flagged.where(~F.col("repeated") & (F.col("id") % 15_000 < 5000)).count() == 0
    assert flagged.where(F.col("repeated")).count() < 10_200


def test_each_slice_reads_its_own_folder(spark):
    hashed = spark.range(20_000).select(F.xxhash64(F.col("id") % 15_000).alias("h"), "id")
    with mock.patch.object(exact_dedup, "cut_table", wraps=exact_dedup.cut_table) as written, mock.patch.object(exact_dedup, "cut", wraps=exact_dedup.cut) as cuts:
        flagged = exact_dedup.possibly_repeated(hashed, 4000)
    assert flagged.count() == 20_000 and written.call_count == 1 and cuts.call_count == 5
    assert flagged.where(~F.col("repeated") & (F.col("id") % 15_000 < 5000)).count() == 0
    assert flagged.where(F.col("repeated")).count() < 10_200
    for call in cuts.call_args_list:
        plan = call.args[0]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(slice" in plan


# 3 and 5


def _weights(codes, starts):
    """Weights of the subsequences that start at the places, by enumeration: letters, and the sum of squared weights place by place."""
    out, squares = Counter(), 0.0
    for start in starts:
        for size in (3, 4):
            for rest in itertools.combinations(range(start + 1, start + 9), size - 1):
                at = (start, *rest)
                if at[-1] < len(codes) and all(codes[i] for i in at):
                    out[tuple(int(codes[i]) for i in at)] += 0.7 ** (at[-1] - start + 1)
                    squares += 0.49 ** (at[-1] - start + 1)
    return out, squares


def _value(codes, begin, width, marks, alpha, bias):
    """A stretch's value, straight from the definition: the weighted sum of its kernels with the landmarks."""
    own, squares = _weights(codes, range(begin, min(begin + width, len(codes))))
    total = sum(a * sum(v * m[k] for k, v in own.items() if k in m) for m, a in zip(marks, alpha, strict=True))
    return bias + total / math.sqrt(squares + toxicity.LEAST_NORM)


def test_stretches_equal_the_sum_over_landmarks():
    marks = toxicity._marks(["idiot", "worthless scum", "garden"])
    alpha = np.array([1.0, 2.0, -0.5])
    codes, begins, _ = toxicity.sentence_codes(["an i*d--i o t wor\u0442hless. scumm\ngardens of idiots"])
    tables = toxicity.fold(marks, alpha)
    found, rows = toxicity.stretch_values(codes, tables, 0.25), [_weights(m, range(len(m)))[0] for m in marks]
    norms = toxicity.start_norms(codes)
    for k, width in enumerate(toxicity.WINDOWS):
        for begin in range(0, len(codes), 3):
            assert found[k, begin] == pytest.approx(_value(codes, begin, width, rows, alpha, 0.25), rel=1e-3, abs=1e-4)
            assert norms[begin] == pytest.approx(_weights(codes, [begin])[1], rel=1e-3, abs=1e-6)
    values, which = toxicity.highest_stretches(codes, tables, 0.25)
    assert (values == found.max(axis=0)).all() and (which == found.argmax(axis=0)).all()
    kernel = toxicity._Kernel(marks)
    padded, places = np.pad(codes, (0, 40)), np.arange(0, len(codes), 5)
    got = kernel(padded, places, np.full(len(places), 6)) @ (alpha * kernel.norm) + 0.25
    assert got == pytest.approx([_value(codes, i, 6, rows, alpha, 0.25) for i in places], rel=1e-3, abs=1e-4)


def _toy_model():
    rng = np.random.default_rng(5)
    words = ["garden", "window", "yellow", "tiger", "morning", "paper", "stone", "river", "table", "candle"]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [f"{say(8)}. {say(3)} {rng.choice(['idiot', 'worthless', 'stupid'])} {say(4)}. {say(6)}" if i % 2 else f"{say(8)}. {say(9)}" for i in range(120)]
    return toxicity.train(texts, [i % 2 for i in range(120)]) | {"tables": {}}


def test_scores_equal_brute_force():
    model = _toy_model()
    rows = [_weights(m, range(len(m)))[0] for m in model["marks"]]
    texts = ["Yellow paper. An i-d-i-o-t of stone.\nRiver", "stone table", "", "..."]
    scores = toxicity.document_scores(texts, model)
    for text, score in zip(texts, scores, strict=True):
        values = []
        for sentence in re.split(r"[.!?](?:\s|$)|\n", text):
            codes, begins, _ = toxicity.sentence_codes([sentence])
            if len(begins):
                places = range(begins[0], len(codes))
                values.append(max(_value(codes, i, w, rows, model["alpha"], model["bias"]) for i in places for w in toxicity.WINDOWS))
        if not values:
            assert score == 0
            continue
        x = np.array(toxicity._features(np.array(values)))
        assert score == pytest.approx(1 / (1 + math.exp(-x @ model["logistic"])), rel=1e-2)


def test_gapped_and_inserted_spellings():
    model = _toy_model()
    score = lambda w: float(toxicity.document_scores([f"yellow stone. river {w} table candle. morning"], model)[0])
    assert all(score(w) > 0.5 for w in ("idiot", "IDIOT", "id iot", "i*d*i*o*t", "\u00ed.d.i.o.t", "idxiot", "st-upid", "stuupid", "worth  less"))
    assert score("i*d*i*o*t") == score("i****d****i****o****t")
    assert score("garden") < 0.5 and score("tiger") < 0.5
    long = "garden window " * 3000
    assert toxicity.document_scores([long + "an idiot. " + long, long + "paper. " + long], model) == pytest.approx([1, 0], abs=0.4)


def test_letters_of_all_scripts():
    one, two, latin, signs = (toxicity.sentence_codes([w])[0] for w in ("\u0434\u0443\u0440\u0430\u043a", "\u0434\u043e\u043c\u0438\u043a", "zzzzz", "\u201c\u2014\u200b\U0001f600"))
    assert (one != two).any() and one.max() >= toxicity.LATIN > latin.max() and not signs.any()
    plain, other = toxicity.sentence_codes(["Stra\u00dfe \u00c6r\u00f8"])[0], toxicity.sentence_codes(["strase aro"])[0]
    assert (plain == other).all()


def test_sentences_and_whose_they_are():
    texts = ["", "One. Two\nthree", "?!", "a.b", "x"]
    codes, begins, text = toxicity.sentence_codes(texts)
    assert text.tolist() == [1, 1, 1, 3, 4] and (codes[begins] == toxicity.EDGE).all()


def test_training_without_a_class():
    assert toxicity.train(["a b c", "d e f"], [1, 1]) is None
    assert toxicity.train(["", ""], [1, 0]) is None


def test_toxic_sentences_of_harmless_words():
    rng = np.random.default_rng(3)
    words = ["garden", "bridge", "jump", "go", "off", "yellow", "tiger", "morning", "paper", "stone", "river", "table"]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [f"{say(8)}. {say(7)}." if i % 2 else f"{say(8)}. go jump off a bridge. {say(5)}." for i in range(240)]
    labels = [1 - i % 2 for i in range(240)]
    model = toxicity.train(texts[:160], labels[:160]) | {"tables": {}}
    scores = toxicity.document_scores(texts[160:], model)
    assert ((scores >= 0.3) == np.array(labels[160:])).mean() > 0.8


def test_dropping_judges_each_row_by_its_text(spark):
    words = ["garden", "window", "yellow", "tiger", "morning"]
    rows = [(i, f"{words[i % 5]} and {words[i % 3]} " + ("you idiot" if i % 2 else "you see")) for i in range(40)]
    docs = docs_of(spark, [t for _, t in rows])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    same = docs.union(docs_of(spark, ["garden and tiger you idiot", "garden and tiger you see", None, ""], [3, 3, 3, 3]))
    kept = toxicity.drop_toxic(same, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["text"]) for r in kept.where("doc_id = 3").collect()) == sorted(["garden and tiger you see", "None", ""])
    assert not [r for r in kept.collect() if "idiot" in (r["text"] or "")]


def _accuracy(spark, query, label, folds, held):
    scored = query(spark, TEST)
    rows = scored.join(columns(spark, TEST, "labels"), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert scored.count() == columns(spark, TEST).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in scored.collect())
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity_on_held_out_rows(spark):
    assert _accuracy(spark, registry.op3_toxicity, "toxic", 4, 2) > 0.9
    rows = registry.op3_toxicity(spark, TEST).join(columns(spark, TEST, "labels"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_a_row_of_each_id_is_learnt_from(spark):
    docs = docs_of(spark, ["b", "a", None, "c", "d"], [1, 1, 1, 2, 9])
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1), (9, 1)], "doc_id long, toxic int")
    sample, rows = common.labelled(docs, labels, "toxic", lambda i: i < 9, "doc_id", "text", 5)
    assert [(r["doc_id"], r["text"], r["label"]) for r in sample.collect()] == [(1, "a", 0), (2, "c", 1)] and rows == {0: 1, 1: 2}


def test_quality_on_held_out_rows(spark):
    assert _accuracy(spark, registry.op5_quality, "quality", 5, 0) > 0.9


@pytest.mark.parametrize(("score", "label"), [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scoring_edges(spark, score, label):
    texts = ["fine day in the garden today", "you idiot moron trash###"] * 15
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (31, None)], f"doc_id long, {label} int")
    docs = docs_of(spark, [*texts, *EDGE], [*range(30), None, *range(100, 110)])
    out = score(docs, labels).collect()
    assert len(out) == 41 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert (by[1] > by[0]) and by[1] == by[3]
    assert score(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in score(docs, labels.limit(0)).collect()}) == 1


# 4


def _models(spark, pages, order=url_filter.ORDER):
    """The score of each URL, computed with dictionaries."""
    rows = [(r["url"] or "") for r in url_filter.score_urls(pages, order=order).where("counted").select("url").collect()]
    decided = {r["url"] or "": r["decided"] for r in url_filter.score_urls(pages, order=order).collect()}
    counts = {a: Counter() for a in ("allow", "block")}
    contexts = {a: Counter() for a in ("allow", "block")}
    for url in rows:
        action = decided[url]
        text = url_filter.START * order + url + url_filter.END
        for i in range(order, len(text)):
            for k in range(order + 1):
                if action:
                    counts[action][text[i - k : i + 1]] += 1
                    contexts[action][(k, text[i - k : i])] += 1

    def p(action, gram, k):
        below = p(action, gram, k - 1) if k else 1 / url_filter.ALPHABET
        part = gram[len(gram) - k - 1 :]
        return (counts[action][part] + url_filter.SMOOTHING * below) / (contexts[action][(k, part[:-1])] + url_filter.SMOOTHING)

    out = {}
    for url in decided:
        text = url_filter.START * order + url + url_filter.END
        terms = [math.log(p("allow", text[i - order : i + 1], order)) - math.log(p("block", text[i - order : i + 1], order)) for i in range(order, len(text))]
        out[url] = sum(terms) / len(terms)
    return out


def test_url_scores_equal_brute_force(spark):
    pages = columns(spark, SMALL, "pages")
    want = _models(spark, pages)
    rows = url_filter.filter_urls(pages).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r["score"] == pytest.approx(want[r["url"]], abs=1e-9)


def test_frequent_and_rare_grams_join_alike(spark):
    pages = columns(spark, SMALL, "pages")
    pages = pages.unionByName(pages.limit(3).withColumn("url", F.lit(None).cast("string")))
    scores = lambda n: sorted((r["page_id"], r["url"], round(r["score"], 9)) for r in url_filter.score_urls(pages, large_grams=n).collect())
    want = scores(200_000)
    assert len(want) == pages.distinct().count() and scores(50) == want and scores(0) == want


def test_rules_and_parts_of_urls(spark):
    urls = {
        "http://a.Example.COM/en/7x?y": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://com/en/1": ("com", "/en/1", "com/en/", "block"),
        "http://notcom/en/1": ("notcom", "/en/1", None, None),
        "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "http://x.example.net/de/8": ("x.example.net", "/de/8", "example.net/de/8", "block"),
        "http://b.org": ("b.org", "", None, None),
        "a://b://c.org/es/": ("b:", "//c.org/es/", None, None),
        "no scheme/en/": ("", "", None, None),
        "http://É.org/es/\n#x": ("É.org", "/es/\n", "org/es/", "block"),
        "http://user?q/en/": ("user", "", None, None),
    }
    rows = [(i, u, "html") for i, u in enumerate(urls)] + [(90, None, ""), (90, None, ""), (None, "http://b.org", "")]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    found = {r["page_id"]: r for r in out}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert found[90]["host"] == found[90]["path"] == ""
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 6


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\[INST]\\\\", "<<SYS>><</SYS>>", "<", "[", "", "\\", "<</s>", "<<ROLE 41>>x<</ROLE>>", "a\nb\r\n", "$1 \\1", None, LONG]
    rows = [(i, n, role, t) for i in range(3) for n, (role, t) in enumerate((("user", "assistant", "system", "tool\\", None)[(n + i) % 5], t) for n, t in enumerate(nasty))]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = out.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), "formatted").collect()
    for r in got:
        want = [(role or "", t or "") for i, _, role, t in rows if i == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")


def test_turn_order(spark):
    cases = ["ua", "sua", "uaua", "u", "sau", "au", "s", "uua", "x", "uas"]
    roles = {"u": "user", "a": "assistant", "s": "system", "x": None}
    rows = [(c, n, roles[k], "t") for c in cases for n, k in enumerate(c)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert {r["conv_id"] for r in out.where("valid").collect()} == {"ua", "sua", "uaua", "u"}


# 7


@pytest.mark.parametrize("fine", [200, sharding.FINE])
def test_shards(spark, fine):
    docs = columns(spark, TEST)
    out = sharding.assign_shards(docs.withColumn("unit", F.lit(1)), 40, fine=fine).toPandas()
    assert len(out) == docs.count()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() < 0.02 * sizes.mean()
    assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and len(text[r.doc_id].encode()) + 16 == r.size for r in out.itertuples())


def test_a_hot_group_is_split_and_edges(spark):
    docs = docs_of(spark, ["hot"] * 400 + [f"cold {i}" for i in range(400)] + EDGE, [*range(800), None, None, *range(900, 909)])
    out = sharding.assign_shards(docs, 8, fine=64).toPandas()
    assert len(out) == 811 and out.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    hot = out[out.text_crc32 == zlib.crc32(b"hot")]
    assert hot["shard"].nunique() > 1
    assert sharding.assign_shards(docs.limit(0), 8).count() == 0


# 8


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = docs_of(spark, [*EDGE, "a <|endoftext|> b", "x" * 5000, " \t" * 3000] + [f"text number {i} " * (i % 90) for i in range(300)], [None, *range(1, 314)])
    out = best_fit_packing.pack_documents(docs).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    for doc_id, part in out.groupby("doc_id", dropna=False):
        codes = ids[None if doc_id != doc_id or doc_id is None else int(doc_id)]
        part = part.sort_values("piece")
        assert list(part["piece"]) == list(range(len(part))) and part["length"].sum() == len(codes)
        assert (part["length"].iloc[1:] == 2048).all() and (len(part) == 1) == (len(codes) <= 2048)
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(codes[r.start : r.start + r.length], "<u4").tobytes())
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["length"].sum() <= 2048 and list(part["offset"]) == [0, *part["length"].cumsum()[:-1]]
    assert out["sequence_id"].nunique() <= 1.02 * out["length"].sum() / 2048 + 1
    assert best_fit_packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 5000):
        counts = np.bincount(rng.integers(1, 101, n), minlength=101)
        used = np.zeros(101, np.int64)
        for lengths, times in best_fit_packing.plan_patterns(counts, 100):
            assert sum(lengths) <= 100
            np.add.at(used, lengths, times)
        assert (used == counts).all()


def test_two_pieces_replace_the_smallest_where_they_fit_better():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert best_fit_packing.plan_patterns(counts, 10)[0] == ([6, 2, 2], 1)


# 9


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _leaks(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w = _words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found)
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def _check_leaks(spark, docs, items):
    got = decontamination.contaminated(docs_of(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert {r[0]: tuple(r)[1:] for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()} == _leaks(docs, items)
    return got


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b", "c", "É", "é", "7"]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, make(int(rng.integers(0, 16)))) for i in range(25)] + [(98, None), (99, "..."), (3, make(12))]
    docs = [(i, make(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"{make(8)}, {items[i][1]}. {make(5)}".upper()) for i in range(25)] + [(200 + i, t) for i, t in enumerate(EDGE)]
    _check_leaks(spark, docs, items)


def test_repetitive_and_long_leaked_texts(spark):
    words_ = [f"w{i % 7}" for i in range(40)]
    long_ = " ".join(f"u{i}" for i in range(3000))
    docs = [(1, "a " * 200), (2, " ".join(words_ * 3)), (3, f"x {long_} y {long_}"), (4, "a a a a a a a a a")]
    _check_leaks(spark, docs, [(1, "a " * 30), (2, " ".join(words_)), (3, long_), (4, "a a a")])


def test_thousands_of_equal_words(spark):
    docs = [(i, "a " * 4000) for i in range(4)] + [(9, "b " + "a " * 4000 + "c")]
    items = [(i, "a " * 50) for i in range(20)] + [(30, "a " * 9 + "b")]
    begun = time.monotonic()
    _check_leaks(spark, docs, items)
    assert time.monotonic() - begun < 60


def test_long_items_only_and_edges(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"x {passage} y"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (3, " ".join(f"w{i}" for i in range(10, 20))), (4, passage.replace("w15", "v")), *((10 + i, t) for i, t in enumerate(EDGE))]
    got = _check_leaks(spark, docs, [(7, passage), (8, passage)])
    assert {r["doc_id"] for r in got.where("contaminated").collect()} == {1, 3, 4}
    frame = docs_of(spark, [t for _, t in docs], [i for i, _ in docs])
    kept = decontamination.drop_contaminated(frame, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert kept.columns == frame.columns and kept.count() == len(docs) - 3
    assert decontamination.contaminated(frame, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    assert decontamination.contaminated(frame.limit(0), spark.createDataFrame([(7, passage)], "item_id long, text string")).count() == 0


# 10


def _near(rows, n=4, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def _check_near(spark, rows):
    out = ngram_join.ngram_components(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == _near(rows)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    passage = list(rng.choice(words, 40))
    for group in range(12):
        base = list(rng.choice(words, int(rng.integers(10, 120))))
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(copy) // 40 + 2)))):
                copy[int(rng.integers(len(copy)))] = "new" + str(rng.integers(1_000_000))
            if group % 3 == 0:
                copy = passage + copy
            rows.append(" ".join(copy))
    rows += EDGE + ["a b c", "A  b\tc", "a b", "\x1ca b c"]
    order = rng.permutation(len(rows))
    _check_near(spark, [(int(i), rows[k]) for k, i in enumerate(order)])


def test_sets_just_under_the_threshold(spark):
    """Each text differs from a common one in three words, so about none link, and nearly all pairs share prefix members."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        copy = list(base)
        for k in rng.choice(200, 3, replace=False):
            copy[k] = f"x{i}_{k}"
        rows.append((i, " ".join(copy)))
    compared = []

    def answers(pairs, *more, **options):
        compared.append(pairs.count())
        return found(pairs, *more, **options)

    found = ngram_join._answers
    with mock.patch.object(ngram_join, "_answers", answers):
        _check_near(spark, rows)
    assert sum(compared) <= 4 * len(rows)  # pairs of whole texts grow with the texts, not with the pairs


def test_components_of_a_chain_and_a_star(spark):
    base = [f"b{i}" for i in range(100)]
    chain = [" ".join(base[k * 3 :] + [f"t{j}" for j in range(k * 3)]) for k in range(12)]
    star = [" ".join([*(f"s{i}" for i in range(100) if i not in (k * 4, k * 4 + 1)), "z"]) for k in range(20)]
    _check_near(spark, [(i * 7 % 64, t) for i, t in enumerate(chain + star)])


def test_one_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [text, text + " x", text, None, "", None], [5, 3, 9, 1, 2, 4])
    kept = ngram_join.drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == docs.columns
    assert ngram_join.drop_near_copies(docs.limit(0)).count() == 0


def test_components_of_links(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: find(i) for i in root}
