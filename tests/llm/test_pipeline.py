"""The pipeline against what its operators find, stage by stage; and the operators' queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import best_fit_packing, registry

from .test_operators import SMALL, TEST, _leaks, _near


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in registry.op3_toxicity(spark, SMALL).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: t for i, t in rows.items() if not scores[i]}
    steps = [set(want)]
    best = {}
    for i, t in want.items():
        best[t] = max(i, best.get(t, i))
    want = {i: t for i, t in want.items() if best[t] == i}
    steps.append(set(want))
    near = _near(list(want.items()))
    want = {i: t for i, t in want.items() if near[i][1] == i}
    steps.append(set(want))
    leaks = _leaks(list(want.items()), items)
    want = {i: t for i, t in want.items() if not leaks[i][-1]}
    steps.append(set(want))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            found = [r["doc_id"] for r in docs.collect()]
            assert len(found) == len(set(found)) and set(found) == steps[k]
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == steps[3]
    packed = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert key(packed) == key(docs)
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > best_fit_packing.CAPACITY)
    assert full.count() == 0


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


BASE = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu one two three four five six seven eight nine ten eleven twelve".split()
NAMES = ("__id", "__h", "__digest", "__best", "gone", "text_hash", "digest", "h", "root", "times")


def _odd_docs(spark):
    """Equal ids with unlike texts, repeated rows, nulls, a very long text, and columns of names that operators use."""
    near, other = " ".join([*BASE[:-1], "thirteen"]), " ".join(reversed(BASE))
    texts = [(3, " ".join(BASE)), (5, near), (5, other), (5, other), (None, near), (None, "what is alone here stays as it is"), (7, None), (8, ""), (9, "long " + " ".join(f"w{i}" for i in range(60_000)))]
    rows = [(i, t, "en", "s", 1, *(f"{k}{c}" for c in NAMES)) for k, (i, t) in enumerate(texts)]
    rows.append(rows[3])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame(rows, schema)


def _kept(df):
    return sorted(((r["doc_id"], (r["text"] or "-")[:20]) for r in df.collect()), key=str)


def test_stages_judge_each_row_by_its_text(spark):
    docs = _odd_docs(spark)
    columns = docs.columns
    every = _kept(docs)
    copies = corpus_pipeline.drop_copies(spark, docs, SMALL)
    near = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    alpha, reverse = "alpha bravo charlie ", " ".join(reversed(BASE))[:20]
    # Of the null and the empty text the row of the larger id stays; the near copy with id 5 and the one with a null id are equal.
    assert _kept(copies) == sorted([(3, alpha), (5, alpha), (5, reverse), (8, "-"), *(r for r in every if r[0] in (9,)), (None, "what is alone here s")], key=str)
    # The near copies are one component, of which the null id counts as the least.
    assert _kept(near) == sorted([(None, alpha), (5, reverse), (7, "-"), (8, "-"), *(r for r in every if r[0] in (9,)), (None, "what is alone here s")], key=str)
    assert copies.columns == near.columns == columns
    bench = spark.createDataFrame([("b1", " ".join(BASE[:14]))], "item_id string, text string")
    from terraloom.llm import decontamination

    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == columns and _kept(clean) == sorted((r for r in every if r[1] != alpha), key=str)
    toxic = corpus_pipeline.reject_toxic(spark, docs, SMALL)
    assert toxic.columns == columns and set(_kept(toxic)) <= set(every) and (7, "-") in _kept(toxic)
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, SMALL).select("doc_id").collect()} == {None, 3, 5, 7, 8, 9}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{TEST}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    found = registry.queries()[name](spark, TEST)
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())
