"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides are cut into words; each run of k words is hashed, and of each window of hashes the least is kept as a
fingerprint. With k = 5 and windows of 6 hashes, any 10 words that a document and an item share contain a
fingerprint that both keep, so no shared span of 10 words can be missed. Fingerprints are joined; each hit is then
extended word by word to both sides and counts if the equal words are 10 or more. Items of fewer words are one
window each; their hash is looked for among all runs of that length, for the few lengths that occur.

Equal surroundings of a fingerprint are compared once, however many places, documents and items have them, so texts that repeat a
few words take no longer than others. The benchmark side is broadcast only if its counted fingerprints are within a bound, and
else joined by a shuffle.

Null and empty texts have no words. Items without words match nothing. Repeated rows are judged each; rows that are
equal in id and text get equal results. An empty documents table gives an empty result, an empty benchmark
gives no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import ascii_lower, cut, keep_rows, small_side, text_key

SPAN, RUN = 10, 5
WINDOW = SPAN - RUN + 1
# Fixed value: what separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(hashes: Column, length: int) -> Column:
    """The hash of each run of so many words, from the words' hashes."""
    runs = F.sequence(F.lit(0), F.size(hashes) - length)
    hashed = F.transform(runs, lambda i: F.xxhash64(F.lit(length), *(F.get(hashes, i + j) for j in range(length))))
    return F.when(F.size(hashes) >= length, hashed).otherwise(F.array().cast("array<long>"))


def _places(runs: Column) -> Column:
    """Each run as (hash, at)."""
    return F.transform(runs, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))


def _winnowed(hashes: Column) -> Column:
    """The runs (hash, at) that hold the least hash of a window that they lie in."""

    def least(runs: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(runs) - WINDOW)
        mins = F.transform(at, lambda i: F.least(*(F.get(runs, i + j) for j in range(WINDOW))))

        def kept(mins: Column) -> Column:
            def is_least(p: Column) -> Column:
                some = F.get(mins, p["at"]) == p["hash"]
                for j in range(1, WINDOW):  # windows that start before it; outside the text they are null
                    some = some | (F.get(mins, p["at"] - j) == p["hash"])
                return some

            return F.filter(_places(runs), is_least)

        return F.when(F.size(runs) >= WINDOW, _let(mins, kept)).otherwise(F.filter(_places(runs), lambda _: F.lit(False)))

    return _let(_runs(hashes, RUN), least)


def _hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _fingerprints(words_: Column, short: list[int]) -> Column:
    """All that a document can be hit by, as (hash, at): winnowed hashes, and the runs of the short items' lengths."""
    return _let(_hashes(words_), lambda hashes: F.concat(_winnowed(hashes), *(_places(_runs(hashes, n)) for n in short)))


def _anchor(words_: Column, at: Column, hash_: Column) -> Column:
    """A place with its hash, the words before it (nearest first) and those from it on."""
    first = F.greatest(at - (SPAN - RUN), F.lit(0))
    return F.struct(
        hash_.alias("hash"),
        at.alias("at"),
        F.reverse(F.slice(words_, first + 1, at - first)).alias("before"),
        F.slice(words_, at + 1, F.lit(SPAN)).alias("after"),
    )


def _anchors(words_: Column, places: Column) -> Column:
    """The anchors of places (hash, at)."""
    return F.transform(places, lambda p: _anchor(words_, p["at"], p["hash"]))


def _equal_start(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return _let(same, lambda s: F.when(F.array_position(s, False) == 0, F.size(s)).otherwise(F.array_position(s, False) - 1)).cast("int")


def item_anchors(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """hash, before, after, need of every item's fingerprints, each with the ids (as strings) of the items that have it; and the lengths of the short items."""
    items = cut(benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0))
    size = F.size("words")
    short = sorted(r["n"] for r in items.where(size < SPAN).select(size.alias("n")).distinct().collect())  # 9 at most
    full = items.where(size >= SPAN)
    kept = full.select("item_id", F.lit(SPAN).alias("need"), F.inline(_anchors(F.col("words"), _winnowed(_hashes(F.col("words"))))))
    parts = [kept]
    for n in short:
        whole = _runs(_hashes(F.col("words")), n)
        one = items.where(size == n).select(
            "item_id",
            F.lit(n).alias("need"),
            F.explode(whole).alias("hash"),
            F.lit(0).alias("at"),
            F.array().cast("array<string>").alias("before"),
            F.col("words").alias("after"),
        )
        parts.append(one)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    same = out.groupBy("hash", "before", "after", "need").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return cut(same), short


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text_hash: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    anchors, short = item_anchors(benchmark)
    wanted = anchors.select("hash").distinct()
    n_wanted = wanted.count()
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_hash"), words(text).alias("words"))
    prints = keyed.select("doc_id", "text_hash", F.inline(_fingerprints(F.col("words"), short)))
    hits = prints.join(small_side(wanted, n_wanted), "hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("hash", "at")).alias("places"))
    hits = cut(hits)
    side = small_side(hits, hits.count()).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    joined = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    rows = cut(
        joined.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.when(F.col("places").isNotNull(), _anchors(F.col("words"), F.col("places"))).alias("anchors"))
    )
    anchored = rows.where(F.col("anchors").isNotNull()).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline("anchors"))
    theirs = small_side(anchors, n_wanted if n_wanted == 0 else anchors.count()).withColumnsRenamed({"before": "item_before", "after": "item_after"})
    # All matches of a surrounding hold its place, so together they cover from the farthest left to the farthest right.
    around = ["hash", "before", "after"]
    met = anchored.select(*around).distinct().join(theirs, "hash")
    met = met.withColumns({"left": _equal_start(F.col("before"), F.col("item_before")), "right": _equal_start(F.col("after"), F.col("item_after"))})
    met = met.where(F.col("left") + F.col("right") >= F.col("need"))
    met = cut(met.groupBy(*around).agg(F.max("left").alias("left"), F.max("right").alias("right"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    spans = anchored.join(small_side(met, met.count()), around)
    spans = cut(spans.select("doc_id", "text_hash", "items", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right") - 1).alias("last")))
    covered = spans.select("doc_id", "text_hash", "first", "last").distinct().select("doc_id", "text_hash", F.explode(F.sequence("first", "last")).alias("place"))
    n_hit = covered.distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    named = spans.select("doc_id", "text_hash", "items").distinct().select("doc_id", "text_hash", F.explode("items").alias("item"))
    items = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = n_hit.join(items, n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["text_hash"] == items["text_hash"])).select(
        n_hit["doc_id"].alias("hit_id"), n_hit["text_hash"].alias("hit_hash"), "n_hit", "items"
    )
    out = rows.select("doc_id", "text_hash", "n_words").join(result, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        *(["text_hash"] if with_text_hash else []),
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that share a window with the benchmark; columns as before. Each row is judged by its own text."""
    bad = contaminated(docs, benchmark, id_col, text_col, with_text_hash=True).where("contaminated").select("doc_id", "text_hash", F.lit(True).alias("gone")).distinct()
    return keep_rows(docs, bad, id_col, text_col)
