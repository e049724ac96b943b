"""How far the sources of a language differ in their use of terms, with a minimal acyclic transducer as vocabulary.

Each language keeps the terms that occur in enough of its documents. The kept terms are sorted; of each run of them a
minimal acyclic transducer is built, term by term, whose arcs carry counts, so that reading a term adds up to its
place in the sorted order, its ordinal. The texts are then read once more through the transducers, which recounts the kept
terms by ordinal; ties between terms are broken by ordinal too, and ordinals are turned back into terms at the end.

The vocabulary is never in one place: Spark sorts it by range, every task cuts its range into runs of SEGMENT_TERMS terms,
and each run has a transducer of its own (minimal for its run). For recounting, runs are broadcast in blocks of BLOCK_BYTES at
most, and the texts are read once for each block, so memory is bounded whatever the vocabulary's size, and none of it is left
out. The driver holds a few numbers for each run and one block. Sources are compared over chunks of ordinals and tiles of
sources; each chunk gives one row for each pair of sources.

With p the share of a term in a group (scaled, add-one) and q that of another, the divergence is the sum of
floor((p - q)^2 / q). Null texts, languages and sources count as ''. Groups without terms take part with counts of 0, and
languages without kept terms give 0 for each pair. Repeated rows count each. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import cut_table, small_batches, small_side
from terraloom.llm.terms import byte_parts, cut_terms, slices, whole

#: A term is kept if so many documents of the language have it.
LEAST_DOCUMENTS = 3
ONE = 1_000_000_000
TOP = 200
#: Terms of one transducer, and bytes of the transducers that are broadcast at once.
SEGMENT_TERMS, BLOCK_BYTES = 1 << 16, 96 << 20
#: Sources and terms that are compared in one group of rows.
TILE, CHUNK = 128, 1 << 13


class Transducer:
    """A minimal acyclic transducer, built from sorted terms: term to ordinal and back.

    States are closed as soon as no later term can pass them; equal ones (the same ending, the same arcs) are made once.
    An arc's output is the number of terms that come before those behind it, among those of its state.
    """

    def __init__(self) -> None:
        self._known: dict[tuple, int] = {}
        self._ends: list[bool] = []
        self._terms: list[int] = []  # of each state: how many terms it leads to
        self._arcs: list[tuple[int, int, int]] = []  # state * 256 + byte, target, output
        self._open: list[list] = [[False]]  # the states of the last term: ending, then byte and target by turns
        self._last = b""
        self.n = 0

    def add(self, term: bytes) -> None:
        """The next term; it must come after the last one."""
        self._close(len(os.path.commonprefix((term, self._last))))
        self._open += [[False] for _ in range(len(term) + 1 - len(self._open))]
        self._open[-1][0] = True
        self._last = term
        self.n += 1

    def _close(self, depth: int) -> None:
        while len(self._open) - 1 > depth:
            state = self._made(tuple(self._open.pop()))
            self._open[-1] += (self._last[len(self._open) - 1], state)

    def _made(self, state: tuple) -> int:
        number = self._known.get(state)
        if number is None:
            number = self._known[state] = len(self._ends)
            before = int(state[0])
            for byte, target in zip(state[1::2], state[2::2], strict=True):
                self._arcs.append((number * 256 + byte, target, before))
                before += self._terms[target]
            self._ends.append(state[0])
            self._terms.append(before)
        return number

    def done(self) -> dict[str, np.ndarray]:
        """Arcs in order (key, target, output), the states that end a term; the last state is the root."""
        self._close(0)
        self._made(tuple(self._open.pop()))
        arcs = np.array(self._arcs, np.int64).reshape(-1, 3)
        return {"key": arcs[:, 0], "target": arcs[:, 1].astype(np.int32), "output": arcs[:, 2].astype(np.int32), "ends": np.array(self._ends, bool)}


PARTS = {"key": np.int64, "target": np.int32, "output": np.int32, "ends": bool}
SEGMENT = "lang string, first binary, last binary, n long, bytes long, " + ", ".join(f"{c} binary" for c in PARTS)


def segments(kept: DataFrame, most: int = SEGMENT_TERMS) -> DataFrame:
    """The transducers of sorted runs of kept (lang, term): lang, first and last term, n, and the parts as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Transducer | None = None
        lang = first = last = None

        def row() -> pa.RecordBatch:
            parts = {k: v.tobytes() for k, v in made.done().items()}
            fields = {"lang": lang, "first": first, "last": last, "n": made.n, "bytes": sum(map(len, parts.values())), **parts}
            return pa.RecordBatch.from_pylist([fields], schema)

        for batch in batches:
            for own, term in zip(batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist(), strict=True):
                if made and (own != lang or made.n >= most):
                    yield row()
                    made = None
                if made is None:
                    made, lang, first = Transducer(), own, term
                made.add(term)
                last = term
        if made:
            yield row()

    kinds = {"lang": pa.string(), "n": pa.int64(), "bytes": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in SEGMENT.split(", ")])
    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(build, SEGMENT)


def _start(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first eight bytes of each term as a number, so that numbers are ordered as terms are."""
    at, length = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        has = length > k
        out[has] |= data[at[has] + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


class Vocabulary:
    """Several transducers side by side, for reading many terms at once. All of it is arrays."""

    def __init__(self, rows: list[dict]) -> None:
        """rows: segments with base (the ordinal of their first term), in order of lang and first term."""
        parts = [{k: np.frombuffer(r[k], kind) for k, kind in PARTS.items()} for r in rows]
        sizes = np.array([len(p["ends"]) for p in parts], np.int64)
        at = np.cumsum(sizes) - sizes
        self.key = np.concatenate([p["key"] + a * 256 for p, a in zip(parts, at, strict=True)])
        self.target = np.concatenate([p["target"] + a for p, a in zip(parts, at, strict=True)]).astype(np.int32)
        self.output = np.concatenate([p["output"] for p in parts])
        self.ends = np.concatenate([p["ends"] for p in parts])
        self.root = at + sizes - 1
        self.base = np.array([r["base"] for r in rows], np.int64)
        self.lang = {}  # the segments of each language, from and to
        for i, r in enumerate(rows):
            self.lang[r["lang"]] = (self.lang.get(r["lang"], (i,))[0], i + 1)
        start = lambda name: _start(*byte_parts(pa.array([r[name] for r in rows], pa.large_binary())))
        self.first, self.last = start("first"), start("last")

    def ordinals(self, terms: pa.Array, langs: np.ndarray) -> np.ndarray:
        """The ordinal of each term in its language's vocabulary, -1 where it isn't in these transducers."""
        data, offsets = byte_parts(terms)
        start = _start(data, offsets)
        low, high = np.zeros(len(terms), np.int64), np.full(len(terms), -1, np.int64)
        for lang in pd.unique(langs):
            if lang in self.lang:
                (a, b), own = self.lang[lang], np.flatnonzero(langs == lang)
                low[own] = a + np.searchsorted(self.last[a:b], start[own], "left")
                high[own] = a + np.searchsorted(self.first[a:b], start[own], "right") - 1
        out = np.full(len(terms), -1, np.int64)
        todo = np.flatnonzero(low <= high)
        while len(todo):  # terms of equal start may be in several segments; nearly always it is one
            found = self._read(data, offsets, todo, low[todo])
            out[todo] = found
            low[todo] += 1
            todo = todo[(found < 0) & (low[todo] <= high[todo])]
        return out

    def _read(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """All terms are read at once, byte by byte."""
        out = np.full(len(rows), -1, np.int64)
        at, length = offsets[rows], (offsets[rows + 1] - offsets[rows])
        here, state, value = np.arange(len(rows)), self.root[segment], self.base[segment].copy()
        depth = 0
        while len(here):
            over = length[here] == depth
            ended = over & self.ends[state]
            out[here[ended]] = value[ended]
            here, state, value = here[~over], state[~over], value[~over]
            key = state * 256 + data[at[here] + depth]
            arc = np.searchsorted(self.key, key)
            arc[arc == len(self.key)] = 0
            met = self.key[arc] == key if len(self.key) else np.zeros(len(key), bool)
            here, arc = here[met], arc[met]
            state, value = self.target[arc].astype(np.int64), value[met] + self.output[arc]
            depth += 1
        return out


def term_of(parts: dict[str, np.ndarray], ordinal: int) -> bytes:
    """The term with an ordinal of one transducer."""
    state, out = len(parts["ends"]) - 1, bytearray()
    while True:
        if ordinal == 0 and parts["ends"][state]:
            return bytes(out)
        a, b = np.searchsorted(parts["key"], (state * 256, state * 256 + 256))
        arc = a + int(np.searchsorted(parts["output"][a:b], ordinal, "right")) - 1
        ordinal -= int(parts["output"][arc])
        out.append(int(parts["key"][arc]) & 255)
        state = int(parts["target"][arc])


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n: how many documents (lang, text) of the language have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            terms, code, row = cut_terms(whole(rows, "text"))
            langs = whole(rows, "lang").dictionary_encode()
            each = np.unique(row * max(len(terms), 1) + code)
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[each // max(len(terms), 1)]
            keys, n = np.unique(lang * max(len(terms), 1) + each % max(len(terms), 1), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(keys // max(len(terms), 1))), terms.take(pa.array(keys % max(len(terms), 1))).cast(pa.large_string()), pa.array(n)], ["lang", "term", "n"]
            )

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def recount(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """lang, source, ordinal, n: occurrences of the vocabulary's terms in docs (lang, source, text), not yet added up."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            terms, code, row = cut_terms(whole(rows, "text"))
            size = max(len(terms), 1)
            langs, sources = whole(rows, "lang").dictionary_encode(), whole(rows, "source").dictionary_encode()
            lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (langs, sources))
            names = np.array(langs.dictionary.to_pylist(), object)
            # Each term of each language is read once, whatever its occurrences.
            pairs, back = np.unique(lang[row] * size + code, return_inverse=True)
            ordinal = shared.value.ordinals(terms.take(pa.array(pairs % size)), names[pairs // size] if len(pairs) else names[:0])
            known = ordinal[back] >= 0
            group, place = source[row[known]], back[known]
            keys, n = np.unique(group * max(len(pairs), 1) + place, return_counts=True)
            at = keys % max(len(pairs), 1)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(pairs[at] // size)), sources.dictionary.take(pa.array(keys // max(len(pairs), 1))), pa.array(ordinal[at]), pa.array(n)], ["lang", "source", "ordinal", "n"]
            )

    return docs.mapInArrow(run, "lang string, source string, ordinal long, n long")


def _blocks(runs: list[dict], most: int) -> Iterator[list[dict]]:
    """Consecutive segments of at most so many bytes; a larger one is a block of its own."""
    held: list[dict] = []
    for r in runs:
        if held and sum(x["bytes"] for x in held) + r["bytes"] > most:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def vocabulary_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS, segment: int = SEGMENT_TERMS, block: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms (lang, source, ordinal, n), and the segments with their base."""
    spark = docs.sparkSession
    kept = document_counts(docs).where(F.col("n") >= least)
    built = cut_table(segments(kept, segment).withColumn("run", F.monotonically_increasing_id()))
    # A few numbers for each run of SEGMENT_TERMS terms.
    runs = sorted((r.asDict() for r in built.select("run", "lang", "first", "last", "n", "bytes").collect()), key=lambda r: (r["lang"].encode(), bytes(r["first"])))
    before: dict[str, int] = {}
    for r in runs:
        r["base"] = before.get(r["lang"], 0)
        before[r["lang"]] = r["base"] + r["n"]
    parts = []
    for held in _blocks(runs, block):
        blobs = {r["run"]: r for r in built.where(F.col("run").isin([r["run"] for r in held])).select("run", *PARTS).collect()}
        rows = [r | {k: bytes(blobs[r["run"]][k]) for k in PARTS} for r in held]
        parts.append(cut_table(recount(docs, Vocabulary(rows)).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))
    empty = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    bases = spark.createDataFrame([(r["run"], r["base"]) for r in runs], "run long, base long")
    return reduce(DataFrame.unionByName, parts, empty), built.join(F.broadcast(bases), "run")  # bases: a row for each run


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (count + 1) / (total + kept)), exactly."""
    scaled = F.lit(ONE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", scaled, (total + kept).cast("decimal(20,0)")) + F.lit(1)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: pandas' own string columns may be chunked, which Spark's Arrow writer doesn't take."""
    return frame.astype({c: object for c in ("lang", "source", "item", "term") if c in frame})


def _pair_sums(frame: pd.DataFrame, chunk_terms: int) -> pd.DataFrame:
    """For every two sources of a group of rows (source, ordinal, p; ordinal -1 gives the p of a count of 0) the summed divergence."""
    s, sources = pd.factorize(frame["source"])
    ordinals = frame["ordinal"].to_numpy(np.int64)
    p, none = frame["p"].to_numpy(np.int64), ordinals < 0
    zero = np.zeros(len(sources), np.int64)
    zero[s[none]] = p[none]
    seen, at = np.unique(ordinals[~none], return_inverse=True)
    table = np.repeat(zero[:, None], len(seen) + 1, axis=1)  # the last column stands for all terms that none of them has
    table[s[~none], at] = p[~none]
    times = np.ones(len(seen) + 1, np.int64)
    times[-1] = chunk_terms - len(seen)
    out = np.zeros((len(sources), len(sources)), np.int64)
    for i, own in enumerate(table):
        step = own - table
        step *= step
        step //= table
        out[i] = step @ times
    a, b = np.indices(out.shape)
    return pd.DataFrame({"source": np.asarray(sources)[a.ravel()], "item": np.asarray(sources)[b.ravel()], "value": out.ravel()})


def pair_values(counts: DataFrame, groups: DataFrame, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    counts: lang, source, ordinal, p; groups: lang, source, kept (terms of the language), p_none (p of a count of 0).
    Sources fall into tiles by hash and terms into chunks by ordinal; each pair of tiles is compared chunk by chunk.
    """
    sized = groups.withColumn("tiles", F.ceil(F.count("*").over(Window.partitionBy("lang")) / F.lit(tile)).cast("int"))
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    chunks = F.sequence(F.lit(0), F.call_function("div", F.col("kept") - 1, F.lit(chunk)).cast("int"))
    none = sized.where(F.col("kept") > 0).select("lang", "source", "tile", "tiles", "kept", F.explode(chunks).alias("chunk"), F.lit(-1).cast("long").alias("ordinal"), F.col("p_none").alias("p"))
    tiles = sized.select("lang", "source", "tile", "tiles", "kept")
    placed = counts.join(small_side(tiles, groups.count()), ["lang", "source"])
    placed = placed.select("lang", "source", "tile", "tiles", "kept", F.call_function("div", F.col("ordinal"), F.lit(chunk)).cast("int").alias("chunk"), "ordinal", "p")
    rows = none.unionByName(placed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame.iloc[0]
        out = _pair_sums(frame, int(min(chunk, at["kept"] - at["chunk"] * chunk)))
        tile_of = dict(zip(frame["source"], frame["tile"], strict=True))
        a, b = out["source"].map(tile_of), out["item"].map(tile_of)
        # Two sources of one tile are compared where the tile meets itself only.
        out = out[((a != b) | (at["low"] == at["high"])) & (out["source"] != out["item"])]
        return _plain(out.assign(lang=at["lang"])[["lang", "source", "item", "value"]])

    parts = rows.groupBy("lang", "low", "high", "chunk").applyInPandas(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms_of(wanted: DataFrame, based: DataFrame) -> DataFrame:
    """wanted (with lang and ordinal) plus term, read backwards from the transducers."""
    runs = based.select("lang", "run", "base", (F.col("base") + F.col("n")).alias("end"))  # a row for each run
    ordinals = wanted.select("lang", "ordinal").distinct()
    placed = ordinals.join(F.broadcast(runs), "lang").where((F.col("ordinal") >= F.col("base")) & (F.col("ordinal") < F.col("end"))).select(F.col("run").alias("own_run"), "lang", "ordinal")

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or own.empty:
            return _plain(pd.DataFrame({"lang": [], "ordinal": [], "term": []})).astype({"ordinal": "int64"})
        parts = {k: np.frombuffer(own[k].iloc[0], kind) for k, kind in PARTS.items()}
        base = int(own["base"].iloc[0])
        return _plain(pd.DataFrame({"lang": asked["lang"], "ordinal": asked["ordinal"], "term": [term_of(parts, int(o) - base).decode() for o in asked["ordinal"]]}))

    named = placed.groupBy("own_run").cogroup(based.select("run", "base", *PARTS).groupBy("run")).applyInPandas(run, "lang string, ordinal long, term string")
    return wanted.join(named, ["lang", "ordinal"])


def audit(
    documents: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    segment: int = SEGMENT_TERMS, block: int = BLOCK_BYTES, tile: int = TILE, chunk: int = CHUNK,
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part "pair" ranks the other sources of the language by divergence, part "term" the terms that the source has more often
    than the language does, to the rank top.
    """
    small_batches(documents.sparkSession)
    clean = lambda name: F.coalesce(F.col(name), F.lit(""))
    docs = documents.select(clean(lang_col).alias("lang"), clean(source_col).alias("source"), clean(text_col).alias("text"))
    counted, based = vocabulary_counts(docs, least, segment, block)
    kept = based.groupBy("lang").agg(F.sum("n").alias("kept"))
    used = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    in_lang = F.sum("total").over(Window.partitionBy("lang"))
    groups = cut_table(groups.withColumn("lang_total", in_lang))
    n_groups = groups.count()
    shared = small_side(groups, n_groups)
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    counts = counted.join(shared, ["lang", "source"]).select("lang", "source", "ordinal", "n", p.alias("p"), "lang_total", "kept")

    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1))))
    values = pair_values(counts.select("lang", "source", "ordinal", "p"), groups.select("lang", "source", "kept", none.alias("p_none")), tile, chunk)
    names = groups.select("lang", "source")
    both = names.join(small_side(names.withColumnRenamed("source", "item"), n_groups), "lang").where(F.col("source") != F.col("item"))
    pairs = both.join(values, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), *order)))
    pairs = ranked(pairs, "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    q = share(F.sum("n").over(Window.partitionBy("lang", "ordinal")), F.col("lang_total"), F.col("kept"))
    above = counts.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang", "source", "ordinal", _distance(F.col("p"), F.col("q")).alias("value"))
    best = cut_table(ranked(above, "ordinal").where(F.col("rank") <= top))
    terms = terms_of(best, based).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
