"""Exact Jaccard join of word n-gram sets, with block skipping and derived answers.

A document's set holds the hashes of its distinct word 4-grams. Equal sets are one from the start. Sets are
ordered by how often their members' hash buckets occur in the corpus, rare first, and each set is listed under the
members of its prefix only: two sets that are similar enough share a prefix member. Entries whose list holds no other
set near enough in size and place are left out, in the shuffle that brings the lists together.

1. *Computed answers.* Each list has a leader, the set that meets most others. Each set is compared with the leaders of its
   largest lists, where sizes and places allow a link; how many members they share is kept.
2. *Block skipping.* Lists whose sets are all connected by then are skipped whole. In the others the entries are grouped in
   blocks by set size and by the member's position; pairs of blocks are skipped when the sizes or the positions
   leave too few members to share, or when all their sets are connected.
3. *Derived answers.* Of two sets whose leader is the same, what each shares with the leader bounds what they share with each
   other from both sides. Where the bounds don't settle whether the pair links, its answer is made from the leader's: the leader's
   size, less the members that either set lacks, plus those that both have besides. A set that shares half of the larger one's members
   or more carries these differences, once made, in place of its text. Only pairs without a common leader are compared as texts.

These steps are the same at all sizes. Comparisons are exact on whole sets of 64-bit hashes of the n-grams (within a pair of sets of
1000 members two n-grams fall together with a chance of 1e-13); sets are equal if their 128-bit digests are. No list, candidate or
partner is capped. Links go to connected components, computed by joins. The order of members, leaders and parts of
lists matter for speed only.

A member that occurs far more often than its bucket's share is dealt out in parts while lists are counted, so no task gets a list of
unbounded length; joins on members are left to Spark's splitting of skewed partitions.

Words are separated by blanks, tabs and line ends; A-Z count as a-z. Null and blank texts have an empty set and no
links; with fewer words than n the sequence is one member. Rows of equal id are judged each by its own text. An empty table gives an empty result. Other columns are carried or ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import batches, cut, cut_table, keep_rows, small_batches, small_side
from terraloom.llm.components import components

NGRAM, PERCENT = 4, 85
#: Counts of members by hash bucket; they order the members. 4 Mi buckets, in 256 parts. What stands out of a bucket's share is a
#: member that occurs more often than a few times the root of that share, so the number of buckets needn't grow as the input does.
SKETCH_BITS, SKETCH_PARTS = 22, 256
REMEMBERED = 200_000
#: Of how many lists each set meets the leaders, and among how many of its first lists these are chosen.
LEADERS, FIRST_LISTS = 3, 12
#: Lists are counted in parts of about so many entries.
LIST_PART = 10_000
#: Sets that a worker keeps while it compares pairs.
KEPT_SETS = 4096
#: What is known of a compared pair.
ANSWER = ["a", "b", "n_a", "n_b", "shared", "only_a", "only_b"]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Hasher:
    """Sets of texts, with the words' hashes remembered up to a bound."""

    def __init__(self, n: int = NGRAM):
        self.n, self.known = n, _WordHashes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the sorted distinct hashes of its word n-grams."""
        lists = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = _WordHashes()
        counts = list(map(len, lists))
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.uint64, sum(counts))
        # The n-grams of all texts in one go; those that reach into the next text are passed over.
        full = np.full(max(0, len(h) - self.n + 1), self.n, np.uint64)
        for k in range(self.n):
            full = _mixed(full, h[k : k + len(full)])
        out, at = [], 0
        for count in counts:
            if count >= self.n:
                members = np.sort(full[at : at + count - self.n + 1])
                out.append(members[np.flatnonzero(np.diff(members, prepend=~members[:1]))])
            else:  # the sequence as a whole
                one = np.full(min(1, count), count, np.uint64)
                for k in range(count):
                    one = _mixed(one, h[at + k : at + k + 1])
                out.append(one)
            at += count
        return out


def _mixed(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    state = (state ^ words) * np.uint64(0x9E3779B97F4A7C15)
    return state ^ (state >> np.uint64(29))


def set_id(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Two sets that are similar enough share one of so many first members."""
    return n - -(-percent * n // 100) + 1


def similar(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _buckets(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _scan(n: int):
    """Rows of the sets (part null), and this task's counts by hash bucket (part set)."""
    names = ["doc_id", "text_hash", "n", "set_id", "part", "counts"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, counts, waiting, any_row = Hasher(n), np.zeros(1 << SKETCH_BITS, np.uint32), [], False

        def count() -> None:
            counts[:] += np.bincount(_buckets(np.concatenate([np.zeros(0, np.uint64), *waiting])), minlength=len(counts)).astype(np.uint32)
            waiting.clear()

        for f in batches(frames):
            found = sets(f["text"].tolist())
            waiting += found
            if sum(map(len, waiting)) > 1 << 20:
                count()
            rows = [(i, h, len(m), set_id(m) if len(m) else None, None, None) for i, h, m in zip(f["doc_id"], f["text_hash"], found, strict=True)]
            any_row = True
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "part": "Int64"})
        if any_row:
            count()
            parts = [(None, None, None, None, i, zlib.compress(c.astype("<u4").tobytes(), 1)) for i, c in enumerate(np.split(counts, SKETCH_PARTS))]
            yield pd.DataFrame(parts, columns=names).astype({c: "Int64" for c in ("doc_id", "text_hash", "n", "part")})

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
    for c in rows["counts"]:
        total += np.frombuffer(zlib.decompress(c), "<u4")
    return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _crowded_buckets(often: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose members' lists are counted in more than one part, and in how many: as their counts stand out of the mean."""
    mean = often.mean()
    most = int(mean + 6 * mean**0.5) + part
    buckets = np.flatnonzero(often >= most)
    return buckets, 1 + (often[buckets].astype(np.int64) - most + part) // part


def _listed(n: int, percent: int, order, part: int):
    """An entry for each prefix member of each distinct set of a task.

    As most entries end in the shuffle, they are narrow: part holds the number of parts and the part, size the set's size and the place, 32 bits each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, often, seen = Hasher(n), order.value, set()
        crowded, times = _crowded_buckets(often, part)
        for f in batches(frames):
            out = []
            for members in sets(f["text"].tolist()):
                if len(members) and (key := set_id(members)) not in seen:
                    seen.add(key)
                    p, bucket = prefix_size(len(members), percent), _buckets(members)
                    first = np.lexsort((members, often[bucket]))[:p]
                    of = np.ones(p, np.int64)
                    if len(crowded):
                        at = np.minimum(np.searchsorted(crowded, bucket[first]), len(crowded) - 1)
                        of = np.where(crowded[at] == bucket[first], times[at], 1)
                    out.append((members[first].view(np.int64), of << 32 | key[0] * 256 % of, [key] * p, len(members) << 32 | np.arange(p)))
            if out:
                columns = dict(zip(("member", "part", "set_id", "size"), zip(*out, strict=True), strict=True))
                yield pd.DataFrame({c: list(chain.from_iterable(v)) if c == "set_id" else np.concatenate(v) for c, v in columns.items()})

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which members of a sorted set another has."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _compared(n: int, differences: bool):
    """How many members the sets of each pair share, and on demand what only a and only b has, where they share half of the larger one or more.

    Sets are kept up to a bound, as many pairs share one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, kept, size = Hasher(n), {}, 0
        for f in batches(frames, 64):
            out = []
            for row in f.itertuples(index=False):
                both = []
                for key, text in ((row.a, row.text_a), (row.b, row.text_b)):
                    if key not in kept:
                        if len(kept) >= KEPT_SETS or size > KEPT_SETS << 10:
                            kept, size = {}, 0
                        (kept[key],) = sets([text])
                        size += len(kept[key])
                    both.append(kept[key])
                common = _common(*both)
                shared = int(common.sum())
                only = [None, None]
                if differences and 2 * shared >= max(map(len, both)):
                    only = [both[0][~common].view(np.int64), both[1][~_common(*both[::-1])].view(np.int64)]
                out.append((row.a, row.b, len(both[0]), len(both[1]), shared, *only))
            yield pd.DataFrame(out, columns=ANSWER)

    return run


def _answers(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, differences: bool = False) -> DataFrame:
    """a, b, n_a, n_b, shared, only_a, only_b of the pairs; nodes tells which document stands for a set, and each pair brings two texts together."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    wanted = cut(nodes.join(wanted, "set_id", "left_semi").withColumnsRenamed({"doc_id": "want_id", "text_hash": "want_hash"}))
    found = docs.join(small_side(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_hash") == F.col("want_hash")))
    texts = found.select("set_id", "text").dropDuplicates(["set_id"])  # both joins read this one shuffle
    ours = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    theirs = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(ours, "a").join(theirs, "b").select("a", "b", "text_a", "text_b")
    return cut_table(joined.mapInPandas(_compared(n, differences), "a binary, b binary, n_a long, n_b long, shared long, only_a array<long>, only_b array<long>"))


def _links(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n_a + n_b - shared)


def _reachable(n_a: Column, place_a: Column, n_b: Column, place_b: Column, percent: int) -> Column:
    """Whether two sets whose first common member has these places can be similar enough, by their sizes and by what follows the places."""
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & ((100 + percent) * F.least(n_a - place_a, n_b - place_b) >= percent * (n_a + n_b))


def _with_partners(entries: DataFrame, percent: int) -> DataFrame:
    """Of each set its entries (place, member, c) that another set of their list can link with, by sizes and places; c is the list's length.

    In a list ordered by size the three entries on each side tell: two by size and place, and whether sizes beyond the
    third are still near enough. A list that is counted in several parts is kept as it is.
    """
    order = Window.partitionBy("member", "part").orderBy("size", "set_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n_of, place_of = (lambda size: F.shiftright(size, 32)), (lambda size: size.bitwiseAND(F.lit(2**32 - 1)))
    # Column by column: a struct of them would be made before the shuffle and go through it.
    at = lambda c, k: F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order)
    beside = {f"{c}_at{k}": at(c, k) for k in (1, 2, 3, -1, -2, -3) for c in ("set_id", "size")}
    seen = entries.withColumns({**beside, "times": F.count("*").over(whole), "lo": F.min("set_id").over(whole), "hi": F.max("set_id").over(whole)})
    parts, n, place = F.shiftright("part", 32), n_of(F.col("size")), place_of(F.col("size"))

    def can_link(k: int) -> Column:
        set_id, size = F.col(f"set_id_at{k}"), F.col(f"size_at{k}")
        near = 100 * F.least(n, n_of(size)) >= percent * F.greatest(n, n_of(size))
        return size.isNotNull() & (near if abs(k) == 3 else _reachable(n, place, n_of(size), place_of(size), percent) & (set_id != F.col("set_id")))

    some = can_link(1)
    for k in (2, 3, -1, -2, -3):
        some = some | can_link(k)
    kept = seen.where((parts > 1) | ((F.col("lo") != F.col("hi")) & some))
    kept = kept.select("set_id", "member", n.alias("n"), place.alias("place"), (F.col("times") * parts).alias("c"))
    return kept.groupBy("set_id").agg(F.first("n").alias("n"), F.collect_set(F.struct("place", "member", "c")).alias("entries"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leader_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Each set with the leaders of its LEADERS largest lists, of the first few that it has, where sizes and places allow a link."""
    meets = F.aggregate("entries", F.lit(0).cast("long"), lambda total, e: total + e["c"])
    scored = held.select("set_id", "n", meets.alias("meets"), F.inline(F.slice(F.array_sort("entries"), 1, FIRST_LISTS)))
    leaders = scored.groupBy("member").agg(F.max_by(F.struct("set_id", "n", "place"), F.struct("meets", "set_id")).alias("leader"))
    near = (F.col("set_id") != F.col("leader.set_id")) & _reachable(F.col("n"), F.col("place"), F.col("leader.n"), F.col("leader.place"), percent)
    met = scored.join(leaders, "member").where(near).groupBy("set_id", F.col("leader.set_id").alias("leader")).agg(F.max("c").alias("c"))
    nth = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("c"), "leader"))
    return met.withColumn("nth", nth).where(F.col("nth") <= LEADERS).select(*_pair("set_id", "leader")).distinct()


def _nearest(answers: DataFrame) -> DataFrame:
    """Of each set that was compared, the set that it shares most with (itself, for a leader of others): set_id, near, near_n, near_shared, and the members
    that it lacks of near's and those that it has besides (null if they differ in too many)."""
    of = lambda x, y: F.struct(F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"), "shared", F.col(f"only_{y}").alias("lacks"), F.col(f"only_{x}").alias("besides"))
    sides = [answers.select(F.col(x).alias("set_id"), F.col(f"n_{x}").alias("own_n"), of(x, y).alias("answer")) for x, y in ("ab", "ba")]
    both = sides[0].unionByName(sides[1])
    # A set that several others were compared with answers for itself.
    best = both.groupBy("set_id").agg(F.max_by("answer", F.struct("answer.shared", "answer.near")).alias("best"), F.count("*").alias("times"), F.max("own_n").alias("own_n"))
    own, none = F.col("times") > LEADERS, F.array().cast("array<long>")
    return best.select(
        "set_id",
        F.when(own, F.col("set_id")).otherwise(F.col("best.near")).alias("near"),
        F.when(own, F.col("own_n")).otherwise(F.col("best.near_n")).alias("near_n"),
        F.when(own, F.col("own_n")).otherwise(F.col("best.shared")).alias("near_shared"),
        F.when(own, none).otherwise(F.col("best.lacks")).alias("lacks"),
        F.when(own, none).otherwise(F.col("best.besides")).alias("besides"),
    )


def _open_pairs(held: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets (a, b, with sizes n_a, n_b) that aren't connected yet and share a prefix member, after skipping lists and blocks."""
    # One row a set brings its root to all its entries.
    named = held.join(small_side(roots, roots.count()), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = named.select("set_id", "n", "root", F.inline("entries")).drop("c")
    still = named.groupBy("member").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("member")
    open_ = cut_table(named.join(still, "member", "left_semi"))
    blocks = open_.groupBy("member", "n", "place").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    side = lambda s: blocks.select("member", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "place", "lo", "hi")))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("place_a") <= F.col("place_b")))
    can_link = (
        ordered
        & _reachable(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"), percent)
        & ~((F.col("lo_a") == F.col("hi_b")) & (F.col("hi_a") == F.col("lo_b")))
    )
    pairs_of_blocks = side("a").join(side("b"), "member").where(can_link).select("member", "n_a", "place_a", "n_b", "place_b")
    entry = lambda s: open_.select("member", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "place", "set_id", "root")))
    met = pairs_of_blocks.join(entry("a"), ["member", "n_a", "place_a"]).join(entry("b"), ["member", "n_b", "place_b"]).where(F.col("root_a") != F.col("root_b"))
    is_less = F.col("set_id_a") < F.col("set_id_b")
    sized = [F.when(is_less, F.col(f"n_{x}")).otherwise(F.col(f"n_{y}")).alias(f"n_{x}") for x, y in ("ab", "ba")]
    return met.select(*_pair("set_id_a", "set_id_b"), *sized).distinct()


def _derived(pairs: DataFrame, nearest: DataFrame, percent: int) -> DataFrame:
    """pairs plus the boolean derived: whether they link where the answers of the set that is nearest to both tell it, else null."""
    side = lambda s, *names: nearest.select(F.col("set_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in names))
    numbers = ("near", "near_n", "near_shared")
    both = pairs.join(side("a", *numbers), "a", "left").join(side("b", *numbers), "b", "left")
    same = F.coalesce(F.col("near_a") == F.col("near_b"), F.lit(False))
    # Of what both share with the nearest set at least the overlap is common; beyond it, at most what each has besides.
    less = F.col("near_shared_a") + F.col("near_shared_b") - F.col("near_n_a")
    more = F.least("near_shared_a", "near_shared_b") + F.least(F.col("n_a") - F.col("near_shared_a"), F.col("n_b") - F.col("near_shared_b"))
    links = lambda shared: _links(shared, F.col("n_a"), F.col("n_b"), percent)
    bounded = both.withColumns({"same": same, "derived": F.when(same & links(less), True).when(same & ~links(more), False)})
    bounded = cut_table(bounded.select("a", "b", "n_a", "n_b", F.col("near_n_a").alias("near_n"), "same", "derived"))
    # What the bounds leave open is told exactly by the differences from the nearest set.
    tight = bounded.where(F.col("same") & F.col("derived").isNull()).join(side("a", "lacks", "besides"), "a").join(side("b", "lacks", "besides"), "b")
    shared = F.col("near_n") - F.size(F.array_union("lacks_a", "lacks_b")) + F.size(F.array_intersect("besides_a", "besides_b"))
    known = F.col("lacks_a").isNotNull() & F.col("lacks_b").isNotNull()
    tight = tight.select("a", "b", F.when(known, links(shared)).alias("derived"))
    rest = bounded.where(~F.col("same") | F.col("derived").isNotNull())
    return rest.select("a", "b", "derived").unionByName(tight)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, percent: int = PERCENT, list_part: int = LIST_PART) -> DataFrame:
    """One row per input row: doc_id, text_hash (xxhash64 of the text), n_shingles, set_id, root (of linked sets), component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scanned = cut_table(rows.mapInPandas(_scan(n), "doc_id long, text_hash long, n long, set_id binary, part long, counts binary"))
    sums = scanned.where(F.col("part").isNotNull()).select("part", "counts").groupBy("part").applyInPandas(_summed, "part long, counts binary")
    width = (1 << SKETCH_BITS) // SKETCH_PARTS
    often = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in sums.toLocalIterator():  # 256 rows of 64 kB, whatever the input
        often[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.uint32)
    members = scanned.where(F.col("part").isNull()).select("doc_id", "text_hash", "n", "set_id")
    # One row per distinct set: the row with the least id stands for it.
    nodes = members.where(F.col("n") > 0).groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("set_id", "one.doc_id", "one.text_hash")
    nodes = cut(nodes)

    entry = "member long, part long, set_id binary, size long"
    entries = rows.select("text").mapInPandas(_listed(n, percent, spark.sparkContext.broadcast(often), list_part), entry)
    held = cut_table(_with_partners(entries, percent))

    answers = _answers(cut(_leader_pairs(held, percent)), nodes, rows, n, differences=True)
    found = answers.where(_links(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    roots = cut(components(found)).withColumnsRenamed({"node": "set_id"})

    open_pairs = cut(_open_pairs(held, roots, percent).join(answers.select("a", "b"), ["a", "b"], "left_anti"))
    open_pairs = cut(_derived(open_pairs, cut_table(_nearest(answers)), percent))
    more = _answers(open_pairs.where(F.col("derived").isNull()).select("a", "b"), nodes, rows, n)
    more = more.where(_links(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    links = found.unionByName(more).unionByName(open_pairs.where("derived").select("a", "b"))
    roots = cut(components(links)).withColumnsRenamed({"node": "set_id"})
    return _by_id(members, nodes, roots)


def _by_id(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """members plus root and component_id: the least id among all rows of the root's component; a row with an empty set has its own id."""
    placed = nodes.select("set_id", F.col("doc_id").alias("least")).join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = placed.join(roots, "set_id", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root", "left").select("set_id", "root", F.coalesce("component_id", "least").alias("component_id"))
    out = members.join(placed, "set_id", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_id", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that with the least id, and of equal ids with the least hash of its text. Columns as before.

    A null id counts as less than all others. Rows with an empty set all stay; of rows repeated in id and text one stays.
    """
    found = cut(ngram_components(docs, id_col, text_col, n, percent).where(F.col("root").isNotNull()).select("root", "doc_id", "text_hash"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    times = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    named = times.join(first, "root").select("doc_id", "text_hash", "times", (~F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).alias("gone"))
    return keep_rows(docs, named.where(F.col("gone") | (F.col("times") > 1)), id_col, text_col)
