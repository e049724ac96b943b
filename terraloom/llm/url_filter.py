"""URL filter: rules first, then the ratio of two character language models, with DataFrame functions only.

Rules name a host (with all its subdomains) and the start of a path; the longest that fits decides. URLs that no
rule decides are judged by two smoothed variable-order Markov models, one of the URLs that rules accept and one of
those they reject. In a model the probability of a character after its last k characters is
(n(context, c) + m * P(c | shorter context)) / (n(context) + m), down to a uniform start. The score of a URL is the
mean over its characters of the difference of the log-probabilities; the threshold is calibrated on rule-decided
URLs that the models didn't count.

What a character adds depends on its gram of order + 1 characters alone, so it is computed once for each distinct
gram and joined to the grams of each URL.

Null URLs count as empty: no host, no path, and the gram of the end mark alone. Repeated rows are scored once and
returned as often as they occur. An empty table gives an empty result; without accepted or rejected URLs all scores
are 0 and the verdict is allow. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import BROADCAST_ROWS, cut

ORDER = 4
SMOOTHING = 4.0
ALPHABET = 256.0
#: Rule-decided URLs whose MD5 starts with one of these calibrate the threshold; the models don't count them.
HELD_OUT = ("0", "1", "2")
START, END = "\u0002", "\u0003"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules to apply.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _decided(host: Column, path: Column, rules: tuple[Rule, ...], by) -> Column:
    """by(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, by(rule)).otherwise(out)
    return out


def _grams(url: Column, order: int) -> Column:
    padded = F.concat(F.lit(START * order), url, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(url) + 1), lambda i: F.substring(padded, i, order + 1))


def gram_ratios(grams: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """gram and ratio, from distinct grams with their counts n_good and n_bad in the two sets.

    Each level sums the counts of the next longer grams; the probabilities are then built from the shortest on.
    """
    levels = {order: grams.select("gram", "n_good", "n_bad")}
    for k in range(order - 1, -1, -1):
        shorter = levels[k + 1].select(F.substring("gram", 2, k + 1).alias("gram"), "n_good", "n_bad")
        levels[k] = shorter.groupBy("gram").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))
    smooth = lambda n, total, p: (F.col(n) + F.lit(smoothing) * p) / (F.col(total) + F.lit(smoothing))
    known = None
    for k in range(order + 1):
        level = levels[k].withColumn("context", F.substring("gram", 1, k) if k else F.lit(""))
        contexts = level.groupBy("context").agg(F.sum("n_good").alias("all_good"), F.sum("n_bad").alias("all_bad"))
        level = level.join(contexts, "context")
        if known is None:
            level = level.withColumns({"q_good": F.lit(1 / ALPHABET), "q_bad": F.lit(1 / ALPHABET)})
        else:
            shorter = known.select(F.col("gram").alias("tail"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad"))
            level = level.withColumn("tail", F.substring("gram", 2, k)).join(shorter, "tail")
        known = level.select("gram", smooth("n_good", "all_good", F.col("q_good")).alias("p_good"), smooth("n_bad", "all_bad", F.col("q_bad")).alias("p_bad"))
    return known.select("gram", (F.ln("p_good") - F.ln("p_bad")).alias("ratio"))


def _with_rules(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows plus host, path, rule, decided (the rule's action) and counted (whether the models count the URL)."""
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return rows.withColumns(
        {
            "rule": _decided(F.col("host"), F.col("path"), rules, lambda r: r.text),
            "decided": _decided(F.col("host"), F.col("path"), rules, lambda r: r.action),
            "counted": ~F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT),
        }
    )


def score_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, large_grams: int = BROADCAST_ROWS) -> DataFrame:
    """One row per distinct page_id and url: page_id, url, copies, score, host, path, rule, decided, counted.

    Grams that make up at least 1 / large_grams of all grams (so there are large_grams of them at most) get their ratios by a
    broadcast. Only the rare others shuffle, and none of those is a hot key.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    # Each URL becomes dozens of grams: the few bytes of the URLs must not end up in few tasks.
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.repartition(spread, "page_id", "url").withColumn("row", F.monotonically_increasing_id()))
    ruled = _with_rules(rows, rules)
    exploded = ruled.select("row", "decided", "counted", F.explode(_grams(F.col("url"), order)).alias("gram"))
    counted = lambda action: F.sum(F.when(F.col("counted") & (F.col("decided") == action), 1).otherwise(0))
    distinct = cut(exploded.groupBy("gram").agg(counted("allow").alias("n_good"), counted("block").alias("n_bad"), F.count("*").alias("times")))
    total = distinct.agg(F.sum("times")).first()[0] or 0
    ratios = cut(gram_ratios(distinct, order).join(distinct.select("gram", "times"), "gram"))
    is_large = F.col("times") * F.lit(large_grams) >= F.lit(total)
    large, small = (ratios.where(x).select("gram", "ratio") for x in (is_large, ~is_large))
    grams = exploded.select("row", "gram")
    known = grams.join(F.broadcast(large), "gram", "left")
    found = known.where(F.col("ratio").isNotNull()).select("row", "ratio")
    rare = known.where(F.col("ratio").isNull()).select("row", "gram").join(small, "gram").select("row", "ratio")
    scores = found.unionByName(rare).groupBy("row").agg(F.avg("ratio").alias("score"))
    return ruled.join(scores, "row").drop("row")


def threshold(scored: DataFrame) -> float:
    """Where the two classes' held-out scores err alike, taken as normal; 0 if a class has no URL."""
    held = scored.where(~F.col("counted") & F.col("decided").isNotNull()).groupBy("decided")
    found = {r["decided"]: r for r in held.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("sd")).collect()}
    if len(found) < 2:
        return 0.0
    good, bad = found["allow"], found["block"]
    width = good["sd"] + bad["sd"]
    return (good["mean"] * bad["sd"] + bad["mean"] * good["sd"]) / width if width else (good["mean"] + bad["mean"]) / 2


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score."""
    scored = cut(score_urls(pages, rules, order))
    judged = F.when(F.col("score") >= F.lit(threshold(scored)), "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")
    ).drop("__copy")
