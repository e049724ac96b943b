"""The registered queries of the training-data operators, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import (
    best_fit_packing, chat_format, decontamination, embedding_whitening, exact_dedup, language_id, ngram_join, quality, secret_scan, sharding, source_divergence, toxicity, url_filter,
)
from terraloom.llm.common import crc32_fold, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (crc32_fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learned only where crc32(doc_id) mod 4 is not 2."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: crc32_fold(i, 4) != 2)
    return _judged(scored, 4, 2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 9))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learned only where crc32(doc_id) mod 5 is not 0."""
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: crc32_fold(i, 5) != 0)
    return _judged(scored, 5, 0)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, which holds control strings; all columns are read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = chat_format.format_chats(turns.unionByName(control)).withColumn("turns", chat_format.parse(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat_format.loss_text(F.col("segments"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; they are learned only where crc32(doc_id) mod 5 is not 0."""
    found = language_id.identify(table(spark, sf_dir, "documents"), lambda i: crc32_fold(i, 5) != 0)
    return found.select("doc_id", (crc32_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""

def _op4_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    by = lambda pick: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{pick(r)}'" for r in rules) + " end"
    m, levels, odds = url_filter.SMOOTHING, "", ""
    for k in range(url_filter.ORDER - 1, -1, -1):
        levels += f", n{k} as (select substr(gram, 2) as gram, sum(good) as good, sum(bad) as bad from n{k + 1} group by 1)"
    for k in range(url_filter.ORDER + 1):
        context = f"(partition by substr(n{k}.gram, 1, {k}))"
        below = (f"p{k - 1}.good", f"p{k - 1}.bad") if k else (f"{1 / url_filter.ALPHABET!r}::double",) * 2
        joined = f"n{k} join p{k - 1} on p{k - 1}.gram = substr(n{k}.gram, 2)" if k else "n0"
        p = lambda i, c: f"(n{k}.{c} + {m}::double * {below[i]}) / (sum(n{k}.{c}) over {context} + {m}::double) as {c}"  # noqa: B023, E731
        odds += f", p{k} as (select n{k}.gram, {p(0, 'good')}, {p(1, 'bad')} from {joined})"
    return f"""
with rows as (select distinct page_id, coalesce(url, '') as url from pages),
parts as (select *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, substr(md5(url), 1, 1) not in ('0', '1', '2') as counted from rows),
ruled as (select *, {by(lambda r: r.text)} as rule, {by(lambda r: r.action)} as decided from parts),
grams as (select *, substr(repeat(chr(2), {url_filter.ORDER}) || url || chr(3), i, {url_filter.ORDER + 1}) as gram
  from ruled, lateral (select unnest(range(1, length(url) + 2)) as i) t),
n{url_filter.ORDER} as (select gram, sum(case when counted and decided = 'allow' then 1 else 0 end) as good,
  sum(case when counted and decided = 'block' then 1 else 0 end) as bad from grams group by gram){levels}{odds},
scored as (select page_id, url, avg(ln(good) - ln(bad)) as score from grams join p{url_filter.ORDER} using (gram) group by page_id, url),
held as (select decided, avg(score) as m, coalesce(stddev_samp(score), 0) as sd from ruled r join scored s on r.page_id is not distinct from s.page_id and r.url = s.url
  where not counted and decided is not null group by decided),
line as (select coalesce((select case when a.sd + b.sd > 0 then (a.m * b.sd + b.m * a.sd) / (a.sd + b.sd) else (a.m + b.m) / 2 end
  from held a, held b where a.decided = 'allow' and b.decided = 'block'), 0) as t)
select p.page_id, host, path, rule, coalesce(decided, case when score >= t then 'allow' else 'block' end) as verdict, round(score, 9) as score
from pages p join ruled r on p.page_id is not distinct from r.page_id and coalesce(p.url, '') = r.url
join scored s on s.page_id is not distinct from r.page_id and s.url = r.url, line
"""


# The template's marks: 15 characters around a system turn, 13 around a user turn, 7 around an assistant turn.
OP6_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, length(regexp_replace(replace(text, '\', '\\'), '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE |<</ROLE>>)', 'x\1', 'g'))
     + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + 2 * octet_length(encode(role)) end as chars,
     case lag(role) over w when 'system' then role = 'user' when 'user' then role = 'assistant' when 'assistant' then role = 'user'
       else row_number() over w = 1 and role in ('system', 'user') end as fits,
     row_number() over w = count(*) over (partition by conv_id) as is_last
  from turns window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars,
  bool_and(fits) and bool_or(is_last and role <> 'system') as valid
from sized group by conv_id
"""

OP9_SQL = r"""
with words as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents
), items as (
  select item_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from benchmark
), needles as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram
  from items, lateral (select unnest(range(1, len(w) - least(len(w), 10) + 2)) as i) t where len(w) > 0
), grams as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from words, (select distinct n from needles) sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i) t
), hits as (
  select doc_id, item_id, i, g.n from grams g join needles d on g.gram = d.gram and g.n = d.n
), covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), matched as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from hits) group by doc_id
)
select w.doc_id, len(w.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join covered using (doc_id) left join matched using (doc_id)
"""

OP10_SQL = r"""
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') if x <> ''] as w from documents
), grams as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as gram
  from words, lateral (select unnest(range(1, greatest(len(w) - 2, 2))) as i) t where len(w) > 0
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id group by all
), links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)
), reach as (
  select doc_id, doc_id as other from documents
  union
  select reach.doc_id, links.y from reach join links on links.x = reach.other
)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id from reach left join sizes using (doc_id) group by doc_id
"""


OP12_SQL = r"""
with docs as (select row_number() over () as k, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
hits as (select k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from hits group by lang, term having count(distinct k) >= 3),
size as (select lang, count(*) as v from kept group by lang),
counted as (select lang, source, term, count(*) as n from hits semi join kept using (lang, term) group by lang, source, term),
whole as (select lang, term, sum(n) as n from counted group by lang, term),
sums as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from docs) g left join counted using (lang, source) group by lang, source),
lang_sums as (select lang, sum(total) as total from sums group by lang),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + v)::hugeint as p
  from sums s join size using (lang) join kept k using (lang) left join counted c on c.lang = s.lang and c.source = s.source and c.term = k.term),
q as (select w.lang, w.term, 1 + (1000000000::hugeint * (w.n + 1)::hugeint) // (l.total + v)::hugeint as q from whole w join lang_sums l using (lang) join size using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) as value
  from sums a join sums b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) t where rank <= 200)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_url_filter": op4_url_filter,
        "op5_quality": op5_quality,
        "op6_chat_format": op6_chat_format,
        "op7_sharding": op7_sharding,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_join": op10_ngram_join,
        "op11_language_id": op11_language_id,
        "op12_source_divergence": op12_source_divergence,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_url_filter": _op4_sql(), "op6_chat_format": OP6_SQL, "op9_decontamination": OP9_SQL, "op10_ngram_join": OP10_SQL, "op12_source_divergence": OP12_SQL}
