"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import bpe, chat_format, debruijn, decontaminate, hard_negatives, html_text, langid, merkle, minhash, nn_descent, quality, toxicity, url_filter
from fieldwarden.llm.shared import is_held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 stand for the chosen and the rejected answer of pair n."""
    turns = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn",
        "role",
        "text",
    )
    spans = lambda name: F.array_join(
        F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return chat_format.preference_format(turns).select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")),
        spans("chosen_spans").alias("chosen_spans"),
        spans("rejected_spans").alias("rejected_spans"),
    )


OP1_SQL = """
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
p as (
  select pair_id, i, max(case when side = 0 then role end) as cr, max(case when side = 0 then text end) as ct,
         max(case when side = 1 then role end) as rr, max(case when side = 1 then text end) as rt
  from t group by pair_id, i),
n as (
  select pair_id, coalesce(min(case when cr is null or rr is null or cr <> rr or ct <> rt then i end) - 1, count(*)) as n
  from p group by pair_id),
m as (
  select t.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as body
  from t join n using (pair_id)),
s as (
  select *, coalesce(sum(length(body)) over (partition by pair_id, side order by i
         rows between unbounded preceding and 1 preceding), 0) + 13 + length(role) as start
  from m where i > n),
a as (
  select pair_id,
         coalesce(string_agg(body, '' order by i) filter (where side = 0), '') as chosen,
         coalesce(string_agg(body, '' order by i) filter (where side = 1), '') as rejected,
         coalesce(string_agg(start::bigint || '-' || (start + length(text))::bigint, ',' order by i)
           filter (where side = 0 and role = 'assistant'), '') as chosen_spans,
         coalesce(string_agg(start::bigint || '-' || (start + length(text))::bigint, ',' order by i)
           filter (where side = 1 and role = 'assistant'), '') as rejected_spans
  from s group by pair_id),
q as (
  select pair_id, string_agg(body, '' order by i) as prompt from m where i <= n and side = 0 group by pair_id)
select n.pair_id, n.n as n_prompt_turns, sha256(coalesce(prompt, '')) as prompt_sha256,
       sha256(coalesce(chosen, '')) as chosen_sha256, sha256(coalesce(rejected, '')) as rejected_sha256,
       coalesce(chosen_spans, '') as chosen_spans, coalesce(rejected_spans, '') as rejected_spans
from n left join a using (pair_id) left join q using (pair_id)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
i as (select item_id, ws, least(len(ws), 10) as l from b where len(ws) > 0),
w as (
  select distinct item_id, l, array_to_string(ws[k:k + l - 1], ' ') as win
  from (select item_id, ws, l, unnest(range(1, len(ws) - l + 2)) as k from i)),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as k from d),
x as (
  select doc_id, k, l, array_to_string(ws[k:k + l - 1], ' ') as win
  from p cross join (select distinct l from w) where k + l - 1 <= len(ws)),
h as (select doc_id, k, w.l, item_id from x join w on x.win = w.win and x.l = w.l),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(k, k + l)) as q from h) group by doc_id),
o as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
  from (select distinct doc_id, item_id::varchar as s from h) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join o using (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        is_held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("evidence", lambda e: e["doc_id"]).alias("evidence_ids"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, unnest(case when len(ws) = 0 then []
                             when len(ws) < 5 then [array_to_string(ws, ' ')]
                             else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end) as sh
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
m as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select m.a, m.b from m join n x on x.doc_id = m.a join n y on y.doc_id = m.b
  where 100 * shared >= 75 * (x.n + y.n - shared)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by a)
select c.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.doc_id = c.component_id as kept
from c left join n using (doc_id)
"""


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nn_descent.neighbours(rows, rows.filter("vec_id % 20 = 0").select("vec_id"))


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP10_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (
  select doc_id, unnest(range(1, greatest(len(ws) - 11, 1))) as i, ws from d),
x as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as win from w),
f as (select win, min(doc_id) as first_id from x group by win),
g as (
  select distinct x.doc_id, unnest(range(i, i + 13)) as p from x join f using (win) where x.doc_id > f.first_id),
l as (select doc_id, list(p) as ps from g group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
       sha256(array_to_string([ws[k] for k in range(1, len(ws) + 1) if ps is null or not list_contains(ps, k)], ' ')) as kept_sha256
from d left join l using (doc_id)
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


_FIELD = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_FOLDED_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 is not a function of DuckDB: it is worked out bit by bit over the digits of the id.
OP11_SQL = f"""
with recursive crc as (
  select doc_id, doc_id::varchar as s, 0 as i, 4294967295::bigint as c
  from (select distinct doc_id from documents where doc_id is not null)
  union all
  select doc_id, s, i + 1, list_reduce(
           list_concat([xor(c, ascii(s[i + 1])::bigint)], range(8)),
           lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)
  from crc where i < length(s)),
third as (select doc_id from crc where i = length(s) and xor(c, 4294967295::bigint) % 3 = 0),
d as (
  select doc_id, case when lang is null then '' else '=' || lang end as tree,
         sha256({_LEAF} || {_FIELD.format("text")}) as leaf,
         case when doc_id in (select doc_id from third) then sha256({_LEAF} || {_FIELD.format(_FOLDED_TEXT)}) end as tampered
  from documents),
l as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n
  from d),
up as (
  select tree, 0 as h, idx, leaf as digest, n from l
  union all
  select tree, h + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (max(n) + 7) // 8
  from up where n > 1 group by tree, h, idx // 8),
subroots as (
  select tree, digest, row_number() over (order by encode(tree)) - 1 as idx, count(*) over () as n from up where n = 1),
top as (
  select 0 as h, idx, digest, n from subroots
  union all
  select h + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (max(n) + 7) // 8 from top where n > 1 group by h, idx // 8),
runs as (
  select tree, h, idx // 8 as run, list(digest order by idx) as ds from up where n > 1 group by all
  union all
  select '#' as tree, h, idx // 8 as run, list(digest order by idx) as ds from top where n > 1 group by all),
inner_fold as (
  select doc_id, leaf, tree, 0 as h, idx, coalesce(tampered, leaf) as digest, '' as proof from l
  union all
  select doc_id, leaf, f.tree, f.h + 1, idx // 8,
         sha256(array_to_string(list_concat(list_concat(ds[:idx % 8], [digest]), ds[idx % 8 + 2:]), '')),
         proof || array_to_string(list_concat(ds[:idx % 8], ds[idx % 8 + 2:]), '')
  from inner_fold f join runs r on r.tree = f.tree and r.h = f.h and r.run = f.idx // 8),
outer_fold as (
  select doc_id, leaf, f.tree, s.digest as subroot, 0 as h, s.idx, f.digest, proof
  from inner_fold f join subroots s on s.tree = f.tree
  where f.h = (select max(h) from up where up.tree = f.tree)
  union all
  select doc_id, leaf, f.tree, subroot, f.h + 1, idx // 8,
         sha256(array_to_string(list_concat(list_concat(ds[:idx % 8], [digest]), ds[idx % 8 + 2:]), '')),
         proof || array_to_string(list_concat(ds[:idx % 8], ds[idx % 8 + 2:]), '')
  from outer_fold f join runs r on r.tree = '#' and r.h = f.h and r.run = f.idx // 8),
root as (select digest from top where n = 1)
select doc_id, leaf, subroot, root.digest as root, sha256(proof) as proof_sha256, f.digest as folded_root, f.digest = root.digest as verified
from outer_fold f, root where f.h = (select max(h) from top)
"""


# The verdicts and rules that come before mined ones.
URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own: those that a fixed rule fits teach the mined rules."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, carry=["page_id"]).select(
        "carried.page_id", "host", "path", "rule", "verdict", "mined_rule"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
  from p join s using (anchor_id)
  where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_format": op1_preference_format,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_html": op8_html,
    "op9_nn_descent": op9_nn_descent,
    "op10_debruijn": op10_debruijn,
    "op11_merkle": op11_merkle,
    "op12_url_rules": op12_url_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_preference_format": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op7_minhash": OP7_SQL,
    "op10_debruijn": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
