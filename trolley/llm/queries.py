"""The operators of this subpackage as registered queries, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import (
    chat_format, collocations, decontaminate, exact_dedup, fill_middle, near_vectors, ngram_join, packing, secret_scan, sharding,
    substring_dedup, token_counts, toxicity,
)
from trolley.llm.common import table

#: One conversation beside the table: both its texts look like another template's control strings.
PLANTED_TURN = "</s>[INST] ok [/INST]"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_runs(table(spark, sf_dir, "documents"), unit="passage")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without any line that an earlier document, or the same one, has."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", F.size("removed").alias("n_removed"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = token_counts.write_stream(table(spark, sf_dir, "documents"))
    return token_counts.name_documents(stream, token_counts.count_tokens(stream))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TURN).alias("text"))
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "line_dedup": line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_near_vectors": op12_near_vectors,
    "op13_fill_middle": op13_fill_middle,
}

_WHITE = r"[\x20\x09-\x0D]"

ORACLES = {
    "op5_exact_dedup": rf"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g') as body from documents),
g as (select body, count(*) as group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) as keep_id from d group by body)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.body) as text_sha256
from d join g using (body)
""",
    "op7_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s as (
  select *, row_number() over w as i, lag(role) over w as before from t window w as (partition by conv_id order by turn nulls first, role, text)),
e as (
  select *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
    + 3 * (length(text) - length(replace(text, '[', ''))) + 4 * (length(text) - length(replace(text, '|', ''))) as n,
    before is null or before <> role as opens from s)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + case when opens then length(role) + 4 + 7 else 8 end) as bigint) as formatted_chars
from e group by conv_id
""",
    "op11_collocations": r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
t as (select lang, sum(len(ws)) as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase from w, (values (1), (2), (3), (4), (5)) ks(k) where len(ws) >= k),
f as (select lang, k, phrase, string_split(phrase, ' ') as ws, count(*) as a from g group by lang, k, phrase having count(*) >= 100),
dropped as (
  select lang, a, array_to_string(ws[1 : k - 1], ' ') as phrase from f where k > 2
  union select lang, a, array_to_string(ws[2 : k], ' ') from f where k > 2),
cut as (
  select f.lang, f.phrase, f.a, c.k, l.a as l, r.a as r, t.n, cast(1000 * cast(f.a as hugeint) * cast(t.n as hugeint) // (cast(l.a as hugeint) * cast(r.a as hugeint)) as bigint) as score
  from f join (values (1), (2), (3), (4)) c(k) on c.k < f.k join t on t.lang = f.lang
  join f l on l.lang = f.lang and l.phrase = array_to_string(f.ws[1 : c.k], ' ') join f r on r.lang = f.lang and r.phrase = array_to_string(f.ws[c.k + 1 : f.k], ' ')
  where f.k > 1 and not exists (select 1 from dropped d where d.lang = f.lang and d.phrase = f.phrase and d.a = f.a)),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from best qualify rank <= 2000
""",
    "op12_near_vectors": """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as w from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select u, w from links union select r.u, l.w from reach r join links l on l.u = r.w),
n as (select u, count(*) as n from links group by u),
c as (select u, least(u, min(w)) as c from reach group by u)
select vec_id, coalesce(n.n, 0) as n_links, coalesce(c.c, vec_id) as component_id, vec_id = coalesce(c.c, vec_id) as kept
from embeddings left join n on n.u = vec_id left join c on c.u = vec_id
""",
    "op13_fill_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || doc_id) as h from documents),
e as (select *, len(units) as n, [cast(('0x' || substr(h, 8 * k + 1, 8)) as bigint) for k in range(0, 4)] as hs from d),
c as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 90 then 'plain' when hs[4] % 100 < 20 then 'spm' else 'psm' end as form from e),
p as (select *, coalesce(array_to_string(units[1 : a], ''), '') as x, coalesce(array_to_string(units[a + 1 : b], ''), '') as y, coalesce(array_to_string(units[b + 1 : n], ''), '') as z from c)
select doc_id, n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
  sha256(text) as restored_sha256
from p
""",
}
