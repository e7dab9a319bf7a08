"""The queries of this subpackage: one ``opN_<name>`` for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, fim, minmax, mixing, ngrams, pages, pii, simhash, substrings, topk, toxicity
from .common import materialise, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_sentences", F.size("toxic_sentences").cast("long").alias("n_toxic_sentences"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
with c as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), q as (select distinct * from c where vec_id % 50 = 0), p as (
  select q.vec_id query_id, q.v qv, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score
  from q join c on q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id, qv order by score desc, vec_id) rank from p)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 5
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = chat.render(chat.messages(chat.events(turns.union(extra))))
    out = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\t'), ':', '\c') as er,
    replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\t') as et from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || er || ': ' || et || '</turn>' || chr(10))) as bigint) as formatted_chars
from e group by conv_id
"""


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
with d as (
  select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), places as (select rid, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35),
windows as (select rid, i, array_to_string(w[i : i + 34], ' ') s from places join d using (rid)),
repeats as (select rid, i from (select rid, i, count(*) over (partition by s) n from windows) where n > 1),
gone as (select distinct rid, unnest(range(i, i + 35)) p from repeats),
words as (select rid, unnest(w) x, unnest(range(1, len(w) + 1)) p from d where len(w) > 0),
kept as (select rid, count(*) n, string_agg(x, ' ' order by p) k from words anti join gone using (rid, p) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256 from d left join kept using (rid)
"""


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') w, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents
), e as (
  select *, len(w) n, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2, cast('0x' || h[17:24] as bigint) h3, cast('0x' || h[25:32] as bigint) h4 from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from e
), g as (
  select *, array_to_string(w[1:a], '') pre, array_to_string(w[a + 1:b], '') mid, array_to_string(w[b + 1:n], '') suf from f
)
select doc_id, cast(n as bigint) n, form,
  case when form <> 'plain' then cast(length(pre) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256
from g
"""


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    books = codes.fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = codes.label_errors(materialise(codes.encode(vectors, books), "codes"))
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    """The nearest entry of every part under the codebooks of round n, as distance * 256 + entry."""
    return f"""a{n} as materialized (
  select p.part, p.rid, min(256 * cast(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) + c.entry) best
  from p join c{n} c using (part) group by all)"""


def _next(n: int) -> str:
    """The codebooks after round n."""
    return f"""s{n} as materialized (
  select part, best % 256 entry, k, cast(sum(y) as bigint) s, count(*) m
  from (select part, best, unnest(x) y, unnest(range(1, len(x) + 1)) k from a{n} join p using (part, rid)) group by all),
c{n + 1} as materialized (
  select c.part, c.entry, coalesce(list((s - ((s % m) + m) % m) // m order by k) filter (m is not null), any_value(c.x)) x
  from c{n} c left join s{n} using (part, entry) group by all)"""


OP12_SQL = f"""
with v as materialized (
  select row_number() over (order by vec_id nulls last, embedding) - 1 rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), w as (select *, cast(ceil((select max(len(v)) from v) / 4.0) as bigint) d from v),
p as materialized (select rid, part, list_resize(v, 4 * d, 0)[part * d + 1 : part * d + d] x from w, (select unnest(range(4)) part)),
c0 as materialized (select part, rid entry, x from p where rid < 256),
{", ".join(x for n in range(4) for x in (_assigned(n), _next(n)))}, {_assigned(4)},
books as (select sha256(string_agg(y, ',' order by part, entry, k)) h from (select part, entry, unnest(x) y, unnest(range(len(x))) k from c4)),
codes as (select rid, string_agg(printf('%02x', cast(best % 256 as integer)), '' order by part) code, cast(sum(best // 256) as bigint) error from a4 group by rid)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256 from v join codes using (rid), books
"""


def op13_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
with recursive d as materialized (
  select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), s as materialized (
  select distinct rid, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) g from d
), k as materialized (select rid, count(*) n, sha256(string_agg(g, chr(10) order by g)) same from s group by rid),
heads as materialized (select same, min(rid) head, any_value(n) n from k group by same),
h as materialized (select s.rid, g, n from s join heads on s.rid = head),
links as materialized (
  select a.rid x, b.rid y from h a join h b on a.g = b.g and a.rid < b.rid group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways as materialized (select x, y from links union select y, x from links),
reach as (select head rid, head root from heads union select y, root from reach join ways on rid = x),
roots as (select rid head, min(root) root from reach group by rid),
named as (select k.rid, root from k join heads using (same) join roots using (head)),
names as (select root, min(doc_id) component_id from named join d using (rid) group by root)
select doc_id, coalesce(n, 0) n_shingles, case when n is null then doc_id else component_id end component_id,
  doc_id is not distinct from (case when n is null then doc_id else component_id end) kept
from d left join k using (rid) left join named using (rid) left join names using (root)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_substrings": op5_substrings,
    "op6_pages": op6_pages,
    "op7_decontaminate": op7_decontaminate,
    "op8_mixing": op8_mixing,
    "op9_ngrams": op9_ngrams,
    "op10_pii": op10_pii,
    "op11_fim": op11_fim,
    "op12_codes": op12_codes,
    "op13_minmax": op13_minmax,
}

ORACLES: dict[str, str] = {"op2_topk": OP2_SQL, "op4_chat": OP4_SQL, "op5_substrings": OP5_SQL, "op11_fim": OP11_SQL, "op12_codes": OP12_SQL, "op13_minmax": OP13_SQL}
