"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, chat, decontam, jaccard, lines, phrases, pii, quality, search, shards, suffix, topk
from rasterloom.llm.common import prepare


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -1L conv_id, t turn, r role, '{said}' text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.format_conversations(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return made.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = lines.dedup_lines(docs, out="kept", removed="n_removed")
    n = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long")
    return made.select("doc_id", n.alias("n_lines"), "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = suffix.remove_repeats(docs)
    return made.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Stands for the secret that an operator of this query would pass.
DEMO_KEY = b"rasterloom demonstration key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pii.pseudonymize(docs, DEMO_KEY)
    return made.select("doc_id", F.size("spans").cast("long").alias("n_found"), F.transform("spans", lambda s: s["kind"]).alias("kinds"), "text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = decontam.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    made = quality.score(docs, forest)
    return made.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.round_trip(docs, path)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        shards.size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def _replaced(expr: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


def _op1_sql() -> str:
    sign = chat.TEMPLATE["escape"]
    esc = lambda c: _replaced(c, [(sign, sign + "0"), *chat._codes(chat.TEMPLATE)])
    other = chat.TEMPLATE["other"]
    around = "".join(f" when '{r}' then {len(m['open'] + m['close'])}" for r, m in chat.TEMPLATE["roles"].items())
    fixed = len(other["open"] + other["named"] + other["close"])
    return rf"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  ({len(chat.TEMPLATE["begin"])} + sum(length({esc("text")}) + case role{around} else {fixed} + length({esc("role")}) end))::bigint as formatted_chars,
  regexp_full_match(string_agg(role, '>' order by turn nulls first, role, text), '(system>)?user>assistant(>user>assistant)*') as valid
from said group by conv_id
"""


OP3_SQL = """
with lines as (
  select doc_id, hash(text) as k, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), said as (
  select *, trim(line, ' ' || chr(9) || chr(13)) as said from lines
), wide as (
  select said, min((doc_id, pos, k)) as first from said where said <> ''
  group by said having count(distinct coalesce(source, '')) >= 10
), kept as (
  select s.doc_id, s.line, s.pos, coalesce((s.doc_id, s.pos, s.k) <> w.first, false) as gone
  from said s left join wide w using (said)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from kept group by doc_id
"""


OP6_SQL = """
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
), classes as (
  select min(doc_id) as rep, list_sort(s) as s from sets where len(s) > 0 group by list_sort(s)
), items as (
  select rep, len(s) as n, unnest(s) as item from classes
), pairs as (
  select a.rep as x, b.rep as y from items a join items b on a.item = b.item and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways as (
  select x, y from pairs union select y, x from pairs
), recursive_reach as (
  with recursive reach(x, y) as (select rep, rep from classes union select r.x, p.y from reach r join both_ways p on r.y = p.x)
  select x, min(y) as low from reach group by x
)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(r.low, d.doc_id)::bigint as component_id
from sets d left join classes c on len(d.s) > 0 and list_sort(d.s) = c.s left join recursive_reach r on r.x = c.rep
"""


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
)
select * from r where rank <= 10
"""


OP12_SQL = """
with pieces as (
  select row_number() over () as doc, coalesce(lang, 'und') as lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as p
  from documents
), said as (
  select doc, lang, generate_subscripts(p, 1) as piece, unnest(p) as said from pieces
), split as (
  select lang, list_filter(regexp_split_to_array(said, '[ \\x09]+'), lambda x: x <> '') as w from said
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g
  from split, (values (1), (2), (3), (4)) as v(k) where len(w) >= k
), counts as (
  select lang, k, g, count(*) as a from grams group by lang, k, g
), held as (
  select * from counts where a >= 30
), cuts as (
  select h.lang, h.k, h.g, h.a, c, l.a as l, r.a as r, (2000000 * h.a::hugeint) // (l.a + r.a) as score
  from held h, (values (1), (2), (3)) as v(c), held l, held r
  where h.k > c and l.lang = h.lang and r.lang = h.lang and l.g = h.g[1:c] and r.g = h.g[c + 1:h.k]
), least as (
  select lang, k, g, a, unnest(list_sort(list({'score': score, 'c': c, 'l': l, 'r': r}))[1:1], recursive := true) from cuts group by lang, k, g, a
), spots as (
  select lang, a, g[i:i + n - 1] as g from held, (values (1), (2), (3)) as v(i), (values (2), (3)) as u(n) where k > n and i + n - 1 <= k
), wide as (
  select lang, g, max(a) as most from spots group by lang, g
), kept as (
  select e.lang, array_to_string(e.g, ' ') as phrase, e.a, e.l, e.r, e.score
  from least e left join wide w on w.lang = e.lang and w.g = e.g where w.most is null or 100 * w.most < 80 * e.a
), ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, * exclude (lang) from kept
), total as (
  select lang, sum(a)::bigint as n from counts where k = 1 group by lang
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""


OP13_SQL = """
with said as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t
  from documents where text is not null and doc_id is not null
), docs as (
  select k, doc_id, len(t)::bigint as n from said where len(t) > 0
), sizes as (
  select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from docs
), asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t
  from benchmark where item_id is not null
), wanted as (
  select item_id, t, count(*)::bigint as often from asked group by item_id, t
), postings as (
  select k, t, count(*)::bigint as tf from (select k, unnest(t) as t from said) where t in (select t from wanted) group by k, t
), weights as (
  select t, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, sizes group by t
), scored as (
  select item_id, d.k, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
  from wanted join postings using (t) join weights using (t) join docs d using (k), sizes group by item_id, d.k, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select * from ranked where rank <= 10
"""


def queries() -> dict:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_token_counts": op2_token_counts,
        "op3_line_dedup": op3_line_dedup,
        "op4_pii": op4_pii,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_quality": op7_quality,
        "op8_top_k": op8_top_k,
        "op9_bpe": op9_bpe,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_sharding": op11_sharding,
        "op12_collocations": op12_collocations,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _op1_sql(), "op3_line_dedup": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op8_top_k": OP8_SQL, "op12_collocations": OP12_SQL, "op13_lexical_search": OP13_SQL}
