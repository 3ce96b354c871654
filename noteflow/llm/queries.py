"""Registered queries of the subpackage: each operator on its whole table, and the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, conversation_trie, cover_tree, factor_machine, ftrl, harmonic_packing, hilbert_sharding, interval_search, license_templates, mixing, order_minhash, stable_ann, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n: which fold a document is in."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def held_out(id_col: str, n: int, rest: int):
    """Whether a document lies in the fold ``rest``; one without an id never does."""
    return F.coalesce(fold(id_col, n) == rest, F.lit(False))


@query("op1_hilbert_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
                                                    F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = hilbert_sharding.shard(docs, ["source", "lang", "size", "doc_id"], "doc_id", "size", shards=40, law="rows", carry=("text_crc32",))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op2_url_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages: a page's address ends in the number of its document; low quality or toxic is bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(F.col("url"), r"://[^/]*/[a-z]+/(\d+)", 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    labelled = pages.withColumn("doc_id", F.when(number != "", number).cast("long")).join(labels, "doc_id").select("url", "bad")
    return url_rules.judge(pages, url_rules.mine(labelled))


def language_model(docs: DataFrame):
    """Network of the pipeline and op3: fitted on the folds that are not held out."""
    return byte_cnn.train(docs.filter(fold("doc_id", 4) != 2), "doc_id", "text", "lang")


@query("op3_byte_cnn")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = byte_cnn.identify(docs, language_model(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Weights of the pipeline and op4: fitted on the folds that are not held out."""
    return ftrl.train(docs, labels.filter(fold("doc_id", 5) != 0), "doc_id", "text", "toxic")


@query("op4_ftrl_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ftrl.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op5_harmonic_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = harmonic_packing.tokenize(docs, "doc_id", "text", tokenizer_path(), digest=True)
    return harmonic_packing.place(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


# The templates hold their base phrase in one piece, so each base place is looked at from both sides.
OP6_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
p(phrase, label) as (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
f as (select row, w, label, len(phrase) as n, list_filter(range(0, greatest(len(w) - len(phrase) + 1, 0)), lambda i: w[i + 1:i + len(phrase)] = phrase) as pos from d, p),
o as (select row, label, n, w, unnest(pos) as i from f),
s as (
  select row, label, i, regexp_matches(' ' || coalesce(array_to_string(w[1:i], ' '), '') || ' ',
      ' (licensed|released|distributed|available|provided) under (the terms of )?(the )?$') as led,
    coalesce(array_to_string(w[i + n + 1:], ' '), '') || ' ' as tail from o),
m as (
  select row, label, i, case when not led then null
    when label = 'gpl' and regexp_matches(tail, '^(as published by the free software foundation )?(either )?(version|v) 2 ') then 'gpl-2'
    when label = 'gpl' and regexp_matches(tail, '^(as published by the free software foundation )?(either )?(version|v) 3 ') then 'gpl-3'
    when label = 'apache' and regexp_matches(tail, '^((version|v) )?2 0 ') then 'apache-2'
    when label = 'cc-by' and regexp_matches(tail, '^[1-4] [05] ') then 'cc-by'
    when label = 'cc-by' and regexp_matches(tail, '^nc [1-4] [05] ') then 'cc-by-nc'
    when label = 'cc-by' and regexp_matches(tail, '^sa [1-4] [05] ') then 'cc-by-sa'
    when label = 'cc-by' and regexp_matches(tail, '^nd [1-4] [05] ') then 'cc-by-nd'
    when label = 'mit' then 'mit-notice' end as extra from s),
a as (
  select row, count(*) as n, min(i) as lo, max(i) as hi, count(extra) as inside, string_agg(distinct label, ',' order by label) as base,
    array_to_string(list_sort(list_distinct(list_concat(list(label), list_filter(list(extra), lambda x: x is not null)))), ',') as labels
  from m group by row)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(a.n, 0) as bigint) as n_base, lo as first_word, hi as last_word,
  coalesce(base, '') as base_labels, coalesce(labels, '') as labels, case when a.n > 0 then cast(inside as double) / a.n else 0e0 end as score
from d left join a on a.row = d.row"""


@query("op6_license_templates", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_templates.license_summary(license_templates.scan_licenses(docs))


@query("op7_stable_ann")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP8_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where vec_id is not null and embedding is not null),
u as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
p as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(a, b) as (select vec_id, vec_id from embeddings where vec_id is not null union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as m from r group by a),
k as (select a, count(*) as n from p group by a)
select vec_id, cast(coalesce(k.n, 0) as bigint) as n_links, c.m as component_id, vec_id = c.m as kept
from embeddings join c on vec_id = c.a left join k on vec_id = k.a"""


@query("op8_cover_tree", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


@query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, slots, pieces = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = mixing.taken_pieces(slots, pieces).groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row", "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP11_SQL = r"""
with recursive c as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select c, row_number() over (partition by c order by turn nulls first, role, text) - 1 as pos, role, text from c),
n as (select c, count(*) as n from t group by c),
h as (
  select c, n, c - c % 100 as base, list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(string_split(cast(c as varchar), ''),
      lambda x: [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end) as crc from n),
k as (select h.c, h.n, base, xor(crc, 4294967295) % 6 as h, least(xor(crc, 4294967295) % 6, coalesce(b.n, 0)) as taken from h left join n b on b.c = base),
r as (
  select k.c, pos, role, text from k join t on t.c = base where pos < taken
  union all select k.c, pos - h + taken, role, text from k join t on t.c = k.c where pos >= h),
l as (select k.c, taken + greatest(n - h, 0) as length from k),
p as (
  select r.c, r.pos + 1 as depth, r.text, sha256(string_agg(concat(strlen(q.role), ':', q.role, strlen(q.text), ':', q.text), '' order by q.pos)) as prefix
  from r join r q on q.c = r.c and q.pos <= r.pos group by all
  union all select c, 0, '', '' from l),
m as (select depth, prefix, min(c) as conv_id, count(*) as n_convs, any_value(text) as text from p group by depth, prefix),
g as (
  select depth, prefix, lower(sha256(coalesce(string_agg(cast(l.c as varchar), ',' order by l.c), ''))) as ends_sha256
  from p left join l on l.c = p.c and l.length = p.depth group by depth, prefix),
a as (select p.depth, p.prefix, m.depth as up_depth, m.prefix as up from m join p q on q.c = m.conv_id and q.depth = m.depth join p on p.c = m.conv_id and p.depth <= m.depth),
f as (select m.*, (select count(*) from a where a.depth = m.depth and a.prefix = m.prefix and a.up_depth = m.depth + 1) as n_children from m),
s as (
  select a.depth, a.prefix, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * length(f.text)) as saved_tokens
  from a join f on f.depth = a.up_depth and f.prefix = a.up group by a.depth, a.prefix)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from f join s using (depth, prefix) join g using (depth, prefix) left join (select a.up_depth, a.up, a.depth, m.conv_id from a join m using (depth, prefix)) u
  on u.up_depth = f.depth and u.up = f.prefix and u.depth = f.depth - 1"""


@query("op11_conversation_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, lengths = conversation_trie.place_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(*conversation_trie.share_openings(placed, lengths))


def quality_model(docs: DataFrame, labels: DataFrame):
    return factor_machine.train(docs, labels.filter(fold("doc_id", 4) != 2), "doc_id", "text", "quality", [length_class()])


def length_class():
    """The one column of ``documents`` that may describe a text: its length, in half octaves."""
    return F.floor(2 * F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1))


@query("op12_factor_machine")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = factor_machine.score(docs, quality_model(docs, table(spark, sf_dir, "labels")), metadata=[length_class()])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP13_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (
  select row_number() over () as item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from (select distinct item_id, text from benchmark)),
s as (select count(*) as docs, cast(sum(len(t)) as bigint) as length from d where len(t) > 0),
p as (
  select row, doc_id, n, term, count(*) as tf from (select row, doc_id, cast(len(t) as bigint) as n, unnest(t) as term from d)
  where term in (select term from i) group by all),
w as (select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from p, s group by term),
r as (
  select item, item_id, row, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) as bigint) as score
  from i join p using (term) join w using (term), s group by all),
o as (select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from r where score > 0)
select item_id, rank, doc_id, score from o where rank <= 50"""


@query("op13_interval_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
