"""The engine's queries over the test tables, each with the SQL it must equal.

Documents are the corpus, benchmark passages the queries and gold texts; headings,
citations and question and answer pairs, which the tables lack, are made from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..functions import wire
from ..operators import chunk as C
from ..operators import clusters, dense, evaluate, fuse, grade, lexical, prompt, quantiles, serving, sft, validate
from ..operators.sizes import dealt, small
from ..sources import files, index
from ..workspace import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
K = 5


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in about equal parts; those of which only a few are wanted by their number are :func:`stored`."""
    return dealt(stored(spark, sf_dir), "ord")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def sha(x) -> F.Column:
    return F.sha2(x.cast("binary"), 256)


# lexical

WORDS = "list_transform(regexp_extract_all({}, '[0-9A-Za-z가-힣]+'), lambda x: lower(x))"
LEXICAL = f"""
dt as (select doc_id as ord, {WORDS.format("coalesce(text, '')")} as t from documents),
st as (select count(*) as n_docs, cast(coalesce(sum(len(t)), 0) as bigint) as n_tokens, avg(cast(len(t) as double)) as avgdl from dt),
po as (select ord, tok, any_value(dl) as dl, count(*) as tf from (select ord, len(t) as dl, unnest(t) as tok from dt) group by ord, tok),
te as (select tok, count(*) as df, cast(sum(tf) as bigint) as cf from po group by tok),
qt as (select qid, tok, count(*) as qtf from (select item_id as qid, unnest({WORDS.format("coalesce(text, '')")}) as tok from benchmark) group by qid, tok),
sc as (select qid, ord, round(sum(qtf * ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)))), 9) as score
  from qt join po using (tok) join te using (tok) cross join st group by qid, ord),
bm as (select qid, ord, score, cast(row_number() over (partition by qid order by score desc, ord) as int) as rank from sc where score > 0)"""
HASHED = """
ch as (select 'd' as side, doc_id as id, lower(coalesce(text, '')) as t from documents union all select 'q', item_id, lower(coalesce(text, '')) from benchmark),
co as (select side, id, list_transform(string_split(case when length(t) < 3 then t || '  ' else t end, ''), lambda x: cast(unicode(x) as bigint)) as c from ch where t <> ''),
bu as (select side, id, cast(h % 512 as int) as bucket, count(*) as n from (select side, id, unnest(list_transform(range(1, len(c) - 1), lambda i:
  ((xor(((xor(((xor(2166136261, c[i]) * 16777619) & 4294967295), c[i + 1]) * 16777619) & 4294967295), c[i + 2]) * 16777619) & 4294967295))) as h from co) group by side, id, bucket),
no as (select side, id, sum(n * n) as norm2 from bu group by side, id)"""
DENSE = (
    HASHED
    + """,
de as (select qid, ord, score, cast(row_number() over (partition by qid order by score desc, ord) as int) as rank from (
  select q.id as qid, d.id as ord, round(sum(q.n * d.n) / (sqrt(cast(any_value(nq.norm2) as double)) * sqrt(cast(any_value(nd.norm2) as double))), 9) as score
  from bu q join bu d on q.side = 'q' and d.side = 'd' and q.bucket = d.bucket join no nq on nq.side = 'q' and nq.id = q.id join no nd on nd.side = 'd' and nd.id = d.id group by q.id, d.id))"""
)


def fused_sql(mode: str, k: int = K) -> str:
    used = {"hybrid": "true", "dense": "ranker = 'dense'", "bm25": "ranker = 'bm25'"}[mode]
    return f"""
fu as (select qid, ord, sum(1.0::double / (60 + rank)) filter ({used}) as score, max(rank) filter (ranker = 'dense') as dense_rank, max(rank) filter (ranker = 'bm25') as bm25_rank
  from (select qid, ord, rank, 'dense' as ranker from de where rank <= {4 * k} union all select qid, ord, rank, 'bm25' from bm where rank <= {4 * k}) group by qid, ord),
re as (select qid, ord, round(score, 9) as score, coalesce(dense_rank, 0) as dense_rank, coalesce(bm25_rank, 0) as bm25_rank, cast(rank as int) as rank from (
  select *, row_number() over (partition by qid order by round(score, 12) desc, dense_rank nulls last, bm25_rank nulls last) as rank from fu where score is not null) where rank <= {k})"""


@query(f"with {LEXICAL} select tok, df, cf, round(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)), 9) as idf from te cross join st")
def term_df_idf(spark, sf_dir):
    toks = lexical.tokenized(corpus(spark, sf_dir))
    return lexical.terms(lexical.postings(toks), lexical.corpus_stats(toks)).withColumn("idf", F.round("idf", 9))


@query(f"with {LEXICAL} select ord, count(*) as n_terms, cast(sum(tf) as bigint) as n_tokens, max(tf) as top_tf from po group by ord")
def tokenize_tf(spark, sf_dir):
    posts = lexical.postings(lexical.tokenized(corpus(spark, sf_dir)))
    return posts.groupBy("ord").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("top_tf"))


@query(f"with {LEXICAL} select n_docs, n_tokens, round(avgdl, 9) as avgdl from st")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(lexical.tokenized(corpus(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 9))


@query(f"with {LEXICAL} select qid, ord, score, rank from bm where rank <= 20")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), 20)


# dense


@query(f"with {HASHED} select id as item_id, bucket, n from bu where side = 'q'")
def hash_bucket_tf(spark, sf_dir):
    return dense.bucket_counts(read(spark, sf_dir, "benchmark"), "item_id")


@query(f"with {HASHED} select id as doc_id, cast(norm2 as bigint) as norm2, round(sqrt(cast(norm2 as double)), 9) as norm from no where side = 'd'")
def hash_norm(spark, sf_dir):
    return dense.norms(corpus(spark, sf_dir), "ord").withColumnRenamed("ord", "doc_id").where("norm2 > 0").withColumn("norm", F.round(F.sqrt("norm2"), 9))


@query(f"with {DENSE} select qid, ord, score, rank from de where rank <= 20")
def dense_topk_hash(spark, sf_dir):
    return dense.dense_hash(corpus(spark, sf_dir), asked(spark, sf_dir), 20)


NEAREST = """with s as (select q.vec_id as qid, d.vec_id as ord, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))), 9) as score
  from embeddings q, embeddings d where q.vec_id % 100 = 0)
select qid, ord, round(score, 6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by qid order by score desc, ord) as rank from s) where rank <= 10"""


@query(NEAREST)
def dense_topk_vec(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.dense_vectors(vectors.select(F.col("vec_id").alias("ord"), "embedding"), queries, 10).withColumn("score", F.round("score", 6))


@query(NEAREST)
def dense_topk_pruned(spark, sf_dir):
    """The same by clusters, of which most are passed over where vectors lie in groups."""
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found, _ = clusters.pruned_search(clusters.clustered(vectors.select(F.col("vec_id").alias("ord"), "embedding")), queries, 10)
    return found.withColumn("score", F.round("score", 6))


# fusion and search


def _search(spark, sf_dir, mode, **more):
    """Ranks are null in the operator where a ranking lacks the document; here that is 0, so that all columns have one type in SQL."""
    found = fuse.search(corpus(spark, sf_dir), asked(spark, sf_dir), K, mode, **more)
    return found.withColumns({"score": F.round("score", 9), "dense_rank": F.coalesce("dense_rank", F.lit(0)), "bm25_rank": F.coalesce("bm25_rank", F.lit(0))})


@query(f"with {LEXICAL}, {DENSE}, {fused_sql('hybrid')} select * from re")
def rrf_hybrid(spark, sf_dir):
    return _search(spark, sf_dir, "hybrid")


@query(f"with {LEXICAL}, {DENSE}, {fused_sql('dense')} select * from re")
def search_dense_mode(spark, sf_dir):
    return _search(spark, sf_dir, "dense")


@query(f"with {LEXICAL}, {DENSE}, {fused_sql('bm25')} select * from re")
def search_bm25_mode(spark, sf_dir):
    return _search(spark, sf_dir, "bm25")


@query(f"with {LEXICAL}, bz as (select qid, ord, rank, row_number() over (partition by qid order by rank) as r from bm where rank <= {K}) select qid, ord, round(1.0::double / (60 + r), 9) as score, cast(r as int) as bm25_rank from bz")
def search_bm25_only(spark, sf_dir):
    """A single mode without the other ranking's ranks runs one ranking."""
    return _search(spark, sf_dir, "bm25", with_ranks=False).select("qid", "ord", "score", "bm25_rank")


RATES = "count(*) as n_cases, " + ", ".join(f"round(avg(case when r <= {k} then 1.0 else 0 end), 9) as hit_{k}" for k in evaluate.CUTS) + f", round(avg(coalesce(case when r <= {evaluate.MRR_DEPTH} then 1.0::double / r end, 0)), 9) as mrr"
HEAD = "array_to_string(string_split(text, ' ')[1:8], ' ')"


def evaluated_sql(dense: str, more: str = "") -> str:
    """Metrics by mode. dense: the table of the dense ranking, which may be defined in ``more``."""
    return f"""with {LEXICAL.replace("from benchmark)", f"from (select item_id, {HEAD} as text from benchmark))")}, {DENSE.replace("select 'q', item_id, lower(coalesce(text, '')) from benchmark", f"select 'q', item_id, lower({HEAD}) from benchmark")},{more}
fu as (select qid, ord, sum(1.0::double / (60 + rank)) as score, max(rank) filter (ranker = 'dense') as dense_rank, max(rank) filter (ranker = 'bm25') as bm25_rank
  from (select qid, ord, rank, 'dense' as ranker from {dense} where rank <= {4 * evaluate.MRR_DEPTH} union all select qid, ord, rank, 'bm25' from bm where rank <= {4 * evaluate.MRR_DEPTH}) group by qid, ord),
al as (select 'hybrid' as mode, qid, ord, row_number() over (partition by qid order by round(score, 12) desc, dense_rank nulls last, bm25_rank nulls last) as rank from fu
  union all select 'dense', qid, ord, rank from {dense} union all select 'bm25', qid, ord, rank from bm),
hi as (select m.mode, b.item_id, min(case when contains(d.text, b.text) then al.rank end) as r from benchmark b cross join (values ('hybrid'), ('dense'), ('bm25')) m(mode)
  left join al on al.mode = m.mode and al.qid = b.item_id and al.rank <= {evaluate.MRR_DEPTH} left join documents d on d.doc_id = al.ord group by m.mode, b.item_id)
select mode, {RATES} from hi group by mode"""


#: Dense search has no threshold: documents without a bucket in common, which the join on buckets lacks, have a similarity of 0.
EVERY = """
ne as (select b.item_id as qid, d.doc_id as ord, row_number() over (partition by b.item_id order by coalesce(de.score, 0) desc, d.doc_id) as rank
  from benchmark b cross join documents d left join de on de.qid = b.item_id and de.ord = d.doc_id),"""


@query(evaluated_sql("ne", EVERY))
def retrieval_eval(spark, sf_dir):
    """All metrics of all modes; a case is the first words of a passage, its gold text the passage."""
    docs, cases = corpus(spark, sf_dir), asked(spark, sf_dir)
    asked_words = cases.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 8), " "))
    out = evaluate.by_mode(docs, asked_words, cases.select("qid", F.col("text").alias("gold")), texts=stored(spark, sf_dir))
    return out.select("mode", "n_cases", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("mode", "n_cases")])


@query(evaluated_sql("de"))
def retrieval_modes(spark, sf_dir):
    """The same rows by another name."""
    return retrieval_eval(spark, sf_dir)


# chunks

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?…。])\s+', '\1' || chr(31), 'g'), '\n', chr(31), 'g'), chr(31)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"


@query(f"select doc_id, cast(len(s) as bigint) as n_sentences, sha256(array_to_string(s, chr(10))) as sentences_sha256 from (select doc_id, {SENTENCES} as s from documents)")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), sha(F.array_join("s", "\n")).alias("sentences_sha256"))


def markdown(spark, sf_dir) -> DataFrame:
    """Each conversation as a markdown document, a section per turn."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("\n## "), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("t")).alias("s"))
    return turns.groupBy("conv_id").agg(F.concat(F.lit("An intro.\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "")).alias("text"))


STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query(f"""with s as (select conv_id, turn, role as section, {STRIPPED} as body from conversations where {STRIPPED} <> '' union all select distinct conv_id, -1, '', 'An intro.' from conversations)
select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as section_no, section, body from s""")
def section_split(spark, sf_dir):
    return C.split_sections(markdown(spark, sf_dir))


def packing(size: int, overlap: int) -> str:
    """SQL for the chunks of the sections so (doc, sec, title, s: sentences), as the table ck (doc, chunk_id, section, text).

    fe: the last sentence of a body that begins with sentence i, i - 1 where that one is
    over the budget; ov: the first of the sentences before e that fit in the overlap;
    nx: where the body after the one from i begins; wk: the beginnings that are reached."""
    return f"""se as (select doc, sec, title, case when title = '' then '' else '[' || title || '] ' end as prefix, unnest(s) as t, unnest(range(1, len(s) + 1)) as i from so),
sb as (select *, greatest({size} - length(prefix), {C.LEAST_BODY}) as b, length(t) + 1 as need, sum(length(t) + 1) over (partition by doc, sec order by i) as cum, max(i) over (partition by doc, sec) as last from se),
sl as (select *, min(case when length(t) > b then i end) over (partition by doc, sec order by i rows between current row and unbounded following) as nl from sb),
fe as (select x.doc, x.sec, x.i, least(coalesce(any_value(x.nl), any_value(x.last) + 1) - 1, max(y.i)) as e from sl x join sl y on y.doc = x.doc and y.sec = x.sec and y.i >= x.i and (y.i = x.i or y.cum - x.cum + x.need <= x.b) group by x.doc, x.sec, x.i),
ov as (select x.doc, x.sec, x.i as e, min(y.i) as t, max(x.cum - y.cum + y.need) as w from sl x join sl y on y.doc = x.doc and y.sec = x.sec and y.i <= x.i and x.cum - y.cum + y.need <= {overlap} group by x.doc, x.sec, x.i),
nx as (select f.doc, f.sec, f.i, f.e, n.i is not null and length(n.t) > n.b as cut, case when n.i is null then null when length(n.t) > n.b then f.e + 2 when ov.t is null or ov.w + n.need > n.b then f.e + 1 else ov.t end as next
  from fe f left join sl n on n.doc = f.doc and n.sec = f.sec and n.i = f.e + 1 left join ov on ov.doc = f.doc and ov.sec = f.sec and ov.e = f.e),
wk as (select doc, sec, i, e, cut, next from nx where i = 1 union all select nx.doc, nx.sec, nx.i, nx.e, nx.cut, nx.next from wk join nx on nx.doc = wk.doc and nx.sec = wk.sec and nx.i = wk.next),
pa as (select wk.doc, wk.sec, wk.i, 0 as p, any_value(title) as title, any_value(prefix) as prefix, string_agg(t, ' ' order by sl.i) as body from wk join sl on sl.doc = wk.doc and sl.sec = wk.sec and sl.i between wk.i and wk.e group by wk.doc, wk.sec, wk.i
  union all select wk.doc, wk.sec, wk.i, 1 + o, title, prefix, trim(substring(t, o + 1, b), ' ' || chr(9) || chr(10)) from (select wk.doc, wk.sec, wk.i, title, prefix, t, b, unnest(range(0, length(t), b)) as o from wk join sl on sl.doc = wk.doc and sl.sec = wk.sec and sl.i = wk.e + 1 where wk.cut) wk),
ck as (select doc, cast(row_number() over (partition by doc order by sec, i, p) - 1 as int) as chunk_id, title as section, prefix || body as text from pa where body <> '')"""


@query(f"with recursive so as (select doc_id as doc, 0 as sec, '' as title, {SENTENCES} as s from documents), {packing(C.SIZE, C.OVERLAP)} select doc as doc_id, chunk_id, section, cast(length(text) as int) as n_chars, sha256(text) as text_sha256 from ck")
def chunk_pack(spark, sf_dir):
    out = C.chunk(corpus(spark, sf_dir), id_col="ord")
    return out.select("doc_id", "chunk_id", "section", F.length("text").alias("n_chars"), sha(F.col("text")).alias("text_sha256"))


@query(f"""with recursive sc as (select conv_id, turn, role as title, {STRIPPED} as text from conversations union all select distinct conv_id, -1, '', 'An intro.' from conversations),
so as (select conv_id as doc, turn as sec, title, {SENTENCES} as s from sc where text <> ''), {packing(200, 50)} select doc || '#' || chunk_id as key, section, cast(length(text) as int) as n_chars from ck""")
def chunk_keys(spark, sf_dir):
    out = C.chunk(markdown(spark, sf_dir), 200, 50, id_col="conv_id")
    return out.select(C.chunk_key(F.col("doc_id"), F.col("chunk_id")).alias("key"), "section", F.length("text").alias("n_chars"))


@query(ORACLE["chunk_pack"])
def chunk_text_sql(spark, sf_dir):
    """The chunks of chunk_pack, by the table function in SQL."""
    tables.register(spark)
    sql = "select d.ord as doc_id, c.chunk_id, c.section, length(c.text) as n_chars, sha2(cast(c.text as binary), 256) as text_sha256 from {docs} d, lateral chunk_text(d.text) c"
    return spark.sql(sql, docs=corpus(spark, sf_dir))


@query(ORACLE["chunk_keys"])
def chunk_keys_sql(spark, sf_dir):
    """Those of chunk_keys likewise, with headings, a size and an overlap."""
    tables.register(spark)
    sql = "select concat(d.conv_id, '#', c.chunk_id) as key, c.section, length(c.text) as n_chars from {docs} d, lateral chunk_text(d.text, 200, 50) c"
    return spark.sql(sql, docs=markdown(spark, sf_dir))


@query("select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as part, length(substring(text, i + 1, 100)) as n_chars, sha256(substring(text, i + 1, 100)) as part_sha256 from (select doc_id, text, unnest(range(0, length(text), 100)) as i from documents)")
def forced_split(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.slices(F.col("text"), 100)).alias("part", "t"))
    return rows.select("doc_id", "part", F.length("t").cast("bigint").alias("n_chars"), sha(F.col("t")).alias("part_sha256"))


# prompts

CONTEXT = f"""cx as (select qid, string_agg('[' || rank || '] (source: ' || ord || '#0)' || chr(10) || text, chr(10) || chr(10) order by rank) as context from bm join documents on doc_id = ord where rank <= {K} group by qid)"""


def _found(spark, sf_dir) -> DataFrame:
    return fuse.with_payload(lexical.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), K), stored(spark, sf_dir)).withColumn("key", C.chunk_key(F.col("ord"), F.lit(0)))


@query(f"with {LEXICAL}, {CONTEXT} select qid, length(context) as n_chars, sha256(context) as context_sha256 from cx")
def rag_context(spark, sf_dir):
    return prompt.context(_found(spark, sf_dir)).select("qid", F.length("context").cast("bigint").alias("n_chars"), sha(F.col("context")).alias("context_sha256"))


@query(f"with {LEXICAL}, {CONTEXT} select item_id as qid, case when context is null then null else sha256('{prompt.INTRO}' || chr(10) || chr(10) || context || chr(10) || chr(10) || '{prompt.QUESTION} ' || text) end as user_sha256, case when context is null then '{prompt.NOTHING}' else trim(text) || ' [1]' end as answer from benchmark left join cx on qid = item_id")
def rag_ask(spark, sf_dir):
    from ..sources.chat import echo

    out = prompt.ask(asked(spark, sf_dir), _found(spark, sf_dir), echo)
    return out.select("qid", sha(F.col("messages")[1]["content"]).alias("user_sha256"), "answer")


# grading, on answers made of the turns

ANSWERS = """a as (select conv_id * 1000 + turn as row_id, conv_id % 3 = 0 as un, case when turn % 4 = 0 then text || ' [1]' when turn % 4 = 1 then text || ' [' || (turn + 1) || '] [2]' when turn % 4 = 2 then 'x 찾을 수 없습니다.' else coalesce(text, '') end as answer,
  case when turn % 2 = 0 then [substring(text, 1, 5), 'x'] when turn % 5 = 0 then [] else [substring(text, 1, 4)] end as gold from conversations where text is not null),
g as (select *, contains(answer, '찾을 수 없습니다') or contains(answer, '찾을수 없습니다') or contains(answer, '확인할 수 없습니다') as refused, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: cast(x as bigint)) as c from a),
r as (select row_id, un, refused, len(c) > 0 as has_cite, len(c) > 0 and coalesce(list_min(c), 0) >= 1 and coalesce(list_max(c), 9) <= 3 as cite_valid, case when un then refused end as refusal_correct, case when not un then refused end as false_refusal,
  case when not un and len(gold) > 0 then len(list_filter(gold, lambda x: contains(answer, x))) = len(gold) end as grounded from g)"""


def _graded(spark, sf_dir) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    answer = F.expr("case when turn % 4 = 0 then concat(text, ' [1]') when turn % 4 = 1 then concat(text, ' [', turn + 1, '] [2]') when turn % 4 = 2 then 'x 찾을 수 없습니다.' else text end")
    gold = F.expr("case when turn % 2 = 0 then array(substring(text, 1, 5), 'x') when turn % 5 = 0 then array() else array(substring(text, 1, 4)) end").cast("array<string>")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), answer.alias("answer"), F.lit(3).alias("n_chunks"), gold.alias("gold"), F.expr("if(conv_id % 3 = 0, 'unanswerable', 'answerable')").alias("kind"))
    return grade.grade(rows)


@query(f"with {ANSWERS} select row_id, refused, has_cite, cite_valid, coalesce(cast(refusal_correct as varchar), '-') as refusal_correct, coalesce(cast(false_refusal as varchar), '-') as false_refusal, coalesce(cast(grounded as varchar), '-') as grounded from r")
def grade_rows(spark, sf_dir):
    return _graded(spark, sf_dir).select("row_id", "refused", "has_cite", "cite_valid", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("refusal_correct", "false_refusal", "grounded")])


@query(f"""with {ANSWERS} select count(*) filter (not un) as n_answerable, count(*) filter (un) as n_unanswerable, count(grounded) as n_grounded_scored, round(avg(cast(has_cite as double)) filter (not un and not refused), 4) as cite_rate,
  round(avg(cast(cite_valid as double)) filter (not un and has_cite), 4) as cite_valid_rate, round(avg(cast(grounded as double)) filter (not un), 4) as grounded_rate, round(avg(cast(false_refusal as double)) filter (not un), 4) as false_refusal_rate, round(avg(cast(refusal_correct as double)) filter (un), 4) as refusal_recall from r""")
def grade_summary(spark, sf_dir):
    return grade.summarize(_graded(spark, sf_dir))


# supervised data

PAIRS = r"""p as (select item_id, text as chunk, case item_id % 8 when 0 then '' when 1 then 'why' else 'what does it say' end as question,
  case item_id % 8 when 2 then repeat('long ', 100) when 3 then 'no citation' when 4 then 'odd [2]' when 5 then 'The documents given do not hold this. [1]' when 6 then 'it is 98765 [1]' else 'it is so [1]' end as answer from benchmark),
v as (select item_id, case when question = '' or answer = '' then 'empty' when length(question) < 5 or length(question) > 120 then 'question length' when length(rtrim(answer)) > 400 then 'answer too long' when len(regexp_extract_all(answer, '\[([0-9]+)\]', 1)) = 0 then 'no citation'
  when len(list_filter(regexp_extract_all(answer, '\[([0-9]+)\]', 1), lambda x: x <> '1')) > 0 then 'citation of no excerpt' when contains(answer, 'The documents given do not hold this.') then 'refusal' when contains(answer, '98765') and not contains(chunk, '98765') then 'number not in chunk(98765)' end as reason from p)"""


def _pairs(spark, sf_dir) -> DataFrame:
    q = "case item_id % 8 when 0 then '' when 1 then 'why' else 'what does it say' end"
    a = "case item_id % 8 when 2 then repeat('long ', 100) when 3 then 'no citation' when 4 then 'odd [2]' when 5 then 'The documents given do not hold this. [1]' when 6 then 'it is 98765 [1]' else 'it is so [1]' end"
    return read(spark, sf_dir, "benchmark").select("item_id", sft.reject_reason(F.expr(q), F.expr(a), F.col("text")).alias("reason"))


@query(f"with {PAIRS} select item_id, reason from v")
def qa_validate(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"with {PAIRS} select string_split(reason, '(')[1] as reason, count(*) as n from v where reason is not null group by 1")
def qa_reject_tally(spark, sf_dir):
    return sft.reject_tally(_pairs(spark, sf_dir))


@query("""with n as (select event_id, json('[3, ' || props || ', null, [1], {"event": ' || event_id || '}]') as j from events),
x as (select event_id, unnest(from_json(j, '["JSON"]')) as o from n)
select event_id, count(*) as n_objects, cast(sum(cast(o->>'$.k' as bigint)) as bigint) as k, cast(sum(cast(o->>'$.event' as bigint)) as bigint) as event from x where json_type(o) = 'OBJECT' group by event_id""")
def json_array_extract(spark, sf_dir):
    """Objects of the array within a noisy reply; numbers, null and a nested list are left out."""
    noisy = F.concat(F.lit("Sure: ```json\n[3, "), "props", F.lit(', null, [1], {"event": '), "event_id", F.lit("}]``` done."))
    rows = read(spark, sf_dir, "events").select("event_id", wire.json_objects(noisy).alias("o"))
    field = lambda name: F.aggregate("o", F.lit(0).cast("bigint"), lambda t, x: t + F.coalesce(F.get_json_object(x, f"$.{name}").cast("bigint"), F.lit(0))).alias(name)
    return rows.select("event_id", F.size("o").cast("bigint").alias("n_objects"), field("k"), field("event"))


def _samples(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("about "), "lang", F.lit("?")).alias("question"), F.array("text", "source").alias("context"), F.lit("so [1]").alias("answer"), F.lit("answerable").alias("kind"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("gold"))


@query(f"select doc_id, sha256('Excerpts found:' || chr(10) || chr(10) || '[1] ' || text || chr(10) || chr(10) || '[2] ' || source || chr(10) || chr(10) || '{prompt.QUESTION} about ' || lang || '?') as user_sha256, 'answerable' as kind, case when doc_id % 2 = 0 then lang end as gold, 3::bigint as n_messages from documents")
def sft_chat_rows(spark, sf_dir):
    out = sft.chat_rows(_samples(spark, sf_dir), with_gold=True)
    return out.select("doc_id", sha(F.col("messages")[1]["content"]).alias("user_sha256"), "kind", F.col("gold")[0].alias("gold"), F.size("messages").cast("bigint").alias("n_messages"))


@query("select is_eval, count(*) as n, cast(sum(doc_id) as bigint) as ids from (select doc_id, (doc_id * 7919 % 1000) / 1000.0 < 0.2 as is_eval from documents) group by is_eval")
def sft_split(spark, sf_dir):
    out = sft.split(_samples(spark, sf_dir), "doc_id", draw=lambda c: F.pmod(c * 7919, F.lit(1000)) / F.lit(1000.0))
    return out.groupBy("is_eval").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""with d as (select doc_id, trim(substring(string_split({STRIPPED}, chr(10))[1], 1, 60), ' ') as topic, row_number() over (order by doc_id) - 1 as n from documents qualify n <= 20),
j as (select a.doc_id, b.doc_id as context_doc, a.topic, a.n from d a join d b on b.n = (a.n + 1) % (select count(*) from d) where a.topic <> '' order by a.n limit 20)
select doc_id, context_doc, 'Tell me about ' || topic || '.' as question from j""")
def sft_unanswerable(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_id"), "text")
    return sft.unanswerable(chunks, 20, order=lambda c: c).select("doc_id", "context_doc", "question")


def _replies(spark, sf_dir) -> DataFrame:
    """A teacher's reply for each turn: a valid pair, or one with a number that the turn lacks, and a second pair, every third time too short."""
    turns = read(spark, sf_dir, "conversations").where("text <> ''")
    first = F.when(F.col("conv_id") % 5 == 0, "it is 98765 [1]").otherwise("it is so [1]")
    second = F.when(F.col("turn") % 3 == 0, "why").otherwise("what else is said")
    reply = F.concat(F.lit('Here: [{"question": "what is it", "answer": "'), first, F.lit('"}, 7, {"question": " '), second, F.lit('", "answer": "that [1]"}] Done.'))
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "text", reply.alias("reply"))


@query(f"""with un as (select d, c, text, row_number() over (order by k, d, c) - 1 < greatest(1, cast(floor(count(*) over () * 0.2::double) as bigint)) as e from (select conv_id as d, turn as c, text, (conv_id * 1000 + turn) * 7919 % 1000003 as k from conversations where text <> '')),
ok as (select d, c, e, 'what is it' as question, text, 'it is so [1]' as answer from un where d % 5 <> 0 union all select d, c, e, 'what is it', text, 'it is 98765 [1]' from un where d % 5 = 0 and contains(text, '98765') union all select d, c, e, 'what else is said', text, 'that [1]' from un where c % 3 <> 0),
nn as (select e, cast(floor(count(*) * 0.2::double / 0.8::double) as bigint) as want from ok group by e),
tp as (select *, trim(substring(string_split({STRIPPED}, chr(10))[1], 1, 60), ' ') as topic from un),
dc as (select e, d, min_by(topic, c) filter (topic <> '') as topic, min_by(text, c) as t1, max_by(text, c) as t2, min(c) as c1, max(c) as c2 from tp group by e, d),
pl as (select dc.*, want, row_number() over (partition by e order by d * 1000 * 7919 % 1000003, d) - 1 as n from dc join nn using (e) qualify n <= want),
mm as (select *, count(*) over (partition by e) as m, count(topic) over (partition by e) as askers from pl),
lp as (select *, unnest(range(0, cast(ceil(want::double / askers) as bigint))) as lap from mm where m > 1 and topic is not null),
pk as (select *, (n + 1 + lap % (m - 1)) % m as at, row_number() over (partition by e order by lap * m + n) as p from lp qualify p <= want)
select e as is_eval, 'answerable' as kind, d as doc_id, question, sha256(text) as context_sha256, answer from ok
union all select pk.e, 'unanswerable', pk.d, 'Tell me about ' || pk.topic || '.', sha256(case when x.c1 = x.c2 then x.t1 else x.t1 || '|' || x.t2 end), '{sft.REFUSAL}' from pk join mm x on x.e = pk.e and x.n = pk.at""")
def sft_build(spark, sf_dir):
    """The whole build from replies to both sets; chunks are put in an order that SQL knows too."""
    order = lambda d, *c: F.pmod((d * 1000 + (c[0] if c else 0)) * 7919, F.lit(1000003))
    out = sft.build(_replies(spark, sf_dir), order=order)
    return out.select("is_eval", "kind", "doc_id", "question", sha(F.array_join("context", "|")).alias("context_sha256"), "answer")


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 32 as batch from documents")
def fixed_batches(spark, sf_dir):
    return sft.batched(read(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")


CODES = "list_transform(string_split(coalesce(text, ''), ''), lambda x: cast(unicode(x) as int))"
ENCODED = f"""e as (select conv_id, turn, pr, an, case when len(pr) + len(an) > 64 then 64 else len(pr) + len(an) end as width, greatest(0, least(64, len(pr) + len(an)) - len(an)) as masked from (
  select u.conv_id, u.turn, {CODES.replace('text', 'u.text')} as pr, list_concat({CODES.replace('text', 'b.text')}, [0]) as an from conversations u join conversations b on b.conv_id = u.conv_id and b.turn = u.turn + 1 where u.role = 'user' and b.role = 'assistant' and u.text <> '' and b.text <> ''))"""


def _encoded(spark, sf_dir) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text <> ''")
    codes = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    said = turns.where("role = 'user'").select("conv_id", "turn", codes(F.col("text")).alias("pr"))
    back = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat(codes(F.col("text")), F.array(F.lit(0))).alias("an"))
    return said.join(back, ["conv_id", "turn"]).select("conv_id", "turn", sft.labelled(F.col("pr"), F.col("an"), 64).alias("x")).select("conv_id", "turn", "x.*")


@query(f"with {ENCODED} select conv_id, turn, cast(width as bigint) as width, cast(masked as bigint) as masked, cast(list_sum(list_concat(pr, an)[-64:]) as bigint) as ids, cast(list_sum(an[-64:]) as bigint) - 100 * masked as labels from e")
def label_mask(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda t, x: t + x)
    return _encoded(spark, sf_dir).select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("width"), (F.size("labels") - sft.supervised(F.col("labels"))).cast("bigint").alias("masked"), total("input_ids").alias("ids"), total("labels").alias("labels"))


@query(f"with {ENCODED}, w as (select conv_id, turn, width, max(width) over (partition by conv_id % 16) as most from e) select conv_id, turn, cast(most as bigint) as padded, cast(width as bigint) as attended from w")
def collate_pad(spark, sf_dir):
    out = sft.collate(_encoded(spark, sf_dir).withColumn("batch", F.pmod("conv_id", F.lit(16))))
    return out.where((F.size("labels") == F.size("input_ids")) & (F.size("attention") == F.size("input_ids"))).select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("padded"), F.aggregate("attention", F.lit(0).cast("bigint"), lambda t, x: t + x).alias("attended"))


# serving

REQUESTS = "q as (select event_type as concurrency, value is not null and event_id % 50 <> 0 as ok, abs(value) / 10 as ttft, abs(value) as latency, event_id % 97 as num_tokens from events)"


@query(f"""with {REQUESTS}, t as (select *, case when num_tokens > 1 then (latency - ttft) / (num_tokens - 1) else 0 end as tpot from q)
select concurrency, count(*) filter (ok) as n_ok, count(*) filter (not ok) as n_failed, round_even(count(*) filter (ok) / 60.0::double, 3) as req_per_s,
  round_even(sum(num_tokens) filter (ok) / 60.0::double, 1) as tok_per_s,
  round_even(quantile_cont(ttft, 0.5) filter (ok) * 1000, 1) as ttft_p50_ms, round_even(quantile_cont(ttft, 0.95) filter (ok) * 1000, 1) as ttft_p95_ms,
  round_even(quantile_cont(tpot, 0.5) filter (ok and tpot > 0) * 1000, 2) as tpot_p50_ms,
  round_even(quantile_cont(latency, 0.5) filter (ok), 3) as latency_p50_s, round_even(quantile_cont(latency, 0.95) filter (ok), 3) as latency_p95_s from t group by concurrency""")
def serving_stats(spark, sf_dir):
    return serving.summary(requests(spark, sf_dir)).drop("wall_s")


def requests(spark, sf_dir) -> DataFrame:
    fine = F.expr("value is not null and event_id % 50 <> 0")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("concurrency"), fine.alias("ok"), (F.abs("value") / 10).alias("ttft"), F.abs("value").alias("latency"), (F.col("event_id") % 97).alias("num_tokens"), F.lit(60.0).alias("wall"))


@query("""with l as (select event_type as level, value from events union all select 'all', value from events)
select level, q, round(case q when 0.5 then p[1] when 0.95 then p[2] else p[3] end, 9) as value
from (select level, quantile_cont(value, [0.5, 0.95, 0.999]) as p from l group by level), (values (0.5), (0.95), (0.999)) v(q)""")
def latency_quantiles(spark, sf_dir):
    """Exact quantiles of all events, and of each type of them."""
    own = read(spark, sf_dir, "events").select(F.explode(F.array("event_type", F.lit("all"))).alias("level"), "value")
    return quantiles.quantiles(own, ["level"], {"value": F.col("value")}, [0.5, 0.95, 0.999]).select("level", F.col("q").cast("decimal(4,3)").alias("q"), F.round("value", 9).alias("value"))


@query("select event_id, round(case when event_id % 7 > 1 then (abs(value) - abs(value) / 4) / (event_id % 7 - 1) else 0 end, 9) as tpot from events")
def tpot(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(serving.tpot(F.abs("value") / 4, F.abs("value"), F.col("event_id") % 7), 9).alias("tpot"))


@query("select user_id as req_id, round(coalesce(min(case when event_type <> 'view' then value end), 0), 9) as ttft, round(max(value), 9) as latency, coalesce(max(case when event_id % 11 = 0 then event_id end), count(*) filter (event_type <> 'view')) as num_tokens from events group by user_id")
def stream_measured(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("req_id"), F.col("value").alias("t"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("delta"), F.when(F.col("event_id") % 11 == 0, F.col("event_id")).alias("usage_tokens"))
    return serving.measured(rows).select("req_id", F.round("ttft", 9).alias("ttft"), F.round("latency", 9).alias("latency"), "num_tokens")


@query("select cast(row_number() over (order by doc_id) - 1 as bigint) as row_id, doc_id, sha256(coalesce(text, '')) as answer_sha256 from documents")
def paired_predictions(spark, sf_dir):
    """Rows and answers written as JSON lines in several files, and paired by their places in them."""
    path = f"{shared_dir(spark)}/lodespark/pairs-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("answer"))
    docs = docs.repartitionByRange(max(4, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id")  # as many files as the input has parts
    files.write_jsonl(docs.select("doc_id"), f"{path}/rows")
    files.write_jsonl(docs.select("answer"), f"{path}/predictions")
    both = grade.paired(files.numbered_lines(spark, f"{path}/rows"), files.numbered_lines(spark, f"{path}/predictions"))
    return both.select("row_id", F.get_json_object("row", "$.doc_id").cast("bigint").alias("doc_id"), sha(F.get_json_object("prediction", "$.answer")).alias("answer_sha256"))


# events of a stream


@query("""with w as (select conv_id * 1000 + turn as req_id, turn % 5 = 4 as bad, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') as d from conversations)
select req_id, len(d) + 2 as n_events, case when bad then 'error' else 'done' end as last_event, sha256('sources' || repeat(',token', cast(len(d) as int)) || case when bad then ',error' else ',done' end) as events_sha256 from w""")
def sse_events(spark, sf_dir):
    """The events of each answer in order: sources, a token for each word, and an error or the end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    sources = F.array(F.struct(F.lit("k").alias("key"), F.lit(None).cast("int").alias("dense_rank")))
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), words.alias("deltas"), sources.alias("sources"), F.when(F.col("turn") % 5 == 4, F.lit("lost")).alias("error"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"])
    out = prompt.events(rows).groupBy("req_id").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event", "seq").alias("last_event"), order.alias("events"))
    return out.select("req_id", "n_events", "last_event", sha(F.array_join("events", ",")).alias("events_sha256"))


@query("select conv_id, turn, 2::bigint as n_deltas, sha256(text || '!') as text_sha256 from conversations where text <> ''")
def sse_decode(spark, sf_dir):
    chunk = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    body = F.concat(F.lit(': ping\n\ndata: {"choices":[]}\n\n'), chunk(F.col("text")), F.lit('data: {"choices":[{"delta":{}}]}\n\n'), chunk(F.lit("!")), F.lit("data: [DONE]\n\n"), chunk(F.lit("after")))
    rows = read(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", wire.sse_deltas(body).alias("d"))
    return rows.select("conv_id", "turn", F.size("d").cast("bigint").alias("n_deltas"), sha(F.array_join("d", "")).alias("text_sha256"))


# requests and uploads

BAD = "case when length(url) < 1 then 'query' when page_id % 60 < 1 or page_id % 60 > 50 then 'top_k' when not regexp_matches(case page_id % 4 when 0 then 'hybrid' when 1 then 'dense' when 2 then 'bm25' else 'fuzzy' end, '^(hybrid|dense|bm25)$') then 'mode' end"


@query(f"select page_id, {BAD} as problem, case when page_id % 3 = 0 then 5 else cast(page_id % 3 as int) end as top_k from pages")
def request_validation(spark, sf_dir):
    mode = F.expr("case page_id % 4 when 0 then 'hybrid' when 1 then 'dense' when 2 then 'bm25' else 'fuzzy' end")
    rows = read(spark, sf_dir, "pages")
    return rows.select("page_id", validate.problem(F.col("url"), F.col("page_id") % 60, mode).alias("problem"), validate.top_k_or_default((F.col("page_id") % 3).cast("int"), 5).alias("top_k"))


@query("select page_id, case when page_id % 4 > 1 then 415 else 200 end as status, case page_id % 4 when 0 then null when 1 then null when 2 then 'image/png' else null end as media, length(html) as n_chars from pages")
def suffix_filter(spark, sf_dir):
    name = F.concat("url", F.expr("case page_id % 4 when 0 then '/a.MD' when 1 then '/a.txt' when 2 then '/a.PNG' else '/a.bmp' end"))
    return read(spark, sf_dir, "pages").select("page_id", wire.upload_status(name, F.col("html").cast("binary")).alias("status"), wire.media_type(name, strict=False).alias("media"), F.length("html").cast("bigint").alias("n_chars"))


@query("select page_id, sha256('data:image/png;base64,' || base64(encode(html))) as url_sha256 from pages")
def image_data_url(spark, sf_dir):
    rows = files.image_requests(read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"), F.lit("image/png").alias("media")))
    return rows.select("page_id", sha(F.col("messages")[0]["content"][0]["image_url"]["url"]).alias("url_sha256"))


@query("select doc_id, case when length(text) > 120 then substring(replace(text, chr(10), ' '), 1, 120) || '…' else replace(text, chr(10), ' ') end as preview from documents")
def search_preview(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


# the index


@query(f"with {LEXICAL} select qid, ord, score, rank from bm where rank <= {K}")
def index_roundtrip(spark, sf_dir):
    """Postings and lengths written as tables and read back."""
    path = f"{shared_dir(spark)}/lodespark/index-{uuid.uuid4().hex}"
    docs, terms = corpus(spark, sf_dir), lexical.query_terms(asked(spark, sf_dir))
    lexical.all_postings(docs).write.parquet(f"{path}/postings")
    lexical.lengths(docs).write.parquet(f"{path}/lengths")
    posts, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    wanted = posts.join(small(terms.select("tok").distinct()), "tok", "left_semi")
    return lexical.ranked(lexical.best(terms, lexical.terms(wanted, stats), lexical.weighted(wanted, stats), K), K)


def indexed_sql(k: int) -> str:
    """Both rankings and their fusion over chunks: the tables of the searches above, with chunks for documents."""
    lexical_part = LEXICAL.replace("select doc_id as ord, ", "select ord, ").replace("from documents", "from cn")
    dense_part = DENSE.replace("select 'd' as side, doc_id as id, lower(coalesce(text, '')) as t from documents", "select 'd' as side, ord as id, lower(coalesce(text, '')) as t from cn")
    return f"""with recursive so as (select doc_id as doc, 0 as sec, '' as title, {SENTENCES} as s from documents), {packing(C.SIZE, C.OVERLAP)},
cn as (select doc * 1000000 + chunk_id as ord, text from ck), {lexical_part}, {dense_part},
fu as (select qid, ord, sum(1.0::double / (60 + rank)) as score, max(rank) filter (ranker = 'dense') as dense_rank, max(rank) filter (ranker = 'bm25') as bm25_rank
  from (select qid, ord, rank, 'dense' as ranker from de where rank <= {4 * k} union all select qid, ord, rank, 'bm25' from bm where rank <= {4 * k}) group by qid, ord),
ra as (select *, row_number() over (partition by qid order by round(score, 12) desc, dense_rank nulls last, bm25_rank nulls last) as rank from fu)
select qid, cast(rank as int) as rank, sha256(text) as text_sha256, round(score, 9) as score, coalesce(dense_rank, 0) as dense_rank, coalesce(bm25_rank, 0) as bm25_rank from ra join cn using (ord) where rank <= {k}"""


@query(indexed_sql(K))
def incremental_append(spark, sf_dir):
    """Documents indexed in two batches, compacted, and searched with both rankings. Equal texts are known by their digest."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    own = index.Index(spark, f"{shared_dir(spark)}/lodespark/index-{uuid.uuid4().hex}")
    for part in (0, 1):
        own.add(docs.where(F.pmod(F.crc32("doc_id"), F.lit(2)) == part))
    own.compact()
    own.vacuum(0)
    out = own.search(asked(spark, sf_dir), K)
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "bm25_rank")]
    return out.select("qid", "rank", sha(F.col("text")).alias("text_sha256"), F.round("score", 9).alias("score"), *ranks)
