"""Queries on vectors, search, joins and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as v
from ..operators import retrieval as r
from .registry import WS, Registry, read, sql_strip, values

R = Registry()
#: The stated query set of a search: every row whose id this divides.
EVERY = 20


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("v"), "label")


def _queries(e: DataFrame) -> DataFrame:
    return e.filter(F.col("vec_id") % EVERY == 0)


_E = "(select vec_id, cast(embedding as double[]) as v, label from embeddings)"


@R.query(f"""
with e as {_E}, n as (select vec_id, v, sqrt(list_inner_product(v, v)) + 1e-9 as len from e)
select vec_id, cast(u.pos - 1 as integer) as pos, round(v[u.pos] / len, 6) as x from n, (select unnest(range(1, 65)) as pos) u
""")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.posexplode(v.l2_normalised(F.col("v"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


_TOPK = """
with e as {e}, s as (
  select q.vec_id as query_id, c.vec_id, round({score}, 9) as s from e q, e c where q.vec_id % {every} = 0 {more}
), k as (select *, row_number() over (partition by query_id order by s {dir}, vec_id) as rank from s)
select query_id, vec_id, cast(rank as integer) as rank, round(s, 6) as score from k where rank <= 3
"""


@R.query(_TOPK.format(e=_E, score="list_inner_product(q.v, c.v)", every=EVERY, more="", dir="desc"))
def topk_ip(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return r.top_k(e, _queries(e), "vec_id", "v", 3).withColumn("score", F.round("score", 6) + 0.0)


@R.query(_TOPK.format(e=_E, score="list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v)", every=EVERY, more="and q.vec_id <> c.vec_id", dir="asc"))
def topk_l2(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return r.top_k(e, _queries(e), "vec_id", "v", 3, "l2", exclude_self=True).withColumn("score", F.round("score", 6) + 0.0)


@R.query(f"""
with e as {_E}, s as (
  select q.vec_id as query_id, c.vec_id, round(list_inner_product(q.v, c.v), 9) as s from e q, e c where q.vec_id % {EVERY} = 0
), k as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from s)
select query_id, md5(substring(string_agg(t.text, chr(10) || chr(10) order by rank), 1, 1500)) as context_md5
from k join documents t on t.doc_id = k.vec_id where rank <= 3 and t.text is not null group by query_id
""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    hits = r.top_k(e, _queries(e), "vec_id", "v", 3)
    texts = read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("vec_id"), "text")
    return r.contexts(hits, texts, "vec_id", "text", 1500).select("query_id", F.md5("context").alias("context_md5"))


_KNN = f"""
e as {_E}, s as (
  select q.vec_id as query_id, c.vec_id, c.label,
         round(list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v), 9) as s
  from e q, e c where q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id
), k as (select *, row_number() over (partition by query_id order by s, vec_id) as rank from s),
votes as (select query_id, label, count(*) as n from k where rank <= 3 group by 1, 2),
best as (select *, row_number() over (partition by query_id order by n desc, label) as b from votes),
knn as (select b.query_id, e.label, b.label as predicted from best b join e on e.vec_id = b.query_id where b.b = 1)
"""


def knn(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    hits = r.top_k(e, _queries(e), "vec_id", "v", 3, "l2", exclude_self=True)
    predicted = r.knn_labels(hits, e, "vec_id", "label")
    return predicted.join(_queries(e).select(F.col("vec_id").alias("query_id"), "label"), "query_id").select("query_id", "label", "predicted")


@R.query(f"with {_KNN} select * from knn")
def knn_classify(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d)


@R.query(f"""
with {_KNN}, dom as (select unnest(range(0, 10)) as l)
select cast(a.l as integer) as label, cast(b.l as integer) as predicted, count(k.query_id) as n
from dom a cross join dom b left join knn k on k.label = a.l and k.predicted = b.l group by 1, 2
""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.range(10).select(F.col("id").cast("int").alias("label")).withColumn("predicted", F.explode(F.sequence(F.lit(0), F.lit(9))))
    counts = knn(spark, d).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return cells.join(counts, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@R.query(f"""
with {_KNN}, m as (
  select l.label, count(*) filter (where k.label = l.label) as support,
         count(*) filter (where k.label = l.label and k.predicted = l.label) as tp, count(*) filter (where k.predicted = l.label) as pred
  from (values (2), (3)) as l(label), knn k group by 1
), p as (select support, case when pred > 0 then tp / pred else 0.0 end as pr, case when support > 0 then tp / support else 0.0 end as re from m)
select round((select avg(case when label = predicted then 1.0 else 0.0 end) from knn), 6) as accuracy,
       round(sum(pr * support) / sum(support), 6) as weighted_precision, round(sum(re * support) / sum(support), 6) as weighted_recall,
       round(sum(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end * support) / sum(support), 6) as weighted_f1 from p
""")
def weighted_prf(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import weighted_scores

    return weighted_scores(knn(spark, d), "label", "predicted", [2, 3])


MODELS, CONDITIONS = ["exaone", "llama31", "qwen3"], ["no_rag", "rag"]


@R.query(f"""
select q.id, m.model, c.condition from (select distinct id from qa_dataset) q,
  (select unnest({MODELS}) as model) m, (select unnest({CONDITIONS}) as condition) c
""")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return r.grid(read(spark, d, "qa_dataset").select("id").distinct(), ("model", MODELS), ("condition", CONDITIONS))


@R.query(f"""
with g as (select q.id, m.model, c.condition from (select distinct id from qa_dataset) q,
  (select unnest({MODELS}) as model) m, (select unnest({CONDITIONS}) as condition) c)
select * from g where not exists (select 1 from experiment_results e where e.id = g.id and e.model = g.model and e.condition = g.condition)
""")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return r.remaining(experiment_grid(spark, d), read(spark, d, "experiment_results"), ["id", "model", "condition"])


@R.query("""
select distinct model, condition from experiment_results group by 1, 2
having not (count(elapsed_sec) > 0 and count(nullif(context, '')) > 0)
""")
def resume_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "experiment_results").withColumn("context", F.nullif("context", F.lit("")))
    done = r.done_groups(e, ["model", "condition"], ["elapsed_sec", "context"])
    return r.remaining(e.select("model", "condition").distinct(), done, ["model", "condition"])


@R.query(f"""
with q as (
  select {sql_strip("question")} as k, type, row_number() over (partition by {sql_strip("question")} order by loaded_at desc, id desc) as n from qa_dataset
)
select e.result_id, e.loaded_at, coalesce(q.type, '') as looked_up from experiment_results e left join q on {sql_strip("e.question")} = q.k and q.n = 1
""")
def qtype_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "experiment_results").select("result_id", "loaded_at", "question")
    q = read(spark, d, "qa_dataset").withColumn("_order", F.struct("loaded_at", "id"))
    return r.lookup(e, F.col("question"), q, "question", "type", "_order", "looked_up").select("result_id", "loaded_at", "looked_up")


@R.query("""
with o as (select model, condition, round(avg(elapsed_sec), 4) as f, round(avg(length(pred_answer)), 4) as r from experiment_results group by 1, 2),
n as (select model, condition, round(avg(elapsed_sec), 4) as f, cast(null as double) as r from experiment_results where q_type is null group by 1, 2)
select o.model, o.condition, case when o.condition = 'rag' then coalesce(n.f, o.f) else o.f end as f, o.r from o left join n on o.model is not distinct from n.model and o.condition is not distinct from n.condition
""")
def summary_update(spark: SparkSession, d: str) -> DataFrame:
    """Means by cell; those of one condition anew from the rows without a type."""
    e = read(spark, d, "experiment_results")

    def means(df: DataFrame, length: Column) -> DataFrame:
        return df.groupBy("model", "condition").agg(F.round(F.avg("elapsed_sec"), 4).alias("f"), length.alias("r"))

    old, new = means(e, F.round(F.avg(F.length("pred_answer")), 4)), means(e.filter("q_type is null"), F.lit(None).cast("double"))
    return r.updated(old, new, ["model", "condition"], ["f", "r"], F.col("condition") == "rag")


_FP = f"substring(regexp_replace(substring({{0}}, 1, {{1}}), '^{WS}+|{WS}+$', '', 'g'), 1, 60)"


def _fp(column: str, n: int) -> str:
    return _FP.replace("{0}", column).replace("{1}", str(n))


@R.query(f"""
with fp as (
  select {_fp("text", 100)} as f from eval_passages where length(text) > 30 union select {_fp("gold_answer", 80)} from qa_dataset where length(gold_answer) > 20
)
select doc_id from documents where text is not null and {_fp("text", 100)} not in (select f from fp where f is not null)
""")
def leakage_filter_prefix60(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "eval_passages").select("text", F.lit(None).cast("string").alias("gold_answer"))
    held = held.unionByName(read(spark, d, "qa_dataset").select(F.lit(None).cast("string").alias("text"), "gold_answer"))
    docs = read(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return r.without_leaks(docs, "text", held, {"text": (100, 30), "gold_answer": (80, 20)}).select("doc_id")


@R.query("select distinct disaster_type from qa_dataset q where exists (select 1 from chunks c where c.disaster_type = q.disaster_type)")
def semi_category(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "qa_dataset").select("disaster_type").distinct().join(read(spark, d, "chunks"), "disaster_type", "left_semi")


PAIRS = [("exaone", "rag"), ("qwen3", "ft_only"), ("llama31", "no_rag")]


@R.query("select result_id, loaded_at, model, condition from experiment_results where (model, condition) in (('exaone', 'rag'), ('qwen3', 'ft_only'), ('llama31', 'no_rag'))")
def tuple_filter(spark: SparkSession, d: str) -> DataFrame:
    return r.in_pairs(read(spark, d, "experiment_results"), ["model", "condition"], PAIRS).select("result_id", "loaded_at", "model", "condition")


@R.query(f"with e as {_E}, m as (select vec_id, v, list_max(v) as top from e), x as (select vec_id, v, top, list_transform(v, lambda z: exp(z - top)) as ex from m) select vec_id, cast(list_position(v, top) - 1 as bigint) as tag, round(1.0 / list_sum(ex), 6) as prob from x")
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", v.argmax(F.col("v")).cast("bigint").alias("tag"), F.round(F.array_max(v.softmax(F.col("v"))), 6).alias("prob"))
