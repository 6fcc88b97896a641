"""Queries on counts, means, rates, quotas and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import metrics as m
from ..operators import ranking
from ..operators.layout import spread
from .registry import Registry, read, values

R = Registry()
METRICS = ["faithfulness", "answer_relevancy", "context_recall"]


@R.query("select lower(regexp_extract(source_file, '\\.[^.]*$')) as ext, count(*) as n from kb_documents group by 1")
def ext_histogram(spark: SparkSession, d: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("source_file", r"\.[^.]*$", 0))
    return read(spark, d, "kb_documents").groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).orderBy("ext")


@R.query("select disaster_type, count(*) as n, cast(rank() over (order by count(*) desc) as integer) as place from chunks group by 1")
def category_counts_desc(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = read(spark, d, "chunks").groupBy("disaster_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n")))).orderBy(F.desc("n"), "disaster_type")


_EV = "select model, condition, q_type, round(elapsed_sec / 60, 4) as faithfulness, case when condition in ('rag', 'ft_rag') then round(length(context) / 1000.0, 4) end as context_recall, case when length(pred_answer) > 0 then round(length(pred_answer) / 1000.0, 4) end as answer_relevancy from experiment_results"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Three nullable numbers per result, in place of judged scores."""
    return read(spark, d, "experiment_results").select(
        "model",
        "condition",
        "q_type",
        F.round(F.col("elapsed_sec") / 60, 4).alias("faithfulness"),
        F.when(F.col("condition").isin("rag", "ft_rag"), F.round(F.length("context") / F.lit(1000.0), 4)).alias("context_recall"),
        F.when(F.length("pred_answer") > 0, F.round(F.length("pred_answer") / F.lit(1000.0), 4)).alias("answer_relevancy"),
    )


@R.query(f"with s as ({_EV}) select model, condition, {', '.join(f'round(avg(round({x}, 4)), 4) as {x}' for x in METRICS)} from s group by 1, 2")
def group_mean_round(spark: SparkSession, d: str) -> DataFrame:
    return m.group_means(_scores(spark, d), ["model", "condition"], METRICS)


@R.query(f"with s as ({_EV}) select model, condition, count(*) as n, {', '.join(f'round(avg({x}), 4) as {x}' for x in METRICS)} from s group by 1, 2")
def nullskip_mean(spark: SparkSession, d: str) -> DataFrame:
    return m.present_means(_scores(spark, d), ["model", "condition"], METRICS)


@R.query(f"with s as ({_EV}) select model, condition, q_type, count(*) as n, {', '.join(f'round(avg({x}), 4) as {x}' for x in METRICS)} from s group by 1, 2, 3 having {' or '.join(f'count({x}) > 0' for x in METRICS)}")
def group3_having_metric(spark: SparkSession, d: str) -> DataFrame:
    return m.present_means(_scores(spark, d), ["model", "condition", "q_type"], METRICS, only_with_values=True)


@R.query(f"with s as ({_EV}) " + " union all ".join(f"select '{x}' as metric, round(avg(case when {x} is null then 1.0 else 0.0 end), 6) as null_rate, avg(case when {x} is null then 1.0 else 0.0 end) > 0.1 as flagged from s" for x in METRICS))
def null_rate(spark: SparkSession, d: str) -> DataFrame:
    return m.null_rates(_scores(spark, d), METRICS)


@R.query(f"""with s as ({_EV}), p as (select model, {', '.join(f"round(avg(answer_relevancy) filter (where condition = '{c}'), 4) as {c}" for c in ("no_rag", "rag", "ft_only", "ft_rag"))} from s group by 1)
select *, round(rag - no_rag, 4) as delta from p""")
def pivot_delta(spark: SparkSession, d: str) -> DataFrame:
    return m.pivot_delta(_scores(spark, d), "model", "condition", "answer_relevancy", "rag", "no_rag", ["no_rag", "rag", "ft_only", "ft_rag"])


@R.query(f"with s as ({_EV}) select count(*) as n, round(avg(faithfulness), 4) as faithfulness from s where model = 'exaone' and condition = 'rag' and q_type = '절차형'")
def slice_avg(spark: SparkSession, d: str) -> DataFrame:
    one = _scores(spark, d).filter((F.col("model") == "exaone") & (F.col("condition") == "rag") & (F.col("q_type") == "절차형"))
    return one.agg(F.count("*").alias("n"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"))


TYPES = ["수치법령형", "절차형", "안전판단형", "복합추론형", "기타"]


@R.query(f"""
with dom as (select unnest({TYPES}) as question_type), c as (select question_type, count(*) as n from ft_dataset group by 1),
j as (select dom.question_type, coalesce(n, 0) as n from dom left join c using (question_type))
select question_type, n, round(case when sum(n) over () > 0 then 100.0 * n / sum(n) over () else 0.0 end, 2) as pct from j
""")
def pct_distribution_fixed_domain(spark: SparkSession, d: str) -> DataFrame:
    return ranking.percentages(read(spark, d, "ft_dataset"), "question_type", TYPES)


_QA = "(select id, max(disaster_type) as disaster_type, max(type) as type from qa_dataset group by id)"


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "qa_dataset").groupBy("id").agg(F.max("disaster_type").alias("disaster_type"), F.max("type").alias("type"))


@R.query(f"select id, disaster_type from (select *, row_number() over (partition by disaster_type order by id) as pos from {_QA}) where pos <= 10")
def per_group_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_n(_qa(spark, d), ["disaster_type"], ["id"], 10).select("id", "disaster_type")


# How many questions each category is to give, and the order of categories.
TARGETS = {"지진": 12, "화재": 12, "황사": 8, "화학사고재난": 8, "미세먼지": 6, "감염병예방": 6, "강풍": 5, "산불": 5, "한파": 4, "대설": 4}
PRIORITY = ["황사", "미세먼지", "화재", "화학사고재난", "강풍", "지진", "감염병예방", "산불"]
ORDER = ["지진", "화재", "황사", "화학사고재난", "미세먼지", "감염병예방", "산불", "강풍", "한파", "대설"]


@R.query(f"select q.id, q.disaster_type, cast(q.pos as integer) as pos from (select *, row_number() over (partition by disaster_type order by id) as pos from {_QA}) q join {values(list(TARGETS.items()), 'disaster_type, quota')} using (disaster_type) where pos <= quota")
def quota_join(spark: SparkSession, d: str) -> DataFrame:
    quota = spark.createDataFrame(list(TARGETS.items()), "disaster_type string, quota int")
    listed = _qa(spark, d).join(F.broadcast(quota), "disaster_type")
    return ranking.first_n(listed, ["disaster_type"], ["id"], F.col("quota")).select("id", "disaster_type", "pos")


@R.query(f"""
select id, disaster_type, cast(row_number() over (order by list_position({PRIORITY}, disaster_type), id) as integer) as pos
from {_QA} where list_contains({PRIORITY}, disaster_type) order by pos limit 10
""")
def priority_quota(spark: SparkSession, d: str) -> DataFrame:
    return ranking.priority_quota(_qa(spark, d), "disaster_type", PRIORITY, "id", 10).select("id", "disaster_type", "pos")


@R.query(f"""
with o as (select id as old_id, disaster_type, row_number() over (order by list_position({ORDER}, disaster_type), id) as n from {_QA} where list_contains({ORDER}, disaster_type))
select old_id, disaster_type, 'Q' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as new_id from o
""")
def custom_order_renumber(spark: SparkSession, d: str) -> DataFrame:
    rank = F.array_position(F.lit(ORDER), F.col("disaster_type"))
    listed = _qa(spark, d).withColumn("_all", F.lit(1)).withColumn("_p", rank).filter("_p > 0")
    listed = listed.withColumn("_o", F.struct("_p", "id"))
    placed = ranking.numbered(listed, ["_all"], "_o", F.concat(F.format_string("%03d", F.col("_p").cast("int")), F.substring("id", 1, 3)), "n")
    return placed.select(F.col("id").alias("old_id"), "disaster_type", t.numbered_id(F.col("n")).alias("new_id"))


@R.query(f"select id, disaster_type, type from {_QA} order by id limit 5")
def limit_preview(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).orderBy("id").limit(5)


_KW = "list_transform(regexp_extract_all(coalesce(gold_answer, ''), '[가-힣]{2,}|[0-9]+'), lambda x: case when contains(coalesce(pred_answer, ''), x) then 1 else 0 end)"


@R.query(f"select result_id, loaded_at, case when len(h) > 0 then round(list_sum(h) / len(h), 4) else 0.0 end as kw_recall from (select result_id, loaded_at, {_KW} as h from experiment_results)")
def kw_recall(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "experiment_results")).select("result_id", "loaded_at", t.keyword_recall(F.col("gold_answer"), F.col("pred_answer")).alias("kw_recall"))


@R.query(f"select model, condition, round(avg(case when len(h) > 0 then round(list_sum(h) / len(h), 4) else 0.0 end), 4) as kw_recall from (select model, condition, {_KW} as h from experiment_results) group by 1, 2")
def kw_recall_by_cell(spark: SparkSession, d: str) -> DataFrame:
    scored = spread(read(spark, d, "experiment_results")).withColumn("kw_recall", t.keyword_recall(F.col("gold_answer"), F.col("pred_answer")))
    return m.group_means(scored, ["model", "condition"], ["kw_recall"])


def _rouge_sql(table: str, said: str, wanted: str, keys: str) -> str:
    return f"""
with recursive d as (select {keys}, {wanted} as gold, {said} as pred, md5(coalesce({wanted}, '') || chr(1) || coalesce({said}, '')) as h from {table}),
p as (select distinct h, regexp_extract_all(lower(coalesce(gold, '')), '[a-z0-9]+') as a, regexp_extract_all(lower(coalesce(pred, '')), '[a-z0-9]+') as b from d),
l as (
  select h, a, b, 0 as i, list_transform(range(0, len(b) + 1), lambda x: 0) as row from p
  union all
  select h, a, b, i + 1,
    list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [j])),
      lambda acc, j: list_append(acc, case when b[j[1]] = a[i + 1] then row[j[1]] + 1 else greatest(row[j[1] + 1], acc[len(acc)]) end))
  from l where i < len(a)
),
r as (select h, case when len(a) + len(b) > 0 then round(2.0 * row[len(row)] / (len(a) + len(b)), 4) else 0.0 end as rouge_l from l where i = len(a))
select {keys}, rouge_l from d join r using (h)
"""


@R.query(_rouge_sql("experiment_results", "pred_answer", "gold_answer", "result_id, loaded_at"))
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    e = spread(read(spark, d, "experiment_results"))
    return e.select("result_id", "loaded_at", m.rouge_l(F.col("pred_answer"), F.col("gold_answer")).alias("rouge_l"))


@R.query(_rouge_sql("qa_dataset", "question", "gold_answer", "id, loaded_at"))
def rouge_l_short(spark: SparkSession, d: str) -> DataFrame:
    """Questions, whose tokens are few, against their answers."""
    q = spread(read(spark, d, "qa_dataset"))
    return q.select("id", "loaded_at", m.rouge_l_short(F.col("question"), F.col("gold_answer")).alias("rouge_l"))


_W = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[가-힣]{{2,}}|[a-z]{{2,}}|[0-9]+'))"


def _share(of: str, within: str) -> str:
    return f"case when len({of}) > 0 then round(len(list_intersect({of}, {within})) / len({of}), 4) end"


@R.query(f"""
with w as (select result_id, loaded_at, {_W.format("pred_answer")} as a, {_W.format("context")} as c, {_W.format("question")} as q, {_W.format("gold_answer")} as g from experiment_results)
select result_id, loaded_at, {_share("a", "c")} as faithfulness_proxy, {_share("q", "a")} as answer_relevancy_proxy, {_share("g", "c")} as context_recall_proxy, {_share("c", "g")} as context_precision_proxy from w
""")
def judge_proxies(spark: SparkSession, d: str) -> DataFrame:
    e = spread(read(spark, d, "experiment_results"))
    scored = m.overlap_proxies(e, "pred_answer", "context", "question", "gold_answer", r"[가-힣]{2,}|[a-z]{2,}|\d+")
    return scored.select("result_id", "loaded_at", "faithfulness_proxy", "answer_relevancy_proxy", "context_recall_proxy", "context_precision_proxy")
