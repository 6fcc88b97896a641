"""Queries on chat data, splits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import finetune as f
from .registry import Registry, read

R = Registry()
SYSTEM = "당신은 재난·안전 안내 도우미입니다."
# The shares of the question types.
WEIGHTS = {"수치법령형": 0.20, "절차형": 0.35, "안전판단형": 0.28, "복합추론형": 0.17}


@R.query(f"""
select id, loaded_at, md5('system: {SYSTEM}' || chr(10) || 'user: ' || coalesce(question, '') || chr(10) || 'assistant: ' || coalesce(gold_answer, '')) as chat_md5 from qa_dataset
""")
def sft_messages(spark: SparkSession, d: str) -> DataFrame:
    messages = f.chat(F.lit(SYSTEM), F.col("question"), F.col("gold_answer"))
    return read(spark, d, "qa_dataset").select("id", "loaded_at", F.md5(f.rendered(messages)).alias("chat_md5"))


_FIRST = "coalesce(list_filter(messages, lambda m: lower(m.role) = '{0}')[1].content, '')"


@R.query(f"select item_id, loaded_at, {_FIRST.format('user')} as first_user, {_FIRST.format('assistant')} as first_assistant from ft_dataset")
def first_by_role(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return read(spark, d, "ft_dataset").select("item_id", "loaded_at", f.first_by_role(m, "user").alias("first_user"), f.first_by_role(m, "assistant").alias("first_assistant"))


@R.query("select item_id, loaded_at, md5(array_to_string(list_transform(messages, lambda m: lower(m.role) || ': ' || coalesce(m.content, '')), chr(10))) as template_md5 from ft_dataset")
def chat_template(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "ft_dataset").select("item_id", "loaded_at", F.md5(f.rendered(F.col("messages"))).alias("template_md5"))


_U = "(('0x' || substring(md5('42:' || cast({0} as varchar)), 1, 8))::bigint::double / 4294967296.0)"


@R.query(f"select doc_id, case when {_U.format('doc_id')} < 0.05 then 'valid' else 'train' end as split from documents")
def hash_split_95_5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", f.split_by_hash(F.col("doc_id")).alias("split"))


@R.query(f"select doc_id, case when u < 0.20 then '수치법령형' when u < 0.55 then '절차형' when u < 0.83 then '안전판단형' else '복합추론형' end as q_type from (select doc_id, {_U.format('doc_id')} as u from documents)")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", f.weighted_choice(F.col("doc_id"), WEIGHTS).alias("q_type"))


@R.query("""
with p as (select doc_id, row_number() over (order by md5('42:' || cast(doc_id as varchar))) as place, count(*) over () as n from documents)
select doc_id, place, case when place <= floor(0.8 * n) then 'train' else 'test' end as part from p
""")
def permute_80_20(spark: SparkSession, d: str) -> DataFrame:
    return f.leading_share(read(spark, d, "documents").select("doc_id"), "doc_id")


@R.query("select 'kb' as origin, page_id as id, page_content as text from kb_documents union all select 'chunk', chunk_id, text from chunks")
def union_append(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "kb_documents").select(F.lit("kb").alias("origin"), F.col("page_id").alias("id"), F.col("page_content").alias("text"))
    chunks = read(spark, d, "chunks").select(F.lit("chunk").alias("origin"), F.col("chunk_id").alias("id"), "text")
    return pages.unionByName(chunks)


@R.query("select source_file from qa_dataset intersect select source_file from kb_documents")
def intersect_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "qa_dataset").select("source_file").intersect(read(spark, d, "kb_documents").select("source_file"))


@R.query("select result_id, loaded_at, model, condition from experiment_results where not (coalesce(starts_with(pred_answer, 'ERROR'), false) and model = 'llama31')")
def predicate_delete(spark: SparkSession, d: str) -> DataFrame:
    bad = t.is_error_answer(F.col("pred_answer")) & (F.col("model") == "llama31")
    return read(spark, d, "experiment_results").filter(~bad).select("result_id", "loaded_at", "model", "condition")


@R.query("""
select result_id, loaded_at, 'v' || case when condition like 'ft%' then '2' else '1' end as shape, coalesce(nullif(pred_answer, ''), '') as answer_text, coalesce(q_type, '') as question_type from experiment_results
""")
def canonical_schema(spark: SparkSession, d: str) -> DataFrame:
    """Records of two shapes with other field names, brought to one."""
    e = read(spark, d, "experiment_results")
    v1 = e.filter(~F.col("condition").like("ft%")).select("result_id", "loaded_at", F.lit("v1").alias("shape"), "pred_answer", "q_type")
    v2 = e.filter(F.col("condition").like("ft%")).select("result_id", "loaded_at", F.lit("v2").alias("shape"), F.col("pred_answer").alias("answer"), F.col("q_type").alias("question_type"))
    both = v1.unionByName(v2, allowMissingColumns=True)
    return both.select(
        "result_id", "loaded_at", "shape",
        t.falsy_coalesce(F.col("answer"), F.col("pred_answer"), F.lit("")).alias("answer_text"),
        F.coalesce("question_type", "q_type", F.lit("")).alias("question_type"),
    )
