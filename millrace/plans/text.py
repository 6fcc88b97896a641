"""Queries on projections, chunking and string scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking
from ..operators.layout import spread
from .registry import Registry, read, sql_strip, values

R = Registry()


def _fold_sql(table: str, key: str, text: str, size: int, overlap: int, least: int, sep: str) -> str:
    """The chunk fold as a recursive query; rows (k, n, chunk)."""
    sep_sql = "chr(10)" if sep == "\n" else "chr(10) || chr(10)"
    paras = f"list_filter(list_transform(string_split(regexp_replace({sql_strip(f'coalesce({text}, chr(32))')}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {sep_sql}), lambda x: {sql_strip('x')}), lambda x: length(x) > 0)"
    step = f"(case when length(cur) + length(ps[i]) + 1 <= {size} then cur else right(cur, {overlap}) end) || chr(10) || ps[i]"
    return f"""
with recursive d as (select {key} as k, {paras} as ps from {table}),
f as (
  select k, ps, 1 as i, '' as cur, cast(null as varchar) as emit from d
  union all
  select k, ps, i + 1,
         case when i <= len(ps) then {sql_strip(step)} else '' end,
         case when i > len(ps) or length(cur) + length(ps[i]) + 1 > {size}
              then case when length(cur) >= {least} then cur end end
  from f where i <= len(ps) + 1
)
select k, row_number() over (partition by k order by i) - 1 as n, emit as chunk from f where emit is not null"""


_PAGES = "(select page_id, max(page_content) as page_content, max(source_file) as source_file, max(disaster_type) as disaster_type from kb_documents group by page_id)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge-base pages, each once."""
    return read(spark, d, "kb_documents").groupBy("page_id").agg(*[F.max(c).alias(c) for c in ("page_content", "source_file", "disaster_type")])


@R.query(f"""
with c as ({_fold_sql("documents", "doc_id", "text", 400, 80, 80, chr(10))})
select coalesce(d.lang, '') as lang, count(*) as n_chunks, count(distinct d.doc_id) as n_docs, round(avg(length(c.chunk)), 4) as avg_len
from c join documents d on c.k = d.doc_id group by 1
""")
def chunk_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents")).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    chunks = chunking.chunk_rows(docs, ["doc_id", "lang"], "text", separator="\n")
    return chunks.groupBy("lang").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("chunk")), 4).alias("avg_len")
    )


@R.query(f"""
with c as ({_fold_sql(_PAGES, "page_id", "page_content", 400, 80, 80, chr(10) * 2)})
select k as page_id, n as chunk_no, length(chunk) as n_chars, md5(chunk) as chunk_md5 from c
""")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_rows(_pages(spark, d), ["page_id"], "page_content")
    return c.select("page_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@R.query(f"""
with c as ({_fold_sql(_PAGES, "page_id", "page_content", 600, 100, 120, chr(10) * 2)})
select k as page_id, n as chunk_no, length(chunk) as n_chars, md5(chunk) as chunk_md5 from c
""")
def chunk_ft_params(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_rows(_pages(spark, d), ["page_id"], "page_content", size=600, overlap=100, least=120)
    return c.select("page_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@R.query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunking.recursively_split(F.col("page_content"))
    return _pages(spark, d).select("page_id", F.posexplode(pieces).alias("piece_no", "piece"))


_CHUNKS = "(select chunk_id, max(text) as text, max(source_file) as source_file, max(disaster_type) as disaster_type from chunks where text is not null group by chunk_id)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").filter("text is not null")
    return c.groupBy("chunk_id").agg(*[F.max(x).alias(x) for x in ("text", "source_file", "disaster_type")])


@R.query(f"""
with p as (select *, (row_number() over (partition by disaster_type order by chunk_id) - 1) // 5 as block_no from {_CHUNKS})
select disaster_type, block_no, md5(substring(string_agg(text, chr(10) || chr(10) order by chunk_id), 1, 2000)) as context_md5,
       arg_min_null(source_file, chunk_id) as source
from p group by 1, 2
""")
def block5_context(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.block_contexts(_chunks(spark, d), "disaster_type", "chunk_id", "text", "source_file")
    return out.select("disaster_type", "block_no", F.md5("context").alias("context_md5"), "source")


@R.query(f"""
with p as (select *, row_number() over (partition by disaster_type order by chunk_id) as pos from {_CHUNKS})
select disaster_type, md5(substring(string_agg(text, chr(10) || chr(10) order by chunk_id), 1, 2000)) as context_md5 from p where pos <= 3 group by 1
""")
def first_n_context(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.first_contexts(_chunks(spark, d), "disaster_type", "chunk_id", "text")
    return out.select("disaster_type", F.md5("context").alias("context_md5"))


@R.query(f"""
select doc_id, length({sql_strip("text")}) as n_stripped, md5({sql_strip("text")}) as stripped_md5,
       len(list_filter(string_split(regexp_replace({sql_strip("text")}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: length({sql_strip("x")}) > 0)) as n_paragraphs,
       length(text) >= 80 as long_enough
from documents
""")
def text_layout(spark: SparkSession, d: str) -> DataFrame:
    s = t.strip(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id",
        F.length(s).cast("bigint").alias("n_stripped"),
        F.md5(s).alias("stripped_md5"),
        F.size(t.paragraphs(t.collapse_blank_lines(s))).cast("bigint").alias("n_paragraphs"),
        (F.length("text") >= 80).alias("long_enough"),
    )


@R.query("select doc_id, substring(text, 1, 60) as opening, right(text, 80) as ending from documents")
def prefix_suffix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", t.prefix(F.col("text"), 60).alias("opening"), t.suffix(F.col("text"), 80).alias("ending"))


@R.query(f"""
select result_id, loaded_at, length(s) as n_chars, md5(s) as answer_md5
from (select result_id, loaded_at, {sql_strip("regexp_replace(pred_answer, '(?s)<think>.*?</think>', '', 'g')")} as s from experiment_results)
""")
def strip_think(spark: SparkSession, d: str) -> DataFrame:
    s = t.strip_reasoning(F.col("pred_answer"))
    return read(spark, d, "experiment_results").select("result_id", "loaded_at", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("answer_md5"))


@R.query("select event_id, '[' || props || ', ' || props || ']' as body from events")
def bracket_extract(spark: SparkSession, d: str) -> DataFrame:
    """Lists out of replies with a fence and words around."""
    reply = F.concat(F.lit("답은 다음과 같습니다.\n```json\n["), "props", F.lit(", "), "props", F.lit("]\n```\n끝"))
    return read(spark, d, "events").select("event_id", t.first_bracketed(reply).alias("body"))


@R.query("""
select c_custkey, c_name || '|' || c_mktsegment as names, case when c_mktsegment = 'BUILDING' then 'a|b' else c_name end as addresses from customer
""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Replies with single quotes, trailing commas, lists or comma-separated text."""
    places = F.when(F.col("c_mktsegment") == "BUILDING", "['a', 'b',]").otherwise(F.concat(F.lit("'"), "c_name", F.lit(" , ,'")))
    raw = F.concat(F.lit("말머리\n```json\n{'names': '"), "c_name", F.lit(", "), "c_mktsegment", F.lit("', 'addresses': "), places, F.lit(",}\n``` 꼬리"))
    j = t.repaired_json(raw)
    return read(spark, d, "customer").select("c_custkey", F.array_join(t.string_or_list(j, "names"), "|").alias("names"), F.array_join(t.string_or_list(j, "addresses"), "|").alias("addresses"))


@R.query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.query("""
select doc_id, array_to_string(list_filter(list_transform(string_split(title, ' '), lambda x: trim(x)), lambda x: length(x) > 0), ',') as words,
       translate(title, ' ', '_') as slug from documents
""")
def csv_list(spark: SparkSession, d: str) -> DataFrame:
    words = t.csv_list(F.translate("title", " ", ","))
    return read(spark, d, "documents").select("doc_id", F.when(F.col("title").isNotNull(), F.array_join(words, ",")).alias("words"), t.underscored(F.col("title")).alias("slug"))


@R.query("select id, loaded_at, regexp_replace(question, '[^\\p{Nd}]', '', 'g') as digits, regexp_replace(question, '[\\s\\x{85}\\p{Z}\\-.]', '', 'g') as dense from qa_dataset")
def digits_only(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return read(spark, d, "qa_dataset").select("id", "loaded_at", t.digits_only(q).alias("digits"), t.without_separators(q).alias("dense"))


# The wording of the prompts.
RAG_PROMPT = "다음 문서를 참고하여 질문에 답하세요.\n\n[문서]\n{context}\n\n[질문]\n{question}\n\n[답변]"
PLAIN_PROMPT = "다음 질문에 답하세요.\n\n[질문]\n{question}\n\n[답변]"


@R.query("""
select result_id, loaded_at, md5(case when condition in ('rag', 'ft_rag')
  then '다음 문서를 참고하여 질문에 답하세요.' || chr(10) || chr(10) || '[문서]' || chr(10) || coalesce(substring(context, 1, 1500), '') || chr(10) || chr(10) || '[질문]' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || '[답변]'
  else '다음 질문에 답하세요.' || chr(10) || chr(10) || '[질문]' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || '[답변]' end) as prompt_md5
from experiment_results
""")
def prompt_by_condition(spark: SparkSession, d: str) -> DataFrame:
    with_context = t.fill_template(RAG_PROMPT, context=t.prefix(F.col("context"), 1500), question=F.col("question"))
    plain = t.fill_template(PLAIN_PROMPT, question=F.col("question"))
    prompt = F.when(F.col("condition").isin("rag", "ft_rag"), with_context).otherwise(plain)
    return read(spark, d, "experiment_results").select("result_id", "loaded_at", F.md5(prompt).alias("prompt_md5"))


@R.query("""
select result_id, loaded_at, coalesce(nullif(context, ''), nullif(pred_answer, ''), question) as first_text,
       coalesce(q_type, '기타') as q_type, round(try_cast(cast(elapsed_sec as varchar) as double), 4) as seconds,
       coalesce(starts_with(pred_answer, 'ERROR'), false) as is_error
from experiment_results
""")
def record_defaults(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "experiment_results").select(
        "result_id",
        "loaded_at",
        t.falsy_coalesce(F.col("context"), F.col("pred_answer"), F.col("question")).alias("first_text"),
        F.coalesce("q_type", F.lit("기타")).alias("q_type"),
        t.safe_round(F.col("elapsed_sec").cast("string")).alias("seconds"),
        t.is_error_answer(F.col("pred_answer")).alias("is_error"),
    )


@R.query("select event_id, case when event_type = 'click' or props is null then null else round(value, 4) end as rounded from events")
def safe_round(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text; clicks have words in their place."""
    told = F.when(F.col("event_type") == "click", "abc").otherwise(F.col("value").cast("string"))
    return read(spark, d, "events").select("event_id", t.safe_round(F.when(F.col("props").isNotNull(), told)).alias("rounded"))


@R.query("""
select id, loaded_at, length(question) as n_question from qa_dataset
where length(gold_answer) > 20 and not contains(substring(gold_answer, 1, 10), '이렇게') and length(coalesce(question, '')) > 0
""")
def qa_valid(spark: SparkSession, d: str) -> DataFrame:
    ok = t.valid_answer(F.col("gold_answer")) & t.all_present(F.col("question"), F.col("gold_answer"))
    return read(spark, d, "qa_dataset").filter(ok).select("id", "loaded_at", F.length("question").cast("bigint").alias("n_question"))


@R.query("select c_custkey, regexp_replace(c_name, '0', 'O') as patched from customer")
def replace_first(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", t.replace_first(F.col("c_name"), "0", "O").alias("patched"))
