"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import spread
from . import contamination, leakage, neardup, packing, pairs, residue, sampling, splitting, truncation
from .tables import latest, read

LIMIT, OVERLAP = 400, 80
TOKEN_LIMIT, TOKEN_OVERLAP = 256, 32
#: Capacities of containers that are to be even in attention cost too.
PLACES, COST = 16, packing.CAPACITY**2 // 2
ANSWERS = ["pred_answer", "gold_answer"]
FIELDS = {"context": None, "pred_answer": "question"}


def _items(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "kb_documents").select(F.lit("page_content").alias("item_kind"), F.col("page_id").alias("item_id"), F.col("page_content").alias("_t"))
    chunks = read(spark, d, "chunks").select(F.lit("chunk_text").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("text").alias("_t"))
    return spread(pages.unionByName(chunks))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that come out in more than one piece."""
    cut = splitting.split_items(_items(spark, d), ["item_kind", "item_id"], "_t", LIMIT, OVERLAP)
    return cut.filter("n_pieces > 1 and piece_no = 0").select("item_kind", "item_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all items."""
    return splitting.split_items(_items(spark, d), ["item_kind", "item_id"], "_t", LIMIT, OVERLAP).distinct()


def _vocabulary(spark: SparkSession) -> str:
    """The tokenizer's file, in the folder that the session names or the usual one."""
    return f"{spark.conf.get('spark.millrace.tokenizers', packing.TOKENIZERS)}/{packing.VOCABULARY}"


def p1_token_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all items, cut by tokens."""
    return splitting.split_items(_items(spark, d), ["item_kind", "item_id"], "_t", TOKEN_LIMIT, TOKEN_OVERLAP, packing.token_sizes(_vocabulary(spark))).distinct()


_PLAN = dict(key="id", labels=["disaster_type", "q_type"], order="loaded_at", plan="plan_id", share="target_share", least="min_items", size="n_items")


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "qa_dataset")


def p2_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """What each category of each plan wants, finds, gets in the sample and lacks, and why."""
    return sampling.shortfalls(_qa(spark, d).withColumnRenamed("type", "q_type"), read(spark, d, "sample_plans"), **_PLAN)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_shortfalls(spark, d).filter("n_missing > 0").select("plan_id", "disaster_type", "q_type").distinct()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled record ids of every plan."""
    return sampling.matched_sample(_qa(spark, d).withColumnRenamed("type", "q_type"), read(spark, d, "sample_plans"), **_PLAN)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    asked = _qa(spark, d).select(F.col("id").alias("key"), F.col("question").alias("text"))
    said = contamination.user_messages(read(spark, d, "ft_dataset"), "item_id", "messages")
    return contamination.contained_pairs(asked, said, 0.75).select(F.col("eval_key").alias("qa_id"), F.col("train_key").alias("item_id"), "containment")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("qa_id", "item_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by evaluation split and source: pairs, questions met, items met."""
    qa = latest(_qa(spark, d), "id", "loaded_at", ["split", "source_file"])
    return (
        _overlaps(spark, d)
        .join(qa, F.col("qa_id") == qa["id"])
        .groupBy("split", "source_file")
        .agg(F.count("*").alias("n_pairs"), F.countDistinct("qa_id").alias("n_questions"), F.countDistinct("item_id").alias("n_items"))
    )


def p4_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of every answer, numbered in the order of the rules."""
    return pairs.defective_pairs(spread(read(spark, d, "experiment_results")), "result_id", "question", ANSWERS, "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_defects(spark, d).filter("position = 0").drop("position")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class, named by its least id, and the number of other texts that its text is alike to."""
    return neardup.named_by_least(neardup.near_duplicate_groups(_qa(spark, d), "id", ["question", "gold_answer"], "loaded_at", 0.5), "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(_qa(spark, d), "id", ["question", "gold_answer"], "loaded_at", 0.5, count_links=False)
    return neardup.grouped_pairs(groups, "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(read(spark, d, "experiment_results"), "result_id", FIELDS, "loaded_at").select("result_id", "field_name")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of lost ends by field, model and condition."""
    return truncation.cut_rates(read(spark, d, "experiment_results"), "result_id", FIELDS, ["model", "condition"], "loaded_at")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return packing.token_counts(spread(read(spark, d, "documents")), "doc_id", "text", _vocabulary(spark))


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every part of a document above the capacity."""
    return packing.packed(_tokens(spark, d), "k", "n_tokens").withColumnRenamed("k", "doc_id")


def p7_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The same for containers of few documents and half the attention cost."""
    return packing.packed(_tokens(spark, d), "k", "n_tokens", places=PLACES, cost=COST).withColumnRenamed("k", "doc_id")


def p7_space(spark: SparkSession, d: str) -> DataFrame:
    """How much of the containers is used, and how few would do at least."""
    return packing.space(p7_assignment(spark, d))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The longest shared run of every leaked passage in every document, by its place there."""
    return leakage.leaks(spread(read(spark, d, "documents")), read(spark, d, "eval_passages"), "doc_id", "text", "passage_id", "text", 40)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("passage_id", "doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are or hold residue, with each kind of evidence."""
    found = residue.residue_documents(spread(read(spark, d, "documents")), "doc_id", "source", "text")
    return found.select("doc_id", F.explode("kinds").alias("kind"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(spread(read(spark, d, "documents")), "doc_id", "source", "text").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pieces, p1_token_pieces, p2_found, p2_shortfalls, p2_sample, p3_found, p3_rates, p4_found, p4_defects, p5_found, p5_classes,
            p6_found, p6_rates, p7_assignment, p7_balanced, p7_space, p8_found, p8_spans, p9_found, p9_kinds,
        )
    }


# White space of any Unicode kind.
_SPACE = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _label(column: str) -> str:
    return f"regexp_replace(split_part(nfc_normalize({column}), '_', 1), '[" + _SPACE + "]+', '', 'g')"


def _long(column: str) -> str:
    return f"length(regexp_replace({column}, '^[" + _SPACE + "]+|[" + _SPACE + "]+$', '', 'g')) > 400"


_DRAWN = f"""
with latest as (
  select id, disaster_type as a, type as b from qa_dataset where id is not null
  qualify row_number() over (partition by id order by loaded_at desc, disaster_type desc nulls last, type desc nulls last) = 1
), labelled as (
  select id, {_label("a")} as a, {_label("b")} as b from latest
), wanted as (
  select distinct plan_id, disaster_type, q_type, target_share, min_items, n_items,
         greatest(min_items, cast(floor(n_items * target_share + 0.5) as bigint)) as n_wanted
  from sample_plans
), met as (
  select w.plan_id, w.disaster_type, w.q_type, l.id,
         row_number() over (partition by w.plan_id, w.disaster_type, w.q_type order by md5('42:' || l.id), l.id) as place
  from wanted w join labelled l
    on (w.disaster_type = '*' or l.a = {_label("w.disaster_type")})
   and (w.q_type = '*' or l.b = {_label("w.q_type")})
), found as (
  select *, least(min_items, n_there) as lo, least(n_wanted, n_there) as hi
  from (select w.*, count(m.id) as n_there from wanted w left join met m using (plan_id, disaster_type, q_type) group by all)
), places as (
  select *, unnest(generate_series(1, least(n_there, n_items))) as k from found
), calls as (
  select *, case when k <= lo then 0 when k <= hi then 1 else 2 end as step,
         round(case when k <= lo then (k - 0.5) / lo when k <= hi then (k - lo - 0.5) / (hi - lo) else (k - hi - 0.5) / target_share end, 6) as call
  from places
), served as (
  select plan_id, disaster_type, q_type, count(*) as quota
  from (select * from calls qualify row_number() over (partition by plan_id order by step, call, disaster_type, q_type) <= n_items)
  group by all
), sums as (
  select plan_id, sum(min_items) as least_sum, sum(n_wanted) as all_sum from wanted group by plan_id
), drawn as (
  select m.plan_id, m.disaster_type, m.q_type, m.id from met m join served s using (plan_id, disaster_type, q_type) where m.place <= s.quota
), report as (
  select f.plan_id, f.disaster_type, f.q_type, f.n_wanted, f.n_there, coalesce(s.quota, 0) as n_drawn,
         greatest(f.n_wanted - f.n_there, 0) as n_missing,
         case when f.n_there < f.n_wanted then 'supply' when coalesce(s.quota, 0) >= f.n_wanted then null
              when coalesce(s.quota, 0) < f.min_items and u.least_sum > f.n_items then 'minimums'
              when u.all_sum > f.n_items then 'trimmed' else 'shared' end as cause
  from found f left join served s using (plan_id, disaster_type, q_type) join sums u using (plan_id)
)
"""


# The compatibility characters of these tables, in place of a full NFKC.
def _normal(column: str) -> str:
    composed = f"replace(replace(replace(nfc_normalize(coalesce({column}, '')), '㎥', 'm3'), '㎍', 'μg'), '℃', 'c')"
    return f"regexp_replace(lower(translate({composed}, '０１２３４５６７８９', '0123456789')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_OVERLAPS = f"""
with asked as (
  select distinct id, {_normal("question")} as n from qa_dataset
), said as (
  select distinct item_id, {_normal("m.content")} as n from (select item_id, unnest(messages) as m from ft_dataset) where lower(trim(m.role)) = 'user'
), q as (
  select distinct id, n, substring(n, i, 5) as p from (select id, n, unnest(generate_series(1, length(n) - 4)) as i from asked)
), m as (
  select distinct item_id, n, substring(n, i, 5) as p from (select item_id, n, unnest(generate_series(1, length(n) - 4)) as i from said)
), sizes as (
  select id, n, count(*) as c from q group by id, n
), hits as (
  select distinct id as qa_id, item_id from (
    select q.id, q.n, m.item_id, m.n as mn, count(*) as n_both from q join m using (p) group by q.id, q.n, m.item_id, m.n
  ) join sizes using (id, n) where n_both >= 0.75 * c
)
"""

_GROUPS = f"""
with recursive latest as (
  select id, question, gold_answer from qa_dataset
  qualify row_number() over (partition by id order by loaded_at desc, question desc nulls last, gold_answer desc nulls last) = 1
), texts as (
  select id, {_normal("concat(coalesce(question, ''), ' ', coalesce(gold_answer, ''))")} as n from latest
), p as (
  select distinct n, substring(n, i, 5) as p from (select distinct n, unnest(generate_series(1, length(n) - 4)) as i from texts)
), sizes as (
  select n, count(*) as c from p group by n
), links as (
  select a.n as x, b.n as y, count(*) as n_both from p a join p b on a.p = b.p and a.n <> b.n group by a.n, b.n
), alike as (
  select x, y from links join sizes s on s.n = x join sizes t on t.n = y where n_both >= 0.5 * (s.c + t.c - n_both)
), reached as (
  select distinct n as x, n as y from texts where n <> ''
  union
  select r.x, a.y from reached r join alike a on r.y = a.x
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
select distinct 'page_content' as item_kind, page_id as item_id from kb_documents where {_long("page_content")}
union
select distinct 'chunk_text', chunk_id from chunks where {_long("text")}
""",
        "p3_found": f"{_OVERLAPS} select qa_id, item_id from hits",
        "p3_rates": f"""{_OVERLAPS}
, latest as (
  select id, split, source_file from qa_dataset
  qualify row_number() over (partition by id order by loaded_at desc, split desc nulls last, source_file desc nulls last) = 1
)
select split, source_file, count(*) as n_pairs, count(distinct qa_id) as n_questions, count(distinct item_id) as n_items
from hits join latest on qa_id = id group by split, source_file
""",
        "p5_found": f"{_GROUPS} select distinct a.id as id_a, b.id as id_b from reached r join texts a on a.n = r.x join texts b on b.n = r.y where a.id < b.id",
        "p5_classes": f"""{_GROUPS}
select t.id, (select min(u.id) from reached r join texts u on u.n = r.y where r.x = t.n) as class_id, (select count(*) from alike where x = t.n) as n_links from texts t
""",
        "p8_found": f"""
with p as (
  select distinct passage_id, substring(n, i, 40) as run
  from (select passage_id, n, unnest(generate_series(1, length(n) - 39)) as i from (select passage_id, {_normal("text")} as n from eval_passages))
), d as (
  select distinct doc_id, substring(n, i, 40) as run
  from (select doc_id, n, unnest(generate_series(1, length(n) - 39)) as i from (select doc_id, {_normal("text")} as n from documents))
)
select distinct passage_id, doc_id from p join d using (run)
""",
        # The categories of these plans share no records; where they do, the tests compare with brute force.
        "p2_shortfalls": f"{_DRAWN} select * from report",
        "p2_sample": f"{_DRAWN} select * from drawn",
        "p2_found": f"{_DRAWN} select distinct plan_id, disaster_type, q_type from report where n_missing > 0",
    }
