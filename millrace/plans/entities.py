"""Queries on personal data, entity decoding, masking and label vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ner, pii, spans
from ..operators.layout import spread
from ..operators.vocabulary import label_vocabulary
from .registry import Registry, read, sql_strip

R = Registry()

@R.query("select c_custkey, '서울 강남구 테헤란로 ' || c_custkey || '|' || '충북 청주시 오창읍 가좌리 산 ' || c_custkey || '-3' as addresses from customer")
def pii_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses written into running text."""
    text = F.concat(F.lit("보낸 곳: 서울 강남구 테헤란로 "), "c_custkey", F.lit(". 받는 곳은 충북 청주시 오창읍 가좌리 산 "), "c_custkey", F.lit("-3; 이상입니다. 서울에서 "), "c_custkey", F.lit("km"))
    return read(spark, d, "customer").select("c_custkey", F.array_join(pii.addresses(text), "|").alias("addresses"))


@R.query(f"""
select doc_id, len(a) as n, array_to_string(a, '|') as addresses
from (select doc_id, list_transform(regexp_extract_all(text, '{pii.ADDRESS}'), lambda x: {sql_strip("x")}) as a from documents where text is not null)
""")
def pii_addresses_documents(spark: SparkSession, d: str) -> DataFrame:
    a = pii.addresses(F.col("text"))
    docs = spread(read(spark, d, "documents")).filter("text is not null")
    return docs.select("doc_id", F.size(a).cast("bigint").alias("n"), F.array_join(a, "|").alias("addresses"))


_FAR = "그리고 이 사이에는 다른 안내 말씀이 마흔 글자보다 길게 이어져 서로 영향을 주지 않습니다. "


@R.query("""
with n as (select o_orderkey, o_orderstatus as s, lpad(cast(o_orderkey as varchar), 8, '7') as a, lpad(cast(o_custkey as varchar), 4, '6') as b from orders)
select o_orderkey,
  case s when 'O' then substring(a, 1, 4) || '-' || substring(a, 5, 4) || '-' || b when 'F' then 'AB1' || a || 'KR' else '' end as trackings,
  case s when 'O' then '1' || substring(a, 1, 5) || b || '99' when 'F' then a || b || '55' else '' end as accounts
from n
""")
def pii_context_accept(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written into text with and without the words that make them parcels or accounts."""
    a, b = F.lpad(F.col("o_orderkey").cast("string"), 8, "7"), F.lpad(F.col("o_custkey").cast("string"), 4, "6")
    parcel = F.concat(F.lit("운송장번호 "), F.substring(a, 1, 4), F.lit("-"), F.substring(a, 5, 4), F.lit("-"), b, F.lit(" 입니다. "))
    bank = F.concat(F.lit("신한은행 1"), F.substring(a, 1, 2), F.lit("-"), F.substring(a, 3, 3), F.lit("-"), b, F.lit("99 입금"))
    letters, word = F.concat(F.lit("AB1"), a, F.lit("KR 우체국. ")), F.concat(F.lit("계좌번호: "), a, b, F.lit("55"))
    order = F.concat(F.lit("주문번호: "), a, b, F.lit(" CJ. "), F.lit(_FAR), F.lit("접수 "), a, b)
    text = F.when(F.col("o_orderstatus") == "O", F.concat(parcel, F.lit(_FAR), bank)).when(F.col("o_orderstatus") == "F", F.concat(letters, F.lit(_FAR), word)).otherwise(order)
    found = spread(read(spark, d, "orders")).select("o_orderkey", pii.detect_all(text).alias("r"))
    return found.select("o_orderkey", F.array_join("r.trackings", "|").alias("trackings"), F.array_join("r.accounts", "|").alias("accounts"))


@R.query()
def pii_detect_results(spark: SparkSession, d: str) -> DataFrame:
    """Parcel and account numbers in every answer."""
    df = spread(read(spark, d, "experiment_results")).select("result_id", "loaded_at", pii.detect_all(F.col("pred_answer")).alias("r"))
    return df.select("result_id", "loaded_at", F.array_join("r.trackings", "|").alias("trackings"), F.array_join("r.accounts", "|").alias("accounts"))


def _window_sql(n: int, cond: str) -> str:
    return f"len(list_filter(range(1, length(s) - {n} + 2), lambda i: {cond})) > 0"


_M, _D = "cast(substring(s, i + {0}, 2) as integer) between 1 and 12", "cast(substring(s, i + {0}, 2) as integer) between 1 and 31"


@R.query(f"""
select o_orderkey, {_window_sql(8, "cast(substring(s, i, 4) as integer) between 1900 and 2100 and " + _M.format(4) + " and " + _D.format(6))}
        or {_window_sql(6, _M.format(2) + " and " + _D.format(4))} as may_be_date
from (select o_orderkey, cast(o_orderkey as varchar) || case when o_orderstatus = 'O' then '' else cast(o_custkey as varchar) end as s from orders)
""")
def fuzzy_date(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers, alone or run together with customers', as what could be dates."""
    digits = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_custkey").cast("string")))
    return read(spark, d, "orders").select("o_orderkey", pii.may_be_date(digits).alias("may_be_date"))


@R.query("""
with r as (
  select doc_id, regexp_extract_all(text, '[0-9]+') as runs, regexp_split_to_array(text, '[0-9]+') as gaps from documents where text is not null
), p as (select doc_id, runs, gaps, unnest(range(1, len(runs) + 1)) as i from r)
select doc_id, runs[i] as value,
       cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(runs[1:i-1], lambda g: length(g))), 0) as integer) as start
from p where length(runs[i]) between 3 and 14
""")
def pii_digit_runs(spark: SparkSession, d: str) -> DataFrame:
    found = F.explode(spans.spans(F.col("text"), r"(?<![0-9])[0-9]{3,14}(?![0-9])"))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", found.alias("s")).select("doc_id", "s.value", "s.start")


_WORDS = "select doc_id, string_split(title, ' ') as w from documents where title is not null"
_VALID = """length({0}) > 1 and regexp_full_match({0}, '[\\p{{L}}\\p{{N}}]+') and not regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]')
  and not regexp_full_match({0}, '[A-Za-z]*') and not regexp_full_match({0}, '[0-9]+') and not (regexp_matches({0}, '[0-9]') and regexp_matches({0}, '\\p{{L}}'))"""


@R.query(f"select n, {_VALID.format('n')} as valid from (select distinct unnest(w) as n from ({_WORDS}) union select distinct substring(c_name, 1, 12) from customer union select distinct cast(c_custkey as varchar) from customer)")
def name_valid(spark: SparkSession, d: str) -> DataFrame:
    """Words of titles, beginnings of customers' names and numbers, as names."""
    words = read(spark, d, "documents").filter("title is not null").select(F.explode(F.split("title", " ")).alias("n"))
    customers = read(spark, d, "customer")
    every = words.union(customers.select(F.substring("c_name", 1, 12))).union(customers.select(F.col("c_custkey").cast("string"))).distinct()
    return every.select("n", ner.valid_name(F.col("n")).alias("valid"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Titles as tokens with tags and probabilities that follow from the words' lengths."""

    def one(w: Column) -> Column:
        n = F.length(w) % 4
        tag = F.when(n == 2, "PER_B").when(n == 3, "PER_I").otherwise("O")
        return F.struct(w.alias("token"), tag.alias("tag"), (F.ascii(w) % 10 / 10.0).alias("prob"))

    return read(spark, d, "documents").filter("title is not null").select("doc_id", "title", F.transform(F.split("title", " "), one).alias("p"))


@R.query(f"""
with t as (select doc_id, w[i] as token, i as pos, case length(w[i]) % 4 when 2 then 'PER_B' when 3 then 'PER_I' else 'O' end as tag, coalesce(unicode(nullif(w[i], '')), 0) % 10 / 10.0 as prob from (select *, unnest(range(1, len(w) + 1)) as i from ({_WORDS}))),
m as (select *, tag = 'PER_B' and prob >= 0.6 as b, tag = 'PER_I' and prob >= 0.6 as i from t),
g as (select *, sum(case when b or not i then 1 else 0 end) over (partition by doc_id order by pos) as grp from m),
n as (select doc_id, grp, string_agg(token, '' order by pos) filter (where b or i) as name, bool_or(b) as begun from g group by doc_id, grp)
select doc_id, coalesce(array_to_string(list(name order by grp) filter (where begun and {_VALID.format("name")}), ','), '') as names from n group by doc_id
""")
def bio_decode(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("doc_id", F.array_join(ner.decoded_names(F.col("p")), ",").alias("names"))


@R.query(f"select doc_id, trim(array_to_string(list_transform(w, lambda x: case when length(x) % 4 in (2, 3) then repeat('*', length(x)) else x end), ' ')) as masked from ({_WORDS})")
def mask_entities(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("doc_id", ner.masked(F.col("title"), F.col("p")).alias("masked"))


@R.query("""
with w as (select distinct unnest(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ')) as tag from documents where title is not null),
a as (select tag, 1 as part, 0 as nr from w where tag <> '' and tag not in ('POS', 'ADJ', 'SUF') union all values ('POS', 2, 0), ('ADJ', 2, 1), ('SUF', 2, 2))
select tag, cast(row_number() over (order by part, nr, tag) - 1 as integer) as tag_id from a
""")
def label_vocab(spark: SparkSession, d: str) -> DataFrame:
    return label_vocabulary(read(spark, d, "documents").filter("title is not null"), "title")
