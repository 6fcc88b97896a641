"""Text functions, chunking and personal data against plain statements of their semantics."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import ner, pii, spans
from millrace.functions import text as t
from millrace.operators import chunking


def fold(text, size, overlap, least, sep="\n\n"):
    """Every chunk that was ever closed, and the one left open, if long enough."""
    parts = [p for p in (p.strip() for p in re.sub(r"\n{3,}", "\n\n", text.strip()).split(sep)) if p]
    chunks, held = [], ""
    while parts:
        head, *parts = parts
        if len(held) + 1 + len(head) > size:
            chunks.append(held)
            held = held[max(0, len(held) - overlap) :]
        held = "\n".join((held, head)).strip()
    return [c for c in (*chunks, held) if len(c) >= least]


def test_fold(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["가나다 ", "abc", "\n\n", "\n", " ", " 😀", "문장입니다. "], k=rng.randint(0, 120))) for _ in range(150)]
    texts += ["x" * 1000, "a" * 50 + "\n\n" + "b" * 20, "", "짧다"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    for size, overlap, least in ((400, 80, 80), (60, 10, 5)):
        got = {r["k"]: r["c"] for r in df.select("k", chunking.folded(F.col("t"), size, overlap, least).alias("c")).collect()}
        assert all(got[i] == fold(x, size, overlap, least) for i, x in enumerate(texts))
    assert spark.createDataFrame([(None,)], "t string").select(chunking.folded(F.col("t")).alias("c")).first()["c"] == []


@settings(max_examples=200)
@given(st.text(alphabet="가나 .\nab", max_size=600), st.integers(10, 80))
def test_recursive_pieces(text, size):
    out = chunking.recursive_pieces(text, size, size // 5, ("\n\n", "\n", ". ", " ", ""))
    assert all(0 < len(p) <= size for p in out)
    assert set("".join(out).split()) <= set(text.split()) or any(len(w) > size for w in text.split()) or "." in text
    if text.strip() and len(text) <= size:
        assert out == [text]


def test_strings(spark):
    df = spark.createDataFrame([("x <think>a\nb</think> y", "a, ,b,", "", "　 지진 　")], "think string, csv string, no string, pad string")
    r = df.select(
        t.strip_reasoning(F.col("think")).alias("think"),
        t.csv_list(F.col("csv")).alias("csv"),
        t.falsy_coalesce(F.col("no"), F.lit("x")).alias("filled"),
        t.strip(F.col("pad")).alias("pad"),
        t.keyword_recall(F.lit("지진 발생 시 탁자 아래 3 분 지진"), F.lit("지진 시 탁자 아래로 30 대피")).alias("recall"),
        t.keyword_recall(F.lit("!!"), F.lit("x")).alias("none"),
        t.numbered_id(F.lit(7)).alias("id"),
        t.numbered_id(F.lit(12345)).alias("long_id"),
        t.fill_template("{a}-{b}-{a}", a=F.lit("1"), b=F.lit(None).cast("string")).alias("filled_in"),
    ).first()
    assert tuple(r) == ("x  y", ["a", "b"], "x", "지진", 0.8333, 0.0, "Q007", "Q12345", "1--1")


def test_replace_first_must_find(spark):
    import pytest

    with pytest.raises(Exception, match="not found"):
        spark.createDataFrame([("abc",)], "x string").select(t.replace_first(F.col("x"), "zz", "y")).collect()


def test_spans_equal_finditer(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["12", "3456", "-", " ", "가", "계좌", "😀", "CJ", "\n", "AB123456789KR", "1234567890123"], k=rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for pattern in (pii.PARCEL, pii.BARE_ACCOUNT, r"\d+"):
        got = {r["k"]: [tuple(s) for s in r["s"]] for r in df.select("k", spans.spans(F.col("t"), pattern).alias("s")).collect()}
        for k, x in enumerate(texts):
            assert got[k] == [(m.group(), *m.span()) for m in re.finditer(pattern, x)]
    got = {r["k"]: [tuple(s) for s in r["s"]] for r in df.select("k", spans.spans(F.col("t"), pii.AFTER_WORD, 1, 1).alias("s")).collect()}
    for k, x in enumerate(texts):
        assert got[k] == [(m.group(1), *m.span(1)) for m in re.finditer(pii.AFTER_WORD, x)]


def test_detect(spark):
    rows = [("우체국 1234-5678-9012",), (None,), ("",), ("긴 글 " * 20_000 + "계좌번호: 12345678901234",)]
    df = spark.createDataFrame(rows, "t string")
    strict = [tuple(map(tuple, r["d"])) for r in df.select(pii.detect_all(F.col("t")).alias("d")).collect()]
    assert strict == [(("1234-5678-9012",), ("123456789012",)), ((), ()), ((), ()), ((), ("12345678901234",))]
    loose = df.select(pii.detect_all(F.col("t"), strict=False).alias("d")).first()["d"]
    assert (loose["trackings"], loose["accounts"]) == ([], ["123456789012"])
    assert df.filter("t is null").select(pii.addresses(F.col("t")).alias("a")).first()["a"] == []


def test_names(spark):
    rows = [(["홍", "##길동"], ["PER_B", "PER_I"], [0.9, 0.8]), ([], [], []), (["김"], ["PER_B"], [0.9])]
    df = spark.createDataFrame(rows, "t array<string>, g array<string>, p array<double>")
    zipped = F.arrays_zip(F.col("t").alias("token"), F.col("g").alias("tag"), F.col("p").alias("prob"))
    assert [r[0] for r in df.select(ner.decoded_names(zipped)).collect()] == [["홍길동"], [], []]
