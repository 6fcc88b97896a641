"""Entities from token tags, name checks and masking, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANJA = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}]"


def valid_name(c: Column) -> Column:
    """Two or more letters or digits of one kind, neither Hanja nor all ASCII letters nor all digits."""
    return (
        (F.length(c) > 1)
        & c.rlike(r"^[\p{L}\p{N}]+$")
        & ~c.rlike(HANJA)
        & ~c.rlike(r"^[A-Za-z]*$")
        & ~c.rlike(r"^\p{Nd}+$")
        & ~(c.rlike(r"\p{Nd}") & c.rlike(r"\p{L}"))
    )


def decoded_names(predictions: Column, least: float = 0.6) -> Column:
    """Names from an array of (token, tag, prob): a sure PER_B begins one, sure PER_I go on,
    anything else ends it; marks of word pieces are dropped and implausible names left out."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def emitted(acc: Column) -> Column:
        return F.when(valid_name(acc["cur"]), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        piece = F.regexp_replace(p["token"], "▁|##", "")
        sure = p["prob"] >= least
        begins = (p["tag"] == "PER_B") & sure
        goes_on = (p["tag"] == "PER_I") & (F.length(acc["cur"]) > 0) & sure
        cur = F.when(begins, piece).when(goes_on, F.concat(acc["cur"], piece)).otherwise(F.lit(""))
        return F.struct(cur.alias("cur"), F.when(goes_on, acc["out"]).otherwise(emitted(acc)).alias("out"))

    return F.aggregate(predictions, start, step, emitted)


def masked(text: Column, predictions: Column, whole: bool = True) -> Column:
    """The text with person tokens replaced by asterisks.

    A cursor walks the text along the tokens, over white space; marks of sentence ends and
    word starts are skipped and an unknown token counts as one character. With ``whole``
    every character of a person token is masked, otherwise the first one only, as the
    earlier scripts do, whose cursor then moves by one.
    """
    start = F.struct(F.lit("").alias("out"), text.alias("rest"))
    gap = r"^(?U)\s*"

    def step(acc: Column, p: Column) -> Column:
        token = F.regexp_replace(p["token"], "^##", "")
        lead = F.regexp_extract(acc["rest"], gap, 0)
        body = F.substring(acc["rest"], F.length(lead) + 1, F.length(acc["rest"]))
        person = p["tag"].isin("PER_B", "PER_I")
        width = F.when(token == "[UNK]", 1).otherwise(F.length(token))
        width = F.least(F.when(person & F.lit(not whole), 1).otherwise(width), F.length(body))
        seen = F.substring(body, F.lit(1), width)
        shown = F.when(person, F.repeat(F.lit("*"), width)).otherwise(seen)
        skipped = p["token"].isin("[CLS]", "[SEP]", "_")
        return F.struct(
            F.when(skipped, acc["out"]).otherwise(F.concat(acc["out"], lead, shown)).alias("out"),
            F.when(skipped, acc["rest"]).otherwise(F.substring(body, width + 1, F.length(body))).alias("rest"),
        )

    return F.trim(F.aggregate(predictions, start, step, lambda acc: F.concat(acc["out"], acc["rest"])))
