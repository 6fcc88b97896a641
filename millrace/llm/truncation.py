"""Texts cut off by field limits.

Word trigrams are counted inside texts and at their ends, in SQL alone, and the counts
decide: a text is cut if its final trigram is common inside texts but almost never the
end of another one. A word counts by its ending (its last two characters, digits as 0, with
a mark if it closes a sentence), since names differ from text to text while endings carry
the grammar. What is rare as a trigram backs off to its last two words, its last word,
which may be the beginning of a longer one, and the kind of its last character. Rules only
exclude: sentences and notes that are complete whatever the counts, and values that are
defective in another way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import endings
from .pairs import other_defects
from .storage import kept

# Marks that close a sentence, and what may follow them.
STOPS = ".!?。！？…"
CLOSERS = "*_`~)]}>\"''”’」』】》〉"
#: What remains of an entity, a tag, an escape or a character after a stopped transfer.
CODE = r"(?:&(?:[A-Za-z][A-Za-z0-9]{0,7}|#[0-9xX]?[0-9A-Fa-f]{0,6})?|</?[A-Za-z]{0,8}|\\[ux]?[0-9A-Fa-f]{0,3}|%[0-9A-F]|\x{fffd}+|[\x{1100}-\x{115f}])$"

#: A text as words and line breaks with single spaces between, digits as 0.
_LINE = r"trim(both ' ' from replace(translate({0}, '123456789\t\r', '000000000  '), '\n', ' \n '))"
_WORDS = f"split({_LINE}, ' ')"


def _closed(word: str) -> str:
    """The word without what closes after it."""
    quoted = CLOSERS.replace("'", "\\'")
    return f"coalesce(nullif(trim(trailing '{quoted}' from {word}), ''), {word})"


def _bare(word: str) -> str:
    """The word without what closes after it, and without its stop if that follows no digit."""
    closed = _closed(word)
    return f"if(right({closed}, 2) = '0.', {closed}, coalesce(nullif(trim(trailing '{STOPS}' from {closed}), ''), {closed}))"


def _ending(word: str) -> str:
    """The last two characters of the bare word, with a mark if it had a stop or was closed."""
    bare, closed, marks = _bare(word), _closed(word), (STOPS + CLOSERS).replace("'", "\\'")
    mark = f"if({bare} <> {closed}, '.', if({closed} <> {word}, ')', ''))"
    # Most words have no mark, and most of the others one stop after a letter.
    plain = f"instr('{STOPS}', right({word}, 1)) > 0 and length({word}) > 2 and instr('0{marks}', left(right({word}, 2), 1)) = 0"
    return (
        f"if(instr('{marks}', right({word}, 1)) = 0, right({word}, 2),"
        f" if({plain}, concat(left(right({word}, 3), 2), '.'), concat(right({bare}, 2), {mark})))"
    )


def bodies(text: Column) -> Column:
    """Trimmed texts without the remains of a code at their ends."""
    short = F.right(text, F.lit(10))
    marked = (F.translate(short, "&<\\%\ufffd", "") != short) | F.right(text, F.lit(1)).between("\u1100", "\u115f")
    return F.when(marked, F.rtrim(F.regexp_replace(text, CODE, ""))).otherwise(text)


def _kind(ending: str) -> Column:
    """The kind of an ending's last letter, and its mark."""
    mark = F.when(F.col(ending).rlike("[^0][.)]$"), F.right(ending, F.lit(1))).otherwise("")
    last = F.when(F.col(ending).rlike(r"[가-힣][.)]?$"), "h").when(F.col(ending).rlike(r"\p{L}[.)]?$"), "a").when(F.col(ending).rlike(r"0\.$"), "0.").when(F.col(ending).rlike(r"0\)?$"), "0").otherwise("-")
    return F.concat(last, mark)


def final_shares(texts: DataFrame, weight: float = 50.0) -> DataFrame:
    """(field_name, trigram, share): how often the final trigrams of texts end other texts, as a
    share of all their places. A trigram goes by the 64-bit hash of its words' endings.

    Takes distinct (field_name, text). The share of a trigram is drawn towards that of its
    last two words, theirs towards that of the last word, and that towards the share of the
    last character's kind, as if seen ``weight`` times. A last word also counts where it begins
    a longer one; trigrams and pairs do not, so that what stands inside no more than half as often
    as at other ends, as cuts in mid-word at one place do, adds nothing there. The text itself
    does not count for its own end.
    """
    words = texts.select("field_name", F.expr(_WORDS.format("text")).alias("w")).filter("w[0] <> ''")
    ends = words.select("field_name", "w", F.expr(f"concat(array('^', '^'), transform(w, x -> {_ending('x')}))").alias("e"))
    places = ends.select("field_name", F.expr("inline(arrays_zip(slice(e, 1, size(w)), slice(e, 2, size(w)), slice(e, 3, size(w)), slice(e, 4, size(w)), w)) as (a, b, c, d, w)"))
    places = places.select("field_name", F.xxhash64("a", "b", "c").alias("three"), F.xxhash64("b", "c").alias("two"), "c", "d", "w")
    # One pass counts trigrams and, for the places inside, whole words.
    counted = places.groupingSets([("field_name", "three", "two", "c"), ("field_name", "w")], "field_name", "three", "two", "c", "w").agg(
        F.count("d").alias("i"), (F.count("*") - F.count("d")).alias("f"), F.grouping("w").alias("g")
    )
    bare = _bare("w")
    cases = F.expr(
        f"""if(g = 1,
          if(f > 0, array(struct(3 as n, three, two, c, i, f), struct(2 as n, 0L as three, two, c, i, f)), array(struct(2 as n, 0L as three, two, c, i, f))),
          transform(if(length({bare}) > 1, sequence(1, length({bare}) - 1), array()), k -> struct(1 as n, 0L as three, 0L as two, right(left(w, k), 2) as c, i, 0L as f)))"""
    )
    sums = [F.sum("i").alias("i"), F.sum("f").alias("f")]
    known = kept(counted.select("field_name", F.inline(cases)).groupBy("field_name", "n", "three", "two", "c").agg(*sums))
    three, two = [known.filter(f"n = {n}").drop("n") for n in (3, 2)]
    # A last word counts with the beginnings of longer ones, the kind of its last character without.
    one = known.filter("n < 3").groupBy("field_name", "c").agg(*sums, F.sum(F.when(F.col("n") == 2, F.col("i")).otherwise(0)).alias("whole"))
    kind = one.groupBy("field_name", _kind("c").alias("k")).agg(F.sum("whole").alias("i"), F.sum("f").alias("f"))

    def named(df: DataFrame, n: int) -> DataFrame:
        return df.withColumnsRenamed({"i": f"i{n}", "f": f"f{n}"})

    known = named(three, 3).join(named(two, 2).drop("three"), ["field_name", "two", "c"]).join(named(one, 1).drop("whole"), ["field_name", "c"])
    # There are a few kinds for each field, whatever the texts.
    known = known.withColumn("k", _kind("c")).join(F.broadcast(named(kind, 0)), ["field_name", "k"])
    others = F.col("f0") - 1
    share = F.when(F.col("i0") + others > 0, others / (F.col("i0") + others)).otherwise(0.0)
    for n in (1, 2, 3):
        others = F.col(f"f{n}") - 1
        share = F.when(F.col(f"i{n}") > (others / 2 if n > 1 else 0), (others + weight * share) / (F.col(f"i{n}") + others + weight)).otherwise(share)
    return known.select("field_name", F.col("three").alias("trigram"), share.alias("share"))


@F.pandas_udf(T.BooleanType())
def _otherwise_sound(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for asked, said in parts:
        yield pd.Series([s is not None and not other_defects(q, s) for q, s in zip(asked, said, strict=True)])


def cut_texts(
    df: DataFrame,
    key: str,
    fields: dict[str, str | None],
    order: str | None = None,
    keep: list[str] | None = None,
    final_share: float = 0.02,
    weight: float = 50.0,
) -> DataFrame:
    """Every value of the text columns with ``cut`` true or false.

    ``fields`` maps each text column to the column of its question, or None. Rows that
    share ``key`` count once, by the greatest ``order``; texts that are null or without
    content are not cut. A text is cut if less than ``final_share`` of the places of its
    final trigram are ends of other texts, see ``final_shares``, unless it is excluded as a
    complete sentence or note, which is tried first where the texts are read, or for another
    defect, which is tried last. Gives (key, field_name, cut) and the columns of
    ``keep``, without ``keep`` the cut values only; empty input gives an empty result.
    """
    values = F.array(
        *[
            F.struct(
                F.lit(i).alias("field_name"),
                F.col(f).cast("string").alias("raw"),
                (F.col(q).cast("string") if q else F.lit("")).alias("asked"),
            )
            for i, (f, q) in enumerate(fields.items(), 1)
        ]
    )
    when = F.col(order) if order else F.lit(0)
    rows = df.select(F.col(key).alias("_k"), when.alias("_t"), F.struct(F.lit(1).alias("_"), *(keep or [])).alias("_keep"), F.inline(values))
    rows = rows.withColumn("_trimmed", endings.trimmed(F.col("raw"))).withColumn("text", bodies(F.col("_trimmed")))
    shares = final_shares(rows.filter("length(raw) > 0").select("field_name", "text").distinct(), weight)
    rare = shares.filter(F.col("share") < final_share).select("field_name", "trigram", F.lit(True).alias("rare"))

    open_end = (F.length("text") > 0) & ~endings.complete(F.col("_trimmed"))
    # The last words are what follows the third space from the end.
    rows = rows.withColumn("_tail", F.when(open_end, F.expr(f"substring_index({_LINE.format('text')}, ' ', -3)")))
    rows = rows.withColumn("e", F.expr(f"concat(array('^', '^'), transform(split(_tail, ' '), x -> {_ending('x')}))"))
    trigram = F.when(F.col("e").isNotNull(), F.xxhash64(*[F.element_at("e", i) for i in (-3, -2, -1)])).alias("trigram")
    # Few values are open, and only these carry their texts on.
    texts = [F.when(F.col("e").isNotNull(), F.col(c)).alias(c) for c in ("raw", "asked")]
    last = (
        rows.select("_k", "field_name", F.struct("_t", trigram, *texts, "_keep").alias("m"))
        .groupBy("_k", "field_name")
        .agg(F.max("m").alias("m"))
        .select("_k", "field_name", "m.trigram", "m.raw", "m.asked", "m._keep")
    )
    found = last.join(rare, ["field_name", "trigram"], "left" if keep else "inner")
    found = found.withColumn("rare", F.col("rare") & _otherwise_sound(F.when(F.col("rare"), F.col("asked")), F.when(F.col("rare"), F.col("raw"))))
    if not keep:
        found = found.filter("rare")
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field_name")).alias("field_name")
    return found.select(
        F.col("_k").alias(key), name, F.coalesce("rare", F.lit(False)).alias("cut"), *[F.col(f"_keep.{c}").alias(c) for c in keep or []]
    )


def cut_rates(df: DataFrame, key: str, fields: dict[str, str | None], by: list[str], order: str | None = None) -> DataFrame:
    """Values and cut values of every text column for each combination of ``by``."""
    return (
        cut_texts(df, key, fields, order, keep=by)
        .groupBy("field_name", *by)
        .agg(F.count("*").alias("n_values"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"))
        .withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )
