"""Near-duplicate records with small edits.

Records are sets of pieces, kept in compressed blocks of some thousand texts. Within a block,
texts that share a band of a byte sketch are compared with the least text of the band only;
whoever is verified belongs to that hub's class. Then every two blocks are joined by an exact
inverted index over the rarest pieces, with their positions, which tallies shared pieces per
pair of texts of different classes; pairs that reach the guaranteed minimum of matches are
verified, and links are joined to groups. Blocks are read from where they are kept, and
neither postings nor tallies are shuffled.

A byte sketch alone cannot find every pair above the threshold: its bytes agree with a
probability, and insertions move every later byte of a positional one. The index on pieces
keeps the method's tally and its guaranteed minimum, and loses no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layout import spread
from .blocks import BLOCK, PIECES, TEXTS, USUAL, alike, block_row, linked, pressed, root, unpressed
from .components import components
from .normal import mix, normalise, piece_rows, pieces, portions
from .overlap import may_hold, rarest_first, released, repeated, shortened, sketch, slots
from .storage import kept

#: Bands of the byte sketch and bytes in each; they serve to form hubs, not to find all pairs.
BANDS, ROWS = 8, 4
#: Characters of one compressed value of texts, about.
CHARACTERS = 2_000_000


def band_keys(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) with a 64-bit key for each band of each text that has pieces: the
    low bytes of the least hash in each of equal parts of their range, with the band's
    number. Takes pieces sorted by text."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    numbers, text = row[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
    least = np.full(len(starts) * BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    mixed = hashes.view(np.uint64)
    cell = text * (BANDS * ROWS) + ((mixed >> np.uint64(32)) * np.uint64(BANDS * ROWS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, cell, mix(mixed))
    least = least.reshape(len(starts), BANDS * ROWS)
    out = np.empty((len(numbers), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(numbers), band, dtype=np.uint64)
        for part in range(band * ROWS, (band + 1) * ROWS):
            with np.errstate(over="ignore"):
                key = mix(key * np.uint64(0x10001) ^ (least[:, part] & np.uint64(0xFFFF)))
        out[:, band] = key
    return np.repeat(numbers, BANDS), out.view(np.int64).ravel()


@F.pandas_udf(T.BooleanType())
def _alike(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, other, least in parts:
        yield pd.Series([alike(pieces(x), pieces(y), t) for x, y, t in zip(one, other, least, strict=True)], dtype=bool)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts are alike."""
    left = texts.select(F.col("id").alias("a"), F.col("norm").alias("na"))
    right = texts.select(F.col("id").alias("b"), F.col("norm").alias("nb"))
    return pairs.join(left, "a").join(right, "b").filter(_alike("na", "nb", F.lit(threshold))).select("a", "b")


def _hubs(text: np.ndarray, key: np.ndarray, texts: list[str], threshold: float) -> np.ndarray:
    """For each text the least one that it is tied to by verified links to the least texts
    of its bands. Takes (text number, key) of band_keys."""
    order = np.lexsort((text, key))
    text, key = text[order], key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
    least = np.repeat(text[starts], np.diff(np.append(starts, len(key))))
    parent: dict[int, int] = {}
    last, of_last = -1, set()
    for i, j in np.unique(np.stack([least, text], axis=1)[least < text], axis=0).tolist():
        if i != last:
            last, of_last = i, pieces(texts[i])
        if alike(of_last, pieces(texts[j]), threshold):
            a, b = root(parent, i), root(parent, j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(parent, i) for i in range(len(texts))], dtype=np.int64)


def _blocks(texts: DataFrame, frequency, threshold: float, hits: int) -> DataFrame:
    """(no, and the columns of block_row): the texts (id, norm) of each task in blocks, with
    the rarest pieces of each. Pieces that no other text holds are left out."""

    def write(parts: list[tuple]) -> pd.DataFrame:
        ids, texts, bands, *counts = ([*a] for a in zip(*parts, strict=True))
        id_, words = np.concatenate(ids), [t for part in texts for t in part]
        order = np.argsort(id_)
        number = np.argsort(order)
        base = np.cumsum([0, *map(len, texts)])
        text = np.concatenate([number[t + at] for (t, _), at in zip(bands, base, strict=False)])
        hub = _hubs(text, np.concatenate([k for _, k in bands]), [words[i] for i in order], threshold)
        size, skip, count, h = (np.concatenate(c) for c in counts)
        return pd.DataFrame([block_row(id_, id_[order][hub][number], words, size, skip, count, h)])

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, parts, n_texts, n_pieces = frequency.value, [], 0, 0
        for frame in portions(frames, "norm"):
            texts = frame["norm"].tolist()
            row, h = piece_rows(texts)
            bands = band_keys(row, h)
            row, h, at, size = rarest_first(row, h, rank)
            some = at < size - np.ceil(threshold * size - 1e-9).astype(np.int64) + hits
            live = some & (rank[slots(h)] > 1)
            sizes, shown, count = (np.bincount(r, minlength=len(texts)) for r in (row, row[some], row[live]))
            n = int(count.sum())
            if parts and (n_texts + len(texts) > TEXTS or n_pieces + n > PIECES):
                yield write(parts)
                parts, n_texts, n_pieces = [], 0, 0
            parts.append((frame["id"].to_numpy(), texts, bands, sizes, shown - count, count, h[live]))
            n_texts, n_pieces = n_texts + len(texts), n_pieces + n
        if parts:
            yield write(parts)

    return texts.select("id", "norm").mapInPandas(blocks, BLOCK).withColumn("no", F.monotonically_increasing_id())


def _hubs_and_links(texts: DataFrame, n_texts: int, threshold: float, hits: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(id, hub) of the texts (id, norm) with distinct norms, about n_texts, and the links (a, b) across hubs.

    Alike are texts whose common pieces are at least ``threshold`` of all pieces of both.
    Hubs and links join every two of these, directly or through others, and give every such
    pair of different hubs if ``every`` one is wanted. Pairs within a hub's class are not listed.
    """
    frequency = texts.sparkSession.sparkContext.broadcast(sketch(texts))
    # Few large blocks meet in far fewer pairs than many small ones; no text is moved for that.
    cores = texts.sparkSession.sparkContext.defaultParallelism
    blocks = kept(_blocks(texts.coalesce(max(cores, -(-n_texts // USUAL))), frequency, threshold, hits))
    frequency.unpersist()

    def hubs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"id": _whole(row.ids, row.n), "hub": _whole(row.hubs, row.n)})

    x, y = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "xy")
    # Every two blocks meet in some task, which reads both from the shared folder.
    both = x.join(y, F.col("x_no") <= F.col("y_no"))
    found = both.mapInPandas(lambda frames: linked(frames, threshold, hits, every), "a long, b long")
    return blocks.select("ids", "hubs", "n").mapInPandas(hubs, "id long, hub long"), kept(found)


def _whole(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(released(data, 8 * int(n)), dtype="<i8")


def _degrees(texts: DataFrame, hubs: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links): how many other texts each is alike to.

    The links have every pair across hubs; those within a hub's class are listed here, which
    is quadratic in the class.
    """
    x, y = hubs.select(F.col("id").alias("a"), "hub"), hubs.select(F.col("id").alias("b"), "hub")
    within = _verified(x.join(y, "hub").filter("a < b").select("a", "b"), texts, threshold)
    every = within.union(links.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    return every.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))


def _counted_once(records: DataFrame) -> DataFrame:
    """(key, whole) of the records (key, m, whole): of those that share a key the one with
    the greatest m. Only records whose key may be there again are moved."""
    again = records.sparkSession.sparkContext.broadcast(repeated(records.select(F.xxhash64("key").alias("h"))))

    @F.pandas_udf(T.BooleanType())
    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(may_hold(again.value, shortened(part.to_numpy())))

    marked = records.withColumn("_again", held(F.xxhash64("key")))
    latest = marked.filter("_again").groupBy("key").agg(F.max(F.struct("m", "whole")).alias("_l")).select("key", "_l.whole")
    return marked.filter("not _again").select("key", "whole").union(latest)


def _normalised(records: DataFrame) -> DataFrame:
    """The normal forms of (key, whole) as rows of many: keys, ids, digests, compressed texts."""
    kind = records.schema["key"].dataType.simpleString()

    def press(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        for frame in portions(frames, "whole", CHARACTERS):
            norm = frame["whole"].map(normalise).tolist()
            ids = np.arange(first, first + len(norm), dtype=np.int64)
            first += len(norm)
            digests = b"".join(hashlib.md5(t.encode()).digest() for t in norm)
            yield pd.DataFrame([{"keys": frame["key"].tolist(), "ids": ids.tobytes(), "digests": digests, **pressed(norm)}])

    return records.mapInPandas(press, f"keys array<{kind}>, ids binary, digests binary, z binary, raw long")


def _texts_once(normal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the texts with pieces (id, norm), each once; and (a, b) for ids of equal texts, of which a stands for b."""

    def digests(row) -> np.ndarray:
        return np.frombuffer(row.digests, dtype="<i8").reshape(-1, 2)

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"h": digests(row)[:, 0]})

    again = normal.sparkSession.sparkContext.broadcast(repeated(normal.select("digests").mapInPandas(heads, "h long")))

    def unpress(repeats: bool):
        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    norm, both = pd.Series(unpressed(row.z, row.raw), dtype=object), digests(row)
                    some = (may_hold(again.value, shortened(np.ascontiguousarray(both[:, 0]))) == repeats) & (norm.str.len() > (0 if repeats else 4)).to_numpy()
                    out = pd.DataFrame({"id": np.frombuffer(row.ids, dtype=np.int64)[some], "norm": norm[some].to_numpy()})
                    yield out.assign(_h=[both[i].tobytes() for i in np.flatnonzero(some)]) if repeats else out

        return rows

    packed = normal.select("ids", "digests", "z", "raw")
    maybe = packed.mapInPandas(unpress(True), "id long, norm string, _h binary")
    first = kept(maybe.groupBy("_h").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("norm").alias("norm")))
    twins = maybe.select("_h", F.col("id").alias("b")).join(first.filter("n > 1").select("_h", F.col("id").alias("a")), "_h").filter("a <> b").select("a", "b")
    single = packed.mapInPandas(unpress(False), "id long, norm string")
    return single.union(first.filter("length(norm) >= 5").select("id", "norm")), kept(twins)


def near_duplicate_groups(
    records: DataFrame, key: str, parts: list[str], order: str | None = None, threshold: float = 0.5, hits: int = 6, count_links: bool = True
) -> DataFrame:
    """(key, class_id, n_links): the class of every record and the number of other texts
    that its text is alike to; without ``n_links`` if they are not to be counted, which
    spares listing the pairs of a class.

    The text of a record is its parts with one space between, null parts empty. Rows that
    share a key count once, by the greatest ``order``. Records with equal normal forms are
    one text. A class holds all records linked directly or through others; its id is an
    arbitrary number. Texts of fewer than five letters and numbers have no pieces and are
    alike only to equal ones; those without any letter or number are alike to none.
    """
    when = F.col(order) if order else F.lit(0)
    fields = [F.col(p).cast("string") for p in parts]
    m = F.struct(when.alias("_t"), *[f.alias(f"p{i}") for i, f in enumerate(fields)])
    whole = F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])
    normal = kept(_normalised(_counted_once(spread(records.select(F.col(key).alias("key"), m.alias("m"), whole.alias("whole"))))))
    texts, twins = _texts_once(normal)
    n_texts = normal.agg(F.sum(F.size("keys"))).first()[0] or 0
    hubs, links = _hubs_and_links(texts, n_texts, threshold, hits, count_links)
    grouped = components(links.union(twins).union(hubs.filter("id <> hub").select("hub", "id"))).withColumnRenamed("node", "id")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                some = [len(t) > 0 for t in unpressed(row.z, row.raw)]
                yield pd.DataFrame({"key": pd.Series(row.keys, dtype=object), "id": np.frombuffer(row.ids, dtype=np.int64), "_some": some})

    kind = normal.schema["keys"].dataType.elementType.simpleString()
    classes = normal.select("keys", "ids", "z", "raw").mapInPandas(keyed, f"key {kind}, id long, _some boolean").join(grouped, "id", "left")
    if count_links:
        counted = classes.join(twins.select(F.col("b").alias("id"), "a"), "id", "left").withColumn("a", F.coalesce("a", "id"))
        degrees = _degrees(texts, hubs, links, threshold).withColumnRenamed("id", "a")
        classes = counted.join(degrees, "a", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("bigint"))
    return classes.select(
        F.col("key").alias(key), F.when(F.col("_some"), F.coalesce("component", "id")).alias("class_id"), *(["n_links"] if count_links else [])
    )


def named_by_least(groups: DataFrame, key: str) -> DataFrame:
    """The groups with the least key of each class as its id."""
    least = groups.groupBy("class_id").agg(F.min(key).alias("_least"))
    named = groups.join(least, "class_id", "left")
    return named.select(*[F.col("_least").alias("class_id") if c == "class_id" else c for c in groups.columns])


def grouped_pairs(groups: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b) for every two records of a class, id_a the lesser by code point."""
    a, b = groups.select(F.col(key).alias("id_a"), "class_id"), groups.select(F.col(key).alias("id_b"), "class_id")
    many = groups.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select("class_id")
    return a.join(many, "class_id").join(b, "class_id").filter("id_a < id_b").select("id_a", "id_b")
