"""An exact inverted index on pieces with count filtering, shared by two operators.

Every record is a set of hashed pieces. The pieces are put in one order for all records,
rarest first. If two sets must share ``need`` pieces, any subset of a set that leaves out
``need - k`` pieces holds ``k`` shared ones; so only the rarest ``size - need + k`` pieces
of a record are indexed, and a pair must be tallied ``k`` times at least to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .normal import mix, piece_rows, portions
from .storage import kept

#: Counters of the sketch of piece frequencies: a fixed size, whatever the data's.
SKETCH = 1 << 20
#: Bits of the filter on indexed pieces, at least and at most; in between, so many for each piece.
FILTER_BITS, BITS_EACH = (1 << 20, 1 << 30), 16


def squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def released(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def slots(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    return (mix(hashes.view(np.uint64)) % np.uint64(size)).astype(np.int64)


def sketch(texts: DataFrame, column: str = "norm") -> np.ndarray:
    """How many texts hold a piece, at most, by the piece's slot.

    Spark sums the tasks' counters part by part; SKETCH sums, packed, reach the driver.
    """
    part = 1 << 12

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, dtype=np.int32)
        for frame in portions(frames, column):
            total += np.bincount(slots(piece_rows(frame[column].to_numpy())[1]), minlength=SKETCH).astype(np.int32)
        parts = total.reshape(-1, part)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"i": some, "b": [squeezed(parts[k].tobytes()) for k in some]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(released(b, 4 * part), dtype=np.int32).astype(np.int64) for b in frame["b"])
        packed = np.minimum(sums, np.iinfo(np.int32).max).astype(np.int32).tobytes()
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "b": [packed]})

    parts = texts.select(column).mapInPandas(count, "i long, b binary").groupBy("i").applyInPandas(add, "i long, b binary")
    out = np.zeros(SKETCH, dtype=np.int32)
    for row in parts.collect():
        out[row["i"] * part : (row["i"] + 1) * part] = np.frombuffer(row["b"], dtype=np.int32)
    return out


def rarest_first(row: np.ndarray, hashes: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of each text in the order that holds for all records: text number, hash,
    position in the text's order, and the number of the text's pieces. Takes pieces sorted
    by text and hash."""
    often = np.minimum(frequency[slots(hashes)], (1 << 24) - 1).astype(np.uint64)
    if len(row) < 1 << 24 and (not len(row) or row[-1] < 1 << 16):
        # Text, frequency and place in one number: sorting these costs a tenth of sorting by three columns.
        places = np.sort(row.astype(np.uint64) << np.uint64(48) | often << np.uint64(24) | np.arange(len(row), dtype=np.uint64))
        order = (places & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((hashes, often, row))
    sizes = np.bincount(row)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else sizes
    row, hashes = row[order], hashes[order]
    return row, hashes, np.arange(len(row)) - starts[row], sizes[row]


def piece_filter(indexed: DataFrame, column: str = "h") -> np.ndarray:
    """A bitmap of the indexed pieces, joined by Spark from parts of 1,024 bytes.

    Its size follows the number of pieces up to 128 MB. Beyond that it lets more pieces through
    that are not indexed, which the join on the index then drops.
    """
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (BITS_EACH * indexed.count() - 1).bit_length()))
    part = 1 << 10

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = np.zeros(bits // 8, dtype=np.uint8)
        for frame in frames:
            at = np.unique(slots(frame[column].to_numpy(), bits))
            byte, bit = at >> 3, np.left_shift(1, 7 - (at & 7))
            first = np.flatnonzero(np.diff(byte, prepend=-1))
            if len(first):
                packed[byte[first]] |= np.add.reduceat(bit, first).astype(np.uint8)
        parts = packed.reshape(-1, part)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"i": some, "b": [parts[k].tobytes() for k in some]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        b = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in frame["b"]])
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "b": [b.tobytes()]})

    parts = indexed.select(column).mapInPandas(mark, "i long, b binary").groupBy("i").applyInPandas(join, "i long, b binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row["i"] * part : (row["i"] + 1) * part] = np.frombuffer(row["b"], dtype=np.uint8)
    return out


def repeated(values: DataFrame) -> np.ndarray:
    """A bitmap of the 64-bit values that occur more than once, and of a few others.

    Takes one column; ``may_hold`` of ``shortened`` values reads it. Only the upper 38 bits
    are compared, and these are moved as differences between sorted values.
    """
    (column,) = values.columns

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v, n = np.unique(shortened(frame[column].to_numpy()), return_counts=True)
            v = np.repeat(v, np.minimum(n, 2))
            group = v >> 32
            for part in np.split(v, np.flatnonzero(np.diff(group)) + 1) if len(v) else []:
                low = np.diff(part & 0xFFFFFFFF, prepend=0).astype("<u4")
                yield pd.DataFrame({"g": [part[0] >> 32], "n": [len(part)], "b": [squeezed(low.view(np.uint8).reshape(-1, 4).T.tobytes())]})

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        low = [np.cumsum(np.frombuffer(released(b, 4 * n), dtype=np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)) for b, n in zip(frame["b"], frame["n"], strict=True)]
        v, n = np.unique(np.concatenate(low), return_counts=True)
        return pd.DataFrame({"h": v[n > 1] | frame["g"].iloc[0] << 32})

    return piece_filter(kept(values.mapInPandas(split, "g long, n long, b binary").groupBy("g").applyInPandas(count, "h long")))


def shortened(values: np.ndarray) -> np.ndarray:
    """The upper 38 bits."""
    return (values.view(np.uint64) >> np.uint64(26)).astype(np.int64)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = slots(hashes, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
