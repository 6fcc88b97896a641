"""Normalised text and its pieces, shared by the operators on overlapping texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

PIECE = 5


class _Kept(dict):
    """Translation table that keeps letters and numbers; filled as code points turn up."""

    def __missing__(self, code: int) -> int | None:
        kept = code if unicodedata.category(chr(code))[0] in "LN" else None
        self[code] = kept
        return kept


_kept = _Kept()
#: Odd 64-bit factors of the hash, from a linear congruence.
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 7 + 0xD1B54A32D192ED03 * i) % 2**64 | 1 for i in range(1, 17)], dtype=np.uint64)


def normalise(text: str | None) -> str:
    """NFKC, then lower case, then only letters and numbers. Null counts as empty."""
    return unicodedata.normalize("NFKC", text or "").lower().translate(_kept)


def pieces(normalised: str, n: int = PIECE) -> set[str]:
    """The distinct runs of n consecutive characters."""
    return {normalised[i : i + n] for i in range(len(normalised) - n + 1)}


def piece_rows(normalised: Sequence[str], n: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the distinct pieces of each text, sorted by both."""
    lengths = np.fromiter(map(len, normalised), dtype=np.int64, count=len(normalised))
    codes = np.frombuffer("".join(normalised).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = np.full(count, 0x9E3779B97F4A7C15, dtype=np.uint64)
        for i in range(n):
            h += codes[i : i + count] * _FACTORS[i]
    row = np.repeat(np.arange(len(lengths)), lengths)[:count]
    whole = np.arange(n, count + n) <= np.cumsum(lengths)[row]
    h, row = mix(h[whole]).view(np.int64), row[whole]
    order = np.argsort(h)
    # By text, which few bits number in most portions: then this is a radix sort.
    order = order[np.argsort(row[order].astype(np.uint16 if len(lengths) <= 1 << 16 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[first], h[first]


def piece_hashes(normalised: str, n: int = PIECE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the pieces, as int64."""
    return piece_rows([normalised], n)[1]


def portions(frames: Iterator[pd.DataFrame], column: str, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The rows in portions of so many characters, or of one text, to be hashed at a time."""
    for frame in frames:
        ends = frame[column].str.len().cumsum().to_numpy()
        at = 0
        while at < len(frame):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield frame.iloc[at:stop]
            at = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift rounds."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
