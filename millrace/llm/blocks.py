"""Texts in compressed blocks, and the pairs of texts alike within a block or across two.

A block holds some thousand texts and the beginnings of their pieces, rarest first. Two
blocks are joined in memory: shared pieces are tallied per pair of texts, pairs that reach
the guaranteed minimum of matches are verified by their texts. Nothing but the links leaves
a task, however often the pieces meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .normal import pieces
from .overlap import released, squeezed

#: Texts of a block where a task has enough; texts and pieces at most (one text may hold more pieces); meetings tallied at a time.
USUAL, TEXTS, PIECES, MEETINGS = 1 << 14, 1 << 15, 1 << 21, 1 << 19
#: Texts whose pieces are held as sets of strings at a time, of either block.
SETS = 1 << 10
#: Texts of one class have sizes within this ratio; beginnings are cut for each two classes.
RATIO = 1.3


def pressed(texts: list[str]) -> dict[str, object]:
    """Columns z and raw: texts of letters and numbers in one compressed value, and its full size."""
    data = "\n".join(texts).encode("utf-8")
    return {"z": squeezed(data), "raw": len(data)}


def unpressed(z: bytes, raw: int) -> list[str]:
    return released(z, raw).decode("utf-8").split("\n")


def numbers(values: np.ndarray, kind: str) -> bytes:
    return squeezed(np.ascontiguousarray(values, dtype=kind).tobytes())


@dataclass
class Block:
    """Texts by number: id, hub, count of pieces, text; and (class, hash, text, position) of
    each indexed piece as one sorted number."""

    id: np.ndarray
    hub: np.ndarray
    size: np.ndarray
    text: list[str]
    entry: np.ndarray


def block_row(id_: np.ndarray, hub: np.ndarray, texts: list[str], size: np.ndarray, skip: np.ndarray, count: np.ndarray, h: np.ndarray) -> dict[str, object]:
    """A block as one row. Takes of each text the number of its pieces, the position of the
    first indexed one and how many are indexed; ``h`` has their hashes, text after text."""
    upper = (h.view(np.uint64) >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    columns = {"ids": numbers(id_, "<i8"), "hubs": numbers(hub, "<i8"), "sizes": numbers(size, "<i4"), "skips": numbers(skip, "<i4"), "counts": numbers(count, "<i4")}
    return {"n": len(texts), **columns, **pressed(texts), "h": np.ascontiguousarray(upper).tobytes()}


#: The columns of block_row.
BLOCK = "n int, ids binary, hubs binary, sizes binary, skips binary, counts binary, z binary, raw long, h binary"


def read_block(row: dict[str, object], prefix: str = "") -> Block:
    """The block of a row; its texts are numbered by hub, so that a hub's entries of one piece are neighbours."""
    n = int(row[f"{prefix}n"])
    id_, hub = (np.frombuffer(released(row[f"{prefix}{c}"], 8 * n), dtype="<i8") for c in ("ids", "hubs"))
    size, skip, count = (np.frombuffer(released(row[f"{prefix}{c}"], 4 * n), dtype="<i4") for c in ("sizes", "skips", "counts"))
    three = np.frombuffer(row[f"{prefix}h"], dtype=np.uint8).reshape(-1, 3).astype(np.uint64)
    h = three[:, 0] | three[:, 1] << np.uint64(8) | three[:, 2] << np.uint64(16)
    by_hub = np.argsort(hub, kind="stable")
    number = np.empty(n, dtype=np.int64)
    number[by_hub] = np.arange(n)
    text = np.repeat(np.arange(n), count)
    at = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) + skip[text], 0xFFFF)
    of_size = (np.log(size) / np.log(RATIO)).astype(np.uint64)
    entry = np.sort(of_size[text] << np.uint64(56) | h << np.uint64(32) | number[text].astype(np.uint64) << np.uint64(16) | at.astype(np.uint64))
    texts = unpressed(row[f"{prefix}z"], int(row[f"{prefix}raw"]))
    return Block(id_[by_hub], hub[by_hub], size[by_hub], [texts[i] for i in by_hub], entry)


def _classes(block: Block, some: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text, position) of the entries of each class, of ``some`` texts or of all."""
    e = block.entry
    if some is not None:
        e = e[some[(e >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)]]
    cuts = np.flatnonzero(np.diff((e >> np.uint64(56)).astype(np.int64))) + 1
    return [
        ((p >> np.uint64(32) & np.uint64(0xFFFFFF)).astype(np.int32), (p >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32), (p & np.uint64(0xFFFF)).astype(np.int32))
        for p in np.split(e, cuts)
        if len(p)
    ]


def _need(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Common pieces that two texts alike have at least, by the sum of their sizes."""
    return np.ceil(threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64)


def _begins(size: np.ndarray, at: np.ndarray, other: int, threshold: float, hits: int) -> np.ndarray:
    """Whether a position is in the beginning that counts against texts of so many pieces or more."""
    need = _need(size + np.maximum(other, threshold * size), threshold)
    return at < size - need + np.minimum(need, hits)


def _met(x: Block, y: Block, threshold: float, hits: int, some_x: np.ndarray | None, some_y: np.ndarray | None, hub_x: np.ndarray, hub_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts of different hubs whose common pieces reach the minimum. Equal
    blocks give every two texts once. Hubs must not fall with the number."""
    same = x is y
    of_x, of_y, out = _classes(x, some_x), _classes(y, some_y), []
    first, last = np.searchsorted(hub_y, hub_x, "left"), np.searchsorted(hub_y, hub_x, "right")
    for i, (xh, xt, xa) in enumerate(of_x):
        for j, (yh, yt, ya) in enumerate(of_y):
            if same and j < i:
                continue
            xs, ys = x.size[xt], y.size[yt]
            if xs.max() < threshold * ys.min() or ys.max() < threshold * xs.min():
                continue
            p, q = _begins(xs, xa, ys.min(), threshold, hits), _begins(ys, ya, xs.min(), threshold, hits)
            out += _joined((xh[p], xt[p], xa[p]), (yh[q], yt[q], ya[q]), x.size, y.size, first, last, same and i == j, threshold, hits)
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    keys = np.concatenate(out)
    return keys >> 16, keys & 0xFFFF


def _joined(xs: tuple, ys: tuple, size_x: np.ndarray, size_y: np.ndarray, first: np.ndarray, last: np.ndarray, once: bool, threshold: float, hits: int) -> list[np.ndarray]:
    (xh, xt, xa), (yh, yt, ya) = xs, ys
    if not len(xh) or not len(yh):
        return []
    starts = np.flatnonzero(np.diff(yh, prepend=-1))
    run, ends = yh[starts], np.append(starts[1:], len(yh))
    at = np.minimum(np.searchsorted(run, xh), len(run) - 1)
    some = np.flatnonzero(run[at] == xh)
    xh, xt, xa, lo, hi = xh[some], xt[some], xa[some], starts[at[some]], ends[at[some]]
    # The texts of the same hub stand together in a run and are left out of it.
    own = np.flatnonzero(first[xt] < last[xt])
    if len(own):
        place = yh.astype(np.int64) << 16 | yt
        a, b = (np.clip(np.searchsorted(place, xh[own].astype(np.int64) << 16 | side[xt[own]]), lo[own], hi[own]) for side in (first, last))
        after = hi[own]
        hi = hi.copy()
        hi[own] = a
        xt, xa, lo, hi = np.append(xt, xt[own]), np.append(xa, xa[own]), np.append(lo, b), np.append(hi, after)
    live = np.flatnonzero(hi > lo)
    live = live[np.argsort(xt[live].astype(np.uint16), kind="stable")]
    xt, xa, lo, n = xt[live], xa[live], lo[live], (hi - lo)[live]
    total, whole, out, a = np.cumsum(n), np.append(np.flatnonzero(np.diff(xt)) + 1, len(xt)), [], 0
    while a < len(xt):
        # Whole texts of x, so that all matches of a pair are tallied at once.
        before = total[a - 1] if a else 0
        b = whole[max(np.searchsorted(total[whole - 1], before + MEETINGS, "right") - 1, np.searchsorted(whole, a, "right"))]
        of = np.repeat(np.arange(a, b), n[a:b])
        to = np.arange(len(of)) - np.repeat(total[a:b] - n[a:b] - before - lo[a:b], n[a:b])
        t, u, p, q = xt[of], yt[to], xa[of], ya[to]
        s, r = size_x[t], size_y[u]
        need = _need(s + r, threshold)
        most = need - np.minimum(need, hits)
        ok = (p < s - most) & (q < r - most) & (np.minimum(p, q) + np.minimum(s - p, r - q) >= need)
        if once:
            ok &= t < u
        key, count = np.unique(t[ok].astype(np.int64) << 16 | u[ok], return_counts=True)
        out.append(key[count >= np.minimum(_need(size_x[key >> 16] + size_y[key & 0xFFFF], threshold), hits)])
        a = b
    return out


class _Sets(dict):
    """Pieces by text number, filled as texts turn up, of a bounded number of texts."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def __missing__(self, i: int) -> set[str]:
        if len(self) >= SETS:
            self.clear()
        self[i] = found = pieces(self.texts[i])
        return found


def alike(p: set[str], q: set[str], threshold: float) -> bool:
    both = len(p & q)
    return both > 0 and both >= threshold * (len(p) + len(q) - both)


def _verified(x: Block, y: Block, t: np.ndarray, u: np.ndarray, threshold: float, every: bool) -> list[tuple[int, int]]:
    """The pairs that are alike; unless ``every`` one is wanted, without those whose hubs are tied by others."""
    of_x, of_y, parent, out = _Sets(x.text), _Sets(y.text), {}, []
    for i, j, g, h in zip(t.tolist(), u.tolist(), x.hub[t].tolist(), y.hub[u].tolist(), strict=True):
        g, h = root(parent, g), root(parent, h)
        if (every or g != h) and alike(of_x[i], of_y[j], threshold):
            out.append((i, j))
            parent[max(g, h)] = min(g, h)
    return out


def _numbered(block: Block, hub: np.ndarray) -> Block:
    """The block with its texts numbered by these hubs."""
    order = np.argsort(hub, kind="stable")
    number = np.empty(len(order), dtype=np.uint64)
    number[order] = np.arange(len(order), dtype=np.uint64)
    e = block.entry
    text = number[(e >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)]
    entry = np.sort(e & ~np.uint64(0xFFFF0000) | text << np.uint64(16))
    return Block(block.id[order], hub[order], block.size[order], [block.text[i] for i in order], entry)


def links(x: Block, y: Block, threshold: float, hits: int, every: bool) -> pd.DataFrame:
    """(a, b): ids of the texts alike of one block (given twice) or of two, of different hubs.

    Unless ``every`` one is wanted, hubs of several texts are compared first, and the texts
    of hubs that are tied then are not compared any more: they are in one class anyway.
    """
    found = []
    if not every:
        many = []
        for block in (x, y):
            _, where, count = np.unique(block.hub, return_inverse=True, return_counts=True)
            many.append((block.hub == block.id) & (count[where] > 1))
        if many[0].any() and many[1].any():
            t, u = _met(x, y, threshold, hits, *many, x.hub, y.hub)
            tied = _verified(x, y, t, u, threshold, every)
            found += [(x.id[i], y.id[j]) for i, j in tied]
            if tied:
                parent: dict[int, int] = {}
                for i, j in tied:
                    a, b = root(parent, int(x.hub[i])), root(parent, int(y.hub[j]))
                    parent[max(a, b)] = min(a, b)
                same = x is y
                x = _numbered(x, np.array([root(parent, h) for h in x.hub.tolist()], dtype=np.int64))
                y = x if same else _numbered(y, np.array([root(parent, h) for h in y.hub.tolist()], dtype=np.int64))
    t, u = _met(x, y, threshold, hits, None, None, x.hub, y.hub)
    found += [(x.id[i], y.id[j]) for i, j in _verified(x, y, t, u, threshold, every)]
    return pd.DataFrame({c: np.array([f[k] for f in found], dtype=np.int64) for k, c in enumerate("ab")})


def root(parent: dict[int, int], i: int) -> int:
    """The least of the joined numbers; ways are shortened as they are gone."""
    while parent.setdefault(i, i) != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(frames: Iterator[pd.DataFrame], threshold: float, hits: int, every: bool) -> Iterator[pd.DataFrame]:
    """The links of each row of two blocks, whose columns begin with x and y."""
    kept: tuple[int, Block] | None = None
    for frame in frames:
        for row in frame.to_dict("records"):
            if kept is None or kept[0] != row["x_no"]:
                kept = row["x_no"], read_block(row, "x_")
            x = kept[1]
            yield links(x, x if row["x_no"] == row["y_no"] else read_block(row, "y_"), threshold, hits, every)
