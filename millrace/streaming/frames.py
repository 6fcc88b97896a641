"""Replay of frames with state: the frame before, tracks that grow, and a selection that
lasts as long as its labels do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def selections(frames: DataFrame) -> DataFrame:
    """(video, frame, kept) for frames (video, frame, labels, picked).

    The selection gains what is picked in a frame and loses labels that the frame lacks; it
    is carried from one micro-batch to the next. Frames of a batch are taken in order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(parts)).sort_values("frame")
        out = []
        for frame, labels, picked in zip(rows["frame"], rows["labels"], rows["picked"], strict=True):
            here = set(labels if labels is not None else [])
            kept = (kept | set(picked if picked is not None else [])) & here
            out.append((key[0], frame, sorted(int(i) for i in kept)))
        state.update((sorted(int(i) for i in kept),))
        yield pd.DataFrame(out, columns=["video", "frame", "kept"])

    return frames.groupBy("video").applyInPandasWithState(
        step, "video long, frame long, kept array<long>", "kept array<long>", "append", GroupStateTimeout.NoTimeout
    )


def tracks(points: DataFrame, follow: Callable[[list[float], list[float]], list[float]]) -> DataFrame:
    """(video, frame, x, y, length): a point followed through frames (video, frame, x, y).

    ``follow`` gives the new place from the last place and the frame's measurement.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, length = (list(state.get[0]), state.get[1]) if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("frame")
        out = []
        for frame, x, y in zip(rows["frame"], rows["x"], rows["y"], strict=True):
            place = [float(x), float(y)] if place is None else [float(v) for v in follow(place, [float(x), float(y)])]
            length += 1
            out.append((key[0], frame, place[0], place[1], length))
        state.update((place, length))
        yield pd.DataFrame(out, columns=["video", "frame", "x", "y", "length"])

    return points.groupBy("video").applyInPandasWithState(
        step, "video long, frame long, x double, y double, length long", "place array<double>, length long", "append", GroupStateTimeout.NoTimeout
    )


def rewound(frames: DataFrame, frame: str, total: int) -> DataFrame:
    """Frame numbers of an endless replay brought back to the video's own."""
    return frames.withColumn("source_frame", F.pmod(F.col(frame), F.lit(total)))
