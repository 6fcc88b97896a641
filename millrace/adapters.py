"""Places where models plug in, with deterministic stand-ins that need no network.

A model is a function from a list of inputs to a list of outputs, called once per Arrow
batch on the executors, so that it can batch its own work. Filter before calling one:
Spark cannot move a filter through a Python function.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import fill_template, repaired_json, string_or_list

Embedder = Callable[[Sequence[str]], np.ndarray]
TextModel = Callable[[Sequence[str]], Sequence[str]]


def hashed_embedder(dimensions: int = 64, n: int = 3) -> Embedder:
    """Unit vectors of hashed character n-grams; equal texts have equal vectors."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for i, text in enumerate(texts):
            text = text or ""
            for k in range(max(1, len(text) - n + 1)):
                h = int.from_bytes(hashlib.blake2b(text[k : k + n].encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)

    return embed


def embedded(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embedder([t or "" for t in part])))

    return df.withColumn(name, embed(F.col(text)))


def answered(df: DataFrame, prompt: str, model: TextModel, name: str = "answer", on_error: str | None = None) -> DataFrame:
    """A model's answer to every prompt. A failing call is repeated prompt by prompt; what
    fails then gives ``on_error``, or "ERROR: " and the message."""

    @F.pandas_udf(T.StringType())
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            prompts = list(part)
            try:
                answers = list(model(prompts))
            except Exception:
                answers = []
                for one in prompts:
                    try:
                        answers.append(model([one])[0])
                    except Exception as e:
                        answers.append(f"ERROR: {e}" if on_error is None else on_error)
            yield pd.Series(answers, dtype=object)

    return df.withColumn(name, ask(F.col(prompt)))


def http_model(url: str, build: Callable[[str], dict], pick: Callable[[dict], str], timeout: float = 30.0) -> TextModel:
    """A model behind an HTTP endpoint; anything but status 200 raises."""

    def call(prompts: Sequence[str]) -> list[str]:
        from urllib.request import Request, urlopen

        out = []
        for p in prompts:
            request = Request(url, json.dumps(build(p)).encode(), {"Content-Type": "application/json"})
            with urlopen(request, timeout=timeout) as reply:
                if reply.status != 200:
                    raise RuntimeError(f"status {reply.status}")
                out.append(pick(json.load(reply)))
        return out

    return call


def echo_model(prompts: Sequence[str]) -> list[str]:
    """A stand-in that answers with the prompt's last line."""
    return [p.strip().splitlines()[-1] if p and p.strip() else "" for p in prompts]


#: One block per category, and the frame around them; both can be replaced.
VERIFY_BLOCK = {
    "names": "다음 후보 가운데 실제 인명만 남기십시오. 후보: {found}",
    "addresses": "다음 후보 가운데 실제 주소만 남기십시오. 후보: {found}",
    "sensitive": "글에 드러난 민감한 개인 사항을 찾으십시오.",
}
VERIFY_FRAME = "{blocks}\n\nnames, addresses, sensitive 세 항목의 JSON으로만 답하고, 되풀이되는 값도 모두 적으십시오.\n\n<글>\n{text}\n</글>\n"


def verification_prompt(text: Column, found: dict[str, Column], prompts: dict[str, str] | None = None) -> Column:
    """One prompt with a block per wanted category; ``found`` maps a category to the list
    detected so far, and ``prompts`` replaces blocks."""
    blocks = []
    for kind, template in VERIFY_BLOCK.items():
        if kind in found:
            listed = F.when(F.size(found[kind]) > 0, F.array_join(found[kind], ", ")).otherwise('""')
            blocks.append(fill_template((prompts or {}).get(kind, template), found=listed))
    return fill_template(VERIFY_FRAME, blocks=F.concat_ws("\n\n", *blocks), text=text)


def verified(answer: Column, wanted: list[str]) -> Column:
    """Struct of lists from the model's JSON, which may be fenced or damaged; categories not
    wanted and unreadable answers give empty lists."""
    body = repaired_json(answer)
    empty = F.array().cast("array<string>")
    return F.struct(*[(F.coalesce(string_or_list(body, k), empty) if k in wanted else empty).alias(k) for k in VERIFY_BLOCK])


def tagged(df: DataFrame, text: str, tagger: Callable[[Sequence[str]], list[list[tuple[str, str, float]]]], name: str = "tokens") -> DataFrame:
    """Tokens with tags and probabilities from a token classifier."""
    kind = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("prob", T.DoubleType())]))

    @F.pandas_udf(kind)
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = tagger([t or "" for t in part])
            yield pd.Series([[{"token": a, "tag": b, "prob": float(c)} for a, b, c in r] for r in rows], dtype=object)

    return df.withColumn(name, tag(F.col(text)))


def judged(df: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], metrics: list[str]) -> DataFrame:
    """Metrics from a judge that sees a batch of the given columns; a failing batch has nulls."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{m}` double" for m in metrics])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                scores = judge(frame[columns])
            except Exception:
                scores = pd.DataFrame({m: [None] * len(frame) for m in metrics}, dtype="float64")
            yield frame.assign(**{m: scores[m].to_numpy(dtype="float64") for m in metrics})

    return df.mapInPandas(run, schema)
