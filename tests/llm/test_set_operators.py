"""Samples, overlaps, near-duplicates and packing against brute force and their limits."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import contamination, neardup, overlap, packing, sampling
from millrace.llm.components import components
from millrace.llm.normal import normalise, piece_hashes, piece_rows, pieces, portions

PLAN = dict(key="id", labels=["a", "b"], order="t", plan="plan_id", share="share", least="least", size="size")


def _records(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(f"Q{i}", rng.choices(["화재", " 화재", "화재_old", "지진", "한파", None], [50, 5, 5, 30, 3, 7])[0], rng.choice(["절차", "판단"]), 1) for i in range(n)]
    rows += [(rows[0][0], "지진", "절차", 2), (rows[1][0], rows[1][1], rows[1][2], 1), (None, "화재", "절차", 1)]
    return spark.createDataFrame(rows, "id string, a string, b string, t int").withColumn("size", F.lit("clash")), rows


def _plans(spark):
    rows = [
        (1, "화재", "*", 0.5, 5, 100), (1, "지진", "*", 0.3, 5, 100), (1, "한파", "*", 0.2, 5, 100),
        (2, "*", "절차", 0.7, 1, 50), (2, "*", "판단", 0.3, 1, 50), (3, "화재", "절차", 1.0, 900, 10), (4, "없음", "판단", 0.5, 2, 10), (4, "*", "*", 0.5, 2, 10),
    ]
    return spark.createDataFrame(rows, "plan_id long, a string, b string, share double, least long, size long"), rows


def _plain(rows):
    latest = {}
    for i, a, b, t in rows:
        if i is not None and (i not in latest or t >= latest[i][2]):
            latest[i] = (a, b, t)
    clean = lambda x: None if x is None else x.split("_")[0].replace(" ", "")
    return {i: (clean(a), clean(b)) for i, (a, b, _) in latest.items()}


def test_shortfalls(spark):
    df, rows = _records(spark)
    plans, plan_rows = _plans(spark)
    have = _plain(rows)
    out = {(r["plan_id"], r["a"], r["b"]): (r["n_wanted"], r["n_there"], r["n_missing"]) for r in sampling.shortfalls(df, plans, **PLAN).collect()}
    for p, a, b, share, least, size in plan_rows:
        there = sum((a in ("*", x)) and (b in ("*", y)) for x, y in have.values())
        want = max(least, int(size * share + 0.5))
        assert out[p, a, b] == (want, there, max(want - there, 0))
    assert sampling.shortfalls(df, plans.limit(0), **PLAN).count() == 0
    empty = sampling.shortfalls(df.limit(0), plans, **PLAN).collect()
    assert len(empty) == len(plan_rows) and all(r["n_there"] == 0 for r in empty)


def test_matched_sample(spark):
    df, rows = _records(spark)
    plans, plan_rows = _plans(spark)
    have = _plain(rows)
    drawn = sampling.matched_sample(df, plans, **PLAN)
    got = sorted(tuple(r) for r in drawn.collect())
    assert got == sorted(tuple(r) for r in sampling.matched_sample(df.repartition(13), plans, **PLAN).collect())
    per_plan = Counter(p for p, *_ in got)
    assert per_plan[1] == 100 and per_plan[2] == 50
    cells = Counter((p, a, b) for p, a, b, _ in got)
    for p, a, b, share, least, size in plan_rows[:5]:
        there = sum((a in ("*", x)) and (b in ("*", y)) for x, y in have.values())
        assert cells[p, a, b] >= min(there, max(least, int(size * share + 0.5)))
    for p, a, b, i in got:
        assert a in ("*", have[i][0]) and b in ("*", have[i][1])
    assert len({(p, i) for p, _, _, i in got}) == len(got)
    assert sampling.matched_sample(df.limit(0), plans, **PLAN).count() == 0


def test_overlapping_categories_fill_the_sample(spark):
    rows = [(f"Q{i}", a, b, 1) for i, (a, b) in enumerate([("x", "A")] * 40 + [("x", "B")] * 10 + [("y", "A")] * 10 + [(None, "A")] * 5)]
    df = spark.createDataFrame(rows, "id string, a string, b string, t int")
    plan_rows = [
        (1, "*", "A", 0.5, 0, 50), (1, "x", "*", 0.5, 0, 50), (2, "*", "*", 0.2, 0, 50), (2, "y", "*", 0.2, 10, 50), (2, "x", "B", 0.6, 0, 50), (3, "x", "*", 0.5, 0, 40), (3, "y", "*", 0.5, 0, 40),
    ]
    plans = spark.createDataFrame(plan_rows, "plan_id long, a string, b string, share double, least long, size long")
    got = sorted(tuple(r) for r in sampling.matched_sample(df, plans, **PLAN).collect())
    assert got == sorted(tuple(r) for r in sampling.matched_sample(df.repartition(7), plans, **PLAN).collect())
    have = {i: (a, b) for i, a, b, _ in rows}
    assert all(a in ("*", have[i][0]) and b in ("*", have[i][1]) for _, a, b, i in got)
    assert len({(p, i) for p, _, _, i in got}) == len(got)
    n = Counter((p, a, b) for p, a, b, _ in got)
    assert (n[1, "*", "A"], n[1, "x", "*"]) == (25, 25) and sum(k for (p, *_), k in n.items() if p == 2) == 50
    assert (n[2, "y", "*"], n[2, "x", "B"], n[2, "*", "*"]) == (10, 10, 30) and (n[3, "x", "*"], n[3, "y", "*"]) == (30, 10)


def test_surplus_of_one_category_serves_another(spark):
    rows = [(f"Q{i}", "A", "x", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, a string, b string, t int")
    plans = spark.createDataFrame([(1, "A", "*", 0.8, 0, 50), (1, "*", "x", 0.2, 0, 50)], "plan_id long, a string, b string, share double, least long, size long")
    n = Counter((a, b) for _, a, b, _ in sampling.matched_sample(df, plans, **PLAN).collect())
    assert n == {("A", "*"): 40, ("*", "x"): 10}
    report = sampling.shortfalls(df, plans, **PLAN).collect()
    assert {(r["a"], r["n_wanted"], r["n_drawn"], r["cause"]) for r in report} == {("A", 40, 40, None), ("*", 10, 10, None)}


def test_sample_is_filled_while_records_last(spark):
    rows = [(f"{c}-{i}", f"c{c}", "x", 1) for c in range(12) for i in range(5 << c)]
    df = spark.createDataFrame(rows, "id string, a string, b string, t int")
    plans = [(1, f"c{c}", "*", 1 / 12, 0, 10000) for c in range(12)]
    plans = spark.createDataFrame(plans, "plan_id long, a string, b string, share double, least long, size long")
    n = Counter(a for _, a, _, _ in sampling.matched_sample(df, plans, **PLAN).collect())
    assert sum(n.values()) == 10000 and all(n[f"c{c}"] == 5 << c for c in range(8))
    assert max(n[f"c{c}"] for c in (9, 10, 11)) - min(n[f"c{c}"] for c in (9, 10, 11)) <= 1
    causes = {r["a"]: r["cause"] for r in sampling.shortfalls(df, plans, **PLAN).collect()}
    assert causes == {f"c{c}": "supply" if 5 << c < 833 else None for c in range(12)}


def test_minimums_above_the_sample_are_reported(spark):
    rows = [(f"{c}-{i}", f"c{c}", "x", 1) for c in range(6) for i in range(17)]
    df = spark.createDataFrame(rows, "id string, a string, b string, t int")
    plans = [(1, f"c{c}", "*", 1 / 6, 3, 12) for c in range(6)] + [(2, "c0", "*", 0.9, 1, 10), (2, "c1", "*", 0.1, 4, 10)]
    plans = spark.createDataFrame(plans, "plan_id long, a string, b string, share double, least long, size long")
    n = Counter((p, a) for p, a, _, _ in sampling.matched_sample(df, plans, **PLAN).collect())
    assert sum(k for (p, _), k in n.items() if p == 1) == 12 and {n[1, f"c{c}"] for c in range(6)} == {2}
    assert (n[2, "c0"], n[2, "c1"]) == (6, 4)
    report = {(r["plan_id"], r["a"]): (r["n_wanted"], r["n_drawn"], r["n_missing"], r["cause"]) for r in sampling.shortfalls(df, plans, **PLAN).collect()}
    assert report[1, "c0"] == (3, 2, 0, "minimums") and report[2, "c0"] == (9, 6, 0, "trimmed") and report[2, "c1"] == (4, 4, 0, None)


def test_apportioned():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        weights, rooms = [rng.choice([0, 0.1, 0.25, 0.5, 1, 3]) for _ in range(n)], [rng.choice([0, 1, 7, 40]) for _ in range(n)]
        places = rng.randint(0, 90)
        calls = sorted((round((k + 0.5) / max(w, 1e-9), 6), i) for i, (w, r) in enumerate(zip(weights, rooms, strict=True)) for k in range(r))
        wanted = Counter(i for _, i in calls[:places])
        assert sampling.apportioned(weights, rooms, places).tolist() == [wanted[i] for i in range(n)]
    assert sampling.apportioned([1, 2], [10**12, 10**12], 3 * 10**11).tolist() == [10**11, 2 * 10**11]


def test_least_hashes_are_a_reservoir(spark):
    rows = [(g, f"{random.Random(i).getrandbits(64):016x}", i) for i in range(3000) for g in ("x", None)]
    df = spark.createDataFrame(rows, "g string, h string, key long").withColumn("n", F.lit(57))
    got = sampling.least_hashes(df, ["g"], "n").collect()
    for g in ("x", None):
        wanted = sorted((h, k) for x, h, k in rows if x == g)[:57]
        assert sorted((r["h"], r["key"]) for r in got if r["g"] == g) == wanted


def _texts(rng, n, base=None):
    words = ["가방", "나무를", "다리에서", "라디오", "마을로", "바람이", "사다리", "아침에", "자동차", "차단기"]
    return [" ".join(rng.choice(words) + rng.choice("가나다라마바사") * rng.randint(0, 2) for _ in range(rng.randint(3, 25))) for _ in range(n)]


def _edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        t[i : i + rng.randint(0, 2)] = rng.choices("고노도로모 ", k=rng.randint(0, 2))
    return "".join(t)


def test_containment_equals_brute_force(spark):
    rng = random.Random(7)
    asked = _texts(rng, 60)
    said = _texts(rng, 80) + [f"앞말 {_edited(rng, rng.choice(asked), rng.randint(0, 6))} 뒷말" for _ in range(80)]
    q = [(f"q{i}", t) for i, t in enumerate(asked)] + [("n", None), ("e", ""), ("s", "짧다"), ("c", asked[0]), ("q1", asked[1])]
    m = [(i, t) for i, t in enumerate(said)] + [(900, None), (901, ""), (902, said[90]), (903, said[91] * 300)]
    got = contamination.contained_pairs(spark.createDataFrame(q, "key string, text string").withColumn("h", F.lit(1)), spark.createDataFrame(m, "key long, text string"), 0.75)
    expected = set()
    for i, t in q:
        p = pieces(normalise(t))
        expected |= {(i, j) for j, u in m if p and len(p & pieces(normalise(u))) >= 0.75 * len(p)}
    rows = got.collect()
    assert {(r["eval_key"], r["train_key"]) for r in rows} == expected and len(rows) == len(expected)
    empty = spark.createDataFrame([], "key string, text string")
    assert contamination.contained_pairs(empty, spark.createDataFrame(m, "key long, text string")).count() == 0


def test_user_messages(spark):
    kind = "id long, m array<struct<role:string,content:string>>, key int, text int"
    df = spark.createDataFrame([(1, [("USER", "a"), ("assistant", "b"), ("user", "c")], 0, 0), (2, None, 0, 0), (3, [], 0, 0), (4, [("User", None)], 0, 0)], kind)
    assert sorted((r["key"], r["text"] or "") for r in contamination.user_messages(df, "id", "m").collect()) == [(1, "a"), (1, "c"), (4, "")]


def _groups(texts, threshold):
    keys = list(texts)
    sets = {k: pieces(normalise(texts[k])) for k in keys}
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            same = normalise(texts[a]) == normalise(texts[b]) != ""
            if same or both and both >= threshold * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = defaultdict(set)
    for k in keys:
        out[find(k)].add(k)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("threshold,hits", [(0.5, 6), (0.8, 2), (0.5, 1)])
def test_near_duplicates_equal_brute_force(spark, threshold, hits):
    rng = random.Random(11)
    base = _texts(rng, 50)
    rows = [(f"k{i}", t, "끝말", 1) for i, t in enumerate(base)]
    rows += [(f"e{i}", _edited(rng, rng.choice(base), rng.randint(1, 14)), "끝말", 1) for i in range(90)]
    rows += [(f"c{i}", base[0].upper() + " !", "끝말", 1) for i in range(40)]
    rows += [(f"h{i}", base[1] + rng.choice("가나다라") * 2 + str(i), "끝말", 1) for i in range(40)]
    rows += [("null", None, None, 1), ("null2", None, None, 1), ("short", "ab", None, 1), ("short2", "AB", None, 1), ("k0", "old text", "x", 0), ("long", base[2] * 500, "끝말", 1)]
    df = spark.createDataFrame(rows, "id string, q string, a string, t int").withColumn("norm", F.lit(0)).withColumn("class_id", F.lit(0))
    got = neardup.near_duplicate_groups(df, "id", ["q", "a"], "t", threshold, hits)
    out, alone = defaultdict(set), set()
    for r in got.collect():
        if r["class_id"] is None:
            alone.add(r["id"])
        else:
            out[r["class_id"]].add(r["id"])
    latest = {i: f"{q or ''} {a or ''}" for i, q, a, t in sorted(rows, key=lambda r: r[3])}
    assert {frozenset(v) for v in out.values()} | {frozenset([k]) for k in alone} == _groups(latest, threshold)
    pairs_found = {(r["id_a"], r["id_b"]) for r in neardup.grouped_pairs(got, "id").collect()}
    assert pairs_found == {(a, b) for v in out.values() for a in v for b in v if a < b}


def test_links_equal_brute_force(spark):
    rng = random.Random(12)
    base = _texts(rng, 12)
    texts = {f"k{i}": t for i, t in enumerate(base)}
    texts |= {f"e{i}": _edited(rng, rng.choice(base), rng.randint(1, 14)) for i in range(40)}
    texts |= {f"h{i}": base[1] + chr(44032 + i) * 2 for i in range(30)}
    texts |= {"copy": base[1].upper() + " !", "short": "ab", "none": ""}
    sets = {normalise(t): pieces(normalise(t)) for t in texts.values()}
    links = Counter(a for a, p in sets.items() for b, q in sets.items() if a != b and p & q and len(p & q) >= 0.5 * len(p | q))
    df = spark.createDataFrame(list(texts.items()), "id string, q string")
    for parts in (1, 7):
        got = neardup.near_duplicate_groups(df.repartition(parts), "id", ["q"])
        assert {r["id"]: r["n_links"] for r in got.collect()} == {k: links[normalise(t)] for k, t in texts.items()}
    assert neardup.near_duplicate_groups(df, "id", ["q"], count_links=False).columns == ["id", "class_id"]


def _shuffled(spark) -> tuple[int, int]:
    """Stages so far, and bytes that they wrote to shuffles."""
    stages, n, total = spark.sparkContext._jsc.sc().statusStore(), 0, 0
    while True:
        try:
            total += stages.lastStageAttempt(n).shuffleWriteBytes()
        except Exception as e:
            if n > 3000 or "NoSuchElement" not in str(e):
                raise
            if not any(_known(stages, n + k) for k in range(1, 20)):
                return n, total
        n += 1


def _known(stages, n: int) -> bool:
    try:
        return stages.lastStageAttempt(n) is not None
    except Exception:
        return False


def test_near_duplicates_move_less_than_their_texts(spark):
    # Texts of one template share many pieces, so postings meet in proportion to the square of their number.
    rng = random.Random(14)
    words = ["".join(chr(rng.randrange(44032, 55204)) for _ in range(7)) for _ in range(120)]
    texts = [" ".join(rng.sample(words, 25)) for _ in range(1500)]
    rows = [(f"k{i}", t) for i, t in enumerate(texts)] + [(f"e{i}", t[3:]) for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame(rows, "id string, q string").repartition(3).localCheckpoint()
    before = _shuffled(spark)[1]
    got = neardup.grouped_pairs(neardup.near_duplicate_groups(df, "id", ["q"], count_links=False), "id").collect()
    moved = _shuffled(spark)[1] - before
    assert {(f"e{i}", f"k{i}") for i in range(20)} <= {(r["id_a"], r["id_b"]) for r in got}
    assert moved < sum(len(t.encode()) for _, t in rows)


def test_components_of_many_edges_take_rounds(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 49), (51, 49)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, other = ({(r["node"], r["component"]) for r in components(df, few=few).collect()} for few in (0, 100))
    assert one == other == {(i, 0) for i in range(21)} | {(i, 49) for i in (49, 50, 51)}


def test_values_there_again(spark):
    values = np.array([3, 5, 3, 1 << 40, 9, 1 << 50, 1 << 50, -1, -1, 7 << 30], dtype=np.int64)
    for parts in (1, 4):
        bits = overlap.repeated(spark.createDataFrame([(int(v),) for v in values], "h long").repartition(parts))
        assert overlap.may_hold(bits, overlap.shortened(np.array([3, 1 << 50, -1], dtype=np.int64))).all()
        assert not overlap.may_hold(bits, overlap.shortened(np.array([1 << 40, 7 << 30, 1 << 60], dtype=np.int64))).any()


def test_pieces_of_many_texts_at_once():
    rng = random.Random(13)
    texts = [normalise(t) for t in _texts(rng, 30)] + ["", "abcd", "abcde", "가" * 40]
    row, h = piece_rows(texts)
    for i, t in enumerate(texts):
        assert h[row == i].tolist() == piece_hashes(t).tolist() and len(piece_hashes(t)) == len(pieces(t))
    where, keys = neardup.band_keys(row, h)
    assert sorted(set(where.tolist())) == sorted(set(row.tolist())) and len(keys) == neardup.BANDS * len(set(row.tolist()))
    r, k = neardup.band_keys(*piece_rows([texts[3]]))
    assert keys[where == 3].tolist() == k.tolist() and set(r.tolist()) == {0}
    assert [len(x) for x in portions(iter([pd.DataFrame({"n": ["a" * 5, "b" * 9, "c" * 30, "", "d"]})]), "n", 14)] == [2, 1, 2]
    assert piece_rows([])[0].size == 0 and neardup.band_keys(*piece_rows(["ab"]))[1].size == 0


def test_filter_lets_all_indexed_pieces_pass(spark):
    df = spark.range(1000).selectExpr("xxhash64(id) as h")
    bits = overlap.piece_filter(df.repartition(3))
    held = np.array([r["h"] for r in df.collect()], dtype=np.int64)
    other = np.arange(1, 20001, dtype=np.int64) * 7919
    assert overlap.may_hold(bits, held).all() and overlap.may_hold(bits, other).mean() < 0.01 and 8 * len(bits) == overlap.FILTER_BITS[0]
    assert not overlap.may_hold(overlap.piece_filter(df.limit(0)), held).any()


def test_classes_named_by_their_least_key(spark):
    df = spark.createDataFrame([("b", 7), ("a", 7), ("c", 9), ("n", None)], "id string, class_id long")
    assert {r["id"]: r["class_id"] for r in neardup.named_by_least(df, "id").collect()} == {"a": "a", "b": "a", "c": "c", "n": None}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, q string")
    assert neardup.near_duplicate_groups(df, "id", ["q"]).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 300)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in got} and set(got) >= {n for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_limit(rule):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 2049, 3000)
    where = packing.best_fit(sizes, 2048, 6, 2048**2, rule=rule)
    assert np.bincount(where, weights=sizes).max() <= 2048
    assert np.bincount(where).max() <= 6
    assert np.bincount(where, weights=sizes.astype(float) ** 2).max() <= 2048**2
    if rule == "norm":
        assert where.max() + 1 <= 1.03 * max(np.ceil(sizes.sum() / 2048), (sizes > 1024).sum())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_places_and_cost_decide(rule):
    sizes = np.array([1000, 900, 100, 40, 30, 20, 10])
    loose = packing.best_fit(sizes, 2048, 256, 2048**2, rule=rule)
    assert loose.max() == 1 and loose[0] == loose[1]
    few = packing.best_fit(sizes, 2048, 3, 2048**2, rule=rule)
    assert np.bincount(few).max() == 3 and few.max() == 2
    # Both halves fit by tokens, not by the sum of their squares; the largest stands alone.
    flat = packing.best_fit(np.array([1700, 1000, 900, 100]), 2048, 256, 1_200_000, rule=rule)
    assert flat[0] not in flat[1:] and flat[1] != flat[2] and flat[3] in flat[1:3]


def test_space_and_its_bounds(spark):
    rows = [(i, n) for i, n in enumerate([2000, 1900, 500, 500, 500, 10, 10, 10, 10])]
    df = spark.createDataFrame(rows, "k long, n long")
    got = packing.packed(df, "k", "n", places=4, cost=packing.CAPACITY**2 // 2)
    by = {r["k"]: r["container_id"] for r in got.collect()}
    assert len({by[0], by[1], by[2]}) == 3 and by[2] == by[3] == by[4] and [by[i] for i in range(2)].count(by[5]) == 0
    r = packing.space(got, places=4, cost=packing.CAPACITY**2 // 2).first()
    assert (r["n_parts"], r["n_containers"], r["n_tokens"]) == (9, 4, 5440)
    assert (r["least_by_tokens"], r["least_by_places"], r["least_by_cost"]) == (3, 3, 3)
    assert got.rdd.getNumPartitions() == 1 and packing.packed(df, "k", "n", group_items=2).rdd.getNumPartitions() == 5


def test_packed(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 900)) for i in range(500)] + [(1000, 5000), (1001, 2048), (1002, 2049), (1003, None), (1004, 0), (7, 10), (None, 3)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("container_id", F.lit("clash"))
    got = packing.packed(df, "k", "n", group_items=200).collect()
    used, parts = Counter(), Counter()
    for r in got:
        used[r["container_id"]] += r["n_tokens"]
        parts[r["k"]] += 1
    assert max(used.values()) <= 2048
    assert all(r["unused"] == 2048 - used[r["container_id"]] for r in got)
    assert parts[1000] == 3 and parts[1001] == 1 and parts[1002] == 2 and parts[7] == 2 and parts[None] == 1 and parts[5] == 1
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n in rows)
    assert packing.packed(df.limit(0), "k", "n").count() == 0


def test_token_counts(spark):
    import os

    path = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"
    if not os.path.exists(path):
        pytest.skip("no tokenizers here")
    df = spark.createDataFrame([(1, "물을 끄고 대피합니다."), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, t string")
    encode = packing.tokenizer(path).encode_ordinary
    got = {r["k"]: r["n_tokens"] for r in packing.token_counts(df, "id", "t", path).collect()}
    assert got == {1: len(encode("물을 끄고 대피합니다.")), 2: 0, 3: 0, 4: len(encode("<|endoftext|>"))}
