"""Pieces, leaks, residue, cut texts and broken pairs against plain statements of what they do."""

from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import endings, leakage, packing, pairs, residue, splitting, truncation
from millrace.llm.normal import normalise, piece_hashes, pieces

TEXTS = st.text(alphabet="가나다 ab.\n!?한 é１。 ", max_size=1500)


@given(TEXTS)
def test_normalise(text):
    plain = unicodedata.normalize("NFKC", text).lower()
    assert normalise(text) == "".join(c for c in plain if unicodedata.category(c)[0] in "LN")


@given(TEXTS)
def test_hashes_stand_for_pieces(text):
    n = normalise(text)
    assert len(piece_hashes(n)) == len(pieces(n))


@settings(max_examples=300)
@given(TEXTS, st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_item(text, limit, overlap):
    item = text.strip()
    cut = splitting.split_item(text, limit, overlap)
    assert (not cut) == (not item)
    for n, (no, start, stop, piece) in enumerate(cut):
        assert no == n and piece == item[start:stop] and 0 < len(piece) <= limit
    if cut:
        assert cut[0][1] == 0 and cut[-1][2] == len(item)
        assert (len(cut) > 1) == (len(item) > limit)
    for a, b in zip(cut, cut[1:], strict=False):
        assert b[1] == a[2] - overlap and b[2] > a[2]


def test_pieces_end_at_boundaries():
    item = "첫 문단입니다. 둘째 문장입니다.\n\n다음 문단은 길어서 나뉩니다. 그리고 이어집니다."
    first = splitting.split_item(item, 30, 5)[0][3]
    assert first.endswith("\n\n")
    assert splitting.split_item("x" * 1000, 400, 80)[1][1:3] == (320, 720)
    assert splitting.split_item("낱말 " * 200, 400, 80)[0][3].endswith(" ")


def test_pieces_end_at_early_boundaries():
    for end in ("\n\n", "\n", ". ", " "):
        cut = splitting.split_item("가" * 150 + end + "x" * 600, 400, 80)
        assert cut[0][1:3] == (0, 150 + len(end)) and all(len(p) <= 400 for *_, p in cut)
        assert all(b[1] == a[2] - 80 for a, b in zip(cut, cut[1:], strict=False))
    assert splitting.split_item("가" * 60 + " " + "x" * 600, 400, 80)[0][2] == 400


def test_pieces_by_other_sizes():
    import numpy as np

    cut = splitting.split_item("가나다라마바사아자차" * 5, 12, 3, lambda t: np.full(len(t), 3))
    assert all(len(p) <= 4 for *_, p in cut)
    assert all(a[2] - b[1] == 1 for a, b in zip(cut, cut[1:], strict=False))
    with pytest.raises(ValueError):
        splitting.split_item("abc" * 500, 10, 10)


def test_split_items_by_other_sizes(spark):
    import numpy as np

    width = lambda t: np.array([len(c.encode()) for c in t])
    texts = ["가나다 라마바 " * 20, "abc def " * 20, "짧다", "가a" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted((r["k"], r["piece_no"], r["start"], r["stop"], r["text"]) for r in splitting.split_items(df, ["k"], "t", 40, 8, width).collect())
    assert got == [(k, *p) for k, t in enumerate(texts) for p in splitting.split_item(t, 40, 8, width)]
    assert all(len(p.encode()) <= 40 for *_, p in got) and len({k for k, n, *_ in got if n > 0}) == 3


def test_split_items_edges(spark):
    long = "문장입니다. " * 5000
    df = spark.createDataFrame(
        [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (4, " 　\n", "x"), (None, "짧은 글", "x")], "k int, t string, piece_no string"
    )
    out = splitting.split_items(df, ["k"], "t")
    rows = out.collect()
    assert {r["k"] for r in rows} == {1, None}
    assert len([r for r in rows if r["k"] == 1]) == rows[0]["n_pieces"] or rows[0]["k"] is None
    assert splitting.split_items(df.limit(0), ["k"], "t").count() == 0


def _leaks_plainly(docs, passages, least):
    out = set()
    for p, pt in passages:
        grams = {normalise(pt)[i : i + least] for i in range(len(normalise(pt)) - least + 1)}
        for d, dt in docs:
            n = normalise(dt)
            if any(n[i : i + least] in grams for i in range(len(n) - least + 1)):
                out.add((p, d))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("가나다라마바사ab1", k=rng.randint(1, 4)))
    passages = [(i, " ".join(word() for _ in range(rng.randint(3, 40)))) for i in range(30)]
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(30))
        if rng.random() < 0.6:
            source = passages[rng.randrange(30)][1]
            start = rng.randrange(len(source))
            text += "\n- ".join(source[start : start + rng.randint(10, 90)].upper().split(" ")) + text
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, docs[3][1]), (203, passages[0][1] * 200)]
    passages += [(99, None), (98, ""), (97, passages[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_shared", F.lit("clash"))
    p = spark.createDataFrame(passages, "passage_id long, text string")
    found = leakage.leaks(d, p, "doc_id", "text", "passage_id", "text", 20).collect()
    expected = _leaks_plainly(docs, passages, 20)
    assert {(r["passage_id"], r["doc_id"]) for r in found} == expected and len(found) == len(expected)
    texts = dict(docs)
    for r in found:
        assert len(normalise(texts[r["doc_id"]][r["doc_start"] : r["doc_end"]])) >= r["n_shared"] >= 20
    assert leakage.leaks(d.limit(0), p, "doc_id", "text", "passage_id", "text").count() == 0
    assert leakage.leaks(d, p.limit(0), "doc_id", "text", "passage_id", "text").count() == 0


RESIDUE = {
    "담당 부서는 {{department}}로 연락 바랍니다.": "placeholder",
    "Dear ${first_name}, your visit is due.": "placeholder",
    "행사는 [날짜 입력]에 열립니다.": "placeholder",
    "Sent by %USER_NAME% today": "placeholder",
    "value is [object Object] now": "placeholder",
    "Lorem ipsum dolor sit amet, elit.": "filler",
    "내용 내용 내용": "filler",
    "여기에 본문을 입력하세요.": "filler",
    "TODO: write this part": "unfinished",
    "(본문 작성 예정)": "unfinished",
    "404 Not Found\nnginx": "error_page",
    'Traceback (most recent call last):\n  File "a.py", line 3\nValueError: x': "error_page",
    "요청하신 페이지를 찾을 수 없습니다.": "error_page",
    "Please enable JavaScript to view this page.": "script_required",
    "이 사이트를 보려면 자바스크립트를 켜야 합니다.": "script_required",
    "로봇이 아님을 확인해 주세요.": "notice",
    "Checking your browser before you proceed": "notice",
}
CONTENT = [
    "경보 화면이 404 숫자를 보이면 회선을 점검합니다.",
    "교육 자료실은 자바스크립트 없이도 열립니다.",
    "누리집에 '페이지를 찾을 수 없습니다'라는 글이 뜨면 전화로 알립니다.",
    "표의 빈칸 [3]에는 12kg를 적고 [별표 2]를 함께 봅니다.",
    "비품 묶음 {담요, 손전등, 물통}은 창고에 둡니다.",
    "The portal shows an error page when the log is full, so staff keep paper copies.",
    "습도는 40%에서 60% 사이로 둡니다.",
    "",
]


def test_residue(spark):
    rows = [(i, t, "h") for i, t in enumerate([*RESIDUE, *CONTENT])]
    df = spark.createDataFrame([*rows, (900, None, None)], "doc_id long, text string, source string").withColumn("kinds", F.lit(1))
    found = {r["doc_id"]: r["kinds"] for r in residue.residue_documents(df, "doc_id", "source", "text").collect()}
    assert set(found) == set(range(len(RESIDUE)))
    for i, kind in enumerate(RESIDUE.values()):
        assert kind in found[i], rows[i]
    assert residue.residue_documents(df.limit(0), "doc_id", "source", "text").count() == 0


def test_recurrent_lines_are_no_evidence(spark):
    footer = "쿠키 설정은 아래에서 바꿉니다"
    rows = [(i, f"본문 {chr(44032 + i)} 내용이 있습니다.\n{footer} {i}", "site") for i in range(20)]
    rows += [(100, f"{footer} 3", "site"), (101, f"다른 곳의 글입니다.\n{footer} 1", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"] for r in residue.residue_documents(df, "doc_id", "source", "text", least_docs=10, least_share=0.2).collect()}
    assert found == {100, 101}


def test_recurrence_does_not_hide_residue(spark):
    field, script, footer = "문의: {{department}}", "Please enable JavaScript to view this page.", "로그인 후 이용"
    rows = []
    for host, n in (("small", 10), ("large", 200)):
        # A tenth each with a placeholder, a script notice and both; nine tenths of another host with a placeholder.
        for i in range(n):
            kind = i * 10 // n
            extra = {0: [field], 1: [script], 2: [field, script]}.get(kind, [])
            rows.append((host, kind, "\n".join([f"본문 {chr(44032 + i)} 내용이 있습니다.", *extra, footer])))
            rows.append((f"{host} form", kind, "\n".join([f"본문 {chr(44032 + i)} 내용이 있습니다.", footer, *([field] if kind else [])])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, kind int, text string")
    found = residue.residue_documents(df, "doc_id", "source", "text").join(df, "doc_id").collect()
    for host, n in (("small", 10), ("large", 200)):
        kinds = [(r["kind"], tuple(r["kinds"])) for r in found if r["source"] == host]
        assert sorted(kinds) == sorted([(0, ("placeholder",)), (1, ("script_required",)), (2, ("placeholder", "script_required"))] * (n // 10))
        kinds = [(r["kind"], tuple(r["kinds"])) for r in found if r["source"] == f"{host} form"]
        assert sorted(kinds) == sorted([(k, ("placeholder",)) for k in range(1, 10)] * (n // 10))


RESIDUE = {
    "본문 {{" + "긴 이름 " * 20 + "}} 입니다.": "placeholder", "값은 ${" + "a" * 90 + "} 입니다.": "placeholder", "안녕 %(user_name)s 님": "placeholder", "Dear {first name}, hello": "placeholder",
    "«name» 귀하": "placeholder", "%%NAME%% 귀하": "placeholder", "[" + "아주 긴 설명이 붙은 담당 부서의 전화 " * 3 + "입력]": "placeholder",
    "\nat com.foo.Bar(Bar.java:12)": "error_page", "503\nBackend fetch failed": "error_page", "404 Page": "error_page", "お探しのページは見つかりません": "error_page", "Страница не найдена": "error_page",
    "<title>" + "기관 소식 " * 30 + "오류</title>": "error_page", "页面不存在": "error_page", "La page introuvable": "error_page",
}
SOUND = ["화면에 '" + "페이지를 찾을 수 없습니다 " * 12 + "'라는 글이 뜨면 알립니다.", "묶음 {세안기, 가스밸브}는 시장에 둡니다.", "빈칸 [7]에는 9L를 적습니다.", "할인율 20% (today) 적용", "값은 404개입니다.", "404개의 문을 닫습니다."]


def test_residue_has_no_bounds(spark):
    df = spark.createDataFrame([(t, k) for t, k in RESIDUE.items()] + [(t, None) for t in SOUND], "t string, kind string")
    for r in df.select("t", "kind", residue.evidence(F.col("t")).alias("kinds")).collect():
        assert (r["kind"] in r["kinds"]) if r["kind"] else not r["kinds"], r


def _samples(pattern, rng, n):
    """Random strings that a pattern matches: its parts at their least and at random lengths."""
    from re import _parser as parser

    plain = pattern.replace(r"\p{L}", "a-z가-힣").replace(r"\p{N}", "0-9").replace(r"\z", "$")

    def one(tokens, groups):
        out = ""
        for op, arg in tokens:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op in ("NOT_LITERAL", "ANY"):
                out += "k"
            elif op == "IN":
                out += pick(arg)
            elif op == "BRANCH":
                out += one(rng.choice(arg[1]), groups)
            elif op == "SUBPATTERN":
                got = one(arg[3], groups)
                groups[arg[0]] = got
                out += got
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                out += "".join(one(inner, groups) for _ in range(rng.randint(low, min(int(high), low + 3))))
            elif op == "GROUPREF":
                out += groups[arg]
            elif op == "AT" or op in ("ASSERT", "ASSERT_NOT"):
                pass
            else:
                raise AssertionError(op)
        return out

    def pick(items):
        negated = str(items[0][0]) == "NEGATE"
        if negated:
            taken = parser.parse("".join("[^" + "".join(cls(i) for i in items[1:]) + "]"))
            import re

            tried = re.compile("[^" + "".join(cls(i) for i in items[1:]) + "]")
            assert taken
            return next(c for c in "k3나-" if tried.match(c))
        op, arg = rng.choice(items)
        return {"LITERAL": lambda: chr(arg), "RANGE": lambda: chr(rng.randint(*arg)) if str(op) == "RANGE" else "", "CATEGORY": lambda: {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "4", "CATEGORY_WORD": "w", "CATEGORY_NOT_WORD": "-", "CATEGORY_NOT_SPACE": "q"}[str(arg)]}[str(op)]()

    def cls(item):
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return "\\" + chr(arg) if not chr(arg).isalnum() and chr(arg) != "\n" else chr(arg)
        if op == "RANGE":
            return f"{chr(arg[0])}-{chr(arg[1])}"
        return {"CATEGORY_SPACE": r"\s", "CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w"}[str(arg)]

    tokens = parser.parse(plain)
    return [one(tokens, {}) for _ in range(n)]


@pytest.mark.parametrize("kind", residue.KINDS)
def test_what_a_pattern_matches_passes_the_automaton(kind):
    rng = random.Random(8)
    for text in _samples(residue.KINDS[kind], rng, 6000):
        assert residue._may_hold(text), text


def test_leaks_in_passes_and_from_few_characters(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("가나다라마바사아자차") for _ in range(6))
    passages = [(i, " ".join(word() for _ in range(12))) for i in range(9)] + [(90, None), (91, "\ufdfa" * 5)]
    docs = [(i, f"앞 {p} 뒤") for i, p in passages[:9]] + [(50, passages[2][1] + " " + passages[7][1]), (60, "\ufdfa" * 5), (61, None), (62, "")]
    p, d = spark.createDataFrame(passages, "pid long, text string"), spark.createDataFrame(docs, "doc_id long, text string").withColumn("p", F.lit(0))
    once = leakage.leaks(d, p, "doc_id", "text", "pid", "text", 40)
    wanted = {(i, i) for i in range(9)} | {(2, 50), (7, 50), (91, 60)}
    assert {(r["pid"], r["doc_id"]) for r in once.collect()} == wanted
    many = leakage.leaks(d, p, "doc_id", "text", "pid", "text", 40, pass_chars=150)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, once.collect()))
    assert leakage.leaks(d, p.limit(0), "doc_id", "text", "pid", "text", 40).count() == 0


def test_pieces_by_tokens(spark):
    import os

    path = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"
    if not os.path.exists(path):
        pytest.skip("no tokenizers here")
    sizes, coder = packing.token_sizes(path), packing.tokenizer(path)
    text = " ".join(f"{i}번째 출입구의 문을 닫고 대피합니다. Close gate {i}! 😀" for i in range(60))
    assert sizes(text).sum() == len(coder.encode_ordinary(text)) and len(sizes(text)) == len(text)
    cut = splitting.split_item(text, 64, 16, sizes)
    sums = [0, *sizes(text).cumsum().tolist()]
    assert len(cut) > 5 and all(sums[b] - sums[a] <= 64 for _, a, b, _ in cut)
    assert all(text[b - 1] == " " or b == len(text) for _, _, b, _ in cut)
    for (_, _, b, _), (_, a, _, _) in zip(cut, cut[1:], strict=False):
        assert 0 < sums[b] - sums[a] <= 16
    rows = splitting.split_items(spark.createDataFrame([(1, text), (1, text), (2, None)], "k long, t string"), ["k"], "t", 64, 16, sizes).collect()
    assert sorted((r["piece_no"], r["start"], r["stop"]) for r in rows) == [(n, a, b) for n, a, b, _ in cut]


FINISHED = [
    "물을 끄고 대피합니다.", "가스를 잠그세요", "손전등을 챙길 것", "1) 문을 닫음\n2) 불을 끔", "최대 기준: 14.5m", "안내문에는 \"잠그세요\"라고 적혀 있습니다. 🙏",
    "준비물\n- 담요\n- 손전등", "끝났습니다. (근거: AB-12)", "문을 닫아 주시기 바람", "Leave by the gate.", "請打開窗戶。", "**안내**",
]
BROKEN = ["문을 닫고 창", "대피 장소까지 3", "측정값은 27.", "그리고 (근거: RH-", "알립니&nb", "확인한 뒤 \\u", "다음 내용은 �", "기준은 ᄀ", "Then open the", "손전등, 들것", "기준을 넘", "문이 열리고 바람", "승강기를 이용할 수"]


def test_ends(spark):
    df = spark.createDataFrame([(t, True) for t in BROKEN] + [(t, False) for t in FINISHED], "t string, broken boolean")
    # The exclusions of the operator on cut texts know complete sentences and notes only.
    complete = df.filter(endings.complete(endings.trimmed(F.col("t")))).collect()
    assert not any(r["broken"] for r in complete)
    assert {r["t"] for r in complete} >= {t for t in FINISHED if t.rstrip(" 🙏)")[-1] in ".。"} | set(FINISHED[1:4])
    assert all(endings.is_abrupt(t) for t in BROKEN) and not any(endings.is_abrupt(t) for t in FINISHED)


Q = "지하 주차장에 물이 차오르면 차량 안의 사람은 무엇부터 해야 합니까?"
ANSWERS = {
    "": ["empty"], "  　": ["empty"], "답변:": ["empty"], "<think>생각 중</think>": ["empty"], "null": ["empty"], "ERROR: timed out after 30s": ["empty"], "```\n```": ["empty"], "...": ["empty"],
    "죄송하지만 이 질문에는 답변드릴 수 없습니다.": ["refusal"], "I'm sorry, but I cannot help with that.": ["refusal", "language"], "抱歉，我无法回答这个问题。": ["refusal", "language"],
    Q: ["copy"], f"질문: {Q}": ["copy"], Q.replace(" ", ""): ["copy"], f"물어보신 내용은 다음과 같습니다: {Q}": ["copy"],
    "Open the door at once and leave the car for higher ground.": ["language"], "まずドアを開けて、すぐに高い場所へ逃げてください。": ["language"], "Trước hết mở cửa xe, sau đó chạy lên chỗ cao hơn.": ["language"],
    "문을 열고 계단으로 올라간 뒤 안내원의 지": ["truncated"],
    "문을 열고 계단으로 올라갑니다.": [], f"{Q} 문을 열고 위층으로 올라가야 합니다.": [], "1) 문을 엶\n2) 위로 감": [],
    "승강기는 탈 수 없으며 계단으로 올라갑니다.": [], "이 질문에 답하기 어렵다는 의견이 있었으나 먼저 문을 열어야 합니다.": [],
    "죄송하다는 말보다 먼저 차 문을 열고 나갑니다.": [], "42": [],
}


@pytest.mark.parametrize("answer", ANSWERS)
def test_defects(answer):
    found = pairs.defects(Q, answer)
    assert [d for d in found if d != "truncated" or ANSWERS[answer] == ["truncated"]] == ANSWERS[answer] or answer == "42"


def test_rules_are_quick_on_long_texts():
    import time

    n = 60_000
    for text in ("-" * n, "timed out " + "-" * n + "x.", "(" * n + "]" * n, '"' * n, "<" * n, "a" * n, "a" + " " * n + "b ", "kann nicht " * (n // 10), "「" * n + "」" * n, "```" * n, "을 " * n, "&" * n, "<b>" * n, "error: " * n):
        began = time.perf_counter()
        pairs.defects(Q, text)
        residue._may_hold(text)
        assert time.perf_counter() - began < 5, text[:12]


def test_defective_pairs_edges(spark):
    rows = [(1, Q, "", 1), (1, Q, "문을 엽니다.", 2), (2, Q, None, 1), (2, Q, None, 1), (3, None, "문을 엽니다.", 1), (4, Q, "가 " * 50_000 + "합니다.", 1), (None, Q, "-", 1)]
    df = spark.createDataFrame(rows, "k long, question string, a string, t int").withColumn("defect", F.lit("x")).withColumn("_k", F.lit(0))
    got = {(r["k"], r["defect"]) for r in pairs.defective_pairs(df, "k", "question", ["a"], "t").filter("position = 0").collect()}
    assert got == {(2, "empty"), (None, "empty")}
    assert pairs.defective_pairs(df.limit(0), "k", "question", ["a"], "t").count() == 0


def test_cut_texts(spark):
    rng = random.Random(5)
    names = ["소화기를", "담요를", "손전등을", "물통을"]
    verbs = ["확인합니다", "치웁니다", "옮깁니다"]
    sentence = lambda: f"{rng.randint(1, 9)}층 창고에서 {rng.choice(names)} 먼저 {rng.choice(verbs)}."
    rows, cut = [], set()
    for i in range(400):
        text = " ".join(sentence() for _ in range(5))
        if i % 20 == 0:
            text = text[: -rng.randint(4, 9)]
            cut.add(i)
        elif i % 7 == 0:
            text = text[:-1]
        rows.append((i, text, Q, 1))
    rows += [(1000, None, Q, 1), (1001, "", Q, 1), (0, rows[0][1], Q, 1), (1002, "끝까지 갑니다. " * 30_000, Q, 1)]
    df = spark.createDataFrame(rows, "k long, text string, question string, t int").withColumn("cut", F.lit("clash"))
    found = truncation.cut_texts(df, "k", {"text": "question"}, "t")
    assert {r["k"] for r in found.collect()} == cut
    rates = truncation.cut_rates(df.withColumn("m", F.lit("a")), "k", {"text": "question"}, ["m"], "t").collect()
    assert [(r["n_values"], r["n_cut"]) for r in rates] == [(403, len(cut))]
    assert truncation.cut_texts(df.limit(0), "k", {"text": "question"}, "t").count() == 0


def test_counts_decide_what_is_cut(spark):
    """Lists, notes and headings that other texts end with are no cuts; their words inside are."""
    rng = random.Random(6)
    things = ["소화기", "담요", "손전등", "물통", "사다리", "안전모"]
    sentence = lambda: f"{rng.randint(1, 9)}층 창고에서 {rng.choice(things)}를 먼저 확인하고 {rng.choice(things)}를 옮깁니다."
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence() for _ in range(4))
        if i % 3 == 0:
            text += "\n준비물\n- " + "\n- ".join(rng.choice(things) for _ in range(rng.randint(2, 4)))
        if i % 10 == 1:
            end = rng.choice(["를 먼저 확인하고 손전등을", "를 먼저", "를 먼", "를 먼저 확인하고&nb", "를 먼저 확"])
            text += f" 7층 창고에서 {rng.choice(things)}{end}"
            cut.add(i)
        rows.append((i, text))
    df = spark.createDataFrame(rows, "k long, text string")
    found = {r["k"] for r in truncation.cut_texts(df, "k", {"text": None}).collect()}
    assert found == cut
    shares = truncation.final_shares(df.select(F.lit("x").alias("field_name"), "text"))
    share = {r["trigram"]: r["share"] for r in shares.collect()}
    hashed = spark.sql("select xxhash64('에서', '기를', '먼저') as x").first()[0]
    assert share[hashed] < 0.02
    listed = [r[0] for r in spark.createDataFrame([(t[-2:],) for t in things], "t string").select(F.xxhash64(F.lit("\n"), F.lit("-"), "t")).collect()]
    assert min(share[x] for x in listed if x in share) > 0.02 and sum(x in share for x in listed) > 3


def test_cuts_at_one_place_do_not_vouch_for_one_another(spark):
    things = ["소화기", "담요", "손전등", "물통", "사다리", "안전모"]
    sentence = lambda i, k: f"{i}층 창고에서 {things[k % 6]}를 먼저 확인하고 {things[(k + 1) % 6]}를 옮깁니다."
    rows = [(i, f"{i}번 안내. " + " ".join(sentence(i % 9 + 1, i + k) for k in range(4))) for i in range(400)]
    # Twenty texts break off within one and the same word; once that part stands by itself.
    rows += [(1000 + i, f"{i}번 안내. {sentence(i % 9 + 1, i)} 3층 창고에서 소화기를 먼저 확인하고 담요를 옮깁") for i in range(20)]
    rows += [(2000, "3층 창고에서 담요를 옮깁 니다. " + sentence(3, 1))]
    found = truncation.cut_texts(spark.createDataFrame(rows, "k long, text string"), "k", {"text": None})
    assert {r["k"] for r in found.collect()} == set(range(1000, 1020))
