"""Sources, adapters and streams on files made by the tests."""

from __future__ import annotations

import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace import adapters
from millrace.sources import files
from millrace.streaming import frames, incremental


def docx(path, lines):
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_files(spark, tmp_path):
    for folder in ("지진_1", "화재"):
        (tmp_path / folder).mkdir()
    docx(tmp_path / "지진_1" / "a.DOCX", ["첫 줄", " ", "둘째 줄"])
    (tmp_path / "화재" / "b.txt").write_text("﻿글", encoding="utf-8")
    (tmp_path / "화재" / "c.docx").write_bytes(b"broken")
    (tmp_path / "화재" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "화재" / "d.doc").write_bytes(b"x")
    (tmp_path / "화재" / "c.doc").write_bytes(b"x")
    tree = files.file_tree(spark, str(tmp_path))
    assert {r["file_type"]: r["n"] for r in files.extension_histogram(tree).collect()} == {".doc": 2, ".docx": 2, ".pdf": 1, ".txt": 1}
    assert {r["source_file"] for r in files.unless_present(tree, ".pdf", ".doc").collect()} == {"a.DOCX", "b.txt", "c.docx", "c.pdf", "d.doc"}
    wanted = files.file_tree(spark, str(tmp_path), [".docx", ".txt", ".pdf"])
    got = {r["source_file"]: (r["category"], r["text"], bool(r["error"])) for r in files.loaded(wanted, {".pdf": lambda b: "page"}).collect()}
    assert got == {"a.DOCX": ("지진", "첫 줄\n둘째 줄", False), "b.txt": ("화재", "글", False), "c.docx": ("화재", None, True), "c.pdf": ("화재", "page", False)}
    pages = spark.createDataFrame([(["x" * 31, " " * 40, "short"],)], "p array<string>")
    assert pages.select(files.kept_pages(F.col("p"))).first()[0] == "x" * 31


def test_json_csv_index(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "Q001", "x": "가"}, {"id": "Q002", "x": null}]', encoding="utf-8")
    df = files.read_json_array(spark, str(tmp_path / "a.json"))
    assert df.count() == 2
    files.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "s.csv").write_text("﻿model,condition,score\nexaone,rag,0.7\nqwen3,rag,\n", encoding="utf-8")
    csv = files.read_csv(spark, str(tmp_path / "s.csv"))
    assert csv.columns == ["model", "condition", "score"] and csv.filter("score is null").count() == 1
    files.write_csv(csv, str(tmp_path / "csv"))
    assert all(f.read_bytes().startswith("\ufeffmodel,".encode()) for f in (tmp_path / "csv").glob("*.csv"))
    again = files.read_csv(spark, str(tmp_path / "csv"))
    assert again.columns == csv.columns and sorted(map(str, again.collect())) == sorted(map(str, csv.collect()))
    vectors = spark.createDataFrame([(1, [0.5, 0.5])], "id int, embedding array<double>")
    files.write_index(vectors, spark.createDataFrame([(1, "t")], "id int, text string"), "id", str(tmp_path / "index"))
    assert files.read_index(spark, str(tmp_path / "index")).first()["text"] == "t"
    (tmp_path / "calib.txt").write_text("10 7\nleft1.jpg\nright1.jpg\nleft2.jpg\nright2.jpg\n")
    pairs = sorted(tuple(r) for r in files.calibration_pairs(spark, str(tmp_path / "calib.txt")).collect())
    assert pairs == [(0, "left1.jpg", "right1.jpg", 10, 7), (1, "left2.jpg", "right2.jpg", 10, 7)]


def pdf(pages, stream=lambda b: (b"", b), extra=()):
    """A PDF with one content stream a page; Latin text in plain strings."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))))]
    for i, content in enumerate(pages):
        head, body = stream(content)
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), head, body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in enumerate([*parts, *extra], 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages():
    import zlib

    from millrace.plans.sources import _pdf
    from millrace.sources.pdf import pdf_pages

    first = rb"BT /F1 12 Tf 72 700 Td (Close \(all\) gates \151n time) Tj 0 -14 Td [(Leave) -300 (by) -250 (the) 20 ( stairs)] TJ (and wait) ' ET"
    second = b"BT 72 700 Td <48656C6C6F> Tj 60 0 Td (there) Tj ET"
    wanted = ["Close (all) gates in time\nLeave by the stairs\nand wait", "Hello there"]
    assert pdf_pages(pdf([first, second])) == wanted
    assert pdf_pages(pdf([first, second], lambda b: (b"/Filter /FlateDecode", zlib.compress(b)))) == wanted
    assert pdf_pages(pdf([b"\xff\xd8 picture"], lambda b: (b"/Filter /DCTDecode", b))) == [""]
    assert pdf_pages(_pdf("지진이 나면 문을 연다 😀\n둘째 줄")) == ["지진이 나면 문을 연다 😀\n둘째 줄"]
    packed = zlib.compress(b"7 0 8 36 << /Type /Pages /Kids [8 0 R] >>    << /Type /Page /Contents 4 0 R >>")
    whole = b"%PDF-1.5\n4 0 obj\n<< /Length 20 >>\nstream\nBT (In a stream) Tj ET\nendstream\nendobj\n9 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    assert pdf_pages(whole) == ["In a stream"]
    for bad in (b"", b"no pdf", b"<html>"):
        try:
            pdf_pages(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert files.pdf_pages_text(pdf([first, second])) == wanted[0]


def test_adapters(spark):
    df = spark.createDataFrame([(1, "가나다"), (2, "가나다"), (3, None)], "id int, t string")
    v = {r["id"]: np.array(r["embedding"]) for r in adapters.embedded(df, "t", adapters.hashed_embedder(16)).collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-4

    def model(prompts):
        if any(p is None for p in prompts):
            raise ValueError("no prompt")
        return [p + "!" for p in prompts]

    got = {r["id"]: r["answer"] for r in adapters.answered(df, "t", model).collect()}
    assert got == {1: "가나다!", 2: "가나다!", 3: "ERROR: no prompt"}
    assert adapters.echo_model(["a\nb", ""]) == ["b", ""]
    found = spark.createDataFrame([("본문", ["홍길동"], ["x"])], "t string, n array<string>, a array<string>")
    prompt = found.select(adapters.verification_prompt(F.col("t"), {"names": F.col("n")}).alias("p")).first()["p"]
    assert "홍길동" in prompt and "본문" in prompt and "주소만" not in prompt
    reply = spark.createDataFrame([("```json\n{'names': '홍길동, 김',}\n```",), ("oops",), ('{"names": ["a"]}',)], "r string")
    assert [r[0]["names"] for r in reply.select(adapters.verified(F.col("r"), ["names"])).collect()] == [["홍길동", "김"], [], ["a"]]
    tags = adapters.tagged(df, "t", lambda texts: [[(c, "O", 1.0) for c in t] for t in texts]).filter("id = 1").first()["tokens"]
    assert [x["token"] for x in tags] == ["가", "나", "다"]
    scored = adapters.judged(df, lambda f: pd.DataFrame({"s": f["t"].str.len()}), ["t"], ["s"]).orderBy("id").collect()
    assert [r["s"] for r in scored][:2] == [3.0, 3.0]


def test_incremental_runs_do_work_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    calls = spark.sparkContext.accumulator(0)

    def work(df):
        def count(frames_):
            for f in frames_:
                calls.add(len(f))
                yield f

        return df.mapInPandas(count, df.schema)

    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string").write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        incremental.run_available(spark, source, schema, sink, check, work, ["id"])
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, x string").write.mode("append").parquet(source)
    incremental.run_available(spark, source, schema, sink, check, work, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3] and calls.value == 3


def test_windowed_counts(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:04:59', 'a' union all select timestamp'2024-01-01 00:05:00', 'a'")
    assert sorted(r["n"] for r in incremental.windowed_counts(rows, "ts", "k").collect()) == [1, 2]


def test_frames_keep_state_between_batches(spark, tmp_path):
    source = str(tmp_path / "frames")
    kind = "video long, frame long, labels array<long>, picked array<long>"
    parts = [[(1, 0, [1, 2], [1, 2]), (1, 1, [1, 2, 3], [3])], [(1, 2, [2, 3], []), (1, 3, [1, 2, 3], None)]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{source}/n={n}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = frames.selections(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["frame"]: r["kept"] for r in spark.table("kept").collect()}
    assert got[0] == [1, 2] and got[1] == [1, 2, 3] and got[2] == [2, 3] and got[3] == [2, 3]


def test_tracks(spark, tmp_path):
    source = str(tmp_path / "points")
    kind = "video long, frame long, x double, y double"
    for n, row in enumerate([(1, 0, 0.0, 0.0), (1, 1, 2.0, 2.0)]):
        spark.createDataFrame([row], kind).coalesce(1).write.parquet(f"{source}/n={n}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    moving = frames.tracks(stream, lambda last, new: [(a + b) / 2 for a, b in zip(last, new, strict=True)])
    query = moving.writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("tracks").orderBy("frame").collect()
    assert [r["length"] for r in rows] == [1, 2] and rows[1]["x"] == 1.0
    assert frames.rewound(spark.table("tracks"), "frame", 1).agg(F.max("source_frame")).first()[0] == 0
