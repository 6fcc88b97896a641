"""Queries that write files and read them again, load documents, and replay events."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import text as t
from ..operators.retrieval import contexts, top_k
from ..session import checkpoint_folder
from ..sources import files
from ..streaming.frames import rewound
from ..streaming.incremental import windowed_counts
from .registry import Registry, read

R = Registry()


def _folder(spark: SparkSession) -> str:
    """A new place in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


@R.query("select model, condition, count(*) as n, round(avg(elapsed_sec), 4) as seconds from experiment_results where model is not null and condition is not null group by 1, 2")
def csv_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary written as CSV with a byte-order mark and read again."""
    path, e = _folder(spark), read(spark, d, "experiment_results").filter("model is not null and condition is not null")
    files.write_csv(e.groupBy("model", "condition").agg(F.count("*").alias("n"), F.round(F.avg("elapsed_sec"), 4).alias("seconds")), path)
    return files.read_csv(spark, path, "model string, condition string, n bigint, seconds double")


@R.query("select distinct id, question, gold_answer, split from qa_dataset")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON and read again, null fields included."""
    path = _folder(spark)
    files.write_json(read(spark, d, "qa_dataset").select("id", "question", "gold_answer", "split").distinct(), path)
    return spark.read.schema("id string, question string, gold_answer string, split string").json(path)


@R.query("""
select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * i)), 5) as mark, (select count(*) from chunks c where c.chunk_id = vec_id) > 0 as known
from embeddings where vec_id in (select chunk_id from chunks)
""")
def index_records(spark: SparkSession, d: str) -> DataFrame:
    """Vectors beside the texts of equal number, written as an index and read again."""
    path, vectors = _folder(spark), read(spark, d, "embeddings").select("vec_id", "embedding")
    texts = read(spark, d, "chunks").groupBy(F.col("chunk_id").alias("vec_id")).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    files.write_index(vectors, texts, "vec_id", path)
    mark = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(1), F.lit(64)), lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, b: a + b)
    return files.read_index(spark, path).select("vec_id", F.round(mark, 5).alias("mark"), (F.col("copies") > 0).alias("known"))


def _docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        lines = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


def _pdf(text: str) -> bytes:
    """One page whose font maps two-byte codes to Unicode as they are; the stream is deflated."""
    shown = "\n".join(f"<{line.encode('utf-16-be').hex()}> Tj T*" for line in text.split("\n"))
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    page = zlib.compress(f"BT /F1 12 Tf 14 TL 1 0 0 1 50 700 Tm\n{shown}\nET".encode())
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(page) + page + b"\nendstream",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>",
        b"<< /Length %d >>\nstream\n" % len(cmap) + cmap.encode() + b"\nendstream",
    ]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % n + body + b"\nendobj\n" for n, body in enumerate(parts, 1))


_MAKE = {".docx": _docx, ".pdf": _pdf, ".txt": lambda x: b"\xef\xbb\xbf" + x.encode(), ".doc": lambda x: x.encode()}
_KINDS = list(_MAKE)
_LINES = "list_filter(string_split(title || chr(10) || chr(10) || '문서 번호는 ' || doc_id || '번이고 이 줄은 충분히 깁니다. (끝)', chr(10)), lambda x: trim(x) <> '')"


@R.query(f"""
select doc_id, kind, case kind when '.doc' then '' when '.txt' then title || chr(10) || chr(10) || '문서 번호는 ' || doc_id || '번이고 이 줄은 충분히 깁니다. (끝)'
  when '.docx' then array_to_string({_LINES}, chr(10)) else title || chr(10) || '문서 번호는 ' || doc_id || '번이고 이 줄은 충분히 깁니다. (끝)' end as text
from documents, (values ('.docx'), ('.pdf'), ('.txt'), ('.doc')) k(kind) where title is not null
""")
def loaded_files(spark: SparkSession, d: str) -> DataFrame:
    """Every title as a file of each kind, loaded by its extension; a kind without a loader gives no text."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[_MAKE[k](x) for k, x in zip(frame["file_type"], frame["text"], strict=True)])[["doc_id", "file_type", "content"]]

    body = F.concat("title", F.lit("\n\n문서 번호는 "), "doc_id", F.lit("번이고 이 줄은 충분히 깁니다. (끝)"))
    wide = read(spark, d, "documents").filter("title is not null").select("doc_id", F.explode(F.array(*map(F.lit, _KINDS))).alias("file_type"), body.alias("text"))
    loaded = files.loaded(wide.mapInPandas(made, "doc_id bigint, file_type string, content binary"))
    return loaded.select("doc_id", F.col("file_type").alias("kind"), F.regexp_replace("text", r"\n\n", F.when(F.col("file_type") == ".pdf", "\n").otherwise("\n\n")).alias("text"))


@R.query("select cast(epoch(time_bucket(interval 5 minutes, ts)) as bigint) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    counted = windowed_counts(read(spark, d, "events"), "ts", "event_type")
    return counted.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@R.query("select event_id, event_id % 30 as source_frame, lag(value) over (partition by event_id // 30 order by event_id) as previous_value from events")
def frame_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of videos of thirty: their own numbers and the value of the frame before."""
    frames = rewound(read(spark, d, "events").withColumn("video", F.floor(F.col("event_id") / 30)), "event_id", 30)
    return files.with_previous(frames, "video", "event_id", ["value"]).select("event_id", "source_frame", "previous_value")


@R.query("select id, loaded_at, case when question is null or trim(question) = '' then '' else trim(string_split(trim(question), chr(10))[-1]) end as answer from qa_dataset")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """The place for a language model, with the stand-in that says the last line again."""
    asked = read(spark, d, "qa_dataset").select("id", "loaded_at", F.trim("question").alias("prompt"))
    return adapters.answered(asked, "prompt", adapters.echo_model).select("id", "loaded_at", F.trim("answer").alias("answer"))


_NAMES = "list_distinct(list_filter(string_split(title, ' '), lambda x: length(x) > 1))"


@R.query(f"select doc_id, array_to_string(list_sort({_NAMES}), '|') as names from (select doc_id, title from documents where title is not null)")
def verified_names(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that a stand-in for the verifying model keeps, out of its fenced reply."""

    def model(prompts: list[str]) -> list[str]:
        return ["```json\n{'names': '" + p + "',}\n```" for p in prompts]

    words = F.array_distinct(F.filter(F.split("title", " "), lambda x: F.length(x) > 1))
    asked = read(spark, d, "documents").filter("title is not null").select("doc_id", F.array_join(words, ", ").alias("prompt"))
    reply = adapters.answered(asked, "prompt", model, "reply")
    return reply.select("doc_id", F.array_join(F.array_sort(adapters.verified(F.col("reply"), ["names"])["names"]), "|").alias("names"))


@R.query("""
with n as (select count(*) as n from embeddings),
c as (select chunk_id, min(text) as text from chunks where text is not null group by 1),
v as (select chunk_id, text, cast(embedding as double[]) as v from c, n join embeddings on vec_id = chunk_id % n.n),
q as (select vec_id, cast(embedding as double[]) as v from embeddings),
s as (select q.vec_id, v.chunk_id, v.text, round(list_dot_product(q.v, v.v), 9) as score from q, v),
k as (select * from s qualify row_number() over (partition by vec_id order by score desc, chunk_id) <= 3),
x as (select vec_id, substring(string_agg(text, chr(10) || chr(10) order by score desc, chunk_id), 1, 800) as context from k group by 1)
select i.item_id, i.loaded_at, md5('user: ' || '[문서]' || chr(10) || coalesce(x.context, '') || chr(10) || '[질문]' || chr(10)
  || coalesce(list_filter(messages, lambda m: lower(m.role) = 'user')[1].content, '') || chr(10) || 'assistant: ' || coalesce(list_filter(messages, lambda m: lower(m.role) = 'assistant')[1].content, '')) as chat_md5
from ft_dataset i cross join n left join x on x.vec_id = i.item_id % n.n
""")
def rag_prompt_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Fine-tuning items whose prompt holds the three chunks nearest to the question, cut to
    800 characters. The table of vectors stands in for an embedder: text number i has vector i
    of as many as there are, so that equal vectors are searched for once."""
    from ..operators import finetune as f

    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    chunks = read(spark, d, "chunks").filter("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    corpus = chunks.select("chunk_id", (F.col("chunk_id") % n).alias("vec_id")).join(vectors, "vec_id").select("chunk_id", "embedding")
    hits = top_k(corpus, vectors.withColumnRenamed("vec_id", "chunk_id"), "chunk_id", "embedding", 3)
    found = contexts(hits, chunks, "chunk_id", "text", 800)
    items = read(spark, d, "ft_dataset").withColumn("query_id", F.col("item_id") % n).join(found, "query_id", "left")
    prompt = t.fill_template("[문서]\n{context}\n[질문]\n{question}", context=F.col("context"), question=f.first_by_role(F.col("messages"), "user"))
    return items.select("item_id", "loaded_at", F.md5(f.rendered(f.without_system(F.col("messages"), prompt))).alias("chat_md5"))
