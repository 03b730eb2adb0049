"""From questions to answers: embed, retrieve, fuse, re-rank or diversify, pack, ask, record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import ingest, retrieval, sessions


def retrieve(questions: DataFrame, store: DataFrame, make: Callable = ingest.hashing_embedder, k: int = retrieval.DEFAULT_K, limits: dict[str, int] | None = None) -> DataFrame:
    """(qid, id, document, file_path, collection_name, score, col_pos, rank_in_col): the hits of each question and collection.

    questions has qid and text, store what ingest.store wrote (id is unique within a collection). The
    questions are embedded as they are; null texts have no hit.
    """
    asked = ingest.embed(questions.where("qid IS NOT NULL AND text IS NOT NULL").select("qid", "text"), make)
    rows = store.withColumn("vec_id", F.xxhash64("collection", "id"))
    found = retrieval.nearest(asked, rows, k, exclude_self=False, limits=limits)
    back = found.join(rows.select("vec_id", "id", F.col("text").alias("document"), "file_path"), "vec_id")
    order = {name: n for n, name in enumerate(sorted(r[0] for r in store.select("collection").distinct().where("collection IS NOT NULL").collect()))}  # one row a collection
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("collection")), F.lit(-1)) if order else F.lit(-1)
    return back.select("qid", "id", "document", "file_path", F.col("collection").alias("collection_name"), "score", place.alias("col_pos"), F.col("rank").alias("rank_in_col"))


def choose(questions: DataFrame, fused: DataFrame, mode: str = "cap", scorer: Callable[[str], str] | None = None, n: int = retrieval.SNIPPETS, embeddings: DataFrame | None = None) -> DataFrame:
    """fused with fused_pos made new: the first n, re-ranked by a scorer (mode rerank) or diversified (mode mmr).

    rerank needs a scorer, mmr the embeddings (id, embedding) of the hits; without them, as with cap, the order stays.
    """
    if mode not in ("cap", "rerank", "mmr"):
        raise ValueError(mode)
    if mode == "rerank" and scorer is not None:
        said = retrieval.replies(retrieval.scorer_requests(questions, fused), scorer)
        return retrieval.rerank(fused, said, n).drop("fused_pos").withColumnRenamed("rerank_pos", "fused_pos")
    if mode == "mmr" and embeddings is not None:
        first = fused.where(F.col("fused_pos") <= retrieval.CANDIDATES).join(embeddings.select("id", "embedding").dropDuplicates(["id"]), "id", "left")
        order = retrieval.diversify(first.select("qid", "id", F.col("fused_pos").alias("pos"), "score", "embedding"), n)
        return fused.drop("fused_pos").join(order.withColumnRenamed("place", "fused_pos"), ["qid", "id"])
    return retrieval.cap(fused, n)


def prompt(questions: DataFrame, chosen: DataFrame, budget: int = retrieval.CONTEXT_TOKENS) -> DataFrame:
    """(qid, messages): the packed context of each question as messages."""
    label = T.source_label(F.col("file_path"), F.lit(None).cast("string"), F.col("id"), *(F.lit(None).cast("int") for _ in range(3)))
    language = T.fence_language(F.lit(None).cast("string"), F.col("file_path"))
    packed = retrieval.pack(chosen.withColumns({"label": label, "language": language}), budget=budget)
    return retrieval.messages(questions, retrieval.contexts(packed))


def complete(requests: DataFrame, model: Callable[[str], Iterator[str]]) -> DataFrame:
    """(qid, seq, delta, error): what a model says to each request (qid, messages), piece by piece.

    A model that breaks off has its error in a last row, behind the pieces that came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for qid, request in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = 0
                try:
                    for piece in model(request):
                        rows.append((qid, seq, piece, None))
                        seq += 1
                except Exception as e:  # noqa: BLE001 - one answer must not stop the others
                    rows.append((qid, seq, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["qid", "seq", "delta", "error"])

    asked = requests.select(F.col("qid").cast("long"), F.to_json("messages").alias("request"))
    return asked.mapInArrow(run, "qid long, seq long, delta string, error string")


def ask(questions: DataFrame, store: DataFrame, model: Callable[[str], Iterator[str]], make: Callable = ingest.hashing_embedder, mode: str = "cap", scorer: Callable[[str], str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """(qid, answer, error): each question's answer with its links normalised; a model that failed has an error and what it said before."""
    hits = retrieve(questions, store, make, limits=limits)
    fused = retrieval.fuse_by_score(retrieval.positions(hits))
    embeddings = store.select("id", "embedding") if mode == "mmr" else None
    said = complete(prompt(questions, choose(questions, fused, mode, scorer, embeddings=embeddings)), model)
    failed = said.where("error IS NOT NULL").groupBy("qid").agg(F.max("error").alias("error"))
    spoken = sessions.answers(said.where("error IS NULL").select(F.col("qid").alias("session_id"), "seq", "delta"))
    return spoken.withColumnRenamed("session_id", "qid").join(failed, "qid", "full").select("qid", F.col("content").alias("answer"), "error")


def finish(history: DataFrame, turns: DataFrame, deltas: DataFrame) -> DataFrame:
    """The completion hook: history with each session's turn, whose answer is its deltas joined with links normalised.

    turns has session_id and question; a session whose answer is empty or lacks records nothing.
    """
    said = sessions.answers(deltas).where(F.length("content") > 0).select("session_id", F.col("content").alias("answer"))
    return sessions.record_turns(history, turns.select("session_id", "question").join(said, "session_id"))


def parse_events(stream: DataFrame) -> DataFrame:
    """(session_id, place, kind, value) of stored event streams (session_id, place, frame).

    kind is content, normalised, error or done; frames that are none of them are dropped.
    """
    body = F.regexp_extract("frame", r"^data: ([\s\S]*?)\n\n$", 1)
    get = lambda name: F.get_json_object(body, f"$['{name}']")
    kind = F.when(body == "[DONE]", "done").when(get("content").isNotNull(), "content").when(get("[NORMALIZED_CONTENT]").isNotNull(), "normalised").when(get("error").isNotNull(), "error")
    value = F.coalesce(get("content"), get("[NORMALIZED_CONTENT]"), get("error"))
    return stream.select("session_id", "place", kind.alias("kind"), F.when(body != "[DONE]", value).alias("value")).where("kind IS NOT NULL")
