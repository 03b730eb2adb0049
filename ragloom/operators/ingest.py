"""Storing new chunks: keep-first, anti-join with what is stored, embedding with retries, partitioned sink."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.chunkers import newline_pieces, split_oversize
from ragloom.operators.paths import keep_first
from ragloom.runtime import cut

ATTEMPTS, FIRST_DELAY, MAX_DELAY = 3, 0.2, 5.0
#: Characters of an item the embedder takes, and from which on a failing one is split.
LIMIT, RETRY_CHARS = 12000, 4000
STORED = "id string, text string, file_path string, embedding array<float>, norm double, collection string"


def new_chunks(chunks: DataFrame, stored_ids: DataFrame | None, order: str = "seq") -> DataFrame:
    """The first row of each id, without the ids that are stored. Null ids are dropped; nothing is renamed."""
    first = keep_first(chunks.where("id IS NOT NULL"), "id", order)
    return first if stored_ids is None else first.join(stored_ids.select("id"), "id", "left_anti")


def hashing_embedder(size: int = 64) -> Callable[[str], list[float]]:
    """A deterministic embedder without a model: signed hashes of the words."""

    def embed(text: str) -> list[float]:
        v = np.zeros(size)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return embed


class Unavailable(Exception):
    """An embedder's error that may pass; anything else is raised at once."""


def with_retries(embed: Callable[[str], list[float]], text: str, sleep: Callable[[float], None] = time.sleep) -> list[float]:
    """Up to ATTEMPTS calls with doubled delays; the last failure is raised."""
    delay = FIRST_DELAY
    for attempt in range(ATTEMPTS):
        try:
            return embed(text)
        except Unavailable:
            if attempt == ATTEMPTS - 1:
                raise
            sleep(delay)
            delay = min(MAX_DELAY, 2 * delay)
    raise AssertionError


def embedded_records(embed: Callable[[str], list[float]], id_: str, text: str, limit: int = LIMIT, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, str, list[float] | None, str | None]]:
    """(id, text, vector, error) of a record, or of the pieces it is split into where the embedder keeps failing.

    A text above RETRY_CHARS that failed is cut at newlines into halves (at least RETRY_CHARS long), whose
    ids name the record; they go to the front of the queue and may be split again. A text that cannot be
    split, and one with an error that does not pass, has its error.
    """
    queue, seen, out = deque([(id_, text)]), {id_}, []
    while queue:
        own, t = queue.popleft()
        try:
            out.append((own, t, with_retries(embed, t, sleep), None))
        except Unavailable as e:
            pieces = []
            if len(t) > RETRY_CHARS:
                for i, piece in enumerate(newline_pieces(t, max(RETRY_CHARS, min(limit, len(t) // 2)))):
                    name = f"{own}#split{i}_{hashlib.md5(piece.encode('utf-8', 'surrogatepass')).hexdigest()[:8]}"
                    if name not in seen:
                        seen.add(name)
                        pieces.append((name, piece))
            if not pieces:
                out.append((own, t, None, f"{type(e).__name__}: {e}"))
            queue.extendleft(reversed(pieces))
        except Exception as e:  # noqa: BLE001 - kept with the record, so that what was embedded is not lost
            out.append((own, t, None, f"{type(e).__name__}: {e}"))
    return out


def embed(chunks: DataFrame, make: Callable[[], Callable[[str], list[float]]] = hashing_embedder, text: str = "text", id_: str | None = None, limit: int = LIMIT) -> DataFrame:
    """chunks with embedding and norm; one embedder for each task. Null texts have null vectors.

    With an id column, records the embedder keeps failing on become pieces (see embedded_records), and a
    column error tells what could not be embedded; without one a failure is raised.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", embedding array<float>, norm double" + (", error string" if id_ else "")
    at = chunks.columns.index(text)
    named = chunks.columns.index(id_) if id_ else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        norm = lambda v: None if v is None else float(np.linalg.norm(v))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names = [*batch.schema.names, "embedding", "norm"]
            if named is None:
                vectors = [None if t is None else with_retries(one, t) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([norm(v) for v in vectors], pa.float64())], names=names)
                continue
            rows, got = [], []
            for k, (own, t) in enumerate(zip(batch.column(named).to_pylist(), texts)):
                made = [(own, t, None, None)] if t is None else embedded_records(one, str(own), t, limit)
                rows += [k] * len(made)
                got += made
            columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            columns[at] = pa.array([g[1] for g in got], pa.string())
            columns[named] = pa.array([g[0] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[2] for g in got], pa.list_(pa.float32())), pa.array([norm(g[2]) for g in got], pa.float64()), pa.array([g[3] for g in got], pa.string())], names=[*names, "error"])

    return chunks.mapInArrow(run, schema)


def stored_ids(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame | None:
    """The ids in a store, of one collection if given; None if there is no store."""
    rows = open_store(spark, path)
    if rows is None:
        return None
    return (rows if collection is None else rows.where(F.col("collection") == collection)).select("id")


def open_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored chunks, None if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not any("collection=" in s.getPath().getName() for s in fs.listStatus(hadoop)):
        return None
    return spark.read.schema(STORED).parquet(path)


def store(chunks: DataFrame, path: str) -> None:
    """Append embedded chunks to the store, a folder for each collection."""
    names = [x.split()[0] for x in STORED.split(", ")]
    chunks.select(*names).write.mode("append").partitionBy("collection").parquet(path)


class NotAllEmbedded(Exception):
    """Some records could not be embedded; all others are stored."""


def update(chunks: DataFrame, path: str, limit: int = LIMIT, make: Callable[[], Callable[[str], list[float]]] = hashing_embedder) -> DataFrame:
    """Split, keep first, leave out what is stored, embed and append; returns what was new.

    Splitting comes before the anti-join, so that oversized chunks are not embedded again each run.
    What could be embedded is stored before a failure is raised. Stored chunks are never removed. The
    new rows are cut in the shared folder, so that they are embedded once.
    """
    split = split_oversize(chunks, limit).withColumn("_rl_order", F.struct("was_split", "seq", "piece"))
    fresh = new_chunks(split, stored_ids(chunks.sparkSession, path), "_rl_order").select("id", "text", "file_path", "collection")
    seen = Observation()
    made = embed(fresh, make, id_="id", limit=limit).observe(seen, F.count("error").alias("failed"), F.max("error").alias("error"))
    made = cut(made)
    good = made.where("error IS NULL").drop("error")
    store(good, path)
    if seen.get["failed"]:
        raise NotAllEmbedded(f"{seen.get['failed']} records, one of them: {seen.get['error']}")
    return good
