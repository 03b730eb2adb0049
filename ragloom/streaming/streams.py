"""Structured Streaming: incremental ingest, token streams, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.operators import ingest, sessions


def ingest_files(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], trigger_once: bool = True):
    """Chunk the files that newly arrive in a folder and store the chunks that are new; the running query.

    Each micro-batch is split, anti-joined with the store and appended; a batch that is run again after
    a failure adds nothing twice, as its ids are stored.
    """

    def accept(batch: DataFrame, _: int) -> None:
        ingest.update(chunk(batch), store)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(accept)
    return (stream.trigger(availableNow=True) if trigger_once else stream).start()


def collect_answers(deltas: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str):
    """Finished answers of a token stream (session_id, seq, delta, done) to sink; the running query.

    Deltas of a session are kept as state until one is done; the state then goes.
    """
    out = "session_id string, seq long, delta string"

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts = state.get if state.exists else ([], [])
        seqs, texts, done = list(seqs), list(texts), False
        for b in batches:
            seqs += b["seq"].astype("int64").tolist()
            texts += b["delta"].fillna("").tolist()
            done = done or bool(b["done"].fillna(False).any())
        if done:
            state.remove()
            yield pd.DataFrame({"session_id": key[0], "seq": seqs, "delta": texts})
        else:
            state.update((seqs, texts))

    whole = deltas.groupBy("session_id").applyInPandasWithState(keep, out, "seqs array<long>, texts array<string>", "append", GroupStateTimeout.NoTimeout)
    return whole.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: sink(sessions.answers(b))).trigger(availableNow=True).start()


def resolve_sessions(requests: DataFrame) -> DataFrame:
    """The streaming form of sessions.resolve: (username, seq, resolved), with each user's sessions as state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, last = state.get if state.exists else ([], None)
        own = list(own)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            if isinstance(r.asked, str) and r.asked in own:
                last = r.asked
            elif last is None or bool(r.force_new):
                last = r.fresh
            if last not in own:
                own.append(last)
            out.append((key[0], int(r.seq), last))
        state.update((own, last))
        yield pd.DataFrame(out, columns=["username", "seq", "resolved"])

    rows = requests.select("username", "seq", "asked", F.coalesce("force_new", F.lit(False)).alias("force_new"), "fresh")
    return rows.groupBy("username").applyInPandasWithState(fold, "username string, seq long, resolved string", "own array<string>, last string", "append", GroupStateTimeout.NoTimeout)
