"""Nearest neighbours, score maps, fusion, diversification, re-ranking and context packing.

Ranked lists are tables with explicit positions; nothing depends on row order. Ties are broken by
position and id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T

DEFAULT_K, SNIPPETS, CONTEXT_TOKENS, CANDIDATES = 5, 10, 16000, 30
#: Bytes of the queries a worker compares with a batch of vectors at a time; more are cut into blocks.
QUERY_BYTES = 16 << 20


def score_of_distance(d: Column) -> Column:
    """1 - d below 2, else a slow decay; null is 0. The jump at 2 is part of the definition."""
    return F.coalesce(F.when(d < 2, 1 - d).otherwise(F.greatest(F.lit(0.0), 1 / (1 + d / 50))), F.lit(0.0))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (rows, unit vectors) of a list column; null vectors are left out, no value becomes a Python object."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten(), dtype=np.float64)
    ends = np.cumsum(np.maximum(sizes, 0))
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        out[n] = rows, _unit(values[(ends[rows] - n)[:, None] + np.arange(n)])
    return out


def _best(score: np.ndarray, names: np.ndarray, top: int, per_collection: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) places of the top rounded scores of each query (and collection), ties with the last one included."""
    for name in np.unique(names) if per_collection else [None]:
        own = np.flatnonzero(names == name) if per_collection else np.arange(score.shape[1])
        part = score[:, own]
        edge = np.partition(part, -top, axis=1)[:, -top][:, None] if part.shape[1] > top else -np.inf
        q, c = np.nonzero((part >= edge) & (part > -np.inf))
        yield q, own[c]


_PAIR = "qid long, vec_id long, collection string, score double"


def nearest(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, per_collection: bool = True, exclude_self: bool = True, limits: dict[str, int] | None = None) -> DataFrame:
    """(qid, vec_id, collection, score, rank): exact cosine neighbours of each query, k for each collection.

    queries has qid and embedding, vectors vec_id, embedding and collection. Null vectors, and those of
    another length than a query's, don't meet it; zero vectors have score 0. Scores are rounded to six
    places before they are compared, and ties go to the smallest vec_id, so that no partitioning
    changes the answer. A null collection is a collection of its own.

    The queries are a stated set. If it has at most QUERY_BYTES it is broadcast once and each batch of
    vectors is compared with it; a larger one is cut into blocks by a hash of qid, the vectors are copied to
    each of them, and a block meets its copy batch by batch: no stage collects queries or vectors.
    Every batch keeps its own best of each query and collection (with ties), and only those are
    shuffled. limits gives other k by collection.
    """
    top = max([k, *(limits or {}).values()])
    spark = vectors.sparkSession
    asked = queries.where("qid IS NOT NULL AND embedding IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), "embedding")
    stored = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("collection").cast("string").alias("collection"), "embedding")

    def compare(known: dict[int, tuple[np.ndarray, np.ndarray]], batch: pa.RecordBatch) -> pa.RecordBatch:
        """known: length -> (qids, unit vectors)."""
        vec_ids = batch.column(0).to_numpy(zero_copy_only=False)
        names = np.array([("=" + c) if c is not None else "" for c in batch.column(1).to_pylist()], dtype=str)
        out: list[list] = [[], [], [], []]
        for n, (rows, unit) in _matrix(batch.column(2)).items():
            if n not in known:
                continue
            qids, asked_unit = known[n]
            score = np.nan_to_num(asked_unit @ unit.T, nan=0.0)
            score = np.round(np.where(score > -1, score, 1 / (1 + (1 - score) / 50)), 6) + 0.0
            if exclude_self:
                score[qids[:, None] == vec_ids[rows][None, :]] = -np.inf
            for q, c in _best(score, names[rows], top, per_collection):
                out[0].append(qids[q])
                out[1].append(vec_ids[rows][c])
                out[2].append(names[rows][c])
                out[3].append(score[q, c])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        said = join(out[2], "U1")
        return pa.RecordBatch.from_arrays([pa.array(join(out[0], np.int64)), pa.array(join(out[1], np.int64)), pa.array([x[1:] if x else None for x in said.tolist()], pa.string()), pa.array(join(out[3], float))], names=["qid", "vec_id", "collection", "score"])

    size = asked.agg(F.coalesce(F.sum(8 * F.size("embedding") + 8), F.lit(0))).first()[0]
    if size <= QUERY_BYTES:
        rows = asked.toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast(_known(rows.column(0).combine_chunks(), rows.column(1).combine_chunks()) if len(rows) else {})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield compare(sent.value, batch)

        found = stored.mapInArrow(run, _PAIR)
    else:
        blocks = int(-(-size // QUERY_BYTES))
        width = max(blocks, spark.sparkContext.defaultParallelism)
        share = -(-width // blocks)  # tasks of a block
        place = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
        left = asked.select(place.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(share - 1))).alias("part"), F.lit(0).alias("side"), F.col("qid").alias("id"), F.lit(None).cast("string").alias("collection"), "embedding")
        right = stored.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(share)).cast("int").alias("part"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "collection", "embedding")
        # a partition may hold several (block, part); within each the queries come first
        laid = left.unionByName(right).repartition(blocks * share, "block", "part").sortWithinPartitions("block", "part", "side")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, pending, known = None, [], {}
            for batch in batches:
                key = np.asarray(batch.column(0)).astype(np.int64) * (1 << 31) + np.asarray(batch.column(1))
                side = np.asarray(batch.column(2))
                steps = np.flatnonzero(np.diff(key) | np.diff(side)) + 1
                for a, b in zip([0, *steps.tolist()], [*steps.tolist(), len(key)]):
                    rows = batch.slice(a, b - a)
                    if key[a] != at:
                        at, pending, known = key[a], [], None
                    if side[a] == 0:
                        pending.append(rows)
                        known = None
                        continue
                    if known is None:
                        whole = pa.Table.from_batches(pending).combine_chunks() if pending else None
                        known = _known(whole.column(3).combine_chunks(), whole.column(5).combine_chunks()) if whole else {}
                    yield compare(known, rows.select([3, 4, 5]))

        found = laid.mapInArrow(meet, _PAIR)
    w = Window.partitionBy("qid", *(["collection"] if per_collection else [])).orderBy(F.col("score").desc(), "vec_id")
    limit = F.lit(k)
    for name, n in (limits or {}).items():
        limit = F.when(F.col("collection") == name, F.lit(n)).otherwise(limit)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.where(F.col("rank") <= limit) if limits else ranked


def _known(qids: pa.Array, embeddings: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    ids = qids.to_numpy(zero_copy_only=False)
    return {n: (ids[rows], unit) for n, (rows, unit) in _matrix(embeddings).items()}


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def positions(hits: DataFrame) -> DataFrame:
    """hits with pos, the place in the concatenated lists of a question; null and NaN scores are 0."""
    order = Window.partitionBy("qid").orderBy("col_pos", F.coalesce("rank_in_col", F.lit(2**31 - 1)), "id", F.col("score").desc_nulls_last())
    score = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))
    return hits.where("qid IS NOT NULL AND id IS NOT NULL").withColumn("pos", F.row_number().over(order)).withColumn("score", score)


def fuse_by_score(hits: DataFrame) -> DataFrame:
    """One row for each question and id: the last list's score and payload, the first list's place; best score first.

    This is the pipeline's default fusion. hits has pos (see positions); fused_pos is the order.
    """
    payload = [c for c in hits.columns if c not in ("qid", "id", "pos")]
    one = hits.groupBy("qid", "id").agg(F.max_by(F.struct(*payload), "pos").alias("x"), F.min("pos").alias("first_pos")).select("qid", "id", "first_pos", "x.*")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "first_pos")
    return one.withColumn("fused_pos", F.row_number().over(w))


def fuse_by_rank(hits: DataFrame, b: int = 60) -> DataFrame:
    """Extension: reciprocal rank fusion, the sum of 1 / (b + rank) over the lists that hold an id."""
    best = hits.groupBy("qid", "id", "col_pos").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("qid", "col_pos").orderBy("pos")
    ranked = best.withColumn("r", F.row_number().over(w)).groupBy("qid", "id").agg(F.sum(1 / (F.lit(b) + F.col("r"))).alias("rrf"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), "first_pos")
    return ranked.withColumn("fused_pos", F.row_number().over(order))


def cap(fused: DataFrame, n: int = SNIPPETS) -> DataFrame:
    """The first n of each question. Without embeddings diversification is the same."""
    return fused.where(F.col("fused_pos") <= n)


def diversify(candidates: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Extension: maximal marginal relevance over (qid, id, pos, score, embedding); (qid, id, place).

    The seed is the first candidate; each round takes the largest weight * score - (1 - weight) *
    largest cosine to the taken ones, the first on ties; a null embedding has cosine 0. Candidates of
    a question are a capped list; a fold over its array picks them, without Python.
    """
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    unit = F.when(length > 0, F.transform("embedding", lambda x: x / length))
    lists = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "score", unit.alias("e")))).alias("c"))
    near = "coalesce(round(aggregate(zip_with(x.e, get(c, {i}).e, (p, q) -> p * q), 0D, (s, v) -> s + v), 9), 0D)"
    # the state is the places taken and each candidate's largest cosine to them
    start = f"named_struct('o', array(0), 'm', transform(c, x -> {near.format(i=0)}))"
    rated = f"transform(c, (x, i) -> CASE WHEN array_contains(acc.o, i) THEN NULL ELSE struct(round({weight}D * x.score - {1 - weight}D * get(acc.m, i), 9) AS v, -i AS i) END)"
    best = f"-array_max(filter({rated}, z -> z IS NOT NULL)).i"
    taken = f"transform(array({best}), j -> named_struct('o', concat(acc.o, array(j)), 'm', zip_with(c, acc.m, (x, y) -> greatest(y, {near.format(i='j')}))))[0]"
    order = f"aggregate(sequence(2, greatest(2, {k})), {start}, (acc, n) -> CASE WHEN size(acc.o) >= least({k}, size(c)) THEN acc ELSE {taken} END, acc -> acc.o)"
    return lists.select("qid", "c", F.posexplode(F.expr(order)).alias("place", "i")).select("qid", F.expr("get(c, i).id").alias("id"), (F.col("place") + 1).alias("place"))


#: Characters of a candidate's text that the scorer sees.
SCORED_CHARS = 512 * 4
RERANK = "Rate from 0 to 1 how well each document answers the question. Reply with a JSON list of objects with id and score only."


def scorer_requests(questions: DataFrame, fused: DataFrame, candidates: int = CANDIDATES, chars: int = SCORED_CHARS, instruction: str = RERANK) -> DataFrame:
    """(qid, request): the scorer's messages as JSON, with the first candidates (id and cut text) of each question."""
    first = fused.where(F.col("fused_pos") <= candidates)
    shown = F.struct("fused_pos", "id", F.left(F.coalesce("document", F.lit("")), F.lit(chars)).alias("text"))
    lists = first.groupBy("qid").agg(F.array_sort(F.collect_list(shown)).alias("c"))  # candidates of one question, capped
    documents = F.to_json(F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))))
    said = F.concat(F.lit("QUESTION:\n"), F.coalesce("text", F.lit("")), F.lit("\n\nDOCUMENTS:\n"), documents)
    both = F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), said.alias("content")))
    return lists.join(questions.select("qid", "text"), "qid").select("qid", F.to_json(both).alias("request"))


def replies(requests: DataFrame, scorer: Callable[[str], str]) -> DataFrame:
    """(qid, reply) of a scorer that gets each request's JSON; a call that fails has a null reply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for request in batch.column(1).to_pylist():
                try:
                    out.append(scorer(request))
                except Exception:  # noqa: BLE001 - without a reply the order stays
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["qid", "reply"])

    return requests.select(F.col("qid").cast("long"), "request").mapInArrow(run, "qid long, reply string")


def parse_reply(reply: str | None) -> list[tuple[str, float]] | None:
    """(id, score) of a scorer's reply: a JSON list of objects with an id; None for anything else."""
    try:
        rows = json.loads(reply)
        if not isinstance(rows, list):
            return None
        return [(str(r["id"]), float(r.get("score", 0.0))) for r in rows]
    except (TypeError, ValueError, KeyError, AttributeError):
        return None


def rerank(fused: DataFrame, replies: DataFrame, n: int = SNIPPETS, candidates: int = CANDIDATES) -> DataFrame:
    """The first candidates in the order of a scorer's reply (qid, reply), n of them.

    Ids that the reply leaves out have score 0, the last of repeated ids counts, ties keep their order;
    a reply that does not parse, or that lacks, leaves the order. The hits' own scores stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, i, s = [], [], []
            for qid, reply in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, value in dict(parse_reply(reply) or []).items():
                    q.append(qid)
                    i.append(key)
                    s.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.string()), pa.array(s, pa.float64())], names=["qid", "id", "reply_score"])

    scores = replies.select(F.col("qid").cast("long"), "reply").mapInArrow(run, "qid long, id string, reply_score double")
    first = fused.where(F.col("fused_pos") <= candidates)
    w = Window.partitionBy("qid").orderBy(F.coalesce("reply_score", F.lit(0.0)).desc(), "fused_pos")
    ranked = first.join(scores, ["qid", "id"], "left").withColumn("rerank_pos", F.row_number().over(w))
    return ranked.where(F.col("rerank_pos") <= n).drop("reply_score")


def pack(hits: DataFrame, order: str = "fused_pos", budget: int = CONTEXT_TOKENS, snippets: int = SNIPPETS, headers: bool = True) -> DataFrame:
    """The hits that fit the context, with snippet and running tokens.

    hits has qid, document, label, language and an order. The first always fits; the list ends before
    the first that overflows the budget, and after snippets of them.
    """
    head = F.concat(F.lit("— "), F.col("label"), F.lit("\n")) if headers else F.lit("")
    rows = hits.withColumn("snippet", F.concat(F.lit("```"), F.col("language"), F.lit("\n"), F.coalesce("document", F.lit("")), F.lit("\n```\n"), head))
    w = Window.partitionBy("qid").orderBy(order)
    rows = rows.withColumn("tokens", T.token_estimate(F.col("snippet"))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= snippets)
    rows = rows.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("used") <= budget) | (F.col("place") == 1))


def contexts(packed: DataFrame) -> DataFrame:
    """(qid, context): snippets of each question joined by blank lines."""
    return packed.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "snippet"))), lambda x: x["snippet"]), "\n\n").alias("context"))


SYSTEM = "Answer from the given context only and cite its sources as links."
USER = "QUESTION:\n{query}\n\nCONTEXT:\n{context}\n"


def messages(questions: DataFrame, context: DataFrame, system: str = SYSTEM, user: str = USER) -> DataFrame:
    """(qid, messages): the system and the user message; braces in question and context are text."""
    rows = questions.select("qid", F.col("text").alias("query")).join(context, "qid", "left")
    head, tail = user.split("{query}")[0], user.split("{query}")[1]
    before, after = tail.split("{context}")
    said = F.concat(F.lit(head), F.coalesce("query", F.lit("")), F.lit(before), F.coalesce("context", F.lit("")), F.lit(after))
    both = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), said.alias("content")))
    return rows.select("qid", both.alias("messages"))
