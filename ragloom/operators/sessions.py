"""Chat sessions: recent history, turns, streamed answers, session resolution, chat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T


def recent(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each session that are not system messages, in order (place 1 is the oldest).

    messages has session_id, turn, role, content; a null role is kept.
    """
    rows = messages.where(~F.col("role").eqNullSafe(F.lit("system")))
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    kept = rows.withColumn("_rl_back", F.row_number().over(w)).where(F.col("_rl_back") <= n)
    order = Window.partitionBy("session_id").orderBy("turn")
    return kept.withColumn("place", F.row_number().over(order)).drop("_rl_back")


def answers(deltas: DataFrame) -> DataFrame:
    """(session_id, content): the deltas (session_id, seq, delta) of each answer joined in order, links normalised.

    Null deltas count as empty; a session without deltas has no answer.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d"))))
    return deltas.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["d"]), "").alias("raw")).select("session_id", T.normalise_links(F.col("raw")).alias("content"))


def frames(deltas: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(session_id, place, frame): the event stream of each answer.

    A frame for each non-empty delta, then the normalised answer (if it is not empty) and the end mark;
    a session in errors (session_id, error) gets an error frame instead of the last two. errors lists
    sessions that may have no delta; a session with an empty answer only gets the end mark.
    """
    frame = lambda name, c: F.concat(F.lit("data: "), F.to_json(F.struct(c.alias(name))), F.lit("\n\n"))
    own = deltas.where(F.length("delta") > 0).select("session_id", F.lit(0).alias("stage"), F.col("seq").cast("long").alias("seq"), frame("content", F.col("delta")).alias("frame"))
    sessions = deltas.select("session_id").distinct()
    failed = errors if errors is not None else None
    good = sessions if failed is None else sessions.join(failed.select("session_id"), "session_id", "left_anti")
    whole = answers(deltas).join(good, "session_id", "left_semi").where(F.length("content") > 0)
    final = whole.select("session_id", F.lit(1), F.lit(0).cast("long"), frame("[NORMALIZED_CONTENT]", F.col("content")))
    done = good.select("session_id", F.lit(2), F.lit(0).cast("long"), F.lit("data: [DONE]\n\n"))
    every = own.union(final).union(done)
    if failed is not None:
        every = every.union(failed.select("session_id", F.lit(1), F.lit(0).cast("long"), frame("error", F.col("error"))))
    w = Window.partitionBy("session_id").orderBy("stage", "seq")
    return every.select("session_id", F.row_number().over(w).alias("place"), "frame")


def record_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """messages with a turn (session_id, question, answer) added to each session.

    A last message of the user is replaced by the question, else it is appended; the answer follows.
    """
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_rl_n", F.row_number().over(w)).where("_rl_n = 1").select("session_id", F.col("turn").alias("last_turn"), F.col("role").alias("last_role"))
    placed = turns.join(last, "session_id", "left").withColumn("at", F.when(F.col("last_role") == "user", F.col("last_turn")).otherwise(F.coalesce("last_turn", F.lit(-1)) + 1))
    asked = placed.select("session_id", F.col("at").cast("long").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content"))
    said = placed.select("session_id", (F.col("at") + 1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    kept = messages.join(asked.select("session_id", "turn"), ["session_id", "turn"], "left_anti").select("session_id", F.col("turn").cast("long").alias("turn"), "role", "content")
    return kept.unionByName(asked).unionByName(said)


def resolve(requests: DataFrame) -> DataFrame:
    """requests with resolved, the session each one gets.

    requests has username, seq, asked (a session or null), force_new and fresh (the id of a new session).
    A session that the user was given before is reused, even with force_new; else the user's last
    session, unless force_new; else fresh. Requests of a user are folded in order of seq. A fold over a
    user's requests is a fold over one user's state, not over all of them: states are rows of an array.
    """
    row = F.struct("seq", "asked", "force_new", "fresh")
    users = requests.groupBy("username").agg(F.array_sort(F.collect_list(row)).alias("r"))
    zero = F.expr("named_struct('own', cast(array() AS array<string>), 'last', cast(null AS string), 'out', cast(array() AS array<struct<seq:bigint,resolved:string>>))")

    def step(acc, x):
        owned = F.coalesce(F.array_contains(acc["own"], x["asked"]), F.lit(False))
        got = F.when(owned, x["asked"]).when(acc["last"].isNotNull() & ~F.coalesce(x["force_new"], F.lit(False)), acc["last"]).otherwise(x["fresh"])
        return F.struct(F.array_union(acc["own"], F.array(got)).alias("own"), got.alias("last"), F.concat(acc["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), got.alias("resolved")))).alias("out"))

    done = users.select("username", F.explode(F.aggregate("r", zero, step, lambda acc: acc["out"])).alias("o"))
    return done.select("username", "o.seq", "o.resolved")


def chat_documents(messages: DataFrame) -> DataFrame:
    """(session_id, document): the JSON of each session with more than one message, messages in order."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    plain = F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = messages.groupBy("session_id").agg(F.count("*").alias("n"), plain.alias("messages")).where("n > 1")
    return rows.select("session_id", F.to_json(F.struct("session_id", "messages")).alias("document"))


def save_chats(messages: DataFrame, path: str) -> None:
    """One line of JSON for each session, replacing what was there."""
    chat_documents(messages).select(F.col("document").alias("value")).write.mode("overwrite").text(path)
