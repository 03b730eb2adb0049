"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import admin, chunkers, code_chunks, ingest, paths, pipeline, retrieval, sessions
from ragloom.runtime import table

_WS = "".join(f"chr({ord(c)})||" for c in T.WHITESPACE)[:-2]
_SPLIT = {"pattern": "[" + "".join(f"\\x{{{ord(c):X}}}" for c in T.LINE_ENDS) + "]"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("collection"), "embedding")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


_KNN = """
WITH p AS (
  SELECT q.vec_id AS qid, e.vec_id, e.label::VARCHAR AS collection,
    list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
s AS (SELECT qid, vec_id, collection, round(CASE WHEN d < 2 THEN 1 - d ELSE greatest(0, 1 / (1 + d / 50)) END, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid{by} ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, collection, score, rank::INT AS rank FROM r WHERE rank <= {k}
"""


@_query(_KNN.format(by=", collection", k="5"))
def knn_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(_questions(spark, sf_dir), _vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


@_query(_KNN.format(by="", k="10"))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(_questions(spark, sf_dir), _vectors(spark, sf_dir), k=10, per_collection=False).withColumn("score", F.round("score", 6))


@_query(_KNN.format(by=", collection", k="CASE collection WHEN '1' THEN 8 WHEN '2' THEN 2 ELSE 5 END"))
def retrieve_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collection has its own number of neighbours, 5 by default."""
    return retrieval.nearest(_questions(spark, sf_dir), _vectors(spark, sf_dir), limits={"1": 8, "2": 2}).withColumn("score", F.round("score", 6))


@_query("""SELECT event_id, round(CASE WHEN value IS NULL THEN 0 WHEN value / 100 < 2 THEN 1 - value / 100 ELSE greatest(0, 1 / (1 + value / 100 / 50)) END, 9) AS score FROM events""")
def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(retrieval.score_of_distance(F.col("value") / 100), 9).alias("score"))


# -- fusion and context

_POS = """
WITH h AS (
  SELECT *, coalesce(CASE WHEN isnan(score) THEN 0 ELSE score END, 0) AS s,
    row_number() OVER (PARTITION BY qid ORDER BY col_pos NULLS FIRST, coalesce(rank_in_col, 2147483647), id, score DESC NULLS LAST) AS pos
  FROM hit WHERE qid IS NOT NULL AND id IS NOT NULL),
f AS (
  SELECT qid, id, arg_max(s, pos) AS score, arg_max(lower(collection_name), pos) AS collection, min(pos) AS first_pos FROM h GROUP BY qid, id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_pos) AS fused_pos FROM f)
"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hit").select("qid", "id", F.lower("collection_name").alias("collection"), "score", "col_pos", "rank_in_col")
    return retrieval.fuse_by_score(retrieval.positions(hits).select("qid", "id", "collection", "score", "pos"))


@_query(_POS + "SELECT qid, id, score, collection, fused_pos::INT AS fused_pos FROM o")
def fuse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("qid", "id", "score", "collection", "fused_pos")


@_query(_POS + "SELECT qid, id, score, fused_pos::INT AS fused_pos FROM o WHERE fused_pos <= 10")
def fuse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cap(_fused(spark, sf_dir)).select("qid", "id", "score", "fused_pos")


@_query("""
WITH h AS (
  SELECT qid, id, col_pos, row_number() OVER (PARTITION BY qid ORDER BY col_pos NULLS FIRST, coalesce(rank_in_col, 2147483647), id, score DESC NULLS LAST) AS pos
  FROM hit WHERE qid IS NOT NULL AND id IS NOT NULL),
b AS (SELECT qid, id, col_pos, min(pos) AS pos FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, col_pos ORDER BY pos) AS r FROM b),
s AS (SELECT qid, id, sum(1 / (60 + r)) AS rrf, min(pos) AS first_pos FROM r GROUP BY qid, id)
SELECT qid, id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first_pos)::INT AS fused_pos FROM s
""")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: genuine reciprocal rank fusion."""
    hits = table(spark, sf_dir, "hit").select("qid", "id", "score", "col_pos", "rank_in_col")
    return retrieval.fuse_by_rank(retrieval.positions(hits)).select("qid", "id", F.round("rrf", 9).alias("rrf"), "fused_pos")


@_query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: ten diverse neighbours out of thirty."""
    near = retrieval.nearest(_questions(spark, sf_dir), _vectors(spark, sf_dir), k=30, per_collection=False)
    rows = near.join(_vectors(spark, sf_dir).select("vec_id", "embedding"), "vec_id").select("qid", F.col("vec_id").cast("string").alias("id"), F.col("rank").alias("pos"), "score", "embedding")
    return retrieval.diversify(rows, 10)


@_query(_POS + """, c AS (SELECT * FROM o WHERE fused_pos <= 30),
r AS (SELECT *, CASE WHEN qid % 3 = 0 OR fused_pos % 2 = 1 THEN 0 ELSE fused_pos END AS reply_score FROM c)
SELECT qid, id, score, rerank_pos FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY reply_score DESC, fused_pos)::INT AS rerank_pos FROM r) WHERE rerank_pos <= 10""")
def rerank_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies rate every second candidate; those of each third question do not parse."""
    fused = _fused(spark, sf_dir)
    rated = fused.where("fused_pos <= 30 AND fused_pos % 2 = 0").groupBy("qid").agg(F.to_json(F.collect_list(F.struct("id", F.col("fused_pos").alias("score")))).alias("good"))
    replies = rated.select("qid", F.when(F.col("qid") % 3 == 0, F.concat(F.lit("Sure: "), "good")).otherwise(F.col("good")).alias("reply"))
    return retrieval.rerank(fused, replies).select("qid", "id", "score", "rerank_pos")


_CHUNK = "(SELECT id, arg_min(text, seq) AS text, arg_min(coalesce(file_path, ''), seq) AS file_path, arg_min(coalesce(start_line, 0), seq) AS start_line, arg_min(coalesce(end_line, 0), seq) AS end_line, arg_min(coalesce(node_type, ''), seq) AS node_type FROM code_chunk WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)"
_LABEL = """
CASE WHEN file_path = '' THEN id ELSE file_path END || CASE
  WHEN start_line <> 0 AND end_line <> 0 AND start_line <> end_line THEN ' : ' || start_line || '-' || end_line
  WHEN start_line <> 0 THEN ' : ' || start_line WHEN end_line <> 0 THEN ' : ' || end_line ELSE '' END"""
_FENCE = "CASE WHEN node_type IN ('function', 'leftover_block') THEN CASE WHEN lower(file_path) LIKE '%.c' OR lower(file_path) LIKE '%.h' THEN 'c' ELSE 'cpp' END ELSE 'markdown' END"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "code_chunk").where("id IS NOT NULL AND text IS NOT NULL")
    first = rows.groupBy("id").agg(F.min_by(F.struct("text", F.coalesce("file_path", F.lit("")).alias("file_path"), "start_line", "end_line", "node_type"), "seq").alias("x")).select("id", "x.*")
    label = T.source_label(F.col("file_path"), F.lit(None).cast("string"), F.col("id"), F.lit(0), F.col("start_line"), F.col("end_line"))
    return first.select("id", F.col("text").alias("document"), label.alias("label"), T.fence_language(F.col("node_type"), F.col("file_path")).alias("language"))


_PACKED = _POS + f"""
, l AS (SELECT id, text AS document, {_LABEL} AS label, {_FENCE} AS language FROM {_CHUNK}),
t AS (SELECT o.qid, o.id, o.score, o.fused_pos, '```' || language || chr(10) || document || chr(10) || '```' || chr(10) || '— ' || label || chr(10) AS snippet, label FROM o JOIN l USING (id)),
p AS (SELECT *, length(snippet) // 3 AS tokens, row_number() OVER (PARTITION BY qid ORDER BY fused_pos) AS place FROM t),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY place) AS used FROM p WHERE place <= 10),
k AS (SELECT * FROM u WHERE used <= {{budget}} OR place = 1)
"""


def _packed(spark: SparkSession, sf_dir: str, budget: int = retrieval.CONTEXT_TOKENS) -> DataFrame:
    return retrieval.pack(_fused(spark, sf_dir).select("qid", "id", "score", "fused_pos").join(_labelled(spark, sf_dir), "id"), budget=budget)


@_query(_PACKED.format(budget=900) + "SELECT qid, id, label AS source, score, place::INT AS place, tokens::INT AS tokens, used::BIGINT AS used FROM k")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 900).select("qid", "id", F.col("label").alias("source"), "score", "place", "tokens", "used")


@_query(_PACKED.format(budget=16000) + "SELECT qid, md5(string_agg(snippet, chr(10) || chr(10) ORDER BY place)) AS context_hash FROM k GROUP BY qid")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.contexts(_packed(spark, sf_dir)).select("qid", F.md5(F.col("context").cast("binary")).alias("context_hash"))


@_query(_PACKED.format(budget=16000) + """, c AS (SELECT qid, string_agg(snippet, chr(10) || chr(10) ORDER BY place) AS context FROM k GROUP BY qid)
SELECT q.qid, md5('QUESTION:' || chr(10) || coalesce(q.text, '') || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || coalesce(context, '') || chr(10)) AS user_hash FROM question q LEFT JOIN c USING (qid)""")
def ask_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to prompt, over all stages after the vector search."""
    said = retrieval.messages(table(spark, sf_dir, "question"), retrieval.contexts(_packed(spark, sf_dir)))
    return said.select("qid", F.md5(F.col("messages")[1]["content"].cast("binary")).alias("user_hash"))


@_query(f"SELECT id, {_LABEL} AS label, {_FENCE} AS language FROM {_CHUNK}")
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("id", "label", "language")


# -- chunkers

_DOCS = "(SELECT '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")


@_query(f"""
WITH ws AS (SELECT {_WS} AS ws), d AS (SELECT path, text FROM {_DOCS}, ws WHERE length(trim(text, ws)) > 0),
w AS (SELECT path, s AS start_char, trim(substring(text, s + 1, 2000), ws) AS piece FROM (SELECT path, text, unnest(range(0, length(text), 1800)) AS s FROM d), ws)
SELECT path || ':char' || start_char || '-' || (start_char + length(piece)) || '-' || left(md5(piece), 8) AS id, path AS file_path, start_char::INT AS start_char, (start_char + length(piece))::INT AS end_char
FROM w WHERE length(piece) > 0""")
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunk_windows(_docs(spark, sf_dir)).select("id", "file_path", "start_char", "end_char")


@_query(f"""
WITH ws AS (SELECT {_WS} AS ws), d AS (SELECT path, page_number, trim(array_to_string(list_transform(lines, lambda x: coalesce(x, '')), chr(10)), ws) AS t FROM pdf_page, ws WHERE lines IS NOT NULL),
w AS (SELECT path, page_number, s AS start_char, trim(substring(t, s + 1, 700), ws) AS piece FROM (SELECT path, page_number, t, unnest(range(0, length(t), 600)) AS s FROM d WHERE length(t) > 0), ws)
SELECT path || ':p' || page_number || '-char' || start_char || '-' || (start_char + length(piece)) || '-' || left(md5(piece), 8) AS id, page_number, start_char::INT AS start_char FROM w WHERE length(piece) > 0""")
def chunk_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 700 characters that overlap by 100."""
    return chunkers.chunk_pages(table(spark, sf_dir, "pdf_page"), size=700, overlap=100).select("id", "page_number", "start_char")


_SPLIT_SQL = r"""
WITH RECURSIVE d AS (SELECT {key} AS k, text FROM {table} WHERE text IS NOT NULL AND length(text) > {size}),
s AS (
  SELECT k, text, 0 AS pos, 0 AS n, '' AS piece FROM d
  UNION ALL
  SELECT k, text, pos + length(p), n + 1, p FROM (
    SELECT k, text, pos, n, CASE WHEN length(text) - pos <= {size} THEN substring(text, pos + 1) ELSE
      substring(text, pos + 1, CASE WHEN length(regexp_extract(substring(text, pos + 1, {size}), '(?s)^(.*\n)', 1)) - 1 > {size} // 2
        THEN length(regexp_extract(substring(text, pos + 1, {size}), '(?s)^(.*\n)', 1)) ELSE {size} END) END AS p
    FROM s WHERE pos < length(text)))
"""


@_query(_SPLIT_SQL.format(key="doc_id", table="documents", size=1000) + "SELECT k AS doc_id, (n - 1)::INT AS piece, md5(piece) AS piece_hash FROM s WHERE n > 0 UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 1000")
def split_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.posexplode(chunkers.split_at_newlines(F.col("text"), 1000)).alias("piece", "t")).select("doc_id", "piece", F.md5(F.col("t").cast("binary")).alias("piece_hash"))


_BLOCKS = f"""(WITH b AS (
  SELECT path, unnest(string_split(regexp_replace(text, '(?m)^#', chr(1) || '#', 'g'), chr(1))) AS raw, unnest(range(len(string_split(regexp_replace(text, '(?m)^#', chr(1) || '#', 'g'), chr(1))))) AS block_index FROM {_DOCS} WHERE text IS NOT NULL)
  SELECT path, block_index, trim(raw, {_WS}) AS text FROM b)"""


@_query(_SPLIT_SQL.format(key="{'path': path, 'block': block_index}", table=_BLOCKS, size=2000) + f"""
SELECT k.path AS file_path, k.block::INT AS block_index, (n - 1)::INT AS piece_index, md5(piece) AS piece_hash FROM s WHERE n > 0
UNION ALL SELECT path, block_index::INT, 0, md5(text) FROM {_BLOCKS} WHERE length(text) BETWEEN 1 AND 2000""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all heading blocks; blocks above 2000 characters are split at newlines."""
    return chunkers.chunk_headings(_docs(spark, sf_dir)).select("file_path", "block_index", "piece_index", F.md5(F.col("text").cast("binary")).alias("piece_hash"))


@_query(_SPLIT_SQL.format(key="seq", table="doc_chunk", size=2000) + """, x AS (SELECT k, n - 1 AS piece, piece AS t FROM s WHERE n > 0)
SELECT d.seq, CASE WHEN length(d.text) > 4000 THEN d.id || '#split' || x.piece || '_' || left(md5(x.t), 8) ELSE d.id END AS id, length(d.text) > 4000 AS was_split, CASE WHEN length(d.text) > 4000 THEN x.piece ELSE 0 END::INT AS piece
FROM doc_chunk d LEFT JOIN x ON d.seq = x.k AND length(d.text) > 4000 WHERE d.text IS NOT NULL""")
def split_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.split_oversize(table(spark, sf_dir, "doc_chunk").select("seq", "id", "text"), 4000).select("seq", "id", "was_split", "piece")


@_query("""SELECT file_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '^' || chr(10) || '{2,}', chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10) || '+$', '')) AS text_hash FROM code_file WHERE text IS NOT NULL""")
def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_file").where("text IS NOT NULL").select("file_id", F.md5(chunkers.collapse_blank_lines(F.col("text")).cast("binary")).alias("text_hash"))


@_query()
def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax-aware chunks and leftovers of all files."""
    files = table(spark, sf_dir, "code_file").groupBy("file_path").agg(F.min_by("text", "file_id").alias("text"))
    return code_chunks.chunk_code(files)


# -- filters and scalars

_IGNORED = ["*_generated.h", "moc_*", "*.pb.cc", "[ab]1.c"]


@_query("""SELECT file_id FROM code_file WHERE file_path IS NOT NULL
  AND NOT (regexp_extract(file_path, '([^/]*)$', 1) GLOB '*_generated.h' OR regexp_extract(file_path, '([^/]*)$', 1) GLOB 'moc_*' OR regexp_extract(file_path, '([^/]*)$', 1) GLOB '*.pb.cc' OR regexp_extract(file_path, '([^/]*)$', 1) = '[ab]1.c')
  AND len(list_filter(string_split(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/'), lambda p: p GLOB 'vendor*' OR p = 'gen')) = 0
  AND lower(regexp_extract(file_path, '[^/.][^/]*([.][^./]*)$', 1)) IN ('.c', '.cc', '.cpp', '.cxx', '.h', '.hpp', '.hh', '.hxx')""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.wanted(table(spark, sf_dir, "code_file"), "file_path", paths.CODE_EXTENSIONS, _IGNORED, ["vendor*", "gen"]).select("file_id")


_WORDS_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.LICENSE_WORDS) + "]"


@_query(f"""SELECT file_id, len(list_filter({_WORDS_SQL}, lambda w: contains(lower(text), w)))::INT AS hits,
  len(list_filter({_WORDS_SQL}, lambda w: contains(lower(text), w))) >= 2 OR regexp_matches(lower(text), 'copyright\\s*(\\(c\\)|©)?\\s*\\d{{4}}') AS license FROM code_file WHERE text IS NOT NULL""")
def license_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_file").where("text IS NOT NULL").select("file_id", T.license_hits(F.col("text")).alias("hits"), T.is_license(F.col("text")).alias("license"))


@_query(f"""WITH ws AS (SELECT {_WS} AS ws), l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line FROM code_file WHERE text IS NOT NULL)
SELECT file_id, count(*)::BIGINT AS separators FROM l, ws WHERE regexp_matches(trim(line, ws), '^//\\s*[-=*#~_]{{3,}}$') GROUP BY file_id""")
def separator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "code_file").where("text IS NOT NULL").select("file_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.is_separator(F.col("line"))).groupBy("file_id").agg(F.count("*").alias("separators"))


_LINE_SQL = f"string_split_regex(text, '\\r\\n|{_SPLIT['pattern']}')"


@_query(f"""WITH ws AS (SELECT {_WS} AS ws)
SELECT doc_id, md5(trim(text, ws)) AS stripped, (len({_LINE_SQL}) - CASE WHEN list_last({_LINE_SQL}) = '' THEN 1 ELSE 0 END)::INT AS lines, left(md5(text), 8) AS short_hash, (length(text) // 3)::INT AS tokens, regexp_replace(coalesce(title, ''), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS safe
FROM documents, ws WHERE text IS NOT NULL""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", F.md5(T.strip(t).cast("binary")).alias("stripped"), F.size(T.split_lines(t)).alias("lines"), T.short_hash(t).alias("short_hash"), T.token_estimate(t).alias("tokens"),
        T.safe_name(F.coalesce("title", F.lit(""))).alias("safe"),
    )


_LINKED = "'[' || coalesce(title, '') || ' ](' || coalesce(url, 'u') || ') [/repo/' || doc_id || '](x) [ ](/a/b) [ same](same) [kept](/src/' || doc_id || '.c) [] () ' || text"
_LINK = r"'\[([^\]]+)\]\(([^)]+)\)'"


@_query(f"""WITH ws AS (SELECT {_WS} AS ws), d AS (SELECT doc_id, {_LINKED} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, ws, string_split_regex(t, {_LINK}) AS b, regexp_extract_all(t, {_LINK}) AS f, list_transform(regexp_extract_all(t, {_LINK}, 1), lambda x: trim(x, ws)) AS s, regexp_extract_all(t, {_LINK}, 2) AS u FROM d, ws)
SELECT doc_id, len(f) AS links, md5(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(
  CASE WHEN s[i] = trim(u[i], ws) THEN f[i] WHEN starts_with(u[i], '/') THEN '[' || CASE WHEN s[i] = '' THEN u[i] ELSE s[i] END || '](' || u[i] || ')' WHEN starts_with(s[i], '/') THEN '[' || s[i] || '](' || s[i] || ')' ELSE f[i] END, '')), '')) AS said FROM p""")
def link_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts, with links of each kind before them, as few have any."""
    linked = F.expr(_LINKED)
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", linked.alias("t"))
    return rows.select("doc_id", F.size(F.regexp_extract_all("t", F.lit(_LINK[1:-1]), F.lit(0))).cast("long").alias("links"), F.md5(T.normalise_links(F.col("t")).cast("binary")).alias("said"))


@_query("""WITH r AS (SELECT lower(name) AS name, root FROM registry),
f AS (SELECT file_id, '~/corpora/sources' || file_path AS path FROM code_file WHERE file_path IS NOT NULL)
SELECT file_id, coalesce(max(CASE WHEN path = root THEN '/' || name || '/.' ELSE '/' || name || '/' || substring(path, length(root) + 2) END), any_value(path)) AS portable
FROM f LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY file_id""")
def path_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "code_file").where("file_path IS NOT NULL").select("file_id", F.concat(F.lit("~/corpora/sources"), "file_path").alias("path"))
    return paths.encode_paths(files, table(spark, sf_dir, "registry")).select("file_id", "portable")


@_query("""SELECT c.seq, coalesce(r.rag_type, 'UNKNOWN') AS collection_type FROM code_chunk c LEFT JOIN registry r ON upper(trim(c.collection, ' ')) = upper(trim(r.name, ' '))""")
def collection_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.collection_types(table(spark, sf_dir, "code_chunk"), table(spark, sf_dir, "registry")).select("seq", "collection_type")


# -- storing


@_query("SELECT seq, id FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM code_chunk WHERE id IS NOT NULL) WHERE rn = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_chunks(table(spark, sf_dir, "code_chunk").select("seq", "id"), None).select("seq", "id")


@_query("""SELECT seq, id FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM chunk_batch WHERE batch_no > 0 AND id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM chunk_batch o WHERE o.batch_no = 0 AND o.id = chunk_batch.id)) WHERE rn = 1""")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks of the later batches; those of the first are stored."""
    rows = table(spark, sf_dir, "chunk_batch").select("seq", "id", "batch_no")
    return ingest.new_chunks(rows.where("batch_no > 0"), rows.where("batch_no = 0")).select("seq", "id")


@_query()
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline embedding of the stored documents' items."""
    return ingest.embed(table(spark, sf_dir, "doc_chunk").select("seq", "text")).select("seq", F.round("norm", 6).alias("norm"), F.size("embedding").alias("dims"))


# -- catalogue

_COUNTS = "SELECT coalesce(r.c, g.c) AS collection, coalesce(n, 0) AS chunks FROM (SELECT DISTINCT upper(trim(name, ' ')) AS c FROM registry) r FULL JOIN (SELECT upper(trim(collection, ' ')) AS c, count(*) AS n FROM code_chunk GROUP BY 1) g ON r.c = g.c"


@_query(_COUNTS)
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.counts(table(spark, sf_dir, "code_chunk"), table(spark, sf_dir, "registry"))


@_query("""WITH g AS (SELECT upper(trim(collection, ' ')) AS c, count(*) AS n, sum(strlen(coalesce(text, ''))) AS b FROM doc_chunk GROUP BY 1),
t AS (SELECT c AS collection, coalesce(r.rag_type, 'UNKNOWN') AS collection_type, n AS chunks, b AS bytes FROM g LEFT JOIN registry r ON upper(r.name) = c UNION ALL SELECT 'TOTAL', 'ALL', sum(n), sum(b) FROM g)
SELECT collection, collection_type, chunks::BIGINT AS chunks, bytes::BIGINT AS bytes, CASE WHEN bytes <= 0 THEN '' WHEN bytes < 1024 THEN bytes || ' bytes' WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024) WHEN bytes < 1073741824 THEN printf('%.2f MB', bytes / 1048576) ELSE printf('%.2f GB', bytes / 1073741824) END AS size FROM t""")
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.info(table(spark, sf_dir, "doc_chunk"), table(spark, sf_dir, "registry"))


@_query("""WITH f AS (SELECT DISTINCT file_path, regexp_extract(file_path, '^(.*)/[^/]*/[^/]*$', 1) AS folder, lower(regexp_extract(file_path, '([.][^./]*)$', 1)) IN ('.c', '.cc', '.cpp', '.cxx') AS wanted FROM code_file WHERE file_path IS NOT NULL),
n AS (SELECT file_path, count(*) AS n FROM code_chunk WHERE file_path IS NOT NULL GROUP BY 1),
d AS (SELECT folder, count(*) FILTER (wanted) AS files, count(*) FILTER (NOT wanted) AS skipped, sum(CASE WHEN wanted THEN coalesce(n, 0) ELSE 0 END) AS chunks FROM f LEFT JOIN n USING (file_path) GROUP BY folder)
SELECT count(*) AS folders, sum(files)::BIGINT AS files, sum(skipped)::BIGINT AS skipped, sum(chunks)::BIGINT AS chunks, max(files) AS most_files, (SELECT folder FROM d ORDER BY files DESC, folder LIMIT 1) AS largest_folder FROM d""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the implementation files; folders without the file's own numbered one."""
    parent = F.regexp_replace("file_path", "/[^/]*/([^/]*)$", "/$1")
    files = table(spark, sf_dir, "code_file").where("file_path IS NOT NULL")
    flat = files.select(F.col("file_path").alias("full"), parent.alias("file_path"), F.lower(F.regexp_extract("file_path", r"(\.[^./]*)$", 1)).isin(".c", ".cc", ".cpp", ".cxx").alias("wanted"))
    unique = F.concat("file_path", F.lit("#"), F.xxhash64("full"))
    chunks = table(spark, sf_dir, "code_chunk").where("file_path IS NOT NULL").select(F.col("file_path").alias("full"), parent.alias("file_path"))
    return admin.ingest_summary(flat.select(unique.alias("file_path"), "wanted"), chunks.select(unique.alias("file_path")))


# -- sessions: events as messages, a user's events as a session

_MESSAGES = "(SELECT user_id AS session_id, event_id AS turn, CASE event_type WHEN 'view' THEN 'system' WHEN 'click' THEN 'user' ELSE 'assistant' END AS role, props AS content FROM events WHERE user_id IS NOT NULL)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type") == "view", "system").when(F.col("event_type") == "click", "user").otherwise("assistant")
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), role.alias("role"), F.col("props").alias("content"))


@_query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM {_MESSAGES} WHERE role <> 'system')
SELECT session_id, turn, role, row_number() OVER (PARTITION BY session_id ORDER BY turn)::INT AS place FROM r WHERE back <= 10""")
def history_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent(_messages(spark, sf_dir)).select("session_id", "turn", "role", "place")


@_query(f"SELECT session_id, md5(string_agg(coalesce(content, ''), '' ORDER BY turn)) AS content_hash FROM {_MESSAGES} GROUP BY session_id")
def stream_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas of each answer joined in order."""
    deltas = _messages(spark, sf_dir).select("session_id", F.col("turn").alias("seq"), F.col("content").alias("delta"))
    return sessions.answers(deltas).select("session_id", F.md5(F.col("content").cast("binary")).alias("content_hash"))


@_query(f"SELECT session_id, count(*) AS n, md5(string_agg(coalesce(role, '') || ':' || coalesce(content, ''), chr(10) ORDER BY turn)) AS said FROM {_MESSAGES} GROUP BY session_id HAVING count(*) > 1")
def chat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and content of the messages in each session's JSON document."""
    docs = sessions.chat_documents(_messages(spark, sf_dir))
    parsed = F.from_json("document", "session_id bigint, messages array<struct<role:string,content:string>>")
    said = F.array_join(F.transform(parsed["messages"], lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
    return docs.select("session_id", F.size(parsed["messages"]).cast("long").alias("n"), F.md5(said.cast("binary")).alias("said"))


@_query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type = 'purchase' AS forced, row_number() OVER w AS n, CASE WHEN event_id % 3 = 0 THEN 's' || (event_id - event_id % 7) WHEN event_id % 3 = 1 THEN 's' || lag(event_id, 2) OVER w END AS asked
  FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, event_id, n, 's' || event_id AS resolved, ['s' || event_id] AS own FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, r, list_append(own, r) FROM (
    SELECT e.user_id, e.event_id, e.n, s.own, CASE WHEN coalesce(list_contains(s.own, e.asked), false) THEN e.asked WHEN forced THEN 's' || e.event_id ELSE s.resolved END AS r FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id::VARCHAR AS username, event_id AS seq, resolved FROM s""")
def session_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases force a new session; some requests name an earlier one, or one that the user never had."""
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    before = F.lag("event_id", 2).over(Window.partitionBy("user_id").orderBy("event_id"))
    asked = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), F.col("event_id") - F.col("event_id") % 7)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("s"), before))
    requests = rows.select(F.col("user_id").cast("string").alias("username"), F.col("event_id").alias("seq"), asked.alias("asked"), (F.col("event_type") == "purchase").alias("force_new"), F.concat(F.lit("s"), "event_id").alias("fresh"))
    return sessions.resolve(requests)


def ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question asked end to end over the embedded items of doc_chunk, of a model that names its prompt's hash."""
    items = table(spark, sf_dir, "doc_chunk").where("id IS NOT NULL AND text IS NOT NULL").withColumn("collection", F.upper(F.trim("collection")))
    store = ingest.embed(paths.keep_first(items, "id", "seq").select("id", "text", "file_path", "collection"))

    def model(request: str):
        yield "The prompt is "
        yield hashlib.md5(request.encode("utf-8", "surrogatepass")).hexdigest()

    def scorer(request: str) -> str:
        shown = json.loads(json.loads(request)[1]["content"].split("DOCUMENTS:\n", 1)[1])
        return json.dumps([{"id": d["id"], "score": len(d["text"])} for d in shown])

    return pipeline.ask(table(spark, sf_dir, "question").select("qid", "text"), store, model, mode="rerank", scorer=scorer).select("qid", "answer", "error")


QUERIES["ask_answers"] = ask_answers


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to context rows: neighbours of each collection, fusion, cap, labels, packing."""
    near = retrieval.nearest(_questions(spark, sf_dir), _vectors(spark, sf_dir))
    hits = near.select("qid", F.col("vec_id").cast("string").alias("id"), "collection", "score", F.col("collection").cast("int").alias("col_pos"), F.col("rank").alias("rank_in_col"))
    fused = retrieval.cap(retrieval.fuse_by_score(retrieval.positions(hits).select("qid", "id", "collection", "score", "pos")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), "source")
    none = F.lit(None).cast("string")
    rows = fused.join(docs, "id").withColumn("label", T.source_label(none, F.col("source"), F.col("id"), F.lit(0), F.lit(0), F.lit(0))).withColumn("language", T.fence_language(none, none))
    return retrieval.pack(rows).select("qid", "id", F.col("label").alias("source"), "collection", F.round("score", 6).alias("score"), "place", "tokens")


QUERIES["flagship"] = flagship
