import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import ingest, paths, retrieval, sessions
from ragloom.streaming import streams


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid long, id string, score double, col_pos int, rank_in_col int")


@pytest.mark.parametrize(("d", "s"), [(0.0, 1.0), (0.25, 0.75), (1.5, -0.5), (1.999, -0.999), (2.0, 1 / 1.04), (50.0, 0.5), (100.0, 1 / 3), (None, 0.0)])
def test_score(spark, d, s):
    got = spark.createDataFrame([(d,)], "d double").select(retrieval.score_of_distance(F.col("d")).alias("s")).first().s
    assert got == pytest.approx(s)


def test_fusion_keeps_last_score_and_first_place(spark):
    rows = [(1, "x", 0.9, 0, 1), (1, "y", 0.5, 0, 2), (1, "y", 0.7, 1, 1), (1, "z", 0.7, 1, 2)]
    got = retrieval.fuse_by_score(retrieval.positions(hits(spark, rows))).orderBy("fused_pos").collect()
    assert [(r.id, r.score) for r in got] == [("x", 0.9), ("y", 0.7), ("z", 0.7)]


def test_rank_fusion(spark):
    rows = [(1, "a", 9.0, 0, 1), (1, "b", 8.0, 0, 2), (1, "b", 1.0, 1, 1), (1, "b", 1.0, 1, 1)]
    got = retrieval.fuse_by_rank(retrieval.positions(hits(spark, rows))).orderBy("fused_pos").collect()
    assert [r.id for r in got] == ["b", "a"] and got[0].rrf == pytest.approx(1 / 62 + 1 / 61)


def test_diversify(spark):
    S = "qid long, pos int, id string, score double, embedding array<float>"
    rows = [(1, 1, "a", 0.9, [1.0, 0.0]), (1, 2, "b", 0.8, [1.0, 0.0]), (1, 3, "c", 0.5, [0.0, 1.0])]
    pick = lambda rows, k, w: [r.id for r in retrieval.diversify(spark.createDataFrame(rows, S), k, w).orderBy("place").collect()]
    assert pick(rows, 3, 0.5) == ["a", "c", "b"]
    assert pick([(*r[:4], None) for r in rows], 3, 0.5) == ["a", "b", "c"]
    assert pick(rows, 2, 1.0) == ["a", "b"] and pick(rows, 1, 0.5) == ["a"] and pick(rows, 9, 0.5) == ["a", "c", "b"]


@pytest.mark.parametrize(("reply", "want"), [('[{"id":"c","score":3},{"id":"a"}]', "cab"), ("not json", "abc"), ('{"id":"c","score":3}', "abc"), ('[{"id":"c","score":"x"}]', "abc"), ("[]", "abc"), (None, "abc"), ('[{"id":"c","score":1},{"id":"c","score":-1}]', "abc")])
def test_rerank(spark, reply, want):
    fused = spark.createDataFrame([(1, x, 0.5, k) for k, x in enumerate("abc", 1)], "qid long, id string, score double, fused_pos int")
    got = retrieval.rerank(fused, spark.createDataFrame([(1, reply)], "qid long, reply string")).orderBy("rerank_pos").collect()
    assert "".join(r.id for r in got) == want and all(r.score == 0.5 for r in got)


@pytest.mark.parametrize(("tokens", "kept"), [([20000, 1], 1), ([9000, 9000, 1], 1), ([8000, 8000, 1], 2), ([1] * 12, 10)])
def test_pack(spark, tokens, kept):
    rows = [(1, k, "x" * (3 * n - 9 - 3), "", "") for k, n in enumerate(tokens, 1)] if max(tokens) > 10 else [(1, k, "", "", "") for k in range(1, 13)]
    df = spark.createDataFrame(rows, "qid long, fused_pos int, document string, label string, language string")
    assert retrieval.pack(df, headers=False).count() == kept


def test_nearest_against_a_loop(spark):
    rng = random.Random(1)
    vecs = [(k, rng.choice("AB"), [rng.uniform(-1, 1) for _ in range(5)]) for k in range(60)] + [(60, "A", None), (61, "B", [0.0] * 5), (62, None, [1.0] * 5), (63, "A", [1.0])]
    V = spark.createDataFrame(vecs, "vec_id long, collection string, embedding array<double>")
    Q = V.where("vec_id IN (0, 1, 61)").select(F.col("vec_id").alias("qid"), "embedding")
    got = {}
    for r in retrieval.nearest(Q, V, k=3).collect():
        got.setdefault((r.qid, r.collection), []).append((r.rank, r.vec_id))
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q in (0, 1):
        for c in "AB":
            own = [(-round(sum(a * b for a, b in zip(vecs[q][2], v)) / norm(vecs[q][2]) / norm(v), 6), k) for k, col, v in vecs if col == c and k != q and v and len(v) == 5 and norm(v)]
            assert [i for _, i in sorted(got[q, c])] == [k for _, k in sorted(own)[:3]]
    assert retrieval.nearest(Q.limit(0), V).count() == 0


def test_messages_keep_braces(spark):
    q = spark.createDataFrame([(1, "what is {context}?")], "qid long, text string")
    c = spark.createDataFrame([(1, "{query}")], "qid long, context string")
    assert retrieval.messages(q, c).first().messages[1].content == "QUESTION:\nwhat is {context}?\n\nCONTEXT:\n{query}\n"


def test_new_chunks(spark):
    rows = spark.createDataFrame([(1, "A", "t1"), (2, "B", "t1"), (3, "B", "t2"), (4, "C", "t1"), (5, None, "x")], "seq long, id string, text string")
    stored = spark.createDataFrame([("A",), ("A",)], "id string")
    assert sorted((r.id, r.text) for r in ingest.new_chunks(rows, stored).collect()) == [("B", "t1"), ("C", "t1")]


def test_retries():
    calls, slept = [], []

    def flaky(text):
        calls.append(len(text))
        if len(calls) < 3:
            raise ingest.Unavailable
        return [1.0]

    assert ingest.with_retries(flaky, "abc", slept.append) == [1.0] and slept == [0.2, 0.4]

    with pytest.raises(ingest.Unavailable):
        ingest.with_retries(lambda t: (_ for _ in ()).throw(ingest.Unavailable()), "x", slept.append)


def _by_value(f):
    """A maker of f that does not name this module, which workers cannot import."""
    import types

    copy = types.FunctionType(f.__code__, {"ingest": ingest, "__builtins__": __builtins__, "__name__": "__main__"}, f.__name__)
    copy.__module__ = "__main__"
    make = types.FunctionType((lambda: copy).__code__, {"__name__": "__main__"}, "make", None, (types.CellType(copy),))
    make.__module__ = "__main__"
    return make


def _short(text):  # sent to workers by value only, as the tests are no package there
    if len(text) > 4500:
        raise ingest.Unavailable("too long")
    if "poison" in text:
        raise ValueError("no")
    return [float(len(text))]


def test_failures_are_split_into_records(monkeypatch):
    monkeypatch.setattr(ingest, "FIRST_DELAY", 0)
    text = ("x" * 99 + "\n") * 90
    got = ingest.embedded_records(_short, "id", text, sleep=lambda s: None)
    assert "".join(t for _, t, _, _ in got) == text and all(e is None and v == [float(len(t))] for _, t, v, e in got)
    assert [i.split("_")[0] for i, *_ in got] == ["id#split0", "id#split1"] and all(len(t) <= 4500 for _, t, _, _ in got)
    deep = ingest.embedded_records(_short, "id", text + text[:500], sleep=lambda s: None)
    assert "".join(t for _, t, _, _ in deep) == text + text[:500] and deep[0][0].count("#split") == 2 and deep[-1][3] is None
    assert ingest.embedded_records(_short, "id", "a poison", sleep=lambda s: None) == [("id", "a poison", None, "ValueError: no")]
    broken = ingest.embedded_records(lambda t: (_ for _ in ()).throw(ingest.Unavailable("down")), "id", "abc", sleep=lambda s: None)
    assert broken == [("id", "abc", None, "Unavailable: down")]


def test_update_stores_what_it_could_embed(spark, tmp_path):
    path = str(tmp_path / "store")
    S = "seq long, id string, text string, file_path string, collection string"
    chunks = spark.createDataFrame([(1, "a", "good", "/f", "D"), (2, "b", "poison", "/f", "D"), (3, "c", "y" * 4400, "/f", "D")], S)
    with pytest.raises(ingest.NotAllEmbedded):
        ingest.update(chunks, path, make=_by_value(_short))
    assert sorted(r.id for r in ingest.open_store(spark, path).collect()) == ["a", "c"]


def test_nearest_is_the_same_for_any_partitioning(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.uniform(-1, 1) for _ in range(6)]
    vecs = [(k, rng.choice(["A", "B", None]), [x * (1 + 1e-9 * (k % 7)) + 1e-9 * rng.random() for x in base] if k % 3 else [rng.uniform(-1, 1) for _ in range(6)]) for k in range(90)] + [(90, "A", None), (91, "A", [0.0] * 6), (92, "A", [1.0])]
    V = spark.createDataFrame(vecs, "vec_id long, collection string, embedding array<double>")
    Q = V.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    read = lambda n: sorted((r.qid, r.collection or "", r.rank, r.vec_id, r.score) for r in retrieval.nearest(Q, V.repartition(n), k=3).collect())
    want = read(1)
    assert read(4) == want and read(16) == want
    for size in (1, 200):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        assert read(5) == want


def _model(request):
    yield "see [/a/b](x) "
    if "fail" in request:
        raise OSError("gone")
    yield "done"


def test_ask(spark):
    from ragloom.operators import pipeline

    rows = [(f"i{k}", f"pump gear number {k}", f"/d/{k}.md", "AB"[k % 2]) for k in range(30)] + [(None, None, None, "A")]
    store = ingest.embed(spark.createDataFrame(rows, "id string, text string, file_path string, collection string").where("id IS NOT NULL"))
    questions = spark.createDataFrame([(1, "pump gear"), (2, "fail gear"), (3, None)], "qid long, text string")
    scorer = lambda request: '[{"id": "i7", "score": 1}]'
    for mode in ("cap", "rerank", "mmr"):
        got = {r.qid: (r.answer, r.error) for r in pipeline.ask(questions, store, _by_value(_model)(), mode=mode, scorer=scorer).collect()}
        assert got[1] == ("see [/a/b](/a/b) done", None) and got[2] == ("see [/a/b](/a/b) ", "OSError: gone")
    with pytest.raises(ValueError):
        pipeline.choose(questions, store, "best")
    hits = retrieval.fuse_by_score(retrieval.positions(pipeline.retrieve(questions, store)))
    third = hits.where("qid = 1 AND fused_pos = 3").first().id
    first = pipeline.choose(questions, hits, "rerank", scorer=lambda r: '[{"id": "%s", "score": 2}]' % third)
    assert first.where("qid = 1 AND fused_pos = 1").first().id == third


def test_completion_hook_and_events(spark):
    from ragloom.operators import pipeline

    history = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "old?")], "session_id long, turn int, role string, content string")
    turns = spark.createDataFrame([(1, "new?"), (2, "none?")], "session_id long, question string")
    deltas = spark.createDataFrame([(1, 1, "b"), (1, 0, "[/x](y)")], "session_id long, seq int, delta string")
    got = [(r.turn, r.role, r.content) for r in pipeline.finish(history, turns, deltas).orderBy("turn").collect()]
    assert got == [(0, "system", "s"), (1, "user", "new?"), (2, "assistant", "[/x](/x)b")]
    read = [(r.kind, r.value) for r in pipeline.parse_events(sessions.frames(deltas)).orderBy("place").collect()]
    assert read == [("content", "[/x](y)"), ("content", "b"), ("normalised", "[/x](/x)b"), ("done", None)]


def test_all_collections(spark, tmp_path):
    from ragloom.sources import collections

    for name, text in {"d/a.md": "# T\nbody", "d/b.txt": "plain text", "d/c.pdf": "p1|l2", "d/bad.docx": "no zip", "s/f.c": "int f(void)\n{\n    return 1;\n}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    registry = [("Docs", str(tmp_path / "d"), "doc"), ("Api", str(tmp_path / "s"), "SRC"), ("None", str(tmp_path / "d"), "other")]
    reader = lambda content: [p.split("|") for p in content.decode().split("\f")]
    store = str(tmp_path / "store")
    got = collections.update_all(spark, registry, store, reader=reader)
    assert sorted({(r.collection, r.file_path) for r in got.collect()}) == [("API", "/api/f.c"), ("DOCS", "/docs/a.md"), ("DOCS", "/docs/b.txt"), ("DOCS", "/docs/c.pdf")]
    assert collections.update_all(spark, registry, store, reader=reader).count() == 0


def test_clients_tell_errors_apart():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from ragloom.sources import clients

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            status = int(body["input"]) if "input" in body and body["input"].isdigit() else 200
            out = b'data: {"choices": [{"delta": {"content": "a"}}]}\n\ndata: {"choices": [{"delta": {"content": "b"}}]}\n\ndata: [DONE]\n\n' if "messages" in body else json.dumps({"data": [{"embedding": [1.0, 2.0]}]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    call = clients.embedder(url, "m")()
    assert call("x") == [1.0, 2.0]
    for status in ("429", "503"):
        with pytest.raises(ingest.Unavailable):
            call(status)
    with pytest.raises(ValueError):
        call("400")
    assert list(clients.chat(url, "m")("[]")) == ["a", "b"]
    server.shutdown()
    server.server_close()
    with pytest.raises(ingest.Unavailable):
        clients.embedder(url, "m")()("x")


def test_store_and_admin(spark, tmp_path):
    from ragloom.operators import admin

    path = str(tmp_path / "store")
    chunks = spark.createDataFrame([(1, "a", "x" * 30, "/f", "DOCS"), (2, "b", "y", "/f", "SRC"), (3, "b", "z", "/f", "SRC")], "seq long, id string, text string, file_path string, collection string")
    assert ingest.update(chunks, path, limit=20).count() == 4
    assert ingest.update(chunks, path, limit=20).count() == 0
    assert admin.collections(spark, path) == ["DOCS", "SRC"]
    with pytest.raises(KeyError):
        admin.remove(spark, path, "NONE")
    assert not admin.remove(spark, path, "SRC") and admin.remove(spark, path, "SRC", force=True)
    assert admin.collections(spark, path) == ["DOCS"] and admin.store_bytes(spark, path).first().bytes > 0
    assert not admin.clean(spark, path, "delete") and admin.clean(spark, path, "DELETE ALL") and admin.collections(spark, path) == []


def test_paths(spark, monkeypatch):
    roots = spark.createDataFrame([("DOCS", "/r/docs"), ("API", "/r/docs/api/")], "name string, root string")
    cases = {"/r/docs/m.pdf": "/docs/m.pdf", "/r/docs/api/m.pdf": "/api/m.pdf", "/r/docs2/m.pdf": "/r/docs2/m.pdf", "/r/docs": "/docs/.", "/x/../y": "/x/../y", "/r/x/../docs/a": "/docs/a", "/r//docs/b/": "/docs/b"}
    got = {r.path: r.portable for r in paths.encode_paths(spark.createDataFrame([(p,) for p in [*cases, None]], "path string"), roots).collect()}
    assert got == {**cases, None: None}
    monkeypatch.setattr(paths, "ROOTS", 1)
    assert {r.path: r.portable for r in paths.encode_paths(spark.createDataFrame([(p,) for p in [*cases, None]], "path string"), roots).collect()} == got


@pytest.mark.parametrize(("name", "pattern", "yes"), [("test_main.cpp", "test_*.cpp", True), ("Test_main.cpp", "test_*.cpp", False), ("b1.c", "[ab]*.c", True), ("a1.c", "[ab]1.c", False), ("x.c\n", "x.?", False)])
def test_ignore(spark, name, pattern, yes):
    df = spark.createDataFrame([("/w/" + name,)], "p string")
    assert df.select(paths.ignored_file(F.col("p"), [pattern]).alias("r")).first().r is yes
    assert spark.createDataFrame([("/w/xx_old/src/a.c",)], "p string").select(paths.ignored_folder(F.col("p"), ["xx_*"]).alias("r")).first().r


def test_sessions(spark):
    S = "username string, seq long, asked string, force_new boolean, fresh string"
    rows = [("u", 1, None, False, "s1"), ("u", 2, "s1", False, "f2"), ("u", 3, "nope", False, "f3"), ("u", 4, "other", None, "f4"), ("u", 5, None, True, "s5"), ("u", 6, "s1", True, "f6"), ("u", 7, None, False, "f7"), ("v", 1, "s1", False, "v1")]
    want = {("u", 1): "s1", ("u", 2): "s1", ("u", 3): "s1", ("u", 4): "s1", ("u", 5): "s5", ("u", 6): "s1", ("u", 7): "s1", ("v", 1): "v1"}
    df = spark.createDataFrame(rows, S)
    assert {(r.username, r.seq): r.resolved for r in sessions.resolve(df).collect()} == want


def test_streamed_sessions_and_answers(spark, tmp_path):
    S = "username string, seq long, asked string, force_new boolean, fresh string"
    spark.createDataFrame([("u", 1, None, False, "s1"), ("u", 2, "zz", False, "s2"), ("u", 3, None, True, "s3")], S).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.resolve_sessions(spark.readStream.schema(S).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("resolved").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.seq, r.resolved) for r in spark.table("resolved").collect()} == {(1, "s1"), (2, "s1"), (3, "s3")}
    D = "session_id string, seq long, delta string, done boolean"
    spark.createDataFrame([("a", 2, "x ](/f)", True), ("a", 1, "[ ", False), ("b", 1, "open", False)], D).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = []
    q = streams.collect_answers(spark.readStream.schema(D).parquet(str(tmp_path / "d")), lambda df: got.extend(df.collect()), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert [(r.session_id, r.content) for r in got] == [("a", "[x](/f)")]


def test_stream_ingest(spark, tmp_path):
    S = "seq long, id string, text string, file_path string, collection string"
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    add = lambda rows: spark.createDataFrame(rows, S).write.mode("append").parquet(src)
    add([(1, "a", "t", "/f", "D"), (2, "b", "t", "/f", "D")])
    run = lambda: streams.ingest_files(spark, src, S, store, str(tmp_path / "cp"), lambda df: df).awaitTermination(120)
    run()
    add([(3, "b", "t", "/f", "D"), (4, "c", "t", "/f", "D")])
    run()
    assert sorted(r.id for r in ingest.open_store(spark, store).collect()) == ["a", "b", "c"]


def test_frames_turns_and_history(spark):
    d = spark.createDataFrame([("s", 1, "He"), ("s", 2, "llo"), ("t", 1, ""), ("e", 1, "x")], "session_id string, seq long, delta string")
    err = spark.createDataFrame([("e", "boom")], "session_id string, error string")
    got = {}
    for r in sessions.frames(d, err).orderBy("session_id", "place").collect():
        got.setdefault(r.session_id, []).append(r.frame)
    assert len(got["s"]) == 4 and "NORMALIZED" in got["s"][2] and got["s"][3] == "data: [DONE]\n\n"
    assert got["t"] == ["data: [DONE]\n\n"] and len(got["e"]) == 2 and "boom" in got["e"][1]
    M = "session_id string, turn long, role string, content string"
    m = spark.createDataFrame([("s", 0, "user", "old"), ("t", 0, "user", "q"), ("t", 1, "assistant", "a")], M)
    turns = spark.createDataFrame([("s", "new", "A"), ("t", "q2", "B"), ("n", "q3", "C")], "session_id string, question string, answer string")
    out = sorted((r.session_id, r.turn, r.role, r.content) for r in sessions.record_turns(m, turns).collect())
    assert out == [("n", 0, "user", "q3"), ("n", 1, "assistant", "C"), ("s", 0, "user", "new"), ("s", 1, "assistant", "A"), ("t", 0, "user", "q"), ("t", 1, "assistant", "a"), ("t", 2, "user", "q2"), ("t", 3, "assistant", "B")]
    many = spark.createDataFrame([("s", k, None if k == 3 else "system" if k % 5 == 0 else "user", "x") for k in range(20)], M)
    assert [r.turn for r in sessions.recent(many).orderBy("place").collect()] == [8, 9, 11, 12, 13, 14, 16, 17, 18, 19]
