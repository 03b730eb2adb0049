import random

import pytest

from ragloom.llm import documented, leakage, provenance, scans, spam, syntax, tokenize

LONG = "word " * 60000


def test_tokens_equal_the_plain_encoder(spark):
    enc = tokenize.FragmentEncoder(tokenize.vocabulary_path())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "'s", "'", "!", "é", " ", "　", "日本", "1", "😀", "́", "'re", "_", "<|endoftext|>", "Z", "''", "the ", ".\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", LONG]
    ids, at = enc([t.encode() for t in texts])
    assert all(ids[at[k] : at[k + 1]].tolist() == enc.plain.encode_ordinary(t) for k, t in enumerate(texts))


def test_tokens_defined_cases(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, "", 0), (3, None, 0), (None, "a b", 0), (1, "a b", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or -1, r.ids) for r in tokenize.encode(df).collect())
    same = [i for k, i in got if k == 1]
    assert len(got) == 5 and same[0] == same[1] == got[0][1] and [i for k, i in got if k in (2, 3)] == [[], []]
    assert tokenize.encode(df.limit(0)).collect() == []


ITEMS = [
    (1, "Give a short answer. On bench Lumenor a rigid crane with 58 links tilts once 70 bodies touch the hinge, and log 2 shows 3 frozen warnings."),
    (2, "Too short to leak."),
    (3, None),
    (4, "Team Quadrane blames a missing limit of 41 metres on the sled near Lumenor. Team Velmar blames a missing limit of 7 metres on the crane near Quadrane. The crane near Velmar is 5 metres high."),
]


def leak(spark, docs):
    D = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, h long, slots string")
    I = spark.createDataFrame([(*i, 7) for i in ITEMS + ITEMS[:1]], "item_id long, text string, h long")  # noqa: E741
    return {(r.item_id, r.doc_id): r.kind for r in leakage.leaks(D, I).collect()}


def test_leaks(spark):
    body = ITEMS[0][1]
    words = body.split()
    docs = [
        (1, "Intro. " + body.upper().replace(" ", "\n", 5) + " End."),
        (2, " ".join(words[4:16])),
        (3, " ".join(words[4:15])),
        (4, body.replace("58", "99").replace("70", "12").replace("Lumenor", "Velmar")),
        (5, None),
        (6, ""),
        (None, body),
        (1, "again " + body),
        (7, LONG + body),
        (8, body.replace("crane", "boat").replace("touch", "x").replace("shows", "y")),
    ]
    assert leak(spark, docs) == {(1, 1): "exact", (1, 2): "exact", (1, 4): "reparameterised", (1, 7): "exact"}
    assert leak(spark, []) == {}


def test_leaks_without_the_broadcast(spark, monkeypatch):
    docs = [(1, ITEMS[0][1]), (2, "nothing at all " * 9)]
    want = leak(spark, docs)
    monkeypatch.setattr(leakage, "BROADCAST_ITEMS", -1)
    assert leak(spark, docs) == want
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", -1)
    assert leak(spark, docs) == want == {(1, 1): "exact"}


def prose(rng):
    return " ".join(f"The {rng.choice('pump gear wheel'.split())} is checked by the {rng.choice('crew shop team'.split())} when it {rng.choice('stops runs turns'.split())} for {rng.randrange(99)} hours." for _ in range(8))


def junk(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice("cheap buy online gear best price gear sale".split()) for _ in range(80))
    if kind == 1:
        return "\n".join(f"https://host{rng.randrange(9)}.example/{rng.randrange(999)}" for _ in range(20))
    return " ".join(f"#tag{rng.choice('abcdefgh')}{rng.randrange(30)}" for _ in range(60))


def test_spam_held_out(spark):
    rng = random.Random(3)
    rows = [(k, junk(rng) if k % 4 == 0 else prose(rng), f"https://h{k % 5}.example/x", 1.0) for k in range(600)]
    rows += [(1000, None, "u", 0.0), (1001, "", None, 0.0), (1002, " \n", None, 0.0), (None, junk(rng), None, 0.0), (0, rows[0][1], "https://h0.example/", 0.0), (1003, LONG, None, 0.0)]
    got = {r.doc_id: r.spam for r in spam.rate(spark.createDataFrame(rows, "doc_id long, text string, url string, p double")).collect()}
    assert None not in got and not got[1001] and not got[1002]
    wrong = [k for k in range(600) if got[k] != (k % 4 == 0)]
    assert len(wrong) <= 3
    entries = "Glossary\n\n" + "\n".join(f"term {k}: The part is moved by the crew when it is old." for k in range(12))
    assert spam.weak_label(__import__("numpy").array([spam.features(entries)]))[0] == 0


def test_spam_without_labels(spark):
    df = spark.createDataFrame([(1, "one two", None)], "doc_id long, text string, url string")
    assert [r.spam for r in spam.rate(df).collect()] == [False]
    assert spam.rate(df.limit(0)).collect() == []


VALID = [
    ("c", "int f(const struct S* p, int n) { for (int i = 0; i < n; ++i) { p->x ^= (i << 3); } return n ? 1 : 2; }"),
    ("c", "#ifdef X\nint f(int a, int b) {\n#else\nint f(int a) {\n#endif\nreturn a;\n}\n"),
    ("c", "enum E { A, B = 2, };\nstatic const float t[2] = { 1.0f, -2e3 };\nstruct { int a; } x;\n"),
    ("c", "#define M(x) do { \\\n f(x); \\\n} while (0)\nvoid g(void) { M(1); switch (a) { case 1: b(); break; default: ; } }"),
    ("c", "#if 0\n)))\n#endif\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nint x;\n#ifdef __cplusplus\n}\n#endif\n"),
    ("cpp", "template <typename T, int K> T f(T* p) { const auto g = [&](int i) { return i * 2; }; if (auto it = m.find(1); it != m.end()) { return it->second; } return p->a; }"),
    ("cpp", "class A final : public B { public: explicit A(int n) : a_(n) {} virtual int f() const = 0; ~A(); private: int a_; };"),
    ("cpp", "const char* r = R\"(} \" {)\"; constexpr int n = 1'000'119; std::vector<std::map<int, float>> v(n, 1.0f);"),
    ("cpp", "namespace a::b { using T = int; int A::f(T&& x) noexcept { for (const auto& [k, v] : m) { x += v; } throw E(\"x\"); } }"),
    ("cpp", ""),
    ("cpp", "/* only */ // comments"),
    ("c", "int f() { " + "{ " * 210 + "} " * 210 + "return 0; }"),
    ("c", "int f() { return " + "(" * 2500 + "1" + ")" * 2500 + "; }"),
    ("c", "int f(int a) { " + "if (a) { a = 1; } else " * 2500 + "{ a = 2; } return a; }"),
    ("cpp", "template <class T> concept C = requires(T a, T b) { { a + b } noexcept -> std::same_as<T>; typename T::x; a.f(); requires sizeof(T) > 4; } && D<T>;"),
    ("cpp", "template <class T> requires C<T> && (sizeof(T) > 1) T f(T a) requires D<T> { return a; }"),
    ("cpp", "template <class... T> auto sum(T... a) { return (a + ...) + (... * a); }"),
]
BROKEN = [
    ("c", "int f() { return 1;"),
    ("c", "int f() { return 1 + ; }"),
    ("c", "int f( { }"),
    ("c", "int a int b;"),
    ("c", "void N::f() {}"),
    ("c", "int x = (1;"),
    ("c", "char* s = \"open;\n"),
    ("c", "/* open"),
    ("c", "#if A\nint x;\n"),
    ("c", "#endif\n"),
    ("c", "int f() {\n<<<<<<< HEAD\n a();\n=======\n b();\n>>>>>>> x\n}\n"),
    ("cpp", "class A { int f() { return 1; }"),
    ("cpp", "import os\ndef f(x):\n  return x\n"),
    ("cpp", "}"),
    ("cpp", "template <class T> concept C = )) ;"),
    ("cpp", "template <class T> requires void f(T a) { }"),
]


@pytest.mark.parametrize(("language", "text"), VALID)
def test_valid(language, text):
    assert syntax.check(text, language) == []


@pytest.mark.parametrize(("language", "text"), BROKEN)
def test_broken(language, text):
    assert syntax.check(text, language)


def test_recovery_finds_all_errors():
    text = "int a = ;\nint ok;\nint b = );\nint f() {\n  x y z;\n  return 0;\n}\nint c = ;\n"
    assert [line for line, _ in syntax.check(text, "c")] == [1, 3, 5, 8]


def test_all_errors_are_kept(spark):
    df = spark.createDataFrame([("/a.c", "r", "c", "int a = ;\n" * 50)], "file_path string, repo string, language string, text string")
    row = syntax.verdicts(df).first()
    assert row.n_errors == len(row.errors) == 50 and [e.line for e in row.errors] == list(range(1, 51))


def test_verdicts_and_rates(spark):
    S = "file_path string, repo string, language string, text string, n_errors int"
    rows = [("/a.c", "r", "c", "int x;", 5), ("/a.c", "r", "c", "int x;", 5), ("/b.cc", None, None, "int", 5), ("/c.h", "r", "cpp", None, 5), (None, "r", "c", "x", 5), ("/d.c", "r", None, "class A {};", 5), ("/e.c", "r", "C ", LONG, 5)]
    v = syntax.verdicts(spark.createDataFrame(rows, S))
    assert {r.file_path for r in v.where("n_errors > 0").collect()} == {"/b.cc", "/d.c", "/e.c"}
    got = {(r.repo, r.language): (r.files, r.invalid) for r in syntax.rates(v).collect()}
    assert got == {("r", "c"): (3, 2), (None, "cpp"): (1, 1)}
    assert syntax.rates(syntax.verdicts(spark.createDataFrame([], S))).collect() == []


def test_heads():
    kinds = lambda s: tuple(map(__import__("ragloom.functions.clex", fromlist=["x"]).CLASSES["cpp"].__getitem__, s.split()))
    assert documented.head_name(kinds("static int f ( int a )")) == 3
    assert documented.head_name(kinds("template < typename T > A < T > :: B g ( T x ) const")) > 0
    assert documented.head_name(kinds("A :: A ( int n ) : a_ ( n ) , b_ { }".replace("{ }", "( 2 )"))) == 3
    assert documented.head_name(kinds("int x = f ( 1 )")) < 0 and documented.head_name(kinds("if ( x )")) < 0


DOC = "Moves every part of the pool once."
CASES = [
    (f"// {DOC}\nint f() {{ }}", True),
    (f"// {DOC}\n\nint f() {{ }}", False),
    (f"/** {DOC} */\ntemplate <typename T>\n#pragma x\n// -----\nint f() {{ }}", True),
    ("/// @brief\nint f() { }", False),
    (f"/// @brief {DOC}\nint f() {{ }}", True),
    ("// f\nint f() { }", False),
    ("// TODO: move every part of the pool\nint f() { }", False),
    ("// if (a > b) move_every_part(of, the, pool);\nint f() { }", False),
    ("// ---- Moves every part of the pool ----\nint f() { }", False),
    ("// NOLINTNEXTLINE move every part of this\nint f() { }", False),
    (f"/*\n * {DOC}\n *\n * @param p x\n */\nint f() {{ }}", True),
    (f"// {DOC}\nint g();\nint f() {{ }}", False),
]


@pytest.mark.parametrize(("text", "yes"), CASES)
def test_comments(text, yes):
    ((name, item, _, _),) = documented.functions(text)
    assert name == "f"
    assert (documented.described(documented.above(text[:item].split("\n")[:-1])) is not None) is yes


def test_pairs(spark):
    S = "file_path string, node_type string, start_line int, end_line int, text string, line int, code string"
    tail = "\n".join(["int x;\n", "\n", "/*\n", f" * {DOC}\n", " */\n"])
    rows = [
        ("/a.cc", "leftover_block", 1, 5, tail, 1, "c"),
        ("/a.cc", "function", 6, 8, "int A::f(int n) {\n return n;\n}", 1, "c"),
        ("/a.cc", "function", 6, 8, "int A::f(int n) {\n return n;\n}", 1, "c"),
        ("/a.cc", "function", 6, 8, "\nint spaced(int n) {\n return n;\n}", 1, "c"),
        ("/a.cc", "class", 10, 20, f"class A {{\npublic:\n  // {DOC}\n  void m() {{ }}\n  void n() {{ }}\n}};", 1, "c"),
        (None, "function", 1, 2, f"// {DOC}\nint f() {{ }}", 1, "c"),
        ("/b.cc", "function", None, None, f"// {DOC}\nint f() {{ }}", 1, "c"),
        ("/b.cc", "function", 1, 2, None, 1, "c"),
        ("/b.cc", None, 1, 2, f"// {DOC}\nint g() {{ }}", 1, "c"),
        ("/b.cc", "function", 1, 2, f"}} ) int broken( {{\n;\n// {DOC}\nint whole() {{ }}", 1, "c"),
        ("/b.cc", "leftover_block", 1, 2, "", 1, "c"),
        ("/b.cc", "leftover_block", 1, 2, LONG, 1, "c"),
    ]
    got = {(r.file_path, r.func_name): r.description for r in documented.pairs(spark.createDataFrame(rows, S)).collect()}
    assert set(got) == {("/a.cc", "f"), ("/a.cc", "m"), ("/b.cc", "f"), ("/b.cc", "whole")} and set(got.values()) == {DOC}
    assert documented.pairs(spark.createDataFrame([], S)).collect() == []


def test_long_heads_and_comments(spark):
    S = "file_path string, node_type string, start_line int, end_line int, text string"
    params = ", ".join(f"const std::map<int, T{k}>& p{k} = f({{{k}, 2}})" for k in range(400))
    tail = "/*\n\n" + f" * {DOC}\n\n" + " * x\n\n" * 900 + " */\n\n"
    rows = [
        ("/a.cc", "function", 1, 3, f"// {DOC}\nint many({params}) {{ return 1; }}"),
        ("/b.cc", "leftover_block", 1, 9, tail),
        ("/b.cc", "function", 10, 12, "int tailed(int n) { return 1 + ; }"),
        ("/c.cc", "function", 1, 2, "// 1 2\n" + "f " * 3000 + "(" + "a(b) < " * 3000 + ") {}"),
    ]
    got = {r.func_name: r.valid for r in documented.pairs(spark.createDataFrame(rows, S)).collect()}
    assert got == {"many": True, "tailed": False}


def test_templates_are_dropped(spark):
    S = "file_path string, node_type string, start_line int, end_line int, text string"
    rows = [(f"/d{k}/n{k}.cc", "function", 2, 3, f"// Standard accessor of this part, made by the wizard for fn{k}.\nint fn{k}() {{ }}") for k in range(60)]
    rows += [("/own.cc", "function", 2, 3, f"// {DOC}\nint own() {{ }}")]
    df = spark.createDataFrame(rows, S)
    assert [r.func_name for r in documented.pairs(df).collect()] == ["own"]
    assert documented.pairs(df, drop_templates=False).count() == 61


HAND = "#include <x>\n\n// measured on the bench, not generated\nstatic const float t[4] = { 1.0f, 2.0f, 3.0f, 4.0f };\n\nint work(struct S* p)\n{\n    p->a = 1;\n    return 0;\n}\n\nint other(struct S* p)\n{\n    return p->b;\n}\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (HAND, None),
        ("// Generated by toolx 1.2. DO NOT EDIT!\n" + HAND, "generated"),
        ("// License\n/*\n * This file was automatically created by toolx from a.def\n */\n" + HAND, "generated"),
        ("// <auto-generated tool=\"x\" />\n" + HAND, "generated"),
        ("// Was auto-generated once, maintained by hand since the rewrite.\n" + HAND, None),
        ("// The tables below feed the code generator; edit them by hand.\n" + HAND, None),
        ("/* do not edit without telling the audio people */\n" + HAND, None),
        ("".join(f"int S_get_{k}(const struct S* p) {{\n    return p->f{k};\n}}\n\n" for k in range(6)), "generated"),
        ("#define X return\n" + "int d(struct R*p,int n){if(p->a>3){n=f(p,n);}X n;}" * 60, "minified"),
        ("const unsigned char t[] = {\n" + "  0x62, 0x3a, 0xc5, 0xa0, 0x38, 0x5e,\n" * 60 + "};\n", "data"),
        ("\n".join(f"{k:08x}  63 f3 66 13 c6 08 9e dc fd 8c af 63 79 5a 98 1b" for k in range(30)), "data"),
        (HAND + 'const char* k = "' + "one two three " * 60 + '";\n' + HAND, None),
        ("", None),
        (LONG, None),
    ],
)
def test_kinds(text, want):
    assert provenance.kind(text) == want


def test_vendored_subtrees(spark):
    S = "file_path string, repo string, text string, h long, code long"
    lib = [f"int lib_{k}(int a) {{ return a + {k}; }}\n" * 9 for k in range(3)]
    rows = []
    for repo in ("one", "two", "three"):
        for k, t in enumerate(lib):
            rows.append((f"/c/{repo}/src/inner/x{k}.c", repo, t.replace("\n", "\r\n") if repo == "two" else t, 1, 1))
        rows.append((f"/c/{repo}/src/own.c", repo, f"int own_{repo}() {{ return 1; }}\n" * 9, 1, 1))
    rows += [("/c/mirror/" + r[0].split("/", 3)[3], "mirror", r[2], 1, 1) for r in rows if r[1] == "one"]
    rows += [("/c/one/a.c", "one", None, 1, 1), (None, "one", lib[0], 1, 1), ("/c/one/e1.c", "one", "", 1, 1), ("/c/two/e2.c", None, "", 1, 1), ("/c/one/src/own.c", "one", rows[3][2], 1, 1), ("x", None, lib[0] + "x", 1, 1)]
    got = {r.file_path: r.repos for r in provenance.vendored(spark.createDataFrame(rows, S)).collect()}
    assert {p for p in got} == {r[0] for r in rows[:16] if r[0] and "/inner/" in r[0]} | {f for f in got if f.startswith("/c/mirror/") or f == "/c/one/src/own.c"}
    assert "/c/two/src/own.c" not in got
    assert provenance.not_hand_written(spark.createDataFrame([], S)).collect() == []


def test_mirrors_are_one_repository(spark):
    S = "file_path string, repo string, text string"
    text = lambda k: f"int part_{k}(int a) {{ return a + {k}; }}\n" * 9
    for names in (("zz", "aa"), ("aa", "zz"), ("m1", "m2")):
        rows = [(f"/c/{n}/src/x{k}.c", n, text(k)) for n in names for k in range(3)]
        rows += [("/c/other/src/y.c", "other", text(9))]
        assert provenance.vendored(spark.createDataFrame(rows, S)).collect() == []
        rows += [("/c/other/src/x0.c", "other", text(0))]
        got = {r.file_path for r in provenance.vendored(spark.createDataFrame(rows, S)).collect()}
        assert got == {f"/c/{n}/src/x0.c" for n in (*names, "other")}


def test_any_text_of_a_path_counts(spark):
    S = "file_path string, repo string, text string"
    lib, own = "int lib(int a) { return a; }\n" * 9, "int own(int a) { return a; }\n" * 12
    rows = [("/c/one/x.c", "one", lib), ("/c/one/x.c", "one", own), ("/c/two/src/y.c", "two", lib), ("/c/two/src/z.c", "two", own[:250])]
    assert {r.file_path for r in provenance.vendored(spark.createDataFrame(rows, S)).collect()} == {"/c/one/x.c", "/c/two/src/y.c"}


def scan_rows():
    rng = random.Random(4)
    nouns, verbs = "pump gear wheel shaft motor frame".split(), "turns moves holds checks".split()
    line = lambda: f"The {rng.choice(nouns)} that the {rng.choice(nouns)} {rng.choice(verbs)} is not the last {rng.choice(nouns)} here."
    pages = []
    for d in range(6):
        for p in range(1, 9):
            body = [line() for _ in range(12)]
            pages.append([f"/d{d}.pdf", p, ["Gear and Shaft" if p % 2 else "Motor Report", *body, str(p + 3)]])
    return pages


def test_scans(spark):
    pages = scan_rows()
    pages[0][2][3] = "The pump that the gcar turns is not the last shaft here."
    pages[1][2][2:4] = ["The frame that the wheel turns is not the last mo-", "tor here and the pump holds it."]
    pages[2][2][-2] = "The pump that the frame moves is not the whe-"
    pages[3][2][1] = "el that the gear checks and holds here."
    pages[4][2][5] = "The self-moving gear is a self-"
    pages[4][2][6] = "moving pump that holds the self-moving gear."
    pages[5][2][0], pages[5][2][-1] = "Motor RepOrt", "l9"[::-1].replace("9l", "9")
    S = "path string, page_number int, lines array<string>, key string, n long"
    rows = [(*p, "x", 1) for p in pages] + [(*pages[0], "x", 1), ("/e.pdf", 1, [], "x", 1), ("/e.pdf", 2, None, "x", 1), (None, 1, ["a"], "x", 1), ("/e.pdf", None, ["a"], "x", 1), ("/e.pdf", 3, [None, "", "A line."], "x", 1)]
    got = {(r.path, r.page_number, r.line_no, r.kind) for r in scans.noise_of(spark.createDataFrame(rows, S)).collect()}
    furniture = {(p, k, n) for p, k, n, kind in got if kind == "furniture"}
    assert furniture == {(p[0], p[1], n) for p in pages for n in (1, len(p[2]))}
    assert {x[:3] for x in got if x[3] == "misread"} == {("/d0.pdf", 1, 4)}
    assert {x[:3] for x in got if x[3] == "broken_word"} == {("/d0.pdf", 2, 3), ("/d0.pdf", 3, 13)}
    text = [r.text for r in scans.paragraphs(spark.createDataFrame(rows, S)).where("path = '/d0.pdf' AND page_number <= 2").orderBy("paragraph_no").collect()]
    assert "the last motor here and the pump" in " ".join(text) and "Motor Report" not in " ".join(text)
    assert scans.noise_of(spark.createDataFrame([], S)).collect() == []


def test_settled_words_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    pages = scan_rows()
    for page in pages:
        for k in range(1, 13):
            if rng.random() < 0.2:
                page[2][k] = page[2][k].replace(*rng.choice([("e", "c"), ("m", "rn"), ("o", "0"), ("h", "b")]), 1)
    df = spark.createDataFrame([tuple(p) for p in pages], "path string, page_number int, lines array<string>")
    want = sorted(map(tuple, scans.noise_of(df).collect()))
    assert any(r[3] == "misread" for r in want)
    for most in (0, 5):
        monkeypatch.setattr(scans, "SETTLED", most)
        assert sorted(map(tuple, scans.noise_of(df).collect())) == want


def test_paragraphs_over_pages(spark):
    pages = scan_rows()
    long = "The frame that the wheel turns is not the last motor that the gear checks and holds"
    pages[0][2][-2] = long + " in the mo-"
    pages[1][2][1:-1] = ["tor " + long] * 12
    pages[2][2][1:3] = ["and at last the motor stops here.", "The pump holds the gear that the wheel turns in the frame and moves it no more here."]
    df = spark.createDataFrame([tuple(p) for p in pages], "path string, page_number int, lines array<string>")
    got = {(r.page_number, r.paragraph_no): r for r in scans.paragraphs(df).where("path = '/d0.pdf' AND page_number <= 3").collect()}
    first = max((r for r in got.values() if r.page_number == 1), key=lambda r: r.paragraph_no)
    assert first.last_page == 3 and "in the motor The frame" in first.text and first.text.endswith("the motor stops here.")
    assert not any(r.page_number == 2 for r in got.values())


def test_pages_of_chunks(spark):
    rows = [("/a.pdf", 1, 0, "one two\nthr"), ("/a.pdf", 1, 8, "three\nfour"), ("/a.pdf", 1, 8, "three\nfour"), ("/a.pdf", 2, None, ""), ("/a.pdf", None, 0, "x"), (None, 1, 0, "x"), ("/a.pdf", 3, 0, None)]
    df = spark.createDataFrame(rows, "file_path string, page_number int, start_char int, text string")
    assert {(r.page_number, tuple(r.lines)) for r in scans.pages_of_chunks(df).collect()} == {(1, ("one two", "three", "four")), (2, ("",))}
    assert scans.pages_of_chunks(df.limit(0)).collect() == []
