import io
import zipfile

import pytest

from ragloom.sources import files


def _docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:tbl/></w:body></w:document>")
    return out.getvalue()


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"x\xff\r\ny")
    (tmp_path / "d" / "b.docx").write_bytes(_docx("one", "two"))
    (tmp_path / "d" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.exe").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in files.read_texts(files.scan_documents(spark, str(tmp_path))).collect()}
    assert got == {"a.TXT": ("x\ny", True), "b.docx": ("one\ntwo", True), "bad.docx": (None, False)}
    with pytest.raises(NotADirectoryError):
        files.scan_documents(spark, str(tmp_path / "none"))


def test_code_scan_ignores(spark, tmp_path):
    for name in ("a.c", "gen_b.c", ".h"):
        (tmp_path / name).write_text("int x;")
    got = files.scan_code(spark, str(tmp_path), ["gen_*"])
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["a.c"]


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"p1|l2\fp2")
    reader = lambda content: [p.split("|") for p in content.decode().split("\f")]
    got = files.read_pages(files.scan_documents(spark, str(tmp_path)), reader).orderBy("page_number").collect()
    assert [(r.page_number, r.lines) for r in got] == [(1, ["p1", "l2"]), (2, ["p2"])]


def test_ranges_of_a_giant_file(spark, tmp_path):
    text = "".join(chr(97 + k % 26) + "é日😀"[k % 3] for k in range(5000))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    sizes = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, length long")
    got = files.text_ranges(spark, sizes, range_bytes=1001, halo=7).orderBy("r").collect()
    assert "".join(r.part[r.lo - r.start : r.lo - r.start + r.n] for r in got) == text
    assert all(text[r.start : r.start + len(r.part)] == r.part for r in got)
