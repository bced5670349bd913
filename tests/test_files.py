import io
import zipfile

import pytest

from lexatlas.functions.vectors import HashedEmbedder
from lexatlas.sources import files
from lexatlas.sources.store import Repository

#: A stand-in for the PDF library: a page a line of JSON, each a list of (text, size, bold).
FITZ = '''
import json
class Table:
    def extract(self): return [["a", "b"], ["1", "2"]]
class Tables:
    def __init__(self, n): self.tables = [Table()] * n
class Page:
    def __init__(self, lines): self.lines = lines
    def get_text(self, _): return {"blocks": [{"lines": [{"spans": [{"text": t, "size": s, "flags": 16 * b}]} for t, s, b in self.lines if t != "TABLE"]}]}
    def find_tables(self): return Tables(sum(t == "TABLE" for t, _, _ in self.lines))
def open(stream, filetype):
    return [Page(json.loads(x)) for x in stream.decode().splitlines()]
'''
BODY = ["# CHAPTER 9 WAYS", "### 901.5 Five", "Text of five."]


def pdf(*pages):
    import json

    return "\n".join(json.dumps(p) for p in pages).encode()


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    lib = tmp_path_factory.mktemp("lib") / "fitz.py"
    lib.write_text(FITZ)
    spark.sparkContext.addPyFile(str(lib))
    root = tmp_path_factory.mktemp("mixed")
    (root / "good.md").write_text("\n".join(BODY))
    (root / "good.docx").write_bytes(docx("A paragraph."))
    (root / "broken.docx").write_bytes(b"not a zip")
    (root / "good.pdf").write_bytes(pdf([("Big", 14.0, True), ("one", 10.0, False), ("two.", 10.0, False), ("TABLE", 0, False)], [("three.", 10.0, False)]))
    (root / "scanned.pdf").write_bytes(pdf([], [], [("one line", 10.0, False)]))
    (root / "blank.pdf").write_bytes(pdf([], []))
    (root / "broken.pdf").write_bytes(b"{no json")
    return root


def test_one_row_for_each_file_that_fails(spark, mixed):
    rows = files.parsed(files.scan(spark, str(mixed))).collect()
    name = lambda r: r["document"].rsplit("/", 1)[1]
    bad = {name(r): r["error"] for r in rows if r["error"]}
    assert set(bad) == {"broken.docx", "broken.pdf", "scanned.pdf", "blank.pdf"} and len([r for r in rows if r["error"]]) == 4
    assert "BadZipFile" in bad["broken.docx"] and "scanned?" in bad["blank.pdf"] and "scanned?" in bad["scanned.pdf"] and "JSON" in bad["broken.pdf"]
    good = {}
    for r in sorted((r for r in rows if not r["error"]), key=lambda r: (r["document"], r["ord"])):
        good.setdefault(name(r), []).append((r["kind"], r["text"], r["page"]))
    assert good["good.pdf"] == [("heading", "Big", 1), ("paragraph", "one two.", 1), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", 1), ("paragraph", "three.", 2)]
    assert good["good.docx"] == [("paragraph", "A paragraph.", None)] and len(good["good.md"]) == 3


@pytest.mark.parametrize("which", ["blank.pdf", "scanned.pdf", "broken.pdf", "broken.docx"])
def test_strict_reading_raises(spark, mixed, which):
    some = files.scan(spark, f"{mixed}/{which}")
    with pytest.raises(Exception, match="scanned|JSON|BadZip"):
        files.all_blocks(some).collect()


def test_a_broken_file_leaves_the_rest_of_a_batch(spark, mixed, tmp_path):
    repo = Repository(spark, str(tmp_path / "s"))
    emb = HashedEmbedder(16)
    repo.init("hashed", emb.name, 16)
    stats = repo.ingest(files.scan(spark, str(mixed)), files.parsed, "t", "T", "plain", "base", emb)
    assert stats["sections"] > 0
    assert sorted(r["source_path"].rsplit("/", 1)[1] for r in repo.read("documents").collect()) == ["good.docx", "good.md", "good.pdf"]
    runs = repo.read("ingest_runs").collect()
    failed = sorted(r["error"].split(": ")[0].rsplit("/", 1)[1] for r in runs if r["status"] == "failed")
    assert failed == ["blank.pdf", "broken.docx", "broken.pdf", "scanned.pdf"] and len({r["id"] for r in runs}) == len(runs) == 5
    only = Repository(spark, str(tmp_path / "o"))
    only.init("hashed", emb.name, 16)
    assert only.ingest(files.scan(spark, f"{mixed}/broken.docx"), files.parsed, "t", "T", "plain", "base", emb)["sections"] == 0
    assert only.read("documents").count() == 0 and only.read("ingest_runs").count() == 1
