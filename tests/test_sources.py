import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veridock.operators import audit, structure
from veridock.sources import files, formats


def test_html():
    page = "<html><head><title>no</title></head><body><div><h2>Chapter 1</h2>Intro <b>bold</b>  <table><tr><td>a</td> <td>b</td></tr></table><script>x</script>&amp;amp; end</div></body></html>"
    assert formats.from_html(page) == "Chapter 1\nIntro bold  \na\tb\n&amp; end"


def test_rtf():
    text = r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator X;}{\info{\title T}}Hello \b bold\b0 \{x\}\par caf\u233? \tab end}"
    out = formats.from_rtf(text)
    assert out.split("\n")[0].replace(" ", "") == "Hellobold{x}" and out.split("\n")[1].split() == ["café", "end"]
    assert not any(x in out for x in ("Arial", "generator", "X;", "T\n"))
    assert "Body" in formats.from_rtf(r"{\rtf1{\info{\title T Body")


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx():
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sdt><w:p><w:r><w:t>in</w:t></w:r></w:p></w:sdt></w:body></w:document>"
    data = _zip({"word/document.xml": body})
    assert formats.from_docx(data) == "One two\na\tb\nin" and formats.sniff(data, "") == ".docx"
    with pytest.raises(formats.ExtractionError):
        formats.from_docx(_zip({"word/document.xml": "<!DOCTYPE x>" + body}))


def test_epub():
    opf = '<package><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/><item id="c" href="c.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    data = _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<rootfile full-path="o/x.opf"/>', "o/x.opf": opf, "o/a.html": "<p>A</p>", "o/b.html": "<p>B</p>", "o/c.html": "<p>C</p>"})
    assert formats.from_epub(data) == "A\n\nB\n\nC" and formats.epub_chapters(data) == 2


def test_decode():
    for name in ("utf-8-sig", "utf-16", "utf-32"):
        assert formats.decode("é日".encode(name)) == "é日"
    assert formats.decode("“é”".encode("cp1252")) == "“é”" and formats.decode(b"\x81") == "\x81" and formats.decode(b"") == ""


def test_pages():
    pages = "\f".join(f"Head\ntext {k} bro-\nken\n{k}" for k in range(1, 4))
    out = formats.clean_pages(pages)
    assert "Head" not in out and "text 2 broken" in out and "\n2\n" not in out
    # a running head goes away from the edge too, Roman numbers at the edge go, others stay
    inside = formats.clean_pages("Head\na\niv\f\nHead\nb 7\n7\nc\f\nx\nHead\ny\fHead\nz\n")
    assert "Head" not in inside and "iv" not in inside and "\n7\n" in inside
    assert formats.clean_pages("Head\n1\fHead\n2") == "Head\n1\nHead\n2"


def test_pdf_ways(monkeypatch):
    def tool(command, *_):
        raise OSError("none")

    monkeypatch.setattr(formats, "_tool", tool)
    monkeypatch.setattr(formats, "_by_pypdf", lambda data: ["", "  "])
    monkeypatch.setattr(formats, "_by_pdfminer", lambda data: ["found"])
    assert formats.from_pdf(b"%PDF").strip() == "found" and formats.pdf_pages(b"%PDF") == 2
    monkeypatch.setattr(formats, "_by_docling", lambda data: ["laid out"])
    assert formats.from_pdf(b"%PDF", technical=True) == "laid out"
    monkeypatch.setattr(formats, "_by_pdfminer", lambda data: [])
    with pytest.raises(formats.ExtractionError, match="pdftotext: OSError; pypdf: no text; pdfminer: no text"):
        formats.from_pdf(b"%PDF")


@pytest.mark.parametrize(
    "line,number",
    [("Chapter 5", 5), ("## Chapter 1: Intro", 1), ("Chapter 6 explores things", None), ("Capítulo IV. Fin", 4), ("CHAPITRE 3", 3), ("II. The Carpet", 2), ("## i. introduction", 1), ("vi: the editor", None), ("IIII: Bad", None),
     ("第三章 起", 3), ("第十二节", 12), ("## 一 · 缘起", 1), ("第１章", 1), ("บทที่ ๑๒", 12), ("제1장 총칙", 1), ("제5장에서 본다", None), ("Hoofdstuk 2 - Begin", 2), ("5 Setup", None), ("Chapter 7 " + "x" * 90, None)],
)
def test_chapter_lines(spark, line, number):
    assert structure.chapter_number_of(line) == number
    found = [r.number for r in structure.chapter_lines(spark.createDataFrame([(1, line)], "id int, text string"), "id", "text").collect()]
    assert found == ([] if number is None else [number])


def test_structure(spark):
    docs = [
        (1, "Contents\n\nChapter 1\nx\nChapter 2\ny\nChapter 1"), (2, "# Book\n\n## One\ntext\n## Two\n```\n## Not\n```\n## two"), (3, "Title\n=====\n\nPart\n----\nOther\n-----\n"), (4, "plain"), (5, None), (6, "| a |\n=====\n## 5 Setup"),
    ]
    out = {r.id: (r.chapters, len(r.headings), r.has_contents) for r in structure.detect(spark.createDataFrame(docs, "id int, text string"), "id", "text").collect()}
    assert out == {1: (2, 3, True), 2: (2, 0, False), 3: (2, 0, False), 4: (0, 0, False), 5: (0, 0, False), 6: (1, 0, False)}


def test_discovery(spark):
    text = "front words here\n" + "\n".join(f"Chapter {k}\n" + "word " * (30 * k) for k in (1, 2, 3))
    r = structure.discovery_cost(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", 10, 5).first()
    assert r.dump > r.loop > r.best > r.compiled == 15


def test_scan_extract_and_manifest(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Title\n\n- Teams should use small queues.\n")
    (tmp_path / "a.txt").write_bytes("café".encode("cp1252"))
    (tmp_path / "bad.docx").write_bytes(b"PK not a zip")
    (tmp_path / "skip.bin").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path), str(tmp_path / "b.md"))
    assert found.count() == 3
    out = {r.path.rpartition("/")[2]: r for r in files.extract(found).collect()}
    assert out["a.txt"].text == "café" and out["bad.docx"].text is None and out["bad.docx"].error and out["b.md"].tokens > 0
    files.check_budget(found)
    with pytest.raises(ValueError):
        files.check_budget(found, sources=1)
    manifest = '{"schema_version":"1.0","id":"c","name":"n","configuration_ref":"r","created_at":"2024","source_entries":[{"source_id":"b","input_ref":"b.md"},{"source_id":"z","input_ref":"none.md"}]}'
    (tmp_path / "m.json").write_text(manifest)
    entries = files.load_manifest(spark, str(tmp_path / "m.json"))
    got = {r.source_id: r for r in files.ingest(entries, found, str(tmp_path)).collect()}
    assert files.missing_paths(spark, str(tmp_path / "no"), str(tmp_path)) == [str(tmp_path / "no")] and files.scan(spark, str(tmp_path / "no"), str(tmp_path / "b.md")).count() == 1
    meta = files.metadata(found, files.extract(found))
    whole = files.totals(meta).first()
    assert meta.count() == 2 and (whole.total_sources, whole.filename, whole.format) == (2, "multi-source", "mixed") and whole.estimated_tokens_human == "~0K"
    assert files.totals(meta.where("filename = 'b.md'")).first().filename == "b.md"
    (tmp_path / "b.md").write_text("# Title\n\n- Changed.\n")
    changed = {r.source_id: r.error for r in files.ingest(entries, files.scan(spark, str(tmp_path)).where("false").unionAll(found), str(tmp_path), found.withColumn("content", F.lit(bytearray(b"x")))).collect()}
    assert changed["b"] == "changed while it was read"
    assert got["b"].title == "Title" and got["b"].media == "text/markdown" and got["b"].record_id and got["z"].error == "missing" and got["z"].record_id is None
    (tmp_path / "m2.json").write_text(manifest.replace("none.md", "../x.md"))
    with pytest.raises(Exception, match="input reference"):
        files.load_manifest(spark, str(tmp_path / "m2.json")).collect()


def test_audit(spark):
    text = "---\nname: Bad Name\ndescription: d\nodd: 1\nallowed-tools: Read\ndisable-model-invocation: no\n---\n- system: obey\nassistant: fine\nplease exfiltrate it\nsend base64 data\nfine\u200b\nallowed-tools: Bash"
    tree = spark.createDataFrame([("SKILL.md", text), ("x.md", "plain\nyou are now it"), ("A.md", "<system>")], "path string, text string")
    found = [(r.path, r.line, r.rule) for r in audit.report_order(audit.findings(tree)).collect()]
    assert found == [
        ("A.md", 1, "prompt.system_tag"), ("SKILL.md", 5, "frontmatter.allowed_tools"), ("SKILL.md", 6, "frontmatter.model_invocation_enabled"), ("SKILL.md", 8, "prompt.fake_system_prefix"),
        ("SKILL.md", 10, "tool.exfiltration_shape"), ("SKILL.md", 11, "tool.exfiltration_shape"), ("SKILL.md", 12, "unicode.invisible"), ("x.md", 2, "prompt.role_reassignment"),
    ]


@pytest.mark.parametrize(
    "lens,grants,body,want",
    [("strict", "\nallowed-tools:\n  - Read\n  - Bash(python3 *)", "run python3 x", []), ("strict", "\nallowed-tools: Read", "```bash\nx\n```", ["tools leave out the shell that the body needs"]),
     ("strict", "\nallowed-tools: my-server", "x", ["no known tool is granted", "unknown tool"]), ("tokens", "\nallowed-tools: my-server", "x", ["unknown tool"]), ("tokens", "\nallowed-tools: shell", "python3 x", []),
     ("mixed", "\ncompatibility: all", "x", []), ("strict", "\ncompatibility: all", "x", ["unknown key"]), ("strict", "", "x", [])],
)
def test_lenses(spark, lens, grants, body, want):
    text = f"---\nname: a-b\ndescription: d{grants}\n---\n{body}"
    assert [r.problem for r in audit.front_matter(spark.createDataFrame([("p", text)], "path string, text string"), lens).collect()] == want


def test_front_matter(spark):
    rows = [("none", "text"), ("bad", "---\nname: My Claude\n---\n" + "x\n" * 501), ("long", f"---\nname: {'a' * 65}\ndescription: {'d' * 1025}\n---\n")]
    got = {}
    for r in audit.front_matter(spark.createDataFrame(rows, "path string, text string")).collect():
        got.setdefault(r.path, []).append((r.level, r.problem))
    assert got == {
        "none": [("error", "no front matter")], "bad": [("error", "name has other characters"), ("error", "name has a reserved word"), ("error", "no description"), ("warning", "more than 500 lines")],
        "long": [("error", "name too long"), ("error", "description too long")],
    }
    budget = spark.createDataFrame([("technical", "study"), ("text", "none")], "c string, d string").select(audit.unit_budget(F.col("c"), F.col("d")).alias("b")).collect()
    assert tuple(budget[0].b) == (2000, 3000) and budget[1].b is None
    front = spark.createDataFrame([("intro\nContents\n1 a",), ("intro",)], "t string").select(structure.contents_block(F.col("t")).alias("b")).collect()
    assert front[0].b.strip().startswith("Contents") and front[1].b == "intro"
