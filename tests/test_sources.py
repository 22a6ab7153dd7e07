"""Files of every kind, read back."""

import io
import json
import zipfile

from strataq.sources import files as S


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{"<w:pPr><w:pStyle w:val=%r/></w:pPr>" % s if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'.replace("'", '"')
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("总则", "Heading1") + p("第一段。") + f"<w:tbl><w:tr>{cell('甲')}{cell('乙')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("后文。")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx() -> bytes:
    x, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}" xmlns:r="{r}"><sheets><sheet name="台账" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>名称</t></si><si><t>数量</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>叉车</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("动火作业。".encode("gb18030"))
    (tmp_path / "sub" / "b.md").write_text("# 标题", encoding="utf-8")
    (tmp_path / "README.md").write_text("no", encoding="utf-8")
    (tmp_path / "c.docx").write_bytes(docx())
    (tmp_path / "d.xlsx").write_bytes(xlsx())
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.docx").write_bytes(b"broken")
    rows = S.load(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    assert by["a.txt"][0]["page_content"] == "动火作业。"
    assert by["b.md"][0]["doc_type"] == "markdown"
    assert [r["page_content"] for r in by["c.docx"]] == ["## 总则\n第一段。", "【表格】\n| 甲 | 乙 |\n|---|---|\n| 1 | 2 |", "后文。"]
    assert by["d.xlsx"][0]["page_content"] == "【表格：工作表 台账】\n| 名称 |   | 数量 |\n|---|---|---|\n| 叉车 |   |   |"
    assert "no parser" in by["e.pdf"][0]["error"] and by["f.docx"][0]["error"]
    assert "README.md" not in by
    files = S.scan(spark, str(tmp_path))
    assert {r["category"] for r in files.collect()} == {"根目录", "sub"}
    cache = S.unparsed(files, spark.createDataFrame([], "cache_key string"))
    assert cache.count() == 6 and S.unparsed(files, cache).count() == 0


def test_items_both_shapes(spark, tmp_path):
    items = [{"id": "1", "question": "q", "key_points": ["a"]}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "b.json").write_text(json.dumps({"items": items}))
    for f in ("a.json", "b.json"):
        assert [(r["id"], r["key_points"]) for r in S.read_items(spark, str(tmp_path / f)).collect()] == [("1", ["a"])]


def test_report(spark):
    got = S.report(spark.createDataFrame([("bm25", 0.5), ("hybrid", None)], "mode string, hit double"), "T").orderBy("line_no")
    assert [r["line"] for r in got.collect()] == ["# T", "", "| mode | hit |", "|---|---|", "| bm25 | 0.5 |", "| hybrid |  |"]


def test_long_sheet_is_whole(spark):
    row = lambda i: f'<row><c r="A{i}"><v>{i}</v></c></row>'
    raw = io.BytesIO(xlsx())
    out = io.BytesIO()
    with zipfile.ZipFile(raw) as a, zipfile.ZipFile(out, "w") as z:
        for name in a.namelist():
            z.writestr(name, a.read(name) if "sheet1" not in name else '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(map(row, range(1, 2502))) + "</sheetData></worksheet>")
    assert len(S.parse_xlsx("a.xlsx", out.getvalue())[0]["cells"]) == 2501


def test_batch_report_and_json(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.txt").write_text("甲")
    (tmp_path / "in" / "a" / "y.docx").write_bytes(b"broken")
    (tmp_path / "in" / "z.txt").write_text("乙")
    got = S.batch_report(S.load(spark, str(tmp_path / "in")), str(tmp_path / "in"))
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 1), ("根目录", 1, 0, 1)}
    S.write_json(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
