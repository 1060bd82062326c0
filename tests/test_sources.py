import json
import zipfile

import pytest

from skarn.sources import readers as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_mark(spark, tmp_path):
    df = S.csv(spark, write(tmp_path / "a.csv", "﻿id,v\n1,007\n"))
    assert df.columns == ["id", "v"] and df.first().v == "007"


def test_json_roots(spark, tmp_path):
    assert S.json_records(spark, write(tmp_path / "a.json", json.dumps([{"x": 1}, {"x": 2}]))).count() == 2
    assert S.json_records(spark, write(tmp_path / "b.json", json.dumps({"data": [{"x": 1}]}))).columns == ["x"]


def test_corpus_queries_qrels(spark, tmp_path):
    c = S.corpus(spark, write(tmp_path / "c.jsonl", '{"_id": "1", "contents": "t", "extra": 5}\n')).first()
    assert (c.docid, c.text, c.metadata) == ("1", "t", {"extra": "5"})
    q = S.queries(spark, write(tmp_path / "q.jsonl", '{"qid": "1", "text": " a "}\n{"qid": "", "text": "b"}\n{"qid": "3", "text": ""}\n'))
    assert [tuple(r) for r in q.collect()] == [("1", "a")]
    r = S.qrels(spark, write(tmp_path / "r.tsv", "qid\tdocid\trelevance\n# no\n\nq1\td1\t2\nq1\t0\td2\t1\n"))
    assert sorted(map(tuple, r.collect())) == [("q1", "d1", 2), ("q1", "d2", 1)]
    with pytest.raises(Exception, match="malformed"):
        S.qrels(spark, write(tmp_path / "bad.tsv", "q1 d1\n")).collect()


def test_run_file_and_versions(spark, tmp_path):
    run = spark.createDataFrame([(1, 7, 1, 0.5)], "qid int, docid int, rank int, score double")
    S.write_run(run, str(tmp_path / "run"), "tag")
    assert spark.read.text(str(tmp_path / "run")).first().value == "1 Q0 7 1 0.5 tag"
    a = spark.createDataFrame([(1, "a")], "id int, v string")
    t = str(tmp_path / "t")
    S.merge_table(spark, t, a, ["id"])
    b = S.merge_table(spark, t, spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"])
    assert sorted(map(tuple, b.collect())) == [(1, "b"), (2, "c")]
    again = S.merge_table(spark, t, spark.createDataFrame([(1, "b")], "id int, v string"), ["id"])
    assert sorted(map(tuple, again.collect())) == [(1, "b"), (2, "c")]
    (tmp_path / "t" / "data" / "rows" / "lost" / "bucket=0").mkdir(parents=True)  # an unfinished write doesn't count
    gap = S.merge_table(spark, t, spark.createDataFrame([(3, "d")], "id int, v string"), ["id"])
    assert sorted(map(tuple, gap.collect())) == [(1, "b"), (2, "c"), (3, "d")]
    newest = max((tmp_path / "t" / "data" / "rows").iterdir(), key=lambda f: f.stat().st_mtime_ns)
    assert len(list(newest.glob("bucket=*"))) == 1


def test_text_blocks(spark, tmp_path):
    rows = S.text_blocks(spark, write(tmp_path / "a.md", "# One\n\nfirst\n")).orderBy("line_no").collect()
    assert [(r.offset, r.section, r.text) for r in rows] == [(0, "One", "# One"), (7, "One", "first")]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet9.xml"/><Relationship Id="r2" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>3.0</v></c></row></sheetData></worksheet>')
    assert sorted((r.row, r.col, r.value) for r in S.xlsx(spark, str(tmp_path / "a.xlsx"), "Data").collect()) == [(1, 1, "name"), (1, 28, "3")]
