"""Workbooks, grids, pages, text tables, cleaning, streaming."""

from __future__ import annotations

import random
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.functions import numbers as N
from gristmill.functions.text import chunks_of, first_object, plain
from gristmill.operators import profiling as R
from gristmill.operators import retrieval as H
from gristmill.operators import values as V
from gristmill.sources import files, grids, pages, workbook
from gristmill.sources.extract import table_in
from gristmill.streaming import watch

_ = None


@pytest.mark.parametrize(
    ("grid", "names", "body"),
    [
        ([["A", "B"], ["1", "2"]], ["A", "B"], 1),
        ([["Report of 2023", _, _], [_, _, _], ["Name", "Qty", "Price"], ["x", "1", "2"]], ["Name", "Qty", "Price"], 3),
        ([[_, "2022", _, "2023", _], ["Company", "Rev", "Cost", "Rev", "Cost"], ["a", "1", "2", "3", "4"]], ["Company", "2022 Rev", "2022 Cost", "2023 Rev", "2023 Cost"], 2),
        ([[_, "FUNDS", "FUNDS", _], ["Name", "In", "Out", "Total"], ["a", "1", "2", "3"]], ["Name", "FUNDS In", "FUNDS Out", "Total"], 2),
        ([["307518243.8", "12", "7"], ["Name", "In", "Out"], ["a", "1", "2"]], ["Name", "In", "Out"], 2),
        ([], [], 0),
    ],
)
def test_headers(grid, names, body):
    assert grids.recover_header(grid) == (names, body)


def test_names_and_junk():
    assert grids.clean_names(["BANK  'GROUPS'", "BANK GROUPS", "x"]) == ["BANK GROUPS", "BANK GROUPS.1", "x"]
    assert grids.is_degenerate([f"T.{i}" for i in range(9)]) and grids.is_degenerate(["col_1", "col_2"]) and not grids.is_degenerate(["a", "b"])
    assert grids.skip_sheet("CEO view") and grids.skip_sheet("P-1") and not grids.skip_sheet("MATRIX")
    blank = [False, False, False, True, True, False, False, True, False]
    assert grids.split_regions(blank, lambda a: True) == [(0, 3), (5, 9)]
    assert grids.split_regions(blank, lambda a: False) == [(0, 9)]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "CY01 31-12-2023.xlsx")
    rows = [{"Company": f" c{i} <&>", "Amount": 1.5 * i, "Code": str(i), "Gap": None} for i in range(30)]
    workbook.write_workbook(rows, path, "Data")
    tables = files.read_file(spark, path)
    (name,) = tables
    assert name == "CY01 31-12-2023.xlsx:Data"
    df = tables[name]
    assert dict(df.dtypes) == {"Company": "string", "Amount": "double", "Code": "double"}
    assert df.agg(F.sum("Amount")).first()[0] == pytest.approx(sum(r["Amount"] for r in rows)) and df.where("Company = 'c3 <&>'").count() == 1
    with pytest.raises(ValueError, match="over"):
        workbook.write_workbook(df, path, most=3)
    with pytest.raises(ValueError, match="kind"):
        files.read_file(spark, "x.doc")


def test_csv_is_typed(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('Name,Net,When\n a ,"1.234,50",31.12.2023\nb,"7,5",01.02.2024\n')
    (df,) = files.read_file(spark, str(path)).values()
    assert dict(df.dtypes) == {"Name": "string", "Net": "double", "When": "timestamp_ntz"} and df.first()["Net"] == 1234.5


def test_merged_cells_dates_and_shared_strings():
    main = workbook.MAIN[1:-1]
    sheet = (
        f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Name</t></is></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4" s="1"><v>45291</v></c><c r="C4"><v>2.50</v></c></row></sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells></worksheet>'
    )
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{workbook.LINK[1:].split("}")[0]}"><sheets><sheet name="S" r:id="a"/><sheet name="pivot" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>20</t></r><r><t>23</t></r></si><si><t>Sum</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", sheet)
    assert list(workbook.parse(raw.getvalue())) == [("S", 0, [_, "2023", "2023"]), ("S", 1, ["Name", "Sum", "Sum"]), ("S", 3, ["True", "2023-12-31", "2.5"])]
    assert len(list(workbook.parse(raw.getvalue(), 2))) == 2
    with pytest.raises(ValueError, match="older"):
        list(workbook.parse(b"\xd0\xcf\x11\xe0"))


def test_pages_stitch_by_shape(spark):
    rows = [("f", 1, 1, 0, ["n", "1"]), ("f", 1, 1, 1, ["a", "2"]), ("f", 2, 1, 0, ["b", "3"]), ("f", 3, 1, 0, ["b", "3", "4"]), ("f", 5, 1, 0, ["c", "4", "5"])]
    got = pages.stitch(spark.createDataFrame(rows, "file string, page int, table int, row int, cells array<string>"))
    assert {(r["page"], r["part"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 2), (5, 3)}
    glued = spark.createDataFrame([("1,000 2,000",), ("3,000 4,000",)], "a string")
    assert not pages.quality(["a"], glued) and pages.quality(["a"], spark.createDataFrame([("x",)], "a string")) and not pages.quality(["1", "2"], glued)


def test_locales(spark):
    df = spark.createDataFrame([("1.234,56", "1,234.50", "1.234", "1.5"), ("12,5", "(7.00)", "2.345", "x"), (None, "$3.10", None, "2,5")], "eu string, us string, code string, mixed string")
    got = N.read_numbers(df, df.columns)
    assert dict(got.dtypes) == {"eu": "double", "us": "double", "code": "string", "mixed": "string"}
    assert [r["eu"] for r in got.collect()] == [1234.56, 12.5, None] and [r["us"] for r in got.collect()] == [1234.5, -7.0, 3.1]
    assert N.echoes("It is 1,234.50 in all", "1234.5") and not N.echoes("99", "1234.5")
    assert N.reformat("of 1234567.5 in 2023", "EU") == "of 1.234.567,50 in 2023"
    for same in ("rate 0.04236 and 3.14159", "on 31.12.2023 or 2023-12-31", "code C0011 and 4711A", "sum 1,234,567.50", "in 1999 and 2100", "999 of 123.45", "1234,5 and 1234.5.6"):
        assert N.reformat(same) == same
    assert N.reformat("1234 and -98765.4321; 2023.5") == "1,234 and -98,765.43; 2,023.50" and N.reformat("12345", "plain") == "12345"


def test_types_need_most_of_the_values(spark):
    df = spark.createDataFrame([(str(i) if i else "n/a", "31.12.2023" if i % 2 else "x", None) for i in range(10)], "a string, b string, c string")
    assert {r["column"]: r["type"] for r in R.coercions(df).collect()} == {"a": "number", "b": "text", "c": "text"}
    assert {r["column"]: r["type"] for r in R.coercions(df, {"a": "text"}).collect()}["a"] == "text"


def test_regions_over_ranges(spark):
    full = [1, 2, 3, 10, 11, 65_534, 65_535, 65_537, 65_538, 65_560, 200_000]
    got = R.regions(spark.createDataFrame([(i,) for i in full], "n long"), "n", F.lit(False)).orderBy("n").collect()
    assert [r["region"] for r in got] == [0, 0, 0, 1, 1, 2, 2, 2, 2, 3, 4]


def test_tables_in_text():
    assert table_in("intro\n| a | b |\n|---|---|\n| 1 | 2 |\nend") == (["a", "b"], [["1", "2"]])
    assert table_in("x,y\n1,2\n3,4") == (["x", "y"], [["1", "2"], ["3", "4"]])
    assert table_in("- Cash: 1,200\n- Debt: $30.5") == (["label", "value"], [["Cash", "1,200"], ["Debt", "30.5"]])
    assert table_in("nothing of the kind") is None


def test_text_functions(spark):
    assert plain("  Ελλάς  ÀÉ ") == "ελλασ ae"
    assert chunks_of("a" * 2500)[1].startswith("a" * 150 + "\n") and chunks_of("") == [] and chunks_of("x\n\ny") == ["x\ny"]
    assert first_object('<think>{"a":1}</think> so {bad} {"b": {"c": 2}} end') == {"b": {"c": 2}} and first_object("{") is None
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "")], "doc_id long, text string")
    assert [r["id"] for r in H.bm25_topk(docs, "red fox").collect()] == [1, 2]
    assert H.bm25_topk(docs, "").count() == 0 and H.build_chunks(docs, keep=["doc_id"]).count() == 2


def test_names_are_resolved_only_when_certain(spark):
    df = spark.createDataFrame([("Smith,Anna",), ("Jones,Bo",), ("Smith,Anton",)], "name string")
    index, domain = V.value_index({"t": df}), V.column_domain(df, "name")
    assert [r["norm"] for r in V.resolve_phrase(index, "jones").collect()] == ["jones,bo"]
    assert V.resolve_phrase(index, "smith").count() == 0 and V.resolve_phrase(index, "an").count() == 0
    assert [r["norm"] for r in V.resolve_fuzzy(domain, "Jnes Bo").collect()] == ["jones,bo"]
    assert V.resolve_fuzzy(domain, "zzzz").count() == 0


def test_watching_a_folder(spark, tmp_path):
    folder, manifest = tmp_path / "in", str(tmp_path / "manifest")
    folder.mkdir()
    (folder / "a.csv").write_text("x")
    got = []
    assert watch.poll(spark, str(folder), manifest, got.extend) == []
    assert watch.poll(spark, str(folder), manifest, got.extend) == []
    (folder / "a.csv").write_text("xy")
    (folder / "b.csv").write_text("z")

    def fails(_):
        raise RuntimeError("not now")

    with pytest.raises(RuntimeError):
        watch.poll(spark, str(folder), manifest, fails)
    assert len(watch.poll(spark, str(folder), manifest, got.extend)) == 2 and len(got) == 2
    assert watch.poll(spark, str(folder), manifest, got.extend) == []


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    folder, target = tmp_path / "s", str(tmp_path / "t")
    folder.mkdir()
    (folder / "one.json").write_text('{"v": 1}\n{"v": 2}\n')
    run = lambda k: watch.follow(spark, str(folder), "v int", target, str(tmp_path / f"c{k}"), once=True).awaitTermination()
    run(1)
    run(2)  # the same files once more, from an empty checkpoint
    (folder / "two.json").write_text('{"v": 5}\n')
    run(2)
    assert sorted(r["v"] for r in spark.read.parquet(target).collect()) == [1, 2, 5]


def test_event_windows(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_dt_interval(0, id) AS ts, 'a' AS event_type, 2.0D AS value, 7L AS user_id FROM range(3)")
    assert sorted(r["n"] for r in watch.windowed(rows, width="2 hours").collect()) == [1, 2] and watch.sessions(rows, gap="90 minutes").first()["n"] == 3


def test_files_audit_and_rules(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.csv", "~$b.xlsx", "c.doc"):
        (tmp_path / "d" / name).write_text("x")
    assert [p.rsplit("/", 1)[-1] for p in files.collect_paths([str(tmp_path), str(tmp_path / "d" / "*.csv")])] == ["a.csv"]
    assert files.decode_name(files.encode_name("a b.xlsx:S#2 é")) == "a b.xlsx:S#2 é"
    audit = files.Audit(str(tmp_path / "audit"))
    audit.log("q1", "rows", 0.1)
    audit.log("q2", "none", 0.1, ["t"])
    assert [e["question"] for e in audit.recent(5)] == ["q2", "q1"]
    rules = tmp_path / "rules.txt"
    rules.write_text("# no\nuse EUR\n")
    assert files.HouseRules(str(rules)).rules() == ["use EUR"] and files.HouseRules(str(tmp_path / "none")).rules() == []
    asked = tmp_path / "q.jsonl"
    asked.write_text('# c\n{"q": "a?", "expect": ["1"]}\n\n')
    assert [r["q"] for r in files.questions(spark, str(asked)).collect()] == ["a?"]
    assert files.record_score(str(tmp_path / "s.json"), "k", {"n": 1})["k"]["n"] == 1
    payload = files.report_payload(spark.createDataFrame([(float("inf"), None)], "a double, b string"))
    assert payload == {"columns": ["a", "b"], "rows": [[None, None]], "truncated": False} and json.dumps(payload)


def test_regions_over_many_ranges(spark, monkeypatch):
    """Ranges of ranges give what one walk over all rows gives."""
    from pyspark.sql import functions as F

    from gristmill.operators import profiling as R

    monkeypatch.setattr(R, "RANGE", 8)
    monkeypatch.setattr(R, "RANGES", 4)
    rng = random.Random(4)
    for start in (0, -70, 1000):
        rows = [(start + i, rng.random() < 0.45) for i in range(900) if rng.random() < 0.95]
        want, region, last = {}, 0, None
        for at, blank in rows:
            if not blank:
                region += last is not None and at - last > 2
                want[at] = region
                last = at
        got = R.regions(spark.createDataFrame(rows, "at long, blank boolean").repartition(4), "at", F.col("blank"))
        assert {r["at"]: r["region"] for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(_q" in plan and "windowspecdefinition(_p ASC" not in plan.replace("#", " ")
    assert R.regions(spark.createDataFrame([], "at long, blank boolean"), "at", F.col("blank")).collect() == []


def test_sheets_are_parsed_apart_and_others_not_opened(spark, tmp_path, monkeypatch):
    main = workbook.MAIN[1:-1]
    head = f'<workbook xmlns="{main}" xmlns:r="{workbook.LINK[1:].split("}")[0]}"><sheets>'
    names = ["One", "Two", "pivot", "Broken"]
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", head + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(4)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared</t></si></sst>')
        for i in range(2):
            cells = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>0</v></c><c r="B{r}"><v>{i * 100 + r}</v></c></row>' for r in range(1, 7))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
        z.writestr("xl/worksheets/s3.xml", "<not xml")
    got = workbook.read_grids(spark, str(path), only=["One", "Two"])
    assert sorted((r["sheet"], r["row"], r["cells"]) for r in got.collect()) == [(n, r, ["shared", str(i * 100 + r + 1)]) for i, n in enumerate(["One", "Two"]) for r in range(6)]
    assert workbook.read_grids(spark, str(path), 2, ["Two"]).count() == 2
    assert [n for n, *_ in workbook.sheets_of(path.read_bytes())] == ["One", "Two", "Broken"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in plan
