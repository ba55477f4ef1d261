"""The same traces from CSV and XLSX files of one table."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from fluora.plans import modules
from fluora.sources import sheets, traces

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(n):
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(path, rows, shared=True, references=True):
    """A plain writer: numbers as they are, texts shared or inline, None as no cell."""
    texts, body = [], ""
    for i, row in enumerate(rows):
        cells = ""
        for j, v in enumerate(row):
            at = f' r="{letters(j)}{i + 1}"' if references else ""
            if v is None:
                continue
            if isinstance(v, str) and shared:
                if v not in texts:
                    texts.append(v)
                cells += f'<c{at} t="s"><v>{texts.index(v)}</v></c>'
            elif isinstance(v, str):
                cells += f'<c{at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
            else:
                cells += f"<c{at}><v>{v!r}</v></c>"
        body += f'<row r="{i + 1}">{cells}</row>' if references else f"<row>{cells}</row>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets><sheet name="x" sheetId="7" r:id="rId9"/><sheet name="y" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="worksheets/sheet5.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet5.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        if shared:
            items = "".join(f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r><rPh><t>hint</t></rPh></si>" for t in texts)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')


def table():
    head = ["frame", "Mean1", "Mean2", "note & <more>", *[f"Max{i}" for i in range(30)], "Mean1"]
    return [head, *([i, 1.5 * i, -0.25 if i % 3 else None, f"text {i % 4}, \"q\"", *[i + j / 8 for j in range(30)], "NaN"] for i in range(40))]


@pytest.mark.parametrize("shared,references", [(True, True), (False, False)])
def test_xlsx_is_like_csv(spark, tmp_path, monkeypatch, shared, references):
    monkeypatch.setattr(sheets, "BATCH", 100)
    rows = table() if references else [[0 if v is None else v for v in r] for r in table()]
    workbook(tmp_path / "t.xlsx", rows, shared, references)
    text = "\n".join(",".join("" if v is None else '"' + v.replace('"', '""') + '"' if isinstance(v, str) else repr(v) for v in r) for r in rows)
    (tmp_path / "t.csv").write_text(text)
    order = ["frame", "col_ord", "name", "y"]
    got, want = (sorted(tuple(r) for r in df.where(df.y.isNotNull()).select(*order).collect()) for df in (sheets.wide_xlsx(spark, str(tmp_path / "t.xlsx")), traces.wide_csv(spark, str(tmp_path / "t.csv"))))
    assert got == want and len(got) > 1200
    cells = {(r.frame, r.col_ord): r.cell for r in sheets.wide_xlsx(spark, str(tmp_path / "t.xlsx")).collect()}
    assert len(cells) == 40 * 35 and cells[3, 3] == 'text 3, "q"' and cells[0, 2] == ("" if references else "0")
    assert sheets.column_number("A1") == 0 and sheets.column_number("XFD9") == 16383


def test_command_line_reads_xlsx(spark, tmp_path):
    rows = [["frame", "Mean1", "Mean2", "note"]] + [[i, 1.0 + (i % 3) * 0.01 + (5 if 10 <= i < 15 else 0), 1.0, f"n{i}"] for i in range(40)]
    workbook(tmp_path / "t.xlsx", rows)
    modules.main(["select_active", "--input", str(tmp_path / "t.xlsx"), "--output", str(tmp_path / "out"), "--params", '{"metrics": "Mean", "k": 2.5}'])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines[0] == "frame,Mean1,note" and lines[11].startswith("10,6.01,n10")


def test_spike_file_of_the_command_line(spark, tmp_path):
    rows = [["time_s", "Mean1", "Mean2"]] + [[100 + i / 2, *(1.0 + (i % 3) * 0.01 + (4 if at <= i < at + 4 else 0) for at in (10, 20))] for i in range(40)]
    (tmp_path / "t.csv").write_text("\n".join(",".join(map(str, r)) for r in rows))
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for i in range(2):
            z.writestr(f"{i}.roi", traces.encode_roi("rect", left=10 * i, top=4, width=2, height=6))
    for n, params in enumerate(('{"metrics": "Mean"}', '{"metrics": "Mean", "roi_zip": "' + str(tmp_path / "r.zip") + '"}')):
        modules.main(["spike_analysis", "--input", str(tmp_path / "t.csv"), "--output", str(tmp_path / f"out{n}"), "--params", params])
        lines = "".join(p.read_text() for p in sorted((tmp_path / f"out{n}").glob("part-*"))).splitlines()
        assert lines[0] == "signal,spike_index,start_s,end_s,width_s,spike_time_s,max_height,auc,x,y,truncated"
        got = {x.split(",")[0]: x.split(",") for x in lines[1:]}
        assert set(got) == {"Mean1", "Mean2"} and [got[k][5] for k in ("Mean1", "Mean2")] == ["105.500000", "110.000000"]
        assert [got[k][8:10] for k in ("Mean1", "Mean2")] == ([["", ""]] * 2 if n == 0 else [["1.000000", "7.000000"], ["11.000000", "7.000000"]])
