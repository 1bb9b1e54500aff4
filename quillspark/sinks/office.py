"""Word, slide and sheet files as zipped XML, written from rows; and files of a folder that all executors share."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.quality import is_rtl
from quillspark.functions.text import strip

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OPEN, _OFFICE, _PACKAGE = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats-officedocument", "application/vnd.openxmlformats-package"
_UNFIT = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
#: Rows of one sheet; the format allows no more, so more go on in a further sheet.
SHEET_ROWS = 1_048_576


def _text(value: object) -> str:
    return escape(_UNFIT.sub("", str(value)), {'"': "&quot;"})


def _zip(parts: dict[str, str]) -> bytes:
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(zipfile.ZipInfo(name), _HEAD + content)
    return box.getvalue()


def _types(**kinds: str) -> str:
    over = "".join(f'<Override PartName="/{name}" ContentType="{kind}"/>' for name, kind in kinds.items())
    return f'<Types xmlns="{_OPEN}/package/2006/content-types"><Default Extension="rels" ContentType="{_PACKAGE}.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{over}</Types>'


def _links(links: Sequence[tuple[str, str, str]]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="{_OPEN}/officeDocument/2006/relationships/{kind}" Target="{target}"/>' for i, kind, target in links)
    return f'<Relationships xmlns="{_OPEN}/package/2006/relationships">{rows}</Relationships>'


# ---- Word ------------------------------------------------------------------------------------------------------------


def blocks(markdown: Column) -> Column:
    """K3: array of (kind, text, is_rtl): headings (``h1`` to ``h6``), items, table cells and paragraphs in order.

    Blank lines part blocks; a heading, item or table row is a line of its own, and a table's rule line is left out. The
    lines of a paragraph join by spaces.
    """

    def marked(x: Column) -> Column:
        own = lambda kind, text: F.concat(F.lit("\x01"), kind, F.lit("\x02"), text, F.lit("\x01"))
        level = F.length(F.regexp_extract(x, "^(#{1,6})[ \t]", 1)).cast("string")
        cells = F.when(x.rlike(r"^[|:\- \t]+$"), F.lit("\x01")).otherwise(F.array_join(F.transform(F.split(F.substr(x, F.lit(2), F.length(x) - 2), r"\|"), lambda c: own(F.lit("cell"), strip(c))), ""))
        return (
            F.when(x == "", F.lit("\x01")).when(level != "0", own(F.concat(F.lit("h"), level), strip(F.regexp_replace(x, "^#+", ""))))
            .when(x.rlike(r"^\|.*\|$"), cells).when(x.rlike(r"^(?:[-*+]|\d{1,9}[.)])[ \t]"), own(F.lit("item"), x)).otherwise(F.concat(F.lit("\x04"), x))
        )

    lines = F.transform(F.split(F.regexp_replace(F.coalesce(markdown, F.lit("")), "[\x01\x02\x04]", ""), "\n"), lambda x: marked(strip(x)))
    pieces = F.filter(F.split(F.array_join(lines, ""), "\x01+"), lambda p: p != "")
    paragraph = lambda p: F.startswith(p, F.lit("\x04"))
    text = lambda p: F.when(paragraph(p), F.replace(F.substr(p, F.lit(2)), F.lit("\x04"), F.lit(" "))).otherwise(F.regexp_extract(p, "(?s)\x02(.*)", 1))
    return F.transform(pieces, lambda p: F.struct(F.when(paragraph(p), F.lit("p")).otherwise(F.regexp_extract(p, "^([^\x02]*)", 1)).alias("kind"), text(p).alias("text"), is_rtl(text(p)).alias("is_rtl")))


def word_file(paragraphs: Iterable[tuple[str, str, bool]]) -> bytes:
    """K3: a Word file of (kind, text, is_rtl); cells in a row of kinds ``cell`` make a table of one column each."""
    out = []
    for kind, text, rtl in paragraphs:
        style = f'<w:pStyle w:val="Heading{kind[1]}"/>' if kind[:1] == "h" else ""
        side = '<w:bidi w:val="1"/><w:jc w:val="right"/>' if rtl else ""
        run = f'<w:r>{"<w:rPr><w:rtl w:val=%s1%s/></w:rPr>" % (chr(34), chr(34)) if rtl else ""}<w:t xml:space="preserve">{_text(text)}</w:t></w:r>'
        paragraph = f"<w:p><w:pPr>{style}{side}</w:pPr>{run}</w:p>"
        out.append(f"<w:tbl><w:tr><w:tc>{paragraph}</w:tc></w:tr></w:tbl>" if kind == "cell" else paragraph)
    body = f'<w:document xmlns:w="{_OPEN}/wordprocessingml/2006/main"><w:body>{"".join(out)}<w:p/></w:body></w:document>'
    main = f"{_OFFICE}.wordprocessingml.document.main+xml"
    return _zip({"[Content_Types].xml": _types(**{"word/document.xml": main}), "_rels/.rels": _links([("r1", "officeDocument", "word/document.xml")]), "word/document.xml": body})


# ---- slides ----------------------------------------------------------------------------------------------------------


def slide_file(rows: Iterable[tuple[int, int, str, bool]]) -> bytes:
    """K4: a slide file of (slide_no, line_no, text, is_rtl); line 0 of a slide is its title."""
    slides: dict[int, list[tuple[int, str, bool]]] = {}
    for slide, line, text, rtl in rows:
        slides.setdefault(slide, []).append((line, text, rtl))
    space = f'xmlns:a="{_OPEN}/drawingml/2006/main" xmlns:r="{_OPEN}/officeDocument/2006/relationships" xmlns:p="{_OPEN}/presentationml/2006/main"'
    tree = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'

    def shape(number: int, kind: str, lines: list[tuple[int, str, bool]]) -> str:
        side = lambda rtl: '<a:pPr algn="r" rtl="1"/>' if rtl else '<a:pPr algn="l"/>'
        text = "".join(f"<a:p>{side(rtl)}<a:r><a:t>{_text(x)}</a:t></a:r></a:p>" for _, x, rtl in lines) or "<a:p/>"
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{text}</p:txBody></p:sp>'

    order = sorted(slides)
    kind = f"{_OFFICE}.presentationml."
    parts = {f"ppt/slides/slide{k}.xml": f"{kind}slide+xml" for k in range(1, len(order) + 1)}
    parts |= {"ppt/presentation.xml": f"{kind}presentation.main+xml", "ppt/slideMasters/slideMaster1.xml": f"{kind}slideMaster+xml", "ppt/slideLayouts/slideLayout1.xml": f"{kind}slideLayout+xml", "ppt/theme/theme1.xml": f"{_OFFICE}.theme+xml"}
    colours = "".join(f'<a:{c}><a:srgbClr val="{v}"/></a:{c}>' for c, v in zip(("dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"), ("000000", "FFFFFF") * 6))
    font = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>'
    theme = f'<a:theme xmlns:a="{_OPEN}/drawingml/2006/main" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    names = "".join(f'<p:sldId id="{255 + k}" r:id="s{k}"/>' for k in range(1, len(order) + 1))
    pairs = " ".join(f'{a}="{b}"' for a, b in zip(("bg1", "tx1", "bg2", "tx2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"), ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")))
    files = {
        "[Content_Types].xml": _types(**parts),
        "_rels/.rels": _links([("r1", "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f'<p:presentation {space}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="m1"/></p:sldMasterIdLst><p:sldIdLst>{names}</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _links([("m1", "slideMaster", "slideMasters/slideMaster1.xml"), *((f"s{k}", "slide", f"slides/slide{k}.xml") for k in range(1, len(order) + 1))]),
        "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {space}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld><p:clrMap {pairs}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="l1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _links([("l1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("t1", "theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": f'<p:sldLayout {space} type="obj"><p:cSld name="Title and content"><p:spTree>{tree}</p:spTree></p:cSld></p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _links([("m1", "slideMaster", "../slideMasters/slideMaster1.xml")]),
        "ppt/theme/theme1.xml": theme,
    }
    for k, number in enumerate(order, 1):
        lines = sorted(slides[number])
        files[f"ppt/slides/slide{k}.xml"] = f"<p:sld {space}><p:cSld><p:spTree>{tree}{shape(2, 'title', lines[:1])}{shape(3, 'body', lines[1:])}</p:spTree></p:cSld></p:sld>"
        files[f"ppt/slides/_rels/slide{k}.xml.rels"] = _links([("l1", "slideLayout", "../slideLayouts/slideLayout1.xml")])
    return _zip(files)


# ---- sheets ----------------------------------------------------------------------------------------------------------


def _cell(value: object, bold: bool) -> str:
    style = ' s="1"' if bold else ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c{style}><v>{value!r}</v></c>"
    return f'<c{style} t="inlineStr"><is><t xml:space="preserve">{_text("" if value is None else value)}</t></is></c>'


def write_workbook(path: str, sheets: Sequence[tuple[str, Sequence[str], Iterable[Sequence[object]]]]) -> None:
    """K5: a sheet file of (name, headers, rows); headers are bold. Rows are streamed, so they need no memory; those beyond
    ``SHEET_ROWS`` go on in a further sheet under the same headers."""
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as archive:
        for name, headers, rows in sheets:
            rows, part, more = iter(rows), 0, True
            pending = next(rows, None)
            while more:
                part += 1
                names.append(name if part == 1 else f"{name} {part}")
                with archive.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                    out.write((_HEAD + f'<worksheet xmlns="{_OPEN}/spreadsheetml/2006/main"><sheetData><row>{"".join(_cell(h, True) for h in headers)}</row>').encode())
                    n = 1
                    while pending is not None and n < SHEET_ROWS:
                        out.write(f"<row>{''.join(_cell(v, False) for v in pending)}</row>".encode())
                        pending, n = next(rows, None), n + 1
                    out.write(b"</sheetData></worksheet>")
                more = pending is not None
        listed = "".join(f'<sheet name="{_text(name)}" sheetId="{k}" r:id="s{k}"/>' for k, name in enumerate(names, 1))
        kind = f"{_OFFICE}.spreadsheetml."
        parts = {"xl/workbook.xml": f"{kind}sheet.main+xml", "xl/styles.xml": f"{kind}styles+xml"} | {f"xl/worksheets/sheet{k}.xml": f"{kind}worksheet+xml" for k in range(1, len(names) + 1)}
        for file, content in {
            "[Content_Types].xml": _types(**parts),
            "_rels/.rels": _links([("r1", "officeDocument", "xl/workbook.xml")]),
            "xl/workbook.xml": f'<workbook xmlns="{_OPEN}/spreadsheetml/2006/main" xmlns:r="{_OPEN}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _links([("st", "styles", "styles.xml"), *((f"s{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1))]),
            "xl/styles.xml": f'<styleSheet xmlns="{_OPEN}/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        }.items():
            archive.writestr(file, _HEAD + content)


# The columns of a ledger's sheets.
LEDGER_HEADERS = ("File", "Date", "Party", "Invoice #", "Total", "VAT", "Currency")


def write_ledger_workbook(rows: DataFrame, path: str) -> None:
    """K5: the rows of :func:`quillspark.operators.ledger.ledger_rows` as a sheet file. Sales and Expenses are always there,
    Unrecognized (file names alone) only where it has rows. Rows come one by one; the folder of ``path`` is the driver's."""
    cells = ("filename", "date", "party_name", "invoice_number", "amount", "vat", "currency")
    of = lambda sheet, columns: map(tuple, rows.where(F.col("sheet") == sheet).orderBy("invoice_id", "filename").select(*columns).toLocalIterator())
    sheets = [("Sales", LEDGER_HEADERS, of("Sales", cells)), ("Expenses", LEDGER_HEADERS, of("Expenses", cells))]
    if not rows.where("sheet = 'Unrecognized'").isEmpty():
        sheets.append(("Unrecognized", ("Filename",), of("Unrecognized", ("filename",))))
    write_workbook(path, sheets)


# ---- files -----------------------------------------------------------------------------------------------------------


def files_of(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], writer: Callable[[Iterable[tuple]], bytes]) -> DataFrame:
    """(key, content): a file per key by the injected ``writer`` of its rows in order. A document's rows are what one task holds."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(list(order))
        return pd.DataFrame({"key": [ordered["__key"].iloc[0]], "content": [writer(ordered[list(columns)].itertuples(index=False, name=None))]})

    picked = rows.select(F.col(key).cast("string").alias("__key"), *dict.fromkeys([*order, *columns]))
    return picked.groupBy("__key").applyInPandas(build, "key string, content binary")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """K7: each row's content as the file ``name`` of a folder that all executors share; a file is replaced whole, so a task
    that runs again does no harm. Null contents write nothing."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            if row[1] is not None:
                target = os.path.join(folder, os.path.basename(row[0]))
                with open(f"{target}.{os.getpid()}.part", "wb") as out:
                    out.write(row[1])
                os.replace(f"{target}.{os.getpid()}.part", target)

    files.select(F.col(name), F.col(content)).where(F.col(name).isNotNull()).foreachPartition(write)
