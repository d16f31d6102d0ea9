"""Spreadsheets as typed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money, urls
from ..functions.text import clean, label

DAB_SKU, KEYWORDS = "(?i)^DAB-[A-Z0-9-]+$", "(?i)^(price|multiplier|collection|sku)$"
URL_HEADER = "(?i)(^|[^a-z])(url|link)($|[^a-z])"
#: Headers of each role, any of which will do; the first column that fits wins.
ROLES = {
    "url": (URL_HEADER, r"(?i)product[\s_-]*(url|link)", r"(?i)supplier[\s_-]*(url|link)"),
    "price": ("(?i)^price$", r"(?i)source[\s_-]*price"),
    "multiplier": ("(?i)^multiplier$", r"(?i)^price[\s_-]*multiplier$", r"(?i)^row[\s_-]*multiplier$", r"(?i)^markup[\s_-]*multiplier$"),
    "collection": ("(?i)^collection$", r"(?i)shopify[\s_-]*collection"),
    "sku": ("(?i)^sku$", r"(?i)product[\s_-]*sku"),
}


_MATRIX = T.StructType().add("row_index", T.IntegerType()).add("cells", T.ArrayType(T.StringType()))


def csv_matrix(text: str) -> Iterator[tuple[int, list[str]]]:
    """(row index, cells) of a CSV text: ragged and blank rows stay, but for a blank one at the end."""
    row, cell, quoted, at, index = [], [], False, 0, 0
    while at < len(text):
        ch = text[at]
        at += 1
        if ch == '"':
            if quoted and text[at : at + 1] == '"':
                cell.append('"')
                at += 1
            else:
                quoted = not quoted
        elif ch in ",\n\r" and not quoted:
            row.append("".join(cell))
            cell = []
            if ch != ",":
                if ch == "\r" and text[at : at + 1] == "\n":
                    at += 1
                yield index, row
                row, index = [], index + 1
        else:
            cell.append(ch)
    row.append("".join(cell))
    if any(c.strip() for c in row):
        yield index, row


@F.udtf(returnType=_MATRIX)
class ParseCsvRows:
    """SELECT * FROM parse_csv_rows(text): rows of a CSV text, in order."""

    def eval(self, text: str):
        yield from csv_matrix(text or "")


def register(spark: SparkSession) -> None:
    """SQL names of the table functions."""
    spark.udtf.register("parse_csv_rows", ParseCsvRows)


def read_matrix(files: DataFrame, text: str = "text") -> DataFrame:
    """files (any columns and one with a whole CSV text) with row_index and cells of each row."""
    return files.lateralJoin(ParseCsvRows(F.col(text).outer())).drop(text)


def _trimmed(cells: Column) -> Column:
    return F.transform(cells, clean)


def headerless(matrix: DataFrame) -> DataFrame:
    """Rows by what their cells look like: URL first, then multiplier right of it, else left, SKU and collection."""
    cells = _trimmed(F.col("cells"))
    each = matrix.withColumn("_c", cells).withColumn("_url", F.array_position(F.transform("_c", urls.is_http), True))
    each = each.where(F.col("_url") > 0)
    number = F.transform("_c", lambda c: money.sheet_price(c))
    place = lambda keep: F.try_element_at(F.filter(F.transform(number, lambda n, i: F.when(n.isNotNull() & keep(i + 1), i + 1)), lambda i: i.isNotNull()), F.lit(1))
    at = F.coalesce(place(lambda i: i > F.col("_url")), place(lambda i: i < F.col("_url")))
    each = each.withColumn("_n", number).withColumn("_at", at)
    first = lambda keep: F.coalesce(F.try_element_at(F.filter("_c", keep), F.lit(1)), F.lit(""))

    def collects(c: Column, i: Column) -> Column:
        plain = ~urls.is_http(c) & money.sheet_price(c).isNull() & ~c.rlike(DAB_SKU) & ~c.rlike(KEYWORDS)
        return (c != "") & (i + 1 != F.col("_url")) & (i + 1 != F.coalesce("_at", F.lit(0))) & plain

    keep = [c for c in matrix.columns if c not in ("row_index", "cells")]
    return each.select(
        *keep,
        (F.col("row_index") + 1).alias("row_number"),
        F.get("_c", F.col("_url").cast("int") - 1).alias("url"),
        F.lit(None).cast("double").alias("price"),
        F.get("_n", F.col("_at") - 1).alias("price_multiplier"),
        first(collects).alias("collection"),
        first(lambda c: c.rlike(DAB_SKU)).alias("sku"),
    )


def roles_of(matrix: DataFrame, sheet: list[str]) -> DataFrame:
    """Each sheet's column of each role (0-based, null for none) and whether its first row is a header."""
    head = matrix.where("row_index = 0").select(*sheet, F.transform("cells", label).alias("h"), F.exists("cells", urls.is_http).alias("data"))

    def column(patterns: tuple[str, ...]) -> Column:
        fits = lambda h: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp(h, p))
        return F.nullif(F.array_position(F.transform("h", fits), True), F.lit(0)).cast("int") - 1

    known = {r: column(p) for r, p in ROLES.items()}
    known["url"] = F.coalesce(known["url"], F.lit(0))
    is_header = ~F.col("data") & F.exists("h", lambda h: h.rlike(URL_HEADER))
    return head.select(*sheet, is_header.alias("is_header"), *[c.alias(f"{r}_at") for r, c in known.items()])


def rows_of(matrix: DataFrame, sheet: list[str]) -> DataFrame:
    """Typed rows of sheets with or without a header. Row numbers count from 1, the header included; rows without a URL go."""
    known = F.broadcast(roles_of(matrix, sheet)) if not sheet else roles_of(matrix, sheet)
    both = matrix.join(known, sheet) if sheet else matrix.crossJoin(known)
    cell = lambda r: F.coalesce(F.trim(F.get("cells", F.col(f"{r}_at"))), F.lit(""))
    headed = both.where("is_header and row_index > 0").select(
        *sheet,
        (F.col("row_index") + 1).alias("row_number"),
        cell("url").alias("url"),
        money.sheet_price(cell("price")).alias("price"),
        money.sheet_price(cell("multiplier")).alias("price_multiplier"),
        cell("collection").alias("collection"),
        cell("sku").alias("sku"),
    )
    plain = both.where("not is_header").select(*sheet, "row_index", "cells")
    return headed.where("url <> ''").unionByName(headerless(plain))


def strict(matrix: DataFrame) -> DataFrame:
    """Rows of url, multiplier within 1 to 100, collection, SKU by position; others go."""
    cell = lambda i: F.coalesce(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    m = money.sheet_price(cell(1))
    each = matrix.select("*", cell(0).alias("url"), m.alias("price_multiplier"), cell(2).alias("collection"), cell(3).alias("sku"))
    return each.where(urls.is_http(F.col("url")) & F.col("price_multiplier").between(1, 100)).withColumn("row_number", F.col("row_index") + 1).drop("cells", "row_index")


def split_invalid(rows: DataFrame) -> DataFrame:
    """Rows with a reason where a URL has no multiplier; null where the row is fine."""
    return rows.withColumn("reason", F.when(F.col("price_multiplier").isNull(), "no multiplier in the row"))


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets one after the other with their name and priority (their place)."""
    out = None
    for i, (name, rows) in enumerate(sheets.items()):
        one = rows.withColumns({"sheet_name": F.lit(name), "priority": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def xlsx_rows(data: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row index, cells) of a workbook's first sheet, from the zipped XML."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        for i, row in enumerate(ElementTree.fromstring(z.read(first)).iter(f"{{{ns['m']}}}row")):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (max(at, 1) - 1 - len(cells))
                v = c.find("m:v", ns)
                inline = c.find("m:is", ns)
                value = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "" if v is not None else "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            yield int(row.get("r", i + 1)) - 1, cells


@F.udtf(returnType=_MATRIX)
class ParseXlsxRows:
    """Rows of an XLSX file's bytes, first sheet only."""

    def eval(self, data: bytes):
        yield from xlsx_rows(bytes(data))


@F.pandas_udf(T.BinaryType())
def workbook(rows: pd.Series) -> pd.Series:
    """The bytes of an XLSX file whose one sheet has these rows (arrays of arrays of texts)."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    main, kind = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def made(sheet) -> bytes:
        cells = lambda n, row: "".join(f'<c r="{letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(row) if c)
        data = "".join(f'<row r="{n}">{cells(n, row)}</row>' for n, row in enumerate(sheet, 1))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{kind}content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{kind}relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kind}relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')
        return out.getvalue()

    return pd.Series([made(s) for s in rows], dtype=object)


def uploaded(files: DataFrame, key: str) -> DataFrame:
    """key, row_number, url, cells of uploaded workbooks (key, content): first sheet, first row as header.

    Rows are numbered as the sheet shows them, cells that are missing are empty, blank rows go. The URL is in the column
    whose name says so, else in the first that holds one.
    """
    matrix = files.lateralJoin(ParseXlsxRows(F.col("content").outer())).select(key, "row_index", "cells")
    head = matrix.where("row_index = 0").select(key, F.transform("cells", label).alias("names"))
    both = matrix.where("row_index > 0").join(head, key)
    width = F.greatest(F.size("names"), F.size("cells"))
    full = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    named = F.array_position(F.transform("names", lambda n: n.rlike(URL_HEADER)), True).cast("int") - 1
    found = F.array_position(F.transform("cells", lambda c: F.coalesce(urls.is_http(c), F.lit(False))), True).cast("int") - 1
    at = F.when(named >= 0, named).when(found >= 0, found)
    rows = both.where(F.exists("cells", lambda c: F.trim(c) != "")).select(key, (F.col("row_index") + 1).alias("row_number"), F.coalesce(F.get("cells", at), F.lit("")).alias("url"), full.alias("cells"))
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, row_index, cells of all workbooks under a path that Spark can read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.lateralJoin(ParseXlsxRows(F.col("content").outer())).drop("content")
