"""Sources: CSV, spreadsheets, plans, mind maps, commit logs and encrypted columns, each as DataFrames."""

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import hkdf_sha256

INTEGER, REAL, TEXT = "bigint", "double", "string"


# CSV ----------------------------------------------------------------------------------------------------------------
#: What an integer and a real cell look like.
_INTEGER, _REAL = r"[+-]?\d{1,18}", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def infer_type(values: list[str]) -> str:
    """The narrowest of integer, real and text that all non-empty values fit."""
    seen = [v for v in values if v not in (None, "")]
    if seen and all(re.fullmatch(_INTEGER, v) for v in seen):
        return INTEGER
    if seen and all(re.fullmatch(_REAL, v) for v in seen):
        return REAL
    return TEXT


def typed(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """``df``'s text columns ``columns`` as ``names``, each of the narrowest type that all its values fit: no value is lost.

    One pass over the rows finds the types. Blank cells are NULL in numbers.
    """
    if not columns:
        return df
    cell = {c: F.trim(F.col(f"`{c}`")) for c in columns}
    fits = lambda c, rx: F.coalesce(F.min(F.when(F.length(cell[c]) > 0, cell[c].rlike(f"^(?:{rx})$").cast("int"))), F.lit(0))
    told = df.agg(*[x.alias(f"{k}{i}") for i, c in enumerate(columns) for k, x in (("i", fits(c, _INTEGER)), ("r", fits(c, _REAL)))]).first()
    kinds = [INTEGER if told[f"i{i}"] else REAL if told[f"r{i}"] else TEXT for i in range(len(columns))]
    return df.select(*[(F.col(f"`{c}`") if k == TEXT else cell[c].try_cast(k)).alias(n) for n, c, k in zip(names, columns, kinds)])


def csv_schema(sample: str, sep: str = ",", header: bool = True, rows: int = 100) -> list[tuple[str, str]]:
    """(name, type) of the columns, from the first ``rows`` rows of ``sample``."""
    found = list(csv.reader(io.StringIO(sample), delimiter=sep))
    if not found:
        return []
    names = found[0] if header else [f"column{k + 1}" for k in range(len(found[0]))]
    body = found[header : header + rows] if header else found[:rows]
    return [(n.strip() or f"column{k + 1}", infer_type([r[k] if k < len(r) else "" for r in body])) for k, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, max_rows: int | None = None) -> DataFrame:
    """A CSV file or folder of files with one header, quoted line ends included.

    A column gets the narrowest type that all its values fit, found by a pass
    over the files; short rows are filled with NULL.
    """
    df = spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=True)
    names = [(c.strip() if header and not re.fullmatch(r"_c\d+", c) else "") or f"column{k + 1}" for k, c in enumerate(df.columns)]
    out = typed(df, names, df.columns)
    return out if max_rows is None else out.limit(max_rows)


def sheet_csv_url(url: str) -> str:
    """The CSV export address of a shared spreadsheet's address, with its sheet if it names one."""
    m = re.search(r"/spreadsheets/d/([A-Za-z0-9_-]+)", url)
    if not m:
        raise ValueError("not a spreadsheet address")
    gid = re.search(r"[#?&]gid=(\d+)", url)
    return f"https://docs.google.com/spreadsheets/d/{m[1]}/export?format=csv" + (f"&gid={gid[1]}" if gid else "")


# spreadsheets -------------------------------------------------------------------------------------------------------
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _address(ref: str) -> tuple[int, int]:
    m = re.match(r"\$?([A-Z]+)\$?(\d+)", ref)
    column = 0
    for ch in m[1]:
        column = column * 26 + ord(ch) - 64
    return int(m[2]), column


def workbook(data: bytes) -> dict[str, list[tuple]]:
    """The rows of an .xlsx file's parts: sheets, cells, styles, cell_references, merged_regions, defined_names."""
    out: dict[str, list[tuple]] = {k: [] for k in WORKBOOK}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        strings = [("".join(t.text or "" for t in si.iter(f"{_S}t"))) for si in (xml("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else [])]
        links = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        book = xml("xl/workbook.xml")
        for n, name in enumerate(book.iter(f"{_S}definedName")):
            out["defined_names"].append((name.get("name"), name.text))
        if (styles := xml("xl/styles.xml")) is not None and (formats := styles.find(f"{_S}cellXfs")) is not None:
            for n, x in enumerate(formats):
                out["styles"].append((n, int(x.get("numFmtId", 0)), int(x.get("fontId", 0)), int(x.get("fillId", 0))))
        for n, sheet in enumerate(book.iter(f"{_S}sheet")):
            title, target = sheet.get("name"), links[sheet.get(f"{_R}id")]
            out["sheets"].append((n, title, sheet.get("state", "visible")))
            page = xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            for c in page.iter(f"{_S}c"):
                row, column = _address(c.get("r"))
                value, formula, kind = c.find(f"{_S}v"), c.find(f"{_S}f"), c.get("t", "n")
                text = value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = strings[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                out["cells"].append((title, row, column, text, {"s": "text", "inlineStr": "text", "str": "text", "b": "boolean", "e": "error"}.get(kind, "number"), formula.text if formula is not None else None, int(c.get("s", 0))))
                if formula is not None and formula.text:
                    for ref in re.findall(r"(?:'[^']+'!|\w+!)?\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?", formula.text):
                        out["cell_references"].append((title, row, column, ref))
            for m in page.iter(f"{_S}mergeCell"):
                out["merged_regions"].append((title, m.get("ref")))
    return out


#: The tables of a workbook.
WORKBOOK = {
    "sheets": "sheet_id int, name string, state string",
    "cells": "sheet string, row int, col int, value string, kind string, formula string, style int",
    "styles": "style int, number_format int, font int, fill int",
    "cell_references": "sheet string, row int, col int, reference string",
    "merged_regions": "sheet string, region string",
    "defined_names": "name string, refers_to string",
}


def read_workbook(spark: SparkSession, path: str, table: str = "cells") -> DataFrame:
    """A table of every .xlsx file under ``path``, with the file's path. Each file is read whole by one task."""
    ddl = WORKBOOK[table]
    return _per_file(spark, path, lambda data: workbook(data)[table], ddl)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """One sheet (the first, unless named) as a table; types as for CSV. The header is read once, cells stay distributed."""
    cells = read_workbook(spark, path)
    name = sheet or read_workbook(spark, path, "sheets").orderBy("sheet_id").first()["name"]
    cells = cells.filter(F.col("sheet") == name)
    top = cells.filter("row = 1").orderBy("col").collect()
    names = [(r["col"], (r["value"] if header else None) or f"column{r['col']}") for r in top]
    body = cells.filter("row > 1") if header else cells
    rows = body.groupBy("row").pivot("col", [c for c, _ in names]).agg(F.first("value"))
    return typed(rows, [n for _, n in names], [str(c) for c, _ in names])


def _per_file(spark: SparkSession, path: str, parse, ddl: str) -> DataFrame:
    import pandas as pd

    names = [x.strip().split(" ")[0] for x in ddl.split(",")]

    def run(batches):
        for pdf in batches:
            for at, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(at, *r) for r in parse(bytes(data))], columns=["file", *names]).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {ddl}")


# plans and mind maps ------------------------------------------------------------------------------------------------
TASKS = "id bigint, name string, start_date string, end_date string, duration int, complete int, parent_id bigint"
DEPENDENCIES = "from_task bigint, to_task bigint, type string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def gantt(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(tasks, dependencies) of a GanttProject or MS-Project XML file."""
    root = ElementTree.fromstring(data)
    tasks, deps = [], []
    if _local(root.tag) == "Project":
        kinds = {"0": "FF", "1": "FS", "2": "SF", "3": "SS"}
        text = lambda e, name: next((c.text for c in e if _local(c.tag) == name), None)
        stack: list[tuple[int, int]] = []
        for t in (e for e in root.iter() if _local(e.tag) == "Task"):
            ident, level = int(text(t, "UID")), int(text(t, "OutlineLevel") or 1)
            while stack and stack[-1][0] >= level:
                stack.pop()
            hours = re.match(r"PT(\d+)H", text(t, "Duration") or "")
            tasks.append((ident, text(t, "Name"), (text(t, "Start") or "")[:10] or None, (text(t, "Finish") or "")[:10] or None, int(hours[1]) // 8 if hours else None, int(text(t, "PercentComplete") or 0), stack[-1][1] if stack else None))
            stack.append((level, ident))
            for link in (c for c in t if _local(c.tag) == "PredecessorLink"):
                deps.append((int(text(link, "PredecessorUID")), ident, kinds.get(text(link, "Type") or "1", "FS")))
        return tasks, deps
    kinds = {"1": "SS", "2": "FS", "3": "FF", "4": "SF"}

    def visit(e, parent):
        for c in e:
            if _local(c.tag) == "task":
                start, days = c.get("start"), int(c.get("duration") or 0)
                tasks.append((int(c.get("id")), c.get("name"), start, _plus(start, days), days, int(c.get("complete") or 0), parent))
                deps.extend((int(c.get("id")), int(d.get("id")), kinds.get(d.get("type") or "2", "FS")) for d in c if _local(d.tag) == "depend")
                visit(c, int(c.get("id")))
            else:
                visit(c, parent)

    visit(root, None)
    return tasks, deps


def _plus(day: str | None, days: int) -> str | None:
    from datetime import date, timedelta

    return None if not day else (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def read_gantt(spark: SparkSession, path: str, table: str = "tasks") -> DataFrame:
    which = 0 if table == "tasks" else 1
    return _per_file(spark, path, lambda data: gantt(data)[which], TASKS if which == 0 else DEPENDENCIES)


MIND_NODES = "id bigint, text string, depth int, note string"
MIND_EDGES = "parent_id bigint, child_id bigint, relation string"


def mind_map(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) of a FreeMind or OPML file; ids count nodes from 1 in document order."""
    root = ElementTree.fromstring(data)
    kind, text, note = ("outline", "text", "_note") if _local(root.tag) == "opml" else ("node", "TEXT", None)
    nodes, edges = [], []

    def visit(e, parent, depth):
        for c in e:
            if _local(c.tag) == kind:
                ident = len(nodes) + 1
                rich = next(("".join(x.itertext()).strip() for x in c if _local(x.tag) == "richcontent"), None)
                nodes.append((ident, c.get(text), depth, c.get(note) if note else rich))
                if parent:
                    edges.append((parent, ident, "child"))
                visit(c, ident, depth + 1)
            elif _local(c.tag) in ("body", "map"):
                visit(c, parent, depth)

    visit(root, None, 0)
    return nodes, edges


def read_mind_map(spark: SparkSession, path: str, table: str = "nodes") -> DataFrame:
    which = 0 if table == "nodes" else 1
    return _per_file(spark, path, lambda data: mind_map(data)[which], MIND_NODES if which == 0 else MIND_EDGES)


# commit logs --------------------------------------------------------------------------------------------------------
def parse_commits(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sha, author, email, date, subject) from lines ``sha|author|email|ISO date|subject``; other lines are left out."""
    parts = F.split(F.col(column), r"\|", 5)
    return lines.filter(F.col(column).rlike(r"^[0-9a-f]{7,40}\|")).select(*[F.get(parts, k).alias(n) for k, n in enumerate(("sha", "author", "email", "date", "subject"))])


def parse_file_changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sha, path, added, deleted) from lines ``sha<TAB>added<TAB>deleted<TAB>path``; ``-`` (binary) gives NULL."""
    parts = F.split(F.col(column), "\t")
    rows = lines.filter(F.size(parts) == 4)
    return rows.select(F.get(parts, 0).alias("sha"), F.get(parts, 3).alias("path"), F.get(parts, 1).try_cast("int").alias("added"), F.get(parts, 2).try_cast("int").alias("deleted"))


def authors(commits: DataFrame) -> DataFrame:
    """(email, name, commits, first, last)."""
    return commits.groupBy("email").agg(F.min("author").alias("name"), F.count("*").alias("commits"), F.min("date").alias("first"), F.max("date").alias("last"))


# encryption ---------------------------------------------------------------------------------------------------------
def encrypt(value: Column, key: bytes) -> Column:
    """AES-GCM with a random nonce, as binary."""
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: bytes) -> Column:
    """The text, or NULL where the key does not fit."""
    return F.try_aes_decrypt(value, F.lit(key), F.lit("GCM")).cast("string")


def decrypt_rows(df: DataFrame, value: str, tag: str, master: bytes, tags: list[str]) -> DataFrame:
    """Add ``plain``: each row decrypted by the key that HKDF derives for its tag, for the caller's ``tags`` only."""
    out = F.lit(None).cast("string")
    for t in tags:
        out = F.when(F.col(tag) == t, decrypt(F.col(value), hkdf_sha256(master, t.encode()))).otherwise(out)
    return df.withColumn("plain", out)
