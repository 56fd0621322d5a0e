"""Statement files (CSV and both OFX dialects) as a Spark data source: ``spark.read.format("statement").load(path)``.

Options: ``path`` (file, folder or glob), ``account_id``, ``institution``, ``on_error`` (``row``: faulty records come out
with their reason; ``drop``: left out), ``map.<field>`` (header that stands for a field). Every file is one partition,
read and parsed on an executor; :func:`read` gives the same rows from any file system; a CSV record's number is its ordinal below the header, blank records counted.
"""

from __future__ import annotations

import glob
import html
import os
import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.records import FIELDS, Fault, Record, header_names, normal_header, read_text

SCHEMA = "source_file string, record_no int, account_id string, institution string, date string, amount double, description string, ttype string, fitid string, category string, reason string, reason_at int"
_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m/%d/%y", "%m-%d-%Y", "%d-%b-%Y", "%b %d, %Y")
_NUMBER = re.compile(r"[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?")


def decode(raw: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252, else Latin-1."""
    for page in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(page)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def looks_like_ofx(name: str, text: str) -> bool:
    head = text[:512].upper().lstrip()
    return name.lower().endswith((".ofx", ".qfx")) or head.startswith(("OFXHEADER", "<?OFX")) or "<OFX>" in head


def written_date(text: str) -> str | None:
    for f in _FORMATS:
        try:
            return datetime.strptime(text.strip(), f).strftime("%Y-%m-%d")
        except ValueError:
            pass
    return None


def written_amount(text: str) -> float | None:
    t = text.strip()
    negative = t.startswith("(") and t.endswith(")")
    t = t[1:-1] if negative else t
    if t.upper().endswith(("CR", "DR")):
        negative |= t.upper().endswith("DR")
        t = t[:-2].strip()
    if t.endswith("-"):
        negative, t = True, t[:-1]
    t = re.sub(r"[,\s$£€]", "", t)
    if not _NUMBER.fullmatch(t):
        return None
    value = float(t)
    return None if value in (float("inf"), float("-inf")) else -abs(value) if negative else value


def csv_rows(text: str, mapped: dict[str, str]):
    """(record number, values, reason, place) of every record below the header that isn't blank."""
    places: dict[str, int] | None = None
    date_at = None
    anchored = lambda cells: date_at is None or date_at < len(cells) and written_date(cells[date_at]) is not None
    for got in read_text(text, anchored):
        if places is None:
            names = header_names(text[got.start : got.end])
            own = {normal_header(c): i for i, c in reversed([*enumerate(got.cells)])}
            places = {n: i for i, (n, _) in reversed([*enumerate(names)]) if n in FIELDS}
            missing = [f for f, h in mapped.items() if normal_header(h) not in own]
            places |= {f: own[normal_header(h)] for f, h in mapped.items() if f not in missing}
            date_at, width = places.get("date"), len(got.cells)
            lack = missing or [f for f in ("date", "description") if f not in places] or ([] if {"amount", "debit", "credit"} & places.keys() else ["amount"])
            if lack:
                yield 0, {}, "no_column_" + lack[0], 0
                return
            continue
        yield from _csv_row(got, places, width)


def _csv_row(got: Record, places: dict[str, int], width: int):
    number, cells = got.number - 1, got.cells
    if got.fault is None and not any(c.strip() for c in cells):
        return
    fault = got.fault or (Fault("cell_count", got.start) if len(cells) != width else None)
    if fault is not None:
        yield number, {}, fault.code, fault.at
        return
    cell = {f: cells[i] for f, i in places.items()}
    date = written_date(cell["date"])
    if "amount" in cell:
        amount = written_amount(cell["amount"])
    else:
        debit, credit = (written_amount(cell.get(f, "")) for f in ("debit", "credit"))
        amount = -abs(debit) if debit is not None else abs(credit) if credit is not None else None
    reason = "bad_date" if date is None else "bad_amount" if amount is None else None
    yield number, {"date": date, "amount": amount, "description": cell["description"].strip(), "category": cell.get("category")}, reason, got.start if reason else None


def ofx_rows(text: str):
    """(account, institution, rows) of an OFX text; 1.x leaves and 2.x elements read alike."""
    account = bank = None
    rows, now = [], None
    for tag, value in re.findall(r"<(/?[A-Za-z0-9.]+)>([^<]*)", text):
        name, value = tag.upper(), html.unescape(value).strip()
        if name == "STMTTRN":
            now = {}
        elif name == "/STMTTRN" and now is not None:
            rows.append(now)
            now = None
        elif now is not None and value and not name.startswith("/"):
            now.setdefault(name, value)
        elif name == "ACCTID" and account is None and value:
            account = value
        elif name == "ORG" and bank is None and value:
            bank = value
    out = []
    for number, row in enumerate(rows, 1):
        day, amount = row.get("DTPOSTED", "")[:8], written_amount(row.get("TRNAMT", ""))
        good = len(day) == 8 and day.isascii() and day.isdigit()
        reason = "bad_date" if not good else "bad_amount" if amount is None else None
        out.append((number, {"date": f"{day[:4]}-{day[4:6]}-{day[6:]}" if good else None, "amount": amount, "description": row.get("NAME", ""), "ttype": row.get("TRNTYPE"), "fitid": row.get("FITID")}, reason, None))
    return account, bank, out


def parsed(path: str, raw: bytes, options: dict):
    """The rows (``SCHEMA``) of one file's bytes."""
    text = decode(raw)
    stem = os.path.splitext(os.path.basename(path))[0]
    account, bank, mapped = None, None, {k[4:]: v for k, v in options.items() if k.startswith("map.")}
    if looks_like_ofx(path, text):
        account, bank, rows = ofx_rows(text)
    else:
        rows = csv_rows(text, mapped)
    account = options.get("account_id") or account or stem
    bank = options.get("institution") or bank or account
    for number, v, reason, at in rows:
        if reason is None or options.get("on_error", "row") == "row":
            yield (path, number, account, bank, v.get("date"), v.get("amount"), v.get("description"), v.get("ttype"), v.get("fitid"), v.get("category"), reason, at)


def read(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """The same rows from any file system that Spark reads: files are listed and read by the ``binaryFile`` source, and parsed in batches on the executors.

    ``options`` are those of the data source (``map.date="Booked"`` as ``**{"map.date": "Booked"}``). One bad file gives rows with a reason, never an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(csv|ofx|qfx)$"))
    types = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for batch in batches:
            for at, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = list(parsed(at, raw, options))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types.types, strict=True)], schema=types)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path = self.options["path"]
        if os.path.isdir(path):
            found = [os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.lower().endswith((".csv", ".ofx", ".qfx"))]
        else:
            found = glob.glob(path)
        return [_File(p) for p in sorted(found)]

    def read(self, partition):
        if partition is None:
            return
        with open(partition.path, "rb") as f:
            yield from parsed(partition.path, f.read(), self.options)


class StatementSource(DataSource):
    @classmethod
    def name(cls):
        return "statement"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(StatementSource)
