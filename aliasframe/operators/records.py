"""Records of statement files: an error-recovering recursive-descent grammar.

    file    := record (EOL record)*
    record  := cell (',' cell)*
    cell    := quoted | bare
    quoted  := '"' (any but '"' | '""')* '"'        followed by ',' or the record's end
    bare    := (any but ',' or EOL)*

Reading a whole text, a fault inside a record (an unclosed quote, or text after a closing one) makes
the parser look for the next *record-start anchor*: a line start from which a record with the file's
number of cells and a readable date parses cleanly. The skipped text comes out as one faulty record
with the place of the fault; what stands behind the anchor is read as usual.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount, parse_money
from ..functions.instants import bind, with_instant

#: Header labels, in normal form, that stand for a field.
FIELD_LABELS: dict[str, tuple[str, ...]] = {
    "date": ("date", "posted date", "posting date", "post date", "date posted", "transaction date", "trans date", "effective date", "value date", "booked on", "booking date"),
    "description": ("description", "desc", "memo", "payee", "name", "details", "detail", "narrative", "merchant", "transaction", "reference", "particulars", "statement text", "booking text"),
    "amount": ("amount", "amt", "transaction amount", "value", "money", "total", "sum booked"),
    "debit": ("debit", "debit amount", "withdrawal", "withdrawals", "money out", "paid out", "outflow", "charge"),
    "credit": ("credit", "credit amount", "deposit", "deposits", "money in", "paid in", "inflow"),
    "balance": ("balance", "running bal", "running balance", "ledger balance", "balance after", "saldo", "available balance"),
    "category": ("category", "cat", "type", "transaction type", "spend group", "bucket"),
}
FIELDS = tuple(FIELD_LABELS)
_FIELD_OF = {label: name for name, labels in FIELD_LABELS.items() for label in labels}


@dataclass
class Fault:
    code: str
    at: int


@dataclass
class Record:
    cells: list[str]
    start: int
    end: int
    fault: Fault | None = None
    number: int = 0


@dataclass
class Grammar:
    """Recursive descent over one text; ``pos`` is the place of the next character."""

    text: str
    pos: int = 0
    multiline: bool = True
    fault: Fault | None = field(default=None)

    def _at_record_end(self) -> bool:
        return self.pos >= len(self.text) or (self.multiline and self.text[self.pos] in "\r\n")

    def record(self) -> Record:
        start, self.fault = self.pos, None
        cells = [self.cell()]
        while self.fault is None and self.pos < len(self.text) and self.text[self.pos] == ",":
            self.pos += 1
            cells.append(self.cell())
        return Record(cells, start, self.pos, self.fault)

    def cell(self) -> str:
        return self.quoted() if self.text.startswith('"', self.pos) else self.bare()

    def bare(self) -> str:
        end, text = self.pos, self.text
        stops = ",\r\n" if self.multiline else ","
        while end < len(text) and text[end] not in stops:
            end += 1
        out, self.pos = text[self.pos : end], end
        return out

    def quoted(self) -> str:
        opened, parts = self.pos, []
        self.pos += 1
        while True:
            close = self.text.find('"', self.pos)
            if close < 0:
                self.fault = Fault("quote_not_closed", opened)
                parts.append(self.text[self.pos :])
                self.pos = len(self.text)
                return "".join(parts)
            parts.append(self.text[self.pos : close])
            self.pos = close + 1
            if not self.text.startswith('"', self.pos):
                break
            parts.append('"')
            self.pos += 1
        if not self._at_record_end() and self.text[self.pos] != ",":
            self.fault = Fault("text_after_quote", self.pos)
        return "".join(parts)

    def end_of_line(self) -> None:
        if self.text.startswith("\r\n", self.pos):
            self.pos += 2
        elif self.pos < len(self.text):
            self.pos += 1


def read_record(raw: str) -> Record:
    """One whole record, which may itself hold line breaks."""
    if '"' not in raw:
        return Record(raw.split(","), 0, len(raw))
    return Grammar(raw, multiline=False).record()


def read_text(text: str, anchored: Callable[[list[str]], bool] | None = None) -> Iterator[Record]:
    """All records of a file's text in order, the faulty ones included; the first is the header.

    ``anchored`` says whether cells could be a record's; by default any record with the header's
    number of cells is an anchor. Empty text gives nothing.
    """
    g, width, number = Grammar(text.removeprefix("﻿")), None, 0
    while g.pos < len(g.text):
        start, number = g.pos, number + 1
        got = g.record()
        got.number = number
        if width is None:
            width = len(got.cells)
        if got.fault is not None:
            place = _next_anchor(g.text, start, width, anchored)
            got.end, g.pos = place, place
            yield got
            continue
        g.end_of_line()
        yield got


_LINE_END = re.compile(r"\r\n|\r|\n")


def _next_anchor(text: str, start: int, width: int, anchored: Callable[[list[str]], bool] | None) -> int:
    for line in _LINE_END.finditer(text, start):
        at = line.end()
        if at >= len(text):
            break
        g = Grammar(text, at)
        got = g.record()
        if got.fault is None and len(got.cells) == width and (anchored is None or anchored(got.cells)):
            return at
    return len(text)


def normal_header(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", label.lower()).strip()


def header_names(raw: str) -> list[tuple[str, str]]:
    """(field or normal form, normal form) of every header cell; a field goes to its first cell only."""
    out, taken = [], set()
    for cell in read_record(raw.removeprefix("﻿")).cells:
        normal = normal_header(cell)
        name = _FIELD_OF.get(normal, normal)
        if name in taken:
            name = normal
        taken.add(name)
        out.append((name, normal))
    return out


_SOURCE_FILE = ("checking", "credit"), ("csv", "ofx", "qfx")


def source_file_fault(value: str) -> str | None:
    """Descent over ``folder '/' type '_' year '-' month '.' ext``; the code of the first fault or None."""
    folder, slash, rest = value.partition("/")
    if not slash or not folder.strip():
        return "no_folder"
    kind, mark, rest = rest.partition("_")
    if not mark or kind not in _SOURCE_FILE[0]:
        return "unknown_type"
    month, dot, ext = rest.partition(".")
    if not (len(month) == 7 and month[4] == "-" and (month[:4] + month[5:]).isascii() and (month[:4] + month[5:]).isdigit() and 1 <= int(month[5:]) <= 12 and month[:4] != "0000"):
        return "no_month"
    return None if dot and ext in _SOURCE_FILE[1] else "unknown_extension"


_CELLS = ("line_id", "file_id", "line_no", "blank", "fault", "fault_at", "n_cells", "n_header", "cells", *FIELDS)
PARSED = "line_id bigint, file_id bigint, line_no int, blank boolean, fault string, fault_at int, n_cells int, n_header int, cells array<string>, " + ", ".join(f"{x} string" for x in FIELDS)
_ARROW = pa.schema(
    [("line_id", pa.int64()), ("file_id", pa.int64()), ("line_no", pa.int32()), ("blank", pa.bool_()), ("fault", pa.string()), ("fault_at", pa.int32()), ("n_cells", pa.int32()), ("n_header", pa.int32()), ("cells", pa.list_(pa.string()))]
    + [(x, pa.string()) for x in FIELDS]
)


def _parse_batches(batches):
    layouts: dict[str | None, dict[str, int]] = {}
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in ("line_id", "file_id", "line_no", "raw_line", "header")}
        out: dict[str, list] = {k: [] for k in _CELLS}
        for line_id, file_id, line_no, raw, header in zip(*cols.values(), strict=True):
            layout = layouts.get(header)
            if layout is None:
                if len(layouts) > 50_000:
                    layouts.clear()
                names = [] if header is None else header_names(header)
                layout = layouts[header] = {"": len(names)} | {n: i for i, (n, _) in reversed([*enumerate(names)])}
            got = read_record(raw or "")
            cells, width = got.cells, layout[""]
            blank = got.fault is None and not any(map(str.strip, cells))
            fault = got.fault.code if got.fault else None
            if fault is None and not blank:
                fault = "no_header" if header is None else "cell_count" if len(cells) != width else None
            out["line_id"].append(line_id)
            out["file_id"].append(file_id)
            out["line_no"].append(line_no)
            out["blank"].append(blank)
            out["fault"].append(fault)
            out["fault_at"].append(got.fault.at if got.fault else None)
            out["n_cells"].append(len(cells))
            out["n_header"].append(width)
            out["cells"].append(cells)
            for name in FIELDS:
                i = layout.get(name)
                out[name].append(cells[i] if i is not None and i < len(cells) else "" if i is not None and fault else None if i is None else "")
        yield pa.RecordBatch.from_pydict(out, schema=_ARROW)


def headers(lines: DataFrame) -> DataFrame:
    """file_id, header: the first line of each file (line 1; of repeated ones the lowest line_id)."""
    return lines.where(F.col("line_no") == 1).groupBy("file_id").agg(F.min_by("raw_line", "line_id").alias("header"))


def parse_lines(lines: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Cells of every record below the header (``PARSED``), read by the grammar.

    ``lines`` needs line_id, file_id, line_no and raw_line; other columns are left behind. A null
    raw_line is a blank record; a record whose file has no header line has the fault ``no_header``.
    A null ``line_no`` counts as a record. Lines that stand there twice come out twice.
    """
    rows = lines.select("line_id", "file_id", "line_no", "raw_line")
    body = rows.where(F.coalesce(F.col("line_no") != 1, F.lit(True)))
    joined = body.join(headers(rows) if head is None else head, "file_id", "left")
    return joined.select("line_id", "file_id", "line_no", "raw_line", "header").mapInArrow(_parse_batches, PARSED)


def _has(name: str) -> Column:
    return F.col(name).isNotNull()


def typed_records(parsed: DataFrame, zone: Column | None = None) -> DataFrame:
    """Parsed records with ``posted_*`` (see :func:`with_instant`), ``money`` DECIMAL(18,2), and ``reason``.

    ``reason`` is null for a valid row, else the first of: ``quote_not_closed``, ``text_after_quote``,
    ``no_header``, ``cell_count``, ``bad_date``, ``bad_amount``, ``bad_debit_credit``. Blank records have
    neither a reason nor values. The amount column wins over a debit/credit pair, of which exactly
    one must be filled; debits come out negative, credits positive.
    """
    out = with_instant(parsed, "date", zone, "posted_")
    filled = lambda c: F.coalesce(F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")) != "", F.lit(False))
    out = bind(out, {"__amount": parse_amount(F.col("amount")), "__debit": parse_amount(F.col("debit")), "__credit": parse_amount(F.col("credit")), "__d": filled("debit"), "__c": filled("credit")})
    pair = (F.col("__d") != F.col("__c")) & F.when(F.col("__d"), F.col("__debit").isNotNull()).otherwise(F.col("__credit").isNotNull())
    reason = (
        F.when(F.col("blank"), F.lit(None))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(_has("date") & F.col("posted_instant").isNull(), "bad_date")
        .when(_has("amount") & F.col("__amount").isNull(), "bad_amount")
        .when(~_has("amount") & (_has("debit") | _has("credit")) & ~pair, "bad_debit_credit")
    )
    money = F.when(_has("amount"), parse_money(F.col("amount"))).when(F.col("__d"), -F.abs(parse_money(F.col("debit")))).otherwise(F.abs(parse_money(F.col("credit"))))
    out = bind(out, {"reason": reason})
    return out.withColumn("money", F.when(F.col("reason").isNull() & ~F.col("blank"), money)).drop("__amount", "__debit", "__credit", "__d", "__c")


def _path_batches(batches):
    for batch in batches:
        value = batch.column("source_file").dictionary_encode()
        faults = pa.array([source_file_fault(v) for v in value.dictionary.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), faults.take(value.indices)], names=["id", "fault"])


def source_file_faults(transactions: DataFrame) -> DataFrame:
    """id, fault of every row with a ``source_file``; fault is null for a usable one. Null paths are left out."""
    rows = transactions.where(F.col("source_file").isNotNull()).select("id", "source_file")
    return rows.mapInArrow(_path_batches, "id bigint, fault string")
