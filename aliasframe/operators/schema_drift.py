"""Schemas that change from file to file: edit scripts between schema trees, compiled into projections.

A schema is a tree of nodes (name, label, kind, children). Two trees are compared by a tree edit
distance with the operations add, delete, rename, retype and move: below matched parents the children
are assigned to one another at the least total cost, and what an assignment leaves over is deleted
and added, or moved where the same name turns up under another parent. The script that reaches the
distance is the report of changes, and it is compiled into the projection that reads each file into one
consistent table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.amounts import number_kind
from .records import FIELDS, header_names, headers, parse_lines, typed_records

ADD, DELETE, RENAME, RETYPE, FORBIDDEN = 1.0, 1.0, 0.4, 0.2, 1e6
#: Cost of two labels without a letter in common, and of two types where the labels alone have to say that two columns are one. A new label is a
#: rename while both labels are like enough: 0.4 + 5.3 x (1 - likeness) below the cost of a removal and an addition, so from a likeness of 0.7 on.
UNLIKE, OTHER_KIND = 5.3, 0.8


@dataclass
class Node:
    """``name`` identifies the field, ``label`` is what the file calls it, ``kind`` its type (None: unknown)."""

    name: str
    label: str = ""
    kind: str | None = None
    children: list[Node] = field(default_factory=list)
    fixed: bool = True  # the name is certain: it never becomes another certain name


@dataclass(frozen=True)
class Change:
    path: str
    kind: str  # added, removed, renamed, retyped, moved
    before: str | None = None
    after: str | None = None


def tree_of(schema: T.DataType, name: str = "") -> Node:
    """Schema tree of a Spark type; arrays and maps have their element type below them."""
    if isinstance(schema, T.StructType):
        return Node(name, name, "struct", [tree_of(f.dataType, f.name) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return Node(name, name, "array", [tree_of(schema.elementType, "element")])
    if isinstance(schema, T.MapType):
        return Node(name, name, "map", [tree_of(schema.keyType, "key"), tree_of(schema.valueType, "value")])
    return Node(name, name, schema.simpleString())


def _weight(n: Node) -> float:
    return 1.0 + sum(map(_weight, n.children))


def _pair_cost(a: Node, b: Node) -> tuple[float, list[tuple[Node | None, Node | None]]]:
    other = a.kind != b.kind and None not in (a.kind, b.kind)
    if a.name != b.name:
        if a.fixed and b.fixed:
            return FORBIDDEN, []
        cost = RENAME + UNLIKE * (1 - likeness(a.label, b.label)) + OTHER_KIND * other
    else:
        cost = RENAME * (a.label != b.label) + RETYPE * other
    below, pairs = match(a.children, b.children)
    return cost + below, [(a, b), *pairs]


def likeness(a: str, b: str) -> float:
    """Share of letters that two labels have in common, in order or, word by word, in any order."""
    plain = SequenceMatcher(None, a, b).ratio()
    return max(plain, SequenceMatcher(None, " ".join(sorted(a.split())), " ".join(sorted(b.split()))).ratio())


def match(old: list[Node], new: list[Node]) -> tuple[float, list[tuple[Node | None, Node | None]]]:
    """Least cost of turning the children ``old`` into ``new`` in any order, with the pairs of the script."""
    cost, pairs, left, right = 0.0, [], list(old), []
    by_name = {n.name: n for n in reversed(left)}
    for b in new:  # a certain name on either side has one possible partner
        a = by_name.pop(b.name, None)
        if a is None:
            right.append(b)
        else:
            c, p = _pair_cost(a, b)
            cost, pairs = cost + c, pairs + p
            left = [x for x in left if x is not a]
    n = max(len(left) + len(right), 1)
    table = [[0.0] * n for _ in range(n)]
    found: dict[tuple[int, int], list] = {}
    for i in range(n):
        for j in range(n):
            if i < len(left) and j < len(right):
                c, found[i, j] = _pair_cost(left[i], right[j])
                table[i][j] = c
            elif i < len(left):
                table[i][j] = DELETE * _weight(left[i])
            elif j < len(right):
                table[i][j] = ADD * _weight(right[j])
    for i, j in enumerate(assignment(table)):
        if i < len(left) and j < len(right) and table[i][j] < DELETE * _weight(left[i]) + ADD * _weight(right[j]):
            cost, pairs = cost + table[i][j], pairs + found[i, j]
            continue
        if i < len(left):
            cost, pairs = cost + DELETE * _weight(left[i]), [*pairs, (left[i], None)]
        if j < len(right):
            cost, pairs = cost + ADD * _weight(right[j]), [*pairs, (None, right[j])]
    return cost, pairs


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in a least-cost assignment of a square table (shortest augmenting paths)."""
    n = len(cost)
    up, across, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for r in range(n):
        row_of[n], j, best, came, seen = r, n, [float("inf")] * n, [n] * n, [False] * (n + 1)
        while row_of[j] != n or j == n:
            seen[j], i, step, nxt = True, row_of[j], float("inf"), n
            for k in range(n):
                if not seen[k]:
                    slack = cost[i][k] - up[i] - across[k]
                    if slack < best[k]:
                        best[k], came[k] = slack, j
                    if best[k] < step:
                        step, nxt = best[k], k
            for k in range(n + 1):
                if seen[k]:
                    up[row_of[k]] += step
                    across[k] -= step
                elif k < n:
                    best[k] -= step
            j = nxt
        while j != n:
            prev = came[j]
            row_of[j], j = row_of[prev], prev
    out = [0] * n
    for k in range(n):
        out[row_of[k]] = k
    return out


def edit_script(old: Node, new: Node) -> tuple[float, list[Change]]:
    """Distance and changes between two trees. A subtree deleted here and added elsewhere is moved."""
    cost, pairs = _pair_cost(Node("", "", old.kind, old.children), Node("", "", new.kind, new.children))
    where: dict[int, str] = {}

    def walk(n: Node, at: str) -> None:
        for c in n.children:
            where[id(c)] = path = f"{at}.{c.name}" if at else c.name
            walk(c, path)

    walk(old, "")
    walk(new, "")
    gone = [a for a, b in pairs if b is None]
    come = [b for a, b in pairs if a is None]
    deep = lambda nodes: [y for n in nodes for y in [n, *deep(n.children)]]
    gone, come, out = deep(gone), deep(come), []
    for b in list(come):
        same = next((a for a in gone if a.name == b.name and a.kind == b.kind and where[id(a)] != where[id(b)]), None)
        if same is not None:
            gone.remove(same)
            come.remove(b)
            cost -= DELETE + ADD - RENAME
            out.append(Change(where[id(b)], "moved", where[id(same)], where[id(b)]))
    for a, b in pairs:
        if a is not None and b is not None and id(b) in where:
            at = where[id(a)] if a.fixed and not b.fixed and id(a) in where else where[id(b)]  # a certain name stands for both
            if a.label != b.label or a.name != b.name:
                out.append(Change(at, "renamed", a.label, b.label))
            if a.kind != b.kind and None not in (a.kind, b.kind):
                out.append(Change(at, "retyped", a.kind, b.kind))
    out += [Change(where[id(a)], "removed", a.label, None) for a in gone] + [Change(where[id(b)], "added", None, b.label) for b in come]
    return cost, sorted(out, key=lambda c: (c.path, c.kind))


def compile_projection(table: Iterable[str], file_tree: Node) -> dict[str, int | None]:
    """Column of the consistent table -> the file's cell that fills it, by the script from table to file."""
    want = Node("", children=[Node(n, n) for n in table])
    _, pairs = match(want.children, file_tree.children)
    place = {id(c): i for i, c in enumerate(file_tree.children)}
    return {a.name: place.get(id(b)) if b is not None else None for a, b in pairs if a is not None}


# ---- files of statements ----------------------------------------------------------------------


def file_tree(header: str, kinds: dict[int, str] | None = None) -> Node:
    """Flat tree of one file. A column known by a field's label has that field's name for certain; any other has its own label, which may change."""
    return Node("", children=[Node(n, label, (kinds or {}).get(i), fixed=n in FIELDS) for i, (n, label) in enumerate(header_names(header))])


def column_kinds(records: DataFrame) -> DataFrame:
    """file_id, kinds map<int,string>: the type of most non-empty values of each column's valid records.

    Counts are combined before the shuffle. Equal counts go to the alphabetically first type.
    """
    cells = records.select("file_id", F.posexplode("cells").alias("place", "cell"))
    each = cells.withColumn("kind", number_kind(F.col("cell"))).where(F.col("kind").isNotNull())
    counted = each.groupBy("file_id", "place", "kind").agg(F.count("*").alias("n"))
    top = counted.groupBy("file_id", "place").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("t"))
    return top.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("t.kind")))).alias("kinds"))


def predecessors(files: DataFrame) -> DataFrame:
    """file_id, previous_id: the file of the same account with the nearest earlier stmt_month.

    Of several files of that month the one with the highest file_id. The window runs over an
    account's distinct months only, so an account with very many files makes no large group.
    Files without account or month have no predecessor.
    """
    known = files.where(F.col("account_id").isNotNull() & F.col("stmt_month").isNotNull()).select("file_id", "account_id", "stmt_month")
    months = known.groupBy("account_id", "stmt_month").agg(F.max("file_id").alias("last_id"))
    earlier = months.withColumn("previous_id", F.lag("last_id").over(Window.partitionBy("account_id").orderBy("stmt_month")))
    return known.join(earlier.select("account_id", "stmt_month", "previous_id"), ["account_id", "stmt_month"]).where(F.col("previous_id").isNotNull()).select("file_id", "previous_id")


_CHANGES = "file_id bigint, previous_id bigint, field_name string, change_kind string, before string, after string"


def _compare(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("file_id", "previous_id", "field_name", "change_kind", "before", "after")}
        for file_id, previous_id, header, kinds, header0, kinds0 in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            old, new = file_tree(header0, dict(kinds0 or ())), file_tree(header, dict(kinds or ()))
            for n in (*old.children, *new.children):
                n.kind = "date" if n.name == "date" else n.kind
            for c in edit_script(old, new)[1]:
                for k, v in zip(out, (file_id, previous_id, c.path, c.kind, c.before, c.after), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file_id", pa.int64()), ("previous_id", pa.int64())] + [(k, pa.string()) for k in ("field_name", "change_kind", "before", "after")]))


def changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every change of a file against its predecessor: ``file_id, previous_id, field_name, change_kind, before, after``.

    A file without a header line is passed over as if it hadn't come, with no row of its own; columns
    in another order are no change; a column without values has no type and so isn't retyped. Null,
    blank and faulty records don't count.
    """
    head = headers(lines)
    valid = typed_records(parse_lines(lines, head)).where(F.col("reason").isNull() & ~F.col("blank"))
    schema = head.join(column_kinds(valid.select("file_id", "cells")), "file_id", "left")
    pairs = predecessors(files.join(head.select("file_id"), "file_id", "left_semi"))
    old = schema.select(F.col("file_id").alias("previous_id"), F.col("header").alias("header0"), F.col("kinds").alias("kinds0"))
    joined = pairs.join(schema, "file_id").join(old, "previous_id")
    return joined.select("file_id", "previous_id", "header", "kinds", "header0", "kinds0").mapInArrow(_compare, _CHANGES)


def _project(batches):
    compiled: dict[str, tuple[list[int | None], list[tuple[str, int]]]] = {}
    for batch in batches:
        ids, numbers, cells, heads = (batch.column(k).to_pylist() for k in ("line_id", "file_id", "cells", "header"))
        out: dict[str, list] = {k: [] for k in ("line_id", "file_id", *FIELDS, "other")}
        for line_id, file_id, row, header in zip(ids, numbers, cells, heads, strict=True):
            if header not in compiled:
                tree = file_tree(header)
                plan = compile_projection(FIELDS, tree)
                used = set(plan.values())
                compiled[header] = [plan[f] for f in FIELDS], [(n.name, i) for i, n in enumerate(tree.children) if i not in used]
            places, rest = compiled[header]
            out["line_id"].append(line_id)
            out["file_id"].append(file_id)
            for f, i in zip(FIELDS, places, strict=True):
                out[f].append(None if i is None else row[i])
            out["other"].append([*dict((n, row[i]) for n, i in rest).items()])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("line_id", pa.int64()), ("file_id", pa.int64())] + [(f, pa.string()) for f in FIELDS] + [("other", pa.map_(pa.string(), pa.string()))]))


def consistent_table(lines: DataFrame) -> DataFrame:
    """All valid records of all files in one table: the fields of ``FIELDS`` and a map of other columns."""
    head = headers(lines)
    valid = typed_records(parse_lines(lines, head)).where(F.col("reason").isNull() & ~F.col("blank"))
    schema = "line_id bigint, file_id bigint, " + ", ".join(f"{f} string" for f in FIELDS) + ", other map<string,string>"
    return valid.select("line_id", "file_id", "cells").join(head, "file_id").select("line_id", "file_id", "cells", "header").mapInArrow(_project, schema)
