"""Records, amounts, dates, schemas over time."""

import csv
import io
import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aliasframe.functions.amounts import number_kind, parse_amount, parse_money
from aliasframe.functions.instants import with_instant
from aliasframe.operators import records as R
from aliasframe.operators import schema_drift as D
from aliasframe.operators import timestamps as Z

LINES = "line_id bigint, file_id bigint, line_no int, raw_line string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text('ab",\n x', max_size=6), min_size=3, max_size=3), min_size=1, max_size=6))
def test_reading_gives_back_what_was_written(rows):
    rows = [["h1", "h2", "h3"], *rows]
    out = io.StringIO(newline="")
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert [r.cells for r in R.read_text(out.getvalue())] == rows
    one = io.StringIO(newline="")
    csv.writer(one, quoting=csv.QUOTE_ALL, lineterminator="").writerow(rows[-1])
    got = R.read_record(one.getvalue())
    assert got.cells == rows[-1] and got.fault is None


def test_recovery_resumes_at_the_next_anchor():
    text = 'Date,Text,Amount\n2025-01-01,ok,1\n2025-01-02,"broken,2\n2025-01-03,"fine, too",3\n2025-01-04,x"y,4\n'
    got = list(R.read_text(text, lambda c: c[0].startswith("2025")))
    faults = [(r.number, r.fault.code) for r in got if r.fault]
    assert faults == [(3, "text_after_quote")]
    assert text[got[2].start :].startswith('2025-01-02,"broken')
    assert [r.cells[-1] for r in got if not r.fault] == ["Amount", "1", "3", "4"]
    assert list(R.read_text("")) == []
    last = list(R.read_text('a,b\n1,"never closed\n'))
    assert last[-1].fault.code == "quote_not_closed" and last[-1].fault.at == 6


def test_typed_records_and_reasons(spark):
    rows = [
        (1, 1, 1, "﻿Date,Description,Amount"), (2, 1, 2, "2025-01-02,a,(1.50)"), (3, 1, 3, "2025-13-02,a,1"), (4, 1, 4, '2025-01-02,"a,1'), (5, 1, 5, '2025-01-02,"a"x,1'), (6, 1, 6, "2025-01-02,a"),
        (7, 1, 7, " , ,"), (8, 1, 8, None), (9, 1, 9, "2025-01-02,a,nan"), (10, 1, 10, '1/3/25,"a\nb",5 DR'), (11, 2, 2, "2025-01-02,a,1"), (12, 3, 1, "Date,Payee,Money Out,Money In"), (13, 3, 2, "2025-01-02,a,5,"),
        (14, 3, 3, "2025-01-02,a,5,6"), (15, 3, 4, "2025-01-02,a,,"), (16, 3, 5, "2025-01-02,a,,7"), (2, 1, 2, "2025-01-02,a,(1.50)"),
    ]
    lines = spark.createDataFrame(rows, LINES).withColumn("cells", F.lit("clash")).withColumn("header", F.lit(1))
    got = {}
    for r in R.typed_records(R.parse_lines(lines)).collect():
        got[r["line_id"]] = (r["reason"], None if r["money"] is None else float(r["money"]))
    assert got == {2: (None, -1.5), 3: ("bad_date", None), 4: ("quote_not_closed", None), 5: ("text_after_quote", None), 6: ("cell_count", None), 7: (None, None), 8: (None, None), 9: ("bad_amount", None), 10: (None, -5.0), 11: ("no_header", None), 13: (None, -5.0), 14: ("bad_debit_credit", None), 15: ("bad_debit_credit", None), 16: (None, 7.0)}
    assert R.parse_lines(spark.createDataFrame([], LINES)).count() == 0
    assert R.typed_records(R.parse_lines(lines)).count() == 15


@pytest.mark.parametrize(("path", "fault"), [("a/checking_2025-01.csv", None), ("a/credit_2025-12.qfx", None), ("checking_2025-01.csv", "no_folder"), ("a/loan_2025-01.csv", "unknown_type"), ("a/credit_2025-13.csv", "no_month"), ("a/credit_2025-01.csv.part", "unknown_extension"), ("a/b/credit_2025-01.csv", "unknown_type"), ("", "no_folder"), ("a/credit_2025-01", "no_month")])
def test_source_files(path, fault):
    got = R.source_file_fault(path)
    assert (got is None) == (fault is None)


def test_amounts(spark):
    cases = {"(1,850.00)": -1850.0, "$3,120.44": 3120.44, "5 CR": 5.0, "5 dr": -5.0, "7-": -7.0, "1_000": 1000.0, "1e3": 1000.0, "inf": None, "nan": None, "5d": None, "12;4": None, "": None, "-€2.5": -2.5, ".5": 0.5, "1e999": None, "--5": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    got = {r[0]: (r[1], r[2]) for r in df.select("v", parse_amount(F.col("v")), number_kind(F.col("v"))).collect()}
    assert {k: v[0] for k, v in got.items()} == {**cases, None: None}
    assert got["(1,850.00)"][1] == "decimal" and got["5 CR"][1] == "whole" and got["5d"][1] == "text" and got[""][1] is None and got[None][1] is None
    assert df.where(parse_money(F.col("v")).isNotNull()).count() == 9


def test_instants(spark):
    zone = F.lit("America/New_York")
    cases = {
        "2025-01-02": "2025-01-02T00:00:00", "1/2/25": "2025-01-02T00:00:00", "01-02-2025": "2025-01-02T00:00:00", "02.01.2025": "2025-01-02T00:00:00", "2-Jan-2025": "2025-01-02T00:00:00", "Jan 2, 2025": "2025-01-02T00:00:00", "20250102": "2025-01-02T00:00:00",
        "1/2/75": "1975-01-02T00:00:00", "2025-01-02 22:30": "2025-01-03T03:30:00", "2025-07-02T22:30:00Z": "2025-07-02T22:30:00", "2025-07-02 22:30 CEST": "2025-07-02T20:30:00", "20250403142124[+5.5]": "2025-04-03T08:51:24", "20250403142124[0:GMT]": "2025-04-03T14:21:24",
        "1/2/2025 12:05 AM": "2025-01-02T05:05:00", "1735776000": "2025-01-02T00:00:00", "1735776000123": "2025-01-02T00:00:00.123000", "2025-03-09 02:30:00": "2025-03-09T07:30:00", "2025-11-02 01:30:00": "2025-11-02T05:30:00", " 2025-01-02 ": "2025-01-02T00:00:00",
        "2025-02-30": None, "13/01/2025": None, "2025-01-02 25:00": None, "2025-01-02 10:00 XYZ": None, "soon": None, "": None, None: None,
    }
    for session in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", session)
        try:
            rows = spark.createDataFrame([(k,) for k in cases], "v string")
            got = with_instant(rows, "v", zone).select("v", F.unix_micros("instant").alias("u"), "shown_day", "utc_day", "needs_zone").collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        from datetime import datetime, timedelta

        seen = {r["v"]: None if r["u"] is None else (datetime(1970, 1, 1) + timedelta(microseconds=r["u"])).isoformat() for r in got}
        assert seen == cases
        by = {r["v"]: r for r in got}
        assert str(by["2025-01-02 22:30"]["shown_day"]) == "2025-01-02" and str(by["2025-01-02 22:30"]["utc_day"]) == "2025-01-03" and by["2025-01-02 22:30"]["needs_zone"]
        assert by["1735776000"]["shown_day"] is None


def test_zone_estimate_and_declared_zone(spark):
    banks = spark.createDataFrame([("Near", "NR", "America/New_York"), ("Far", "FR", "Asia/Kolkata"), ("West", "WS", "America/Los_Angeles")], "institution string, account_prefix string, time_zone string")
    rows = [(i, "XX-1", None, f"2025-06-{i:02d} 10:00:00", f"2025-06-{i:02d} 05:00:00") for i in range(1, 9)]  # ingested 30 minutes after 10:00 in Kolkata
    rows += [(20, "NR-9", None, "2025-06-01 22:00", "2025-06-09 00:00:00"), (21, None, None, "2025-06-01 22:00", "2025-06-09 00:00:00"), (22, "ZZ-1", "Far", None, "2025-06-09 00:00:00")]
    df = spark.createDataFrame(rows, "id int, acct string, inst string, v string, got string").withColumn("got", F.col("got").cast("timestamp")).withColumn("zone", F.lit("clash")).withColumn("instant", F.lit("clash"))
    got = {r["id"]: r for r in Z.to_utc(df, "v", "acct", "inst", "got", banks).collect()}
    assert {got[i]["zone"] for i in range(1, 9)} == {"Asia/Kolkata"} and len(got) == 11
    assert got[20]["zone"] == "America/New_York" and str(got[20]["utc_day"]) == "2025-06-02"
    assert got[21]["zone"] == "UTC" and got[22]["zone"] == "Asia/Kolkata" and got[22]["instant"] is None
    assert Z.to_utc(df.limit(0), "v", "acct", "inst", "got", banks).count() == 0


def test_assignment_is_the_cheapest():
    r = random.Random(1)
    for n in range(1, 6):
        for _ in range(20):
            cost = [[float(r.randint(0, 9)) for _ in range(n)] for _ in range(n)]
            got = sum(cost[i][j] for i, j in enumerate(D.assignment(cost)))
            assert got == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))


def test_edit_scripts_of_nested_schemas():
    a = T.StructType([T.StructField("id", T.LongType()), T.StructField("who", T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType())])), T.StructField("tags", T.ArrayType(T.StringType()))])
    b = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("who", T.StructType([T.StructField("name", T.StringType())])), T.StructField("new", T.LongType())])
    cost, script = D.edit_script(D.tree_of(a), D.tree_of(b))
    assert {(c.path, c.kind) for c in script} == {("age", "moved"), ("id", "retyped"), ("tags", "removed"), ("tags.element", "removed"), ("new", "added")}
    assert cost > 0 and D.edit_script(D.tree_of(a), D.tree_of(a)) == (0.0, [])
    old, new = D.Node("", children=[D.Node("amount", "betrag", "decimal", fixed=False)]), D.Node("", children=[D.Node("betrag eur", "betrag eur", "decimal", fixed=False)])
    assert [c.kind for c in D.edit_script(old, new)[1]] == ["renamed"]
    free = lambda *labels: D.Node("", children=[D.Node(x, x, k, fixed=False) for x, k in labels])
    got = D.edit_script(free(("posted by", "text"), ("fx rate", "decimal"), ("branch code", "text")), free(("code branch", "text"), ("poster by", "text"), ("check no", "whole")))[1]
    assert {(c.path, c.kind) for c in got} == {("poster by", "renamed"), ("code branch", "renamed"), ("fx rate", "removed"), ("check no", "added")}


def test_a_label_outside_the_dictionary_that_is_like_a_field_is_a_rename():
    old, new = D.file_tree("Date,Description,Amount,Balance"), D.file_tree("Date,Descriptions,Amount,Closing Balance,Branch")
    assert {(c.path, c.kind) for c in D.edit_script(old, new)[1]} == {("description", "renamed"), ("balance", "removed"), ("closing balance", "added"), ("branch", "added")}
    assert {(c.path, c.kind) for c in D.edit_script(D.file_tree("Date,Description,Amount,Posted By"), D.file_tree("Date,Description,Amount,Poster By"))[1]} == {("poster by", "renamed")}
    assert D.compile_projection(("date", "description", "amount", "balance"), D.file_tree("Descriptions,Date,Amount,Branch")) == {"date": 1, "description": 0, "amount": 2, "balance": None}


def test_changes_between_files(spark):
    files = spark.createDataFrame([(1, "A", "2025-01"), (2, "A", "2025-03"), (3, "B", "2025-01"), (4, "A", "2025-02"), (5, None, "2025-02"), (6, "A", "2025-04")], "file_id bigint, account_id string, stmt_month string")
    text = {1: ["Date,Description,Amount,Branch", "2025-01-01,a,1.50,x", "2025-01-02,b,2,"], 4: ["Date,Description,Branch,Amount", "2025-02-01,a,x,1.50", "2025-02-01,b,,3.25"], 2: ["Posted Date,description,Balance,Amount", "2025-03-01,a,5.00,150", "2025-03-02,a,5.00,-25", "2025-03-0x,a,1,1.1"], 3: ["Date,Description,Amount", "2025-01-01,a,1"], 6: []}
    lines = [(100 * f + i, f, i, raw) for f, raws in text.items() for i, raw in enumerate(raws, 1)]
    got = {(r["file_id"], r["field_name"], r["change_kind"]) for r in D.changes(files, spark.createDataFrame(lines, LINES)).collect()}
    assert got == {(2, "date", "renamed"), (2, "branch", "removed"), (2, "balance", "added"), (2, "amount", "retyped")}
    table = D.consistent_table(spark.createDataFrame(lines, LINES)).where("line_id = 402").first()
    assert table["amount"] == "1.50" and table["other"] == {"branch": "x"} and table["balance"] is None
    assert D.changes(files, spark.createDataFrame([], LINES)).count() == 0
