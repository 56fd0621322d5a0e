"""Queries of the general data problems: records, schemas over time, timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema_drift
from ..operators.records import FIELD_LABELS, parse_lines, source_file_faults, typed_records
from ..operators.timestamps import to_utc
from ..session import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lines = typed_records(parse_lines(read_table(spark, d, "statement_lines")))
    bad_lines = lines.where(F.col("reason").isNotNull()).select(F.lit("statement_lines").alias("tbl"), F.col("line_id").alias("row_id"))
    paths = source_file_faults(read_table(spark, d, "raw_transactions")).where(F.col("fault").isNotNull())
    return bad_lines.unionByName(paths.select(F.lit("raw_transactions").alias("tbl"), F.col("id").alias("row_id"))).distinct()


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The rows set apart, each with its reason and the place of the fault, -1 where it is the whole row."""
    lines = typed_records(parse_lines(read_table(spark, d, "statement_lines"))).where(F.col("reason").isNotNull())
    paths = source_file_faults(read_table(spark, d, "raw_transactions")).where(F.col("fault").isNotNull())
    return lines.select(F.lit("statement_lines").alias("tbl"), F.col("line_id").alias("row_id"), "reason", F.coalesce(F.col("fault_at").cast("bigint"), F.lit(-1)).alias("at")).unionByName(
        paths.select(F.lit("raw_transactions").alias("tbl"), F.col("id").alias("row_id"), F.col("fault").alias("reason"), F.lit(-1).cast("bigint").alias("at"))
    )


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid records, typed."""
    lines = typed_records(parse_lines(read_table(spark, d, "statement_lines")))
    return lines.where(F.col("reason").isNull() & ~F.col("blank")).select("line_id", "file_id", "line_no", F.col("posted_shown_day").alias("posted"), "description", "money", "balance", "category")


def p2_typed(spark: SparkSession, d: str) -> DataFrame:
    """Day, text and cents of the valid records."""
    lines = typed_records(parse_lines(read_table(spark, d, "statement_lines"))).where(F.col("reason").isNull() & ~F.col("blank"))
    return lines.select("line_id", "file_id", F.date_format("posted_shown_day", "yyyy-MM-dd").alias("posted"), "description", (F.col("money") * 100).cast("bigint").alias("cents"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    institutions = read_table(spark, d, "institutions")
    raw = to_utc(read_table(spark, d, "raw_transactions").select("id", "posted_date", "account_id", "institution", "ingested_at"), "posted_date", "account_id", "institution", "ingested_at", institutions)
    files = read_table(spark, d, "statement_files").select("file_id", "account_id", "institution", "received_at")
    lines = typed_records(parse_lines(read_table(spark, d, "statement_lines"))).where(F.col("reason").isNull() & ~F.col("blank")).select("line_id", "file_id", "date")
    dated = to_utc(lines.join(files, "file_id", "left"), "date", "account_id", "institution", "received_at", institutions, sources=files)
    shape = ["form", "instant", "shown_day", "utc_day", "zone"]
    return raw.select(F.lit("raw_transactions").alias("tbl"), F.col("id").alias("row_id"), *shape).unionByName(dated.select(F.lit("statement_lines").alias("tbl"), F.col("line_id").alias("row_id"), *shape))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    at = _instants(spark, d).where(F.col("instant").isNotNull())
    return at.where(F.col("shown_day").isNull() | (F.col("shown_day") != F.col("utc_day"))).select("tbl", "row_id").distinct()


def p6_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(read_table(spark, d, "statement_files"), read_table(spark, d, "statement_lines")).select("file_id", "field_name", "change_kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(read_table(spark, d, "statement_files"), read_table(spark, d, "statement_lines"))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(read_table(spark, d, "statement_lines"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rejected, p2_loaded, p2_typed, p3_found, p3_report, p3_table, p6_found, p6_normalised)}


def _labels(field: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in FIELD_LABELS[field]) + "]"


_WELL = """(?s)("([^"]|"")*"|[^",][^,]*|)(,("([^"]|"")*"|[^",][^,]*|))*"""
_CLOCK = r"([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?"
_ZONE = r"(\s*(Z|z|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{1,2})|\s+(Z|UTC|GMT|WET|BST|WEST|CET|CEST|EET|EEST|IST|EST|EDT|CST|CDT|MST|MDT|PST|PDT))?"
#: Written days: (pattern of the whole value, its day, the day's form).
_DAYS = (
    (rf"[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}(([Tt]|\s+){_CLOCK}{_ZONE})?", "[0-9]+-[0-9]+-[0-9]+", "%Y-%m-%d"),
    (rf"[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}(([Tt]|\s+){_CLOCK}{_ZONE})?", "[0-9]+/[0-9]+/[0-9]+", "%Y/%m/%d"),
    (rf"[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}(,?\s+{_CLOCK}(\s*[AaPp]\.?[Mm]\.?)?{_ZONE})?", "[0-9]+-[0-9]+-[0-9]+", "%m-%d-%Y"),
    (rf"[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}(,?\s+{_CLOCK}(\s*[AaPp]\.?[Mm]\.?)?{_ZONE})?", "[0-9]+/[0-9]+/[0-9]+", "%m/%d/%Y"),
    (rf"[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2}}(,?\s+{_CLOCK}(\s*[AaPp]\.?[Mm]\.?)?{_ZONE})?", "[0-9]+-[0-9]+-[0-9]+", "%m-%d-%y"),
    (rf"[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}(,?\s+{_CLOCK}(\s*[AaPp]\.?[Mm]\.?)?{_ZONE})?", "[0-9]+/[0-9]+/[0-9]+", "%m/%d/%y"),
    (rf"[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}(,?\s+{_CLOCK}{_ZONE})?", "[0-9]+[.][0-9]+[.][0-9]+", "%d.%m.%Y"),
    (rf"[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{2}}(,?\s+{_CLOCK}{_ZONE})?", "[0-9]+[.][0-9]+[.][0-9]+", "%d.%m.%y"),
    (r"[0-9]{8}", "[0-9]{8}", "%Y%m%d"),
    (r"[0-9]{8}([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9](\.[0-9]{1,9})?(\[[+-]?[0-9]{1,2}(\.[0-9]{1,2})?(:[A-Za-z]{1,5})?\])?", "[0-9]{8}", "%Y%m%d"),
    (r"[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}", ".*", "%d-%b-%Y"),
    (r"[0-9]{1,2} [A-Za-z]{3} [0-9]{4}", ".*", "%d %b %Y"),
    (r"[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}", ".*", "%b %d, %Y"),
    (r"[A-Za-z]{3} [0-9]{1,2} [0-9]{4}", ".*", "%b %d %Y"),
)
_DAY_OK = "regexp_full_match({0}, '[0-9]{{10}}|[0-9]{{13}}') OR " + " OR ".join("(regexp_full_match({0}, '%s') AND try_strptime(regexp_extract({0}, '^%s'), '%s') IS NOT NULL)" % tuple(x.replace("{", "{{").replace("}", "}}") for x in d) for d in _DAYS)
_AMOUNT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)^\s*\((.*)\)\s*$', '\1'), '(?i)(CR|DR)\s*$', ''), '-\s*$', ''), '[,\s$£€\x{{00A0}}]', '', 'g')"
_AMOUNT_OK = "(regexp_full_match(" + _AMOUNT + r", '[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(replace(" + _AMOUNT + ", '_', '') AS DOUBLE)), false))"
_CELL = lambda field: f"cells[at_{field}]"
_kind = lambda v: f"CASE WHEN regexp_full_match({_AMOUNT.format(v)}, '[+-]?[0-9]+') THEN 'whole' WHEN regexp_full_match({_AMOUNT.format(v)}, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)') THEN 'decimal' ELSE 'text' END"
_SHOWN_SQL = "strftime(CASE " + " ".join("WHEN regexp_full_match(x, '%s') THEN try_strptime(regexp_extract(x, '^%s'), '%s')" % d for d in _DAYS) + " END, '%Y-%m-%d')"
_PATH_OK = r"regexp_full_match(source_file, '[^/]*[^/\s][^/]*/(checking|credit)_[0-9]{4}-(0[1-9]|1[0-2])\.(csv|ofx|qfx)') AND NOT contains(source_file, '_0000-')"
#: Every record below a header with its cells and what is wrong with it, from the definition in words and independent of the parser.
_FAULTS_SQL = rf"""
    WITH cut AS (SELECT line_id, file_id, line_no, coalesce(raw_line, '') AS raw, list_transform(regexp_extract_all(',' || replace(coalesce(raw_line, ''), '{chr(0xFEFF)}', ''), '(?s),("(?:[^"]|"")*"|[^",][^,]*|)', 1),
        lambda c: CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) AS cells FROM statement_lines),
    head AS (SELECT file_id, list_transform(arg_min(cells, line_id), lambda c: trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))) AS names FROM cut WHERE line_no = 1 GROUP BY 1),
    placed AS (SELECT *, {", ".join(f"list_filter(range(1, len(names) + 1), lambda i: list_contains({_labels(f)}, names[i]))[1] AS at_{f}" for f in ("date", "description", "amount", "debit", "credit"))} FROM head),
    judged AS (SELECT line_id, file_id, line_no, cells, CASE
        WHEN NOT regexp_full_match(raw, '{_WELL}') THEN 'quote'
        WHEN len(list_filter(cells, lambda c: regexp_matches(c, '\S'))) = 0 THEN 'blank'
        WHEN names IS NULL OR len(cells) <> len(names) THEN 'cells'
        WHEN at_date IS NOT NULL AND NOT ({_DAY_OK.format("trim(cells[at_date])")}) THEN 'date'
        WHEN at_amount IS NOT NULL AND NOT {_AMOUNT_OK.format("cells[at_amount]")} THEN 'amount'
        WHEN at_amount IS NULL AND (at_debit IS NOT NULL OR at_credit IS NOT NULL) AND NOT (
            (regexp_matches(coalesce(cells[at_debit], ''), '\S') AND NOT regexp_matches(coalesce(cells[at_credit], ''), '\S') AND {_AMOUNT_OK.format("cells[at_debit]")})
            OR (regexp_matches(coalesce(cells[at_credit], ''), '\S') AND NOT regexp_matches(coalesce(cells[at_debit], ''), '\S') AND {_AMOUNT_OK.format("cells[at_credit]")})) THEN 'pair' END AS fault, at_description
        FROM cut LEFT JOIN placed USING (file_id) WHERE line_no IS DISTINCT FROM 1)
"""
#: What differs between a file and the one before it, by names; the assignment of the operator pairs other labels only where they are alike.
_DRIFT_SQL = (
    _FAULTS_SQL
    + rf""", fields AS (SELECT file_id, unnest(range(1, len(names) + 1)) AS i, unnest(names) AS label FROM head),
    named AS (SELECT file_id, i, label, {" ".join(f"CASE WHEN list_contains({_labels(f)}, label) THEN '{f}' ELSE" for f in FIELD_LABELS)} label {" ".join("END" for _ in FIELD_LABELS)} AS wanted FROM fields),
    called AS (SELECT file_id, i, label, CASE WHEN row_number() OVER (PARTITION BY file_id, wanted ORDER BY i) = 1 THEN wanted ELSE label END AS name FROM named),
    kinds AS (SELECT file_id, i, kind, count(*) AS n FROM (SELECT file_id, i, {_kind("v")} AS kind FROM (SELECT file_id, unnest(range(1, len(cells) + 1)) AS i, unnest(cells) AS v FROM judged WHERE fault IS NULL) WHERE trim(v) <> '') GROUP BY ALL),
    most AS (SELECT file_id, i, arg_min(kind, struct_pack(a := -n, b := kind)) AS kind FROM kinds GROUP BY ALL),
    schema AS (SELECT c.file_id, c.name, c.label, CASE WHEN c.name = 'date' THEN 'date' ELSE m.kind END AS kind FROM called c LEFT JOIN most m ON m.file_id = c.file_id AND m.i = c.i),
    months AS (SELECT account_id, stmt_month, max(file_id) AS last_id FROM statement_files WHERE file_id IN (SELECT file_id FROM head) GROUP BY ALL),
    before AS (SELECT account_id, stmt_month, lag(last_id) OVER (PARTITION BY account_id ORDER BY stmt_month) AS previous_id FROM months),
    pairs AS (SELECT f.file_id, previous_id FROM statement_files f JOIN before USING (account_id, stmt_month) WHERE previous_id IS NOT NULL AND f.file_id IN (SELECT file_id FROM head)),
    new AS (SELECT p.file_id, p.previous_id, s.name, s.label, s.kind FROM pairs p JOIN schema s ON s.file_id = p.file_id),
    old AS (SELECT p.file_id, p.previous_id, s.name, s.label, s.kind FROM pairs p JOIN schema s ON s.file_id = p.previous_id),
    told AS (SELECT coalesce(new.file_id, old.file_id) AS file_id, coalesce(new.previous_id, old.previous_id) AS previous_id, coalesce(new.name, old.name) AS field_name, c.change_kind, c.before, c.after FROM new FULL JOIN old ON new.file_id = old.file_id AND new.name = old.name,
        LATERAL (SELECT unnest([
            struct_pack(change_kind := CASE WHEN old.name IS NULL THEN 'added' END, before := NULL::VARCHAR, after := new.label), struct_pack(change_kind := CASE WHEN new.name IS NULL THEN 'removed' END, before := old.label, after := NULL::VARCHAR),
            struct_pack(change_kind := CASE WHEN new.label <> old.label THEN 'renamed' END, before := old.label, after := new.label), struct_pack(change_kind := CASE WHEN new.kind <> old.kind THEN 'retyped' END, before := old.kind, after := new.kind)]) AS c) t
        WHERE c.change_kind IS NOT NULL)
"""
)
SQL = {
    "p2_found": _FAULTS_SQL + f"SELECT 'statement_lines' AS tbl, line_id AS row_id FROM judged WHERE fault <> 'blank' UNION SELECT 'raw_transactions', id FROM raw_transactions WHERE source_file IS NOT NULL AND NOT ({_PATH_OK})",
    "p3_found": _DRIFT_SQL + "SELECT DISTINCT file_id, field_name, change_kind FROM told",
    "p3_report": _DRIFT_SQL + "SELECT file_id, previous_id, field_name, change_kind, before, after FROM told",
    "p2_rejected": _FAULTS_SQL.replace("AS cells FROM statement_lines)", "AS cells, length(regexp_extract(coalesce(raw_line, ''), '(?s)^((\"([^\"]|\"\")*\"|[^\",][^,]*|),)*')) AS good FROM statement_lines)").replace("SELECT line_id, file_id, line_no, cells, CASE", "SELECT line_id, file_id, line_no, raw, good, names, cells, CASE")
    + rf""", quoted AS (SELECT *, regexp_extract(substr(raw, good + 1), '(?s)^"([^"]|"")*"') AS closed FROM judged),
    placed_faults AS (SELECT *, closed <> '' AND substr(raw, good + length(closed) + 1, 1) <> '"' AS is_closed FROM quoted),
    paths AS (SELECT id, source_file AS f, split_part(source_file, '/', 1) AS folder, substr(source_file, strpos(source_file, '/') + 1) AS rest FROM raw_transactions WHERE source_file IS NOT NULL),
    faulty AS (SELECT id, CASE WHEN NOT contains(f, '/') OR trim(folder) = '' THEN 'no_folder' WHEN NOT regexp_matches(rest, '^(checking|credit)_') THEN 'unknown_type'
        WHEN NOT regexp_full_match(split_part(substr(rest, strpos(rest, '_') + 1), '.', 1), '[0-9]{{4}}-(0[1-9]|1[0-2])') OR rest LIKE '%_0000-%' THEN 'no_month'
        WHEN NOT regexp_full_match(substr(rest, strpos(rest, '_') + 1), '[0-9-]{{7}}\.(csv|ofx|qfx)') THEN 'unknown_extension' END AS reason FROM paths)
    SELECT 'statement_lines' AS tbl, line_id AS row_id, CASE fault WHEN 'quote' THEN CASE WHEN is_closed THEN 'text_after_quote' ELSE 'quote_not_closed' END WHEN 'cells' THEN CASE WHEN names IS NULL THEN 'no_header' ELSE 'cell_count' END
        WHEN 'date' THEN 'bad_date' WHEN 'amount' THEN 'bad_amount' ELSE 'bad_debit_credit' END AS reason, CAST(CASE WHEN fault = 'quote' THEN good + CASE WHEN is_closed THEN length(closed) ELSE 0 END ELSE -1 END AS BIGINT) AS "at"
    FROM placed_faults WHERE fault <> 'blank' UNION ALL SELECT 'raw_transactions', id, reason, -1 FROM faulty WHERE reason IS NOT NULL""",
    "p2_typed": _FAULTS_SQL.replace(" AS fault, at_description", " AS fault, at_description, at_date, at_amount, at_debit, at_credit")
    + rf""", good AS (SELECT line_id, file_id, trim(cells[at_date]) AS x, coalesce(cells[at_description], '') AS description, at_amount IS NOT NULL AS one, regexp_matches(coalesce(cells[at_debit], ''), '\S') AS out_,
        CASE WHEN at_amount IS NOT NULL THEN cells[at_amount] WHEN regexp_matches(coalesce(cells[at_debit], ''), '\S') THEN cells[at_debit] ELSE cells[at_credit] END AS a, at_date, at_description FROM judged WHERE fault IS NULL),
    money AS (SELECT *, TRY_CAST(replace({_AMOUNT.format("a")}, '_', '') AS DOUBLE) AS v FROM good)
    SELECT line_id, file_id, {_SHOWN_SQL} AS posted, CASE WHEN at_description IS NOT NULL THEN description END AS description, CAST(round_even((CASE WHEN one THEN CASE WHEN regexp_matches(a, '(?is)^\s*\(.*\)\s*$|DR\s*\)?\s*$|-\s*(CR|DR)?\s*\)?\s*$') THEN -abs(v) ELSE v END WHEN out_ THEN -abs(v) ELSE abs(v) END) * 100, 0) AS BIGINT) AS cents FROM money""",
    "p6_found": _FAULTS_SQL.replace(" AS fault, at_description", " AS fault, at_date")
    + rf""", written AS (
        SELECT 'statement_lines' AS tbl, line_id AS row_id, trim(cells[at_date]) AS x, account_id, institution FROM judged LEFT JOIN statement_files USING (file_id) WHERE fault IS NULL
        UNION ALL SELECT 'raw_transactions', id, trim(posted_date), account_id, institution FROM raw_transactions),
    zoned AS (SELECT w.*, coalesce(p.time_zone, i.time_zone, 'UTC') AS zone FROM written w LEFT JOIN institutions p ON p.account_prefix = split_part(w.account_id, '-', 1) AND contains(w.account_id, '-') LEFT JOIN institutions i ON i.institution = w.institution),
    read AS (SELECT tbl, row_id, x, zone, regexp_full_match(x, '[0-9]{{10}}|[0-9]{{13}}') AS epoch, CAST({_SHOWN_SQL} AS DATE) AS shown, regexp_full_match(x, '[0-9]{{14}}.*') AS packed, regexp_matches(x, '[0-9]:[0-9]') AS clocked,
        CAST(nullif(regexp_extract(x, '([0-9]{{1,2}}):[0-9]{{2}}', 1), '') AS INT) AS h, CAST(nullif(regexp_extract(x, '[0-9]:([0-9]{{2}})', 1), '') AS INT) AS m, upper(regexp_extract(x, '([AaPp])\.?[Mm]\.?', 1)) AS half,
        regexp_extract(x, ':[0-9]{{2}}(?:\.[0-9]+)?\s*(Z|z|[+-][0-9]{{2}}:?[0-9]{{2}}|[+-][0-9]{{1,2}})$', 1) AS off, upper(regexp_extract(x, '[0-9]\s+([A-Za-z]{{2,5}})$', 1)) AS called, regexp_extract(x, '\[([+-]?[0-9.]+)', 1) AS hours FROM zoned),
    timed AS (SELECT tbl, row_id, zone, epoch, shown, packed OR clocked AS has_clock,
        CASE WHEN packed THEN strptime(left(x, 12), '%Y%m%d%H%M') ELSE shown + to_minutes(CAST(60 * (CASE WHEN half = '' THEN h ELSE h % 12 + (CASE half WHEN 'P' THEN 12 ELSE 0 END) END) + m AS BIGINT)) END AS local,
        CASE WHEN packed THEN CASE WHEN hours <> '' THEN CAST(CAST(hours AS DOUBLE) * 60 AS BIGINT) END
             WHEN upper(off) = 'Z' THEN 0 WHEN off <> '' THEN (CASE WHEN off LIKE '-%' THEN -1 ELSE 1 END) * (60 * CAST(substr(off, 2, 2) AS BIGINT) + CASE WHEN length(off) > 3 THEN CAST(right(off, 2) AS BIGINT) ELSE 0 END)
             WHEN called NOT IN ('', 'AM', 'PM') THEN map {{'Z': 0, 'UTC': 0, 'GMT': 0, 'WET': 0, 'BST': 60, 'WEST': 60, 'CET': 60, 'CEST': 120, 'EET': 120, 'EEST': 180, 'IST': 330, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420}}[called] END AS minutes FROM read)
    SELECT DISTINCT tbl, row_id FROM timed WHERE epoch OR has_clock AND CAST(CASE WHEN minutes IS NULL THEN timezone(zone, local) AT TIME ZONE 'UTC' ELSE local - to_minutes(CAST(minutes AS BIGINT)) END AS DATE) <> shown""",
}
