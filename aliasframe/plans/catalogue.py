"""The registered queries of the ledger operators, each with the SQL that gives the same rows where SQL can.

All of them run over whole tables. ``raw_transactions``, ``alias_mapping``, ``payee_variant`` and the statement tables are the
store; ``ledger`` is a view derived from the order tables, with a known grouping of its memos.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import amounts, text
from ..operators import aliases, checks, graph, projection, redact, resolve, scrub
from ..operators.records import headers
from ..session import read_table
from . import gate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _raw(s, d):
    return read_table(s, d, "raw_transactions")


def _store(s, d):
    return _raw(s, d), read_table(s, d, "alias_mapping"), read_table(s, d, "payee_variant")


def _records(s, d):
    return projection.project(*_store(s, d))


def ledger(s: SparkSession, d: str) -> DataFrame:
    """txn_id, account_id, institution, posted_date, amount_cents, anchor, raw_payee derived from the order tables."""
    orders, customer, nation, part = (read_table(s, d, t) for t in ("orders", "customer", "nation", "part"))
    n = part.agg(F.count("*").alias("parts"))
    k = F.col("o_orderkey")
    anchor = F.concat(F.lit("QX"), F.translate(F.lpad((k % 97).cast("string"), 3, "0"), "0123456789", "BCDFGHJKLM"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(n)).join(part, F.col("p_partkey") == k % F.col("parts"))
    return rows.select(
        k.alias("txn_id"), F.col("c_name").alias("account_id"), F.col("n_name").alias("institution"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_date"),
        (amounts.cents(F.col("o_totalprice")) * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)).alias("amount_cents"), anchor.alias("anchor"),
        F.concat(F.lit("POS DEBIT "), anchor, F.lit(" "), F.upper("p_name"), F.lit(" #"), (k % 1000).cast("string")).alias("raw_payee"),
    )


LEDGER_SQL = """
    SELECT o_orderkey AS txn_id, c_name AS account_id, n_name AS institution, strftime(o_orderdate, '%Y-%m-%d') AS posted_date,
           CAST(round_even(o_totalprice * 100, 0) AS BIGINT) * (CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END) AS amount_cents,
           'QX' || translate(lpad(CAST(o_orderkey % 97 AS VARCHAR), 3, '0'), '0123456789', 'BCDFGHJKLM') AS anchor,
           'POS DEBIT ' || 'QX' || translate(lpad(CAST(o_orderkey % 97 AS VARCHAR), 3, '0'), '0123456789', 'BCDFGHJKLM') || ' ' || upper(p_name) || ' #' || (o_orderkey % 1000) AS raw_payee
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
"""
_KEY = r"upper(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_NOISE = ", ".join(f"'{w}'" for w in text.NOISE)
_TOKENS = f"list_filter(string_split_regex(upper({{}}), '[^A-Za-z0-9]+'), lambda t: length(t) > 1 AND NOT regexp_matches(t, '[0-9]') AND t NOT IN ({_NOISE}))"
_MEMO_TOKENS = f"CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} ELSE [coalesce(nullif(regexp_replace(upper({{}}), '[^A-Z]', '', 'g'), ''), 'UNKNOWN')] END"


def _memo_sql(column: str) -> str:
    return _MEMO_TOKENS.replace("{}", column)


_HEADS_SQL = """
    WITH RECURSIVE hop(token, spot, n) AS (
        SELECT alias_token, coalesce(merged_into, alias_token), 0 FROM alias_mapping
        UNION ALL
        SELECT h.token, m.merged_into, n + 1 FROM hop h JOIN alias_mapping m ON m.alias_token = h.spot WHERE m.merged_into IS NOT NULL AND n < 60
    ), heads AS (SELECT token, arg_max(spot, n) AS head FROM hop GROUP BY token)
"""
#: The calendar day in UTC of a written date: year first, else month first with slash or dash, day first with dots, names of months, packed, seconds.
#: A clock with a stated zone is moved by it; one without stays where it is.
_ISO_OFF = r"""CASE WHEN regexp_matches(x, '[+-][0-9]{2}:?[0-9]{2}$') THEN
    (CASE WHEN regexp_matches(x, '-[0-9]{2}:?[0-9]{2}$') THEN -1 ELSE 1 END) * (60 * CAST(regexp_extract(x, '[+-]([0-9]{2}):?[0-9]{2}$', 1) AS INT) + CAST(right(x, 2) AS INT))
    ELSE coalesce(map {'EDT': -240, 'EST': -300, 'CDT': -300, 'CST': -360, 'PDT': -420, 'PST': -480, 'CET': 60, 'CEST': 120}[regexp_extract(x, '[A-Z]{3,4}$')], 0) END"""
_DAY_SQL = r"""strftime(CASE
    WHEN regexp_matches(x, '^[0-9]{13}$') THEN epoch_ms(CAST(x AS BIGINT))
    WHEN regexp_matches(x, '^[0-9]{10}$') THEN epoch_ms(CAST(x AS BIGINT) * 1000)
    WHEN regexp_matches(x, '^[0-9]{14}') THEN strptime(left(x, 12), '%Y%m%d%H%M') - to_minutes(CAST(60 * CAST('0' || coalesce(nullif(regexp_extract(x, '\[[+-]?([0-9.]+)', 1), ''), '0') AS DOUBLE) AS BIGINT) * (CASE WHEN contains(x, '[-') THEN -1 ELSE 1 END))
    WHEN regexp_matches(x, '^[0-9]{8}') THEN strptime(left(x, 8), '%Y%m%d')
    WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]') THEN strptime(left(x, 10) || ' ' || substr(x, 12, 5), '%Y-%m-%d %H:%M') - to_minutes(CAST(ISO_OFF AS BIGINT))
    WHEN regexp_matches(x, '^[0-9]{4}[-/]') THEN strptime(replace(regexp_extract(x, '^[0-9]{4}[-/][0-9]+[-/][0-9]+'), '/', '-'), '%Y-%m-%d')
    WHEN regexp_matches(x, '^[0-9]+[-/][0-9]+[-/][0-9]{4}') THEN strptime(replace(regexp_extract(x, '^[0-9]+[-/][0-9]+[-/][0-9]{4}'), '/', '-'), '%m-%d-%Y')
    WHEN regexp_matches(x, '^[0-9]+[-/][0-9]+[-/][0-9]{2}') THEN strptime(replace(regexp_extract(x, '^[0-9]+[-/][0-9]+[-/][0-9]{2}'), '/', '-'), '%m-%d-%y')
    WHEN regexp_matches(x, '^[0-9]+\.[0-9]+\.[0-9]{4}') THEN strptime(regexp_extract(x, '^[0-9]+\.[0-9]+\.[0-9]{4}'), '%d.%m.%Y')
    WHEN regexp_matches(x, '^[0-9]+\.[0-9]+\.[0-9]{2}') THEN strptime(regexp_extract(x, '^[0-9]+\.[0-9]+\.[0-9]{2}'), '%d.%m.%y')
    WHEN regexp_matches(x, '^[0-9]+[- ][A-Za-z]{3}') THEN strptime(replace(x, ' ', '-'), '%d-%b-%Y')
    WHEN regexp_matches(x, '^[A-Za-z]{3} ') THEN strptime(replace(x, ',', ''), '%b %d %Y') END, '%Y-%m-%d')""".replace("ISO_OFF", _ISO_OFF)


def _day_sql(column: str) -> str:
    return re.sub(r"\bx\b", f"trim({column})", _DAY_SQL)


_RECORDS_SQL = (
    _HEADS_SQL
    + f""", acct AS (SELECT real_value, arg_min(alias_token, CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT)) AS token FROM alias_mapping WHERE entity_type = 'ACCT' GROUP BY 1),
    inst AS (SELECT real_value, arg_min(alias_token, CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT)) AS token FROM alias_mapping WHERE entity_type = 'INST' GROUP BY 1),
    pay AS (SELECT variant, arg_min(coalesce(h.head, v.alias_token), CAST(regexp_extract(coalesce(h.head, v.alias_token), '-([0-9]+)$', 1) AS BIGINT)) AS payee FROM payee_variant v LEFT JOIN (SELECT * FROM heads WHERE token LIKE 'PAYEE-%') h ON h.token = v.alias_token GROUP BY 1),
    records AS (
        SELECT r.id, coalesce(a.token, r.account_id, '') AS account, coalesce(i.token, nullif(r.institution, '')) AS institution,
               coalesce(p.payee, r.raw_payee, '') AS payee, {_day_sql('r.posted_date')} AS date, r.amount_cents / 100.0 AS amount, '' AS ttype, '' AS category, r.amount_cents
        FROM raw_transactions r LEFT JOIN acct a ON a.real_value = r.account_id LEFT JOIN inst i ON i.real_value = r.institution
        LEFT JOIN pay p ON p.variant = {_KEY.format('r.raw_payee')})
"""
)

# ---- scalar operators ----------------------------------------------------------------------------------


@query(f"SELECT id, {_KEY.format('raw_payee')} AS variant, lower(trim(regexp_replace(raw_payee, '\\s+', ' ', 'g'))) AS lexicon FROM raw_transactions")
def variant_key(s, d):
    return _raw(s, d).select("id", text.variant_key(F.col("raw_payee")).alias("variant"), text.lexicon_key(F.col("raw_payee")).alias("lexicon"))


@query(f"SELECT id, array_to_string({_memo_sql('raw_payee')}, ' ') AS tokens FROM raw_transactions WHERE raw_payee IS NOT NULL")
def normalize_memo(s, d):
    return _raw(s, d).where(F.col("raw_payee").isNotNull()).select("id", F.array_join(text.memo_tokens(F.col("raw_payee")), " ").alias("tokens"))


@query(f"SELECT id, array_to_string(list_transform({_memo_sql('variant')}, lambda t: left(t, 1)), '') AS acronym FROM payee_variant")
def memo_acronym(s, d):
    return read_table(s, d, "payee_variant").select("id", text.acronym(text.memo_tokens(F.col("variant"))).alias("acronym"))


@query("SELECT file_id, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS normal FROM (SELECT file_id, unnest(string_split(raw_line, ',')) AS label FROM statement_lines WHERE line_no = 1)")
def header_normalize(s, d):
    cells = headers(read_table(s, d, "statement_lines")).select("file_id", F.explode(F.split("header", ",")).alias("label"))
    return cells.select("file_id", "label", text.header_key(F.col("label")).alias("normal"))


_FORMS = "CASE id % 5 WHEN 0 THEN '(' || money || ')' WHEN 1 THEN money || ' DR' WHEN 2 THEN '$' || money || '-' WHEN 3 THEN ' €' || money WHEN 4 THEN money || ' cr' END"


@query("SELECT id, (CASE WHEN id % 5 < 3 THEN -1 ELSE 1 END) * abs(amount_cents) AS cents FROM raw_transactions")
def amount_parse(s, d):
    money = F.format_number(F.abs("amount_cents") / 100, 2)
    rows = _raw(s, d).select("id", money.alias("money")).withColumn("written", F.expr(_FORMS))
    return rows.select("id", (amounts.parse_money(F.col("written")) * 100).cast("bigint").alias("cents"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS cents FROM lineitem")
def cents_half_even(s, d):
    return read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", amounts.cents(F.col("l_extendedprice")).alias("cents"))


@query(r"""
    SELECT id, strftime(CASE
        WHEN regexp_matches(posted_date, '^\d{4}-\d{1,2}-\d{1,2}$') THEN try_strptime(posted_date, '%Y-%m-%d')
        WHEN regexp_matches(posted_date, '^\d{4}/\d{1,2}/\d{1,2}$') THEN try_strptime(posted_date, '%Y/%m/%d')
        WHEN regexp_matches(posted_date, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(posted_date, '%m/%d/%Y')
        WHEN regexp_matches(posted_date, '^\d{1,2}/\d{1,2}/\d{2}$') THEN try_strptime(posted_date, '%m/%d/%y')
        WHEN regexp_matches(posted_date, '^\d{1,2}-\d{1,2}-\d{4}$') THEN try_strptime(posted_date, '%m-%d-%Y')
        WHEN regexp_matches(posted_date, '^\d{1,2}-[A-Za-z]{3}-\d{4}$') THEN try_strptime(posted_date, '%d-%b-%Y')
        WHEN regexp_matches(posted_date, '^[A-Za-z]{3} \d{1,2}, \d{4}$') THEN try_strptime(posted_date, '%b %d, %Y') END, '%Y-%m-%d') AS day
    FROM raw_transactions
""")
def date_parse(s, d):
    from ..functions.instants import with_instant

    plain = F.col("form").isin("iso_day", "us_day", "day_month_name", "month_name_day")
    return with_instant(_raw(s, d).select("id", "posted_date"), "posted_date").select("id", F.when(plain, F.date_format("shown_day", "yyyy-MM-dd")).alias("day"))


@query(r"SELECT alias_token, regexp_matches(alias_token, '^(PAYEE|ACCT|INST|PERSON|CARD)-[1-9][0-9]*$') AS canonical, CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT) AS n FROM alias_mapping")
def token_shape(s, d):
    return read_table(s, d, "alias_mapping").select("alias_token", text.is_canonical(F.col("alias_token")).alias("canonical"), text.token_number(F.col("alias_token")).alias("n"))


_ABA = " + ".join(f"{w} * CAST(substr(digits, {i}, 1) AS INT)" for i, w in enumerate((3, 7, 1) * 3, 1))


@query(f"SELECT c_custkey, digits, ({_ABA}) % 10 = 0 AS aba FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS digits FROM customer)")
def aba_check(s, d):
    digits = F.lpad((F.col("c_custkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    return read_table(s, d, "customer").select("c_custkey", digits.alias("digits")).withColumn("aba", text.aba_valid(F.col("digits")))


# ---- spans, detection, lint ------------------------------------------------------------------------------

_LUHN = "list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN (length(m) - i) % 2 = 1 THEN (CASE WHEN CAST(substr(m, CAST(i AS BIGINT), 1) AS INT) > 4 THEN 2 * CAST(substr(m, CAST(i AS BIGINT), 1) AS INT) - 9 ELSE 2 * CAST(substr(m, CAST(i AS BIGINT), 1) AS INT) END) ELSE CAST(substr(m, CAST(i AS BIGINT), 1) AS INT) END)) % 10 = 0"
_ABA_M = _ABA.replace("digits", "m")


@query(f"""
    WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS m FROM documents),
    found AS (
        SELECT doc_id, 'luhn_card' AS kind, m AS match FROM runs WHERE length(m) BETWEEN 13 AND 19 AND {_LUHN}
        UNION ALL SELECT doc_id, 'aba_routing', m FROM runs WHERE length(m) = 9 AND ({_ABA_M}) % 10 = 0
        UNION ALL SELECT doc_id, 'ssn', unnest(regexp_extract_all(text, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b')) FROM documents)
    SELECT doc_id, kind, match, count(*) AS n FROM found GROUP BY ALL
""")
def structural_scan(s, d):
    return checks.scan_text(read_table(s, d, "documents"), "doc_id", "text").groupBy("doc_id", "kind", "match").agg(F.count("*").alias("n"))


@query(r"""
    WITH found AS (
        SELECT id, 'ACCOUNT_ID' AS entity_type, unnest(regexp_extract_all(raw_memo, '(?i)\b[A-Z]{3,}-[A-Z]{2,4}-\d{4,}\b')) AS match FROM raw_transactions
        UNION ALL SELECT id, 'ROUTING_NUMBER', unnest(regexp_extract_all(raw_memo, '\b\d{9}\b')) FROM raw_transactions)
    SELECT id, entity_type, match, count(*) AS n FROM found GROUP BY ALL
""")
def detect_patterns(s, d):
    return checks.detect(_raw(s, d), "id", "raw_memo").groupBy("id", "entity_type", "match").agg(F.count("*").alias("n"))


@query(r"""
    SELECT doc_id, match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(?:statement\s+note|statement|dispute)\b')) AS match FROM documents) GROUP BY ALL
""")
def detect_denylist(s, d):
    found = checks.detect(read_table(s, d, "documents"), "doc_id", "text", {"TERM": ["dispute", "statement", "statement note"]})
    return found.where(F.col("entity_type") == "TERM").groupBy("doc_id", "match").agg(F.count("*").alias("n"))


@query(r"""
    SELECT doc_id, upper(regexp_extract(raw, '([A-Za-z]+)', 1)) || '-' || CAST(CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS token, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])((?:PAYEE|ACCT|INST|PERSON|CARD)[-_ ][0-9]+)', 1)) AS raw FROM documents)
    WHERE CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) > 0 GROUP BY ALL
""")
def alias_tokens_found(s, d):
    docs = read_table(s, d, "documents").where(F.col("text").rlike(text.ALIAS))
    return docs.select("doc_id", F.explode(text.alias_matches(F.col("text"))).alias("m")).groupBy("doc_id", F.col("m.token").alias("token")).agg(F.count("*").alias("n"))


@query()
def lens_render(s, d):
    """Documents with their tokens rendered, whole texts."""
    return redact.lens(read_table(s, d, "documents"), "doc_id", "text", read_table(s, d, "alias_mapping"))


@query(
    _HEADS_SQL
    + r""", said AS (SELECT doc_id, upper(regexp_extract(raw, '([A-Za-z]+)', 1)) || '-' || CAST(CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS token
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])((?:PAYEE|ACCT|INST|PERSON|CARD)[-_ ][0-9]+)', 1)) AS raw FROM documents))
    SELECT doc_id, count(*) AS n FROM said JOIN heads USING (token) JOIN alias_mapping m ON m.alias_token = head GROUP BY 1
"""
)
def lens_counts(s, d):
    done = redact.lens(read_table(s, d, "documents"), "doc_id", "text", read_table(s, d, "alias_mapping"))
    return done.where(F.size("substituted") > 0).select("doc_id", F.size("substituted").cast("bigint").alias("n"))


_RULE_SQL = " UNION ALL ".join(
    "SELECT memo_id, '{}' AS kind, unnest(regexp_extract_all(raw, '{}')) AS m FROM injection_memos WHERE true".format(k, p.replace("(?:(?<=^)|(?<=[\\s.>|\\]]))", "(?:^|[\\s.>|\\]])").replace("'", "''")) for k, p in scrub.RULES
)


@query(f"SELECT memo_id, kind, count(*) AS n FROM ({_RULE_SQL}) WHERE m <> '' GROUP BY ALL")
def scrub_hits_by_kind(s, d):
    done = scrub.scrub(read_table(s, d, "injection_memos").select("memo_id", "raw"), "raw")
    return done.select("memo_id", F.explode("scrubbed_hits").alias("h")).groupBy("memo_id", F.col("h.kind").alias("kind")).agg(F.count("*").alias("n"))


@query()
def scrub_text(s, d):
    return scrub.scrub(read_table(s, d, "injection_memos").select("memo_id", "raw"), "raw").select("memo_id", "scrubbed", F.size("scrubbed_hits").cast("bigint").alias("n"))


@query(
    _RECORDS_SQL
    + r"""SELECT id, field, match FROM (SELECT id, 'account' AS field, account AS match FROM records UNION ALL SELECT id, 'institution', institution FROM records UNION ALL SELECT id, 'payee', payee FROM records)
    WHERE match IS NOT NULL AND NOT regexp_matches(match, '^(PAYEE|ACCT|INST|PERSON|CARD)-[1-9][0-9]*$')"""
)
def lint_conformance(s, d):
    return checks.conformance(_records(s, d), "id")


@query(
    _RECORDS_SQL
    + r""", bad AS (SELECT 1 FROM (SELECT account AS match FROM records UNION ALL SELECT institution FROM records UNION ALL SELECT payee FROM records)
    WHERE match IS NOT NULL AND NOT regexp_matches(match, '^(PAYEE|ACCT|INST|PERSON|CARD)-[1-9][0-9]*$'))
    SELECT CASE WHEN count(*) = 0 THEN 'clean' ELSE 'leaks' END AS verdict, count(*) AS findings, CASE WHEN count(*) = 0 THEN '' ELSE 'alias_nonconformance' END AS kinds FROM bad"""
)
def lint_verdict(s, d):
    return checks.verdict(checks.conformance(_records(s, d), "id").select(F.lit("alias_nonconformance").alias("kind")))


@query()
def lint_text(s, d):
    """All findings of memos, with places."""
    return checks.lint_text(_raw(s, d), "id", "raw_memo")


@query("""
    SELECT DISTINCT doc_id, real_value AS seed FROM documents, alias_mapping WHERE contains(lower(text), lower(real_value))
""")
def seed_leak_scan(s, d):
    return checks.seed_hits(read_table(s, d, "documents"), "doc_id", "text", read_table(s, d, "alias_mapping").select(F.col("real_value").alias("seed")))


# ---- entity resolution -------------------------------------------------------------------------------------

_DOCS_SQL = f"WITH docs AS (SELECT DISTINCT {_memo_sql('variant')} AS tokens FROM payee_variant WHERE variant IS NOT NULL), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM docs) GROUP BY 1), "
_DOCS_SQL += "generic AS (SELECT token, df FROM df WHERE df >= 8 AND df >= 0.10 * (SELECT count(*) FROM docs)) "


def _docs(s, d):
    return resolve.documents(read_table(s, d, "payee_variant"), "variant")


@query(_DOCS_SQL + "SELECT token, df FROM df")
def token_df(s, d):
    return resolve.token_df(_docs(s, d))


@query(
    f"WITH ledger AS ({LEDGER_SQL}), docs AS (SELECT DISTINCT {_memo_sql('raw_payee')} AS tokens FROM ledger), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM docs) GROUP BY 1)"
    "SELECT token, df FROM df WHERE df >= 8 AND df >= 0.10 * (SELECT count(*) FROM docs)"
)
def generic_tokens(s, d):
    return resolve.generic_tokens(resolve.documents(ledger(s, d), "raw_payee"))


@query(_DOCS_SQL + "SELECT array_to_string(tokens, ' ') AS doc, token FROM (SELECT tokens, unnest(list_distinct(tokens)) AS token FROM docs) WHERE token NOT IN (SELECT token FROM generic)")
def discriminative_tokens(s, d):
    return resolve.discriminative(_docs(s, d)).select(F.array_join("tokens", " ").alias("doc"), "token")


@query(
    _DOCS_SQL
    + """, disc AS (SELECT tokens, token FROM (SELECT tokens, unnest(list_distinct(tokens)) AS token FROM docs) WHERE token NOT IN (SELECT token FROM generic)),
    words AS (SELECT DISTINCT token FROM disc)
    SELECT a.token AS short, b.token AS long FROM words a JOIN words b ON length(a.token) >= 5 AND starts_with(b.token, a.token) AND a.token <> b.token"""
)
def candidate_pairs_prefix(s, d):
    return resolve.prefix_links(resolve.discriminative(_docs(s, d)).select("token").distinct())


@query(
    _DOCS_SQL
    + """, disc AS (SELECT tokens, token FROM (SELECT tokens, unnest(list_distinct(tokens)) AS token FROM docs) WHERE token NOT IN (SELECT token FROM generic)),
    least AS (SELECT token, min(tokens) AS a FROM disc GROUP BY 1)
    SELECT DISTINCT array_to_string(a, ' ') AS a, array_to_string(tokens, ' ') AS b FROM disc JOIN least USING (token) WHERE a <> tokens"""
)
def candidate_pairs_shared(s, d):
    return resolve.shared_links(resolve.discriminative(_docs(s, d))).select(F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b")).distinct()


_INITIALS = f"SELECT variant FROM payee_variant UNION SELECT array_to_string(list_transform({_memo_sql('variant')}, lambda t: left(t, 1)), '') FROM payee_variant"


@query(
    _DOCS_SQL.replace("FROM payee_variant WHERE variant IS NOT NULL", f"FROM ({_INITIALS}) WHERE variant IS NOT NULL")
    + """, disc AS (SELECT tokens, token FROM (SELECT tokens, unnest(list_distinct(tokens)) AS token FROM docs) WHERE token NOT IN (SELECT token FROM generic))
    SELECT array_to_string(a.tokens, ' ') AS a, array_to_string(b.tokens, ' ') AS b FROM disc a JOIN docs b ON len(a.tokens) = 1 AND length(a.token) BETWEEN 2 AND 5 AND len(b.tokens) > 1
    AND a.token = array_to_string(list_transform(b.tokens, lambda t: left(t, 1)), '')"""
)
def candidate_pairs_acronym(s, d):
    """Lists and the initials that spell them, over the recorded spellings and all their initials."""
    variants = read_table(s, d, "payee_variant").select("variant")
    docs = resolve.documents(variants.union(variants.select(text.acronym(text.memo_tokens(F.col("variant"))))), "variant")
    return resolve.initial_links(docs, resolve.discriminative(docs)).select(F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b"))


@query(f"WITH ledger AS ({LEDGER_SQL}) SELECT anchor, count(DISTINCT raw_payee) AS spellings FROM ledger GROUP BY 1")
def resolve_entities(s, d):
    """Entities of the derived ledger: each is one anchor, and the count of its spellings."""
    rows = ledger(s, d)
    found = resolve.resolve(rows, "raw_payee")
    anchor = F.array_join(F.filter("tokens", lambda t: t.startswith("QX")), " ")
    return found.withColumn("anchor", anchor).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("anchor")), ",").alias("anchor"), F.count("*").alias("spellings")).drop("entity")


@query()
def resolve_payees(s, d):
    """Entities and labels of the recorded spellings."""
    docs = _docs(s, d)
    found = resolve.resolve(read_table(s, d, "payee_variant"), "variant")
    return found.join(resolve.labels(found, resolve.generic_tokens(docs)), "entity").select(F.col("memo").alias("variant"), "entity", "label")


# ---- alias dictionary ----------------------------------------------------------------------------------------


def _issue_sql(cls: str, column: str) -> str:
    return f"SELECT '{cls}' AS entity_type, {column} AS real_value, n, '{cls}-' || n AS alias_token FROM (SELECT {column}, row_number() OVER (ORDER BY min(id), {column}) AS n FROM raw_transactions WHERE coalesce({column}, '') <> '' GROUP BY {column})"


def _values(raw: DataFrame, cls: str, column: str) -> DataFrame:
    return raw.select(F.lit(cls).alias("entity_type"), F.col(column).alias("real_value"), F.col("id").alias("seen"))


@query(_issue_sql("ACCT", "account_id"))
def alias_issue_acct(s, d):
    return aliases.issue(_values(_raw(s, d), "ACCT", "account_id"))


@query(_issue_sql("INST", "institution"))
def alias_issue_inst(s, d):
    return aliases.issue(_values(_raw(s, d), "INST", "institution"))


@query(_issue_sql("PAYEE", "raw_payee"))
def alias_issue_payee(s, d):
    return aliases.issue(_values(_raw(s, d), "PAYEE", "raw_payee"))


@query("""
    WITH top AS (SELECT max(CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT)) AS n FROM alias_mapping WHERE entity_type = 'PAYEE'),
    new AS (SELECT raw_payee, min(id) AS seen FROM raw_transactions WHERE coalesce(raw_payee, '') <> '' AND raw_payee NOT IN (SELECT real_value FROM alias_mapping WHERE entity_type = 'PAYEE' AND real_value IS NOT NULL) GROUP BY 1)
    SELECT 'PAYEE' AS entity_type, raw_payee AS real_value, CAST(n + row_number() OVER (ORDER BY seen, raw_payee) AS BIGINT) AS n, 'PAYEE-' || CAST(n + row_number() OVER (ORDER BY seen, raw_payee) AS BIGINT) AS alias_token FROM new, top
""")
def alias_issue_incremental(s, d):
    """Numbers for the payees the dictionary doesn't hold yet, from its durable counter on."""
    raw, mapping, _ = _store(s, d)
    return aliases.issue(_values(raw, "PAYEE", "raw_payee"), mapping, aliases.counters(mapping))


@query(_HEADS_SQL + "SELECT token, head FROM heads")
def merge_heads(s, d):
    return aliases.heads(read_table(s, d, "alias_mapping"))


@query("""
    WITH RECURSIVE chain(token, spot, n) AS (
        SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE c_custkey - 1 END, 0 FROM customer
        UNION ALL SELECT token, spot - 1, n + 1 FROM chain WHERE spot % 10 <> 0)
    SELECT CAST(token AS VARCHAR) AS token, CAST(min(spot) AS VARCHAR) AS head FROM chain GROUP BY 1
""")
def merge_chains(s, d):
    """Chains of up to nine redirects, made from the customer keys."""
    k = F.col("c_custkey")
    links = read_table(s, d, "customer").select(k.cast("string").alias("token"), F.when(k % 10 != 0, (k - 1).cast("string")).alias("merged_into"))
    return graph.chain_heads(links)


@query(
    _HEADS_SQL
    + """, used AS (SELECT head, count(*) AS n, min(confidence) AS c FROM payee_variant v JOIN heads h ON h.token = v.alias_token GROUP BY 1)
    SELECT m.alias_token AS head, m.real_value AS label, coalesce(n, 0) AS variant_count, coalesce(c, 1.0) AS confidence, coalesce(c, 1.0) < 0.95 AS low_confidence
    FROM alias_mapping m LEFT JOIN used ON used.head = m.alias_token WHERE m.entity_type = 'PAYEE' AND m.merged_into IS NULL"""
)
def payee_review(s, d):
    _, mapping, variants = _store(s, d)
    return aliases.review(mapping, variants)


@query(
    _HEADS_SQL
    + """, used AS (SELECT head, min(confidence) AS c FROM payee_variant v JOIN heads h ON h.token = v.alias_token GROUP BY 1)
    SELECT m.alias_token AS head, c AS confidence FROM alias_mapping m JOIN used ON used.head = m.alias_token WHERE m.entity_type = 'PAYEE' AND m.merged_into IS NULL AND c < 0.95"""
)
def payee_flagged(s, d):
    _, mapping, variants = _store(s, d)
    return aliases.flagged(mapping, variants)


# ---- projection, windows, probes -----------------------------------------------------------------------------


@query(_RECORDS_SQL + "SELECT id, account, institution, payee, date, amount, ttype, category, amount_cents FROM records")
def project_alias(s, d):
    return _records(s, d)


@query(_RECORDS_SQL + "SELECT id, account, institution, payee, date, amount, ttype, category, amount_cents FROM records WHERE starts_with(date, '2025-03')")
def export_month(s, d):
    raw, mapping, variants = _store(s, d)
    return projection.project(projection.month_rows(raw, "2025-03"), mapping, variants)


@query(f"SELECT DISTINCT substr({_day_sql('posted_date')}, 1, 7) AS month FROM raw_transactions WHERE posted_date IS NOT NULL")
def months(s, d):
    return projection.months(_raw(s, d))


@query(_RECORDS_SQL + "SELECT id, account, payee, date, amount_cents FROM records WHERE date >= '2025-02-01' AND date <= '2025-06-30' AND account IN (SELECT token FROM acct WHERE real_value LIKE '%-CC-%')")
def context_filter(s, d):
    raw, mapping, variants = _store(s, d)
    wanted = aliases.resolve_values(mapping, "ACCT").where(F.col("real_value").contains("-CC-")).select(F.col("token").alias("account"))
    return projection.window(projection.project(raw, mapping, variants), "2025-02-01", "2025-06-30", wanted).select("id", "account", "payee", "date", "amount_cents")


@query(
    _RECORDS_SQL
    + """SELECT account, arg_min(institution, id) FILTER (institution IS NOT NULL) AS institution_known, CAST(sum(amount_cents) AS BIGINT) AS net_cents,
    CAST(coalesce(sum(amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS debit_cents, CAST(coalesce(sum(amount_cents) FILTER (amount_cents >= 0), 0) AS BIGINT) AS credit_cents, count(*) AS txn_count FROM records GROUP BY 1"""
)
def balances(s, d):
    rows = _records(s, d)
    known = rows.where(F.col("institution").isNotNull()).groupBy("account").agg(F.min_by("institution", "id").alias("institution_known"))
    return projection.balances(rows).drop("institution").join(known, "account", "left").select("account", "institution_known", "net_cents", "debit_cents", "credit_cents", "txn_count")


@query(_RECORDS_SQL + "SELECT payee, CAST(sum(amount_cents) AS BIGINT) AS spend_cents, count(*) AS n FROM records WHERE date BETWEEN '2025-01-01' AND '2025-12-31' GROUP BY 1")
def payee_spend(s, d):
    return projection.payee_spend(projection.window(_records(s, d), "2025-01-01", "2025-12-31"))


@query(_RECORDS_SQL + "SELECT account, CAST(sum(amount_cents) AS BIGINT) AS net_cents FROM records WHERE date >= '2026-01-01' GROUP BY 1")
def account_net(s, d):
    return projection.account_net(projection.window(_records(s, d), "2026-01-01"))


@query(_RECORDS_SQL + "SELECT account, count(*) AS n FROM records WHERE date <= '2025-12-31' GROUP BY 1")
def account_count(s, d):
    return projection.account_count(projection.window(_records(s, d), None, "2025-12-31"))


@query(_RECORDS_SQL + "SELECT account, amount_cents, id, payee FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY amount_cents, id) AS k FROM records) WHERE k = 1")
def largest_expense(s, d):
    return projection.largest_expense(_records(s, d))


@query("SELECT file_id, source_file, account_id, account_type, stmt_month FROM (SELECT *, row_number() OVER (PARTITION BY account_id, account_type, stmt_month ORDER BY source_file, file_id) AS k FROM statement_files) WHERE k = 1")
def canonical_statement(s, d):
    return projection.canonical_statements(read_table(s, d, "statement_files")).select("file_id", "source_file", "account_id", "account_type", "stmt_month")


@query(_RECORDS_SQL + "SELECT account, count(*) AS n_rows, count(DISTINCT payee) AS n_payees, count(*) >= 100 AND count(DISTINCT payee) > 0 AND count(*) >= 100 * count(DISTINCT payee) AS collapsed FROM records GROUP BY 1")
def collapse_check(s, d):
    return projection.collapse_check(_records(s, d), "account")


@query(f"""
    SELECT r.source_file, count(*) AS n_rows, count(DISTINCT CASE WHEN v.variant IS NULL THEN {_KEY.format('r.raw_payee')} END) AS new_variants, count(DISTINCT CASE WHEN a.real_value IS NULL THEN r.account_id END) AS new_accounts
    FROM raw_transactions r LEFT JOIN (SELECT DISTINCT variant FROM payee_variant) v ON v.variant = {_KEY.format('r.raw_payee')}
    LEFT JOIN (SELECT DISTINCT real_value FROM alias_mapping WHERE entity_type = 'ACCT') a ON a.real_value = r.account_id GROUP BY 1
""")
def ingest_summary(s, d):
    return projection.ingest_summary(*_store(s, d))


@query("SELECT f.account_type, m.alias_token AS account, count(*) AS files FROM statement_files f JOIN alias_mapping m ON m.entity_type = 'ACCT' AND m.real_value = f.account_id GROUP BY ALL")
def account_scope(s, d):
    mapping = read_table(s, d, "alias_mapping")
    tokens = aliases.resolve_values(mapping, "ACCT").select(F.col("real_value").alias("account_id"), F.col("token").alias("account"))
    return read_table(s, d, "statement_files").join(tokens, "account_id").groupBy("account_type", "account").agg(F.count("*").alias("files"))


@query(f"WITH ledger AS ({LEDGER_SQL}) SELECT account_id, CAST(sum(amount_cents) AS BIGINT) AS net_cents, count(*) AS n FROM ledger WHERE posted_date >= '1996-01-01' GROUP BY 1")
def ledger_balances(s, d):
    return ledger(s, d).where(F.col("posted_date") >= "1996-01-01").groupBy("account_id").agg(F.sum("amount_cents").alias("net_cents"), F.count("*").alias("n"))


@query(_RECORDS_SQL + "SELECT id, CAST(json_object('account', account, 'amount', amount, 'category', category, 'date', date, 'institution', institution, 'payee', payee, 'ttype', ttype) AS VARCHAR) AS json FROM records")
def projection_json(s, d):
    """Records as JSON lines with sorted keys."""
    return _records(s, d).select("id", projection.record_json().alias("json"))


@query()
def outbound_redact(s, d):
    """Documents with every known real value and spelling replaced by its token."""
    return redact.redact(read_table(s, d, "documents"), "doc_id", "text", redact.surfaces(*_store(s, d)))


@query()
def outbound_warnings(s, d):
    done = redact.redact(read_table(s, d, "documents"), "doc_id", "text", redact.surfaces(*_store(s, d)))
    return redact.warnings(read_table(s, d, "documents"), "doc_id", "text", done)


# ---- labels, tokens, dictionary changes, scopes --------------------------------------------------------------------


@query(f"SELECT id, CASE WHEN len({_TOKENS.replace('{}', 'variant')}) > 0 THEN array_to_string(list_transform({_TOKENS.replace('{}', 'variant')}, lambda t: upper(left(t, 1)) || lower(substr(t, 2))), ' ') ELSE coalesce(nullif(trim(regexp_replace(variant, '\\s+', ' ', 'g')), ''), 'Unknown Payee') END AS label FROM payee_variant")
def display_label(s, d):
    return read_table(s, d, "payee_variant").select("id", text.display_label(F.col("variant"), text.significant_tokens(F.col("variant"))).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN k BETWEEN 0 AND 4 AND n > 0 THEN ['PAYEE', 'ACCT', 'INST', 'PERSON', 'CARD'][k + 1] || '-' || n END AS token FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 6 AS k, l_linenumber - 1 AS n FROM lineitem)")
def canonical_tokens(s, d):
    """Tokens made from the order lines: five classes and one that is none, numbers from 0."""
    classes = F.array(*[F.lit(c) for c in ("payee", "Acct", "INST", "person", "CARD", "BANK")])
    return read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.canonical(F.get(classes, (F.col("l_orderkey") % 6).cast("int")), (F.col("l_linenumber") - 1).cast("bigint")).alias("token"))


@query("SELECT id, printf('%+.2f', amount_cents / 100.0) AS figure, contains(raw_payee, CAST(amount_cents // 100 AS VARCHAR)) AND amount_cents % 100 = 0 OR contains(raw_payee, printf('%+.2f', amount_cents / 100.0)) AS shown FROM raw_transactions WHERE amount_cents IS NOT NULL AND raw_payee IS NOT NULL")
def reply_figures(s, d):
    """Every amount as a reply writes it, and whether the payee's text happens to show it."""
    value = F.col("amount_cents") / 100
    return _raw(s, d).where(F.col("amount_cents").isNotNull() & F.col("raw_payee").isNotNull()).select("id", text.figure(value).alias("figure"), text.shows_figure(F.col("raw_payee"), value).alias("shown"))


@query("SELECT entity_type, real_value, arg_min(alias_token, CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT)) AS token FROM alias_mapping GROUP BY 1, 2")
def alias_lookup(s, d):
    """The token of every real value of every class."""
    mapping = read_table(s, d, "alias_mapping")
    out = None
    for cls in text.CLASSES:
        one = aliases.resolve_values(mapping, cls).select(F.lit(cls).alias("entity_type"), "real_value", "token")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    SELECT alias_token, entity_type, CASE WHEN entity_type = 'PAYEE' AND CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT) % 3 = 0 THEN 'Put ' || alias_token ELSE real_value END AS real_value, merged_into FROM alias_mapping
    UNION ALL SELECT 'CARD-' || account_prefix, 'CARD', institution, NULL FROM institutions WHERE false
    UNION ALL SELECT 'PERSON-' || n, 'PERSON', institution, NULL FROM (SELECT institution, row_number() OVER (ORDER BY institution) AS n FROM institutions)
""")
def alias_put(s, d):
    """A third of the payees get another value, and new tokens come in; what is no token of its class is left out."""
    mapping = read_table(s, d, "alias_mapping").select("alias_token", "entity_type", "real_value", "merged_into")
    changed = mapping.where((F.col("entity_type") == "PAYEE") & (text.token_number(F.col("alias_token")) % 3 == 0)).select("alias_token", "entity_type", F.concat(F.lit("Put "), "alias_token").alias("real_value"))
    banks = read_table(s, d, "institutions").select("institution").withColumn("n", F.row_number().over(Window.orderBy("institution")))  # twelve rows, fixed
    fresh = banks.select(F.concat_ws("-", F.lit("PERSON"), "n").alias("alias_token"), F.lit("PERSON").alias("entity_type"), F.col("institution").alias("real_value"))
    bad = banks.select(F.concat_ws("-", F.lit("CARD"), F.lit("x"), "n").alias("alias_token"), F.lit("CARD").alias("entity_type"), F.col("institution").alias("real_value"))
    return aliases.put(mapping, changed.unionByName(fresh).unionByName(bad))


_TWO_SQL = "two AS (SELECT alias_token, row_number() OVER (ORDER BY CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT)) AS k FROM alias_mapping m WHERE entity_type = 'PAYEE' AND merged_into IS NULL)"


def _two(mapping: DataFrame) -> list[str]:
    """The two payees with the lowest numbers that are heads."""
    first = mapping.where((F.col("entity_type") == "PAYEE") & F.col("merged_into").isNull()).orderBy(text.token_number(F.col("alias_token"))).limit(2)
    return [r[0] for r in first.select("alias_token").collect()]


@query(f"WITH {_TWO_SQL} SELECT alias_token, CASE WHEN alias_token = (SELECT alias_token FROM two WHERE k = 2) THEN (SELECT alias_token FROM two WHERE k = 1) ELSE merged_into END AS merged_into FROM alias_mapping")
def alias_merge(s, d):
    mapping = read_table(s, d, "alias_mapping")
    return aliases.merge(mapping, *_two(mapping))[0].select("alias_token", "merged_into")


@query("SELECT alias_token, merged_into FROM alias_mapping")
def alias_split(s, d):
    """A merge taken back leaves the dictionary as it was."""
    mapping = read_table(s, d, "alias_mapping")
    two = _two(mapping)
    return aliases.split(aliases.merge(mapping, *two)[0], two[1])[0].select("alias_token", "merged_into")


@query(f"WITH {_TWO_SQL} SELECT alias_token, CASE WHEN alias_token = (SELECT alias_token FROM two WHERE k = 1) THEN 'Another  Name 1' ELSE real_value END AS real_value FROM alias_mapping".replace("Another  Name", "Another Name"))
def alias_rename(s, d):
    mapping = read_table(s, d, "alias_mapping")
    return aliases.rename(mapping, _two(mapping)[0], "Another   Name 1")[0].select("alias_token", "real_value")


@query("SELECT variant, CASE WHEN variant = (SELECT min(variant) FROM payee_variant) THEN 'PAYEE-' || (SELECT 1 + max(CAST(regexp_extract(alias_token, '-([0-9]+)$', 1) AS BIGINT)) FROM alias_mapping WHERE entity_type = 'PAYEE') ELSE alias_token END AS alias_token FROM payee_variant")
def alias_split_variant(s, d):
    """The first spelling moves to a token of its own."""
    mapping, variants = read_table(s, d, "alias_mapping"), read_table(s, d, "payee_variant")
    least = variants.agg(F.min("variant")).first()[0]
    return aliases.split_variant(mapping, variants, least)[1].select("variant", "alias_token")


@query(f"SELECT variant, alias_token, confidence FROM payee_variant UNION ALL SELECT v, 'PAYEE-0', 0.5 FROM (SELECT DISTINCT {_KEY.format('raw_payee')} AS v FROM raw_transactions) WHERE v <> '' AND v NOT IN (SELECT variant FROM payee_variant)")
def variant_upsert(s, d):
    """Every spelling of the transactions brought as new: recorded ones keep their token."""
    variants = read_table(s, d, "payee_variant").select("variant", "alias_token", "confidence")
    new = _raw(s, d).select(text.variant_key(F.col("raw_payee")).alias("variant"), F.lit("PAYEE-0").alias("alias_token"), F.lit(0.5).alias("confidence")).where(F.col("variant") != "")
    return aliases.upsert_variants(variants, new)


@query(_RECORDS_SQL + "SELECT id, account, date, amount_cents FROM records WHERE date >= '2025-02-01' AND date <= '2025-04-30' AND account IN (SELECT token FROM acct JOIN statement_files f ON f.account_id = acct.real_value WHERE f.account_type = 'credit')")
def scope_filter(s, d):
    """Records of one window of the accounts of one type."""
    kinds = read_table(s, d, "statement_files").join(aliases.resolve_values(read_table(s, d, "alias_mapping"), "ACCT"), F.col("account_id") == F.col("real_value")).select(F.col("token").alias("account"), "account_type")
    return gate.scope(_records(s, d), "date", "2025-02-01", "2025-04-30", "account", kinds, "credit").select("id", "account", "date", "amount_cents")


@query(f"""
    WITH runs AS (SELECT id, unnest(regexp_extract_all(raw_memo, '[0-9]+')) AS m FROM raw_transactions)
    SELECT DISTINCT * FROM (
        SELECT id, 'luhn_card' AS kind, m AS match FROM runs WHERE length(m) BETWEEN 13 AND 19 AND {_LUHN}
        UNION ALL SELECT id, 'aba_routing', m FROM runs WHERE length(m) = 9 AND ({_ABA_M}) % 10 = 0
        UNION ALL SELECT id, 'ssn', unnest(regexp_extract_all(raw_memo, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b')) FROM raw_transactions
        UNION ALL SELECT id, 'ACCOUNT_ID', unnest(regexp_extract_all(raw_memo, '(?i)\\b[A-Z]{{3,}}-[A-Z]{{2,4}}-\\d{{4,}}\\b')) FROM raw_transactions
        UNION ALL SELECT id, 'ROUTING_NUMBER', unnest(regexp_extract_all(raw_memo, '\\b\\d{{9}}\\b')) FROM raw_transactions)
""")
def lint_kinds(s, d):
    """What the lint of a memo finds, without places."""
    return checks.lint_text(_raw(s, d), "id", "raw_memo").select("id", "kind", "match").distinct()


@query()
def match_mentions(s, d):
    """The entity of every raw payee as a mention of the recorded spellings."""
    docs = _docs(s, d)
    found = resolve.resolve(read_table(s, d, "payee_variant"), "variant")
    return resolve.match(_raw(s, d).select(F.col("raw_payee").alias("mention")), found, resolve.generic_tokens(docs))
