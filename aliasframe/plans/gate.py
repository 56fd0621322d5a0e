"""The conversation boundary and its test: what leaves is tokens only, and answers stay right.

``Client`` holds the three steps of a turn. ``falsify`` asks the same probes of the alias-space view and, by another way, of the
raw rows, compares the figures, and scans everything that crossed the boundary for real values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import variant_key
from ..operators import aliases, checks, projection, redact
from ..session import checkpoint


class Client:
    """context -> send -> receive over one store's tables; rendering stays on this side.

    ``matcher`` tells which capitalised mentions are known payees (``mention`` in, ``mention`` out), for the warnings.
    """

    def __init__(self, raw: DataFrame, mapping: DataFrame, variants: DataFrame, matcher: Callable[[DataFrame], DataFrame] | None = None):
        self.raw, self.mapping, self.variants = raw, mapping, variants
        self.records = projection.project(raw, mapping, variants)
        self.crossed: list[DataFrame] = []
        self.matcher = matcher

    def _note(self, texts: DataFrame) -> DataFrame:
        self.crossed.append(texts.select(F.col("text").cast("string").alias("text")))
        return texts

    def context_document(self, start: str | None = None, end: str | None = None, accounts: list[str] | None = None) -> str:
        """The window as one JSON document: ``{version, window, balances, records}``, keys sorted."""
        rows, sums = self.context(start, end, accounts)
        return projection.document(rows, window={"start": start, "end": end}, balances=[json.loads(r[0]) for r in sums.orderBy("account").select(F.to_json(F.struct("*"))).toLocalIterator()])

    def context(self, start: str | None = None, end: str | None = None, accounts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(records, balances) of a window; both cross the boundary."""
        rows = projection.window(self.records, start, end, accounts)
        sums = projection.balances(rows)
        self._note(rows.select(projection.record_json().alias("text")))
        self._note(sums.select(F.to_json(F.struct("*")).alias("text")))
        return rows, sums

    def send(self, texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
        """(redacted texts, warnings); the redacted texts cross the boundary."""
        done = checkpoint(redact.redact(texts, key, text, redact.surfaces(self.raw, self.mapping, self.variants)))
        self._note(done.select(F.col("redacted").alias("text")))
        return done, redact.warnings(texts, key, text, done, self.matcher)

    def receive(self, texts: DataFrame, text: str) -> DataFrame:
        """Replies come in as they are; nothing is rendered here."""
        self._note(texts.select(F.col(text).alias("text")))
        return texts

    def leaks(self) -> int:
        """Real values and identifier shapes in all that crossed."""
        said = self.crossed[0]
        for more in self.crossed[1:]:
            said = said.unionByName(more)
        said = checkpoint(said.distinct().withColumn("k", F.xxhash64("text")))
        return checks.seed_hits(said, "k", "text", seeds(self.raw, self.mapping)).count() + checks.scan_text(said, "k", "text").count()

    def render(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        return redact.lens(texts, key, text, self.mapping)


@dataclass(frozen=True)
class Probe:
    """A question whose answer can be checked: ``payee_spend``, ``account_net``, ``account_count`` or ``largest_expense``, over a window and, if given, one account type."""

    name: str
    kind: str
    question: str
    merchant: str | None = None
    account_type: str | None = None
    start: str | None = None
    end: str | None = None
    label: str = "the window"


@dataclass(frozen=True)
class Reply:
    text: str
    value: float
    count: int = 0
    tokens: tuple[str, ...] = ()


def script(merchant: str, start: str, end: str, label: str) -> list[Probe]:
    """Five turns over one window that ask all four kinds."""
    return [
        Probe("merchant-spend", "payee_spend", f"How much did I spend at {merchant} in {label}?", merchant, None, start, end, label),
        Probe("checking-net", "account_net", f"What was the net on my checking account in {label}?", None, "checking", start, end, label),
        Probe("credit-count", "account_count", f"How many purchases were on my credit card in {label}?", None, "credit", start, end, label),
        Probe("largest-expense", "largest_expense", f"What was my single largest expense in {label}?", None, None, start, end, label),
        Probe("credit-net", "account_net", f"And what was the net on the credit card in {label}?", None, "credit", start, end, label),
    ]


def stub_model(probe: Probe, records: DataFrame, sent: str) -> Reply:
    """Answers by arithmetic over the alias-space records alone; a merchant reaches it as the token that redaction put into the question."""
    tokens = tuple(dict.fromkeys(m[0].upper() for m in re.finditer(r"(?i)\bPAYEE-[1-9]\d*\b", sent)))
    if probe.kind == "payee_spend":
        records = records.where(F.col("payee").isin(list(tokens)))
    got = records.agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("sum"), F.count("*").alias("n"), F.min(F.struct("amount_cents", "id", "payee")).alias("worst")).first()  # one row
    if probe.kind == "payee_spend":
        return Reply(f"Over {probe.label} you spent {got['sum'] / 100:+.2f} at {tokens[0] if tokens else 'that merchant'} across {got['n']} transactions.", got["sum"] / 100, got["n"], tokens)
    if probe.kind == "account_net":
        return Reply(f"The net over {probe.label} was {got['sum'] / 100:+.2f} across {got['n']} transactions.", got["sum"] / 100, got["n"])
    if probe.kind == "account_count":
        return Reply(f"There were {got['n']} transactions over {probe.label}.", float(got["n"]), got["n"])
    if probe.kind != "largest_expense":
        raise ValueError(f"unknown kind of question: {probe.kind}")
    if got["worst"] is None:
        return Reply(f"There were no transactions over {probe.label}: {0:+.2f}.", 0.0)
    worst = got["worst"]
    return Reply(f"The largest single expense over {probe.label} was {worst['amount_cents'] / 100:+.2f} at {worst['payee']}.", worst["amount_cents"] / 100, got["n"], (worst["payee"],))


def scope(rows: DataFrame, day: str, start: str | None, end: str | None, account: str, kinds: DataFrame | None, account_type: str | None) -> DataFrame:
    """Rows of an inclusive window and, if one is asked for, of the accounts of a type, by ``kinds(account, account_type)``."""
    out = rows
    if start is not None:
        out = out.where(F.col(day) >= start)
    if end is not None:
        out = out.where(F.col(day) <= end)
    if account_type is not None:
        wanted = kinds.where(F.col("account_type") == account_type).select(F.col("account").alias(account)).distinct()
        out = out.join(wanted, account, "left_semi")
    return out


def oracle(probe: Probe, raw: DataFrame, kinds: DataFrame, spellings: DataFrame) -> tuple[float, int]:
    """(value, count) from the raw rows and the true ``spellings(label, variant)`` of merchants, without dictionary, projection or resolver."""
    rows = scope(projection.with_day(raw), "day", probe.start, probe.end, "account_id", kinds, probe.account_type)
    if probe.kind == "payee_spend":
        wanted = spellings.where(F.col("label") == probe.merchant).select(variant_key(F.col("variant")).alias("variant")).distinct()
        rows = rows.withColumn("variant", variant_key(F.col("raw_payee"))).join(wanted, "variant", "left_semi")
    got = rows.agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("sum"), F.count("*").alias("n"), F.coalesce(F.min("amount_cents"), F.lit(0)).alias("worst")).first()
    return (float(got["n"]) if probe.kind == "account_count" else got["worst"] / 100 if probe.kind == "largest_expense" else got["sum"] / 100), got["n"]


def score(probe: Probe, reply: Reply, value: float, count: int) -> list[str]:
    """Why an answer is wrong; nothing if it is right."""
    out = []
    if abs(reply.value - value) > 0.005:
        out.append(f"{probe.name}: answered {reply.value:+.2f}, the rows say {value:+.2f}")
    if probe.kind in ("payee_spend", "account_count") and reply.count != count:
        out.append(f"{probe.name}: {reply.count} transactions were counted, there are {count}")
    if probe.kind == "payee_spend" and not reply.tokens:
        out.append(f"{probe.name}: the merchant was not recognised")
    if f"{reply.value:+.2f}" not in reply.text and not (float(reply.value).is_integer() and str(int(reply.value)) in reply.text):
        out.append(f"{probe.name}: the figure is not in the reply")
    return out


def converse(client: Client, probes: list[Probe], kinds: DataFrame, spellings: DataFrame, model: Callable[[Probe, DataFrame, str], Reply] = stub_model) -> dict:
    """Hold the conversation and judge it: ``{ok, turns, failures, leaks}``.

    ``kinds(account, account_type)`` names real accounts. Records, questions as sent and replies as received are what crossed; they are scanned for real
    values. Any model can stand in for the stub.
    """
    spark = client.raw.sparkSession
    tokens = kinds.join(aliases.resolve_values(client.mapping, "ACCT"), F.col("account") == F.col("real_value")).select(F.col("token").alias("account"), "account_type")
    failures: list[str] = []
    for i, probe in enumerate(probes):
        records = checkpoint(scope(client.context(probe.start, probe.end)[0], "date", None, None, "account", tokens, probe.account_type))
        sent, _ = client.send(spark.createDataFrame([(i, probe.question)], "k int, text string"), "k", "text")
        reply = model(probe, records, sent.first()["redacted"])
        client.receive(spark.createDataFrame([(i, reply.text)], "k int, text string"), "text")
        failures += score(probe, reply, *oracle(probe, client.raw, kinds, spellings))
    leaks = client.leaks()
    return {"ok": not failures and leaks == 0, "turns": len(probes), "failures": failures, "leaks": leaks}


def oracle_spend(raw: DataFrame, mapping: DataFrame, variants: DataFrame, start: str, end: str) -> DataFrame:
    """payee, spend_cents, n from the raw rows and the dictionary, without the projection."""
    at = aliases.heads(mapping.where(F.col("entity_type") == "PAYEE"))
    named = variants.join(at, F.col("alias_token") == F.col("token")).select("variant", F.col("head").alias("payee"))
    rows = projection.with_day(raw).where(F.col("day").between(start, end)).withColumn("variant", variant_key(F.col("raw_payee")))
    return rows.join(named, "variant").groupBy("payee").agg(F.sum("amount_cents").alias("spend_cents"), F.count("*").alias("n"))


def seeds(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """The real values that must not cross: accounts, institutions and raw payees."""
    values = mapping.where(F.col("entity_type").isin("ACCT", "INST")).select(F.col("real_value").alias("seed"))
    return values.unionByName(raw.select(F.col("raw_payee").alias("seed"))).where(F.length("seed") > 3).distinct()


def falsify(client: Client, start: str, end: str, replies: DataFrame | None = None) -> dict:
    """``{ok, wrong, leaks}``: figures that differ from the oracle's, and real values found in what crossed."""
    rows, _ = client.context(start, end)
    mine = projection.payee_spend(rows).withColumnRenamed("spend_cents", "a").withColumnRenamed("n", "m")
    want = oracle_spend(client.raw, client.mapping, client.variants, start, end)
    both = want.join(mine, "payee", "left")
    wrong = both.where(~(F.col("a").eqNullSafe(F.col("spend_cents")) & F.col("m").eqNullSafe(F.col("n")))).count()
    if replies is not None:
        client.receive(replies, "text")
    leaks = client.leaks()
    return {"ok": wrong == 0 and leaks == 0, "wrong": wrong, "leaks": leaks}
