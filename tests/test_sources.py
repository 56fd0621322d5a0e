"""Fixtures with a manifest, files to scan, documents, key custody, mentions, the conversation."""

import json

import pytest
from pyspark.sql import functions as F

from aliasframe import cli
from aliasframe.operators import aliases, checks, projection, redact, resolve
from aliasframe.plans import gate
from aliasframe.sources import fixtures, keys, statement

MAP = "alias_token string, entity_type string, real_value string, merged_into string"
MANIFEST = {
    "accounts": {"checking": {"account_id": "QB-CHK-0001", "institution": "Quillbank", "routing_number": "021000021"}, "credit": {"account_id": "QB-CC-0002", "institution": "Quillbank"}},
    "payees": {"Zorblax": ["ZORBLAX #12 SEA", "Zorblax 77"], "Kuvenda Drensil": ["KUVENDA DRENSIL"]},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("fixtures")
    (at / "manifest.json").write_text(json.dumps(MANIFEST))
    (at / "checking_2026-05.csv").write_text("Date,Description,Amount\n2026-05-01,ZORBLAX #12 SEA,-5.00\n2026-05-02,Zorblax 77,-2.50\nnever,x,1\n")
    (at / "credit_2026-05.ofx").write_text("OFXHEADER:100\n<OFX><ACCTID>QB-CC-0002\n<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260503<TRNAMT>-40.00<FITID>F1<NAME>KUVENDA DRENSIL</STMTTRN></OFX>")
    (at / "savings_2026-05.csv").write_text("Date,Description,Amount\n2026-05-01,x,1\n")
    (at / "notes.csv").write_text("Date,Description,Amount\n2026-05-01,x,1\n")
    return str(at)


def test_fixtures_and_manifest(spark, folder):
    rows = fixtures.statements(spark, folder).collect()
    assert {(r["account_type"], r["stmt_month"], r["format"], r["account_id"], r["institution"]) for r in rows} == {("checking", "2026-05", "csv", "QB-CHK-0001", "Quillbank"), ("credit", "2026-05", "ofx", "QB-CC-0002", "Quillbank")}
    assert sorted((r["amount"], r["reason"]) for r in rows if r["reason"] is None) == [(-40.0, None), (-5.0, None), (-2.5, None)] and sum(r["reason"] == "bad_date" for r in rows) == 1
    seeds = {r["seed"]: r["provenance"] for r in fixtures.seeds(spark, MANIFEST).collect()}
    assert seeds["QB-CC-0002"] == "account_id of credit" and seeds["021000021"] == "routing_number of checking" and seeds["Zorblax 77"] == "payee" and len(seeds) == 9
    found = fixtures.detector(MANIFEST)(spark.createDataFrame([(1, "to Quillbank and zorblax 77, QB-CHK-0001"), (2, None)], "k int, t string"), "k", "t").collect()
    assert {(r["entity_type"], r["match"]) for r in found} >= {("INSTITUTION", "Quillbank"), ("PAYEE", "zorblax 77")}
    assert fixtures.payees(spark, MANIFEST).count() == 3


def test_both_readers_give_the_same_rows(spark, folder):
    statement.register(spark)
    plain = lambda df: sorted((r["source_file"].rsplit("/", 1)[1], *map(str, r[1:])) for r in df.collect())
    assert plain(statement.read(spark, folder)) == plain(spark.read.format("statement").load(folder))
    assert statement.read(spark, folder, **{"account_id": "Z", "on_error": "drop"}).where("account_id = 'Z'").count() == 5


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.md").write_text("x\ncard 4111111111111111")
    (tmp_path / "b.bin").write_text("4111111111111111")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe 4111111111111111")
    got = checks.scan_files(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["kind"], r["line"], r["col"]) for r in got] == [("a.md", "luhn_card", 2, 6)]
    assert cli.main(["fakeness", str(tmp_path)]) == 1
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "records": [{"account": "ACCT-1", "payee": "Corner Shop", "institution": None}]}))
    assert {(r["kind"], r["match"], r["detail"]) for r in checks.lint_file(spark, str(tmp_path / "p.json")).collect()} == {("alias_nonconformance", "Corner Shop", "records[0].payee")}
    assert "alias_nonconformance: 1" in checks.report(checks.lint_file(spark, str(tmp_path / "p.json"))) and cli.main(["lint", str(tmp_path / "p.json")]) == 1
    records = spark.createDataFrame([(2, "ACCT-1", None, "PAYEE-1", "2026-05-01", -1.5, "", ""), (1, "ACCT-1", "INST-1", "PAYEE-2", "2026-05-01", 2.0, "", "")], "id int, account string, institution string, payee string, date string, amount double, ttype string, category string")
    projection.write_document(records, str(tmp_path / "out.json"), provenance={"status": "green"})
    whole = json.loads((tmp_path / "out.json").read_text())
    assert [r["payee"] for r in whole["records"]] == ["PAYEE-2", "PAYEE-1"] and list(whole) == ["provenance", "records", "version"] and json.loads(projection.document(records))["records"] == whole["records"]
    projection.write_document(records.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"records": [], "version": 1}


def test_key_custody(tmp_path, capsys):
    held = keys.KeyFile(str(tmp_path / "key"))
    with pytest.raises(FileNotFoundError):
        held.get()
    first = held.generate().reveal()
    assert len(first) == 64 and (tmp_path / "key").stat().st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        held.generate()
    with pytest.raises(ValueError):
        held.set(" ", True)
    held.set("other", True)
    assert held.get().reveal() == "other" and cli.main(["key", "generate", str(tmp_path / "key")]) == 1
    assert cli.main(["key", "delete", str(tmp_path / "key")]) == 0 and not held.present() and "other" not in capsys.readouterr().out
    assert cli.main(["status", "--store", str(tmp_path / "nowhere"), "--key", "k"]) == 2


def test_put(spark):
    mapping = spark.createDataFrame([("PAYEE-1", "PAYEE", "One", None), ("PAYEE-2", "PAYEE", "Two", "PAYEE-1")], MAP)
    rows = spark.createDataFrame([("PAYEE-2", "PAYEE", "Zwei"), ("ACCT-1", "ACCT", "A"), ("ACCT-x", "ACCT", "B"), ("PAYEE-7", "ACCT", "C"), ("PAYEE-8", "PAYEE", "")], "alias_token string, entity_type string, real_value string")
    assert {tuple(r) for r in aliases.put(mapping, rows).collect()} == {("PAYEE-1", "PAYEE", "One", None), ("PAYEE-2", "PAYEE", "Zwei", "PAYEE-1"), ("ACCT-1", "ACCT", "A", None)}
    assert aliases.put(mapping.limit(0), rows.limit(0)).count() == 0


def test_mentions(spark):
    found = resolve.resolve(spark.createDataFrame([("WHOLE FOODS #12",), ("STARBUCKS 77",), ("KUVENDA DRENSIL",)], "memo string"), "memo")
    asked = spark.createDataFrame([("whole foods",), ("Starbukcs",), ("WF",), ("WHOLEFDS",), ("Quintoria",), (None,), ("",)], "mention string").withColumn("entity", F.lit("clash"))
    got = {r["mention"]: (r["entity"], round(r["score"], 2)) for r in resolve.match(asked, found).collect()}
    assert got == {"whole foods": ("WHOLE FOODS", 1.0), "Starbukcs": ("STARBUCKS", 0.89), "WF": ("WHOLE FOODS", 0.85), "WHOLEFDS": ("WHOLE FOODS", 0.9)}
    assert resolve.match(asked.limit(0), found).count() == 0 and resolve.match(asked, found.limit(0)).count() == 0


def _client(spark, matcher=None):
    raw = spark.createDataFrame([(1, "QB-CHK-0001", "Quillbank", "ZORBLAX #12 SEA", "05/01/2026", -500), (2, "QB-CHK-0001", "Quillbank", "Zorblax 77", "2026-05-02", -250), (3, "QB-CC-0002", "Quillbank", "KUVENDA DRENSIL", "3.5.2026", -4000), (4, "QB-CC-0002", "Quillbank", "KUVENDA DRENSIL", "2026-06-01", -100)], "id int, account_id string, institution string, raw_payee string, posted_date string, amount_cents bigint")
    mapping = spark.createDataFrame([("ACCT-1", "ACCT", "QB-CHK-0001", None), ("ACCT-2", "ACCT", "QB-CC-0002", None), ("INST-1", "INST", "Quillbank", None), ("PAYEE-1", "PAYEE", "Zorblax", None), ("PAYEE-2", "PAYEE", "Kuvenda Drensil", None)], MAP)
    variants = spark.createDataFrame([("ZORBLAX #12 SEA", "PAYEE-1", 1.0), ("ZORBLAX 77", "PAYEE-1", 0.9), ("KUVENDA DRENSIL", "PAYEE-2", 1.0)], "variant string, alias_token string, confidence double")
    return gate.Client(raw, mapping, variants, matcher)


def test_a_conversation_of_five_turns(spark):
    kinds = spark.createDataFrame([("QB-CHK-0001", "checking"), ("QB-CC-0002", "credit")], "account string, account_type string")
    spellings = fixtures.payees(spark, MANIFEST)
    probes = gate.script("Zorblax", "2026-05-01", "2026-05-31", "May")
    assert {p.kind for p in probes} == {"payee_spend", "account_net", "account_count", "largest_expense"} and len(probes) == 5
    assert gate.converse(_client(spark), probes, kinds, spellings) == {"ok": True, "turns": 5, "failures": [], "leaks": 0}

    def leaky(probe, records, sent):
        said = gate.stub_model(probe, records, sent)
        return gate.Reply(said.text + " It was KUVENDA DRENSIL.", said.value, said.count, said.tokens)

    def wrong(probe, records, sent):
        said = gate.stub_model(probe, records, sent)
        return gate.Reply(said.text, said.value + 1, said.count, ())

    assert gate.converse(_client(spark), probes[:2], kinds, spellings, leaky)["leaks"] > 0
    failures = gate.converse(_client(spark), probes[:1], kinds, spellings, wrong)["failures"]
    assert len(failures) == 3 and "not recognised" in failures[1]
    page = json.loads(_client(spark).context_document("2026-05-01", "2026-05-31"))
    assert list(page) == ["balances", "records", "version", "window"] and len(page["records"]) == 3 and page["balances"][0]["account"] == "ACCT-1"


def test_warnings_ask_the_matcher(spark):
    known = lambda mentions: mentions.where("mention = 'Zorblx'")
    text = spark.createDataFrame([(1, "What about Zorblx, and Quintoria?"), (2, None)], "k int, t string")
    assert [r["surface"] for r in _client(spark, known).send(text, "k", "t")[1].collect()] == ["Quintoria"]
    surfaces = {r["surface"]: r["token"] for r in redact.surfaces(*[getattr(_client(spark), n) for n in ("raw", "mapping", "variants")]).collect()}
    assert surfaces["zorblax"] == "PAYEE-1" and surfaces["zorblax #12 sea"] == "PAYEE-1" and surfaces["quillbank"] == "INST-1"
