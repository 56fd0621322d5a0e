"""A session from files to answers: ingest, export, review, boundary, command line."""

from pyspark.sql import functions as F

from aliasframe import cli
from aliasframe.operators import aliases, projection
from aliasframe.plans import gate, ingest
from aliasframe.sources import statement


def test_from_files_to_answers(spark, tmp_path, capsys):
    statement.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/checking_2026-04.csv").write_text("Date,Description,Amount\n2026-04-01,ZORBLAX #12,-5.00\n2026-04-02,Zorblax 77,-2.50\nnever,x,1\n")
    (tmp_path / "in/checking_2026-05.csv").write_text("Date,Description,Amount\n2026-05-01,KUVENDA DRENSIL,-1.00\n2026-05-02,ZORBLAX #99,-1.00\n")
    where, key = str(tmp_path / "store"), ["--key", "k"]
    assert cli.main(["init", "--store", where, *key]) == 0 and cli.main(["status", "--store", where, "--key", "x"]) == 2
    assert cli.main(["ingest", "--store", where, *key, str(tmp_path / "in/checking_2026-04.csv")]) == 1
    store = ingest.open_store(spark, where, "k")
    first = {r["real_value"]: r["alias_token"] for r in store.read("alias_mapping").collect()}
    assert first == {"checking_2026-04": "ACCT-1", "Zorblax": "PAYEE-1"} | {k: v for k, v in first.items() if v == "INST-1"}
    summary = ingest.ingest(store, spark.read.format("statement").load(str(tmp_path / "in"))).collect()  # April comes again
    assert {r["source_file"][-11:-4]: (r["new_variants"], r["faulty"]) for r in summary} == {"2026-04": (0, 1), "2026-05": (2, 0)}
    again = {r["real_value"]: r["alias_token"] for r in store.read("alias_mapping").where("entity_type = 'PAYEE'").collect()}
    assert again == {"Zorblax": "PAYEE-1", "Kuvenda Drensil": "PAYEE-2"}
    assert store.read("raw_transactions").count() == 6
    assert cli.main(["export", "--store", where, *key, "--out", str(tmp_path / "out"), "--all-months"]) == 0
    assert cli.main(["payees", "--store", where, *key, "--merge", "PAYEE-1", "PAYEE-2"]) == 0
    assert cli.main(["payees", "--store", where, *key, "--merge", "PAYEE-1", "PAYEE-2"]) == 1
    assert cli.main(["payees", "--store", where, *key, "--review"]) == 0
    assert cli.main(["lens", "--store", where, *key, "spent at payee_2"]) == 0
    assert "spent at Zorblax" in capsys.readouterr().out
    assert [r["op"] for r in store.read("payee_journal").collect()] == ["merge"]
    tables = [store.read(t) for t in ("raw_transactions", "alias_mapping", "payee_variant")]
    client = gate.Client(*tables)
    sent, warned = client.send(spark.createDataFrame([(1, "What did Zorblax cost, and Quintoria?")], "id int, text string"), "id", "text")
    assert sent.first()["redacted"] == "What did PAYEE-1 cost, and Quintoria?" and [r["surface"] for r in warned.collect()] == ["Quintoria"]
    assert gate.falsify(client, "2026-04-01", "2026-05-31") == {"ok": True, "wrong": 0, "leaks": 0}
    # three seeded faults must each turn the gate red
    lost = gate.Client(tables[0], tables[1].where("entity_type <> 'ACCT'"), tables[2])
    assert gate.falsify(lost, "2026-04-01", "2026-05-31")["leaks"] > 0
    wrong = gate.Client(*tables)
    wrong.records = wrong.records.withColumn("amount_cents", F.col("amount_cents") + 1)
    assert gate.falsify(wrong, "2026-04-01", "2026-05-31")["wrong"] > 0
    talk = gate.falsify(gate.Client(*tables), "2026-04-01", "2026-05-31", spark.createDataFrame([("it was KUVENDA DRENSIL",)], "text string"))
    assert talk["leaks"] > 0
    assert projection.collapse_check(client.records, "account").where("collapsed").count() == 0
    assert aliases.review(tables[1], tables[2]).count() == 1
    (tmp_path / "note.txt").write_text("card 4111111111111111")
    assert cli.main(["lint", str(tmp_path / "note.txt")]) == 1
