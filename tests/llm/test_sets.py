"""Names, deduplication, packing, mixing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aliasframe.llm import dedupe, mixing, names, packing
from aliasframe.llm.tokens import VOCABULARY, encoder, with_tokens

SYL = "BA DREN KOR MI SU TAL VOR ZE LIN PO GAR FEN HU WIC".split()


def _word(r, k):
    return "".join(r.choice(SYL) for _ in range(k))


def _typo(r, w):
    i = r.randrange(1, len(w) - 1)
    return r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("AEOKLR") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]))


def _corpus(seed, n):
    r, out, seen = random.Random(seed), [], set()
    for k in range(n):
        if k % 3:
            a, b, trade = _word(r, 4), _word(r, 3), r.choice(("BAKERY", "AUTO REPAIR", "DENTAL CLINIC", "MARKET"))
            ways = [f"{a} {b} {trade}", f"POS DEBIT {a} {b} {trade}", f"{a}{b}.COM", f"SQ *{a} {b} #123", f"{a} {b} {trade} 1234 LARKMOOR MA", f"{b}, {a}", f"{a[0]}{names.skeleton(a[1:])} {b} {trade}", f"{trade} {a} {b}", f"{_typo(r, a)} {b}", f"{a}-{b} {trade}"]
        else:
            s, g = _word(r, 4), r.choice(("FREDERICK", "SUSANNAH", "KATARZYNA"))
            nick = {"FREDERICK": "FRED", "SUSANNAH": "SUSIE", "KATARZYNA": "KASIA"}[g]
            ways = [f"{g} {s}", f"{s}, {g}", f"{nick} {s}", f"ZELLE TO {g} {s}", f"{g[0]} {s}", f"{s}, {g[0]}.", f"DR {g} {s}", f"{g} M {s}", f"{g} {_typo(r, s)}"]
        for w in r.sample(ways, r.randint(1, 6)):
            if w not in seen:
                seen.add(w)
                out.append((k, w))
    return out


def test_linked_spellings(spark):
    corpus = _corpus(3, 240)
    df = spark.createDataFrame(corpus + [(999, None), (998, ""), (997, "12 #34"), (0, corpus[0][1])], "k int, name string").withColumn("entity", F.lit("clash")).withColumn("core", F.lit(1))
    got = {r["name"]: r["entity"] for r in names.link_names(df).collect()}
    assert len(got) == len(corpus) + 2 and got["12 #34"] == "?|12 #34"
    pairs = lambda label: {(a, b) for i, (a, x) in enumerate(label) for b, y in label[i + 1 :] if x == y}
    want, found = pairs([(w, k) for k, w in corpus]), pairs([(w, got[w]) for _, w in corpus])
    hit = len({frozenset(p) for p in want} & {frozenset(p) for p in found})
    assert hit / len(want) > 0.95 and hit / len(found) > 0.97
    assert names.link_names(df.limit(0)).count() == 0


def test_people_with_one_surname_stay_apart(spark):
    rows = ["ELEANOR KARVONE", "KARVONE, OSWALD", "E KARVONE", "EDWARD KARVONE", "O. KARVONE", "MR KARVONE", "BALORTO DRENSIL BAKERY", "BALORTO KUVENDA BAKERY", "BALORTO LARKMOOR MA", "BALORTO PELLWATER GA"]
    got = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame([(x,) for x in rows], "name string")).collect()}
    assert len({got["ELEANOR KARVONE"], got["KARVONE, OSWALD"], got["EDWARD KARVONE"], got["E KARVONE"], got["MR KARVONE"]}) == 5
    assert got["O. KARVONE"] == got["KARVONE, OSWALD"] and got["BALORTO DRENSIL BAKERY"] != got["BALORTO KUVENDA BAKERY"]


@pytest.mark.parametrize("surnames", [("KELKEALCASSU", "KELKELCASSU", "KELKELCCASSU"), ("QUINHALKELITA", "QUINHALKELTA", "QUUINHALKELTA")])
def test_a_spelling_between_two_others_links_both(spark, surnames):
    got = names.link_names(spark.createDataFrame([(f"PATRICIA {s}",) for s in surnames], "name string")).collect()
    assert len({r["entity"] for r in got}) == 1


def _noisy(seed, n):
    """Names of few words, so that many agree: misspelt, thinned, cut, with initials and bare surnames."""
    r, out = random.Random(seed), set()
    heads, tails, people = [_word(r, k) for k in (2, 2, 3, 4)], [_word(r, k) for k in (2, 3, 3, 4)], [_word(r, k) for k in (2, 3, 3)]
    change = lambda w: r.choice((w, w, names.skeleton(w), w[0] + names.skeleton(w[1:]), w[: r.randint(3, len(w))], _typo(r, w), _typo(r, _typo(r, w))))
    while len(out) < n:
        words = [change(r.choice(heads)), change(r.choice(tails)), *([change(r.choice(tails))] if r.random() < 0.2 else [])]
        s = r.choice((people[0], _typo(r, r.choice(people)), r.choice(people)))
        g = r.choice(("PETER", "PETRE", "PAULA", "PAUL", "XAVIER", "XAVER"))
        out.add(r.choice((" ".join(words), "".join(words), f"{words[0]} {words[1]} MARKET", f"ZELLE TO {g} {s}", f"{g} {s}", f"{g[0]} {s}", f"{r.choice('PXAQ')} {s}", f"MR {s}")))
    return sorted(out)


def test_names_that_agree_share_a_rewriting():
    cores = {c.key(): c for n in _noisy(5, 700) if (c := names.read_name(n)) is not None and not c.vague}
    forms, agreeing = {k: names.rewritings(c) for k, c in cores.items()}, 0
    for a, x in cores.items():
        for b, y in cores.items():
            assert names.same_name(x, y) == names.same_name(y, x)
            if a < b and names.same_name(x, y):
                agreeing += 1
                assert forms[a] & forms[b], (a, b)
    assert agreeing > 500


def test_entities_are_those_of_all_pairs(spark):
    noisy = _noisy(8, 160)
    got = names.link_names(spark.createDataFrame([(n,) for n in noisy], "name string")).collect()
    want = names.group_entities({r["core"] for r in got})
    assert {r["core"]: r["entity"] for r in got} == want and 5 < len(set(want.values())) < 150


def test_a_rewriting_shared_by_many_still_links(spark):
    word = "BALORTODRENSIL"
    rows = [f"{word[:i]}{c}{word[i:]} KORVANMISU" for i in range(2, 14) for c in "BCDFGHKLMNPR"]
    got = names.link_names(spark.createDataFrame([(x,) for x in rows], "name string")).collect()
    assert len(got) > 128 and len({r["entity"] for r in got}) == 1


def test_rows_whose_form_stands_alone_are_passed_over():
    import pyarrow as pa

    r = random.Random(4)
    for size in (1, 2, 3, 7, 100):
        rows = sorted((r.choice("abcdefghijklmnopqrst"), str(i)) for i in range(r.randint(0, 25)))
        batches = [pa.RecordBatch.from_pydict({"form": [x for x, _ in rows[i : i + size]], "core": [y for _, y in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        got = [(f, c) for forms, cores in names._shared(batches) for f, c in zip(forms, cores, strict=True)]
        assert got == [x for x in rows if sum(y[0] == x[0] for y in rows) > 1]


@pytest.mark.parametrize("hot", [256, 3])
def test_links_of_names_that_begin_alike(spark, hot):
    r = random.Random(21)
    tails = [_word(r, k) for k in (2, 3, 3, 4, 4)]
    cut = lambda w: r.choice((w, w[: r.randint(3, len(w))], names.skeleton(w), _typo(r, w)))
    spelt = sorted({f"{r.choice(('BALORTO', 'BALORTO', 'BALRTO'))} {cut(r.choice(tails))}{r.choice(('', '', ' ' + _word(r, 2)))}" for _ in range(260)})
    cores = sorted({c.key() for n in spelt if (c := names.read_name(n)) is not None and not c.vague})
    found = names.links(spark.createDataFrame([(c, "") for c in cores], "core string, grp string"), hot).collect()
    label = names._least(cores, ((x["a"], x["b"]) for x in found))
    want = names._least(cores, ((a, b) for i, a in enumerate(cores) for b in cores[i + 1 :] if names.same_name(names.Core.of(a), names.Core.of(b))))
    assert label == want and len(set(want.values())) > 3 and all(x["score"] > 0 and names.same_name(names.Core.of(x["a"]), names.Core.of(x["b"])) for x in found)


def test_many_people_of_one_surname(spark):
    first = [a + b for a in ("BAL", "DRE", "FIN", "GOR", "HUL", "JAS", "KEM", "LOR", "MIV", "NUP") for b in ("ANA", "EMO", "IRU", "OLE", "UDA", "ASK", "EVI", "INT", "ORB", "UXE")]
    people = [f"ZELLE TO {a}{b} KARVONE" for a in first for b in first[::4]]
    got = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame([(p,) for p in people], "name string")).collect()}
    cores = {n: names.read_name(n) for n in people}
    want = names._least(people, ((x, y) for i, x in enumerate(people[:150]) for y in people[i + 1 : 150] if names.same_name(cores[x], cores[y])))
    assert len(got) == len(people) == 2500 and len(set(got.values())) > 1500
    assert all((got[x] == got[y]) >= (want[x] == want[y]) for i, x in enumerate(people[:150]) for y in people[i + 1 : 150])


@settings(max_examples=200, deadline=None)
@given(st.text("ABC", max_size=6), st.text("ABC", max_size=6))
def test_one_error_against_brute_force(a, b):
    near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ABC"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ABC"}
    near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert names.within_one(a, b) == (b in near)


def _plain_fold(rows, same):
    accepted, out = [], {}
    for id_, acct, cents, payee, batch, day in sorted(rows, key=lambda r: (r[4], r[0])):
        near = [a for a in accepted if a[1] == acct and a[2] == cents and abs(a[5] - day) <= 3 and a[4] < batch and same(a[3], payee)]
        if near:
            out[id_] = min(a[0] for a in near)
        else:
            accepted.append((id_, acct, cents, payee, batch, day))
    return out


ROWS = "id long, account_id string, amount_cents long, payee string, batch_id long, day int"


def _rows(seed, n, hot):
    r = random.Random(seed)
    payees = ["KORVANDREN TALMISU BAKERY", "SQ *KORVANDREN TALMISU", "GARFENHU ZELINPO MARKET", "PETER WICKORMI", "WICKORMI, PETER"]
    out = []
    for i in range(1, n + 1):
        hit = r.random() < hot
        out.append((i, "A" if hit else r.choice("ABC"), 500 if hit else r.choice((500, 700)), r.choice(payees), i // (n // 12 + 1) + 1, r.randint(1, 40)))
    return out


def _same(a, b):
    return names.same_name(names.read_name(a), names.read_name(b))


@pytest.mark.parametrize("few", [24, 1])
def test_repeats_against_a_plain_fold(spark, few):
    for seed in (1, 2):
        rows = _rows(seed, 260, 0.4)
        got = {r["id"]: r["first_id"] for r in dedupe.repeats(spark.createDataFrame(rows, ROWS), few=few).collect()}
        assert got == _plain_fold(rows, _same)
    assert dedupe.repeats(spark.createDataFrame([], ROWS)).count() == 0


def test_entities_of_a_session_do_not_depend_on_its_size(spark):
    noisy = [*_noisy(9, 120), "12 #34", "56 #7", "LGRZLR GOF", "LUGARZELOR GOFAVAN"]
    df = spark.createDataFrame([(5, day, p) for day in (1, 2) for p in (noisy if day == 1 else noisy[::2])], "key long, session int, payee string")

    def parts(few):
        out: dict = {}
        for r in dedupe.entities(df, few).collect():
            out.setdefault((r["session"], r["entity"]), set()).add(r["payee"])
        return sorted((k[0], sorted(v)) for k, v in out.items())

    small = parts(1000)
    assert small == parts(1) and any({"LGRZLR GOF", "LUGARZELOR GOFAVAN"} <= set(v) for _, v in small)


def test_an_initial_of_two_people_joins_neither_in_a_small_session():
    rows = ["E KARVONE", "EDWARD KARVONE", "ELEANOR KARVONE", "KARVONE, OSWALD", "O. KARVONE"]
    assert dedupe._label(rows) == [*rows[:4], "KARVONE, OSWALD"]


def test_history_admits_batch_by_batch(spark, tmp_path):
    rows = _rows(7, 120, 0.3)
    history, got = dedupe.History(spark, str(tmp_path / "h"), buckets=4), {}
    batches = sorted({r[4] for r in rows})
    for b in batches[:2]:
        got |= {r["id"]: r["first_id"] for r in history.admit(spark.createDataFrame([r for r in rows if r[4] == b], ROWS)).collect()}
    for part in (batches[2:7], batches[7:]):  # several batches in one delivery
        got |= {r["id"]: r["first_id"] for r in history.admit(spark.createDataFrame([r for r in rows if r[4] in part], ROWS)).collect()}
    assert got == _plain_fold(rows, _same)
    assert spark.read.parquet(str(tmp_path / "h")).count() == len(rows) - len(got)


def test_prepare_leaves_out_what_cannot_repeat(spark):
    banks = spark.createDataFrame([("Bank", "BK", "America/New_York")], "institution string, account_prefix string, time_zone string")
    raw = spark.createDataFrame([(1, "BK-1", "Bank", "2025-01-01 22:00", "a  b", 5, 1), (2, "BK-1", None, "2025-01-02", "A B", 5, 2), (3, "BK-1", None, "never", "A B", 5, 3), (4, "BK-1", None, "2025-01-02", " ", 5, 3), (5, None, None, "2025-01-02", "A B", 5, 3), (6, "BK-1", None, "2025-01-02", None, None, 3)], "id long, account_id string, institution string, posted_date string, raw_payee string, amount_cents long, batch_id long").withColumn("ingested_at", F.lit("2025-02-01").cast("timestamp")).withColumn("day", F.lit("clash"))
    got = {r["id"]: (r["payee"], r["day"]) for r in dedupe.prepare(raw, banks).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and got[1][0] == "A B"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 8))
def test_packer_keeps_every_item(sizes, windows):
    p, closed = packing.Packer(50, windows), []
    for i, s in enumerate(sizes):
        closed += p.add(s, [(i, s)])
        assert len(p.room) <= windows
    closed += p.rest()
    assert sorted(i for _, items in closed for i, _ in items) == list(range(len(sizes)))
    assert all(fill == sum(s for _, s in items) <= 50 for fill, items in closed)


def test_packing_table(spark):
    r = random.Random(4)
    sizes = [(i, r.choice((0, r.randint(1, 300), r.randint(1, 300), 2048, 5000))) for i in range(1500)]
    df = spark.createDataFrame(sizes + [(9999, None)], "doc_id long, tokens long").withColumn("fill", F.lit("clash")).repartition(6)
    got = packing.pack(df).collect()
    total = sum(s for _, s in sizes)
    assert sum(c["fill"] for c in got) == total and max(c["fill"] for c in got) <= 2048 and len({c["container_id"] for c in got}) == len(got)
    assert len(got) <= total / 2048 * 1.03 + 2
    by: dict = {}
    for c in got:
        assert c["fill"] == sum(i["tokens"] for i in c["items"])
        for i in c["items"]:
            by.setdefault(i["doc_id"], []).append((i["piece_no"], i["first_token"], i["tokens"]))
    for doc, size in sizes:
        parts = sorted(by.get(doc, []))
        assert sum(p[2] for p in parts) == size and len(parts) == -(-size // 2048)
    assert packing.pack(df.limit(0)).count() == 0


def test_mixing_shares_and_caps(spark):
    r = random.Random(6)
    docs = [(i, r.choice(("big", "big", "big", "mid", "tiny")), r.randint(0, 60)) for i in range(3000)] + [(5000, None, 9), (5001, "other", 9), (5002, "mid", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("position", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("tiny", 0.2, 3), ("absent", 0.1, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, targets, {"big": (0.5, 1.5)})
    rows, plan = chosen.collect(), {p["source"]: p for p in report.collect()}
    assert [x["position"] for x in rows] == sorted(x["position"] for x in rows) and 0 <= rows[0]["position"] and rows[-1]["position"] <= 1
    for name, share in (("big", 5 / 9), ("mid", 2 / 9), ("tiny", 2 / 9)):
        assert abs(plan[name]["reached_share"] - share) < 0.004
    uses: dict = {}
    for x in rows:
        uses[x["doc_id"]] = uses.get(x["doc_id"], 0) + 1
        assert x["source"] in ("big", "mid", "tiny")
    kind = {d: s for d, s, _ in docs}
    assert all(n <= {"big": 1, "mid": 2, "tiny": 3}[kind[d]] for d, n in uses.items())
    assert plan["absent"]["used_tokens"] == 0 and plan["other"]["demand"] == 0
    early = sum(x["tokens"] for x in rows if x["source"] == "big" and x["position"] < 0.5)
    assert early / plan["big"]["used_tokens"] == pytest.approx(0.375, abs=0.02)
    empty, report = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and report.where("used_tokens > 0").count() == 0
    capped = {p["source"]: p for p in mixing.mix(df, targets, {}, total=10**7)[1].collect()}
    assert capped["tiny"]["most_uses"] == 3 and capped["tiny"]["used_tokens"] == 3 * capped["tiny"]["available"]


def test_mixing_few_large_documents(spark):
    docs = [(1, "few", 344), (2, "few", 1381), (3, "few", 1635), *((10 + i, "many", 7 + i % 40) for i in range(2000)), *((9000 + i, "huge", s) for i, s in enumerate((19000, 12000, 800, 750, 400, 90, 60, 45)))]
    targets = spark.createDataFrame([("few", 0.05, 1), ("many", 0.9, 1), ("huge", 0.05, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, tokens long"), targets, total=30_000)
    rows, plan = chosen.collect(), {p["source"]: p for p in report.collect()}
    assert all(abs(p["used_tokens"] - p["demand"]) <= (0.004 * p["demand"] if p["source"] == "many" else 120) for p in plan.values()) and len({x["doc_id"] for x in rows}) == len(rows)
    assert not any(p["sets_size"] for p in plan.values())


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no test tables here")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_shares_of_the_test_tables(spark, size):
    from aliasframe.llm.queries import p9_shares

    assert all(abs(p["wanted_share"] - p["reached_share"]) < 0.01 for p in p9_shares(spark, f"/root/testdata/{size}").collect())


@pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary here")
def test_token_sizes(spark):
    code = encoder()
    texts = ["Payees & tokens: 12.50 EUR\n\n", "naïve café", "<|endoftext|>", "x" * 5000]
    assert all(code.decode(code.encode_ordinary(t)) == t for t in texts)
    df = spark.createDataFrame([*enumerate(texts), (8, None), (9, "")], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(df, ["doc_id"]).collect()}
    assert got == {**{i: len(code.encode_ordinary(t)) for i, t in enumerate(texts)}, 8: 0, 9: 0}
