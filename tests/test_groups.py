import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import text
from ledgerloom.functions.similarity import similarity
from ledgerloom.operators import cards, groups, links
from ledgerloom.plans.shared import cut

SF = "/root/testdata/sf0.001"


def test_subset_sums_against_enumeration():
    draw = random.Random(4)
    for _ in range(80):
        amounts = [draw.randint(1, 12) for _ in range(draw.randint(0, 8))]
        target = draw.randint(1, 30)
        want = {c for n in range(1, len(amounts) + 1) for c in itertools.combinations(range(len(amounts)), n) if sum(amounts[i] for i in c) == target}
        found, limited = groups.subset_sums(amounts, target)
        assert set(found) == want and not limited
    assert groups.subset_sums([1] * 20, 10, nodes=100)[1]


def test_both_similarities_agree(spark):
    words = ["mercado", "mercadolivre", "posto", "pos", "farmacia", "frmci", "a", "uber", "super mercado", "supermercado bom"]
    pairs = [(f"{a} {c}", b) for a in words for b in words for c in ("sul", "livre")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.description_similarity(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == pytest.approx(similarity(r.a, r.b)) for r in df.collect())


def test_duplicates_keep_to_their_anchor(spark):
    rows = [("r1", 1, "padaria central"), ("r2", 2, "padaria central ltda"), ("r3", 3, "outra coisa"), ("r4", 4, None)]
    df = spark.createDataFrame(rows, "id string, row_idx int, description string").select("*", F.lit("2026-01-01").cast("date").alias("date"), F.lit(5).cast("long").alias("amount"))
    assert [(r.anchor_id, r.ids) for r in groups.ledger_duplicates(df).collect()] == [("r1", ["r1", "r2"])]


def test_duplicates_of_a_repeated_id_keep_to_their_text(spark):
    rows = [("r1", 1, "padaria central"), ("r2", 2, "padaria central"), ("r1", 1, "outra coisa"), ("r3", 3, "outra coisa"), ("r4", 4, "posto"), ("r4", 4, "farmacia")]
    df = spark.createDataFrame(rows, "id string, row_idx int, description string").select("*", F.lit("2026-01-01").cast("date").alias("date"), F.lit(5).cast("long").alias("amount"))
    assert sorted((r.anchor_id, r.ids) for r in groups.ledger_duplicates(df).collect()) == [("r1", ["r1", "r2"]), ("r1", ["r1", "r3"])]
    assert sorted(r.id for r in groups.duplicate_members(df).collect()) == ["r1", "r1", "r2", "r3"]


def test_compositions_add_up(spark):
    out = catalog.card_compositions(spark, SF).collect()
    cents = {str(r.o_orderkey): int(r.o_totalprice * 100 + 0.5) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    sums = {}
    for r in out:
        if r.ids:
            sums.setdefault(r.bill_id, set()).add(sum(cents[i] for i in r.ids.split(",")))
    assert sums and all(len(s) == 1 for s in sums.values()) and {r.status for r in out} <= {"REVIEW", "NO_MATCH", "LIMITED"}
    assert len(out) >= spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()


def test_things_wanted_by_single_wishes_need_no_rounds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(links, "cut", lambda df: kept.append(1) or cut(df))
    schema = "claim string, place int, id string, fixed boolean"
    held = lambda rows: {r.claim for r in links.first_claims(spark.createDataFrame(rows, schema)).collect()}
    assert held([("a", 1, "x", False), ("b", 2, "x", False), ("c", 2, "x", True), ("d", 3, "y", False), ("e", 3, "y", False), ("f", 4, None, False)]) == {"a", "c", "d", "e"}
    assert len(kept) == 1
    # "b" wants two things, so "x" and "y" take rounds: "b" falls by "a" and leaves "y" to "c".
    assert held([("a", 1, "x", False), ("b", 2, "x", False), ("b", 2, "y", False), ("c", 3, "y", False), ("d", 9, "z", False)]) == {"a", "c", "d"}


def test_alike_invoices_settle_as_one_by_one(spark):
    rng = random.Random(5)
    day = lambda: datetime.date(2026, 1, 1) + datetime.timedelta(rng.randrange(25))
    owed = [(k, day(), rng.randrange(6)) for k in range(160)] + [(1000, None, 3)]
    paid = [(k, day(), rng.randrange(6), "CARD_PAYMENT" if k % 9 else "EXPENSE") for k in range(140)]
    options = {s: [(abs((d - due).days), abs(a - total), d, p) for p, d, a, kind in paid if kind == "CARD_PAYMENT" and due and abs((d - due).days) <= 7 and abs(a - total) <= 1] for s, due, total in owed}
    want, used = {}, set()
    for s, due, _ in sorted((r for r in owed if options[r[0]]), key=lambda r: (len(options[r[0]]), r[1], str(r[0]))):
        free = [o for o in sorted(options[s]) if o[3] not in used]
        if free:
            want[s] = free[0][3]
            used.add(free[0][3])
    invoices, bank = spark.createDataFrame(owed, "statement long, due_date date, total long"), spark.createDataFrame(paid, "id long, date date, amount long, type string")
    assert {r.statement: r.bank_id for r in cards.settled(invoices, bank).collect()} == want
    # Copies of one invoice and one payment are one class each: no pair of rows is formed.
    many = spark.range(3000).selectExpr("id as statement", "date'2026-01-05' as due_date", "7L as total"), spark.range(2000).selectExpr("id", "date'2026-01-05' as date", "7L as amount", "'CARD_PAYMENT' as type")
    assert cards.settled(*many).count() == 2000


def test_parts_of_invoices_are_settled_many_at_a_time(spark):
    apart = spark.range(400).selectExpr("id", "date_add(date'2026-01-05', cast(id * 20 as int)) as day")
    out = cards.settled(apart.selectExpr("id as statement", "day as due_date", "7L as total"), apart.selectExpr("id", "day as date", "7L as amount", "'CARD_PAYMENT' as type"))
    assert out.filter("statement = bank_id").count() == out.count() == 400
    keys = re.search(r"FlatMapCoGroupsInPandas \[([a-z_]+)#", out._jdf.queryExecution().executedPlan().toString())
    assert keys and keys[1] == "lot"


def test_bills_are_searched_many_at_a_time(spark):
    day = datetime.date(2026, 1, 31)
    bills = spark.createDataFrame([(f"b{n}", n, day, 30 + n) for n in range(3)], "bill_id string, account int, date date, amount long")
    costs = spark.createDataFrame([(f"c{n}-{c}", n, datetime.date(2026, 1, c), c + (c == 20) * n) for n in range(3) for c in (10, 20)], "id string, account int, date date, amount long")
    out = groups.card_compositions(bills, costs)
    assert [(r.bill_id, r.status, r.candidates, r.ids) for r in out.orderBy("bill_id").collect()] == [(f"b{n}", "REVIEW", 2, [f"c{n}-10", f"c{n}-20"]) for n in range(3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
