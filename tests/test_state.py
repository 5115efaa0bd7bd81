import itertools
import random

from pyspark.sql import functions as F

from ledgerloom.operators import audit, claims, expected
from ledgerloom.operators.reconciliation import decided

CLAIMS = "sheet_id string, subject string, source string, decision string"


def withdrawable(rows, status, exact):
    """Every decision on every row: what would the claims be without it?"""
    out = set()
    for sheet, decision in {(r[0], r[3]) for r in rows if r[3]}:
        mine = [r for r in rows if r[3] == decision]
        if {r[0] for r in mine} != {sheet} or len({r[1] for r in mine}) != 1 or len({r[3] for r in rows if r[0] == sheet and r[3]}) != 1 or len({r[1] for r in rows if r[0] == sheet}) != 2:
            continue
        loser, left = mine[0][1], [r for r in rows if r not in mine]
        owners = {r[1] for r in left if r[0] == sheet}
        if loser in owners or len(owners) != 1:
            continue
        winner = owners.pop()
        firm = lambda who, row: any(r[:3] == (row, who, "CURRENT") for r in left) and not any(r[:3] == (row, who, "GROUP") for r in left) and (who, row) in exact
        if not firm(winner, sheet):
            continue
        others = sorted(r[0] for r in left if r[1] == loser and r[0] != sheet and firm(loser, r[0]) and {x[1] for x in left if x[0] == r[0]} == {loser})
        if others or status.get(decision) == "STALE":
            out.add((sheet, decision, loser, winner, others[0] if others else None))
    return out


def test_safe_invalidations_against_what_would_be(spark):
    total = 0
    for seed in range(3):
        draw = random.Random(seed)
        rows = set()
        for n in range(150):
            source = draw.choice(("DECISION", "CURRENT", "CURRENT", "GROUP"))
            rows.add((f"s{draw.randrange(60)}", f"p{draw.randrange(40)}", source, f"d{draw.choice((n, n, n, n // 2))}" if source == "DECISION" else None))
        owner = {}
        rows = [r for r in sorted(rows, key=str) if r[3] is None or owner.setdefault(r[3], r[1]) == r[1]]
        status = {r[3]: draw.choice(("STALE", "VALID")) for r in rows if r[3]}
        exact = {(r[1], r[0]) for r in rows if draw.random() < 0.8}
        got = claims.safe_invalidations(spark.createDataFrame(rows, CLAIMS), spark.createDataFrame(list(status.items()), "decision string, status string"), spark.createDataFrame(sorted(exact), "subject string, sheet_id string"))
        want = withdrawable(rows, status, exact)
        assert {(r.sheet_id, r.decision, r.obsolete, r.winner, r.separate_id) for r in got.collect()} == want
        total += len(want)
    assert total > 5


def test_claim_conflicts_of_empty_and_null_claims(spark):
    none = spark.createDataFrame([(None, "a", "CURRENT", None), (None, "b", "CURRENT", None), ("s", "a", "CURRENT", None), ("s", "a", "DECISION", "d")], CLAIMS)
    assert claims.claim_conflicts(none).count() == 0
    shared = spark.createDataFrame([("s", "g1", "GROUP", None), ("s", "g2", "GROUP", None), ("t", "a", "CURRENT", None), ("t", "b", "DECISION", "d")], CLAIMS)
    assert sorted(map(tuple, claims.claim_conflicts(shared).collect())) == [("s", 2, 0, "INFO", False), ("t", 2, 2, "CRITICAL", True)]


def test_bank_states_are_explained(spark):
    from datetime import date

    bank = spark.createDataFrame([(i, date(2026, 1, 5), a, "DEBIT", True, "EXPENSE", "pix enviado", None, "Pix") for i, a in (("b1", 100), ("b2", 100), ("b3", 300), ("b4", 400))], "id string, date date, amount long, direction string, direction_known boolean, type string, original_description string, counterparty_name string, payment_method string")
    ledger = spark.createDataFrame([(i, n, date(2026, 1, 5), a, "DEBIT", "EXPENSE", "x", "x", "Pix") for n, (i, a) in enumerate((("s1", 100), ("s3", 300)))], "id string, row_idx long, date date, amount long, direction string, type string, original_description string, description string, payment_method string")
    made = decided(spark, confirmed=spark.createDataFrame([("b2", "s1", 1)], "bank_id string, sheet_id string, place long"), rejected=spark.createDataFrame([("b3", "s3", "k")], "bank_id string, sheet_id string, decision_key string"))
    current = bank.select(F.col("id").alias("subject"), F.lit("MISSING").alias("status"))
    states = expected.bank_expected(bank, ledger, made, current)
    got = {r.subject: (r.expected, [s.stage for s in r.chain], r.chain[-1].outcome, r.target) for r in states.collect()}
    assert got["b2"] == ("MATCHED", ["PURE_MATCHING", "DECISION", "FINAL_ASSIGNMENT"], "MATCHED", "s1")
    assert got["b3"] == ("MISSING", ["PURE_MATCHING", "DECISION", "FINAL_ASSIGNMENT"], "MISSING", None) and got["b4"][1] == ["PURE_MATCHING", "FINAL_ASSIGNMENT"]
    assert got["b1"][:2] == ("REVIEW", ["PURE_MATCHING", "RESERVATION", "FINAL_ASSIGNMENT"]) and expected.unexplained(states).count() == 0


FINDING = "code string, severity string, invariant string, subject string, root_cause string, target map<string,array<string>>, technical map<string,array<string>>, impact string, current string, expected string, identity string, comparable boolean"


def test_signatures_see_matter_only(spark):
    base = {"code": "A", "severity": "REVIEW", "invariant": "I", "subject": "s", "root_cause": "c", "target": {"selected": ["x", "y"], "sheetIdentity": ["r"]}, "technical": {"row": ["1"], "index": ["3"]}, "impact": None, "current": "M", "expected": "M", "identity": "CANONICAL", "comparable": True}
    same = [{"target": {"sheetIdentity": ["r"], "selected": ["y", "x"], "updatedAt": ["now"]}}, {"technical": {"index": ["9"], "row": ["2"]}}, {"impact": "LOW"}, {"severity": "INFO"}, {"technical": {"row": ["1"], "note": ["x"]}}]
    worse = [{"severity": "CRITICAL"}, {"root_cause": "d"}, {"impact": "CRITICAL"}, {"expected": "N"}, {"identity": "HEURISTIC"}, {"technical": {}}, {"technical": {"row": ["1"], "decisionId": ["d"]}}, {"comparable": False}, {"technical": {"row": ["1"], "candidateEvaluations": []}}]
    elsewhere = [{"subject": "t"}, {"target": {"selected": ["x"]}}, {"code": "B"}, {"invariant": "J"}, {"target": {}}]
    names = [c.split()[0] for c in FINDING.split(", ")]
    rows = [tuple((base | change)[n] for n in names) for change in ({}, *same, *worse, *elsewhere)]
    all_ = audit.signed(spark.createDataFrame(rows, FINDING).coalesce(1).withColumn("n", F.monotonically_increasing_id()))
    saved = all_.filter("n = 0").select("key", "severity", "signature", F.lit("2026").alias("dismissed_at"))
    visible = [r.visible for r in audit.dismissed(all_, saved).orderBy("n").collect()]
    assert visible == [False] * (1 + len(same)) + [True] * (len(worse) + len(elsewhere))
    bare = audit.dismissed(all_, saved.withColumn("signature", F.lit(None).cast(saved.schema["signature"].dataType))).orderBy("n").collect()
    assert [r.visible for r in bare][: 1 + len(same) + len(worse)] == [False] * (1 + len(same)) + [True] + [False] * (len(worse) - 1)
    assert len({r.key for r in all_.collect()}) == 1 + len(elsewhere) and len(list(itertools.chain(same, worse))) == 14


def test_safe_invalidations_write_only_claims_that_matter(spark, monkeypatch):
    written = []
    monkeypatch.setattr(claims, "cut", lambda df: written.append(df.count()) or df, raising=False)
    held = [("r", "a", "DECISION", "d"), ("r", "b", "CURRENT", None), ("q", "a", "CURRENT", None), *((f"x{k}", s, "CURRENT", None) for k in range(20) for s in "ab")]
    table = spark.createDataFrame(held, "sheet_id string, subject string, source string, decision string")
    valid = spark.createDataFrame([("d", "VALID"), ("d", "VALID")], "decision string, status string")
    out = claims.safe_invalidations(table, valid, table.select("subject", "sheet_id"))
    assert [tuple(r) for r in out.select("sheet_id", "decision", "obsolete", "winner", "separate_id", "decision_status").collect()] == [("r", "d", "a", "b", "q", "VALID")]
    assert written == [3]
