"""Rows that are alike are matched as classes: as many pairs as before, work by distinct rows."""

import datetime

import numpy as np

from ledgerloom.operators import guard, matching, reconciliation, solver

DAY = datetime.date(2024, 1, 5)


def test_flows_equal_the_assignment_of_the_single_rows():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n, m = rng.integers(1, 5, 2)
        weights = np.where(rng.random((n, m)) < 0.7, rng.integers(55, 64, (n, m)), 0)
        supply, room = rng.integers(1, 4, n) * rng.integers(0, 2, n) + 1, rng.integers(1, 4, m) * rng.integers(0, 2, m) + 1
        rows, columns = np.nonzero(weights)
        if not len(rows):
            continue
        found = solver.flows(solver.graph(rows, columns, weights[rows, columns], n, m), supply, room)
        single = np.repeat(np.repeat(weights, supply, 0), room, 1)
        total = solver.solve(single)[0]
        assert sum(weights[i, j] * k for i, j, k, _ in found) == total
        for i, j, _, margin in found:
            without = single.copy()
            without[supply[:i].sum(), room[:j].sum()] = 0
            assert margin == total - solver.solve(without)[0]


def _rows(spark, banks, sheets):
    bank = spark.createDataFrame([(f"b{k:04}", DAY, 100, "DEBIT", True, "EXPENSE", "pix enviado", None, "Pix") for k in range(banks)], "id string, date date, amount long, direction string, direction_known boolean, type string, original_description string, counterparty_name string, payment_method string")
    ledger = spark.createDataFrame([(f"s{k:04}", DAY, 100, "EXPENSE", "padaria", "Pix") for k in range(sheets)], "id string, date date, amount long, type string, original_description string, payment_method string")
    return bank, ledger


def test_copies_make_one_edge_and_every_pair(spark):
    bank, ledger = _rows(spark, 700, 600)
    alike = matching.alike_edges(bank, ledger)
    assert alike.edges.count() == 1
    pairs = matching.candidate_edges(bank, ledger)
    assert pairs.count() == pairs.select("bank_id", "sheet_id").distinct().count() == 700 * 600
    for found in (matching.assignment_of(alike), matching.assignment(pairs)):
        rows = found.collect()
        assert {r.bank_id for r in rows} == {f"b{k:04}" for k in range(600)} and len({r.sheet_id for r in rows}) == len(rows) == 600
        assert {(r.margin, r.ambiguous, r.matched) for r in rows} == {(0, True, False)}


def test_reconciling_copies_settles_them_by_class_and_lists_every_pair(spark):
    bank, ledger = _rows(spark, 30, 20)
    ledger = ledger.selectExpr("*", "0L as row_idx", "'DEBIT' as direction", "id as description")
    refused = spark.createDataFrame([("b0000", f"s{k:04}", f"k{k}") for k in range(20)], reconciliation.SCHEMAS["rejected"])
    out = reconciliation.reconcile(bank, ledger, reconciliation.decided(spark, rejected=refused))
    assert "candidates" not in out.settled.columns
    rows = {r.bank_id: r for r in out.items.collect()}
    assert rows["b0000"].status == "MISSING" and {r.status for b, r in rows.items() if b != "b0000"} == {"REVIEW"}
    assert all(len(r.candidates) == 20 for b, r in rows.items() if b != "b0000")
    assert sum(r.review_reason == "ASSIGNMENT_CONFLICT" for r in rows.values()) == 9
    assert out.trace.filter("disposition = 'REJECTED_BY_DECISION'").count() == 20 and out.trace.count() == 600


def test_guard_tells_other_holders_without_listing_them(spark):
    bank, ledger = _rows(spark, 2, 3)
    taken = spark.createDataFrame([("s0000", "b0000"), ("s0001", "b0000"), ("s0001", "b0001"), ("s0002", None)], "sheet_id string, bank_id string")
    out = guard.bank_guard(bank.selectExpr("id as bank_id"), bank, ledger, taken=taken)
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.bank_id: (r.candidates, r.free, r.best_id) for r in out.collect()} == {"b0000": (3, 2, "s0000"), "b0001": (3, 1, "s0002")}


def test_refunds_of_one_day_and_amount_are_listed_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(matching, "cut", lambda df: written.append(df.count()) or df)
    schema = "id string, date date, amount long, direction string, type string, original_description string"
    later = DAY + datetime.timedelta(2)
    debits = [(f"d{k}", DAY, 100, "DEBIT", "EXPENSE", "pix enviado") for k in range(4)] + [("e", DAY, 70, "DEBIT", "EXPENSE", "pix enviado")]
    refunds = [(f"r{k}", later, 100, "CREDIT", "REFUND", "") for k in range(5)] + [("q", later, 60, "CREDIT", "REFUND", "")]
    rows = {r.refund_id: (r.status, r.original_ids, r.gross, r.net) for r in matching.refund_groups(spark.createDataFrame(debits + refunds, schema)).collect()}
    assert rows == {**{f"r{k}": ("REVIEW", ["d0", "d1", "d2", "d3"], None, None) for k in range(5)}, "q": ("PARTIAL", ["e"], 70, 10)}
    assert written == [1]


def test_refused_groups_equal_their_pairs_and_settling_forms_no_pairs(spark, monkeypatch):
    bank, ledger = _rows(spark, 30, 20)
    ledger = ledger.selectExpr("*", "0L as row_idx", "'DEBIT' as direction", "id as description")
    group = lambda rows, key: rows.selectExpr(f"id as {key}_id", f"cast(substr(id, 2) as long) % 3 as {key}_group")
    refused = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1)], reconciliation.SCHEMAS["refused_groups"])
    by_group = reconciliation.decided(spark, bank_groups=group(bank, "bank"), sheet_groups=group(ledger, "sheet"), refused_groups=refused)
    pairs = group(bank, "bank").join(refused, "bank_group").join(group(ledger, "sheet"), "sheet_group").selectExpr("bank_id", "sheet_id", "concat_ws('/', bank_id, sheet_id) as decision_key")
    formed, cut = [], reconciliation.cut

    def counted(df):
        kept = cut(df)
        formed.append(kept.count())
        return kept

    monkeypatch.setattr(reconciliation, "cut", counted)
    one = reconciliation.reconcile(bank, ledger, by_group)
    assert max(formed) == 30
    monkeypatch.undo()
    other = reconciliation.reconcile(bank, ledger, reconciliation.decided(spark, rejected=pairs))
    # Ledger rows of two groups may be refused for the same bank rows, so equal optima may fall otherwise.
    told = lambda out: (sorted((r.bank_id, r.status, [c.sheet_id for c in r.candidates or []]) for r in out.items.collect()), sorted((r.bank_id, r.sheet_id, r.decision_key or "") for r in out.trace.collect()), {(r.bank_id, r.disposition) for r in out.answers.collect()}, out.unmatched.count())
    assert told(one) == told(other)
    assert one.trace.count() == 600 and one.trace.filter("disposition = 'REJECTED_BY_DECISION'").count() == pairs.count() == 270
    assert {r.status for r in one.items.collect() if int(r.bank_id[1:]) % 3 == 0} == {"MISSING"} and {int(r.bank_id[1:]) % 3 for r in one.answers.collect()} == {1, 2}


def test_roles_of_refunds_need_no_lists(spark):
    schema = "id string, date date, amount long, direction string, type string, original_description string"
    later = DAY + datetime.timedelta(2)
    debits = [(f"d{n}-{k}", DAY, n, "DEBIT", "EXPENSE", "pix enviado") for n, copies in ((100, 3), (200, 1), (300, 1), (70, 1)) for k in range(copies)]
    refunds = [(f"r{n}-{k}", later, n, "CREDIT", "REFUND", "") for n, copies in ((100, 1), (200, 1), (300, 2), (60, 1)) for k in range(copies)]
    cases = matching.refund_cases(spark.createDataFrame(debits + refunds, schema))
    assert "collect_list" not in matching.refund_roles(cases)._jdf.queryExecution().optimizedPlan().toString()
    want = {**{f"d100-{k}": "AMBIGUOUS" for k in range(3)}, "r100-0": "OTHER_CREDIT", "d200-0": "ORIGINAL", "r200-0": "CREDIT", "d300-0": "AMBIGUOUS", "r300-0": "OTHER_CREDIT", "r300-1": "OTHER_CREDIT", "r60-0": "OTHER_CREDIT"}
    assert {r.bank_id: r.role for r in matching.refund_roles(cases).collect()} == want
