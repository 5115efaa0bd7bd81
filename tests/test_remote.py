"""Rows of the remote decision table: odd ids, and what is dealt out to find those that repeat."""

from pyspark.sql import functions as F

from ledgerloom.functions.identity import decision_key, fingerprint
from ledgerloom.operators import decisions

SCHEMA = "line int, n string, decision_id string, kind string, subject string, status string, related string, metadata string, created_at string, updated_at string, version string"


def _rows(spark, *cells):
    """cells: (n, decision_id, changes); an id of "own" is the one that fits, and what isn't changed can be read."""
    plain = {"kind": "PAIR_CONFIRMED", "status": "ACTIVE", "metadata": '{"selected":["r"]}', "created_at": "2026-01-01T00:00:00-03:00", "updated_at": "2026-02-03T04:05:06Z", "version": "1", "subject": "own"}
    made = [{"line": i, "n": n, "decision_id": key, "related": f'["{n}"]'} | plain | more for i, (n, key, more) in enumerate(cells)]
    rows = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in made], SCHEMA)
    own = lambda name, value: F.when(F.col(name) == "own", value).otherwise(F.col(name)).alias(name)
    rows = rows.select("line", own("decision_id", fingerprint(decision_key(F.lit("PAIR_CONFIRMED"), F.array("n")))), own("subject", fingerprint(F.col("n"))), *(c for c in decisions.REMOTE if c not in ("decision_id", "subject")))
    return rows.localCheckpoint()


def test_ids_that_repeat_are_blank_or_null(spark):
    again, none, late, lost = "DUPLICATE_REMOTE_DECISION_ID", None, "INVALID_DECISION_TIMESTAMP", "INVALID_REMOTE_DECISION_ROW"
    cells = [
        ("a", "own", {}, none), ("b", "own", {}, again), ("b", "own", {"updated_at": "never"}, again), ("c", "x", {}, again), ("d", "x", {"related": None}, again), ("e", "", {}, lost), ("f", "", {}, lost), ("g", "  ", {}, lost), ("g", "  ", {"updated_at": None}, late),
        ("h", None, {}, lost), ("i", None, {"updated_at": "2026-02-30T00:00:00Z"}, late), ("j", "own", {"subject": None}, lost), ("k", "own", {"metadata": '{"selected":[null]}'}, lost), ("l", "own", {"related": "oops"}, lost), ("m", "own", {"created_at": "x"}, lost),
        ("n", "own", {"kind": None}, lost), ("o", "own", {"version": "x"}, lost), ("p", "own", {"status": "GONE"}, lost), ("ação \U0001f600", "own", {}, none),
    ]
    got = decisions.remote_rows(_rows(spark, *(c[:3] for c in cells))).collect()
    assert {r.line: r.issue for r in got} == {i: c[3] for i, c in enumerate(cells)} and len(got) == len(cells)
    assert next(r for r in got if r.line == 0).identities == ["a"] and next(r for r in got if r.line == 11).selected == ["r"]


def test_rows_are_not_dealt_out_for_a_few_ids_that_repeat(spark):
    out = decisions.remote_rows(_rows(spark, *((str(k), "own" if k % 7 else "same", {}) for k in range(100))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert out.filter("issue is not null").count() == 15
