import json
import random
import threading
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import records, views
from ledgerloom.sources.versions import VersionedTable
from ledgerloom.streaming import decisions

ROWS = "date date, amount long, description string, payment_method string"


def ledger_row(n):
    return (datetime(2026, 1, 1 + n % 28).date(), n, f"linha {n}", "Pix")


def test_two_writers_at_once_lose_no_row(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "ledger"), ROWS)
    sides = [[spark.createDataFrame([ledger_row(n) for n in range(k, k + 6)], ROWS) for k in starts] for starts in ((0, 20, 30), (3, 23, 40))]
    added, errors = [], []

    def work(parts):
        try:
            added.extend(VersionedTable(spark, table.path, ROWS).append(p, views.to_append) for p in parts)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work, args=(parts,)) for parts in sides]
    [t.start() for t in threads]
    [t.join() for t in threads]
    amounts = sorted(r.amount for r in table.read().collect())
    assert not errors and amounts == [*range(9), *range(20, 29), *range(30, 36), *range(40, 46)] and sum(added) == len(amounts)
    assert table.append(sides[0][0], views.to_append) == 0 and table.version() <= 6  # a repeated append makes no version


def test_only_one_writer_makes_a_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ROWS)
    folder = table.write(spark.createDataFrame([ledger_row(1)], ROWS))
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append(table.commit(0, {str(n): folder}))) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True] and table.version() == 1 and table.read().count() == 1


def test_a_lost_writer_leaves_the_table_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ROWS)
    table.append(spark.createDataFrame([ledger_row(1)], ROWS), views.to_append)
    table.write(spark.createDataFrame([ledger_row(2)], ROWS))  # and no commit
    assert table.read().count() == 1 and table.read(0).count() == 0
    table.mutate(lambda rows: rows.withColumn("amount", F.col("amount") + 5))
    assert [r.amount for r in table.read().collect()] == [6] and [r.amount for r in table.read(1).collect()] == [1]


def versions_of(seed, n=120):
    draw = random.Random(seed)
    return [(f"k{draw.randrange(15)}", datetime(2026, 1, 1) + timedelta(hours=draw.randrange(4)), draw.choice(("ACTIVE", "DELETED")), draw.choice(("local", "remote"))) for _ in range(n)]


def test_files_in_any_order_give_one_result(spark, tmp_path):
    rows = versions_of(8)
    remote, local = ({} for _ in range(2))
    for key, at, state, side in rows:
        held = remote if side == "remote" else local
        held[key] = max(held.get(key, (at, state == "DELETED", state)), (at, state == "DELETED", state))
    tables = [spark.createDataFrame([(k, v[0], v[2]) for k, v in held.items()], "key string, updated_ts timestamp, state string") for held in (remote, local)]
    want = sorted((r.key, r.updated_ts, r.state, r.side) for r in records.sync_merge(*tables).collect())
    for order in (1, 2):
        source, table, checkpoint = (tmp_path / f"{x}{order}" for x in ("in", "table", "check"))
        source.mkdir()
        shuffled = random.Random(order).sample(rows, len(rows))
        for n in range(0, 4):
            (source / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "updated_ts": t.isoformat() + "Z", "state": s, "side": w}) for k, t, s, w in shuffled[n::4]))
            if n in (1, 3):
                decisions.merge_new_files(spark, str(source), str(table), str(checkpoint), buckets=4, files_per_batch=1)
        assert sorted((r.key, r.updated_ts, r.state, r.side) for r in decisions.current(spark, str(table)).collect()) == want


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda rows: spark.createDataFrame(rows, decisions.SCHEMA)
    at = datetime(2026, 1, 1)
    decisions.merge_batch(spark, path, batch([(f"k{n}", at, "ACTIVE", None) for n in range(50)]), 0, buckets=8)
    table = VersionedTable(spark, path, decisions.SCHEMA)
    before = table.slots(1)
    touched = decisions.merge_batch(spark, path, batch([("k7", at + timedelta(1), "DELETED", "local")]), 1)
    after = table.slots(2)
    assert len(touched) == 1 and [k for k in before if not k.startswith("_") and before[k] != after[k]] == [str(touched[0])]
    assert decisions.merge_batch(spark, path, batch([("k8", at + timedelta(9), "DELETED", None)]), 1) == [] and table.version() == 2  # a replayed batch
    got = {r.key: r.state for r in table.read().collect()}
    assert len(got) == 50 and [k for k, s in got.items() if s == "DELETED"] == ["k7"]
