import itertools
import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import text
from ledgerloom.operators import matching, records, solver

SF = "/root/testdata/sf0.001"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_amounts(spark):
    said = {"R$ 1.234,56": 123456, "1,234": 123, "1.234": 123400, "1.23": 123, "(10,00)": -1000, "-5,00": -500, "5,00-": 500, "1,234.56": 123456, "abc": None, "": None, "BRL 7": 700, "1.005": 100500, " 8,5 ": 850}
    assert column(spark, list(said), text.normalize_amount) == list(said.values())
    assert column(spark, [None], text.normalize_amount) == [None]


def test_dates(spark):
    said = {"2026-1-8": "2026-01-08", "08/01/26": "2026-01-08", "8.1.1971": "1971-01-08", "31/02/2026": None, "8 de março de 2026": "2026-03-08", "01/02/75": "1975-02-01", "2026-01-08T10:00": "2026-01-08", "x": None, "": None}
    assert [d and str(d) for d in column(spark, list(said), text.normalize_date)] == list(said.values())


def test_accents_by_decomposition(spark):
    said = {"São José": "sao jose", "Sa\u0303o Jose\u0301": "sao jose", "Dvořák Ūnā ạ": "dvorak una a", "İzmir Ǆ ß ø": "izmir", "Compra aprovada Café": "cafe"}
    assert column(spark, list(said), text.normalize_description) == list(said.values())


def test_types_and_booleans(spark):
    said = {"Gastos Cartão de Crédito": "CARD_PAYMENT", "Estorno Pix": "REFUND", "Resgate CDB": "INVESTMENT", "TED": "TRANSFER", "limited": "TRANSFER", "Pix recebido": "INCOME", "Compra visa": "EXPENSE", "saldo": "OTHER"}
    assert column(spark, list(said), text.transaction_type) == list(said.values())
    assert column(spark, ["Sim", "não", "", None], text.parse_boolean) == [True, False, None, None]


def test_similarity(spark):
    pairs = [("Padaria do João", "padaria do joao", 1.0), ("", "x", 0.0), ("mercado livre", "mercadolivre", 0.0), ("farmacia popular", "farmacia central", 0.5), ("super mercado", "supermercado", 0.8 * 0.92)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(text.description_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [1.0, 0.0]
    assert got[2] == pytest.approx(0.85 * 0.92) and got[3] >= 0.5 and got[4] == pytest.approx(0.85 * 0.92)


def brute(weights):
    n, m = weights.shape
    best = 0.0
    for columns in itertools.product([-1, *range(m)], repeat=n):
        used = [c for c in columns if c >= 0]
        if len(used) == len(set(used)):
            best = max(best, sum(weights[i, c] for i, c in enumerate(columns) if c >= 0))
    return best


def test_solver_against_enumeration():
    draw = random.Random(7)
    for _ in range(150):
        weights = np.array([[draw.choice([0, 0, 55, 60, 75, 80, 100]) for _ in range(draw.randint(1, 4))]] * 1, float)
        weights = np.array([[draw.choice([0, 55, 60, 75, 80, 100]) for _ in range(weights.shape[1])] for _ in range(draw.randint(1, 4))], float)
        total, chosen = solver.solve(weights)
        used = [c for c in chosen if c >= 0]
        assert total == brute(weights) and len(used) == len(set(used))


def test_assignment_margin():
    rows = [("b1", "s1", 100, 85, 90, 0, "EXPENSE", True, False, "pix"), ("b1", "s2", 100, 80, 90, 1, "EXPENSE", True, False, "pix"), ("b2", "s2", 100, 85, 90, 0, "EXPENSE", True, False, "pix")]
    edges = pd.DataFrame(rows, columns=["bank_id", "sheet_id", "amount", "score", "confidence", "days", "bank_type", "direction_known", "pix_bank", "paid"])
    out = pd.DataFrame(matching.assign_component(edges), columns=[c.split()[0] for c in matching.ASSIGNED.split(", ")]).set_index("bank_id")
    assert out.sheet_id.to_dict() == {"b1": "s1", "b2": "s2"} and out.matched.all() and not out.ambiguous.any()


def test_margins_against_solving_again():
    draw = random.Random(11)
    for _ in range(200):
        weights = np.array([[draw.choice([0, 0, 55, 60, 75, 80, 100]) for _ in range(draw.randint(1, 5))]] * 1, float)
        weights = np.array([[draw.choice([0, 0, 55, 60, 75, 80, 100]) for _ in range(weights.shape[1])] for _ in range(draw.randint(1, 5))], float)
        total, chosen = solver.solve(weights)
        again, margins = solver.solve_with_margins(weights)
        assert again == chosen
        for i, j in enumerate(chosen):
            if j >= 0:
                without = weights.copy()
                without[i, j] = 0
                assert margins[i] == pytest.approx(total - solver.solve(without)[0])


def test_margins_of_larger_components():
    draw = random.Random(5)
    for _ in range(60):
        n, m, kinds = draw.randint(5, 14), draw.randint(5, 14), draw.choice([[60], [55, 60], list(range(55, 101))])
        weights = np.array([[draw.choice(kinds) if draw.random() < 0.35 else 0 for _ in range(m)] for _ in range(n)], float)
        total = solver.solve(weights)[0]
        pairs, margins = solver.solve_with_margins(weights)
        assert len({j for j in pairs if j >= 0}) == sum(j >= 0 for j in pairs)
        for i, j in enumerate(pairs):
            without = weights.copy()
            if j >= 0:
                without[i, j] = 0
            assert margins[i] == (total - solver.solve(without)[0] if j >= 0 else 0)


def test_edges_given_twice_and_edges_without_weight():
    g = solver.graph(np.array([1, 0, 0, 0]), np.array([0, 0, 0, 1]), np.array([60, 55, 80, 0]), 2, 2)
    found = solver.optimum(g)
    assert solver.chosen(g, found[2]).tolist() == [0, -1] and solver.margins(g, *found)[0] == 20
    nothing = solver.graph(np.array([], int), np.array([], int), np.array([]), 0, 0)
    assert solver.margins(nothing, *solver.optimum(nothing)).tolist() == []


def chain(n, circular=False, score=lambda i, k: 60):
    """n bank rows of one amount, each fitting a ledger row and the next one."""
    names = [("b%05d" % i, "s%05d" % ((i + k) % n), score(i, k)) for i in range(n) for k in (0, 1) if circular or i + k < n]
    return pd.DataFrame([(b, s, 100, w, 90, 1, "EXPENSE", True, False, "pix") for b, s, w in names], columns=matching._EDGE)


def test_long_chains_in_bounded_memory():
    columns = [c.split()[0] for c in matching.ASSIGNED.split(", ")]
    draw = random.Random(3)
    cases = {"equal": (chain(20_000), 60, 60), "circle": (chain(20_000, True), 0, 0), "drawn": (chain(20_000, score=lambda i, k: draw.randint(55, 100)), 0, 100)}
    for name, (edges, least, most) in cases.items():
        tracemalloc.start()
        out = pd.DataFrame(matching.assign_component(edges), columns=columns)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.sheet_id.is_unique and out.bank_id.is_unique and out.margin.between(least, most).all() and peak < 200 << 20, (name, peak)
        if name == "drawn":
            assert out.score.sum() == best_of_chain(edges)
        else:
            assert len(out) == 20_000


def best_of_chain(edges):
    """Largest total of edges of which no two neighbours in the chain's order are taken."""
    before = last = 0
    for w in edges.sort_values(["bank_id", "sheet_id"]).score:
        before, last = last, max(last, before + w)
    return last


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels pages benchmark".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).collect(), con.sql(catalog.ORACLE_SQL[name])
    names = sorted(want.columns)
    shown = lambda v: "~" if v is None else str(v)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted([shown(r[n]) for n in names] for r in got) == sorted([shown(r[n]) for n in names] for r in rows)


def test_items_cover_every_bank_row(spark):
    items = catalog.QUERIES["reconcile_items"](spark, SF)
    assert items.count() == items.select("bank_id").distinct().count() > 0


def test_empty_tables(spark):
    schema = "key string, updated_ts timestamp, state string"
    nothing = spark.createDataFrame([], schema)
    assert records.sync_merge(nothing, nothing).count() == 0 and records.audit_merge(nothing, nothing).count() == 0


def test_anchors_by_pieces_equal_plain_search():
    import random

    from ledgerloom.functions.similarity import Anchors, alike, similarity

    draw = random.Random(7)
    stems = ["padaria", "padariacentral", "central", "mercado", "merc", "mercadinho", "posto", "pst", "farmacia", "farm", "ltda", "sul", "da", "x", "popular", "popul", "shell", "loja", "12", "1234", "nova"]
    for _ in range(60):
        texts = list(dict.fromkeys(" ".join(draw.choice(stems) for _ in range(draw.randint(1, 8))) for _ in range(40)))
        plain, anchors = [], Anchors(0.78)
        for n, text in enumerate(texts):
            found = next((name for other, name in plain if similarity(other, text) >= 0.78), None)
            if found is None:
                plain.append((text, f"a{n}"))
            assert anchors.place(text, f"a{n}") == (found or f"a{n}")
        for a in texts[:12]:
            for b in texts[:12]:
                assert all(alike(a, b, least) == (similarity(a, b) >= least) for least in (0.3, 0.72, 0.78, 0.9))
