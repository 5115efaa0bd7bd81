"""Ledger duplicates around an anchor, and card bills composed of several ledger rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import Anchors
from ..functions.text import normalize_description

#: Limits of the composition search: candidates, items, visited nodes, solutions, days before the bill.
CANDIDATES, ITEMS, NODES, SOLUTIONS, HORIZON = 24, 18, 75_000, 8, 365
ALIKE = 0.78


def duplicate_members(ledger: DataFrame) -> DataFrame:
    """Ledger rows that repeat each other: (id, row_idx, date, amount, anchor_id), anchors included, as _duplicates() finds them."""
    return _duplicates(ledger).select("id", "row_idx", "date", "amount", "anchor_id")


def _duplicates(ledger: DataFrame) -> DataFrame:
    """duplicate_members() with the anchor's text (anchor_said), which names a group within its date and amount also where ids repeat.

    Rows of equal date and amount whose text is like an earlier row's, the anchor, belong to it; likeness counts to the anchor only and isn't transitive, and the first anchor in the order of
    row_idx takes a row. Equal texts always share an anchor, so only distinct texts of keys with several of them reach Python, sorted and one at a time: a task holds the anchors of one key, and a text meets only those with which it shares a token or a piece of one.
    ledger: id, row_idx, date, amount, description.
    """
    rows = ledger.select("id", "row_idx", "date", "amount", normalize_description(F.coalesce("description", F.lit(""))).alias("said"))
    key = ["date", "amount"]
    texts = rows.groupBy(*key, "said").agg(F.min(F.struct("row_idx", "id")).alias("first"), F.count("*").alias("n")).filter("said <> ''")
    several = texts.groupBy(*key).agg(F.count("*").alias("texts"), F.sum("n").alias("rows")).filter("rows > 1")
    kept = texts.join(several, key)

    def anchored(batches):
        at, anchors = None, Anchors(ALIKE)
        for batch in batches:
            out = []
            for date, amount, said in zip(batch.date, batch.amount, batch.said, strict=True):
                if (date, amount) != at:
                    at, anchors = (date, amount), Anchors(ALIKE)
                out.append(anchors.place(said, said))
            yield batch[["date", "amount", "said"]].assign(anchor_said=out)

    many = kept.filter("texts > 1").select(*key, "said", "first").repartition(*key).sortWithinPartitions(*key, "first").drop("first")
    anchors = many.mapInPandas(anchored, "date date, amount long, said string, anchor_said string").unionByName(kept.filter("texts = 1").select(*key, "said", F.col("said").alias("anchor_said")))
    members = rows.join(anchors, [*key, "said"])
    sizes = members.groupBy(*key, "anchor_said").agg(F.count("*").alias("n"), F.min(F.struct("row_idx", "id")).alias("first")).filter("n > 1")
    return members.join(sizes.select(*key, "anchor_said", F.col("first.id").alias("anchor_id")), [*key, "anchor_said"])


def ledger_duplicates(ledger: DataFrame) -> DataFrame:
    """duplicate_members() as one row per anchor: (date, amount, anchor_id, ids), ids in the order of row_idx."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "id"))), lambda r: r["id"])
    return _duplicates(ledger).groupBy("date", "amount", "anchor_said").agg(F.first("anchor_id").alias("anchor_id"), ids.alias("ids")).drop("anchor_said")


def subset_sums(amounts: list[int], target: int, items: int = ITEMS, nodes: int = NODES) -> tuple[list[tuple[int, ...]], bool]:
    """Index sets that add up to the target, and whether the search stopped early. Depth first, taking before leaving; a set ends where its sum is met."""
    rest = [0] * (len(amounts) + 1)
    for i in reversed(range(len(amounts))):
        rest[i] = rest[i + 1] + amounts[i]
    found, seen, todo = [], 0, [(0, 0, ())]
    while todo:
        i, total, chosen = todo.pop()
        seen += 1
        if seen > nodes:
            return found, True
        if total == target and chosen:
            found.append(chosen)
        elif i < len(amounts) and total <= target and len(chosen) < items and total + rest[i] >= target:
            todo += [(i + 1, total, chosen), (i + 1, total + amounts[i], (*chosen, i))]
    return found, False


OPTION = "bill_id string, status string, candidates int, candidate_total long, rank int, score int, ids array<string>"


def _counted(bills: DataFrame, items: DataFrame) -> DataFrame:
    """bills with the number and sum of the items of their account up to HORIZON days before, by a range window over daily sums; no pair is formed."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).alias("n_day")
    daily = items.groupBy("account", number("day")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    asked = bills.select("account", number("date"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cost")).distinct()
    both = daily.unionByName(asked).groupBy("account", "n_day").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    back = Window.partitionBy("account").orderBy("n_day").rangeBetween(-HORIZON, 0)
    sums = both.select("account", "n_day", F.sum("n").over(back).cast("int").alias("candidates"), F.sum("cost").over(back).cast("long").alias("candidate_total"))
    return bills.withColumn("n_day", F.datediff("date", F.lit("1970-01-01").cast("date"))).join(sums, ["account", "n_day"])


def card_compositions(bills: DataFrame, ledger: DataFrame) -> DataFrame:
    """Up to eight sets of ledger rows of an account that add up to a card bill: one row per option, or one without ids.

    status: REVIEW (options to choose from), NO_MATCH or LIMITED (too many candidates or nodes). Candidates lie up to a year before the bill; their number and sum come from a window over daily
    sums, and only bills with at most 24 of them are joined with rows, by blocks of 31 days. bills: bill_id, account, date, amount; ledger: id, account, date, amount and, where rows may repeat
    an identity, identity, of which the first row counts.
    """
    named = ledger if "identity" in ledger.columns else ledger.withColumn("identity", F.col("id"))
    first = F.min(F.struct(*(["row_idx"] if "row_idx" in ledger.columns else []), "id", F.col("date").alias("day"), F.col("amount").alias("cost"))).alias("row")
    items = named.groupBy("account", "identity").agg(first).select("account", "identity", "row.id", "row.day", "row.cost")
    sized = _counted(bills, items)
    plain = sized.filter(f"candidates = 0 or candidates > {CANDIDATES}").select(
        "bill_id", F.when(F.col("candidates") == 0, "NO_MATCH").otherwise("LIMITED").alias("status"), "candidates", "candidate_total", F.lit(0).alias("rank"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("array<string>").alias("ids")
    )
    few = sized.filter(f"candidates between 1 and {CANDIDATES}").withColumn("block", F.explode(F.sequence(F.floor((F.col("n_day") - HORIZON) / 31), F.floor(F.col("n_day") / 31))))
    blocks = items.withColumn("block", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 31))
    age = F.datediff("date", "day")
    pairs = few.join(blocks, ["account", "block"]).filter((age >= 0) & (age <= HORIZON)).select("bill_id", "amount", "candidate_total", "id", "identity", "cost", age.alias("age"))

    def searched(bill: str, amount: int, total: int, items: list[tuple]) -> list[tuple]:
        sets, limited = subset_sums([cost for *_, cost in items], amount)
        options = []
        for chosen in sets:
            ages = [items[i][0] for i in chosen]
            near = [math.floor(25 * (1 - min(x, HORIZON) / HORIZON) + 0.5) for x in (sum(ages) / len(ages), max(ages) - min(ages))]
            options.append((-(50 + sum(near)), "|".join(sorted(items[i][2] for i in chosen)), [items[i][1] for i in sorted(chosen, key=lambda i: (-items[i][0], items[i][1]))]))
        status = "LIMITED" if limited else "REVIEW" if options else "NO_MATCH"
        head = (bill, status, len(items), total)
        return [(*head, k, -score, ids) for k, (score, _, ids) in enumerate(sorted(options)[:SOLUTIONS], 1)] or [(*head, 0, None, None)]

    def all_searched(batches):
        for batch in batches:
            found = [row for bill, amount, total, items in zip(batch.bill_id, batch.amount, batch.candidate_total, batch["items"], strict=True) for row in searched(bill, amount, total, [tuple(i.values()) for i in items])]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in OPTION.split(", ")]).astype({"score": "Int32"})

    # At most CANDIDATES items a bill, so a bill is one row, and many bills are searched in one batch.
    listed = pairs.groupBy("bill_id", "amount", "candidate_total").agg(F.array_sort(F.collect_list(F.struct("age", "id", "identity", "cost"))).alias("items"))
    return plain.unionByName(listed.mapInPandas(all_searched, OPTION))
