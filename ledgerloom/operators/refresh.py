"""Refresh of a kept assignment after some rows changed: only what a change can reach is matched again.

Edges join rows of one amount, and an assignment is solved by connected component. So what a change reaches is this: the classes of alike rows that lose or gain a member, their edges, and every component that holds
an end of one. Edges of these components are solved again, all other components keep their result. Rows, edges and pairs are stored by a hash of their amount, so that a
refresh reads and writes only the parts of the amounts that changed. Edges are kept between classes, with the members of these; their pairs are formed only where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import Scratch
from ..sources.versions import Conflict, VersionedTable
from .links import components
from .matching import _EDGE, ASSIGNED, CONFIG, Alike, MatchConfig, alike_edges, assignment_of, pairs_of, ranked

EDGES = "component string, bank_id string, sheet_id string, amount long, score int, confidence int, days int, bank_type string, direction_known boolean, pix_bank boolean, paid string"
#: An edge between classes (side is null), or a member (side, id) of the class in bank_id or sheet_id.
KEPT = f"{EDGES}, side string, id string"
PAIRS = f"component string, {ASSIGNED}"
#: Parts by amount.
PARTS = 64


def part(amount, parts: int = PARTS):
    return F.pmod(F.xxhash64(amount), F.lit(parts)).cast("int")


def by_amount(rows: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write rows to a folder per part, as refresh() reads them."""
    rows.withColumn("part", part(F.col("amount").cast("long"), parts)).repartition("part").write.partitionBy("part").parquet(path)


def labelled(alike: Alike) -> DataFrame:
    """The edges with the component that they belong to: the smallest bank row of it."""
    labels = components(alike.edges.select(F.concat(F.lit("b"), "bank_id").alias("a"), F.concat(F.lit("s"), "sheet_id").alias("b"))).filter("v like 'b%'").select(F.substring("v", 2, 1 << 30).alias("bank_id"), "c")
    named = labels.join(alike.banks.withColumnRenamed("c", "bank_id"), "bank_id").groupBy("c").agg(F.min("id").alias("component"))
    return alike.edges.join(labels.join(named, "c").drop("c"), "bank_id")


def _solved(alike: Alike, config: MatchConfig) -> DataFrame:
    of_class = alike.edges.select(F.col("bank_id").alias("c"), "component").distinct()
    return assignment_of(alike, config).join(alike.banks.join(of_class, "c").select(F.col("id").alias("bank_id"), "component"), "bank_id")


def _rows(alike: Alike, banks: DataFrame, sheets: DataFrame) -> DataFrame:
    """The edges and members of classes as rows of KEPT; banks, sheets: id, amount."""
    kinds = [c.split() for c in KEPT.split(", ")]
    blank = lambda df: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
    of = lambda members, rows, side, key: members.join(rows.select("id", F.col("amount").cast("long").alias("amount")), "id").select(F.lit(side).alias("side"), "id", "amount", F.col("c").alias(key))
    return blank(alike.edges).unionByName(blank(of(alike.banks, banks, "BANK", "bank_id"))).unionByName(blank(of(alike.sheets, sheets, "LEDGER", "sheet_id")))


def _members(rows: DataFrame, side: str) -> DataFrame:
    return rows.filter(F.col("side") == side).select(F.coalesce("bank_id", "sheet_id").alias("c"), "id", "amount")


class Edges:
    """Kept edges, stored between classes."""

    def __init__(self, table: VersionedTable):
        self.table, self.version, self.slots = table, table.version, table.slots

    def read(self, version: int | None = None) -> DataFrame:
        """All pairs with their component."""
        rows = self.table.read(version)
        edges = rows.filter("side is null").select(*_columns(EDGES))
        return pairs_of(Alike(edges, ranked(_members(rows, "BANK")), ranked(_members(rows, "LEDGER")))).select(*_columns(EDGES))


@dataclass(frozen=True)
class Kept:
    """A kept assignment: edges with their components, and the planned pairs."""

    edges: Edges
    pairs: VersionedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Kept:
        return cls(Edges(VersionedTable(spark, f"{path}/edges", KEPT)), VersionedTable(spark, f"{path}/pairs", PAIRS))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _store(table: VersionedTable, rows: DataFrame, schema: str, touched: list[int] | None, parts: int) -> None:
    """Make a version in which the touched parts (all where None) hold these rows."""
    for _ in range(20):
        base = table.version()
        slots = table.slots(base)
        folder = table.write(rows.select(*_columns(schema)).withColumn("part", part(F.col("amount"), parts)).repartition("part"), by="part")
        # A part without rows has no folder.
        full = table.folders(folder, "part")
        kept = {} if touched is None else {k: v for k, v in slots.items() if int(k) not in touched}
        if table.commit(base, kept | {p: f"{folder}/part={p}" for p in full}):
            return
        table.discard(folder)
    raise Conflict(table.path)


def build(kept: Kept, bank: DataFrame, ledger: DataFrame, config: MatchConfig = CONFIG, parts: int = PARTS) -> None:
    """Match all rows and keep the result."""
    scratch = Scratch(bank.sparkSession)
    alike = alike_edges(bank, ledger, config)
    alike = Alike(scratch.keep(labelled(alike)), alike.banks, alike.sheets)
    _store(kept.edges.table, _rows(alike, bank, ledger), KEPT, None, parts)
    _store(kept.pairs, _solved(alike, config), PAIRS, None, parts)
    scratch.drop()


def refresh(kept: Kept, bank: DataFrame, ledger: DataFrame, changed: DataFrame, config: MatchConfig = CONFIG, parts: int = PARTS) -> list[int]:
    """Bring a kept assignment up to date and return the parts that were read and written.

    bank, ledger: all rows as they are now, with `part` as by_amount() stores them. changed: side (BANK or LEDGER), id, amount: one row for each row that came, went or changed, with its
    amount before and, if that differs, another with its amount now. Rows named without need cost only time; no changes change nothing.
    """
    spark = bank.sparkSession
    scratch = Scratch(spark)
    changed = scratch.keep(changed.select("side", "id", F.col("amount").cast("long").alias("amount")).distinct())
    touched = sorted(r.part for r in changed.select(part(F.col("amount"), parts).alias("part")).distinct().collect())  # at most `parts`
    if not touched:
        return []
    near = lambda rows: rows.filter(F.col("part").isin(touched)).join(changed.select("amount").distinct(), "amount", "left_semi").drop("part")
    held = lambda table: table.rows(v for k, v in table.slots(table.version()).items() if int(k) in touched)
    banks, sheets = scratch.keep(near(bank)), scratch.keep(near(ledger))
    ids = lambda side: changed.filter(F.col("side") == side).select("id").distinct()
    old = scratch.keep(held(kept.edges.table))
    old_edges = old.filter("side is null").select(*_columns(EDGES))
    # Edges of classes with changed rows, as they are now: each changed side against all rows of the other.
    of_bank, of_sheet = alike_edges(banks.join(ids("BANK"), "id", "left_semi"), sheets, config), alike_edges(banks, sheets.join(ids("LEDGER"), "id", "left_semi"), config)
    now_banks, now_sheets = of_sheet.banks, of_bank.sheets
    new = scratch.keep(of_bank.edges.select(*_EDGE).unionByName(of_sheet.edges.select(*_EDGE)).dropDuplicates(["bank_id", "sheet_id"]))

    # A component is reached if it holds a class that a row has left or joined, or an end of a new edge.
    def hit(side, members, key):
        moved = _members(old, side).select("c", "id").unionByName(members.select("c", "id")).join(ids(side), "id", "left_semi").select("c")
        return moved.unionByName(new.select(F.col(key).alias("c"))).distinct().withColumnRenamed("c", key)

    ends = [old_edges.join(hit(side, members, key), key, "left_semi").select("component") for side, members, key in (("BANK", now_banks, "bank_id"), ("LEDGER", now_sheets, "sheet_id"))]
    reached = scratch.keep(ends[0].unionByName(ends[1]).distinct())
    calm = lambda rows: rows.join(reached, "component", "left_anti")
    alive = old_edges.join(reached, "component", "left_semi").select(*_EDGE)
    for members, key in ((now_banks, "bank_id"), (now_sheets, "sheet_id")):
        alive = alive.join(members.select(F.col("c").alias(key)).distinct(), key, "left_semi")
    again = Alike(scratch.keep(alive.select(*_EDGE).unionByName(new).dropDuplicates(["bank_id", "sheet_id"])), now_banks, now_sheets)
    again = Alike(scratch.keep(labelled(again)), now_banks, now_sheets)
    others = old.filter("side is not null").join(changed.select("amount").distinct(), "amount", "left_anti")
    stored = calm(old_edges).unionByName(others, allowMissingColumns=True).unionByName(_rows(again, banks, sheets))
    _store(kept.edges.table, stored, KEPT, touched, parts)
    _store(kept.pairs, calm(held(kept.pairs)).unionByName(_solved(again, config).select(*_columns(PAIRS))), PAIRS, touched, parts)
    scratch.drop()
    return touched
