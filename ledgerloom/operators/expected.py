"""The state that a subject should have, with the chain of steps that lead to it.

Every operator that has a say builds its own steps: what matching alone gives, a refund, a decision, a reservation for another subject, a group, and the final assignment. A chain holds the first step, the strongest of
the middle ones, and the last; a step that settles the state also names it and its target, so the state follows from the chain and not the chain from the state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut
from . import cards
from .reconciliation import Decided, reconcile

#: subject, place in the chain, the step, and the state and target that it settles (settles false: it leaves them as they are).
STEPS = "subject string, place int, stage string, outcome string, evidence array<string>, decision string, settles boolean, state string, target string"
# What the steps say.
SAID = {
    "pure": "resultado do matcher sem decisões persistidas", "refund": "compra integralmente neutralizada por crédito/estorno", "confirmed": "confirmação manual válida aplicada", "rejected": "candidata rejeitada por decisão manual válida",
    "reserved": "candidata reservada para outro subject", "final": "resultado final da atribuição global",
}
#: Places of the middle steps: of several the first counts.
REFUND, CONFIRMED, REJECTED, RESERVED, GROUP = 1, 2, 3, 4, 5


def _steps(rows: DataFrame, place: int, stage: str, outcome: Column, evidence: Column | None = None, decision: Column | None = None, state: Column | None = None, target: Column | None = None) -> DataFrame:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return rows.select(
        F.col("subject").cast("string").alias("subject"), F.lit(place).alias("place"), F.lit(stage).alias("stage"), outcome.cast("string").alias("outcome"), (evidence if evidence is not None else F.array()).cast("array<string>").alias("evidence"),
        text(decision).alias("decision"), F.lit(state is not None).alias("settles"), text(state).alias("state"), text(target).alias("target"),
    )


def pure_steps(states: DataFrame) -> DataFrame:
    """states: subject, status, as matching alone gives them."""
    return _steps(states, 0, "PURE_MATCHING", F.col("status"), F.array(F.lit(SAID["pure"])))


def refund_steps(returned: DataFrame, state: str = "CARD_REFUNDED") -> DataFrame:
    """returned: subject, of purchases that a credit gives back in full."""
    return _steps(returned.select("subject").distinct(), REFUND, "REFUND", F.lit(state), F.array(F.lit(SAID["refund"])), state=F.lit(state))


def confirmation_steps(confirmed: DataFrame, state: str) -> DataFrame:
    """confirmed: subject, target, decision, of confirmations that hold; of several of a subject the smallest decision."""
    one = confirmed.groupBy("subject").agg(F.min(F.struct("decision", "target")).alias("d")).select("subject", "d.*")
    return _steps(one, CONFIRMED, "DECISION", F.lit(SAID["confirmed"]), F.array("target"), F.col("decision"), F.lit(state), F.col("target"))


def rejection_steps(rejected: DataFrame, canonical: DataFrame) -> DataFrame:
    """rejected: subject, decision, of refusals that hold; the state is the canonical one (subject, status), without a target."""
    one = rejected.groupBy("subject").agg(F.min("decision").alias("decision")).join(canonical.select("subject", "status"), "subject")
    return _steps(one, REJECTED, "DECISION", F.lit(SAID["rejected"]), decision=F.col("decision"), state=F.col("status"))


def reservation_steps(reserved: DataFrame) -> DataFrame:
    """reserved: subject, owner, target, decision: a candidate row that belongs to another subject; of several of a subject the smallest target."""
    one = reserved.groupBy("subject").agg(F.min(F.struct("target", "owner", "decision")).alias("r")).select("subject", "r.*")
    return _steps(one, RESERVED, "RESERVATION", F.lit(SAID["reserved"]), F.array("owner", "target"), F.col("decision"))


def group_steps(groups: DataFrame) -> DataFrame:
    """groups: subject, status, rows, of subjects that matched as a group."""
    return _steps(groups, GROUP, "GROUP_MATCHING", F.col("status"), F.col("rows"), state=F.col("status"))


def expected_states(steps: list[DataFrame], canonical: DataFrame, current: DataFrame) -> DataFrame:
    """(subject, pure, expected, current, target, chain) of every subject with a pure step; chain is an array of (stage, outcome, evidence, decision).

    canonical: subject, status, evidence, the state after all valid decisions and the global assignment; current: subject, status, as shown now. A subject without a canonical or current state has UNAVAILABLE.
    The last step is the state that the strongest middle step settles, else the canonical one, with its target, else the canonical evidence.
    """
    every = reduce(DataFrame.unionByName, steps)
    step = F.struct("stage", "outcome", "evidence", "decision")
    told = every.groupBy("subject").agg(
        F.min(F.when(F.col("place") == 0, step)).alias("first"), F.min(F.when(F.col("place") > 0, F.struct("place", step.alias("step"), "settles", "state", "target"))).alias("middle")
    ).filter("first is not null")
    rows = told.join(canonical.select("subject", F.col("status").alias("canonical"), F.col("evidence").alias("found")), "subject", "left").join(current.select("subject", F.col("status").alias("current")), "subject", "left")
    settled = F.coalesce(F.col("middle.settles"), F.lit(False))
    expected = F.when(settled, F.col("middle.state")).otherwise(F.coalesce("canonical", F.lit("UNAVAILABLE")))
    target = F.when(settled, F.col("middle.target"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    shown = F.when(target.isNotNull(), F.array(target)).when(F.size(found) > 0, found).otherwise(F.array(F.lit(SAID["final"])))
    last = F.struct(F.lit("FINAL_ASSIGNMENT").alias("stage"), expected.alias("outcome"), shown.alias("evidence"), F.lit(None).cast("string").alias("decision"))
    chain = F.array_compact(F.array("first", F.col("middle.step"), last))
    return rows.select("subject", F.col("first.outcome").alias("pure"), expected.alias("expected"), F.coalesce("current", F.lit("UNAVAILABLE")).alias("current"), target.alias("target"), chain.alias("chain"))


def card_expected(
    purchases: DataFrame, ledger: DataFrame, current: DataFrame, refunded: DataFrame | None = None, confirmed: DataFrame | None = None, rejected: DataFrame | None = None, reserved: DataFrame | None = None
) -> DataFrame:
    """expected_states() of card purchases. purchases, ledger: as for cards.purchase_states; current: subject, status; refunded: purchase_id; confirmed, rejected: purchase_id, sheet_id, decision; reserved: sheet_id,
    purchase_id (the only one that may take the row), decision."""
    spark = purchases.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    refunded = refunded if refunded is not None else empty("purchase_id string")
    confirmed = confirmed if confirmed is not None else empty("purchase_id string, sheet_id string, decision string")
    rejected = rejected if rejected is not None else empty("purchase_id string, sheet_id string, decision string")
    reserved = reserved if reserved is not None else empty("sheet_id string, purchase_id string, decision string")
    subject = F.col("purchase_id").alias("subject")
    pure, after, refused, owned = cards.pure_and_decided(purchases, ledger, refunded, confirmed, rejected, reserved)
    pure, after = pure.select(subject, "status"), cut(after)
    evidence = F.when(F.col("sheet_id").isNotNull(), F.array("sheet_id")).otherwise(F.col("sheet_ids"))
    canonical = after.select(subject, "status", evidence.alias("evidence"))
    held = after.filter("held is not null").select("purchase_id", F.col("held").alias("sheet_id")).join(confirmed.select("purchase_id", "sheet_id", "decision"), ["purchase_id", "sheet_id"]).select(subject, F.col("sheet_id").alias("target"), "decision")
    refused, owned = refused.select(subject, "decision"), owned.select(subject, "owner", "target", "decision")
    grouped = after.filter("status = 'CARD_GROUP_MATCHED'").select(subject, "status", F.col("sheet_ids").alias("rows"))
    steps = [pure_steps(pure), refund_steps(refunded.select(subject)), confirmation_steps(held, "CARD_MATCHED"), rejection_steps(refused, canonical), reservation_steps(owned), group_steps(grouped)]
    return expected_states(steps, canonical, current)


def bank_expected(bank: DataFrame, ledger: DataFrame, made: Decided, current: DataFrame) -> DataFrame:
    """expected_states() of bank rows under decisions, as reconcile() takes them. current: subject, status. A confirmed pair is named by its bank row and its ledger row, as decisions resolved to rows carry no key."""
    subject = F.col("bank_id").alias("subject")
    pure = reconcile(bank, ledger).settled.select(subject, "status")
    items = reconcile(bank, ledger, made).items
    evidence = F.when(F.col("sheet_id").isNotNull(), F.array("sheet_id")).otherwise(F.transform("candidates", lambda c: c.sheet_id))
    canonical = items.select(subject, "status", evidence.alias("evidence"))
    confirmed = made.confirmed.join(made.conflicting.select("sheet_id").distinct(), "sheet_id", "left_anti").select(subject, F.col("sheet_id").alias("target"), F.concat_ws("/", "bank_id", "sheet_id").alias("decision"))
    refused = made.rejected.select(subject, F.col("decision_key").alias("decision"))
    owned = items.filter("conflict_owner is not null").select(subject, F.col("conflict_owner").alias("owner"), F.col("sheet_id").alias("target"), F.col("conflict_owner").alias("decision"))
    steps = [pure_steps(pure), confirmation_steps(confirmed, "MATCHED"), rejection_steps(refused, canonical), reservation_steps(owned)]
    return expected_states(steps, canonical, current)


def unexplained(states: DataFrame) -> DataFrame:
    """Subjects whose chain doesn't end in the state they should have."""
    return states.filter(F.element_at("chain", -1)["outcome"] != F.col("expected")).select("subject")

