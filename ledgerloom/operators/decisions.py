"""Decisions of a user: validity, what they apply to, and conflicts between them. Columns: key, schema_version, kind, identities, selected, updated_at, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import decision_key, fingerprint
from ..functions.text import is_timestamp
from ..plans.shared import cut
from . import cards
from .matching import candidate_edges
from .reconciliation import Decided, decided

# Kinds with (number of identities, number of selected rows); null is any, -1 is at least one.
ARITY = {
    "BANK_IGNORED": (1, 0), "SHEET_IGNORED": (1, 0), "PAIR_CONFIRMED": (1, 1), "PAIR_REJECTED": (2, 0), "MISSING_ADDED_TO_SHEET": (1, 1), "COMPOSITION_CONFIRMED": (2, -1),
    "STATEMENT_MATCH_CONFIRMED": (1, 1), "CARD_MISSING_CONFIRMED": (1, 0), "CARD_PURCHASE_IGNORED": (1, 0), "CARD_REVIEW_REJECTED_CANDIDATES": (1, -1),
}


def is_valid() -> Column:
    """Whether a decision is well formed: version, kind, texts, timestamp, key and the numbers of its parts."""
    filled = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull() & (F.trim(v) != ""))
    counts = F.lit(False)
    for kind, (n, chosen) in ARITY.items():
        enough = F.size("selected") > 0 if chosen < 0 else F.size("selected") == chosen
        counts = F.when(F.col("kind") == kind, (F.size("identities") == n) & enough).otherwise(counts)
    return F.coalesce((F.col("schema_version") == 1) & filled("identities") & filled("selected") & is_timestamp(F.col("updated_at")) & (F.col("key") == decision_key(F.col("kind"), F.col("identities"))) & counts, F.lit(False))


def applicable(decisions: DataFrame, tombstones: DataFrame, blocked: DataFrame) -> DataFrame:
    """Valid decisions that no tombstone of their key equals or outdates, and whose key isn't blocked. tombstones: key, updated_at; blocked: key."""
    last = tombstones.groupBy("key").agg(F.max(F.try_to_timestamp("updated_at")).alias("deleted_at"))
    open_ = decisions.filter(is_valid()).join(last, "key", "left").filter(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.try_to_timestamp("updated_at")))
    return open_.drop("deleted_at").join(blocked.select("key").distinct(), "key", "left_anti")


def integrity(rows: DataFrame) -> DataFrame:
    """Rows of a decision table as read, with an issue or null: DUPLICATE_REMOTE_DECISION_ID, INVALID_DECISION_TIMESTAMP or INVALID_REMOTE_DECISION_ROW. All copies of an id are marked."""
    copies = F.count("*").over(Window.partitionBy("key"))
    return rows.withColumn("issue", F.when(copies > 1, "DUPLICATE_REMOTE_DECISION_ID").when(~F.coalesce(is_timestamp(F.col("updated_at")), F.lit(False)), "INVALID_DECISION_TIMESTAMP").when(~is_valid(), "INVALID_REMOTE_DECISION_ROW"))


REMOTE = ["decision_id", "kind", "subject", "status", "related", "metadata", "created_at", "updated_at", "version"]


def remote_rows(rows: DataFrame) -> DataFrame:
    """Rows of a remote decision table (line and the nine columns of REMOTE, as text) with key, identities, selected and issue.

    issue is DUPLICATE_REMOTE_DECISION_ID for all copies of an id, INVALID_DECISION_TIMESTAMP for a row that can't be read and whose update time is no full timestamp, INVALID_REMOTE_DECISION_ROW for any other row
    that can't be read, and null for a decision. A decision's id and subject are the fingerprints of its key and of its first identity.
    """
    lists = rows.withColumn("identities", F.from_json("related", "array<string>")).withColumn("selected", F.from_json("metadata", "struct<selected:array<string>>")["selected"])
    lists = lists.withColumn("key", F.when(F.col("identities").isNotNull() & F.col("kind").isNotNull(), decision_key(F.col("kind"), F.col("identities"))))
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull())
    # Fingerprints come last: a row that fails before needs none.
    read = (
        F.col("kind").isin(list(ARITY)) & (F.col("version").try_cast("int") == 1) & F.col("status").isin("ACTIVE", "DELETED") & whole("identities") & whole("selected") & is_timestamp(F.col("updated_at")) & is_timestamp(F.col("created_at"))
        & (F.col("decision_id") == fingerprint(F.col("key"))) & (F.col("subject") == fingerprint(F.coalesce(F.get("identities", F.lit(0)), F.lit(""))))
    )
    # Ids that repeat are few as a rule: kept, they are broadcast if Spark finds them small, and rows stay where they are. Blank ids go after that, as a filter on ids would move below the steps that make the rows and be worked out there once more.
    repeated = cut(rows.groupBy("decision_id").agg(F.count("*").alias("copies")).filter("copies > 1").select("decision_id")).filter(F.trim("decision_id") != "").withColumn("repeated", F.lit(True))
    # Told before the join, so that rows which have to be dealt out carry only what is asked of them.
    lists = lists.withColumn("unread", F.when(F.coalesce(read, F.lit(False)), None).when(~F.coalesce(is_timestamp(F.col("updated_at")), F.lit(False)), "INVALID_DECISION_TIMESTAMP").otherwise("INVALID_REMOTE_DECISION_ROW"))
    issue = F.when(F.col("repeated"), "DUPLICATE_REMOTE_DECISION_ID").otherwise(F.col("unread"))
    return lists.join(repeated, "decision_id", "left").select("line", *REMOTE, "key", "identities", "selected", issue.alias("issue"))


def identified(rows: DataFrame) -> DataFrame:
    """(identity, id): the row that decisions name, the first of those that share an identity."""
    named = F.col("identity") if "identity" in rows.columns else F.col("id")
    return rows.groupBy(named.alias("identity")).agg(F.min("id").alias("id"))


def resolve(decisions: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """decisions with bank_id and sheet_id, the rows of today that they name, or null."""
    first, second = F.get("identities", F.lit(0)), F.get("identities", F.lit(1))
    sheet = F.when(F.col("kind") == "SHEET_IGNORED", first).when(F.col("kind") == "PAIR_REJECTED", second).otherwise(F.get("selected", F.lit(0)))
    asked = decisions.withColumn("_bank", F.when(F.col("kind") != "SHEET_IGNORED", first)).withColumn("_sheet", sheet)
    out = asked.join(identified(bank).select(F.col("identity").alias("_bank"), F.col("id").alias("bank_id")), "_bank", "left").join(identified(ledger).select(F.col("identity").alias("_sheet"), F.col("id").alias("sheet_id")), "_sheet", "left")
    return out.drop("_bank", "_sheet")


def status(decisions: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, kind, status) of bank decisions against today's rows: VALID, STALE, ORPHANED, NEEDS_REVIEW or INVALID.

    A pair is valid while matching would consider it; a confirmed one needs review while amount and direction still agree, else a pair is stale. bank, ledger: as for candidate_edges, with direction. Card kinds
    are judged by card_status().
    """
    named = resolve(decisions.filter("kind in ('PAIR_CONFIRMED', 'PAIR_REJECTED', 'MISSING_ADDED_TO_SHEET', 'BANK_IGNORED', 'SHEET_IGNORED')"), bank, ledger)
    edges = candidate_edges(bank, ledger, only=named)
    sums = lambda rows, mark: rows.select(F.col("id").alias(f"{mark}_id"), F.col("amount").alias(f"{mark}_amount"), F.col("direction").alias(f"{mark}_side"))
    both = named.join(edges.select("bank_id", "sheet_id", F.lit(True).alias("plausible")), ["bank_id", "sheet_id"], "left").join(sums(bank, "bank"), "bank_id", "left").join(sums(ledger, "sheet"), "sheet_id", "left")
    same = F.coalesce((F.col("bank_amount") == F.col("sheet_amount")) & (F.col("bank_side") == F.col("sheet_side")), F.lit(False))
    ignores = F.when(F.col("kind") == "SHEET_IGNORED", F.col("sheet_id")).when(F.col("kind") == "BANK_IGNORED", F.col("bank_id"))
    out = (
        F.when(~is_valid(), "INVALID").when(F.col("kind").isin("SHEET_IGNORED", "BANK_IGNORED"), F.when(ignores.isNotNull(), "VALID").otherwise("ORPHANED")).when(F.col("sheet_id").isNull(), "ORPHANED").when(F.col("bank_id").isNull(), "NEEDS_REVIEW")
        .when(F.col("plausible"), "VALID").when(same & (F.col("kind") != "PAIR_REJECTED"), "NEEDS_REVIEW").otherwise("STALE")
    )
    return both.select("key", "kind", out.alias("status"))


def card_status(decisions: DataFrame, aliases: DataFrame, purchases: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, kind, status) of decisions about card purchases. aliases: identity, purchase_id, every name under which a purchase may be stored; purchases, ledger: as for cards.plausible_rows.

    A confirmed row is valid while the purchase could be it, needs review while amount, direction and payment still agree, else it is stale. A confirmed missing purchase is stale once any row could be it. Refused
    candidates are valid while some of them, and no other row, could be the purchase.
    """
    kinds = ["STATEMENT_MATCH_CONFIRMED", "CARD_MISSING_CONFIRMED", "CARD_PURCHASE_IGNORED", "CARD_REVIEW_REJECTED_CANDIDATES"]
    asked = decisions.filter(F.col("kind").isin(kinds)).withColumn("valid", is_valid()).join(aliases.groupBy("identity").agg(F.min("purchase_id").alias("purchase_id")), F.get("identities", F.lit(0)) == F.col("identity"), "left")
    rows = identified(ledger).withColumnRenamed("id", "sheet_id")
    chosen = asked.select("key", "purchase_id", F.explode("selected").alias("identity")).join(rows, "identity", "left")
    pairs = cards.plausible_rows(purchases, ledger).select("purchase_id", "sheet_id", F.lit(True).alias("fits"))
    priced = chosen.join(purchases.select(F.col("id").alias("purchase_id"), F.col("amount").alias("price")), "purchase_id", "left").join(ledger.select(F.col("id").alias("sheet_id"), "amount", cards.is_card_cost(F.col("direction"), F.col("payment_method"), F.col("type")).alias("card")), "sheet_id", "left")
    told = priced.join(pairs, ["purchase_id", "sheet_id"], "left").groupBy("key").agg(F.count("sheet_id").alias("found"), F.count("fits").alias("fitting"), F.max(F.coalesce((F.col("amount") == F.col("price")) & F.col("card"), F.lit(False))).alias("same"))
    open_ = asked.select("key", "purchase_id").join(pairs, "purchase_id").join(chosen.select("key", "sheet_id").filter("sheet_id is not null").withColumn("named", F.lit(True)), ["key", "sheet_id"], "left").groupBy("key").agg(F.count("*").alias("all"), F.count_if(F.col("named").isNull()).alias("others"))
    both = asked.join(told, "key", "left").join(open_, "key", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    known, kind = F.col("purchase_id").isNotNull(), F.col("kind")
    out = (
        F.when(~F.col("valid"), "INVALID").when(kind == "CARD_PURCHASE_IGNORED", F.when(known, "VALID").otherwise("ORPHANED")).when(kind == "CARD_MISSING_CONFIRMED", F.when(~known, "ORPHANED").when(n("all") > 0, "STALE").otherwise("VALID"))
        .when(kind == "STATEMENT_MATCH_CONFIRMED", F.when(n("found") == 0, "ORPHANED").when(~known, "NEEDS_REVIEW").when(n("fitting") > 0, "VALID").when(F.col("same"), "NEEDS_REVIEW").otherwise("STALE"))
        .otherwise(F.when(~known, "NEEDS_REVIEW").when(n("others") > 0, "STALE").when(n("all") > 0, "VALID").when(n("found") > 0, "STALE").otherwise("ORPHANED"))
    )
    return both.select("key", "kind", out.alias("status"))


def confirmed_pairs(decisions: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Valid bank confirmations: (bank_id, sheet_id, conflicting); a ledger row given to several bank rows conflicts. Confirmations of card purchases are another domain."""
    valid = status(decisions, bank, ledger).filter("kind = 'PAIR_CONFIRMED' and status = 'VALID'").select("key").distinct()
    pairs = resolve(decisions.filter("kind = 'PAIR_CONFIRMED'").join(valid, "key", "left_semi"), bank, ledger).select("bank_id", "sheet_id").distinct()
    owners = pairs.groupBy("sheet_id").agg(F.count_distinct("bank_id").alias("owners"))
    return pairs.join(owners, "sheet_id").select("bank_id", "sheet_id", (F.col("owners") > 1).alias("conflicting"))


def hydrate(decisions: DataFrame, bank: DataFrame, ledger: DataFrame, payments: DataFrame | None = None) -> Decided:
    """Valid decisions as the tables that a reconciliation takes. payments: bank_id of card bills that an invoice identifies."""
    valid = decisions.join(status(decisions, bank, ledger).filter("status = 'VALID'").select("key").distinct(), "key", "left_semi")
    named = resolve(valid, bank, ledger)
    pairs = confirmed_pairs(decisions, bank, ledger)
    added = named.filter("kind = 'MISSING_ADDED_TO_SHEET'").select("bank_id", "sheet_id").join(pairs.select("bank_id"), "bank_id", "left_anti")
    # The earliest decision comes first.
    since = named.filter("kind in ('PAIR_CONFIRMED', 'MISSING_ADDED_TO_SHEET')").groupBy("bank_id", "sheet_id").agg(F.min(F.unix_millis(F.try_to_timestamp("updated_at"))).alias("place"))
    confirmed = pairs.filter("not conflicting").select("bank_id", "sheet_id").unionByName(added).distinct().join(since, ["bank_id", "sheet_id"], "left")
    composed = decisions.filter((F.col("kind") == "COMPOSITION_CONFIRMED") & is_valid()).select(F.get("identities", F.lit(0)).alias("identity"), F.col("selected").alias("identities")).join(identified(bank), "identity").select(F.col("id").alias("bank_id"), "identities")
    tables = {
        "ignored": named.filter("kind = 'BANK_IGNORED'").select("bank_id"), "rejected": named.filter("kind = 'PAIR_REJECTED'").select("bank_id", "sheet_id", F.col("key").alias("decision_key")), "confirmed": confirmed,
        "conflicting": pairs.filter("conflicting").select("bank_id", "sheet_id"), "compositions": composed,
    }
    return decided(decisions.sparkSession, **tables, **({"identified": payments} if payments is not None else {}))


def statement_assignments(decisions: DataFrame, aliases: DataFrame, purchases: DataFrame, ledger: DataFrame) -> DataFrame:
    """Confirmed rows of card purchases that still fit: (key, purchase_id, sheet_id, conflicting); a row with several purchases conflicts, names of one purchase don't."""
    asked = decisions.filter("kind = 'STATEMENT_MATCH_CONFIRMED'").select("key", F.get("identities", F.lit(0)).alias("identity"), F.get("selected", F.lit(0)).alias("row"))
    rows = identified(ledger).select(F.col("identity").alias("row"), F.col("id").alias("sheet_id"))
    pairs = cards.plausible_rows(purchases, ledger).select("purchase_id", "sheet_id").distinct()
    found = asked.join(aliases.select("identity", "purchase_id").distinct(), "identity").join(rows, "row").join(pairs, ["purchase_id", "sheet_id"], "left_semi")
    owners = found.groupBy("sheet_id").agg(F.count_distinct("purchase_id").alias("owners"))
    return found.join(owners, "sheet_id").select("key", "purchase_id", "sheet_id", (F.col("owners") > 1).alias("conflicting"))


def superseded_owners(decisions: DataFrame, new: DataFrame, aliases: DataFrame) -> DataFrame:
    """Confirmations that new ones replace: those of the same ledger row for another purchase. new: purchase_id, row."""
    asked = decisions.filter("kind = 'STATEMENT_MATCH_CONFIRMED'").select("*", F.get("identities", F.lit(0)).alias("identity"), F.get("selected", F.lit(0)).alias("row"))
    owned = asked.join(aliases.select("identity", F.col("purchase_id").alias("owner")).distinct(), "identity", "left").join(new.select("row", "purchase_id").distinct(), "row")
    return owned.filter(F.col("owner").isNull() | (F.col("owner") != F.col("purchase_id"))).select("key").distinct()


def bury(decisions: DataFrame, tombstones: DataFrame, now: str) -> DataFrame:
    """Tombstones with one more for each decision, later than the decision and any tombstone before: (key, updated_at). tombstones: key, updated_at."""
    at = lambda c: F.try_to_timestamp(c)
    old = tombstones.groupBy("key").agg(F.max(at("updated_at")).alias("old"))
    later = lambda c: F.coalesce(F.col(c) + F.expr("INTERVAL 1 MILLISECOND"), F.lit("1970-01-01").cast("timestamp"))
    fresh = decisions.groupBy("key").agg(F.max(at("updated_at")).alias("seen")).join(old, "key", "left").select("key", F.greatest(F.lit(now).cast("timestamp"), later("seen"), later("old")).alias("at"))
    kept = old.join(fresh.select("key"), "key", "left_anti").select("key", F.col("old").alias("at"))
    return kept.unionByName(fresh).select("key", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"))


def upsert(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of a decision table after changed ones replace theirs by key; created_at stays where it can be read, else it is the change's time, and deletions come first (place). existing, changed: key, state, updated_at; existing also created_at."""
    new = changed.select("key", F.col("state").alias("new_state"), F.col("updated_at").alias("new_at"))
    both = existing.join(new, "key", "full")
    made = F.when(F.try_to_timestamp("created_at").isNotNull(), F.col("created_at")).otherwise(F.coalesce("new_at", "created_at"))
    touched = F.col("new_state").isNotNull()
    return both.select("key", F.coalesce("new_state", "state").alias("state"), F.coalesce("new_at", "updated_at").alias("updated_at"), made.alias("created_at"), F.when(~touched, 0).when(F.col("new_state") == "DELETED", 1).otherwise(2).alias("place"))


def refused_pairs(trace: DataFrame, decisions: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Edges that a valid refusal keeps out, which may be reconsidered: (bank_id, sheet_id, decision_key). trace: as a reconciliation gives it."""
    valid = status(decisions, bank, ledger).filter("kind = 'PAIR_REJECTED' and status = 'VALID'").select(F.col("key").alias("decision_key")).distinct()
    return trace.filter("disposition = 'REJECTED_BY_DECISION'").join(valid, "decision_key", "left_semi").select("bank_id", "sheet_id", "decision_key")


def resolvable(listed: DataFrame, decisions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Listed assignments of a conflict that the user may end: named once in their finding, active, not buried, and about that row. listed: finding, row, key."""
    once = listed.groupBy("finding", "row", "key").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    last = tombstones.groupBy("key").agg(F.max(F.try_to_timestamp("updated_at")).alias("gone"))
    active = decisions.filter("kind = 'PAIR_CONFIRMED' and size(selected) = 1").join(last, "key", "left").filter(F.col("gone").isNull() | (F.col("gone") < F.try_to_timestamp("updated_at")))
    return once.join(active.select("key", F.get("selected", F.lit(0)).alias("row")), ["key", "row"], "left_semi").select("finding", "row", "key")


def live_pairs(pairs: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs (bank_id, sheet_id) both of whose rows are still there."""
    return pairs.join(bank.select(F.col("id").alias("bank_id")), "bank_id", "left_semi").join(ledger.select(F.col("id").alias("sheet_id")), "sheet_id", "left_semi")


def replace(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions after new pair decisions: those of the same key and an older opposite of the same pair go."""
    pair = F.when(F.col("kind") == "PAIR_REJECTED", F.col("identities")).when(F.col("kind") == "PAIR_CONFIRMED", F.concat("identities", "selected"))
    fresh = new.withColumn("pair", pair)
    old = decisions.withColumn("pair", pair).join(fresh.select("key"), "key", "left_anti").join(fresh.filter("pair is not null").select("pair"), "pair", "left_anti")
    return old.drop("pair").unionByName(new)


def effective_revision(decisions: DataFrame) -> DataFrame:
    """One row (decisions, revision) of the effective set; order doesn't matter and no list is gathered."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("@", "key", "updated_at")), 1, 15), 16, 10).cast("decimal(20,0)")
    return decisions.agg(F.count("*").alias("decisions"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("revision"))
