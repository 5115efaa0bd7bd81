"""Consistency audit: provenance of rows across sources, claims on ledger rows, findings and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_description, transaction_type

FINDING = ["code", "severity", "subject", "related"]


def _finding(rows: DataFrame, code: str, severity: str, subject: Column, related: Column | None = None) -> DataFrame:
    related = related if related is not None else F.lit(None).cast("array<string>")
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), related.alias("related"))


def provenance(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows without an active source, and sources that name a missing row. entities: id, source_ids; sources: source_id, entity_ids."""
    told = sources.select("source_id", F.explode("entity_ids").alias("id"))
    held = entities.select("id", F.explode("source_ids").alias("source_id"))
    lost = told.join(entities.select("id"), "id", "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("source_id")).alias("from"))
    backed = held.join(sources.select("source_id"), "source_id", "left_semi").select("id").distinct()
    bare = entities.join(backed, "id", "left_anti")
    return _finding(lost, "SOURCE_POINTS_TO_MISSING_ENTITY", "REVIEW", F.col("id"), F.col("from")).unionByName(_finding(bare, "ACTIVE_ENTITY_WITHOUT_SOURCE", "REVIEW", F.col("id")))


def duplicates_across_sources(bank: DataFrame) -> DataFrame:
    """Equal movements (date, amount, direction, text) that stand as separate rows of disjoint sources: (date, amount, direction, said, id), one row for each row concerned.

    A row is concerned if any equal row shares no source with it. Rows with the same set of sources behave alike, so only the sets of a movement are compared, and ids, however many, are joined back to them; rows
    without a source are left out. bank: id, source_ids (or source_id), date, amount, direction, original_description.
    """
    given = F.col("source_ids") if "source_ids" in bank.columns else F.array("source_id")
    key = ["date", "amount", "direction", "said"]
    rows = bank.select("id", F.array_sort(F.array_distinct(F.array_compact(given.cast("array<string>")))).alias("sources"), "date", "amount", "direction", normalize_description(F.coalesce("original_description", F.lit(""))).alias("said"))
    rows = rows.filter(F.size("sources") > 0)
    sets = rows.select(*key, "sources").distinct()
    apart = sets.join(sets.withColumnRenamed("sources", "others"), key).filter(~F.arrays_overlap("sources", "others")).select(*key, "sources").distinct()
    return rows.join(apart, [*key, "sources"], "left_semi").select(*key, "id")


def duplicate_findings(members: DataFrame) -> DataFrame:
    """One finding per movement of duplicates_across_sources() with the ids of all rows concerned."""
    met = members.groupBy("date", "amount", "direction", "said").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return _finding(met, "DUPLICATE_BANK_TRANSACTION_ACROSS_STATEMENTS", "REVIEW", F.get("ids", F.lit(0)), F.slice("ids", 2, 1 << 30))


def source_conflicts(bank: DataFrame, left: str, right: str) -> DataFrame:
    """Movements named by the same document in two sources, once in each, that differ in date, amount, direction or balance: (document, differs)."""
    fields = ["date", "amount", "direction", "balance_after"]

    def single(source: str, mark: str) -> DataFrame:
        rows = bank.filter((F.col("source_id") == source) & (F.coalesce("document", F.lit("")) != ""))
        one = rows.groupBy("document").agg(F.count("*").alias("n"), *(F.min(f).alias(f"{mark}_{f}") for f in fields))
        return one.filter("n = 1").drop("n")

    both = single(left, "l").join(single(right, "r"), "document")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields)))
    return both.select("document", differs.alias("differs")).filter(F.size("differs") > 0)


def double_claims(claims: DataFrame) -> DataFrame:
    """Ledger rows that several subjects claim: (sheet_id, owners, confirmed). claims: subject, sheet_id, confirmed."""
    per_owner = claims.filter("sheet_id is not null").groupBy("sheet_id", "subject").agg(F.max("confirmed").alias("confirmed"))
    return per_owner.groupBy("sheet_id").agg(F.count("*").alias("owners"), F.count_if("confirmed").alias("confirmed")).filter("owners > 1")


def state_findings(items: DataFrame, edges: DataFrame, claims: DataFrame, refunds: DataFrame | None = None) -> DataFrame:
    """Findings about the states of bank rows. items: bank_id, status, review_reason, sheet_id, composition, type, direction, text; edges: bank_id, disposition (plausible edges as traced); claims: as for double_claims;
    refunds: status, original_ids.

    A missing expense with any plausible ledger row is critical, unless all of them were refused by valid decisions, which is expected. A review needs a candidate row; a conflict counts as one only with its candidate.
    """
    tried = edges.groupBy("bank_id").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "REJECTED_BY_DECISION").alias("refused"))
    rows = items.join(tried, "bank_id", "left")
    if refunds is not None:
        back = refunds.filter("status = 'REFUNDED'").select(F.explode("original_ids").alias("bank_id"), F.lit(True).alias("returned")).distinct()
        rows = rows.join(back, "bank_id", "left")
    else:
        rows = rows.withColumn("returned", F.lit(None).cast("boolean"))
    rows = rows.withColumn("means_card", transaction_type(F.coalesce("text", F.lit(""))) == "CARD_PAYMENT")
    expense = "status = 'MISSING' and direction = 'DEBIT' and type = 'EXPENSE' and n > 0"
    cases = [
        ("MATCHED_WITHOUT_LINK", "CRITICAL", "status = 'MATCHED' and sheet_id is null and coalesce(size(composition), 0) <= 0"),
        ("REVIEW_WITHOUT_CANDIDATES", "REVIEW", "status = 'REVIEW' and sheet_id is null"),
        ("ASSIGNMENT_CONFLICT", "REVIEW", "status = 'REVIEW' and review_reason = 'ASSIGNMENT_CONFLICT' and sheet_id is not null"),
        ("MISSING_WITH_STRONG_CANDIDATE", "CRITICAL", f"{expense} and refused < n"),
        ("EXPECTED_MANUAL_REJECTION", "INFO", f"{expense} and refused = n"),
        ("CARD_PAYMENT_AS_EXPENSE_MISSING", "CRITICAL", "status = 'MISSING' and (type = 'CARD_PAYMENT' or means_card)"),
        ("REFUNDED_BUT_MISSING", "CRITICAL", "status = 'MISSING' and returned"),
    ]
    labels = F.array_compact(F.array(*(F.when(F.expr(test), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in cases)))
    found = rows.select(F.explode(labels).alias("f"), F.col("bank_id").alias("subject"), F.when(F.col("sheet_id").isNotNull(), F.array("sheet_id")).alias("related")).select("f.*", "subject", "related")
    return found.unionByName(_finding(double_claims(claims), "DOUBLE_CLAIM", "CRITICAL", F.col("sheet_id")))


def invoice_findings(statements: DataFrame, subtotals: DataFrame) -> DataFrame:
    """Findings about the sums of invoices: INVOICE_TOTAL_MISMATCH (the equation is off) and CARD_SUBTOTAL_MISMATCH (reported subtotals don't add up). statements: statement, total, difference; subtotals: statement, amount."""
    off = _finding(statements.filter("difference <> 0"), "INVOICE_TOTAL_MISMATCH", "REVIEW", F.col("statement"))
    sums = subtotals.groupBy("statement").agg(F.sum("amount").alias("sum")).join(statements.select("statement", "total"), "statement").filter("total <> sum")
    return off.unionByName(_finding(sums, "CARD_SUBTOTAL_MISMATCH", "REVIEW", F.col("statement")))


def mismatch_severity(pure: Column, current: Column, can_append: Column) -> Column:
    """How grave it is that a purchase's state differs from what matching alone gives."""
    matched = lambda c: c.isin("CARD_MATCHED", "CARD_GROUP_MATCHED")
    return (
        F.when(matched(pure) & (current == "CARD_MISSING") | (pure == "CARD_MISSING") & matched(current) | (pure == "CARD_REVIEW") & (current == "CARD_MISSING") & can_append, "CRITICAL")
        .when((pure == "CARD_REVIEW") & (current == "CARD_GROUP_MATCHED"), "INFO").otherwise("REVIEW")
    )


def card_state_findings(pure: DataFrame, current: DataFrame, can_append: DataFrame) -> DataFrame:
    """DERIVED_STATE_MISMATCH of purchases whose state differs from the recomputed one. pure, current: purchase_id, status; can_append: purchase_id of purchases that may still be written to the ledger."""
    both = pure.select("purchase_id", F.col("status").alias("pure")).join(current.select("purchase_id", F.col("status").alias("now")), "purchase_id").filter(F.col("pure") != F.col("now"))
    both = both.join(can_append.select("purchase_id", F.lit(True).alias("open")).distinct(), "purchase_id", "left")
    grave = mismatch_severity(F.col("pure"), F.col("now"), F.coalesce("open", F.lit(False)))
    return both.select(F.lit("DERIVED_STATE_MISMATCH").alias("code"), grave.alias("severity"), F.col("purchase_id").cast("string").alias("subject"), F.array("pure", "now").alias("related"))


# The invariant that each code breaks.
INVARIANT = {
    "DOUBLE_CLAIM": "INV-01", "DOUBLE_CLAIM_AFTER_CONFIRMATION": "INV-02", "ORPHANED_SHEET_REFERENCE": "INV-02", "EDITED_SHEET_REFERENCE": "INV-02", "MISSING_COM_CANDIDATO": "INV-03", "MISSING_WITH_STRONG_CANDIDATE": "INV-03", "ASSIGNMENT_CONFLICT": "INV-03",
    "REVIEW_WITHOUT_CANDIDATES": "INV-03", "MISSING_ACTION_INCONSISTENCY": "INV-04", "CARD_PAYMENT_AS_EXPENSE_MISSING": "INV-05", "REFUNDED_BUT_MISSING": "INV-06", "STALE_ACTIVE_SOURCE": "INV-07", "DERIVED_STATE_MISMATCH": "INV-08", "MATCHED_WITHOUT_LINK": "INV-08",
    "INVOICE_TOTAL_MISMATCH": "INV-13", "CARD_SUBTOTAL_MISMATCH": "INV-13", "REFUND_NET_MISMATCH": "INV-06", "ACTIVE_ENTITY_WITHOUT_SOURCE": "INV-07", "SOURCE_POINTS_TO_MISSING_ENTITY": "INV-07", "SOURCE_CONFLICT": "INV-07", "MISSING_COUNT_DIVERGENCE": "INV-09",
}
#: Codes that depend on derived results; they weigh less when the inputs have changed meanwhile.
DEPENDENT = ["CURRENT_SOURCE_DIVERGENCE", "STALE_DECISION_RESULT", "VALID_BANK_MANUAL_MATCH_NOT_APPLIED", "VALID_MANUAL_MATCH_NOT_APPLIED", "REJECTED_CANDIDATE_FILTERED", "MISSING_COM_CANDIDATO", "MISSING_WITH_STRONG_CANDIDATE", "DERIVED_STATE_MISMATCH", "MISSING_ACTION_INCONSISTENCY", "CARD_PAYMENT_AS_EXPENSE_MISSING", "REVIEW_WITHOUT_CANDIDATES", "ASSIGNMENT_CONFLICT", "UNUSED_STRONG_CANDIDATE"]


def enrich(findings: DataFrame) -> DataFrame:
    """Findings with category, invariant, role and root cause: what breaks, which rule, whether a finding follows from another one, and the key that findings of one cause share."""
    code = F.col("code")
    category = (
        F.when(code.rlike("SOURCE|DRIVE|INVOICE_SOURCE"), "SOURCE").when(code.rlike("DUPLICATE|FITID|OVERLAP|DEDUP"), "IDENTITY")
        .when(code.rlike("DECISION|TOMBSTONE|FINGERPRINT|SYNC|DOUBLE_CLAIM|WRONG_DECISION_DOMAIN|RESERVED_SHEET_ROW_REUSED|EXPECTED_MANUAL_RESERVATION"), "DECISION").when(code.rlike("REFUND|INVOICE|SUBTOTAL|BALANCE|PAYMENT|COUNT"), "FINANCIAL").otherwise("STATE")
    )
    named = F.create_map(*(F.lit(x) for pair in INVARIANT.items() for x in pair))
    fallback = F.when(category == "SOURCE", "INV-07").when(category == "IDENTITY", "INV-14").when(category == "FINANCIAL", "INV-13").when(category == "DECISION", "INV-08").otherwise("INV-03")
    role = F.when(code.startswith("EXPECTED_"), "EXPECTED").when(F.col("severity") == "INFO", "INFO").when(code.isin("ASSIGNMENT_CONFLICT", "UNUSED_STRONG_CANDIDATE"), "RELATED").otherwise("PRIMARY")
    cause = F.when(code.isin("ASSIGNMENT_CONFLICT", "UNUSED_STRONG_CANDIDATE", "MISSING_COM_CANDIDATO", "MISSING_WITH_STRONG_CANDIDATE", "MISSING_ACTION_INCONSISTENCY"), "RECONCILIATION_ASSIGNMENT").when(
        code.isin("DOUBLE_CLAIM", "DOUBLE_CLAIM_AFTER_CONFIRMATION", "RESERVED_SHEET_ROW_REUSED"), "OWNERSHIP").otherwise(code)
    return findings.select("*", category.alias("category"), F.coalesce(F.try_element_at(named, code), fallback).alias("invariant"), role.alias("role"), F.concat_ws(":", cause, "subject").alias("root_cause"))


def group_by_cause(findings: DataFrame) -> DataFrame:
    """Enriched findings with one primary finding per root cause, the gravest, and the codes of the others and of related ones beside it (related_codes); findings of another role stay, related ones only where nothing absorbs them."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "REVIEW", 1).otherwise(2)
    cols = [c for c in findings.columns if c != "root_cause"]
    primary = findings.filter("role = 'PRIMARY'").groupBy("root_cause").agg(F.min(F.struct(rank.alias("rank"), *cols)).alias("top"), F.collect_set("code").alias("codes"))
    related = findings.filter("role = 'RELATED'").groupBy("root_cause").agg(F.collect_set("code").alias("more"))
    kept = primary.join(related, "root_cause", "left").select("root_cause", *(F.col(f"top.{c}").alias(c) for c in cols), F.array_sort(F.array_except(F.array_union("codes", F.coalesce("more", F.array().cast("array<string>"))), F.array("top.code"))).alias("related_codes"))
    rest = findings.filter("role <> 'PRIMARY'").join(primary.select("root_cause", F.lit(True).alias("absorbed")), "root_cause", "left").filter("role <> 'RELATED' or absorbed is null").drop("absorbed").withColumn("related_codes", F.array().cast("array<string>"))
    return kept.unionByName(rest.select(kept.columns))


def snapshot_state(captured: DataFrame, current: DataFrame) -> DataFrame:
    """One row (state, stale): STALE if any source's revision differs from the captured one, MIXED_REVISION, PARTIAL or COMPLETE. captured, current: source, revision, mixed, unavailable."""
    both = captured.select("source", F.col("revision").alias("then"), F.col("mixed").alias("m1"), F.col("unavailable").alias("u1")).join(current.select("source", F.col("revision").alias("now"), F.col("mixed").alias("m2"), F.col("unavailable").alias("u2")), "source", "full")
    any_ = lambda *c: F.coalesce(F.max(F.coalesce(c[0], F.lit(False)) | F.coalesce(c[1], F.lit(False))), F.lit(False))
    out = both.agg(F.array_sort(F.collect_list(F.when(~F.col("then").eqNullSafe(F.col("now")), F.col("source")))).alias("stale"), any_(F.col("m1"), F.col("m2")).alias("mixed"), any_(F.col("u1"), F.col("u2")).alias("partial"))
    return out.select(F.when(F.size("stale") > 0, "STALE").when(F.col("mixed"), "MIXED_REVISION").when(F.col("partial"), "PARTIAL").otherwise("COMPLETE").alias("state"), "stale")


def finalize(findings: DataFrame, state: str) -> DataFrame:
    """Findings under the state of the inputs: with stale or mixed inputs dependent codes become REVIEW, confidence is LOW and the mismatch itself is reported; with partial ones confidence is at most MEDIUM. findings: also confidence."""
    uncertain = state in ("STALE", "MIXED_REVISION")
    grave = F.when(F.lit(uncertain) & F.col("code").isin(DEPENDENT), "REVIEW").otherwise(F.col("severity"))
    sure = F.lit("LOW") if uncertain else F.lit("MEDIUM") if state == "PARTIAL" else F.col("confidence")
    out = findings.withColumn("severity", grave).withColumn("confidence", sure)
    if not uncertain:
        return out
    own = findings.sparkSession.createDataFrame([("AUDIT_INPUT_REVISION_MISMATCH", "REVIEW", state, "LOW")], "code string, severity string, subject string, confidence string")
    return out.unionByName(own, allowMissingColumns=True)


def confidence(comparable: Column, coverage: Column, identity: Column, evidence: Column, valid_decision: Column, canonical_target: Column) -> Column:
    """How sure a diagnosis is: LOW without comparable, whole inputs and known identities, HIGH with canonical identities and enough evidence, else MEDIUM."""
    weak = ~comparable | (coverage == "PARTIAL") | (identity == "INCOMPLETE")
    return F.when(weak, "LOW").when((identity == "CANONICAL") & (evidence >= 2) & (valid_decision | canonical_target | (evidence >= 4)), "HIGH").when(evidence > 0, "MEDIUM").otherwise("LOW")


def finding_filter(findings: DataFrame, kind: str) -> DataFrame:
    """Findings shown under a filter: ALL, CRITICAL, REVIEW, LEGACY (legacy and maintenance ones, by lifecycle) or HIDDEN (none)."""
    return findings if kind == "ALL" else findings.limit(0) if kind == "HIDDEN" else findings.filter(F.col("lifecycle").isin("LEGACY", "MAINTENANCE")) if kind == "LEGACY" else findings.filter(F.col("severity") == kind)


# Codes that speak of the state of one card purchase.
CARD_STATE = ["MISSING_COM_CANDIDATO", "CARD_MISSING_NO_CANDIDATE", "DERIVED_STATE_MISMATCH", "PREWRITE_MATCH_MISMATCH", "STALE_MISSING_DECISION", "ORPHANED_SHEET_REFERENCE", "EDITED_SHEET_REFERENCE", "CURRENT_SOURCE_DIVERGENCE", "REJECTED_CANDIDATE_FILTERED"]


def _weight(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "REVIEW", 1).otherwise(2)


def collapse(findings: DataFrame) -> DataFrame:
    """Findings with one row for all codes about the card state of a subject: the gravest, of equals the first code, with the others as `others`. A finding of any other code keeps its own row, repeated ones count once."""
    about = F.when(F.col("code").isin(CARD_STATE), "card state").otherwise(F.col("code"))
    kept = findings.groupBy("subject", about.alias("about")).agg(F.min(F.struct(_weight(F.col("severity")).alias("rank"), "code", "severity")).alias("top"), F.collect_set("code").alias("codes"))
    return kept.select("subject", "top.code", "top.severity", F.array_sort(F.array_except("codes", F.array("top.code"))).alias("others"))


def lifecycle(findings: DataFrame) -> DataFrame:
    """Enriched findings with status: LEGACY for codes and fingerprints of former versions, MAINTENANCE for harmless references to rows that went or changed, EXPECTED for what a decision, group, refund,
    source or synchronisation explains, else ACTIVE."""
    code, harmless = F.col("code"), F.col("severity") == "INFO"
    explained = code.rlike("REFUND|STALE_ACTIVE_SOURCE|DUPLICATE_PRESENT_BUT_MARKED_MISSING|IGNORED|TOMBSTONE|SYNC|DECISION|ASSIGNMENT_CONFLICT") | code.startswith("EXPECTED_")
    status = (
        F.when(code.isin("NEWER_TOMBSTONE_EXISTS", "LEGACY_FINGERPRINT_MATCH"), "LEGACY").when(harmless & code.isin("ORPHANED_SHEET_REFERENCE", "EDITED_SHEET_REFERENCE"), "MAINTENANCE").when(harmless & explained, "EXPECTED").otherwise("ACTIVE")
    )
    return findings.withColumn("status", status)


def audit_summary(findings: DataFrame) -> DataFrame:
    """One row of distinct root causes: critical, review, maintenance, legacy, informational, and attention (critical or review). findings: severity, status, role, root_cause; related ones don't count."""
    n = lambda test: F.count_distinct(F.when(F.expr(test), F.col("root_cause")))
    return findings.filter("role <> 'RELATED'").agg(
        n("severity = 'CRITICAL'").alias("critical"), n("severity = 'REVIEW'").alias("review"), n("status = 'MAINTENANCE'").alias("maintenance"), n("status = 'LEGACY'").alias("legacy"), n("severity = 'INFO'").alias("informational"),
        n("severity in ('CRITICAL', 'REVIEW')").alias("attention"),
    )


# Keys of technical details that say nothing of their matter.
IMMATERIAL = r"(?i)^(?:timestamp|updatedAt|auditedAt|createdAt|position|index|order)$"


def material(details: Column) -> Column:
    """A text that is equal for details (a map of names to lists of texts) of the same matter: names in order, lists sorted, times and places left out."""
    kept = F.map_filter(details, lambda k, v: ~k.rlike(IMMATERIAL) & v.isNotNull())
    return F.to_json(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.struct(e["key"].alias("k"), F.array_sort(F.array_compact(e["value"])).alias("v"))))


def _dismissal_key() -> Column:
    return F.sha2(F.to_json(F.struct("code", "invariant", "subject", material(F.col("target")).alias("target"))), 256)


def _band() -> Column:
    """How much a finding touches: its declared impact, else more where the state isn't the one expected."""
    declared = F.array_position(F.array(*map(F.lit, ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.upper(F.coalesce("impact", F.lit("")))).cast("int")
    return F.when(declared > 0, declared - 1).when(F.col("current") != F.col("expected"), 2).otherwise(1)


def signed(findings: DataFrame) -> DataFrame:
    """Findings with key, by which a dismissal finds them again, and signature (cause, severity, band, evidence), by which it's seen whether they have become worse.

    findings: code, severity, invariant, subject, root_cause, target and technical (maps of names to lists of texts), impact, current, expected, identity (quality of the identities), comparable. The key depends on code,
    invariant, subject and target alone, however their parts are ordered; evidence is a set of classes.
    """
    has = lambda *names: F.exists(F.map_keys("technical"), lambda k: k.isin(list(names)))
    tried = F.try_element_at("technical", F.lit("candidateEvaluations"))
    evidence = F.array(
        F.concat(F.lit("IDENTITY_"), F.coalesce("identity", F.lit("UNKNOWN"))), F.concat(F.lit("DECISION_"), has("decision", "validManualConfirmation", "decisionId").cast("string")), F.concat(F.lit("ROW_"), has("row", "sheet").cast("string")),
        F.when(tried.isNull(), "CANDIDATE_EVIDENCE_UNKNOWN").when(F.size(tried) > 0, "CANDIDATES").otherwise("NO_CANDIDATES"), F.when(F.coalesce("comparable", F.lit(True)), "REVISION_COMPARABLE").otherwise("REVISION_UNCERTAIN"),
    )
    return findings.withColumn("key", _dismissal_key()).withColumn("signature", F.struct(F.col("root_cause").alias("cause"), (2 - _weight(F.col("severity"))).alias("severity"), _band().alias("band"), F.array_sort(evidence).alias("evidence")))


def dismissed(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """signed() findings with `visible`. dismissals: key, severity, signature (null for those of former versions), dismissed_at; the last of a key counts.

    A dismissal hides a finding until that is materially worse: graver, of another cause, of more impact, or with a class of evidence that wasn't there. Without a signature only the severity counts.
    """
    last = dismissals.groupBy("key").agg(F.max_by(F.struct((2 - _weight(F.col("severity"))).alias("severity"), "signature"), F.col("dismissed_at")).alias("then"))
    both = findings.join(last, "key", "left")
    now, then = F.col("signature"), F.col("then.signature")
    worse = (now["severity"] > F.col("then.severity")) | (then.isNotNull() & ((now["cause"] != then["cause"]) | (now["severity"] > then["severity"]) | (now["band"] > then["band"]) | (F.size(F.array_except(now["evidence"], then["evidence"])) > 0)))
    return both.withColumn("visible", F.col("then").isNull() | F.coalesce(worse, F.lit(True))).drop("then")


def hidden(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Findings with `visible`: a dismissal (code, subject, severity) hides a finding unless it has become graver."""
    weight = lambda c: F.when(c == "CRITICAL", 2).when(c == "REVIEW", 1).otherwise(0)
    gone = dismissals.groupBy("code", "subject").agg(F.max(weight(F.col("severity"))).alias("accepted"))
    return findings.join(gone, ["code", "subject"], "left").withColumn("visible", F.col("accepted").isNull() | (weight(F.col("severity")) > F.col("accepted"))).drop("accepted")


def invariant_executions(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """(invariant, status, findings) of each invariant: NOT_APPLICABLE, SKIPPED_DUE_TO_REVISION, UNAVAILABLE, EXECUTED_FAIL (a critical or review finding) or EXECUTED_PASS. findings: enriched; facts: invariant, applicable,
    mixed (its sources have different revisions), unavailable (one of them is missing)."""
    per_rule = findings.groupBy("invariant").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "REVIEW")).alias("open"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(~F.col("applicable"), "NOT_APPLICABLE").when(F.col("mixed"), "SKIPPED_DUE_TO_REVISION").when(F.col("unavailable"), "UNAVAILABLE").when(n("open") > 0, "EXECUTED_FAIL").otherwise("EXECUTED_PASS")
    return facts.join(per_rule, "invariant", "left").select("invariant", status.alias("status"), n("n").alias("findings"))


def invariants(findings: DataFrame, rules: dict[str, list[str]], skipped: tuple[str, ...] = ()) -> DataFrame:
    """PASS, FAIL or UNAVAILABLE per invariant with the number of its findings. rules: invariant and the codes that break it."""
    spark = findings.sparkSession
    table = spark.createDataFrame([(name, code) for name, codes in rules.items() for code in codes], "invariant string, code string")
    counts = findings.groupBy("code").agg(F.count("*").alias("n"))
    per_rule = table.join(counts, "code", "left").groupBy("invariant").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    status = F.when(F.col("invariant").isin(list(skipped)), "UNAVAILABLE").when(F.col("findings") > 0, "FAIL").otherwise("PASS")
    return per_rule.select("invariant", status.alias("status"), "findings")


def revision(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, revision) that changes when any row does and doesn't depend on order; summed hashes, so no row list is ever gathered."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("revision"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (p.select(*FINDING) for p in parts))
