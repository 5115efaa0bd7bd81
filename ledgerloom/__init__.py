"""Reconciliation analytics on Spark: candidate joins, assignment, audits and the ingestion around them."""
