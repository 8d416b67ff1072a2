"""Clause analytics on Spark: documents, clauses, claims, answers and their evaluation."""
