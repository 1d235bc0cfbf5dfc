"""Queries over the driver's tables, one per operator, with SQL that computes the same."""
