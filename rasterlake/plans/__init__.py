"""Queries over images that are derived from the tables, with the SQL that computes the same."""
