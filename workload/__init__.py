"""Queries over the given tables, the views derived from them, and the SQL that checks the results."""
