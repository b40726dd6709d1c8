"""Queries over the test tables: fixtures, registered queries and their SQL."""
