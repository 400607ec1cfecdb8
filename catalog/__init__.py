"""Queries over the test tables, with the SQL each one is compared to."""
