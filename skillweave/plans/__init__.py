"""Queries: each a name, a function of (spark, folder of tables), and SQL that states its result."""
