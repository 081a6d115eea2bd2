"""All queries of the library."""

from __future__ import annotations

from . import evalruns, facts, formal, intake, matching, profiles, streams, texts, vocab

ALL = {**matching.QUERIES, **facts.QUERIES, **texts.QUERIES, **streams.QUERIES, **intake.QUERIES, **profiles.QUERIES, **formal.QUERIES, **vocab.QUERIES, **evalruns.QUERIES}
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
