"""Queries over the test tables: each applies operators of this library, with the SQL that must give the same rows."""

from tidewell.plans import ads, billing, computed, expressions, feeds, lines, ranks, relational, sales, usage, values  # noqa: F401  (they register their queries)
