"""All queries of the library by name, with their SQL where it has one."""

from __future__ import annotations

from quarryline.plans import aggregates, blocks, boards, clusters, feeds, files, influence, joins, measuring, migration, queues, reports, rules, scalars, scores, selections, sequences, sinks, streams, unified  # noqa: F401
from quarryline.plans.registration import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "author_outliers"
