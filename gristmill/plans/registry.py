"""All queries of the core with their SQL."""

from __future__ import annotations

from gristmill.plans import domain, pipeline, problems, records  # noqa: F401, domain and records add their queries to those of the pipeline

QUERIES = pipeline.QUERIES | problems.QUERIES
ORACLE = pipeline.ORACLE | problems.ORACLE
