"""The queries of the operators over timed text, by name, and their SQL."""

from cuelake.queries import answers, campaigns, documents, evidence, gates, inputs, reports, retries, samples, scalars, sequences, settings, stages, streams, tracks  # noqa: F401  they register their queries
from cuelake.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
