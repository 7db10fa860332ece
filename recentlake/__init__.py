"""recentlake: page-change event analytics as Spark DataFrame operators.

Layout
------
functions/   Column -> Column helpers (bucketing, keys, parsing, formatting)
sources/     batch and streaming readers (lake files, Kafka rows, test tables)
sinks/       report / lake / Kafka-row writers
operators/   DataFrame -> DataFrame operators (ingest, reports, ranking,
             anomaly rules, live views, monitoring)
streaming/   Structured Streaming pipelines built from the same operators
plans/       the registered queries and their SQL oracles
"""

from recentlake.session import build_session, checkpoint_root  # noqa: F401

__all__ = ["build_session", "checkpoint_root"]
