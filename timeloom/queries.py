"""All registered queries of the library without the training-data operators."""

from timeloom.operators import aggregates, casework, correlation, defender, findings, filters, graph, heuristics, ingest, integrity, ioc, lineage, objects, pages, projections, sequences, sinks, summaries, textindex, triage  # noqa: F401
from timeloom.registry import ORACLES, QUERIES  # noqa: F401
from timeloom.streaming import streams  # noqa: F401
