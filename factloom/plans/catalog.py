"""All registered queries."""

from factloom.plans import q_changes, q_cleaning, q_graph, q_ingest, q_reading, q_search  # noqa: F401
from factloom.plans.registry import ORACLES, QUERIES  # noqa: F401
