"""All queries on the reference's own operators."""

from . import aggregates, detail, graphs, more, reflection, retrieval, scans, sequences, stores, streams, texts  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES  # noqa: F401
