"""Named queries over the driver tables, each beside the SQL that must give the same rows."""

from quillgauge.catalog import diversity, reports, requests, rows, stores, streams, texts, transfer, vectors  # noqa: F401
from quillgauge.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
