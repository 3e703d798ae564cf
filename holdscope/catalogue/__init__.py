"""Named queries over the test tables, one or more per operator."""

from holdscope.catalogue import browse, details, feeds, portfolio, series, stored  # noqa: F401
from holdscope.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
