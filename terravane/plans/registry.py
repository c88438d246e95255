"""All queries of the reference's operators, and their SQL."""

from __future__ import annotations

from terravane.plans import fieldlog_queries, log_queries, spatial_queries  # noqa: F401
from terravane.plans.helpers import ORACLES, QUERIES  # noqa: F401
