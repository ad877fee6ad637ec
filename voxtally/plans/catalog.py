"""All registered queries."""

from voxtally.plans import file_queries, image_queries, region_queries, stat_queries  # noqa: F401
from voxtally.plans.registry import ORACLES, QUERIES  # noqa: F401
