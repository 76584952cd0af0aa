"""Named queries: importing this package registers all of them."""

from vigilog.plans import alert_sql  # noqa: F401  (adds the alert views)
from vigilog.plans import (  # noqa: F401
    detect_queries,
    lookup_queries,
    parse_queries,
    rollup_queries,
    source_queries,
    stat_queries,
    stateful_queries,
    window_queries,
)
from vigilog.plans.catalog import ORACLES, QUERIES  # noqa: F401
