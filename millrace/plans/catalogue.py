"""All queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from millrace.plans.queries import edges, enrich, lifecycle, ordered, serving, streams, transform, validation  # noqa: F401  (they register themselves)
from millrace.plans.queries.base import ORACLES, QUERIES  # noqa: F401
