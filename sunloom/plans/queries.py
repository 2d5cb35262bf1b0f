"""All registered queries."""

from __future__ import annotations

from . import fields, models, series, stations  # noqa: F401  (registers their queries)
from .registry import QUERIES, SQL  # noqa: F401
