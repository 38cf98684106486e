"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import aggregates, building, filters, jobs, joins, reporting, shapes, texts, windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
