"""Queries over the given tables, each with the SQL that says what it must return."""

from checks import (  # noqa: F401
    cleaning,
    forecasting,
    reporting,
    rules,
    scalars,
    summaries,
)
from checks.registry import ORACLES, QUERIES  # noqa: F401
