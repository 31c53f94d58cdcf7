"""All registered queries: importing this module imports every query module."""

from tessera.plans import q_daily, q_functions, q_model, q_relational, q_streaming, q_windows  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
