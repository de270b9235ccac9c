"""factloom: append-only fact logs as PySpark DataFrames.

A fact is (entity, attribute, value, transaction, op). Everything else here is derived from a
DataFrame of facts: current and as-of state, per-attribute relations, graph closures, profiles,
identity resolution, evidence checks and scores. Each operator is a DataFrame plan.
"""

from factloom.model import Attribute, FACT_SCHEMA
from factloom.store import FactLog

__all__ = ["Attribute", "FACT_SCHEMA", "FactLog"]
