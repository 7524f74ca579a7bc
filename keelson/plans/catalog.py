"""Imports every query module so the registry is complete."""

from __future__ import annotations

from keelson.plans import (  # noqa: F401
    deploy_queries,
    join_queries,
    manifest_queries,
    monitor_queries,
    properties_queries,
    stream_queries,
)
from keelson.plans.registry import ORACLE, QUERIES

FLAGSHIP = "m1_deployment_plan"

__all__ = ["QUERIES", "ORACLE", "FLAGSHIP"]
