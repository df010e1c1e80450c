"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from cleanloom.catalog.registry import ORACLES, QUERIES
from cleanloom.catalog import advice, cleaning, files, imputation, numbers, profiles, recipes, texts  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
