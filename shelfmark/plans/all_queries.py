"""Imports every module that registers queries."""

from shelfmark.plans import generated, listings, pages, records, search, stored, structure  # noqa: F401
from shelfmark.plans.registry import ORACLES, QUERIES  # noqa: F401
