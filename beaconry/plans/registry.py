"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("text_plans", "warning_plans", "geo_plans", "queue_plans", "trade_plans", "record_plans", "io_plans", "stream_plans")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        found.update(getattr(import_module(f"beaconry.plans.{family}"), attribute))
    return found


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")
