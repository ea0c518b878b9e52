"""Registered queries: an operator applied to the driver's tables, with its SQL twin."""

from rosterforge.plans import registry


def load_all() -> tuple[dict, dict]:
    """Import every plan module and return (queries, oracle SQL)."""
    from rosterforge.plans import (  # noqa: F401
        curation, incremental, ingest, matchup, resolve, sources, text, usage, vectors,
    )
    return dict(registry.QUERIES), dict(registry.ORACLES)
