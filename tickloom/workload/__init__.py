"""Queries over the given tables, one per operator."""


def load():
    """The registry with every query module imported."""
    from tickloom.workload import (
        comparisons,
        events,
        ledgers,
        market,
        rankings,
        registry,
        storage,
    )

    _ = (comparisons, events, ledgers, market, rankings, storage)
    return registry
