"""Queries over the test tables, one or more for every operator of the library."""

from __future__ import annotations


def _load() -> None:
    from workload import (  # noqa: F401
        expressions,
        filters,
        aggregates,
        joins,
        io,
        text,
        flows,
    )


def all_queries():
    _load()
    from workload.registry import QUERIES

    return dict(QUERIES)


def all_twins():
    _load()
    from workload.registry import TWINS

    return dict(TWINS)
