"""Registry of runnable queries: one per operator, each with its DuckDB
oracle (when SQL can state the result).

Every query reads whole driver tables (or data Spark derives from them); the
registry adds flattening projections only so that results compare as flat
rows.  Oracles are plain DuckDB SQL over the pre-registered table views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle.strip()
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # importing the modules registers their queries
    from tagweave.plans import (  # noqa: F401
        q_annotate, q_tokens, q_labels, q_evaluate, q_sentences, q_sources,
        q_pieces, q_sampling, q_decode, q_runlog, q_tagger, q_misc,
    )
