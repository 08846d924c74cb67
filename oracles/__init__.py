"""Registered queries and the DuckDB text that must give the same rows."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import analytics, derive, features, feeds, loads, models, stored, streams
    from oracles.prelude import with_prelude

    modules = (derive, analytics, loads, features, feeds, models, streams, stored)
    extra: dict[str, str] = {}
    for module in modules:
        extra |= getattr(module, "CTES", {})
    out: dict[str, str] = {}
    for module in modules:
        for name, sql in module.SQL.items():
            out[name] = with_prelude(sql, extra)
    return out
