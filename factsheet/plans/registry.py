"""All registered queries and their SQL oracles, gathered from the plan modules."""

from __future__ import annotations


def all_queries() -> dict:
    from factsheet.plans import queries

    out = dict(queries.QUERIES)
    for mod in _extra_modules():
        out.update(getattr(mod, "QUERIES", {}))
    return out


def all_oracles() -> dict[str, str]:
    from factsheet.plans import oracle_queries

    out = dict(oracle_queries.ORACLE)
    for mod in _extra_modules():
        out.update(getattr(mod, "ORACLE", {}))
    return out


def _extra_modules() -> list:
    import importlib

    mods = []
    for name in ("factsheet.plans.admission_queries", "factsheet.plans.catalog_queries",
                 "factsheet.plans.prep_queries", "factsheet.plans.audit_queries"):
        try:
            mods.append(importlib.import_module(name))
        except ModuleNotFoundError as e:
            if e.name != name:
                raise
    return mods
