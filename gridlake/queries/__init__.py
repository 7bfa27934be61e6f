"""Named queries, one or more per operator, with SQL counterparts."""

from importlib import import_module

from .registry import ORACLE, QUERIES

for _module in ("tiles", "mosaics", "vectors", "evaluation", "training", "catalogs"):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLE", "QUERIES"]
