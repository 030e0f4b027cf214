"""Every operator as a query over the supplied tables, next to the SQL that must give the same rows."""

from catalogue.registry import QUERIES, SQL

from catalogue import charts, cleaning, features, measures, modelling, profiling, sources, targets, splits  # noqa: F401, E402

__all__ = ["QUERIES", "SQL"]
