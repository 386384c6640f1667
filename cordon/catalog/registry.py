"""Registry of runnable queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.catalog.oracle import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Nested and time columns as text, so both engines give comparable cells."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(t, T.MapType):
            pairs = F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))))
            c = F.array_join(pairs, ",")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, survey: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name."""

    def keep(fn):
        assert name not in QUERIES, name

        def run(spark, sf_dir):
            return flat(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        SURVEY_IDS[name] = survey
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return keep


def load() -> None:
    """Import every catalogue module once."""
    import importlib
    import pkgutil

    import cordon.catalog as pkg

    for mod in pkgutil.iter_modules(pkg.__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"cordon.catalog.{mod.name}")
