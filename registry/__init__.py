"""Registered queries: each pairs a Spark job over the driver's tables with its SQL counterpart."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoprank.functions.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

_SPARK = {"long": "bigint", "int": "int", "str": "string", "float": "double", "date": "date", "bool": "boolean"}
_SQL = {"long": "BIGINT", "int": "INTEGER", "str": "VARCHAR", "float": "DOUBLE", "date": "DATE", "bool": "BOOLEAN"}
SCALE = 1e6
# Means over 2, 4, 8, ... rows often end exactly half way between two roundings, where the last bit
# decides. Both engines add this before rounding, which moves such values off the edge.
NUDGE = 3.7e-9


def _schema(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in text.split()]


def _spark_side(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in schema:
        column = F.col(f"`{name}`").cast(_SPARK[kind])
        # floats are compared to six decimals: sums are added in a different order in either engine
        out.append((F.floor((column + NUDGE) * SCALE + 0.5) / SCALE if kind == "float" else column).alias(name))
    return df.select(*out)


def _needed(body: str) -> list[str]:
    """Every named building block that `body` mentions, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return order


def with_ctes(body: str) -> str:
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in _needed(body))
    return f"WITH {head}\n{body}" if head else body


def of_fold(name: str, k: int) -> str:
    """The building block `name`, which stands for the newest fold, for fold k: it and all it rests on are copied under other names."""
    if k == 0:
        return name
    copies: dict[str, str] = {}
    for block in [*_needed(CTES[name]), name]:
        text = CTES[block].replace("s.fold = 'fold_0'", f"s.fold = 'fold_{k}'")
        for old, new in copies.items():
            text = re.sub(rf"\b{old}\b", new, text)
        if text != CTES[block]:
            copies[block] = f"{block}_of_{k}"
            CTES[copies[block]] = text
    return copies[name]


def _sql_side(body: str, schema: list[tuple[str, str]]) -> str:
    out = []
    for name, kind in schema:
        cast = f'CAST("{name}" AS {_SQL[kind]})'
        out.append(f'floor(({cast} + {NUDGE}) * {SCALE} + 0.5) / {SCALE} AS "{name}"' if kind == "float" else f'{cast} AS "{name}"')
    return with_ctes(f"SELECT {', '.join(out)} FROM ({body}) answer")


def query(name: str, schema: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` with its result columns and, where there is one, its SQL."""
    columns = _schema(schema)

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _spark_side(fn(tune(spark), sf_dir), columns)

        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _sql_side(sql, columns)
        return fn

    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def load_all() -> None:
    for module in ("tables", "preparation", "candidates", "feature_blocks", "lists", "reports",
                   "exploration", "studies", "ranking", "stages"):
        importlib.import_module(f"registry.{module}")
