"""A catalogue of queries, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


#: White space of any Unicode kind, as SQL's regular expressions take it.
WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL table expression."""

    def one(v: object) -> str:
        if v is None:
            return "null"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({names})"
