"""Checks of rows before they are published; each constraint costs one aggregate or one semi join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparrowsql.functions.dialect import SqlError


class Violation(SqlError):
    """Rows that a constraint rejects."""


def keys_of(table: dict) -> list[tuple[str, list[str]]]:
    """(name, columns) of the primary key and each unique constraint."""
    found = [("PRIMARY", table["primary_key"])] if table["primary_key"] else []
    return found + [(u["name"], u["columns"]) for u in table["uniques"]]


def all_null_safe(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def check_rows(df: DataFrame, table: dict, name: str, *also: Column) -> Row | None:
    """NOT NULL, ENUM, SET and CHECK of all rows, in one pass, which gives the aggregates in also as well."""
    tests: list[tuple[str, Column]] = []
    for c in table["columns"]:
        col = F.col(f"`{c['name']}`")
        if not c["nullable"] or c["name"] in table["primary_key"]:
            tests.append((f"column {c['name']} can't be null", col.isNull()))
        if c.get("enum"):
            tests.append((f"{c['name']} must be one of {c['enum']}", col.isNotNull() & ~col.isin(c["enum"])))
        if c.get("set"):
            allowed = F.array(*[F.lit(v) for v in c["set"]])
            parts = F.filter(F.split(col, ","), lambda x: x != "")
            tests.append((f"{c['name']} must hold only {c['set']}", col.isNotNull() & (F.size(F.array_except(parts, allowed)) > 0)))
    for check in table["checks"]:
        tests.append((f"check {check['name']} ({check['expr']})", ~F.coalesce(F.expr(check["expr"]), F.lit(True))))
    if not tests and not also:
        return None
    row = df.agg(*[F.count_if(bad).alias(f"t{i}") for i, (_, bad) in enumerate(tests)], *also).first()
    for i, (said, _) in enumerate(tests):
        if row[f"t{i}"]:
            raise Violation(f"{name}: {said}: {row[f't{i}']} rows")
    return row


def check_unique(df: DataFrame, table: dict, name: str) -> None:
    """No two rows of df share a key (nulls never clash)."""
    for key, columns in keys_of(table):
        twice = df.where(all_null_safe(columns)).groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1")
        if not twice.isEmpty():
            raise Violation(f"{name}: duplicate value for {key}")


def clashes(fresh: DataFrame, existing: DataFrame, table: dict) -> DataFrame:
    """The rows of fresh that share a key with an existing row."""
    parts = []
    for _, columns in keys_of(table):
        other = existing.where(all_null_safe(columns)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)])
        on = reduce(lambda a, b: a & b, [fresh[c] == F.col(f"__k{i}") for i, c in enumerate(columns)])
        parts.append(fresh.join(other, on, "left_semi"))
    return reduce(lambda a, b: a.union(b), parts) if parts else fresh.limit(0)


def check_parents(df: DataFrame, fk: dict, parent: DataFrame, name: str) -> None:
    """Every non-null value of the key's column stands in the parent."""
    other = parent.select(F.col(fk["ref_column"]).alias("__p"))
    orphan = df.where(F.col(fk["column"]).isNotNull()).join(other, F.col(fk["column"]) == F.col("__p"), "left_anti")
    if not orphan.isEmpty():
        raise Violation(f"{name}: {fk['name']}: no such {fk['ref_table']}.{fk['ref_column']}")
