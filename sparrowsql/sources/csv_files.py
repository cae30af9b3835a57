"""CSV in and out, on Spark's own reader and writer."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowsql.operators import dml

if TYPE_CHECKING:
    from sparrowsql.plans.session import Session


def import_csv(session: Session, path: str, table: str) -> tuple[int, int]:
    """Append the rows of a CSV folder or file with a header; (added, rejected).

    Rows with a value that doesn't fit its column's type are rejected, the rest is one insert.
    """
    db, name = session.table(table)
    rows = session.spark.read.csv(path, header=True, quote='"', escape='"')
    kinds = {c["name"].lower(): c["spark"] for c in session.store.database(db)["tables"][name]["columns"]}
    fits = F.lit(True)
    for c in rows.columns:
        kind = kinds.get(c.lower())
        if kind and kind != "STRING":
            fits &= F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` AS {kind})").isNotNull()
    total = rows.count()
    good = rows.where(fits)
    with session.store.change():
        added = dml.insert(session.store, db, name, good, rows.columns).count()
    return added, total - added


def export_csv(session: Session, query: str, path: str) -> DataFrame:
    """Write the result of a query as CSV files with headers."""
    out = session.sql(query)
    out.write.csv(path, header=True, quote='"', escape='"')
    return out
