"""SQL dumps: statements that make a database again."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowsql.functions.dialect import SqlError
from sparrowsql.operators import dml
from sparrowsql.sources.store import Files

if TYPE_CHECKING:
    from sparrowsql.plans.session import Session


#: Rows of one INSERT at most.
ROWS = 1_000
#: Characters that a string literal can't hold where a statement is one line, or that have a meaning in it.
ODD = {"\\": 92, "\n": 10, "\r": 13}
_STRING = r"'[^']*(?:''[^']*)*'"
_PIECE = rf"(?:{_STRING}|CHAR\(\d+\))"
_PIECES = re.compile(rf"({_STRING})|CHAR\((\d+)\)")
#: What opens a value, its text by kind, and what closes it.
_VALUE = re.compile(
    rf"""(?P<open>\(|,\ )
    (?:(?P<string>{_STRING})
    |CONCAT\((?P<pieces>{_PIECE}(?:,\ {_PIECE})*)\)
    |CAST\('(?P<cast>\w+|-Infinity)'\ AS\ (?:DOUBLE|FLOAT)\)
    |(?P<bare>[-+\w.]+))
    (?P<close>\)(?:,\ |;$)|(?=,\ ))""",
    re.X,
)


def create_table(name: str, table: dict) -> str:
    lines = []
    for c in table["columns"]:
        said = f"  {c['name']} {c['type'].upper() if '(' not in c['type'] else c['type'].split('(')[0].upper() + '(' + c['type'].split('(', 1)[1]}"
        said += "" if c["nullable"] else " NOT NULL"
        said += f" DEFAULT {c['default']}" if c["default"] is not None else ""
        lines.append(said + (" AUTO INCREMENT" if c["auto"] else ""))
    if table["primary_key"]:
        lines.append(f"  PRIMARY KEY ({', '.join(table['primary_key'])})")
    lines += [f"  CONSTRAINT {u['name']} UNIQUE ({', '.join(u['columns'])})" for u in table["uniques"]]
    lines += [f"  CONSTRAINT {k['name']} CHECK ({k['expr']})" for k in table["checks"]]
    for f in table["foreign_keys"]:
        lines.append(
            f"  CONSTRAINT {f['name']} FOREIGN KEY ({f['column']}) REFERENCES {f['ref_table']}({f['ref_column']})"
            f" ON DELETE {f['on_delete']} ON UPDATE {f['on_update']}"
        )
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n)"


def _parents_first(tables: dict) -> list[str]:
    out: list[str] = []
    while len(out) < len(tables):
        ready = [t for t in tables if t not in out and all(f["ref_table"] in out or f["ref_table"] == t or f["ref_table"] not in tables for f in tables[t]["foreign_keys"])]
        out += ready or [t for t in tables if t not in out]
    return out


def backup(session: Session, db: str, path: str) -> None:
    """Write the statements as text files under path: folders for the definitions before and after the rows, one for each table's rows.

    INSERT lines are made by the executors, so a table of any size is dumped in parallel.
    """
    database = session.store.database(db)
    target = path if "/" in path else f"{session.store.root}/backups/{path}"
    order = _parents_first(database["tables"])
    heads = [f"DROP TABLE IF EXISTS {t};" for t in reversed(order)] + [create_table(t, database["tables"][t]) + ";" for t in order]
    for kind in ("synonyms", "functions", "procedures"):
        heads += [f"DROP {kind[:-1].upper()} IF EXISTS {n};" for n in database[kind]]
    heads += [f"CREATE FUNCTION {n}({', '.join(f['parameters'])}) RETURNS TEXT RETURN {f['body']};" for n, f in database["functions"].items()]
    heads += [f"CREATE OR REPLACE VIEW {v} AS {x['sql']};" for v, x in database["views"].items()]
    heads += [f"CREATE SYNONYM {n} FOR {target};" for n, target in database["synonyms"].items()]
    heads += [f"CREATE PROCEDURE {n}({', '.join(f'IN {p} TEXT' for p in x['parameters'])}) {x['body']};" for n, x in database["procedures"].items()]
    # After the rows: triggers don't run for them.
    tails = [f"DROP INDEX IF EXISTS {n};\nCREATE INDEX {n} ON {x['table']} ({', '.join(x['columns'])}){' USING HASH' * (x['kind'] == 'HASH')};" for n, x in database["indexes"].items()]
    tails += [f"DROP TRIGGER IF EXISTS {n};\nCREATE TRIGGER {n} {x['moment']} {x['event']} ON {x['table']} FOR EACH ROW {x['body']};" for n, x in database["triggers"].items()]
    session.frame_of([("\n".join(tails),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/2-definitions")
    session.frame_of([("\n".join(heads),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/0-definitions")
    for i, name in enumerate(order):
        df = session.store.frame(db, name)
        row = F.concat(F.lit("("), F.concat_ws(", ", *[_said(f) for f in df.schema]), F.lit(")"))
        place = F.monotonically_increasing_id()
        lines = df.select(row.alias("row"), F.floor(place / ROWS).alias("line")).groupBy("line").agg(F.array_join(F.collect_list("row"), ", ").alias("rows"))
        lines.select(F.concat(F.lit(_head(name, df.columns)), "rows", F.lit(";")).alias("value")).write.mode("overwrite").text(f"{target}/1-rows-{i:04d}-{name}")


def _head(name: str, columns: list[str]) -> str:
    return f"INSERT INTO {name} ({', '.join(columns)}) VALUES "


def _said(f: T.StructField) -> Column:
    """A column's values as literals of the dialect on one line."""
    col, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
    text = col.cast("string")
    if kind in ("float", "double"):
        said = F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.concat(F.lit("CAST('"), text, F.lit(f"' AS {kind.upper()})"))).otherwise(text)
    elif kind in ("byte", "short", "integer", "long", "decimal", "boolean"):
        said = text
    else:
        said = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        odd = said
        for c, code in ODD.items():
            odd = F.replace(odd, F.lit(c), F.lit(f"', CHAR({code}), '"))
        said = F.when(F.translate(text, "".join(ODD), "") == text, said).otherwise(F.concat(F.lit("CONCAT("), odd, F.lit(")")))
    return F.when(col.isNull(), F.lit("NULL")).otherwise(said)


def restore(session: Session, path: str) -> None:
    """Run the statements that backup wrote under path.

    Definitions run one by one. A table's INSERTs are read by the executors and added as one change, so that
    keys and foreign keys are checked once over all of its rows and the table has one segment.
    """
    for part in sorted(Files(session.spark, path).names("")):
        lines = session.spark.read.text(f"{path}/{part}", wholetext=not part.startswith("1-rows-"))
        if not part.startswith("1-rows-"):
            session.run("\n".join(r.value for r in lines.collect()))
        elif not lines.isEmpty():
            with session.store.change():
                db, name = session.table(part.split("-", 3)[3])
                columns = [c["name"] for c in session.store.database(db)["tables"][name]["columns"]]
                dml.insert(session.store, db, name, _read(lines, _head(name, columns), columns), columns)


def _read(lines: DataFrame, head: str, columns: list[str]) -> DataFrame:
    """The rows of INSERT lines, their values as texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0):
                values = _values(line.as_py(), head, len(columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], columns)

    return lines.mapInArrow(run, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def _values(line: str, head: str, width: int) -> list[list[str | None]]:
    """The values of an INSERT's rows by column; anything that backup doesn't write is an error."""
    out: list[list[str | None]] = [[] for _ in range(width)]
    if not line.startswith(head):
        raise SqlError(f"{head.strip()} expected, found {line[:80]!r}")
    at, i = len(head), 0
    while at < len(line):
        m = _VALUE.match(line, at)
        if not m or (m["open"] == "(") != (i == 0) or bool(m["close"]) != (i == width - 1):
            raise SqlError(f"a dump's value expected at {at}, found {line[at : at + 80]!r}")
        if m["string"] is not None:
            value = m["string"][1:-1].replace("''", "'")
        elif m["pieces"] is not None:
            value = "".join(s[1:-1].replace("''", "'") if s else chr(int(code)) for s, code in _PIECES.findall(m["pieces"]))
        else:
            value = m["cast"] or (None if m["bare"] == "NULL" else m["bare"])
        out[i].append(value)
        at, i = m.end(), (i + 1) % width
    if i or not line.endswith(";"):
        raise SqlError(f"an INSERT ends too early: {line[-80:]!r}")
    return out
