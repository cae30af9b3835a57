"""Session: statements of the dialect over the store.

sql() runs one statement, run() a script. Queries become one Spark plan each;
everything else changes the catalog or makes new table versions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowsql.functions.dialect import Rewriter, SqlError, Token, literal, name_of, quote, split_commas, split_statements, string_value, tokenize
from sparrowsql.operators import dml
from sparrowsql.operators.recursive import fixpoint
from sparrowsql.plans import admin, routines
from sparrowsql.plans.parsing import Cursor, column_definition, column_type, empty_table, table_constraint
from sparrowsql.sources.store import DEFAULT_DB, Store, empty_database

_session = itertools.count()
#: Changes of rows after which a session runs VACUUM by itself, outside of transactions.
AUTO_VACUUM = 200


class Session:
    def __init__(self, spark: SparkSession, warehouse: str, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        """tables: frames that queries may read by name besides the stored tables, or what makes them when first read."""
        self.spark, self.store, self.db = spark, Store(spark, warehouse), DEFAULT_DB
        self.variables: dict[str, object] = {}
        self.prepared: dict[str, str] = {}
        self.frames = {k.lower(): v for k, v in (tables or {}).items()}
        self._prefix = f"sparrow_{next(_session)}"
        self._hidden: dict[str, str] = {}  # names that a recursive query or a change stands for
        self._depth = 0
        self._changes = 0

    # --- entry points

    def sql(self, text: str) -> DataFrame:
        found = split_statements(text)
        if len(found) != 1:
            raise SqlError(f"one statement at a time; found {len(found)}")
        return self._statement(found[0])

    def run(self, script: str) -> list[DataFrame]:
        return [self._statement(s) for s in split_statements(script)]

    def done(self, count: int | None = None) -> DataFrame:
        return self.spark.createDataFrame([(count,)], "rows_affected long")

    def frame_of(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _statement(self, text: str) -> DataFrame:
        c = Cursor(tokenize(text))
        if self.store.staged is None:
            self.store.refresh()
        else:
            self.store.catch_up()
        if c.peek() == "WITH":
            c = self._cte_insert(c)
        word = c.peek()
        method = getattr(self, f"_do_{word.lower()}", None) if word.isalpha() else None
        if method is not None:
            c.take()
            return method(c, text)
        if word in ("SELECT", "WITH", "(", "VALUES"):
            return self.query(c.rest())
        return admin.statement(self, c, text)

    @staticmethod
    def _cte_insert(c: Cursor) -> Cursor:
        """WITH ... INSERT INTO t SELECT as INSERT INTO t WITH ... SELECT; anything else as it is."""
        head = c.until("INSERT", "SELECT")
        if c.peek() != "INSERT":
            c.at = 0
            return c
        into = c.until("SELECT")
        return Cursor([*into, *head, *c.rest()])

    # --- names

    def rewriter(self, resolve: bool = True) -> Rewriter:
        functions = {n.upper(): (f["parameters"], tokenize(f["body"])) for db in self.store.catalog["databases"].values() for n, f in db["functions"].items()}
        return Rewriter(self.variables, functions, self._resolve if resolve else None, self.db)

    def _view(self, key: str, df: DataFrame) -> str:
        name = f"{self._prefix}_{key}"
        df.createOrReplaceTempView(name)
        return name

    def _resolve(self, name: str) -> str:
        """The Spark name that stands for a table, view, synonym or catalog view."""
        low = name.lower()
        if low in self._hidden:
            return self._hidden[low]
        if low.startswith("information_schema."):
            return self._view(low.replace(".", "_"), admin.information_schema(self, low.split(".", 1)[1]))
        db, _, short = name.rpartition(".")
        db = db or self.db
        if db not in self.store.catalog["databases"]:
            return name
        database = self.store.catalog["databases"][db]
        target = {k.lower(): v for k, v in database["synonyms"].items()}.get(short.lower())
        if target:
            return self._resolve(target if "." in target else f"{db}.{target}")
        views = {k.lower(): v for k, v in database["views"].items()}
        if short.lower() in views:
            self._depth += 1
            try:
                if self._depth > 50:
                    raise SqlError(f"view {name} holds itself")
                return self._view(f"{db}_{short.lower()}", self.query(tokenize(views[short.lower()]["sql"])))
            finally:
                self._depth -= 1
        key = next((t for t in database["tables"] if t.lower() == short.lower()), None)
        if key:
            return self._view(f"{db}_{key.lower()}", self.store.frame(db, key))
        if low in self.frames:
            found = self.frames[low]
            self.frames[low] = found if isinstance(found, DataFrame) else found()
            return self._view(low, self.frames[low])
        return name

    def table(self, name: str) -> tuple[str, str]:
        return dml.resolve_table(self.store, self.db, name)

    # --- queries

    def query(self, tokens: list[Token]) -> DataFrame:
        if tokens and tokens[-1].text == ";":
            tokens = tokens[:-1]
        locking = self.store.staged is not None and any(t.up == "FOR" and u.up in ("UPDATE", "SHARE") for t, u in zip(tokens, tokens[1:], strict=False))
        if locking:  # no lock is held: a change of these tables by others makes this transaction's COMMIT fail
            seen, self.store.seen = self.store.seen, set()
        recursive = self._distinct_recursion(tokens)
        made = recursive if recursive is not None else self.spark.sql(self.rewriter().tokens(tokens))
        if locking:
            self.store.locked |= self.store.seen
            self.store.seen |= seen
        return made

    def _distinct_recursion(self, tokens: list[Token]) -> DataFrame | None:
        """WITH RECURSIVE a AS (base UNION step) main, which Spark's own recursion doesn't take."""
        c = Cursor(tokens)
        if not c.accept("WITH", "RECURSIVE"):
            return None
        name = c.name()
        columns = c.names() if c.peek() == "(" else None
        if not c.accept("AS") or c.peek() != "(":
            return None
        body = Cursor(c.group())
        base = body.until("UNION")
        if not body.accept("UNION") or body.peek() == "ALL" or c.peek() == ",":
            return None
        step = body.rest()
        first = self.query(base)
        first = first.toDF(*columns) if columns else first

        def write(df: DataFrame) -> str:
            return f"{self.store.root}/{self.store.write(df, '.work', name)}"

        def read(paths: list[str]) -> DataFrame:
            return self.spark.read.schema(first.schema).parquet(*paths)

        def next_rows(fresh: DataFrame) -> DataFrame:
            self._hidden[name.lower()] = self._view(f"work_{name.lower()}", fresh)
            made = self.query(step)
            return made.select(*[F.col(f"`{a}`").cast(f.dataType).alias(f.name) for a, f in zip(made.columns, first.schema, strict=True)])

        try:
            whole = fixpoint(first, next_rows, write, read)
            self._hidden[name.lower()] = self._view(f"work_{name.lower()}", whole)
            return self.query(c.rest())
        finally:
            self._hidden.pop(name.lower(), None)

    def value(self, tokens: list[Token]) -> object:
        """The value of an expression without tables."""
        return self.spark.sql(f"SELECT {self.rewriter().tokens(tokens)} AS v").first()["v"]

    # --- DML

    def _returning(self, c: Cursor) -> list[Token] | None:
        return c.rest() if c.accept("RETURNING") else None

    def _returned(self, df: DataFrame, columns: list[Token] | None, count: int) -> DataFrame:
        if columns is None:
            return self.done(count)
        view = self._view("returned", df)
        return self.spark.sql(f"SELECT {self.rewriter(False).tokens(columns)} FROM {view}")

    def _triggered(self, db: str, name: str, event: str, action):
        """Run an action between a table's BEFORE and AFTER triggers, once per statement, as one change."""
        with self.store.change():
            for moment in ("BEFORE", "AFTER"):
                if moment == "AFTER":
                    out = action()
                for t in list(self.store.database(db)["triggers"].values()):
                    if (t["table"], t["moment"], t["event"]) == (name, moment, event):
                        routines.body(self, t["body"], {})
        self._changes += 1
        if self._changes >= AUTO_VACUUM and self.store.staged is None:
            self._changes = 0
            self.store.vacuum()
        return out

    def _view_target(self, name: str) -> tuple[str, str | None]:
        """The base table of an updatable view and the view's condition; the name itself for a table."""
        db, _, short = name.rpartition(".")
        views = {k.lower(): v for k, v in self.store.database(db or self.db)["views"].items()}
        if short.lower() not in views:
            return name, None
        c = Cursor(tokenize(views[short.lower()]["sql"]))
        c.expect("SELECT")
        if c.peek() == "DISTINCT":
            raise SqlError(f"view {name} can't be changed")
        c.until("FROM")
        c.expect("FROM")
        base = c.name()
        rest = c.rest()
        cursor = Cursor(rest)
        condition = None
        if cursor.accept("WHERE"):
            condition = self.rewriter().tokens(cursor.rest())
        if cursor.at < len(cursor.tokens) or any(t.up in ("SELECT", "GROUP", "JOIN", "UNION", "LIMIT") for t in rest):
            raise SqlError(f"view {name} can't be changed")
        return base, condition

    def _do_insert(self, c: Cursor, text: str) -> DataFrame:
        ignore = c.accept("IGNORE")
        c.accept("INTO")
        target, _ = self._view_target(c.name())
        db, name = self.table(target)
        return self._insert(c, db, name, ignore)

    def _insert(self, c: Cursor, db: str, name: str, ignore: bool) -> DataFrame:
        columns = None
        if c.peek() == "(" and c.peek(1) not in ("SELECT", "WITH"):
            columns = c.names()
        table = self.store.database(db)["tables"][name]
        order = columns or [x["name"] for x in table["columns"]]
        if c.accept("VALUES") or c.accept("VALUE"):
            rows = [split_commas(c.group())]
            while c.accept(","):
                rows.append(split_commas(c.group()))
            defaults = {x["name"].lower(): x["default"] or "NULL" for x in table["columns"]}
            say = self.rewriter().tokens
            lines = []
            for row in rows:
                if len(row) != len(order) and not (columns is None and len(row) < len(order)):
                    raise SqlError(f"{len(order)} columns but {len(row)} values")
                lines.append("(" + ", ".join(defaults[order[i].lower()] if v and v[0].up == "DEFAULT" else say(v) for i, v in enumerate(row)) + ")")
            source = self.spark.sql("SELECT * FROM VALUES " + ", ".join(lines)).coalesce(1)  # as listed: counters follow the order
        else:
            source = self.query(c.until("ON", "RETURNING") if c.peek() != "(" else c.group())
        updates = None
        if c.accept("ON", "DUPLICATE", "KEY", "UPDATE"):
            updates = self._sets(c)
        returning = self._returning(c)
        c.end()

        def act() -> tuple[DataFrame, int]:
            before = self.store.database(db)["tables"][name]["rows"]
            added = dml.insert(self.store, db, name, source, columns, ignore, updates)
            return added, self.store.database(db)["tables"][name]["rows"] - before

        added, count = self._triggered(db, name, "INSERT", act)
        return self._returned(added, returning, count)

    def _sets(self, c: Cursor) -> list[tuple[str, str]]:
        """col = expr, ... up to WHERE, RETURNING or the end."""
        tokens = c.until("WHERE", "RETURNING", "WHEN", ";")
        out = []
        for part in split_commas(tokens):
            p = Cursor(part)
            column = p.name()
            p.expect("=")
            out.append((column, self.rewriter().tokens(p.rest())))
        return out

    def _do_update(self, c: Cursor, text: str) -> DataFrame:
        from_ = c.until("SET")
        c.expect("SET")
        sets = self._sets(c)
        where = c.until("RETURNING", ";") if c.accept("WHERE") else None
        returning = self._returning(c)
        c.end()
        head = Cursor(from_)
        first = head.name()
        target, view = self._view_target(first)
        head.accept("AS")
        alias = head.name() if head.at < len(head.tokens) and head.peek() not in (",", "JOIN", "INNER", "LEFT", "RIGHT", "CROSS") else None
        if head.at < len(head.tokens):
            return self._update_many(from_, sets, where, returning)
        db, name = self.table(target)
        condition = self._condition(where, view)
        short = {c_.split(".")[-1]: e for c_, e in sets}
        plain = alias is None and not any("SELECT" in e for e in [condition or "", *short.values()]) and returning is None
        if plain and not any(f"{first.split('.')[-1].lower()} ." in (condition or "").lower() for _ in [0]):
            count = self._triggered(db, name, "UPDATE", lambda: dml.update_where(self.store, db, name, condition, list(short.items())))
            return self.done(count)
        hit = self._identified(db, name, alias or first.split(".")[-1], condition, {f"__s_{k}": v for k, v in short.items()})
        parked = self.store.write(hit, db, name)
        changes = self.spark.read.schema(hit.schema).parquet(f"{self.store.root}/{parked}")
        kept = None
        if returning is not None:  # the rows with their new values, before identities change
            new = {k.lower(): f"__s_{k}" for k in short}
            rows = dml.with_identity(self.store, db, name).join(changes, [dml.FILE, dml.ROW])
            made = rows.select(*[F.col(new.get(x["name"].lower(), x["name"])).cast(x["spark"]).alias(x["name"]) for x in self.store.database(db)["tables"][name]["columns"]])
            parked = self.store.write(made, db, name)
            kept = self.spark.read.schema(made.schema).parquet(f"{self.store.root}/{parked}")
        count = self._triggered(db, name, "UPDATE", lambda: dml.update_rows(self.store, db, name, changes, list(short)))
        if returning is None:
            return self.done(count)
        return self._returned(kept, returning, count)

    def _condition(self, where: list[Token] | None, view: str | None) -> str | None:
        parts = [self.rewriter().tokens(where)] if where else []
        if view:
            parts.append(view)
        return " AND ".join(f"({p})" for p in parts) or None

    def _identified(self, db: str, name: str, alias: str, condition: str | None, values: dict[str, str]) -> DataFrame:
        """Identity and values of the rows of a table that meet any condition, subqueries too."""
        view = self._view(f"rows_{db}_{name.lower()}", dml.with_identity(self.store, db, name))
        said = [f"({e}) AS `{n}`" for n, e in values.items()]
        return self.spark.sql(f"SELECT {', '.join([f'`{alias}`.{dml.FILE}', f'`{alias}`.{dml.ROW}', *said])} FROM {view} AS `{alias}`" + (f" WHERE {condition}" if condition else ""))

    def _sources(self, from_: list[Token]) -> tuple[str, dict[str, tuple[str, str]]]:
        """FROM text over identified views, and alias -> table."""
        aliases: dict[str, tuple[str, str]] = {}
        hidden = dict(self._hidden)
        c = Cursor(from_)
        expect_name = True
        try:
            while c.at < len(c.tokens):
                word = c.peek()
                if expect_name and word != "(":
                    start = c.name()
                    db, name = self.table(start)
                    view = self._view(f"rows_{db}_{name.lower()}", dml.with_identity(self.store, db, name))
                    self._hidden[start.lower()] = view
                    c.accept("AS")
                    follows = c.peek()
                    known = ("", ",", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "OUTER")
                    aliases[c.name().lower() if follows not in known else start.split(".")[-1].lower()] = (db, name)
                    expect_name = False
                else:
                    c.take()
                    expect_name = word in (",", "JOIN")
            return self.rewriter().tokens([Token("word", "FROM"), *from_]), aliases
        finally:
            self._hidden = hidden

    def _update_many(self, from_: list[Token], sets: list[tuple[str, str]], where: list[Token] | None, returning) -> DataFrame:
        if returning is not None:
            raise SqlError("RETURNING takes one table")
        said, aliases = self._sources(from_)
        condition = f" WHERE {self.rewriter().tokens(where)}" if where else ""
        by_alias: dict[str, list[tuple[str, str]]] = {}
        for column, expr in sets:
            owner, _, short = column.rpartition(".")
            if not owner:
                owner = next((a for a, (db, n) in aliases.items() if short.lower() in {x["name"].lower() for x in self.store.database(db)["tables"][n]["columns"]}), "")
            if owner.lower() not in aliases:
                raise SqlError(f"no table for {column}")
            by_alias.setdefault(owner.lower(), []).append((short, expr))
        changes = []
        for alias, own in by_alias.items():
            db, name = aliases[alias]
            values = ", ".join(f"({e}) AS `__s_{c}`" for c, e in own)
            hit = self.spark.sql(f"SELECT `{alias}`.{dml.FILE}, `{alias}`.{dml.ROW}, {values} {said}{condition}")
            parked = self.store.write(hit, db, name)
            changes.append((db, name, own, self.spark.read.schema(hit.schema).parquet(f"{self.store.root}/{parked}")))
        total = 0
        with self.store.change():
            for db, name, own, hit in changes:
                total += self._triggered(db, name, "UPDATE", lambda: dml.update_rows(self.store, db, name, hit, [c for c, _ in own]))  # noqa: B023
        return self.done(total)

    def _do_delete(self, c: Cursor, text: str) -> DataFrame:
        targets = c.until("FROM")
        c.expect("FROM")
        from_ = c.until("WHERE", "RETURNING", ";")
        where = c.until("RETURNING", ";") if c.accept("WHERE") else None
        returning = self._returning(c)
        c.end()
        if targets:
            said, aliases = self._sources(from_)
            condition = f" WHERE {self.rewriter().tokens(where)}" if where else ""
            gone = []
            for part in split_commas(targets):
                alias = name_of(part[-1]).lower()
                if alias not in aliases:
                    raise SqlError(f"{alias} isn't in FROM")
                db, name = aliases[alias]
                hit = self.spark.sql(f"SELECT DISTINCT `{alias}`.{dml.FILE}, `{alias}`.{dml.ROW} {said}{condition}")
                parked = self.store.write(hit, db, name)
                gone.append((db, name, self.spark.read.schema(hit.schema).parquet(f"{self.store.root}/{parked}")))
            total = 0
            with self.store.change():
                for db, name, hit in gone:
                    total += self._triggered(db, name, "DELETE", lambda: dml.delete_rows(self.store, db, name, hit))  # noqa: B023
            return self.done(total)
        head = Cursor(from_)
        first = head.name()
        target, view = self._view_target(first)
        head.accept("AS")
        alias = head.name() if head.at < len(head.tokens) else None
        db, name = self.table(target)
        condition = self._condition(where, view)
        kept = None
        if returning is not None:
            rows = dml.with_identity(self.store, db, name)
            hit = self._identified(db, name, alias or first.split(".")[-1], condition, {})
            old = rows.join(hit.select(dml.FILE, dml.ROW), [dml.FILE, dml.ROW], "left_semi").drop(dml.FILE, dml.ROW)
            parked = self.store.write(old, db, name)
            kept = self.spark.read.schema(old.schema).parquet(f"{self.store.root}/{parked}")
        simple = alias is None and "SELECT" not in (condition or "") and f"{name.lower()} ." not in (condition or "").lower()

        def act() -> int:
            if simple:
                return dml.delete_where(self.store, db, name, condition)
            hit = self._identified(db, name, alias or first.split(".")[-1], condition, {})
            return dml.delete_rows(self.store, db, name, hit)

        count = self._triggered(db, name, "DELETE", act)
        return self._returned(kept, returning, count) if kept is not None else self.done(count)

    def _do_merge(self, c: Cursor, text: str) -> DataFrame:
        c.accept("INTO")
        target = c.name()
        db, name = self.table(target)
        alias = target.split(".")[-1]
        if c.accept("AS") or c.peek() != "USING":
            alias = c.name()
        c.expect("USING")
        if c.peek() == "(":
            source = self.query(c.group())
            source_name = "source"
        else:
            source_name = c.name()
            source = self.spark.table(self._resolve(source_name))
            source_name = source_name.split(".")[-1]
        if c.accept("AS") or c.peek() != "ON":
            source_name = c.name()
        c.expect("ON")
        say = self.rewriter().tokens
        on = say(c.until("WHEN"))
        deletes, updates, insert = [], [], None
        while c.accept("WHEN"):
            if c.accept("MATCHED"):
                condition = say(c.until("THEN")) if c.accept("AND") else "true"
                c.expect("THEN")
                if c.accept("DELETE"):
                    deletes.append(condition)
                else:
                    c.expect("UPDATE", "SET")
                    updates.append((condition, self._sets(c)))
            else:
                c.expect("NOT", "MATCHED")
                condition = say(c.until("THEN")) if c.accept("AND") else "true"
                c.expect("THEN", "INSERT")
                columns = c.names() if c.peek() == "(" else None
                c.expect("VALUES")
                insert = (condition, columns, [say(v) for v in split_commas(c.group())])
        c.end()
        rows = self._view(f"rows_{db}_{name.lower()}", dml.with_identity(self.store, db, name))
        given = self._view("merge_source", source)
        joined = f"FROM {rows} AS `{alias}` JOIN {given} AS `{source_name}` ON {on}"
        gone = " OR ".join(f"({d})" for d in deletes) or "false"
        columns = list(dict.fromkeys(col.split(".")[-1] for _, sets in updates for col, _ in sets))
        picks = []
        for column in columns:
            cases = "".join(f" WHEN ({cond}) THEN ({dict((k.split('.')[-1], v) for k, v in sets).get(column, f'`{alias}`.`{column}`')})" for cond, sets in updates)
            picks.append(f"CASE{cases} ELSE `{alias}`.`{column}` END AS `__s_{column}`")
        matched = self.spark.sql(f"SELECT `{alias}`.{dml.FILE}, `{alias}`.{dml.ROW}, coalesce(({gone}), false) AS __gone{''.join(', ' + p for p in picks)} {joined}")
        parked = self.store.write(matched, db, name)
        matched = self.spark.read.schema(matched.schema).parquet(f"{self.store.root}/{parked}")
        fresh = None
        if insert:
            condition, into, values = insert
            said = ", ".join(f"({v}) AS c{i}" for i, v in enumerate(values))
            made = self.spark.sql(f"SELECT {said} FROM {given} AS `{source_name}` WHERE ({condition}) AND NOT EXISTS (SELECT 1 FROM {rows} AS `{alias}` WHERE {on})")
            parked = self.store.write(made, db, name)
            fresh = (self.spark.read.schema(made.schema).parquet(f"{self.store.root}/{parked}"), into)
        total = 0
        with self.store.change():
            if columns and deletes:  # the rows that go, first; what the others become travels with them
                total += dml.delete_rows(self.store, db, name, matched.where("__gone").select(dml.FILE, dml.ROW), matched.where("NOT __gone").drop("__gone"))
                total += dml.update_rows(self.store, db, name, dml.carried(self.store, db, name, columns), columns)
            elif columns:
                total += dml.update_rows(self.store, db, name, matched.drop("__gone"), columns)
            elif deletes:
                total += dml.delete_rows(self.store, db, name, matched.where("__gone").select(dml.FILE, dml.ROW))
            if fresh:
                total += dml.insert(self.store, db, name, *fresh).count()
        return self.done(total)

    def _do_truncate(self, c: Cursor, text: str) -> DataFrame:
        c.accept("TABLE")
        db, name = self.table(c.name())
        c.end()
        with self.store.change():
            dml.truncate(self.store, db, name)
        return self.done()

    # --- DDL

    def _do_create(self, c: Cursor, text: str) -> DataFrame:
        replace = c.accept("OR", "REPLACE")
        kind = c.take().up
        if kind == "UNIQUE":
            kind = c.take().up
        method = getattr(self, f"_create_{kind.lower()}", None)
        if method is None:
            return admin.create(self, kind, c)
        with self.store.change() as catalog:
            method(c, catalog["databases"].setdefault(self.db, empty_database()), replace, text)
        return self.done()

    def _create_table(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        quiet = c.accept("IF", "NOT", "EXISTS")
        name = c.name()
        db, _, short = name.rpartition(".")
        database = self.store.database(db) if db else database
        if short.lower() in {t.lower() for t in database["tables"]}:
            if quiet:
                return
            raise SqlError(f"table {name} exists")
        table = empty_table()
        source = None
        if c.accept("AS"):
            source = self.query(c.rest())
            table["columns"] = [{"name": f.name, "type": f.dataType.simpleString(), "spark": f.dataType.simpleString(), "nullable": True, "default": None, "auto": False} for f in source.schema]
        else:
            for part in split_commas(c.group()):
                p = Cursor(part)
                if not table_constraint(p, table, self.rewriter(False)):
                    table["columns"].append(column_definition(p, table, self.rewriter(False)))
                p.end()
        database["tables"][short] = table
        self.store.touch(db or self.db, short)
        if source is not None:
            dml.insert(self.store, db or self.db, short, source, None)

    def _create_view(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        name = c.name()
        c.expect("AS")
        body = c.rest()
        if name in database["views"] and not replace:
            raise SqlError(f"view {name} exists")
        database["views"][name] = {"sql": " ".join(t.text for t in body if t.text != ";")}

    def _create_synonym(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        name = c.name()
        c.expect("FOR")
        if name in database["synonyms"] and not replace:
            raise SqlError(f"synonym {name} exists")
        database["synonyms"][name] = c.name()

    def _create_index(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        name = c.name()
        c.expect("ON")
        table = c.name()
        db, table = self.table(table)
        known = {x["name"].lower(): x["name"] for x in self.store.database(db)["tables"][table]["columns"]}
        columns = c.names()
        if unknown := [x for x in columns if x.lower() not in known]:
            raise SqlError(f"{table} has no column {unknown[0]}")
        index = {"table": table, "columns": [known[x.lower()] for x in columns], "kind": "HASH" if c.accept("USING", "HASH") else "BTREE"}
        self.store.database(db)["indexes"][name] = index
        dml.cluster(self.store, db, table, index)

    def _create_function(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        name = c.name()
        parameters = [name_of(p[0]) for p in split_commas(c.group())]
        if c.accept("RETURNS"):
            column_type(c)
        c.expect("RETURN")
        database["functions"][name] = {"parameters": parameters, "body": " ".join(t.text for t in c.rest() if t.text != ";")}

    def _create_procedure(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        name = c.name()
        parameters = []
        for part in split_commas(c.group()):
            p = Cursor(part)
            p.accept("IN") or p.accept("OUT") or p.accept("INOUT")
            parameters.append(p.name())
        database["procedures"][name] = {"parameters": parameters, "body": routines.text_of(c.rest())}

    def _create_trigger(self, c: Cursor, database: dict, replace: bool, text: str) -> None:
        name = c.name()
        moment, event = c.take().up, c.take().up
        c.expect("ON")
        table = self.table(c.name())[1]
        c.accept("FOR", "EACH", "ROW")
        database["triggers"][name] = {"table": table, "moment": moment, "event": event, "body": routines.text_of(c.rest())}

    def _do_drop(self, c: Cursor, text: str) -> DataFrame:
        kind = c.take().up
        quiet = c.accept("IF", "EXISTS")
        places = {"TABLE": "tables", "VIEW": "views", "SYNONYM": "synonyms", "INDEX": "indexes", "FUNCTION": "functions", "PROCEDURE": "procedures", "TRIGGER": "triggers"}
        if kind not in places:
            return admin.drop(self, kind, c, quiet)
        name = c.name()
        db, _, short = name.rpartition(".")
        with self.store.change():
            found = self.store.database(db or self.db)[places[kind]]
            key = next((k for k in found if k.lower() == short.lower()), None)
            if key is None:
                if quiet:
                    return self.done()
                raise SqlError(f"no {kind.lower()} {name}")
            if kind == "TABLE":
                pointing = [x for x in dml.children(self.store, db or self.db, key) if (x[0], x[1]) != (db or self.db, key)]
                if pointing:
                    raise SqlError(f"{pointing[0][1]} points at {name}")
            del found[key]
            if kind == "TABLE":
                self.store.touch(db or self.db, key)
        return self.done()

    def _do_alter(self, c: Cursor, text: str) -> DataFrame:
        c.expect("TABLE")
        db, name = self.table(c.name())
        with self.store.change():
            self._alter(c, db, name)
        return self.done()

    def _alter(self, c: Cursor, db: str, name: str) -> None:
        tables = self.store.database(db)["tables"]
        table = tables[name]
        named = lambda n: next(x for x in table["columns"] if x["name"].lower() == n.lower())
        if c.accept("ADD"):
            c.accept("COLUMN")
            before = len(table["foreign_keys"]), len(table["checks"])
            if table_constraint(c, table, self.rewriter(False)):
                rows = self.store.frame(db, name)
                dml.check_rows(rows, table, name)
                dml.check_unique(rows, table, name)
                for fk in table["foreign_keys"][before[0] :]:
                    dml.check_parents(rows, fk, self.store.frame(*dml.resolve_table(self.store, db, fk["ref_table"])), name)
            else:
                column = column_definition(c, table, self.rewriter(False))
                rows = self.store.frame(db, name)
                table["columns"].append(column)
                if table["segments"] and column["default"] is not None:
                    dml._replace(self.store, db, name, rows.withColumn(column["name"], F.expr(column["default"]).cast(column["spark"])))
        elif c.accept("DROP", "CONSTRAINT") or c.accept("DROP", "FOREIGN", "KEY"):
            gone = c.name().lower()
            kept = {k: [x for x in table[k] if x["name"].lower() != gone] for k in ("uniques", "checks", "foreign_keys")}
            if all(len(kept[k]) == len(table[k]) for k in kept):
                raise SqlError(f"no constraint {gone}")
            table.update(kept)
        elif c.accept("DROP"):
            c.accept("COLUMN")
            gone = named(c.name())
            rows = self.store.frame(db, name)
            table["columns"].remove(gone)
            if table["segments"]:
                dml._replace(self.store, db, name, rows)
        elif c.accept("RENAME", "TO"):
            new = c.name()
            tables[new] = tables.pop(name)
            self.store.touch(db, name)
            self.store.touch(db, new)
            return
        elif c.accept("RENAME"):
            c.accept("COLUMN")
            old = named(c.name())
            c.expect("TO")
            new, was = c.name(), old["name"]
            rows = self.store.frame(db, name).withColumnRenamed(was, new)
            old["name"] = new
            swap = lambda names: [new if n == was else n for n in names]
            table["primary_key"] = swap(table["primary_key"])
            for u in table["uniques"]:
                u["columns"] = swap(u["columns"])
            if table["segments"]:
                dml._replace(self.store, db, name, rows)
        elif c.accept("MODIFY"):
            c.accept("COLUMN")
            fresh = column_definition(c, table, self.rewriter(False))
            old = named(fresh["name"])
            rows = self.store.frame(db, name)
            lost = rows.where(F.col(old["name"]).isNotNull() & F.expr(f"try_cast(`{old['name']}` AS {fresh['spark']})").isNull())
            if not lost.isEmpty():
                raise SqlError(f"{old['name']}: values don't fit {fresh['type']}")
            changed = old["spark"] != fresh["spark"]
            fresh["name"] = old["name"]
            table["columns"][table["columns"].index(old)] = fresh
            if changed and table["segments"]:
                dml._replace(self.store, db, name, rows.withColumn(old["name"], F.col(old["name"]).cast(fresh["spark"])))
        else:
            raise SqlError(f"ALTER TABLE can't {c.peek()}")
        self.store.touch(db, name)

    # --- transactions, variables, routines

    def _do_begin(self, c: Cursor, text: str) -> DataFrame:
        self.store.begin()
        return self.done()

    def _do_start(self, c: Cursor, text: str) -> DataFrame:
        c.expect("TRANSACTION")
        return self._do_begin(c, text)

    def _do_commit(self, c: Cursor, text: str) -> DataFrame:
        self.store.commit()
        return self.done()

    def _do_rollback(self, c: Cursor, text: str) -> DataFrame:
        if c.accept("TO"):
            c.accept("SAVEPOINT")
            self.store.rollback_to(c.name())
        else:
            self.store.rollback()
        return self.done()

    def _do_savepoint(self, c: Cursor, text: str) -> DataFrame:
        self.store.savepoint(c.name())
        return self.done()

    def _do_release(self, c: Cursor, text: str) -> DataFrame:
        c.accept("SAVEPOINT")
        self.store.release(c.name())
        return self.done()

    def _do_set(self, c: Cursor, text: str) -> DataFrame:
        if c.accept("ISOLATION", "LEVEL") or c.accept("TRANSACTION", "ISOLATION", "LEVEL"):
            level = " ".join(t.up for t in c.rest() if t.text != ";")
            if level not in ("READ UNCOMMITTED", "READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"):
                raise SqlError(f"no isolation level {level}")
            self.store.isolation = level
            return self.done()
        name = c.take()
        if name.kind != "var":
            raise SqlError(f"can't set {name.text}")
        c.accept("=") or c.expect(":=")
        self.variables[name.text.lstrip("@").lower()] = self.value([t for t in c.rest() if t.text != ";"])
        return self.done()

    def _do_use(self, c: Cursor, text: str) -> DataFrame:
        name = c.name()
        self.store.database(name)
        self.db = name
        return self.done()

    def _do_prepare(self, c: Cursor, text: str) -> DataFrame:
        name = c.name()
        c.expect("FROM")
        self.prepared[name.lower()] = string_value(c.take())
        return self.done()

    def _do_execute(self, c: Cursor, text: str) -> DataFrame:
        name = c.name().lower()
        if name not in self.prepared:
            raise SqlError(f"nothing prepared as {name}")
        values = [self.value(v) for v in split_commas([t for t in c.rest() if t.text != ";"])] if c.accept("USING") else []
        return self.execute(self.prepared[name], values)

    def execute(self, text: str, values: list) -> DataFrame:
        """A statement with ? for each value."""
        tokens = tokenize(text)
        if sum(t.text == "?" for t in tokens) != len(values):
            raise SqlError(f"the statement takes {sum(t.text == '?' for t in tokens)} values, not {len(values)}")
        left = iter(values)
        said = []
        for t in tokens:
            if t.text == "?":
                v = next(left)
                said.append("'" + v.replace("'", "''") + "'" if isinstance(v, str) else literal(v) if not hasattr(v, "isoformat") else f"'{v}'")
            else:
                said.append(t.text)
        return self._statement(" ".join(said))

    def _do_deallocate(self, c: Cursor, text: str) -> DataFrame:
        c.accept("PREPARE")
        self.prepared.pop(c.name().lower(), None)
        return self.done()

    def _do_call(self, c: Cursor, text: str) -> DataFrame:
        return routines.call(self, c)
