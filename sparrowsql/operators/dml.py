"""Row changes over the store: each makes a new version of a table from the version before.

Rows are told apart by the file and row index that the Parquet reader gives, so
tables need no key. Conditions without subqueries change a table in one pass
without a shuffle; others join the changed rows back by that identity. Only the
segments that hold rows to change are written again; a table of one segment (one
INSERT, or the last change of all) is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowsql.functions.dialect import SqlError, name_of, tokenize
from sparrowsql.operators.constraints import Violation, all_null_safe, check_parents, check_rows, check_unique, clashes, keys_of
from sparrowsql.sources.store import Store

FILE, ROW = "__file", "__row"
#: Where a row of a batch stands in it.
ORDER = "__order"


def with_identity(store: Store, db: str, name: str, segments: list[str] | None = None) -> DataFrame:
    df = store.frame(db, name, segments)
    if not (store.database(db)["tables"][name]["segments"] if segments is None else segments):
        return df.withColumn(FILE, F.lit("")).withColumn(ROW, F.lit(0).cast("long"))
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _holding(store: Store, db: str, name: str, rows: DataFrame) -> tuple[list[str], list[str]]:
    """The table's segments that hold some of the rows (with their identity), and the others."""
    segments = store.database(db)["tables"][name]["segments"]
    if len(segments) < 2:
        return segments, []
    found = rows.select(F.regexp_extract(FILE, r"/([0-9a-f]{32})/[^/]*$", 1).alias("s")).distinct()
    held = {r["s"] for r in found.collect()}  # segments' names at most
    return [s for s in segments if s.rsplit("/", 1)[-1] in held], [s for s in segments if s.rsplit("/", 1)[-1] not in held]


def _columns(table: dict) -> list[str]:
    return [c["name"] for c in table["columns"]]


def _replace(store: Store, db: str, name: str, df: DataFrame, also: list[str] | None = None, others: list[str] | None = None) -> None:
    """The rows of df become the table (with those of other segments); columns in also are written beside the table's own and not read as such."""
    table = store.database(db)["tables"][name]
    segment = store.write(df.select(*_columns(table), *(also or [])), db, name)
    table["segments"] = [*(others or []), segment]
    table["rows"] = store.frame(db, name).count()
    store.touch(db, name)


def cluster(store: Store, db: str, name: str, index: dict) -> None:
    """Lay a table out for an index: sorted by its columns, so that Parquet's statistics prune; a hash index adds Bloom filters (Store.write)."""
    rows = store.frame(db, name)
    if store.database(db)["tables"][name]["segments"]:
        _replace(store, db, name, rows.repartitionByRange(*index["columns"]).sortWithinPartitions(*index["columns"]) if index["kind"] == "BTREE" else rows)


def carried(store: Store, db: str, name: str, columns: list[str]) -> DataFrame:
    """Identity and __s_<column> of the rows that delete_rows has carried changes for."""
    table = store.database(db)["tables"][name]
    kinds = {c["name"].lower(): c["spark"] for c in table["columns"]}
    schema = "__carried boolean, " + ", ".join(f"`__s_{c}` {kinds[c.lower()]}" for c in columns)
    rows = store.spark.read.schema(schema).parquet(*[f"{store.root}/{s}" for s in table["segments"]])
    return rows.where("__carried").select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW), *[f"__s_{c}" for c in columns])


def dense_ids(df: DataFrame, start: int, column: str) -> DataFrame:
    """df with consecutive numbers from start where column is null; rows are counted by partition, not sorted into one."""
    marked = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    needed = F.col(column).isNull()
    counts = marked.where(needed).groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumnRenamed("__p", "__q").select("__q", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__p", needed).orderBy("__m"))
    joined = marked.withColumn("__place", place).join(F.broadcast(counts), F.col("__p") == F.col("__q"), "left")
    number = (F.col("__base") + F.col("__place") - 1 + start).cast(df.schema[column].dataType)
    return joined.withColumn(column, F.coalesce(F.col(column), number)).select(*df.columns)


def insert(
    store: Store,
    db: str,
    name: str,
    source: DataFrame,
    columns: list[str] | None,
    ignore: bool = False,
    on_duplicate: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Append the rows of source; the rows that were added, as stored."""
    table = store.database(db)["tables"][name]
    names = columns or _columns(table)[: len(source.columns)]
    if len(names) != len(source.columns):
        raise SqlError(f"{len(names)} columns but {len(source.columns)} values")
    given = source.toDF(*[f"__v{i}" for i in range(len(names))])
    place = {n.lower(): f"__v{i}" for i, n in enumerate(names)}
    unknown = set(place) - {c.lower() for c in _columns(table)}
    if unknown:
        raise SqlError(f"{name} has no column {sorted(unknown)[0]}")
    made = []
    for c in table["columns"]:
        found = place.get(c["name"].lower())
        if found:
            value = F.col(found)
        elif c["default"] is not None:
            value = F.expr(c["default"])
        elif c["type"].startswith("timestamp"):
            value = F.localtimestamp()
        else:
            value = F.lit(None)
        made.append(value.cast(c["spark"]).alias(c["name"]))
    batch = given.select(*made)
    auto = next((c["name"] for c in table["columns"] if c["auto"]), None)
    parked = store.write(batch, db, name)  # evaluated once, whatever the source does
    fresh = store.spark.read.schema(batch.schema).parquet(f"{store.root}/{parked}")
    if auto:
        fresh = dense_ids(fresh, table["auto"], auto)
    existing = store.frame(db, name)
    tally = F.count("*").alias("n"), F.max(auto or F.lit(None)).alias("top")
    stats = check_rows(fresh, table, name, *tally)
    keys = keys_of(table)
    if keys and (ignore or on_duplicate is not None):
        ordered = store.spark.read.schema(batch.schema).parquet(f"{store.root}/{parked}")
        ordered = ordered.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(ORDER))
        if auto:  # numbers are given to the rows that have none, whether they stay or not
            ordered = dense_ids(ordered, table["auto"], auto)
        if on_duplicate is not None:
            return _upsert(store, db, name, ordered, on_duplicate)
        for _, key in keys:
            ordered = ordered.join(_renamed(existing, key), _same(ordered, key), "left_anti")
        fresh = _first_come(store, db, name, ordered, [key for _, key in keys])[0].drop(ORDER)
    else:
        check_unique(fresh, table, name)
        if table["segments"] and keys and not clashes(fresh, existing, table).isEmpty():
            raise Violation(f"{name}: duplicate value for a key")
    for fk in table["foreign_keys"]:
        pdb, parent = resolve_table(store, db, fk["ref_table"])
        rows = store.frame(pdb, parent)
        if (pdb, parent) == (db, name):
            rows = rows.unionByName(fresh)
        check_parents(fresh, fk, rows, name)
    if auto or ignore:
        segment = store.write(fresh, db, name)
        store.files.delete(parked)
    else:
        segment = parked
    table["segments"].append(segment)
    added = store.spark.read.schema(batch.schema).parquet(f"{store.root}/{segment}")
    if ignore:
        stats = added.agg(*tally).first()
    table["rows"] += stats["n"]
    if auto and stats["top"] is not None:
        table["auto"] = max(table["auto"], int(stats["top"]) + 1)
    store.touch(db, name)
    return added


def _renamed(df: DataFrame, key: list[str], *more) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], *more)


def _same(df: DataFrame, key: list[str]):
    """Equal in all columns of a key; nulls never are."""
    return reduce(lambda a, b: a & b, [df[c] == F.col(f"__k{i}") for i, c in enumerate(key)])


def _parked(store: Store, db: str, name: str, df: DataFrame) -> DataFrame:
    return store.spark.read.schema(df.schema).parquet(f"{store.root}/{store.write(df, db, name)}")


def _first_come(store: Store, db: str, name: str, rows: DataFrame, keys: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch that go in if they come one by one in ORDER, and (ORDER, __by) of the others: the row that was there.

    A row that is first for all of its keys goes in; the others that share a key
    with it don't; what is left goes on. Keys that overlap seldom need a second
    round. Firsts are found by folding minima, so a key on a third of all rows is
    a row a task.
    """
    left = _parked(store, db, name, rows)
    taken, beaten = [], []
    while not left.isEmpty():
        win = left
        for key in keys:
            known = left.where(all_null_safe(key))
            best = known.groupBy(*key).agg(F.min(ORDER).alias("__first")).select("__first")
            win = win.where(~all_null_safe(key)).unionByName(win.where(all_null_safe(key)).join(best, F.col(ORDER) == F.col("__first"), "left_semi"))
        win = _parked(store, db, name, win)
        taken.append(win)
        lost = None
        for i, key in enumerate(keys):
            part = left.join(_renamed(win, key, F.col(ORDER).alias("__by")), _same(left, key)).where(F.col(ORDER) != F.col("__by"))
            part = part.select(ORDER, F.lit(i).alias("__i"), "__by")
            lost = part if lost is None else lost.union(part)
        lost = lost.groupBy(ORDER).agg(F.min_by("__by", "__i").alias("__by"))
        lost = _parked(store, db, name, lost)
        beaten.append(lost)
        done = win.select(ORDER).union(lost.select(ORDER)).withColumnRenamed(ORDER, "__o")
        left = _parked(store, db, name, left.join(done, F.col(ORDER) == F.col("__o"), "left_anti"))
    if not taken:
        return left, left.select(ORDER, F.col(ORDER).alias("__by"))
    return reduce(lambda a, b: a.unionByName(b), taken), reduce(lambda a, b: a.unionByName(b), beaten)


def _times(table: dict, sets: list[tuple[str, str]], count: str, once: bool) -> list:
    """__s_<column> after the assignments were made count times, each from the row as it was before."""
    kinds = {c["name"].lower(): c["spark"] for c in table["columns"]}
    _known(table, [c for c, _ in sets], "table")
    if once:
        return [F.expr(e).cast(kinds[c.lower()]).alias(f"__s_{c}") for c, e in sets]
    names = {c.lower(): c for c, _ in sets}

    def inside(expr: str) -> str:
        """The expression with the assigned columns taken from the row so far."""
        tokens = tokenize(expr)
        out = []
        for i, t in enumerate(tokens):
            own = t.kind in ("word", "quoted") and name_of(t).lower() in names and not (i + 1 < len(tokens) and tokens[i + 1].text == "(")
            out.append(f"acc.`{names[name_of(t).lower()]}`" if own else t.text)
        return " ".join(out)

    start = ", ".join(f"'{c}', CAST(`{c}` AS {kinds[c.lower()]})" for c in names.values())
    made = {c.lower(): e for c, e in sets}
    step = ", ".join(f"'{c}', CAST(({inside(made[low])}) AS {kinds[low]})" for low, c in names.items())
    row = f"aggregate(sequence(1, CAST({count} AS INT)), named_struct({start}), (acc, i) -> named_struct({step}))"
    return [F.expr(f"{row}.`{c}`").alias(f"__s_{c}") for c in names.values()]


def _upsert(store: Store, db: str, name: str, batch: DataFrame, sets: list[tuple[str, str]]) -> DataFrame:
    """ON DUPLICATE KEY UPDATE, as if the rows came one by one: each that meets a row updates it, whether that was there or came before."""
    table = store.database(db)["tables"][name]
    keys = [key for _, key in keys_of(table)]
    batch = _parked(store, db, name, batch)
    rows = with_identity(store, db, name)
    met = None
    for i, key in enumerate(keys):
        part = rows.join(_renamed(batch, key, ORDER), _same(rows, key)).select(ORDER, F.lit(i).alias("__i"), FILE, ROW)
        met = part if met is None else met.union(part)
    met = met.groupBy(ORDER).agg(F.min(F.struct("__i", FILE, ROW)).alias("m")).select(ORDER, f"m.{FILE}", f"m.{ROW}")
    met = _parked(store, db, name, met)
    fresh = batch.join(met.select(F.col(ORDER).alias("__o")), F.col(ORDER) == F.col("__o"), "left_anti")
    added, beaten = _first_come(store, db, name, fresh, keys)
    again = beaten.groupBy("__by").agg(F.count("*").alias("__n"))
    many = again.agg(F.max("__n")).first()[0]
    new = added
    if many:
        new = added.join(again, F.col(ORDER) == F.col("__by"), "left")
        values = [F.when(F.col("__n").isNotNull(), v).otherwise(F.col(c)).alias(f"__s_{c}") for (c, _), v in zip(sets, _times(table, sets, "coalesce(__n, 1)", many == 1), strict=True)]
        new = new.select("*", *values)
        given = {c.lower() for c, _ in sets}
        new = new.select(*[F.col(f"__s_{c}").alias(c) if c.lower() in given else F.col(c) for c in _columns(table)])
    new = _parked(store, db, name, new.select(*_columns(table)))
    hit = met.groupBy(FILE, ROW).agg(F.count("*").alias("__n"))
    many = hit.agg(F.max("__n")).first()[0]
    if many:
        changed = rows.join(hit, [FILE, ROW])
        update_rows(store, db, name, _parked(store, db, name, changed.select(FILE, ROW, *_times(table, sets, "__n", many == 1))), [c for c, _ in sets])
    return insert(store, db, name, new, new.columns)


def resolve_table(store: Store, db: str, name: str) -> tuple[str, str]:
    """(database, table) that a possibly dotted name means, through synonyms."""
    own, _, short = name.rpartition(".")
    own = own or db
    found = store.database(own)
    for _ in range(20):
        if short not in found["synonyms"]:
            break
        own2, _, short = found["synonyms"][short].rpartition(".")
        own = own2 or own
        found = store.database(own)
    key = next((t for t in found["tables"] if t.lower() == short.lower()), None)
    if key is None:
        raise SqlError(f"no table {name}")
    return own, key


def children(store: Store, db: str, name: str) -> list[tuple[str, str, dict]]:
    """(database, table, foreign key) of every key that points at a table."""
    out = []
    for cdb, database in store.catalog["databases"].items():
        for child, table in database["tables"].items():
            for fk in table["foreign_keys"]:
                try:
                    if resolve_table(store, cdb, fk["ref_table"]) == (db, name):
                        out.append((cdb, child, fk))
                except SqlError:
                    continue
    return out


def update_where(store: Store, db: str, name: str, condition: str | None, sets: list[tuple[str, str]]) -> int:
    """One pass without a shuffle: rows that meet a plain condition get new values."""
    table = store.database(db)["tables"][name]
    if children_use(store, db, name, [c for c, _ in sets]):
        rows = with_identity(store, db, name)
        hit = rows.where(condition) if condition else rows
        return update_rows(store, db, name, hit.select(FILE, ROW, *[F.expr(e).alias(f"__s_{c}") for c, e in sets]), [c for c, _ in sets])
    touched, others = _holding(store, db, name, with_identity(store, db, name).where(condition)) if condition else (table["segments"], [])
    if not touched:
        return 0
    df = store.frame(db, name, touched)
    hit = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
    kinds = {c["name"].lower(): c["spark"] for c in table["columns"]}
    _known(table, [c for c, _ in sets], name)
    new = {c.lower(): F.expr(e).cast(kinds[c.lower()]) for c, e in sets}
    made = df.select(*[F.when(hit, new[c.lower()]).otherwise(F.col(c)).alias(c) if c.lower() in new else F.col(c) for c in df.columns], hit.alias("__hit"))
    return _checked_replace(store, db, name, made, [c for c, _ in sets], others)


def _known(table: dict, columns: list[str], name: str) -> None:
    for c in columns:
        if c.lower() not in {x.lower() for x in _columns(table)}:
            raise SqlError(f"{name} has no column {c}")


def _checked_replace(store: Store, db: str, name: str, made: DataFrame, changed: list[str], others: list[str]) -> int:
    """The rows of made, which say whether they are changed (__hit), take the place of all segments but the others."""
    table = store.database(db)["tables"][name]
    parked = store.write(made, db, name)
    stored = store.spark.read.schema(made.schema).parquet(f"{store.root}/{parked}")
    hit = stored.where("__hit")
    count = hit.count()
    if count:
        check_rows(hit, table, name)
        low = {c.lower() for c in changed}
        whole = stored.select(*_columns(table)).unionByName(store.frame(db, name, others)) if others else stored
        if any(low & {c.lower() for c in key} for _, key in keys_of(table)):
            check_unique(whole, table, name)
        for fk in table["foreign_keys"]:
            if fk["column"].lower() in low:
                pdb, parent = resolve_table(store, db, fk["ref_table"])
                check_parents(hit, fk, whole if (pdb, parent) == (db, name) else store.frame(pdb, parent), name)
        table["segments"] = [*others, parked]  # the marker column is simply not read
        store.touch(db, name)
    else:
        store.files.delete(parked)
    return count


def children_use(store: Store, db: str, name: str, columns: list[str]) -> bool:
    low = {c.lower() for c in columns}
    return any(fk["ref_column"].lower() in low for _, _, fk in children(store, db, name))


def update_rows(store: Store, db: str, name: str, changes: DataFrame, columns: list[str]) -> int:
    """changes: identity and __s_<column> for each column; foreign keys that point here follow."""
    table = store.database(db)["tables"][name]
    _known(table, columns, name)
    kinds = {c["name"].lower(): c["spark"] for c in table["columns"]}
    touched, others = _holding(store, db, name, changes)
    if not touched:
        return 0
    rows = with_identity(store, db, name, touched)
    changes = changes.dropDuplicates([FILE, ROW]).withColumn("__hit", F.lit(True))
    joined = rows.join(changes, [FILE, ROW], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    new = {c.lower(): F.col(f"__s_{c}").cast(kinds[c.lower()]) for c in columns}
    moved = []
    for cdb, child, fk in children(store, db, name):
        if fk["ref_column"].lower() in new:
            old = F.col(fk["ref_column"])
            pairs = joined.where(F.col("__hit") & ~old.eqNullSafe(new[fk["ref_column"].lower()])).select(old.alias("__old"), new[fk["ref_column"].lower()].alias("__new"))
            seg = store.write(pairs, db, name)
            moved.append((cdb, child, fk, store.spark.read.schema(pairs.schema).parquet(f"{store.root}/{seg}")))
    made = joined.select(*[F.when(F.col("__hit"), new[c.lower()]).otherwise(F.col(c)).alias(c) if c.lower() in new else F.col(c) for c in _columns(table)], "__hit")
    count = _checked_replace(store, db, name, made, columns, others)
    for cdb, child, fk, pairs in moved:
        rows = with_identity(store, cdb, child)
        hit = rows.join(pairs, F.col(fk["column"]) == F.col("__old"))
        if hit.isEmpty():
            continue
        if fk["on_update"] == "RESTRICT":
            raise Violation(f"{child}: {fk['name']}: rows point at {name}.{fk['ref_column']}")
        update_rows(store, cdb, child, hit.select(FILE, ROW, _action(store, cdb, child, fk, fk["on_update"], F.col("__new")).alias(f"__s_{fk['column']}")), [fk["column"]])
    return count


def _action(store: Store, db: str, name: str, fk: dict, action: str, moved):
    if action == "CASCADE":
        return moved
    if action == "SET DEFAULT":
        column = next(c for c in store.database(db)["tables"][name]["columns"] if c["name"].lower() == fk["column"].lower())
        return F.expr(column["default"] or "NULL")
    return F.lit(None)


def delete_where(store: Store, db: str, name: str, condition: str | None) -> int:
    """Rows that meet a plain condition go; one pass without a shuffle where no key points here."""
    if children(store, db, name):
        rows = with_identity(store, db, name)
        return delete_rows(store, db, name, rows.where(condition).select(FILE, ROW) if condition else rows.select(FILE, ROW))
    table = store.database(db)["tables"][name]
    before = table["rows"]
    if condition is None:
        table["segments"], table["rows"] = [], 0
        store.touch(db, name)
        return before
    touched, others = _holding(store, db, name, with_identity(store, db, name).where(condition))
    if not touched:
        return 0
    _replace(store, db, name, store.frame(db, name, touched).where(f"NOT coalesce(({condition}), false)"), None, others)
    return before - table["rows"]


def delete_rows(store: Store, db: str, name: str, gone: DataFrame, carry: DataFrame | None = None) -> int:
    """gone: identities; keys that point here restrict, cascade to any depth, or are set.

    carry: identities and further columns, which are written beside the rows that stay, for carried().
    """
    touched, others = _holding(store, db, name, gone if carry is None else gone.select(FILE, ROW).union(carry.select(FILE, ROW)))
    if not touched:
        return 0
    rows = with_identity(store, db, name, touched)
    table = store.database(db)["tables"][name]
    hit = rows.join(gone.select(FILE, ROW).distinct(), [FILE, ROW], "left_semi")
    pointing = children(store, db, name)
    wanted = sorted({fk["ref_column"] for _, _, fk in pointing})
    keys = None
    if wanted:
        parked = store.write(hit.select(*wanted), db, name)
        keys = store.spark.read.schema(hit.select(*wanted).schema).parquet(f"{store.root}/{parked}")
    before = table["rows"]
    stay = rows.join(gone.select(FILE, ROW).distinct(), [FILE, ROW], "left_anti")
    also = []
    if carry is not None:
        if any((cdb, child) == (db, name) for cdb, child, _ in pointing):
            raise SqlError(f"{name} points at itself: MERGE can't delete and update its rows at once")
        also = ["__carried", *[c for c in carry.columns if c not in (FILE, ROW)]]
        stay = stay.join(carry.dropDuplicates([FILE, ROW]).withColumn("__carried", F.lit(True)), [FILE, ROW], "left")
    _replace(store, db, name, stay, also, others)
    count = before - table["rows"]
    if not count:
        return 0
    for cdb, child, fk in pointing:
        below = with_identity(store, cdb, child)
        values = keys.select(F.col(fk["ref_column"]).alias("__k")).distinct()
        met = below.join(values, F.col(fk["column"]) == F.col("__k"), "left_semi")
        if met.isEmpty():
            continue
        if fk["on_delete"] == "RESTRICT":
            raise Violation(f"{child}: {fk['name']}: rows point at {name}")
        if fk["on_delete"] == "CASCADE":
            delete_rows(store, cdb, child, met.select(FILE, ROW))
        else:
            value = _action(store, cdb, child, fk, fk["on_delete"], F.lit(None))
            update_rows(store, cdb, child, met.select(FILE, ROW, value.alias(f"__s_{fk['column']}")), [fk["column"]])
    return count


def truncate(store: Store, db: str, name: str) -> None:
    table = store.database(db)["tables"][name]
    table["segments"], table["rows"], table["auto"] = [], 0, 1
    store.touch(db, name)
