"""Exact dedup: 128-bit content hash, smallest or largest stable id stays, bytes compared.

Rows are grouped by (128-bit hash, text). The hash spreads and the text in the
key compares the bytes, so two texts that collide form two groups. Partial
aggregation folds copies inside each input split, so a group that holds a third
of all rows reaches the shuffle as one row per task.

groups() tells every row its group: rows find it by the hash alone, without
their texts; only for hashes that hold several texts (none in practice) are the
texts joined. dedup() needs one shuffle: the aggregation itself carries the row
that stays.

Nulls count as the empty text. Rows repeated with one id and one text are
members like any other; exactly one of them is marked as kept, and of such rows
dedup() keeps the one whose other columns are largest (of those that can be
compared). A null id never wins over an id that isn't null. An empty table gives
an empty result. Input columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", content_hash(F.col("text")))
    best = {"max": F.max, "min": F.min}[keep]("id").alias("keep_id")
    by_text = rows.groupBy("h", "text").agg(best, F.count("*").alias("group_size"))
    found = materialize(by_text.select("h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), "exact")
    clash = found.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    if clash.isEmpty():
        keyed = rows.select("id", "h", F.sha2("text", 256).alias("sha"))
        joined = keyed.join(found.drop("sha"), "h", "left")
    else:  # several texts under one hash: find the group by the text's bytes as well
        joined = rows.join(by_text, ["h", "text"], "left").withColumn("sha", F.sha2("text", 256))
    same = Window.partitionBy("id", "sha").orderBy(F.lit(0))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns: one for each text."""
    known = F.col(id_col).isNotNull() if keep == "max" else F.col(id_col).isNull()
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "struct", "array", "variant") and f.name not in (id_col, text_col)]
    order = F.struct(known.alias("known"), F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(plain)])
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = text_or_empty(text_col)
    rows = docs.select(content_hash(text).alias("h"), text.alias("t"), order.alias("o"), row.alias("r"))
    best = {"max": F.max_by, "min": F.min_by}[keep]("r", "o").alias("r")
    return rows.groupBy("h", "t").agg(best).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)])
