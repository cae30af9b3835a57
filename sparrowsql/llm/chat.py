"""Chat formatting of reply trees.

Messages form trees (a message names its parent). Iterative self-joins with
doubling steps find, for every message, its distance from the root and the sum
of scores on the way: after round j each message knows its ancestor 2^j up, so
a path of n messages takes log2 n rounds. The leaves of each conversation are
ranked by the score of their branch (then longer, then smaller leaf), and the
best ones' paths are marked by walking the same doubling tables up again. No
round makes more rows than there are messages. Each chosen path is formatted
as one conversation; a conversation's text is one value, so its turns meet in
one row at the end, and only there.

Template: ``<|im_start|>role newline text<|im_end|>newline`` per turn. Inside
roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no control
string stands in a text, and parse() gives back what was formatted. The loss
mask covers the texts of assistant turns.

Null roles and texts are empty. A message whose parent isn't there is a root; a
message on or under a circle of parents is on no path. Rows repeated with the
same turn follow one another. A null conversation is one of its own.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str) -> str:
    """A role on one line: its line ends are written as backslash n."""
    return escape(role).replace("\n", "\\n")


def _unrole(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans (code points) under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role or '')}\n", escape(text or "")
        if (role or "") == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn starts at {at}")
        out.append((_unrole(found[1]), unescape(found[2])))
        at = found.end()
    return out


def tree_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv, branch (1 is best), depth, node of the chosen root-to-leaf paths.

    messages: conv, node (unique in its conversation), parent (null for a root), score.
    """
    base = materialize(messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    total = base.count()
    there = base.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    link = F.col("conv").eqNullSafe(F.col("c"))
    step = base.join(there, link & (F.col("parent") == F.col("n")), "left").select(
        "conv", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("sum")
    )
    step = materialize(step, "steps")
    tables = [step]
    ended, going = step.where("up IS NULL"), step.where("up IS NOT NULL")
    for _ in range(math.ceil(math.log2(max(total, 2))) + 1):
        if going.isEmpty():
            break
        above = ended.union(going).select(
            F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("sum").alias("s2")
        )
        joined = going.join(above, link & (F.col("up") == F.col("n")))  # only those that haven't reached their root
        step = materialize(
            joined.select(
                "conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("sum") + F.col("s2")).alias("sum")
            ),
            "steps",
        )
        tables.append(step)
        ended, going = ended.union(step.where("up IS NULL")), step.where("up IS NOT NULL")
    whole = ended  # others are on or under a circle
    parents = tables[0].where("up IS NOT NULL").select(F.col("conv").alias("c"), F.col("up").alias("n")).distinct()
    leaves = whole.join(parents, link & (F.col("node") == F.col("n")), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc("sum"), F.desc("depth"), "node")
    marked = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches).select("conv", "branch", "node")
    for jump in tables[:-1]:
        up = jump.where("up IS NOT NULL").select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        more = marked.join(up, link & (F.col("node") == F.col("n"))).select("conv", "branch", F.col("up").alias("node"))
        marked = materialize(marked.union(more), "marked")
    depth = whole.select(F.col("conv").alias("c"), F.col("node").alias("n"), "depth")
    return marked.join(depth, link & (F.col("node") == F.col("n"))).select("conv", "branch", "depth", "node")


def from_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before."""
    named = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    chained = named.withColumn("node", place)
    return chained.select(
        "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv, branch, turns: the chosen paths with their roles and texts, root first."""
    messages = materialize(messages, "texts")
    paths = tree_paths(messages.select("conv", "node", "parent", "score"), branches)
    texts = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    full = paths.join(texts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    turns = F.array_sort(F.collect_list(F.struct("depth", "role", "text")))
    return full.groupBy("conv", "branch").agg(turns.alias("turns"))


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv, branch, formatted, loss (spans of code points under the mask)."""
    kind = messages.schema["conv"].dataType.simpleString()
    out = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(2)]
            loss = pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans in made], out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in made], pa.string()), loss], ["conv", "branch", "formatted", "loss"]
            )

    schema = f"conv {kind}, branch int, formatted string, loss array<struct<start:long,stop:long>>"
    return conversations(messages, branches).mapInArrow(run, schema)


def read_back(formatted: str, loss: list[dict]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of a formatted conversation."""
    turns = parse(formatted)
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    learnt = "".join(unescape(formatted[x["start"] : x["stop"]]) for x in loss)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(turns), digest(said), len(learnt), digest(learnt), len(formatted)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    kind = formatted.schema["conv"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            made = [read_back(f.as_py(), x.as_py()) for f, x in zip(batch.column(1), batch.column(2), strict=True)]
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv", *names])

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv", "formatted", "loss").mapInArrow(run, schema).withColumnRenamed("conv", conv_col)
