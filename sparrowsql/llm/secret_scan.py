r"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each kind has a pattern whose matches in a text are leftmost and don't overlap;
those too short are dropped afterwards. Places come from cutting the text into
pieces that each end with a match (``\G(.*?)match``) and summing their lengths,
as rows, so a text with very many matches costs time in proportion; no pattern
starts again inside of a run that it has failed on.

The value of each match is then counted over the whole corpus: in how many
repositories and under how many owners it stands. A value under several owners
is a copied example; one under a single owner that looks random is taken for a
live credential. Counting folds by (value, owner, repository), then (value,
owner), then value, so a value that a third of all rows share reaches each
shuffle as a row per task.

Values never leave the task that reads the text: what is shuffled and written is
their SHA-256 and whether they look random.

Null and empty texts have no spans; texts of any length are read whole. A
repeated row counts once and gives a repeated result. A null owner is one more
owner. Columns of other names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize, text_or_empty

# Kind, pattern, group of the value, least length of the value, a cheap test that must hold.
# access and hex stand for AKIA[A-Z0-9]+ of 18 characters or more and [0-9a-f]+ of 16 or more: a run that is long enough
# is matched from the same start, and shorter ones make no rows. For assign that doesn't hold: what is dropped is passed over.
BASE = [
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
        r"(?i:password|passwd|secret|token|api_?key)",
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
]
ADDED = [
    ("bearer", r"Bearer\x20++([A-Za-z0-9._~+/=-]++)", 1, 20, r"Bearer\x20"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, r"xox[abprs]-"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 30, r"eyJ"),
    ("pem", r"-----BEGIN (?:[A-Z]++ )*+(?<=PRIVATE )KEY-----", 0, 20, r"PRIVATE KEY-----"),
]
KINDS = BASE + ADDED
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567"
#: A value with this many different characters or more looks random.
VARIED = 8
MATCH = "rank:int,nth:int,upto:int,size:int,counts:boolean,value_hash:string,varied:boolean"


def _found(text: Column, rank: int, kind: tuple) -> Column:
    """The matches of a kind: rank, place in order, length with what stands before, own length, whether it counts, its value's hash and look."""
    _, pattern, group, least, test = kind

    def random_looking(value: Column) -> Column:
        return (F.size(F.array_distinct(F.split(value, ""))) >= VARIED) & ~value.rlike(PLACEHOLDER)

    def described(piece: Column, i: Column) -> Column:
        value = F.regexp_extract(piece, pattern, group)
        return F.struct(
            F.lit(rank).alias("rank"),
            i.alias("nth"),
            F.char_length(piece).alias("upto"),
            F.char_length(F.regexp_extract(piece, pattern, 0)).alias("size"),
            (F.char_length(value) >= least).alias("counts"),
            F.sha2(value, 256).alias("value_hash"),
            random_looking(value).alias("varied"),
        )

    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    return F.when(text.rlike(test), F.transform(pieces, described)).otherwise(F.array().cast(f"array<struct<{MATCH}>>"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """row_key, id, owner, repo, rank, start, stop, value_hash, varied: every span of every kind, in code points."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        text_or_empty(text_col).alias("body"),
    ).withColumn("row_key", F.xxhash64("id", "body"))
    matches = F.concat(*[_found(F.col("body"), rank, kind) for rank, kind in enumerate(KINDS)])
    rows = rows.select("row_key", "id", "owner", "repo", F.explode(matches).alias("m"))
    rows = rows.select("row_key", "id", "owner", "repo", "m.*").dropDuplicates(["row_key", "id", "rank", "nth"])
    order = Window.partitionBy("row_key", "id", "rank").orderBy("nth")
    placed = rows.withColumn("stop", F.sum("upto").over(order))
    return placed.where("counts").select(
        "row_key", "id", "owner", "repo", "rank", (F.col("stop") - F.col("size")).alias("start"), "stop", "value_hash", "varied"
    )


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, owners, repos: in how many repositories and under how many owners each value stands."""
    by_repo = found.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def classified(found: DataFrame, max_owners: int = 1) -> DataFrame:
    """found with owners, repos and live: under max_owners or fewer, varied and no placeholder."""
    own = found.join(ownership(found), "value_hash")
    return own.withColumn("live", (F.col("owners") <= max_owners) & F.col("varied"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, how many are live or shared."""
    found = materialize(spans(docs, id_col, text_col, owner_col, repo_col), "secrets")
    marked = classified(found)
    name = F.element_at(F.array(*[F.lit(kind[0]) for kind in KINDS]), F.col("rank") + 1)
    entry = F.struct("start", "rank", F.concat_ws(":", name, F.col("start"), F.col("stop")).alias("said"))
    count = lambda rank: F.count_if(F.col("rank") == rank)
    held = marked.groupBy(F.col("row_key").alias("k"), F.col("id").alias("i")).agg(
        *[count(r).alias(f"n_{kind[0]}") for r, kind in enumerate(BASE)],
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.count_if("live").alias("n_live"),
        F.count_if(F.col("owners") > 1).alias("n_shared"),
    )
    base = F.filter("entries", lambda e: e["rank"] < len(BASE))
    say = lambda entries: F.array_join(F.transform(entries, lambda e: e["said"]), ",")
    held = held.select("k", "i", *[f"n_{kind[0]}" for kind in BASE], say(base).alias("base"), say(F.col("entries")).alias("spans"), "n_live", "n_shared")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("row_key"))
    out = rows.join(held, (F.col("row_key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        F.col("id").alias(id_col),
        *[zero(f"n_{kind[0]}") for kind in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        zero("n_live"),
        zero("n_shared"),
    )
