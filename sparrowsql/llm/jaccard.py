"""N-gram Jaccard join with Bayesian candidate pruning.

A text's set holds the hashes of its runs of SHINGLE words; a shorter text that
isn't empty has one shingle of all its words. Two texts are linked when the
Jaccard similarity of their sets is THRESHOLD or more.

1. Texts with one set (128-bit fingerprint and count) fold into one node with a
   number of copies. A node has a number of its own; ids are labels only.
2. MinHash bands (32 of 5 values) put nodes into buckets: at a similarity of 0.8
   a pair shares no bucket with probability 3e-6. Buckets of one node go, and of
   buckets with the same nodes one stays.
3. Pruning. In each bucket MinHash values (320 bytes a node, no texts) are
   compared 16 at a time; with a uniform prior, a pair is dropped as soon as the
   posterior probability of reaching the threshold falls below TOLERANCE. The
   pairs that stay join their nodes to candidate groups, so texts that share a
   band by chance or a template don't chain.
4. Verification. A group is cut into blocks, and each pair of blocks is one unit
   of work that reaches its task as rows of nodes, never of pairs. In it, pairs
   are pruned in the same way and the rest verified exactly on the sets, as bits
   over the shingles that at least two texts of the unit share.
5. A unit gives each node its number of links and one spanning edge, so output
   grows with nodes, not with links. Classes are the components of the links.

Exact numbers of links in a group of n near copies that all differ cost n^2
comparisons of bits. They are spread over (n / b)^2 / 2 units, for which each
node makes n / b rows, where b grows from BLOCK with the root of n to MOST_BLOCK:
one row up to 512 nodes, 12 rows each at 10,000, 49 at 100,000, then in
proportion to n. Buckets are cut in the same way, up to WIDE_BLOCK nodes.

Null and empty texts have no shingles, no links and a class of their own.
Repeated rows are copies. An id may stand on several texts. Null ids count as
copies and links, never as a class id when any other id is there. Texts of any
length are read whole. Any further columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize, mix, slices, utf8, words
from sparrowsql.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Nodes in a block at least, in one of a group at most, in one of a bucket at most.
BLOCK, MOST_BLOCK, WIDE_BLOCK = 512, 2_048, 8_192
#: Buckets up to this size are compared together, so many pairs at a time.
SMALL, PAIRS = 64, 20_000
_rng = np.random.default_rng(20_240_601)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(SHINGLE)], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and where each text's begin (and the end)."""
    n = len(offsets) - 1
    _, _, hashes, first = words(data, offsets)
    count = np.diff(first)
    whole = np.zeros(len(hashes), np.uint64)
    for j in range(min(SHINGLE, len(hashes))):
        whole[: len(hashes) - j] += hashes[j:] * _ORDER[j]
    text = np.repeat(np.arange(n), count)
    inside = np.arange(len(hashes)) + SHINGLE <= first[text + 1] if len(hashes) else np.zeros(0, bool)
    values, owner = [mix(whole[inside])], [text[inside]]
    for size in range(1, SHINGLE):  # texts of fewer words
        few = np.flatnonzero(count == size)
        if len(few):
            total = np.full(len(few), size, np.uint64)
            for j in range(size):
                total += hashes[first[few] + j] * _ORDER[j]
            values.append(mix(total))
            owner.append(few)
    value, own = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[fresh], own[fresh]
    return value, np.searchsorted(own, np.arange(n + 1))


def minhashes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that isn't empty (the others get zeros), as 16-bit values."""
    n = len(first) - 1
    out = np.zeros((n, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        starts = first[some]
        for i in range(HASHES):
            out[some, i] = np.minimum.reduceat((value ^ _XOR[i]) * _MULTIPLY[i], starts) >> np.uint64(24) & np.uint64(0xFFFF)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band for each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        keys = mix(keys + parts[:, :, j])
    return keys


def prints(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of each set, in halves."""
    total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[first])
    return mix(total(value)), mix(total(mix(value ^ np.uint64(0x5851F42D4C957F2D))))


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values: the least matches at which a pair stays.

    After k matches of m and a uniform prior, the posterior probability of a
    similarity of threshold or more is that of k or fewer successes in m + 1
    trials of chance threshold.
    """
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        total, k = 0.0, -1
        while total < tolerance and k < m:
            k += 1
            total += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def candidates(sig_a: np.ndarray, sig_b: np.ndarray, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that pruning leaves; with same, those with a < b only."""
    found_a, found_b = [], []
    rows = max(1, 2_000_000 // max(1, len(sig_b) * STEP))
    for at in range(0, len(sig_a), rows):
        part = sig_a[at : at + rows]
        match = (part[:, None, :STEP] == sig_b[None, :, :STEP]).sum(2)
        a, b = np.nonzero(match >= least[0])
        k = match[a, b]
        a = a + at
        if same:
            keep = a < b
            a, b, k = a[keep], b[keep], k[keep]
        for i in range(1, len(least)):
            if not len(a):
                break
            cut = slice(i * STEP, (i + 1) * STEP)
            k = k + (sig_a[a][:, cut] == sig_b[b][:, cut]).sum(1)
            keep = k >= least[i]
            a, b, k = a[keep], b[keep], k[keep]
        found_a.append(a)
        found_b.append(b)
    return np.concatenate(found_a), np.concatenate(found_b)


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of sig that pruning leaves."""
    k = np.zeros(len(a), np.int64)
    for i, few in enumerate(least):
        cut = slice(i * STEP, (i + 1) * STEP)
        k = k + (sig[a, cut] == sig[b, cut]).sum(1)
        keep = k >= few
        a, b, k = a[keep], b[keep], k[keep]
    return a, b


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets of each pair (a, b) reach the threshold, exactly."""
    size = np.array([len(s) for s in sets])
    shared = np.zeros(len(a), np.int64)
    if len(a) <= 32:
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            shared[i] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:
        used = np.unique(np.concatenate([a, b]))
        owner = np.repeat(used, size[used])
        value = np.concatenate([sets[i] for i in used])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        group = np.cumsum(np.concatenate([[0], (value[1:] != value[:-1]).astype(np.int64)])) if len(value) else np.zeros(0, np.int64)
        times = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        common = times[group] > 1
        place = np.cumsum(times > 1) - 1
        column, owner = place[group[common]], owner[common]
        total = int((times > 1).sum())
        most = max(64, (1 << 25) // len(sets))  # shingles at a time
        for low in range(0, total, most):
            here = (column >= low) & (column < low + most)
            wide = min(most, total - low)
            flags = np.zeros((len(sets), -(-wide // 64) * 64), bool)
            flags[owner[here], column[here] - low] = True
            bits = np.packbits(flags, axis=1).view(np.uint64)
            step = max(1, (1 << 22) // bits.shape[1])
            for at in range(0, len(a), step):
                both = bits[a[at : at + step]] & bits[b[at : at + step]]
                shared[at : at + step] += np.bitwise_count(both).sum(1, dtype=np.int64)
    return shared >= threshold * (size[a] + size[b] - shared) - 1e-9


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index joined to each index by the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def _links(rows: list[dict], same: bool, threshold: float, least: list[int]) -> list[tuple[int, int, int]]:
    """node, links (copies counted), root node, for the nodes of one pair of blocks."""
    rows = sorted({r["node"]: r for r in rows}.values(), key=lambda r: r["node"])
    nodes = np.array([r["node"] for r in rows], np.int64)
    copies = np.array([r["copies"] for r in rows], np.int64)
    sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
    sig = np.array([np.frombuffer(r["sig"], np.uint16) for r in rows])
    if same:
        a, b = candidates(sig, sig, True, least)
    else:
        low = min(r["block"] for r in rows)
        left, right = (np.array([i for i, r in enumerate(rows) if (r["block"] == low) == side], np.int64) for side in (True, False))
        if not len(left) or not len(right):
            return []
        a, b = candidates(sig[left], sig[right], False, least)
        a, b = left[a], right[b]
    keep = verified(sets, a, b, threshold)
    a, b = a[keep], b[keep]
    links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
    root = _roots(len(rows), a, b)
    return [(int(nodes[i]), int(links[i]), int(nodes[root[i]])) for i in np.flatnonzero(links)]


def _text(text_col: str):
    return F.col(text_col).cast("string")


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (a hash of the text), p1, p2, n, sig of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("th"), _text(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets):
                value, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p1, p2 = prints(value, first)
                sig = pa.array([s.tobytes() for s in minhashes(value, first)], pa.binary())
                made = [pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), pa.array(np.diff(first), pa.int64()), sig]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *made], ["id", "th", "p1", "p2", "n", "sig"])

    return rows.mapInArrow(run, f"id {kind}, th long, p1 long, p2 long, n long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as rows of a matrix."""
    raw, offsets = utf8(column)
    return raw.view(np.uint16).reshape(len(offsets) - 1, HASHES)


def _bands(nodes: DataFrame) -> DataFrame:
    """node, key of each band of each node."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                keys = band_keys(_matrix(part.column(1)))
                node = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.reshape(-1).view(np.int64))], ["node", "key"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, key long")


def _block(most: int):
    """Nodes in a block of a group of size nodes."""
    return F.greatest(F.lit(BLOCK), F.least(F.lit(most), 8 * F.sqrt("size")))


def _cut(rows: DataFrame, by: str, block) -> DataFrame:
    """rows (with node and size, the number of nodes of their group) for each pair of blocks (low, high) that theirs is in."""
    placed = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", by), F.col("blocks")))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return units.drop("other", "blocks", "size")


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, low, high, block, node, sig: the nodes of every bucket of two or more, but of buckets with the same nodes one."""
    banded = materialize(_bands(nodes), "bands")
    sized = banded.groupBy("key").agg(
        F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("all")
    )
    kept = sized.where("size > 1").groupBy("size", "first", "last", "all").agg(F.min("key").alias("key")).select("key", "size")
    members = banded.join(materialize(kept, "buckets"), "key")
    return _cut(members.join(nodes.select("node", "sig"), "node"), "key", _block(WIDE_BLOCK))


def _joined(buckets: DataFrame, threshold: float) -> DataFrame:
    """node, group: spanning edges of the pairs that pruning leaves in each unit of a bucket."""
    least = fewest_matches(threshold)

    def run(batches):
        nodes, sigs, left, right = [], [], [], []  # of small buckets, compared together
        base = pairs = 0

        def edges(node, a, b):
            root = _roots(len(node), a, b)
            some = np.unique(np.concatenate([a, b]))
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["node", "group"])

        def close():
            nonlocal base, pairs
            node = np.concatenate(nodes)
            a, b = pruned(np.concatenate(sigs), np.concatenate(left), np.concatenate(right), least)
            for x in (nodes, sigs, left, right):
                x.clear()
            base = pairs = 0
            return edges(node, a, b)

        for unit, same, columns in _units(batches):
            node, sig = columns[1].to_numpy(), _matrix(columns[2])
            if same and len(node) <= SMALL:
                a, b = np.triu_indices(len(node), 1)
                nodes.append(node)
                sigs.append(sig)
                left.append(a + base)
                right.append(b + base)
                base, pairs = base + len(node), pairs + len(a)
                if pairs >= PAIRS:
                    yield close()
                continue
            if same:
                yield edges(node, *candidates(sig, sig, True, least))
            else:
                block = columns[0].to_numpy()
                one, two = np.flatnonzero(block == unit[1]), np.flatnonzero(block == unit[2])
                a, b = candidates(sig[one], sig[two], False, least)
                yield edges(node, one[a], two[b])
        if pairs:
            yield close()

    keys = ["key", "low", "high"]
    laid = buckets.select(*keys, "block", "node", "sig").repartition(*keys).sortWithinPartitions(*keys)
    return laid.mapInArrow(run, "node long, group long")


def _units(batches):
    """(key, low == high, the other columns) of each run of rows with equal first three columns."""
    key, held = None, []

    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[3:]]

    for batch in batches:
        if not batch.num_rows:
            continue
        g, low, high = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
            here = (int(g[a]), int(low[a]), int(high[a]))
            if here != key:
                if held:
                    yield key, key[1] == key[2], whole()
                key, held = here, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, key[1] == key[2], whole()


def _with_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, grp, size, copies, set, sig of the wanted nodes, from their texts."""
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("th"), _text(text_col).alias("text"))
    rows = text.join(wanted, F.col("id").eqNullSafe(F.col("want")) & (F.col("th") == F.col("want_th")))
    rows = rows.select("node", "grp", "size", "copies", "text")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(4))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                value, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sig = minhashes(value, first)
                made = [pa.array([value[first[i] : first[i + 1]].tobytes() for i in range(b - a)], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *made], ["node", "grp", "size", "copies", "set", "sig"])

    return rows.mapInArrow(run, "node long, grp long, size long, copies long, set binary, sig binary")


def _links(node: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, sides: tuple | None, threshold: float, least: list[int]):
    """node, links (copies counted), root node, for the nodes of one unit that have links; sides: the rows of its two blocks."""
    if sides is None:
        a, b = candidates(sig, sig, True, least)
    else:
        a, b = candidates(sig[sides[0]], sig[sides[1]], False, least)
        a, b = sides[0][a], sides[1][b]
    keep = verified(sets, a, b, threshold)
    a, b = a[keep], b[keep]
    links = (np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))).astype(np.int64)
    root, some = _roots(len(node), a, b), np.flatnonzero(links)
    return node[some], links[some], node[root[some]]


def _compare(units: DataFrame, threshold: float) -> DataFrame:
    """node, links, root for each unit (pair of blocks of one group)."""
    least = fewest_matches(threshold)

    def run(batches):
        for unit, same, columns in _units(batches):
            node = columns[1].to_numpy()
            _, once = np.unique(node, return_index=True)  # a row that the table repeats comes repeated
            if len(once) < 2:
                continue
            columns = [c.take(pa.array(once)) for c in columns]
            block, node, copies = (columns[i].to_numpy() for i in range(3))
            raw, offsets = utf8(columns[3])
            sets = [raw[x:y].view(np.uint64) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sides = None if same else (np.flatnonzero(block == unit[1]), np.flatnonzero(block == unit[2]))
            made = _links(node, copies, sets, _matrix(columns[4]), sides, threshold, least)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["node", "links", "root"])

    keys = ["grp", "low", "high"]
    laid = units.select(*keys, "block", "node", "copies", "set", "sig").repartition(*keys).sortWithinPartitions(*keys)
    return laid.mapInArrow(run, "node long, links long, root long")


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """id, th, class_id, n_links, stays of every row: whether it is the one of its class with the least id (then the least set, then text)."""
    rows = materialize(_signatures(docs, id_col, text_col), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    folded = rows.where("n > 0").groupBy("p1", "p2", "n").agg(least.alias("w"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    folded = folded.select("p1", "p2", "n", F.col("w.id").alias("want"), F.col("w.th").alias("want_th"), "copies", "sig")
    nodes = materialize(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so a number stays

    near = _joined(_buckets(nodes), threshold)
    grouped = components(near, "near")
    sizes = materialize(grouped.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    placed = grouped.join(sizes, "label").withColumnRenamed("label", "grp")
    wanted = nodes.join(placed, "node").select("want", "want_th", "node", "grp", "size", "copies")
    found = materialize(_compare(_cut(_with_sets(docs, wanted, id_col, text_col), "grp", _block(MOST_BLOCK)), threshold), "links")

    classes_ = components(found.select("node", F.col("root").alias("group")).union(found.select(F.col("root").alias("node"), F.col("root").alias("group"))), "class")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.drop("sig").join(classes_, "node", "left").withColumn("label", F.coalesce("label", "node"))
    told = materialize(told.join(links, "node", "left"), "told")
    order = F.struct(F.col("want").isNull().alias("none"), "want", "p1", "p2", "n")
    best = materialize(told.groupBy("label").agg(F.min(order).alias("best")), "best")
    told = told.join(best, "label").select(
        F.col("p1").alias("a"),
        F.col("p2").alias("b"),
        F.col("n").alias("m"),
        F.col("best.want").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "want",
        "want_th",
        ((F.col("best.p1") == F.col("p1")) & (F.col("best.p2") == F.col("p2")) & (F.col("best.n") == F.col("n"))).alias("best"),
    )
    out = rows.select("id", "th", "p1", "p2", "n").join(told, (F.col("p1") == F.col("a")) & (F.col("p2") == F.col("b")) & (F.col("n") == F.col("m")), "left")
    one = F.col("best") & F.col("id").eqNullSafe(F.col("want")) & (F.col("th") == F.col("want_th"))
    return out.select(
        "id",
        "th",
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, one).otherwise(True).alias("stays"),  # without shingles: a class of its own
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (the class's smallest id), n_links (other documents at threshold or more)."""
    return _linked(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each class, with all its columns; of rows repeated with one id and text, one."""
    told = materialize(_linked(docs, id_col, text_col, threshold).select("id", "th", "stays"), "stays")
    drop = told.where(~F.col("stays")).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    key = (F.xxhash64(_text(text_col)) == F.col("__th")) & F.col(id_col).eqNullSafe(F.col("__id"))
    kept = docs.join(drop, key, "left_anti")
    repeated = told.where("stays").groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
