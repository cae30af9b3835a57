"""Suffix-array dedup: bytes covered by an earlier copy of a LENGTH-byte string go, the first copy stays.

Texts are UTF-8 bytes; matches never cross documents; earlier means a smaller
document id, or the same document and an earlier start. All strings are judged
on the input.

1. Anchors. In every LENGTH-byte string, the leftmost 32-byte run with the least
   hash is its anchor, so equal strings have equal anchors at equal offsets. A
   text has about one anchor in 35 bytes. An anchor's context is all bytes that
   its strings can reach; contexts with equal anchors and equal bytes (128 bits
   of hash) are copies. Each task folds the copies that it sees, so copies in a
   third of all rows reach the shuffle as a few rows per task.
2. Occurrences meet in sorted streams, dealt by ranges of (anchor, context), so
   that a frequent anchor is spread over tasks; a sample of documents gives the
   ranges' bounds, so that each text is searched once. Of equal contexts the first
   stays and the others are removed whole. If an anchor has one context only,
   that's all.
3. An anchor with more than MOST different contexts (a license line with other
   text around it in every document) would be too much for one suffix array. Its
   strings get longer anchors: the leftmost run of least hash of 66 bytes, then
   83, 92 and so on up to LENGTH, and steps 1 and 2 are repeated on the pieces of
   its contexts that have them. Pieces that lie inside of the line are equal and
   fold; pieces whose anchor takes in other text are rare; what stays frequent is
   about one piece a context and level, half as wide as before. At LENGTH bytes a
   piece is one string, so the levels end.
4. Where contexts of one anchor differ (the edges of copied passages), the first
   occurrence of each context is read again from its document, and the contexts
   are put into suffix order. The previous and the next smaller position in that
   order give, for each suffix, its longest match with an earlier place (a
   longest-previous-factor array), cut at LENGTH: where it reaches LENGTH, that
   string has an earlier copy. Frequent anchors or not, this step decides; it
   leaves out the bytes of strings whose hash occurs once among the contexts.

A document's removed spans are merged at the end, when spans join texts. Null
and empty texts have no bytes; texts shorter than LENGTH lose nothing. Null ids
come first. Where an id stands on several rows, the row whose text's hash is
smaller is earlier, and rows equal in both are one row, given once. An empty
table gives an empty result. Columns of other names don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize, mix, powers, slices, utf8

LENGTH, GRAM = 100, 32
#: Different contexts of one anchor that one suffix array takes; an anchor with more is told apart by longer anchors.
MOST = 2_000
#: Rows of anchors that a task folds at a time, and contexts in one suffix array (and those of one more anchor).
FOLD_ROWS, SORTED_CONTEXTS = 500_000, 4_000
#: Bytes that the kernels over anchors work on at a time, so that their arrays stay in a core's cache.
CACHED_BYTES = 1 << 16
#: For the bounds of ranges: documents (or contexts) a range, and anchors a document.
SAMPLE_ROWS, SAMPLE_ANCHORS = 16, 12
_SALT = np.uint64(0x2545F4914F6CDD1D)
_BYTE = mix(np.arange(256, dtype=np.uint64) + _SALT)
_OTHER = mix(np.arange(256, 512, dtype=np.uint64) * _SALT)


def _prefix(data: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=total[1:])
    return total


def _hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[start:end] from prefix sums."""
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _grams(total: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each run of gram bytes."""
    _, down = powers(len(total))
    return mix((total[gram:] - total[:-gram]) * down[: len(total) - gram])


def _contexts(data: np.ndarray, total: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each context data[low:high] around an anchor at place; where it begins is part of them."""
    shape = (place - low).astype(np.uint64) * np.uint64(1009) + (high - place).astype(np.uint64)
    return mix(_hash(total, low, high) + shape), mix(_hash(_prefix(data, _OTHER), low, high) + shape)


def widths(length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """The sizes of anchors, level by level: each takes half of what is left up to length."""
    out = [gram]
    while out[-1] < length:
        out.append(out[-1] + (length - out[-1] + 1) // 2)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value of each run of width values.

    The place takes the low 24 bits of a key, so values count by their high 40
    bits, everywhere alike; longer inputs go in blocks.
    """
    low = np.uint64(24)
    most, out = (1 << 24) - width, []
    for at in range(0, max(1, len(values) - width + 1), most):
        part = values[at : at + most + width - 1]
        best = (part >> low << low) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        out.append((best & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For texts end to end: text, place in data, hash of the gram, two hashes, start and end of the context of each anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, *[none.astype(np.uint64)] * 3, none, none
    total = _prefix(data)
    grams = _grams(total, GRAM)
    chosen = window_minima(grams, length - GRAM + 1)  # of each window start
    inside = np.ones(len(chosen), bool)
    for end in offsets[1:-1].tolist():  # strings that would cross into the next text
        inside[max(0, end - length + 1) : end] = False
    chosen = chosen[inside]
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = chosen[1:] != chosen[:-1]  # window starts ascend, and so do their anchors
    place = chosen[fresh]
    text = np.searchsorted(offsets, place, side="right") - 1
    reach = length - GRAM
    low = np.maximum(place - reach, offsets[text])
    high = np.minimum(place + GRAM + reach, offsets[text + 1])
    return text, place, grams[place], *_contexts(data, total, place, low, high), low, high


def narrowed(data: np.ndarray, offsets: np.ndarray, lead: np.ndarray, gram: int, wider: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Like anchors(), for contexts end to end whose anchor of gram bytes stands at lead: the anchors of wider bytes of its strings."""
    total = _prefix(data)
    at = np.arange(len(data) - length + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    own = window_minima(_grams(total, gram), length - gram + 1) == offsets[text] + lead[text]
    own &= at + length <= offsets[text + 1]  # no string that crosses into the next context
    at, text = at[own], text[own]
    grams = _grams(total, wider)
    place = window_minima(grams, length - wider + 1)[at]
    fresh = np.ones(len(at) + 1, bool)
    fresh[1:-1] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first, last = np.flatnonzero(fresh[:-1]), np.flatnonzero(fresh[1:])
    low, high, place, text = at[first], at[last] + length, place[first], text[first]
    return text, place, grams[place], *_contexts(data, total, place, low, high), low, high


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in order of their first depth bytes (prefix doubling), and each one's rank.

    Each start has depth bytes of its own text behind it, so that it doesn't matter what follows a text.
    """
    n, have = len(data), min(8, depth)
    padded = np.concatenate([data, np.zeros(have, np.uint8)])
    packed = np.zeros(n, np.uint64)
    for j in range(have):
        packed = packed << np.uint64(8) | padded[j : j + n]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    while have < depth:
        step = min(have, depth - have)
        have += step
        at = starts if have == depth else np.arange(n - step)
        fresh = np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + step], return_inverse=True)[1].astype(np.int64)
        rank = fresh if have == depth else np.concatenate([fresh, np.zeros(step, np.int64)])
    if depth <= 8:
        rank = rank[starts]
    return np.argsort(rank, kind="stable"), rank


def nearest_smaller(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest place before and after it whose position is smaller; -1 or n for none."""
    n = len(position)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    todo = np.flatnonzero(before >= 0)
    while len(todo):  # nothing between before[i] and i is smaller, so its own pointer may be followed
        todo = todo[position[before[todo]] >= position[todo]]
        before[todo] = before[before[todo]]
        todo = todo[before[todo] >= 0]
    todo = np.flatnonzero(after < n)
    while len(todo):
        todo = todo[position[after[todo]] >= position[todo]]
        after[todo] = after[after[todo]]
        todo = todo[after[todo] < n]
    return before, after


def earlier_copies(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in it) of each string of length bytes that has a copy at a smaller position.

    Texts lie end to end; starts gives the position of each. Texts may overlap,
    as contexts of one document do: a string is no copy of itself.
    """
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    if not len(text):
        return text, text
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    # Only bytes of strings whose hash occurs again are put into order.
    hashes = _grams(_prefix(data), length)[offsets[text] + place]
    order = np.argsort(hashes)
    twin = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(text), bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    text, place = text[again], place[again]
    if not len(text):
        return text, text
    at = offsets[text] + place
    covered = np.zeros(len(data) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.subtract.at(covered, at + length, 1)
    covered = np.cumsum(covered[:-1]) > 0
    order, rank = suffix_order(data[covered], (np.cumsum(covered) - 1)[at], length)
    before, after = nearest_smaller((starts[text] + place)[order])
    n, ranks = len(order), rank[order]  # equal ranks: equal in their first length bytes
    hit = (before >= 0) & (ranks[np.maximum(before, 0)] == ranks) | (after < n) & (ranks[np.minimum(after, n - 1)] == ranks)
    found = np.sort(order[hit])
    return text[found], place[found]


# --- the distributed plan ---------------------------------------------------------------------------

# h; c, d: hashes of anchor and context; nil, id, row: the document; a: where the context starts in it; lead: where
# the anchor starts in the context; done: whether the task knows that an earlier copy exists. Pieces of contexts bring their bytes.
ROW = "h long, c long, d long, nil int, id long, row long, a long, lead int, size int, done boolean"
_ORDER = ["h", "c", "d", "done", "nil", "id", "row", "a"]
_NAMES = ["h", "c", "d", "nil", "id", "row", "a", "lead", "size"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
FOUND = "kind int, h long, nil int, id long, row long, a long, lead int, size int"
_KEPT = ["h", "nil", "id", "row", "a", "lead", "size"]
_LEAST = np.iinfo(np.int64).min
SPAN, CONTEXT, DEEP = 0, 1, 2  # a span to remove; a context to compare; one whose anchor has too many
EDGE, COUNT = 3, 4  # a context whose anchor may go on in the next task; how many contexts of it this task has (in a)


def _batch(columns: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def ranges(h: np.ndarray, c: np.ndarray, low_h: np.ndarray, low_c: np.ndarray) -> np.ndarray:
    """The range of each (h, c): how many of the bounds (low_h, low_c), which ascend, are not above it."""
    part = np.searchsorted(low_h, h, side="right")
    values, first, n = np.unique(low_h, return_index=True, return_counts=True)
    for k, x, y in zip(values.tolist(), first.tolist(), (first + n).tolist(), strict=True):
        if y > x + 1 or low_c[x] > _LEAST:
            at = np.flatnonzero((part == y) & (h == k))
            part[at] = x + np.searchsorted(low_c[x:y], c[at], side="right")
    return part


def _bounds(sample: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges 1 to n - 1 of (h, c) begin, from a sample. Any bounds give the same result; these give ranges of like size.

    Copies count once, as they fold. A range begins within an anchor only if that one anchor fills a whole range.
    """
    got = sample.select("h", "c").toArrow().combine_chunks()
    h, c = (x.to_numpy() for x in got.columns)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[fresh], c[fresh]
    at = np.arange(1, n) * len(h) // n if len(h) else np.zeros(0, np.int64)
    h, c = h[at], c[at]
    alone = np.ones(len(h), bool)
    alone[1:] &= h[1:] != h[:-1]
    alone[:-1] &= h[1:] != h[:-1]
    return h, np.where(alone, _LEAST, c)


class _Fold:
    """Marks, in runs of a task's rows, all but the first of equal (h, c, d) as done; bounds, if given, say which range each row goes to."""

    def __init__(self, bounds: tuple[np.ndarray, np.ndarray] | None):
        self.bounds = bounds
        self.parts: list[list[np.ndarray]] = []
        self.raw: list[pa.Array] = []
        self.size = 0

    def add(self, columns: list[np.ndarray], raw: pa.Array | None = None):
        self.parts.append(columns)
        if raw is not None:
            self.raw.append(raw)
        self.size += len(columns[0])
        return self.close() if self.size >= FOLD_ROWS else None

    def close(self):
        if not self.size:
            return None
        h, c, d, nil, id_, row, a, lead, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(h)
        twin = h[order[1:]] == h[order[:-1]]
        some = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]  # the others have no copies here
        some = some[np.lexsort([x[some] for x in (a, row, id_, nil, d, c, h)])]
        x, y = some[1:], some[:-1]
        again = np.zeros(len(h), bool)
        again[x] = (h[x] == h[y]) & (c[x] == c[y]) & (d[x] == d[y])
        # What is known to go needs to meet nothing more: it travels under the anchor of any other row that
        # stays, so that it is dealt out as they are, and a context of its own.
        spot = mix(id_[again].view(np.uint64) * _SALT + a[again].view(np.uint64))
        stay = np.flatnonzero(~again)
        h[again] = h[stay[(spot % np.uint64(len(stay))).astype(np.int64)]]
        c[again], d[again] = mix(spot + _SALT).view(np.int64), 0
        made = _batch([h, c, d, nil, id_, row, a, lead, size, again], [*_NAMES, "done"], [*_KINDS, pa.bool_()])
        if self.bounds is not None:
            made = made.append_column("part", pa.array(ranges(h, c, *self.bounds), pa.int32()))
        if self.raw:
            raw = pa.concat_arrays(self.raw)
            made = made.append_column("bytes", pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), raw))
        self.parts, self.raw, self.size = [], [], 0
        return made


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nil (0 for a null id, 1 else), id, row (a hash of the text where ids repeat, else 0), text."""
    text, ids = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    unique = docs.groupBy(ids.alias("i")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = docs.select(ids.isNotNull().cast("int").alias("nil"), F.coalesce(ids, F.lit(0)).alias("id"), text.alias("text"))
    row = F.lit(0).cast("long") if unique else F.xxhash64("text")
    rows = rows.select("nil", "id", row.alias("row"), "text")
    return rows if unique else rows.dropDuplicates(["nil", "id", "row"])


def _signed(*hashes: np.ndarray) -> list[np.ndarray]:
    return [x.view(np.int64) for x in hashes]


def _anchor_rows(rows: DataFrame, length: int, bounds=None, few: int = 0) -> DataFrame:
    """The occurrences of anchors, folded in the task; few: so many of each text only."""

    def run(batches):
        fold = _Fold(bounds)
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            nil, ids, row = (batch.column(i).to_numpy() for i in range(3))
            for x, y in slices(offsets, CACHED_BYTES):
                own = offsets[x : y + 1] - offsets[x]
                found = anchors(data[offsets[x] : offsets[y]], own, length)
                if few:
                    n = np.bincount(found[0], minlength=y - x)
                    nth = np.arange(len(found[0])) - (np.cumsum(n) - n)[found[0]]
                    found = [v[nth * few % n[found[0]] < few] for v in found]
                text, place, h, c, d, low, high = found
                if not len(text):
                    continue
                at = own[text]
                columns = [*_signed(h, c, d), nil[x:y][text], ids[x:y][text], row[x:y][text], low - at, place - low, high - low]
                if (made := fold.add(columns)) is not None:
                    yield made
        if (made := fold.close()) is not None:
            yield made

    return rows.select("nil", "id", "row", "text").mapInArrow(run, ROW + ", part int" * (bounds is not None))


def _deeper(contexts: DataFrame, gram: int, wider: int, length: int, bounds=None) -> DataFrame:
    """The pieces of contexts whose strings have one anchor of wider bytes, as occurrences with their bytes, folded in the task."""

    def run(batches):
        fold = _Fold(bounds)
        for batch in batches:
            data, offsets = utf8(batch.column(5))
            nil, ids, row, a, lead = (batch.column(i).to_numpy() for i in range(5))
            for x, y in slices(offsets, CACHED_BYTES):
                part, own = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                text, place, h, c, d, low, high = narrowed(part, own, lead[x:y], gram, wider, length)
                raw = pa.array([part[s:e].tobytes() for s, e in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                columns = [*_signed(h, c, d), nil[x:y][text], ids[x:y][text], row[x:y][text], a[x:y][text] + low - own[text], place - low, high - low]
                if (made := fold.add(columns, raw)) is not None:
                    yield made
        if (made := fold.close()) is not None:
            yield made

    return contexts.select("nil", "id", "row", "a", "lead", "bytes").mapInArrow(run, ROW + ", part int" * (bounds is not None) + ", bytes binary")


def _met(occurrences: DataFrame, most: int) -> DataFrame:
    """kind, h, document, a, lead, size (and bytes): spans that go, and the first occurrences of contexts whose anchor has several.

    Rows are dealt by ranges of (anchor, context), so a frequent anchor's
    contexts lie in as many tasks as its rows need, and a task holds at most
    `most` of them. What a task can't settle alone, the contexts of its first
    and its last anchor, it gives out as EDGE with their COUNT.
    """
    raw = "bytes" in occurrences.columns
    fields = [*_KEPT, "bytes"] if raw else _KEPT

    def run(batches):
        last = None  # h, c, d of the row before
        first_h, opening, before = None, True, 0  # the task's first anchor, whether it is still open, its contexts
        held: list[pa.RecordBatch] = []  # the open anchor's contexts, unless it is the first or has too many
        count = 0

        def rows_of(got, place, kind):
            out = got.select(fields).take(pa.array(place))
            columns = out.columns
            if raw and np.isscalar(kind) and kind == SPAN:
                columns[-1] = pa.nulls(len(place), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(kind), len(place))), *columns], ["kind", *fields])

        def told(batch, kind):
            return batch.set_column(0, "kind", pa.array(np.full(batch.num_rows, kind, np.int32)))

        def more(got, place):
            """Contexts of the open anchor: the batches to give out now."""
            nonlocal held, count
            count += len(place)
            if opening:
                return [rows_of(got, place, EDGE)] if len(place) else []
            held.append(rows_of(got, place, CONTEXT))
            if count <= most:
                return []
            out, held = [told(x, DEEP) for x in held], []
            return out

        for got in batches:
            if not got.num_rows:
                continue
            h, c, d, done = (got.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 9))
            if last is None:
                first_h, last = h[0], (h[0], None, None)
            new_h = np.concatenate([[h[0] != last[0]], h[1:] != h[:-1]])
            same = (c[1:] == c[:-1]) & (d[1:] == d[:-1])
            new_c = new_h | np.concatenate([[c[0] != last[1] or d[0] != last[2]], ~same])
            last = h[-1], c[-1], d[-1]
            first = new_c & ~done
            gone = np.flatnonzero(~first)
            if len(gone):
                yield rows_of(got, gone, SPAN)
            place = np.flatnonzero(first)
            group = np.cumsum(new_h)
            top, group = int(group[-1]), group[place]  # 0: the anchor that was open before
            yield from more(got, place[group == 0])
            if top:
                if opening:
                    opening, before = False, count
                elif count > 1:
                    yield from held
                counts = np.bincount(group, minlength=top + 1)
                inner = (group > 0) & (group < top) & (counts[group] > 1)
                if inner.any():
                    yield rows_of(got, place[inner], np.where(counts[group[inner]] > most, DEEP, CONTEXT))
                held, count = [], 0
                yield from more(got, place[group == top])
        if last is not None:
            for x in held:
                yield told(x, EDGE)
            tell = [(first_h, count if opening else before)] + [(last[0], count)] * (not opening)
            none = [0] * len(tell)
            columns = [[COUNT] * len(tell), [x for x, _ in tell], none, none, none, [n for _, n in tell], none, none]
            made = _batch(columns, ["kind", *_KEPT], [pa.int32(), *(_KINDS[_NAMES.index(x)] for x in _KEPT)])
            yield made.append_column("bytes", pa.nulls(len(tell), pa.binary())) if raw else made

    if "part" in occurrences.columns:
        dealt = occurrences.repartitionById(_partitions(occurrences), F.col("part"))
    else:
        dealt = occurrences.repartitionByRange("h", "c")
    return dealt.sortWithinPartitions(*_ORDER).mapInArrow(run, FOUND + ", bytes binary" * raw)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sampled(rows: DataFrame, n_rows: int, wanted: int, *key: str) -> DataFrame:
    """About as many rows as wanted, chosen by a hash of their key."""
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(max(1, n_rows // wanted))) == 0)


def _settled(met: DataFrame, most: int) -> DataFrame:
    """The contexts to compare or to go deeper with, those at the edges of tasks decided by all tasks' counts."""
    counts = met.where(F.col("kind") == COUNT).groupBy("h").agg(F.sum("a").alias("n"))
    edges = met.where(F.col("kind") == EDGE).join(F.broadcast(counts), "h").where("n > 1")  # two counts a task at most
    edges = edges.withColumn("kind", F.when(F.col("n") > most, DEEP).otherwise(CONTEXT)).select(*met.columns)
    return met.where(F.col("kind").isin(CONTEXT, DEEP)).unionByName(edges)


PIECE = ["kind", "h", "nil", "id", "row", "a", "lead", "bytes"]


def _with_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """kind, h, document, a, lead, bytes of the wanted contexts, cut from their documents."""
    asked = wanted.groupBy("nil", "id", "row").agg(F.collect_list(F.struct("kind", "h", "a", "lead", "size")).alias("asked"))
    joined = rows.join(asked, ["nil", "id", "row"]).select("nil", "id", "row", "text", "asked")
    schema = "kind int, h long, nil int, id long, row long, a long, lead int, bytes binary"

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            lists = batch.column(4)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            fields = lists.flatten()
            kind, h, a, lead, size = (fields.field(i).to_numpy() for i in range(5))
            start = offsets[owner] + a
            for x in range(0, len(owner), 20_000):
                y = min(x + 20_000, len(owner))
                cut = [data[s : s + n].tobytes() for s, n in zip(start[x:y].tolist(), size[x:y].tolist(), strict=True)]
                ids = [batch.column(i).to_numpy()[owner[x:y]] for i in range(3)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield _batch([kind[x:y], h[x:y], *ids, a[x:y], lead[x:y], cut], PIECE, kinds)

    return joined.mapInArrow(run, schema)


SPANS = "nil int, id long, row long, a long, size int"


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the strings with earlier copies, from suffix arrays over whole groups of contexts."""

    def close(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        nil, id_, row, a = (table.column(i).to_numpy() for i in range(1, 5))
        order = np.lexsort((a, row, id_, nil))
        nil, id_, row, a = nil[order], id_[order], row[order], a[order]
        data, offsets = utf8(table.column(5).combine_chunks().take(pa.array(order)))
        new = np.concatenate([[False], (id_[1:] != id_[:-1]) | (row[1:] != row[:-1]) | (nil[1:] != nil[:-1])])
        text, place = earlier_copies(data, offsets, (np.cumsum(new) << 40) + a, length)
        if not len(text):
            return None
        edge = np.ones(len(text) + 1, bool)
        edge[1:-1] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
        low, high = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
        text, place, size = text[low], place[low], place[high] - place[low] + length
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return _batch([nil[text], id_[text], row[text], a[text] + place, size], ["nil", "id", "row", "a", "size"], kinds)

    def run(batches):
        parts: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            h = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])) if len(h) else []
            at = 0
            for cut in starts:  # where another anchor begins
                if size + cut - at >= SORTED_CONTEXTS:
                    parts.append(batch.slice(at, cut - at))
                    if (made := close(parts)) is not None:
                        yield made
                    parts, size, at = [], 0, cut
            if len(h):
                parts.append(batch.slice(at))
                size += len(h) - at
                last = h[-1]
        if size and (made := close(parts)) is not None:
            yield made

    return contexts.select("h", "nil", "id", "row", "a", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def removed_spans(rows: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """nil, id, row, a, size of spans whose bytes have earlier copies; spans may overlap."""
    sizes, n = widths(length), _partitions(rows)
    # Spark's own ranges would find all anchors twice, once for their bounds.
    few = _sampled(rows, rows.count(), SAMPLE_ROWS * n, "nil", "id", "row")
    bounds = _bounds(_anchor_rows(few, length, few=SAMPLE_ANCHORS), n)
    met = materialize(_met(_anchor_rows(rows, length, bounds), most), "anchors")
    span = ["nil", "id", "row", "a", "size"]
    found = met.where(F.col("kind") == SPAN).select(*span)
    pieces = materialize(_with_bytes(rows, _settled(met, most)), "contexts")
    contexts = pieces.where(F.col("kind") == CONTEXT)
    for gram, wider in zip(sizes, sizes[1:], strict=False):
        deep = pieces.where(F.col("kind") == DEEP)
        if not (many := deep.count()):
            break
        bound = most if wider < length else 1 << 62  # one string each: none is left to tell apart
        few = _sampled(deep, many, SAMPLE_ROWS * SAMPLE_ANCHORS * n, "nil", "id", "row", "a")
        bounds = _bounds(_deeper(few, gram, wider, length), n)
        met = materialize(_met(_deeper(deep, gram, wider, length, bounds), bound), "anchors")
        found = found.union(met.where(F.col("kind") == SPAN).select(*span))
        pieces = _settled(met, bound).select(*PIECE)
        contexts = contexts.union(pieces.where(F.col("kind") == CONTEXT))
    return found.union(materialize(_compared(contexts, length), "compared"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST, outputs: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and, as outputs, kept (the remaining bytes) and spans."""
    rows = _rows(docs, id_col, text_col)
    spans = removed_spans(rows, length, most).groupBy("nil", "id", "row").agg(F.collect_list(F.struct("a", "size")).alias("spans"))
    joined = rows.join(spans, ["nil", "id", "row"], "left").select("nil", "id", "text", "spans")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, spans array<struct<start:long,stop:long>>" * outputs

    def made(nil, ids, data, offsets, owner, start, size):
        """owner, start, size: of the spans, in any order."""
        n = len(ids)
        order = np.argsort(offsets[owner] + start)
        owner, start = owner[order], start[order]
        stop = start + size[order]
        far = np.maximum.accumulate(offsets[owner] + owner + stop)  # a byte lies between documents, so no span touches the next one's
        fresh = np.ones(len(owner) + 1, bool)
        fresh[1:-1] = (offsets[owner] + owner + start)[1:] > far[:-1]
        first, last = np.flatnonzero(fresh[:-1]), np.flatnonzero(fresh[1:])
        owner, start = owner[first], start[first]
        stop = far[last] - offsets[owner] - owner
        edges = np.zeros(len(data) + 1, np.int8)
        np.add.at(edges, offsets[owner] + start, 1)
        np.add.at(edges, offsets[owner] + stop, -1)
        rest = data[np.cumsum(edges[:-1], dtype=np.int8) == 0].tobytes()
        removed = np.zeros(n, np.int64)
        np.add.at(removed, owner, stop - start)
        n_spans = np.bincount(owner, minlength=n)
        cuts = (offsets - np.concatenate([[0], np.cumsum(removed)])).tolist()
        kept = [rest[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        out = [pa.array(ids, mask=nil == 0), np.diff(offsets), removed, n_spans, [hashlib.sha256(k).hexdigest() for k in kept]]
        names, kinds = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [*[pa.int64()] * 4, pa.string()]
        batch = _batch(out, names, kinds)
        if outputs:
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"])
            at = pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32())
            batch = batch.append_column("kept", pa.array(kept, pa.binary())).append_column("spans", pa.ListArray.from_arrays(at, spans))
        return batch

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            nil, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            start, size = (lists.flatten().field(i).to_numpy() for i in range(2))
            owner = np.repeat(np.arange(len(ids)), np.diff(ends))
            for x, y in slices(offsets):
                p, q = ends[x], ends[y]
                own = offsets[x : y + 1] - offsets[x]
                yield made(nil[x:y], ids[x:y], data[offsets[x] : offsets[y]], own, owner[p:q] - x, start[p:q], size[p:q].astype(np.int64))

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
