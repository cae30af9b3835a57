import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sparrowsql.llm import suffix_dedup
from sparrowsql.llm.common import table


def brute(rows, length=100):
    """rows: (id, text), ids distinct; every string of length bytes in ascending order of (id, start)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(frame, **options):
    return sorted(repr(tuple(r)[:5]) for r in suffix_dedup.dedup(frame, **options).collect())


def test_tables(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(docs) == want
    assert any(", 0, 0," not in r for r in want)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde é") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(20, len(s))], word()]
        rows.append((rng.randint(0, 1 << 40) if i % 7 else i, "".join(parts)))
    rows.append((5, "ab" * 3000 + "x" + "ab" * 200))
    rows.append((1 << 50, "z" * 700))
    return list({r[0]: r for r in rows}.values())


def test_passages_with_any_context(spark):
    for seed, most in ((1, 2_000), (2, 3), (3, 1)):  # the second and third tell contexts apart by longer anchors
        rows = passages(seed)
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(frame, most=most) == brute(rows)


def test_line_with_thousands_of_contexts(spark):
    """One line, whole or cut, with other text around it in every document; production parameters."""
    rng = random.Random(11)
    line = "Licensed under the terms of the example license, version two; you may not use this file except as it says. " * 2
    rows = []
    for i in range(5_000):
        around = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) for _ in range(2)]
        cut = line if i % 3 else line[rng.randint(0, 60) : len(line) - rng.randint(0, 60)]
        rows.append((i, around[0] + cut + around[1]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    met = suffix_dedup._met(suffix_dedup._anchor_rows(suffix_dedup._rows(frame, "doc_id", "text"), 100), suffix_dedup.MOST)
    assert suffix_dedup._settled(met, suffix_dedup.MOST).where("kind = 2").count() > suffix_dedup.MOST
    assert got(frame) == brute(rows)


def test_edges(spark, no_docs):
    long = "".join(random.Random(7).choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, None), (3, ""), (4, "x" * 99), (5, "y" * 100), (6, "y" * 101), (None, long[500:2500]), (7, long), (8, "é" * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)
    assert suffix_dedup.dedup(no_docs).count() == 0
    twice = spark.createDataFrame([(1, long), (1, long), (1, "y" * 150)], "doc_id long, text string")
    assert sorted(r.n_bytes for r in suffix_dedup.dedup(twice).collect()) == [150, 30_000]


def test_lpf_agrees_with_sets():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for length in (5, 8, 9, 13, 17):
        text, place = suffix_dedup.earlier_copies(data, offsets, np.arange(30) << 20, length)
        seen, want = set(), []
        for k, t in enumerate(texts):
            for i in range(len(t) - length + 1):
                if t[i : i + length] in seen:
                    want.append((k, i))
                seen.add(t[i : i + length])
        assert list(zip(text.tolist(), place.tolist(), strict=True)) == want


def test_widths_end_at_the_whole_string():
    assert suffix_dedup.widths() == [32, 66, 83, 92, 96, 98, 99, 100]


def test_each_text_is_searched_once(spark):
    """Finding anchors and cutting contexts read every text once each; the bounds of ranges need a sample only."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = [(1, i, 0, " ".join(rng.choice(words) for _ in range(40))) for i in range(2_000)]
    rows += [(1, 2_000 + i, 0, rows[i][3][:150] + "x") for i in range(200)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    frame = spark.createDataFrame(rows, "nil int, id long, row long, text string").withColumn("text", counted("text"))
    assert suffix_dedup.removed_spans(frame).select("id").distinct().count() == 200
    assert len(rows) < read.value < 2.2 * len(rows)


def test_ranges_keep_the_order_of_anchors_and_contexts():
    rng = np.random.default_rng(3)
    h, c = np.sort(rng.integers(-5, 5, 2_000)), rng.integers(-1000, 1000, 2_000)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    low_h, low_c = np.array([-3, -1, -1, -1, 4]), np.array([np.iinfo(np.int64).min, -200, 0, 300, np.iinfo(np.int64).min])
    want = [sum((x, y) >= b for b in zip(low_h.tolist(), low_c.tolist(), strict=True)) for x, y in zip(h.tolist(), c.tolist(), strict=True)]
    assert suffix_dedup.ranges(h, c, low_h, low_c).tolist() == want


def test_frequent_anchor_over_many_ranges(spark):
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, n)))
    rows = [(i, word(60) + line + word(60)) for i in range(1_200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        docs = suffix_dedup._rows(frame, "doc_id", "text")
        low_h, _ = suffix_dedup._bounds(suffix_dedup._anchor_rows(docs, 100, few=12), 23)
        assert len(set(low_h.tolist())) < len(low_h)  # an anchor begins more than one range
        for most in (2_000, 50):
            assert got(frame, most=most) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
