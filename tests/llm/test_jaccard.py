import random
import re

import numpy as np

from sparrowsql.llm import jaccard
from sparrowsql.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i])))
    return out


def test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted(map(tuple, jaccard.classes(docs).collect()))
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert sum(n for _, _, n in got) > 0


def test_large_group_of_near_copies(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("MOST_BLOCK", 16), ("WIDE_BLOCK", 32), ("SMALL", 8)):  # many blocks
        monkeypatch.setattr(jaccard, name, size)
    random.seed(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(random.randint(0, 2)):
            text[random.randrange(60)] = f"x{random.randrange(50)}"
        rows.append((i * 3, " ".join(text)))
    rows += [(1000 + i, f"quite different words {i} " * 5) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.classes(frame).collect())) == sorted(brute(rows))


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sorted(map(repr, map(tuple, jaccard.classes(edge_docs).collect())))
    assert got == sorted(map(repr, brute(rows)))
    assert jaccard.classes(no_docs).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    least = jaccard.fewest_matches()
    lost = 0
    for _ in range(3000):
        hits = np.cumsum((rng.random(jaccard.HASHES) < 0.8).reshape(-1, jaccard.STEP).sum(1))
        lost += (hits < np.array(least)).any()
    assert lost == 0


def test_exact_check_agrees_with_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    for t in (0.2, 0.3, 0.8):
        want = [len(np.intersect1d(sets[x], sets[y])) >= t * len(np.union1d(sets[x], sets[y])) - 1e-9 for x, y in zip(a, b, strict=True)]
        assert (jaccard.verified(sets, a, b, t) == want).all()


def test_one_id_on_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, near(base, 3)), (3, near(other, 4)), (3, near(base, 5)), (3, near(base, 5)), (None, near(other, 9)), (7, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, jaccard.classes(frame).collect()))) == sorted(map(repr, brute(rows)))
    kept = sorted(map(repr, map(tuple, jaccard.keep_one(frame).collect())))
    assert kept == sorted(map(repr, [(1, " ".join(base)), (1, " ".join(other)), (7, None), (7, "")]))


def test_templates_do_not_chain(spark):
    """Half of every text is one template: buckets are shared, but no pair stays, so no group comes of it."""
    rng = random.Random(12)
    template = " ".join(f"t{i}" for i in range(100))
    rows = [(i, template + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for i in range(300)]
    rows += [(1_000 + i, rows[i][1] + " tail") for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.classes(frame).collect())) == sorted(brute(rows))
    signed = jaccard._signatures(frame, "doc_id", "text").withColumnRenamed("id", "node").persist()
    buckets = jaccard._buckets(signed)
    assert buckets.agg({"node": "max"}).first()[0] is not None
    assert jaccard._joined(buckets, 0.8).select("node").distinct().count() == 10


def test_recall_against_brute_force(spark):
    """Pairs at every similarity from 0.8 on: none is lost."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        text = [f"a{i}x{j}" for j in range(120)]
        rows.append((2 * i, " ".join(text)))
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(120)] = "b"
        rows.append((2 * i + 1, " ".join(text)))
    got = sorted(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute(rows)) and 200 < sum(n for _, _, n in got) < 800
