import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sparrowsql.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_groups_match_brute_force(edge_docs):
    got = exact_dedup.groups(edge_docs).collect()
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(repr, want))
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({w[3] for w in want})


def test_dedup_keeps_one_row_and_all_columns(edge_docs):
    kept = exact_dedup.dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [2, 4, 6, 7]


def test_smallest_id(edge_docs):
    assert sorted(r.doc_id for r in exact_dedup.dedup(edge_docs, keep="min").collect()) == [1, 3, 5, 7]


def test_empty(no_docs):
    assert exact_dedup.groups(no_docs).count() == 0
    assert exact_dedup.dedup(no_docs).count() == 0


def test_null_is_the_empty_text_and_one_row_stays(spark):
    rows = [(1, None, "b"), (1, "", "a"), (2, "x", "p"), (2, "x", "q"), (2, "x", "q"), (None, "y", None), (None, "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    assert sorted(map(repr, map(tuple, exact_dedup.dedup(docs).collect()))) == ["(1, None, 'b')", "(2, 'x', 'q')", "(None, 'y', 'z')"]
    assert sorted(map(repr, map(tuple, exact_dedup.dedup(docs, keep="min").collect()))) == ["(1, '', 'a')", "(2, 'x', 'p')", "(None, 'y', None)"]


def test_texts_that_collide_stay_apart(spark, monkeypatch, edge_docs):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 32, "0")))
    docs = edge_docs.union(spark.createDataFrame([(20, "samE text", "s", None, None), (21, "xyz", "s", None, None)], edge_docs.schema))
    test_groups_match_brute_force(docs)
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs).collect()) == [2, 4, 6, 7, 20, 21]


def test_names_of_working_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, {"k": 1}), (2, "a", 7, 8, None)], "id long, t string, h int, r int, `o.d` map<string,int>")
    assert [tuple(r) for r in exact_dedup.dedup(docs, "id", "t").collect()] == [(2, "a", 7, 8, None)]
    assert sorted(r.keep_id for r in exact_dedup.groups(docs, "id", "t").collect()) == [2, 2]
