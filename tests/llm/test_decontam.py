import hashlib
import random
import re

from sparrowsql.llm import decontam
from sparrowsql.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    items |= found
                    hit.update(range(i, i + n))
        said = ",".join(sorted(items))
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(said.encode()).hexdigest(), len(items) >= 2))
    return sorted(map(repr, out))


def test_matches_brute_force_on_the_tables(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = sorted(map(repr, map(tuple, decontam.annotate(docs, bench).collect())))
    want = brute(docs.select("doc_id", "text").collect(), bench.collect())
    assert got == want
    assert any(eval(r)[3] for r in got)


def test_edges(spark, edge_docs):
    bench = spark.createDataFrame(
        [(10, "SAME Text"), (2, "same text!"), (None, "ipsum"), (4, None), (5, "--"), (6, "É 日本 x a b c d e f g"), (7, "ipsum dolor sit amet lorem ipsum dolor sit amet")],
        "item_id long, text string",
    )
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = [repr(tuple(r)) for r in decontam.annotate(edge_docs, bench).collect()]
    want = brute(rows, [(i if i is not None else None, t) for i, t in bench.collect() if i is not None])
    # A null item has no name to list, but its words are hits: the first word of rows 5 and 6 stands in no window.
    named = spark.createDataFrame([r for r in bench.collect() if r.item_id is not None], bench.schema)
    assert sorted(repr(tuple(r)) for r in decontam.annotate(edge_docs, named).collect()) == want
    hit = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.annotate(edge_docs, bench).collect()}
    assert hit[5] == hit[6] == (19_999, 1) and len(got) == len(want)


def test_empty_tables(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_items == 0 and not r.contaminated for r in decontam.annotate(edge_docs, bench).collect())
    assert decontam.clean(edge_docs, bench).count() == edge_docs.count()
    assert decontam.annotate(no_docs, bench).count() == 0


def test_clean_drops_documents_with_a_window(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    texts = sorted({r.text for r in bench.collect()})
    planted = [(-1, f"before {texts[0]} after"), (-2, f"{texts[1]} . {texts[2]}"), (-3, " ".join(texts[3].split()[:7])), (-4, "nothing of them")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    bad = {r.doc_id for r in decontam.annotate(docs, bench).where("n_hit > 0").collect()}
    assert {-1, -2} <= bad and not {-3, -4} & bad and any(i >= 0 for i in bad)
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_clean_needs_two_short_items(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "blue whale"), (3, "one two three four five six seven eight nine")], "item_id long, text string")
    rows = [(1, "yes"), (2, "a blue whale, yes"), (3, "zero one two three four five six seven eight"), (4, "one two three"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [1, 4, 5]


def test_native(spark, sf):
    plan = decontam.annotate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_capital_sigma_beside_marks(spark):
    """lower() of a running text makes it a final or an inner sigma by what stands beside its word."""
    rows = [(1, "x Α.Σ. foo y"), (2, "to ΟΔΟΣ'Χ go"), (3, "ΑΣ:Β c"), (4, "x α.σ. foo")]
    items = [(10, "Α Σ foo"), (20, "ΟΔΟΣ Χ"), (30, "ΑΣ Β C")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.annotate(docs, bench).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows, items)
    assert [r.n_items for r in sorted(got)] == [1, 1, 1, 0]


def test_windows_of_cased_words_beyond_ascii(spark):
    """Random texts of letters whose lower case depends on their neighbours or changes in length."""
    rng = random.Random(13)
    parts = ["ΟΔΟΣ", "οδος", "Σ", "ς", "İI", "K", "ß", "ẞ", "Ab", "aB", "b", "c'x", "é", "Éa", "日本", "Ⅷ", "ǅ"]
    joins = [" ", "'", ".", ":", "-", "­", "  "]
    text = lambda n: "".join(rng.choice(parts) + rng.choice(joins) for _ in range(n))
    items = [(i, text(rng.randint(1, 12))) for i in range(60)]
    rows = [(i, text(rng.randint(0, 10)) + "".join(rng.choice(items)[1] for _ in range(rng.randint(0, 2))) + text(3)) for i in range(300)]
    rows.append((900, "ΟΔΟΣ'x b c d e f g"))
    items += [(907, "ΟΔΟΣ x b c d e f g"), (908, "ΟΔΟΣ'x b c d e f g")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.annotate(docs, bench).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows, items)
    assert next(r for r in got if r.doc_id == 900)[2:4] == (8, 2)
