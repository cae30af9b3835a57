import corpus_pipeline
from test_decontam import brute as brute_hits
from test_jaccard import brute as brute_near

from sparrowsql.llm import quality
from sparrowsql.llm.common import table


def test_run_matches_brute_force(spark, sf):
    """The classifier's decisions are taken from its own query; all else is brute force."""
    docs = table(spark, sf, "documents")
    keep = {r.doc_id for r in quality.classify(docs).where("keep").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in keep]
    last = {t: max(i for i, x in rows if x == t) for _, t in rows}
    rows = [(i, t) for i, t in rows if last[t] == i]
    near = {i: c for i, c, _ in brute_near(rows)}
    rows = [(i, t) for i, t in rows if near[i] == i]
    bench = table(spark, sf, "benchmark").collect()
    bad = {eval(r)[0] for r in brute_hits(rows, bench) if eval(r)[2]}  # every item has a whole window
    assert bad
    want = sorted(i for i, _ in rows if i not in bad)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == want
    assert all(r.n_tokens > 0 for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_benchmark_stage_drops_documents_of_one_item(spark, sf):
    texts = sorted({r.text for r in table(spark, sf, "benchmark").collect()})
    rows = [(1, f"{texts[0]} . {texts[1]}"), (2, f"before {texts[0]} after"), (3, "nothing of them"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, sf).collect()) == [3, 4]


def test_stages_on_nulls_ties_repeats_and_long_texts(spark, sf):
    """Each stage by itself, on rows that the stages before would have dropped."""
    passage = sorted({r.text for r in table(spark, sf, "benchmark").collect()})[0]
    long = "A plain sentence about the weather, written by hand on day {}. " * 3_000
    rows = [
        (1, None, "en", "s", None, "x"),
        (2, "", None, None, 0, "x"),
        (None, "Plain words in a plain sentence, as people write them every day.", "en", "s", 1, None),
        (4, "Plain words in a plain sentence, as people write them every day.", "en", "s", 1, "y"),
        (4, "Plain words in a plain sentence, as people write them every day.", "en", "s", 1, "y"),
        (5, f"Before. {passage} After.", "en", "t", 2, "z"),
        (6, long, "en", "t", 3, "z"),
        (7, long, "en", "t", 3, "z"),
        (8, long + "One more.", "en", "t", 3, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    ids = lambda frame: sorted(str(r.doc_id) for r in frame.collect())
    stages = dict(corpus_pipeline.STAGES)
    got = {name: stages[name](spark, docs, sf) for name in ("quality", "exact", "near", "benchmark")}
    assert all(frame.columns == docs.columns for frame in got.values())
    assert not {"1", "2"} & set(ids(got["quality"])) and set(ids(got["quality"])) <= set(ids(docs))
    assert ids(got["exact"]) == ["2", "4", "5", "7", "8"]
    assert ids(got["near"]) == ["1", "2", "4", "5", "6"]
    assert ids(got["benchmark"]) == ["1", "2", "4", "4", "6", "7", "8", "None"]
    encoded = {str(r.doc_id): r.n_tokens for r in stages["encode"](spark, docs, sf).collect()}
    assert encoded["1"] == encoded["2"] == 0 and encoded["6"] == encoded["7"] > 10_000 and len(encoded) == 8
