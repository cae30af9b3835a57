import numpy as np
from pyspark.sql import functions as F

from sparrowsql.llm import quality
from sparrowsql.llm.common import table


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"  # the labels are never used for fitting
    got = {r.doc_id: r.keep for r in quality.classify(table(spark, sf, "documents")).collect()}
    labels = table(spark, sf, "labels").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def planted(rng, n, bad_rates, good_rates, share=0.8, silent=0.1):
    truth = rng.random(n) < share
    said = rng.random((n, quality.RATIOS)) < np.where(truth[:, None], good_rates, bad_rates)
    return truth, np.where(rng.random(said.shape) < silent, 0, np.where(said, -1, 1))


def test_estimate_tells_accurate_from_careless_labellers():
    """Labellers 0 and 1 find most bad texts, 2 and 3 few; 4 and 5 often call good texts bad: the rates come from the data."""
    bad_rates = np.array([0.9, 0.8, 0.2, 0.1, 0.6, 0.5, 0.4, 0.4])
    good_rates = np.array([0.01, 0.01, 0.01, 0.01, 0.2, 0.1, 0.01, 0.01])
    for share in (0.8, 0.3):
        truth, votes = planted(np.random.default_rng(1), 20_000, bad_rates, good_rates, share)
        patterns, counts = np.unique(quality.pattern(votes), return_counts=True)
        good, rates, prior = quality.expectation_maximisation(patterns, counts.astype(float))
        assert np.abs(rates[0] - bad_rates).max() < 0.05 and np.abs(rates[1] - good_rates).max() < 0.03
        assert abs(prior - share) < 0.03
        told = dict(zip(patterns, good >= 0.5, strict=True))
        assert np.mean([told[p] == t for p, t in zip(quality.pattern(votes), truth, strict=True)]) > 0.95


def test_estimate_is_that_of_a_plain_one_over_documents():
    """Brute force: the same steps document by document instead of by pattern."""
    _, votes = planted(np.random.default_rng(3), 400, np.linspace(0.2, 0.7, quality.RATIOS), np.full(quality.RATIOS, 0.03))
    patterns, counts = np.unique(quality.pattern(votes), return_counts=True)
    good, rates, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    p = [0.05 if -1 in v else 0.95 for v in votes.tolist()]
    for _ in range(300):
        share = (sum(p) + quality.PRIOR * quality.WEIGHT) / (len(p) + quality.WEIGHT)
        want = [[0.0] * quality.RATIOS for _ in range(2)]
        for c in range(2):
            for j in range(quality.RATIOS):
                weight = [x if c else 1 - x for x, v in zip(p, votes, strict=True) if v[j]]
                bad = [x if c else 1 - x for x, v in zip(p, votes, strict=True) if v[j] == -1]
                want[c][j] = (sum(bad) + quality.WEIGHT * quality.BELIEF[c]) / (sum(weight) + quality.WEIGHT)
        fresh = []
        for v in votes:
            like = [1 - share, share]
            for c in range(2):
                for j in range(quality.RATIOS):
                    like[c] *= {-1: want[c][j], 0: 1.0, 1: 1 - want[c][j]}[int(v[j])]
            fresh.append(like[1] / (like[0] + like[1]))
        done = max(abs(a - b) for a, b in zip(p, fresh, strict=True)) < 1e-6
        p = fresh
        if done:
            break
    told = dict(zip(patterns, good, strict=True))
    assert np.abs(np.array([told[k] for k in quality.pattern(votes)]) - p).max() < 1e-9
    assert np.abs(rates - np.array(want)).max() < 1e-9 and abs(prior - share) < 1e-9


def test_patterns_round_trip():
    votes = np.random.default_rng(2).integers(-1, 2, (50, quality.RATIOS)).astype(np.int8)
    assert (quality.unpattern(quality.pattern(votes)) == votes).all()


def test_edges(edge_docs, no_docs):
    got = quality.classify(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert not any(r.keep for r in got if r.doc_id in (3, 4))
    kept = quality.accepted(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert quality.classify(no_docs).count() == 0 and quality.accepted(no_docs).count() == 0


def test_very_long_and_tied_texts(spark):
    long = " ".join(f"Word{i % 977} of the {i % 13}th sentence." for i in range(200_000))  # 4.9 MB
    rows = [(i, "Plain words, in a plain sentence, as people write them.") for i in range(30)] + [(90, long), (91, long), (92, "!" * 3_000_000)]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 33 and len({(got[i].score, got[i].keep) for i in range(30)}) == 1
    assert got[90].score == got[91].score and not got[92].keep


def test_sample_is_the_least_hashes_of_the_whole_table(spark, monkeypatch):
    """20 of 20,000 texts, far below 1 %, one of them on a third of all rows: the same for any deal of the rows."""
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of row "), F.col("id"), F.lit(" and more.")).alias("text"))
    want = docs.orderBy(F.xxhash64("text")).limit(20).collect()
    assert {r.doc_id // 5_000 for r in want} == {0, 1, 2, 3}
    hot = spark.range(20_000, 30_000).select(F.col("id").alias("doc_id"), F.lit(want[0].text).alias("text"))
    data = np.frombuffer("".join(r.text for r in want).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r.text) for r in want])])
    x = quality.features(data, offsets, quality.ratios(data, offsets)[0]).astype(np.float16).astype(np.float32)
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, target: seen.append(x) or np.zeros(x.shape[1], np.float32))
    for frame in (docs, docs.union(hot), docs.union(hot).repartition(13, "doc_id")):
        quality.fit(frame, sample=20)
        assert seen[-1].shape == x.shape and (seen[-1] == x).all()
