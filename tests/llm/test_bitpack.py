import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowsql.llm import bitpack
from sparrowsql.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 3000), max_size=8), st.randoms(use_true_random=False))
def test_files_round_trip(bits, sizes, rng):
    docs = [np.array([rng.randrange(1 << bits) for _ in range(n)], np.uint32) for n in sizes]
    shard = bitpack.Shard(bitpack.pack([None, *range(len(docs))][: len(docs)], docs, bits))
    assert shard.doc_ids == [None, *range(len(docs))][: len(docs)]
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
    assert all((x[2] == d).all() for x, d in zip(shard.documents(), docs, strict=True))


def test_width_and_limits():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack([1], [np.array([8], np.uint32)], 3)
    image = bitpack.pack([1], [np.arange(8000, dtype=np.uint32)], 13)
    assert len(image) < 8000 * 13 // 8 + 200


def brute(rows):
    lib = Tokenizer.from_file(PATH)
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf):
    docs = table(spark, sf, "documents")
    got = bitpack.round_trip(docs, PATH, 1)
    assert sorted(map(tuple, got.collect())) == brute(docs.select("doc_id", "text").collect())


def test_edges(edge_docs, no_docs):
    got = bitpack.round_trip(edge_docs, PATH, 1).collect()
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bitpack.round_trip(no_docs, PATH, 1).count() == 0


def test_every_character_below_combining_marks_is_cut_as_the_library_does(spark):
    """Control characters have stand-ins; two letters lower to characters beyond the fast path's own."""
    rows = [(c, f"a{chr(c)}b {chr(c)}{chr(c)} x") for c in range(0x300) if chr(c) != "\x00"]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, bitpack.round_trip(frame, PATH, 1).collect())) == brute(rows)


def test_long_documents_and_random_access_in_storage(spark, tmp_path):
    """Documents longer than a shard, repeated and null ids; one document is found without reading the other shards."""
    rows = [(i, f"word{i % 7} and {i} " * (1 + i % 50)) for i in range(0, 600, 2)] + [(301, "long text " * 3_000), (None, "no id"), (None, ""), (40, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/packed"
    bitpack.write(frame, PATH, path, 1, shard_ids=2_048)
    got = sorted(map(tuple, bitpack.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert sorted(repr((r[0], *r[2:])) for r in got) == sorted(repr((r[0], *r[2:])) for r in brute(rows))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    files = spark.read.parquet(path)
    assert files.count() > 20 and max(r.n_tokens for r in files.collect()) > 2_048
    assert files.where("low <= 301 AND high >= 301").count() <= 2
    lib = Tokenizer.from_file(PATH)
    found = {r.doc_id: r.tokens for r in bitpack.read_documents(spark, path, [301, 44, 7]).collect()}
    assert found == {i: [*lib.encode(dict(rows)[i], add_special_tokens=False).ids, 1] for i in (301, 44)}
    assert len(bitpack.read_documents(spark, path, [40]).collect()) == 2
