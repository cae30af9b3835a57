import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowsql.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(CODEC.encode(text), "<u4")
    assert got.tolist() == want
    assert CODEC.decode(got) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abthe  '\n<|>")), max_size=60))
def test_any_text(text):
    same(text)


def test_awkward_texts():
    random.seed(5)
    bits = ["a", "aaaa", "the", " ", "  ", "\n", "é", "1", ".", "'s", "<|endoftext|>", "日", "\x1c", "\x85", "\U0001f600"]
    for _ in range(2000):
        same("".join(random.choice(bits) for _ in range(random.randint(0, 30))))
    same("a" * 20000)
    same(" " * 5000)


def test_any_ids_decode_as_the_library_does():
    random.seed(6)
    for _ in range(500):
        ids = [random.randrange(50257) for _ in range(random.randint(0, 20))]
        assert CODEC.decode(np.array(ids, np.uint32)) == LIB.decode(ids, skip_special_tokens=False)


def test_digests(edge_docs, no_docs):
    got = bpe.encode_digests(edge_docs, PATH).collect()
    want = []
    for r in edge_docs.collect():
        ids = LIB.encode(r.text or "", add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.encode_digests(no_docs, PATH).count() == 0


def test_columns_round_trip(edge_docs):
    tokens = bpe.add_tokens(edge_docs, PATH)
    assert tokens.columns == [*edge_docs.columns, "token_ids"]
    assert all(r.decoded == (r.text or "") for r in bpe.decode_column(tokens, PATH).collect())
