"""BPE encoding and decoding: an exact linear-time backtracking encoder and an offset-table decoder.

Encoder. A sequence of tokens is what byte-pair merging gives exactly when each
pair of neighbours is compatible, that is, when merging the bytes of just the
two gives the two back. So the encoder looks up the longest token at each place
(one Aho-Corasick pass over the word), tries it and then its shorter prefix
tokens, checks the pair with the token before, and steps back when nothing
fits; a place that was left once is never entered again, which keeps the time
linear. Pairs are decided from the merge ranks along the two tokens' inner
edges and kept in a table.

Texts are first cut as the byte-level scheme does: special tokens, then pieces
(a space and a word, digits, marks, white space). Pieces are cut and encoded
once per process and then found in a table, which is bounded.

Decoder. All tokens' bytes lie in one array; an offset table says where each
starts, and numpy gathers whole documents at a time. Bytes that are not UTF-8
become U+FFFD, as the library does.

Null and empty texts have no tokens; a text of any length is encoded whole;
repeated rows give repeated results; further columns of any name pass through
add_tokens(). The vocabulary (about 1.5 MB, a fixed size) is read on the driver
and broadcast, so executors need no such file.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The byte-level scheme's cutting pattern and Unicode's White_Space characters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Below this code point the Unicode versions of this process and the library agree on classes.
SETTLED = 0x530
#: Entries that a process keeps in each of its tables before it starts anew, and their longest key.
TABLE_SIZE, KEY_SIZE = 250_000, 64
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The scheme's printable stand-in for each byte: itself where printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Tokens, merges and pair compatibility of one vocabulary, over bytes as Latin-1 strings."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        alphabet = byte_alphabet()
        raw = lambda token: "".join(chr(alphabet[c]) for c in token)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*model["model"]["vocab"].values(), *self.special.values()])
        self.text: list[str] = [""] * size
        for token, i in model["model"]["vocab"].items():
            if token not in self.special:
                self.text[i] = raw(token)
        ids = {t: i for i, t in enumerate(self.text) if t}
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * size  # the rank at which a token comes to be; -1 for single bytes
        self.parts: list[tuple[int, int] | None] = [None] * size
        for r, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[raw(a)], ids[raw(b)]
            self.rank[a, b] = r
            c = ids[self.text[a] + self.text[b]]
            if self.parts[c] is None:
                self.parts[c], self.made[c] = (a, b), r
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        #: The longest proper prefix of a token that is a token; -1 for none.
        self.shorter = [-1] * size
        for t, i in ids.items():
            self.shorter[i] = next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1)
        self.sizes = [len(t) for t in self.text]
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.edges: dict[int, list[tuple[int, int]]] = {}  # inner edges on the left, by token

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens leaves just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self._fits(left, right)
            if len(self.pairs) >= TABLE_SIZE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and what it is made of along one edge, each with the rank that uses it up."""
        edge, used = [], NEVER
        while True:
            edge.append((token, used))
            if self.parts[token] is None:
                return edge
            used = self.made[token]
            token = self.parts[token][side]

    def _fits(self, left: int, right: int) -> bool:
        inner = self.edges.get(right)
        if inner is None:  # at most one entry for each token
            inner = self.edges[right] = self._edge(right, 0)
        rank = self.rank.get
        for a, a_used in self._edge(left, 1):
            for b, b_used in inner:
                # Of equal ranks the leftmost merge goes first: a's own is further left, b's further right.
                r = rank((a, b))
                if r is not None and r < a_used and r <= b_used:
                    return False
        return True

    def encode(self, word: str) -> list[int]:
        """The merged tokens of a word, given as Latin-1 text of its bytes."""
        n = len(word)
        longest = [-1] * (n + 1)
        for end, (token, size) in self.automaton.iter(word):
            longest[end - size + 1] = token  # a later end is a longer token
        shut, sizes, shorter, pairs = bytearray(n + 1), self.sizes, self.shorter, self.pairs
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not shut[end]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits or fits is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at, token = token, end, longest[end]
            elif out:
                shut[at] = 1
                at -= sizes[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, spec: str):
        self.merges = Merges(spec)
        self.cut = Tokenizer.from_str(spec).pre_tokenizer
        self.alphabet = byte_alphabet()
        self.pattern = regex.compile(PIECES)
        self.chunk = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
        special = self.merges.special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        texts = [t.encode("latin-1") for t in self.merges.text]
        for content, i in special.items():
            texts[i] = content.encode()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def _pieces(self, chunk: str) -> list[str]:
        """The scheme's pieces of a chunk, as Latin-1 text of their bytes."""
        if max(chunk) < chr(SETTLED):
            return [p.encode().decode("latin-1") for p in self.pattern.findall(chunk)]
        return ["".join(chr(self.alphabet[c]) for c in p) for p, _ in self.cut.pre_tokenize_str(chunk)]

    def _word(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            found = np.array(self.merges.encode(piece), "<u4").tobytes()
            if len(piece) <= KEY_SIZE:
                if len(self.words) >= TABLE_SIZE:
                    self.words.clear()
                self.words[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self._word, self._pieces(chunk)))
        if len(chunk) <= KEY_SIZE:
            if len(self.chunks) >= TABLE_SIZE:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = []
        get = self.chunks.get
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                parts.append(np.array([self.merges.special[part]], "<u4").tobytes())
            else:
                parts += [get(c) or self._chunk(c) for c in self.chunk.findall(part)]
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).tobytes().decode("utf-8", errors="replace")

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """All bytes of a sequence of ids, gathered through the offset table."""
        starts = self.starts[ids]
        sizes = self.starts[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _digests(text: str, c: Codec) -> tuple[int, str, str]:
    raw = c.encode(text)
    decoded = c.decode(np.frombuffer(raw, "<u4"))
    return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _spread(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256 and, after decoding again, decoded_sha256."""
    spec = _spread(docs, vocabulary)

    def run(batches):
        c = codec(spec.value)
        for batch in batches:
            made = [_digests(t.as_py() or "", c) for t in batch.column(1)]
            n, ids, texts = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def add_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with a column of token ids (replaced where one of that name is there)."""
    spec = _spread(docs, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(texts):
        c = codec(spec.value)
        return texts.map(lambda t: np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32))

    return docs.withColumn(ids_col, encode(F.col(text_col).cast("string")))


def decode_column(tokens: DataFrame, vocabulary: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """tokens with a column of the text that the ids stand for; null ids give the empty text."""
    spec = _spread(tokens, vocabulary)

    @F.pandas_udf("string")
    def decode(ids):
        c = codec(spec.value)
        return ids.map(lambda x: c.decode(np.asarray(x if x is not None else [], np.uint32)))

    return tokens.withColumn(text_col, decode(ids_col))
