"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the token that ends its encoding is unique. An automaton reads the piece and
gives, at each position, the vocabulary entries that are suffixes of the prefix; of these, longest first,
the one is stored that may follow the last token of the shorter prefix: the pair test undoes both tokens'
merges at their common border and fails if a merge across it would have come earlier. Following the stored
tokens back from the end gives the ids that merging in rank order gives, in time linear in the piece.

Defined cases: null text is empty and has no ids; repeated rows are encoded each; very long pieces need
memory for one integer a byte; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import recut, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
#: Texts of these characters alone, on whose classes all Unicode versions in use agree, are split here; others by the vocabulary file's own rule.
SETTLED = regex.compile(r"[\x00-\u0557\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*+")
#: Entries of a worker's caches of pieces and of pairs; a full cache starts anew.
CACHE, PAIRS = 400_000, 200_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Piece of text to its ids as little-endian bytes."""

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.coder.encode_piece(piece.encode("utf-8"))
        if len(piece) <= 32:
            self[piece] = ids
        return ids


class Coder:
    """Encodes and decodes with a byte-level vocabulary file."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import ahocorasick

        path = tokenizer_path(vocabulary)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.path, self.library = path, None
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in model["vocab"].items():
            self.bytes_of[i] = bytes(letters[c] for c in word)
        # a token of one byte is its own two parts; rank -1: it needs no merge
        self.parts, self.rank = [(i, i) for i in range(size)], [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        self.pairs: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        whole = [len(x) == 1 for x in self.bytes_of]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        for rank, (a, b) in enumerate(merges):
            self.merged[vocab[a], vocab[b]] = rank
        for rank, (a, b) in enumerate(merges):
            left, right, whole_id = vocab[a], vocab[b], vocab[a + b]
            if self.rank[whole_id] < 0 and whole[left] and whole[right] and self.borders(left, right, rank):
                self.parts[whole_id], self.rank[whole_id], whole[whole_id] = (left, right), rank, True
        for i, x in enumerate(self.bytes_of):
            if x and whole[i]:  # others no text is ever encoded to
                automaton.add_word(x.decode("latin-1"), (len(x), i))
        automaton.make_automaton()
        self.size, self.lengths = size, [len(x) for x in self.bytes_of]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.automaton = automaton
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode("utf-8")
        self.pieces = Pieces(self)

    def borders(self, left: int, right: int, limit: int) -> bool:
        """Whether two neighbours stay apart while merges of ranks below ``limit`` are made in rank order, leftmost first.

        Their merges are undone from the last one back. Of the parts that met at the border, each was there until
        the merge that took it away; a merge across the border came before if its rank is lower, or equal on the
        right side, as the leftmost of equal merges is made first.
        """
        merged, rank, parts = self.merged, self.rank, self.parts
        until_left = until_right = limit
        while True:
            across = merged.get((left, right))
            if across is not None and across < until_left and across <= until_right:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until_left, left = a, parts[left][1]
            else:
                until_right, right = b, parts[right][0]

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left * self.size + right] = self.borders(left, right, NEVER)
        return known

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of a piece: for each prefix the last token, then back from the end."""
        n, size, pairs, solved = len(piece), self.size, self.pairs, -1
        last = [-1] * (n + 1)
        for stop, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if stop == solved:  # this prefix has its token
                continue
            before = stop + 1 - length
            if before:
                left = last[before]
                if left < 0:
                    continue
                fits = pairs.get(left * size + token)
                if fits is None:
                    fits = self.may_follow(left, token)
                if not fits:
                    continue
            last[stop + 1], solved = token, stop
        ids, lengths = [], self.lengths
        while n:
            token = last[n]
            ids.append(self.packed[token])
            n -= lengths[token]
        ids.reverse()
        return b"".join(ids)

    def split(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return SPLIT.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_split is None or not any(x in text for x in self.special):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        out = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += map(self.pieces.__getitem__, self.split(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(vocabulary: str) -> Coder:
    """One for each worker process and vocabulary."""
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for b in recut(batches):
            ids = [c.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, text of every row of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for b in recut(batches):
            text = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def encoded_and_back(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return digests(decode_documents(encode_documents(docs, vocabulary), vocabulary))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_back(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
