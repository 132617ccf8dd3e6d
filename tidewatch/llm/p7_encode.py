"""Encoding of the whole corpus with a public tokenizer (problem 7).

Method: prefix-sharing trie traversal. A byte-level BPE encodes each word (a match of the tokenizer's pattern) by itself, so
distinct words are encoded once. They are visited in the depth-first order of their trie, which is their sorted order; at
each node, i.e. each prefix, stands the *last token* of the prefix's encoding. It is the only token t that ends the prefix
and may follow the last token of what is before it; so the state of a shared prefix is computed once, and a word's
encoding is read backwards from its last node. The trie's path is all that is held; a word's ids are kept for later batches.

Token t may follow s if no merge across their border comes before the merges that made them: for no pair (x, y) of a part x
that ends s and a part y that starts t is x + y a token that forms while both exist.

Null and empty texts give an empty list; special tokens' strings are ordinary text. The tokenizer's file stays where it is:
its path is a parameter and each executor reads it there.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The word pattern of the byte-level BPE (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept for later batches; beyond that the memory starts anew.
KEPT = 400_000
NO_LIMIT = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level BPE's file: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words by traversal of their trie."""

    def __init__(self, path: str = TOKENIZER, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        rank, halves = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            rank[raw[a] + raw[b]] = r
            halves[raw[a] + raw[b]] = (raw[a], raw[b])
        self.rank, self.halves = rank, halves
        self.longest = max(map(len, self.id_of))
        self.ends: dict[bytes, list[tuple[bytes, int]]] = {}
        self.starts: dict[bytes, list[tuple[bytes, int]]] = {}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.kept = kept

    def _parts(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at one side of the token, down to its byte, each with the rank of the merge that ends it."""
        out, until = [(token, NO_LIMIT)], token
        while until in self.halves:
            r = self.rank[until]
            until = self.halves[until][side]
            out.append((until, r))
        return out

    def may_follow(self, s: bytes, t: bytes) -> bool:
        key = (s, t)
        known = self.follows.get(key)
        if known is None:
            if s not in self.ends:
                self.ends[s] = self._parts(s, 1)
            if t not in self.starts:
                self.starts[t] = self._parts(t, 0)
            rank, known = self.rank, True
            for x, x_ends in self.ends[s]:
                for y, y_ends in self.starts[t]:
                    r = rank.get(x + y)
                    # Of equal merges the left one comes first.
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def learn(self, words: set[str]) -> None:
        """Encode unknown words."""
        new = words - self.known.keys()
        if not new:
            return
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
            new = words
        id_of, follows, longest, known = self.id_of, self.may_follow, self.longest, self.known
        last: list[bytes] = [b""]
        before = b""
        for word, text in sorted((w.encode("utf-8", "replace"), w) for w in new):
            if word in id_of and len(word) < 3:
                known[text] = [id_of[word]]
                continue
            n, top = 0, min(len(word), len(before))
            while n < top and word[n] == before[n]:
                n += 1
            del last[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    t = word[start:end]
                    if t in id_of and (start == 0 or follows(last[start], t)):
                        last.append(t)
                        break
            before = word
            ids, end = [], len(word)
            while end:
                ids.append(id_of[last[end]])
                end -= len(last[end])
            known[text] = ids[::-1]


def worker_encoder(path: str):
    """This worker's encoder and pattern, kept from task to task."""
    import regex

    home = sys.modules.setdefault("_tidewatch_worker", types.ModuleType("_tidewatch_worker"))
    store = home.__dict__.setdefault("encoders", {})
    if path not in store:
        store[path] = (TrieEncoder(path), regex.compile(PATTERN))
    return store[path]


def encoded(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id_col, ids array<int>): one row for each row of ``df``."""
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder, pattern = worker_encoder(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = [pattern.findall(x) if x else [] for x in b.column(1).to_pylist()]
                encoder.learn(set().union(*texts))
                known = encoder.known
                rows = [[i for w in words for i in known[w]] for words in texts]
                off = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=off[1:])
                flat = np.fromiter((i for r in rows for i in r), np.int32, int(off[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id_col, n_tokens): the encodings' lengths, without the ids leaving the worker."""
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.IntegerType())])

    def run(batches):
        encoder, pattern = worker_encoder(path)
        sizes: dict[str, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = [pattern.findall(x) if x else [] for x in b.column(1).to_pylist()]
                encoder.learn(set().union(*texts))
                known = encoder.known
                if len(sizes) > KEPT:
                    sizes = {}
                for words in texts:
                    for w in words:
                        if w not in sizes:
                            sizes[w] = len(known[w])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(map(sizes.__getitem__, words)) for words in texts], pa.int32())], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text")
