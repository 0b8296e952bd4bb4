"""Word-piece token counts with a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes: pieces that begin a word hang from one root, pieces that continue a
word from another. Each node has a failure link (where matching goes on after the longest pieces of its string are
popped) and the number of pieces popped on the way. A word costs one walk; no piece is ever built.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .byte_bpe import byte_chars
from .common import blocks, lean, raw, spread, words

#: Words beyond these bytes are walked one by one.
LONG = 64


class Automaton:
    """begin, go_on: the byte strings that may begin and continue a word."""

    def __init__(self, begin: set[bytes], go_on: set[bytes]):
        edges: dict[int, int] = {}  # node * 256 + byte -> node; 0 begins words, 1 continues them
        final, parent, byte = {}, [0, 0], [0, 0]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in sorted(pieces - {b""}):
                node = root
                for b in piece:
                    if (to := edges.get(node * 256 + b)) is None:
                        to = edges[node * 256 + b] = len(parent)
                        parent.append(node)
                        byte.append(b)
                    node = to
                final[node] = True
        n = len(parent)
        fail, pops, depth = [-1] * n, [0] * n, [0] * n
        for v in range(2, n):  # a parent's number is smaller, but a link may lead to any shorter string
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if v in final:
                fail[v], pops[v] = 1, 1
                continue
            z, popped = fail[parent[v]], pops[parent[v]]
            while z >= 0 and (to := edges.get(z * 256 + byte[v])) is None:
                popped += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = to, popped
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.edges = edges
        order = np.array(sorted(edges), np.int64)
        self.keys, self.to = order, np.array([edges[k] for k in order.tolist()], np.int64)

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; 1 if it has none."""
        node, n = 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for b in word:
            while (to := edges.get(node * 256 + b)) is None:
                n += int(pops[node])
                node = int(fail[node])
                if node < 0:
                    return 1
            node = to
        while node > 1:
            n += int(pops[node])
            node = int(fail[node])
        return n if node == 1 else 1 if word else 0

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """count() of many words at once: all of them take a step together."""
        lengths = np.diff(offsets)
        out = np.zeros(len(lengths), np.int64)
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self.count(data[offsets[i] : offsets[i + 1]].tobytes())
        order = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        order = order[np.argsort(-lengths[order], kind="stable")]
        sizes, begins = lengths[order], offsets[:-1][order]
        node, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, "left"))  # words longer than step come first
            todo = np.flatnonzero(node[:live] >= 0)
            letters = data[begins[todo] + step].astype(np.int64)
            while len(todo):
                key = node[todo] * 256 + letters
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key if len(self.keys) else np.zeros(len(todo), bool)
                node[todo[hit]] = self.to[at[hit]]
                todo, letters = todo[~hit], letters[~hit]
                n[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
                stays = node[todo] >= 0
                todo, letters = todo[stays], letters[stays]
        while (open_ := node > 1).any():
            n[open_] += self.pops[node[open_]]
            node[open_] = self.fail[node[open_]]
        out[order] = np.where(node == 1, n, 1)
        return out


def pieces_of(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word pieces from a byte-level BPE vocabulary: tokens with a leading space begin a word, the others continue
    one, and each single byte may do both, so every word has pieces."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    of = {c: b for b, c in enumerate(byte_chars())}
    space = byte_chars()[32]
    single = {bytes([b]) for b in range(256)}
    plain = [t for t in vocabulary if all(c in of for c in t)]
    to_bytes = lambda t: bytes(of[c] for c in t)
    return (
        {to_bytes(t[1:]) for t in plain if t[0] == space and len(t) > 1} | single,
        {to_bytes(t) for t in plain if t[0] != space} | single,
    )


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(*pieces_of(path))


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with n_words and n_tokens (long): words are `[^\\x20\\x09-\\x0D]+`, tokens their word pieces.

    A null or blank text has 0 of both. Whole texts are counted, of any length. Other columns pass through; columns of
    docs with the new names are replaced. An empty table gives an empty one."""
    docs = docs.drop("n_words", "n_tokens")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        own = automaton(vocabulary)
        for batch in blocks(batches, text_col):
            ends, index, distinct = words(batch.column(at))
            each = own.counts(*raw(distinct))[index] if len(index) else np.zeros(0, np.int64)
            sums = np.concatenate(([0], np.cumsum(each)))[ends]
            more = [pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(sums), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "n_words", "n_tokens"])

    more = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens")]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *more]))
