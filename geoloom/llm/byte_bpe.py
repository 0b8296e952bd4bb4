"""Byte-level BPE with the tokenizers library over Arrow batches, from a rank file, and its inverse.

A rank file says which byte strings are tokens and in which order they merge. It becomes a byte-level model of the
tokenizers library: bytes are written as printable characters, and every pair of tokens whose concatenation is a
token is a merge, in rank order. Texts are cut before runs of white space (no match of the pattern spans such a
place); each distinct piece of a batch is encoded once.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Kept, blocks, lean, ragged, spread

#: The code points of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Bytes of text, and distinct pieces, that are encoded at a time.
BLOCK, SLICE = 2 << 20, 4096


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in printable else chr(spare))
        spare += b not in printable
    return out


class Codec:
    """The tokenizers model of a rank file, and the byte table that decodes its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        chars = byte_chars()
        name = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = [
            (name[t[:i]], name[t[i:]])
            for t, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.model = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        table = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            table[r] = t
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.kept = Kept()

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids."""
        number: dict[str, int] = {}  # of each distinct piece
        counts, index = [], []
        for t in texts:
            own = PIECES.findall(t)
            counts.append(len(own))
            index.append(np.fromiter((number.setdefault(p, len(number)) for p in own), np.int64, len(own)))
        at, starts, lengths, values = self.kept.look_up(list(number), self._ids, SLICE)
        place = at[np.concatenate(index)] if index else at
        sizes = lengths[place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))], values.astype(np.int32)[spread(starts[place], sizes)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths in bytes of the ids' strings, and all their bytes."""
        lengths = self.lengths[ids]
        return lengths, self.bytes[spread(self.starts[ids], lengths)]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def characters(data: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of these lengths over the bytes: the character that holds each one's first byte and the one after
    its last byte's, counted in each text. A character split between tokens belongs to all of them.

    first: for each token, the position of its text's first byte."""
    lead = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to and with each byte
    ends = np.cumsum(lengths)
    lead = np.concatenate((lead, lead[-1:])) if len(lead) else np.zeros(1, np.int64)
    before = np.where(first > 0, lead[first - 1], 0)
    return lead[ends - lengths] - 1 - before, lead[np.maximum(ends - 1, 0)] - before


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """docs with a column ids (array<int>), and with offsets also byte_start, char_start and char_end of each token.

    A null text is encoded as the empty one: no ids. Other columns pass through unchanged; a column of docs that has
    one of the new names is replaced. An empty table gives an empty one. vocabulary: path of a rank file."""
    new = ["ids", *(["byte_start", "char_start", "char_end"] if offsets else [])]
    docs = docs.drop(*new)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        own = codec(vocabulary)
        for batch in blocks(batches, text_col, BLOCK):
            texts = pc.fill_null(batch.column(at), "")
            ends, ids = own.encode(texts.to_pylist())
            more = [ragged(ids, ends, pa.int32())]
            if offsets:
                lengths, data = own.decode(ids)
                counts = np.diff(ends)
                byte_ends = np.concatenate(([0], np.cumsum(lengths)))
                first = np.repeat(byte_ends[ends[:-1]], counts)
                start, end = characters(data, lengths, first)
                more += [ragged(x.astype(np.int32), ends, pa.int32()) for x in (byte_ends[:-1] - first, start, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *new])

    fields = [*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in new)]
    return docs.mapInArrow(lean(run), T.StructType(fields))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with a binary column: the bytes of ids_col, which need not be whole characters. Null ids decode to the
    empty string. An id outside the table fails. A column of docs named as `to` is replaced."""
    docs = docs.drop(to)
    names = docs.columns
    at = names.index(ids_col)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = pc.fill_null(part.column(at), pa.scalar([], part.column(at).type))
                counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                lengths, data = own.decode(np.asarray(lists.flatten()))
                ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
                out = pa.Array.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], [*names, to])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(to, T.BinaryType())]))


def text_of(decoded: bytes) -> str:
    """Decoded bytes as text: a character of which only a part was decoded becomes U+FFFD."""
    return decoded.decode("utf-8", errors="replace")
