"""Packing of tokenised documents into sequences, by bound-certified best-fit decreasing.

Each task packs its share of the pieces by best-fit decreasing, and bounds from below what any packing of them needs
with dual-feasible functions. Where both agree, the share's bin count is certified optimal and its bins stay. A share
with a gap keeps its full bins; the documents of its other bins are exchanged with those of the other such shares and
packed again, in fewer and fewer shares.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Kept, Scratch, blocks, lean, raw, spread, words

#: Pieces in a share; rounds of exchange.
SHARE, ROUNDS = 32768, 6
#: Words encoded at a time.
SLICE = 4096
#: What a tokenizers file says that splits words as plain_pieces does.
PLAIN = {
    "truncation": None,
    "padding": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Kinds of bytes, and the lower-case form of each. 0xC3 leads the letters from U+00C0 to U+00FF.
OTHER, LETTER, DIGIT, SIGN = range(4)
KINDS, LOWER = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[ord("'")] = OTHER
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[ord("A") : ord("Z") + 1] = KINDS[ord("a") : ord("z") + 1] = KINDS[0xC3] = LETTER
LOWER[ord("A") : ord("Z") + 1] += 0x20


def splits_plainly(path: str) -> bool:
    """Whether a tokenizers file treats lower-cased words as plain_pieces does, its added tokens aside, which begin with `<|`."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    added = all(t["content"].startswith("<|") for t in own["added_tokens"])
    return added and own["model"].get("dropout") is None and all(own.get(k) == v for k, v in PLAIN.items())


def plain_pieces(distinct: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of words that are not empty (large binary): the number of pieces of each, the pieces lower-cased, and which words are not
    plain. Those have no pieces: words with an apostrophe, with `<|`, or with other characters than printable ASCII and the
    letters from U+00C0 to U+00FF. No two of these characters compose, and each has one lower-case form.

    A piece is a run of letters, a digit, or a run of other characters."""
    offsets, data = raw(distinct)
    first, data = offsets[:-1] - offsets[0], data[offsets[0] : offsets[-1]]
    kind, low = KINDS[data], LOWER[data]
    lead = np.flatnonzero(data == 0xC3)
    tail = np.append(data, np.uint8(0))[lead + 1]
    letter = (tail & 0xC0 == 0x80) & (tail != 0x97) & (tail != 0xB7)  # but the signs of multiplication and division
    kind[lead[~letter]] = OTHER
    lead, tail = lead[letter], tail[letter]
    kind[lead + 1], low[lead + 1] = LETTER, np.where(tail < 0x9F, tail + 0x20, tail)
    odd = kind == OTHER
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    odd = np.logical_or.reduceat(odd, first) if len(first) else np.zeros(0, bool)
    begins = kind == DIGIT
    begins[1:] |= kind[1:] != kind[:-1]
    begins[first] = True
    counts = np.add.reduceat(begins, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    ends = np.append(np.flatnonzero(begins), len(data))
    pieces = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low)])
    if odd.any():
        pieces = pieces.filter(pa.array(np.repeat(~odd, counts)))
    return np.where(odd, 0, counts), pieces, odd


class Encoder:
    """A tokenizers model whose matches never span white space, applied to each distinct piece of words once where it splits
    words plainly, else to each distinct word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.kept, self.plain = Tokenizer.from_file(path), Kept(), None
        if splits_plainly(path):
            self.plain = Tokenizer(self.model.model)
            self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)

    def _look_up(self, model, said: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def ids(said: list[str]) -> list[list[int]]:
            return [e.ids for e in model.encode_batch_fast(said, add_special_tokens=False)]

        said = said.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        at, starts, lengths, flat = self.kept.look_up(said, ids, SLICE)
        return starts[at], lengths[at], flat

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The start and number of each word's ids in the last array."""
        if self.plain is None:
            return self._look_up(self.model, distinct)
        counts, pieces, odd = plain_pieces(distinct)
        coded = pieces.dictionary_encode()
        index = np.asarray(coded.indices)
        starts, lengths, flat = self._look_up(self.plain, coded.dictionary)
        sizes = lengths[index]
        own = flat[spread(starts[index], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        starts, lengths = ends[:-1], np.diff(ends)
        if odd.any():
            starts[odd], lengths[odd], flat = self._look_up(self.model, distinct.filter(pa.array(odd)))
            starts[odd] += len(own)
            own = np.concatenate((own, flat))
        return starts, lengths, own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids."""
        ends, index, distinct = words(texts)
        starts, lengths, flat = self._words(distinct)
        sizes = lengths[index]
        return np.concatenate(([0], np.cumsum(sizes)))[ends], flat[spread(starts[index], sizes)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """The token pieces of docs: item (unique), doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its text's ids, then the id `end`; a null text is empty. Only documents longer than capacity are cut,
    into pieces of capacity; the last may be shorter. vocabulary: a tokenizers file whose tokens never span white space.
    item numbers the pieces of a task: write the result before using it twice."""

    def run(batches):
        own, made = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in blocks(batches, most=4 << 20):
            ends, ids = own.encode(batch.column("text"))
            n = len(ends) - 1
            whole = np.insert(ids, ends[1:], np.uint32(end)).astype("<u4")
            begins = ends + np.arange(n + 1)
            sizes = np.diff(begins)
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(n), count)
            piece = spread(np.zeros(n, np.int64), count)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            edges = np.concatenate(([0], np.cumsum(length))) * 4
            for k in range(0, len(doc), 1000):
                part = slice(k, min(len(doc), k + 1000))
                m = part.stop - part.start
                data = pa.py_buffer(whole[edges[part.start] // 4 : edges[part.stop] // 4])
                offsets = (edges[part.start : part.stop + 1] - edges[part.start]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(made + np.arange(m)), batch.column("doc_id").take(pa.array(doc[part])), pa.array(piece[part].astype(np.int32)),
                        pa.array(start[part]), pa.array(length[part]), pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), data]),
                    ],
                    ["item", "doc_id", "piece", "start", "length", "ids"],
                )
                made += m

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "item long, doc_id long, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions that round items above capacity - t up to
    it, and those below t down to 0, for each t, and of those composed with rounding to multiples of capacity / k."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    volume, number = np.cumsum(counts * x), np.cumsum(counts)
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for k in range(1, 21):
        # the items' sizes in units of capacity / k, exactly: k * f(x) / capacity
        units = np.where((k + 1) * x % capacity == 0, x * k / capacity, (k + 1) * x // capacity)
        value = np.cumsum(counts * units)
        middle = value[capacity - t] - np.where(t > 0, value[np.maximum(t - 1, 0)], 0)
        best = max(best, int(np.ceil((large + middle / k).max() - 1e-6)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and place in it, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, places, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_ = [[] for _ in range(capacity + 1)]  # bins by the room left
    bits = 0  # which rooms there are
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = bits >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                bits &= ~(1 << left)
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bins[i], places[i] = b, capacity - left
        left -= size
        room[b] = left
        open_[left].append(b)
        bits |= 1 << left
    return bins, places, np.array(room, np.int64)


def _packed(capacity, number, last):
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        lengths = np.asarray(table["length"].combine_chunks())
        bins, places, room = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        certified = len(room) <= bound
        stays = np.full(len(room), True) if certified or last else room == 0
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays(
            [
                table["item"].combine_chunks(), pa.array(lengths), pa.array(base + bins), pa.array(places), pa.array(stays[bins]),
                pa.array(np.full(len(lengths), certified)),
            ],
            ["item", "length", "sequence_id", "offset", "stays", "certified"],
        )

    return run


def pack(items: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """items (item, length), lengths from 1 to capacity, with sequence_id, offset and certified: whether the share
    that it was packed in provably uses as few bins as it can.

    Items are dealt into shares by a hash of their number, so equal lengths or sources do not matter. A share's rows
    go through one task: SHARE of them, about. Ties in length go by row order in the share."""
    full = items.where(F.col("length") == capacity).select(
        "item", (F.col("item") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    live = items.where(F.col("length") < capacity).select("item", "length")
    out, number, shares = full, 0, None
    while (n := live.count()) and number < ROUNDS:
        shares = max(1, -(-n // SHARE)) if shares is None else max(1, min(-(-n // SHARE), shares // 2))
        last = number == ROUNDS - 1 or shares == 1
        dealt = live.repartition(shares, F.xxhash64("item", F.lit(number)))
        rows = scratch.write(
            dealt.mapInArrow(
                lean(_packed(capacity, number, last)),
                "item long, length long, sequence_id long, offset long, stays boolean, certified boolean",
            ),
            f"round{number}",
        )
        out = out.union(rows.where("stays").select("item", "sequence_id", "offset", "certified"))
        live, number = rows.where("not stays").select("item", "length"), number + 1
    return out


def pack_pieces(own: DataFrame, capacity: int = 2048) -> DataFrame:
    """own (item, length and any other columns) with sequence_id, offset and certified; columns of own with these names are
    replaced. own must give the same rows each time it is read. An empty table gives an empty one."""
    scratch = Scratch(own.sparkSession, "packing")
    own = own.drop("sequence_id", "offset", "certified")
    return own.join(pack(own.select("item", "length"), capacity, scratch), "item")
