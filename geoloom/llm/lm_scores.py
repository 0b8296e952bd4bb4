"""Stupid-backoff scores, computed relationally over the whole corpus.

The n-grams of all orders are counted into tables partitioned by their hash, and joined with the n-grams of the texts:

1. `blocks`: texts become rows of word hashes, some 4 MB of text a row, written once and read by the steps below.
2. Each block asks for its distinct n-grams, with the number of times it has them: one row for each share of the hash
   range, so a hot n-gram is one entry a block, however often it occurs.
3. The owner of a share adds up the counts of equal n-grams (those rows are the share's count table), and answers every
   block that asked. No n-gram is pruned, and no table is broadcast.
4. A block joins its answers, which give each word's score, and the scores are summed by document.

N-grams are told apart by hashes of 56 bits, or of 64 where a corpus has over WIDE words: of n distinct ones, n ** 2 / 2 **
57 (or 65) pairs share a hash, and only their own counts are off then. That is 0.2 pairs of the 1.5e8 n-grams of 0.9 GB of
text, and one n-gram in ten million at worst, just below WIDE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, blocks, lean
from .shingles import STEP, mixed, word_hashes

#: Words of the longest n-grams, and what each step to a shorter one costs.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a block, and n-grams asked for in a share, about.
BLOCK, SHARE = 8 << 20, 1 << 21
#: Words of a corpus from which hashes have 64 bits.
WIDE = 1 << 33
_ZSTD = pa.Codec("zstd", compression_level=1)


@dataclass
class Model:
    """Count tables: table (share, hashes, counts), shares cut by the hashes' top `bits`, and the words counted."""

    table: DataFrame
    bits: int
    total: int
    order: int
    width: int


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers, plane by plane of their bytes, as many as the largest needs, compressed where that helps."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    if len(planes) > 64 and len(small := _ZSTD.compress(planes, asbytes=True)) < len(planes):
        return bytes([width + 8]) + len(planes).to_bytes(8, "little") + small
    return bytes([width]) + planes


def unpacked(data: bytes) -> np.ndarray:
    width, planes = data[0], data[1:]
    if width > 8:
        width, planes = width - 8, _ZSTD.decompress(data[9:], int.from_bytes(data[1:9], "little"))
    planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _ascending(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    out = np.concatenate((np.frombuffer(data, "<u8", 1), unpacked(data[8:])))
    return np.cumsum(out, out=out)


def _deltas(hashes: np.ndarray) -> bytes:
    return hashes[:1].astype("<u8").tobytes() + packed(np.diff(hashes)) if len(hashes) else b""


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, where in their order each begins, and which of them each value is."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    begins = np.flatnonzero(new)
    return own[begins], begins, place


def _blocks(batches):
    made = TaskContext.get().partitionId() << 32
    for batch in blocks(batches, most=BLOCK):
        ends, hashes = word_hashes(batch.column("text"), lower=False)
        kinds, _, codes = distinct(hashes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([made]), pa.array([len(hashes)]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                *(pa.array([x], pa.binary()) for x in (packed(np.diff(ends)), packed(codes), _deltas(kinds))),
            ],
            ["block", "n", "docs", "sizes", "codes", "kinds"],
        )
        made += 1


def _read(batch, i) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts' words in the i-th block of the batch, and the words' hashes."""
    sizes, codes, kinds = (batch.column(c)[i].as_py() for c in ("sizes", "codes", "kinds"))
    ends = np.concatenate(([0], np.cumsum(unpacked(sizes).astype(np.int64))))
    return ends, _ascending(kinds)[unpacked(codes).astype(np.int64)] if ends[-1] else np.zeros(0, np.uint64)


def _grams(ends: np.ndarray, hashes: np.ndarray, order: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that start at each word, a row for each order, and which of them their text has."""
    n = len(hashes)
    out, there = np.zeros((order, n), np.uint64), np.zeros((order, n), bool)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    run = hashes.copy()
    for k in range(order):
        if k:
            run = run[: max(0, n - k)] * STEP + hashes[k:]
        out[k, : len(run)] = mixed(run + np.uint64(k * 0x51_7C_C1_B7_27_22_0A_95 % (1 << 64)))
        there[k] = left > k
    out >>= np.uint64(64 - width)
    return out, there


def _asks(order, bits, width):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                grams, there = _grams(*_read(batch, i), order, width)
                if not there.size:
                    continue
                grams = np.sort(grams[there])
                begins = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                hashes, counts = grams[begins], np.diff(np.append(begins, len(grams)))
                share = (hashes >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(share)) + 1, [len(share)]))
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                for k in range(0, len(parts), 256):
                    some = parts[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(share[[a for a, _ in some]]), pa.array([batch.column("block")[i].as_py()] * len(some), pa.int64()),
                            pa.array([_deltas(hashes[a:b]) for a, b in some], pa.binary()),
                            pa.array([packed(counts[a:b]) for a, b in some], pa.binary()),
                        ],
                        ["share", "block", "hashes", "counts"],
                    )

    return run


def _shares(work):
    """Applies work to the rows (block, hashes, counts) of each share, which come one after the other."""

    def run(batches):
        held, own = [], None
        for batch in batches:
            for share, *row in zip(*(batch.column(c).to_pylist() for c in ("share", "block", "hashes", "counts")), strict=True):
                if held and share != own:
                    yield from work(own, held)
                    held = []
                own = share
                held.append((row[0], _ascending(row[1]), unpacked(row[2])))
        if held:
            yield from work(own, held)

    return run


def _summed(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of a share's rows, the count of each, and which of them each row's n-grams are."""
    own = np.concatenate([c for *_, c in rows]).astype(np.int64)
    kinds, begins, place = distinct(np.concatenate([h for _, h, _ in rows]))
    return kinds, np.bincount(place, own, len(begins)).astype(np.int64), place


def _answers(share, blocks_, found, sizes):
    ends = np.cumsum([0, *sizes])
    for k in range(0, len(blocks_), 256):
        some = range(k, min(len(blocks_), k + 256))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([blocks_[i] for i in some], pa.int64()), pa.array([share] * len(some), pa.int64()),
                pa.array([packed(found[ends[i] : ends[i + 1]]) for i in some], pa.binary()),
            ],
            ["block", "share", "totals"],
        )


def _own(share, rows):
    """The owner's answers where the blocks that ask are the corpus itself."""
    _, sums, place = _summed(rows)
    yield from _answers(share, [b for b, *_ in rows], sums[place], [len(h) for _, h, _ in rows])


def _tables(share, rows):
    """The owner's count table."""
    hashes, sums, _ = _summed(rows)
    arrays = [pa.array([share]), pa.array([None], pa.int64()), pa.array([_deltas(hashes)], pa.binary()), pa.array([packed(sums)], pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, ["share", "block", "hashes", "counts"])


def _looked_up(share, rows):
    """The owner's answers from the count table, whose row (without a block) comes first; 0 for what it lacks."""
    table = rows.pop(0)[1:] if rows[0][0] is None else (np.zeros(1, np.uint64), np.zeros(1, np.uint64))
    for block, hashes, _ in rows:
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        yield from _answers(share, [block], np.where(table[0][at] == hashes, table[1][at], 0), [len(hashes)])


def _scored(order, backoff, total, width):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ends, hashes = _read(batch, i)
                grams, there = _grams(ends, hashes, order, width)
                counts = np.zeros(grams.shape)
                if there.any():
                    kinds, _, place = distinct(grams[there])
                    told = [unpacked(x["totals"]) for x in sorted(batch.column("answers")[i].as_py(), key=lambda x: x["share"])]
                    counts[there] = np.concatenate(told)[place]
                    assert sum(map(len, told)) == len(kinds)
                value = words_scores(counts, ends, backoff, total)
                n = np.diff(ends)
                text = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("docs")[i].values, pa.array(n), pa.array(np.bincount(text, value, len(n)))],
                    ["doc_id", "n_tokens", "log_score"],
                )

    return run


def words_scores(counts: np.ndarray, ends: np.ndarray, backoff: float, total: int) -> np.ndarray:
    """The ln score of each word, given the count of the n-gram of each order that starts there (0: not in the model,
    or not in the text). A word with too few words before it backs off; a word that the model lacks counts as one."""
    order, n = counts.shape
    at = np.arange(n) - np.repeat(ends[:-1], np.diff(ends))
    value = np.log(np.maximum(counts[0], 1)) - math.log(max(total, 1)) + (order - 1) * math.log(backoff)
    for k in range(1, order):
        start = np.maximum(np.arange(n) - k, 0)
        seen = (at >= k) & (counts[k, start] > 0)
        place = start[seen]
        value[seen] = np.log(counts[k, place]) - np.log(counts[k - 1, place]) + (order - 1 - k) * math.log(backoff)
    return value


def _written(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(lean(_blocks), "block long, n long, docs array<long>, sizes binary, codes binary, kinds binary")
    made = scratch.write(made, "blocks")
    return made, made.agg(F.sum("n")).first()[0] or 0


def _owned(rows: DataFrame, work, schema: str) -> DataFrame:
    """rows (share, block, hashes, counts) dealt to the shares' owners."""
    return rows.repartition("share").sortWithinPartitions("share", F.col("block").asc_nulls_first()).mapInArrow(lean(_shares(work)), schema)


_ROWS, _TOLD = "share long, block long, hashes binary, counts binary", "block long, share long, totals binary"


def _cut(total: int, order: int) -> tuple[int, int]:
    """Bits of a hash that number its share, and those of a hash."""
    return max(0, math.ceil(math.log2(max(1, total * order / SHARE)))), 56 if total < WIDE else 64


def fit(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The count tables of all n-grams of up to `order` words in docs. Null and blank texts have none; n-grams never
    cross rows. The tables are written below the shared folder."""
    scratch = Scratch(docs.sparkSession, "model")
    made, total = _written(docs, scratch, id_col, text_col)
    bits, width = _cut(total, order)
    asked = made.mapInArrow(lean(_asks(order, bits, width)), _ROWS)
    return Model(scratch.write(_owned(asked, _tables, _ROWS), "table"), bits, total, order, width)


def stupid_backoff(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, model: Model | None = None
) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of ln scores) of every document, under the model of all of docs, or another one.

    Words are `[^\\x20\\x09-\\x0D]+`. A word's score after the order - 1 words before it is the count of them all
    together divided by the count of those before it; where the model lacks that n-gram, or the text has fewer words
    before, it is backoff times the score after one word less, and at last the word's share of all words. A word that
    the model lacks counts as one that occurs once.

    A null or blank text has 0 of both. Texts of any length are taken whole. Rows that repeat an id, or have none, are
    one document whose scores add up; n-grams never cross rows. Other columns are ignored, whatever their names. An
    empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "backoff")
    made, total = _written(docs, scratch, id_col, text_col)
    if model:
        order, total, bits, width = model.order, model.total, model.bits, model.width
        asked = made.mapInArrow(lean(_asks(order, bits, width)), _ROWS).unionByName(model.table)
        told = scratch.write(_owned(asked, _looked_up, _TOLD), "answers")
        del asked
    else:
        bits, width = _cut(total, order)
        told = scratch.write(_owned(made.mapInArrow(lean(_asks(order, bits, width)), _ROWS), _own, _TOLD), "answers")
    answers = told.groupBy("block").agg(F.collect_list(F.struct("share", "totals")).alias("answers"))
    each = made.join(answers, "block", "left").mapInArrow(
        lean(_scored(order, backoff, total, width)), "doc_id long, n_tokens long, log_score double"
    )
    return each.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("log_score").alias("log_score"))
