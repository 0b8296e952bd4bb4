"""Exact deduplication through an extendible-hash index on shared files.

1. Each task collapses equal texts of its own rows (byte comparison), so a hot text costs one row a task.
2. A directory over the top bits of a 64-bit key doubles until no bucket holds more than its capacity.
3. An owner task reads the buckets of its key ranges in key order, chains texts that share a key, compares
   their bytes, and writes the index pages; documents then look up their page entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, lean

#: Bytes of distinct texts that a bucket may hold before it splits.
BUCKET_BYTES = 64 << 20
#: Bytes of distinct texts that a task holds while it collapses its rows.
HELD_BYTES = 48 << 20
#: The directory never has more than 2 ** MOST_BITS slots; the driver holds it.
MOST_BITS = 20


@dataclass
class Directory:
    """An extendible-hash directory over key prefixes: slots[prefix of depth bits] is a bucket's number."""

    depth: int
    slots: list[int]

    @classmethod
    def build(cls, weights: dict[int, int], bits: int, capacity: int) -> Directory:
        """weights: bytes below each prefix of `bits` bits. A bucket beyond capacity splits on its next bit; a
        bucket as deep as the directory doubles the directory first."""
        sums = [np.zeros(1 << bits, np.int64)]
        for prefix, weight in weights.items():
            sums[0][prefix] += weight
        while len(sums) <= bits:
            sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
        sums.reverse()  # sums[d][p]: bytes below the prefix p of d bits
        depth, slots, buckets, todo = 0, [0], [(0, 0)], [0]
        while todo:
            bucket = todo.pop()
            local, prefix = buckets[bucket]
            if sums[local][prefix] <= capacity or local == bits:
                continue
            if local == depth:
                slots, depth = [x for x in slots for _ in range(2)], depth + 1
            new = len(buckets)
            buckets[bucket] = (local + 1, prefix * 2)
            buckets.append((local + 1, prefix * 2 + 1))
            span = 1 << (depth - local - 1)
            at = (prefix * 2 + 1) * span
            slots[at : at + span] = [new] * span
            todo += [bucket, new]
        return cls(depth, slots)


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _collapse(hasher):
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            nonlocal made
            texts = list(held)
            for at in range(0, len(texts), 256):
                some = texts[at : at + 256]
                docs = [held[t] for t in some]
                ids = [[d for d in x if d is not None] for x in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(some), pa.int32()),
                        pa.array(range(made, made + len(some)), pa.int64()),
                        pa.array([hasher(t) for t in some], pa.int64()),
                        pa.array([len(t) for t in some], pa.int64()),
                        pa.array(some, pa.binary()),
                        pa.array([len(x) for x in docs], pa.int64()),
                        pa.array([max(x, default=None) for x in ids], pa.int64()),
                        pa.array(docs, pa.list_(pa.int64())),
                    ],
                    ["part", "class", "key", "bytes", "text", "n", "last", "docs"],
                )
                made += len(some)

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if (got := held.get(text)) is None:
                    held[text] = [doc]
                    size += len(text) + 200
                else:
                    got.append(doc)
                    size += 40
            if size >= HELD_BYTES:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    return run


def _own(batches):
    """Rows in key order: chains the texts of a key, compares bytes, and gives each row its entry."""
    key, chain = None, []

    def entries():
        for number, (text, rows) in enumerate(chain):
            ids = [r[3] for r in rows if r[3] is not None]
            keep, size = max(ids, default=None), sum(r[2] for r in rows)
            owner = next((r for r in rows if r[3] == keep), rows[0])
            sha = hashlib.sha256(text).hexdigest()
            for r in rows:
                yield r[0], r[1], key, number, keep, size, r is owner, sha

    done = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for part, number, k, text, n, last in zip(*columns, strict=True):
            if k != key:
                done += entries()
                key, chain = k, []
            entry = next((e for e in chain if e[0] == text), None)
            if entry is None:
                chain.append(entry := (text, []))
            entry[1].append((part, number, n, last))
        if len(done) >= 2000:
            yield _entries(done)
            done = []
    done += entries()
    yield _entries(done)


def _entries(rows):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["part", "class", "key", "chain", "keep_id", "group_size", "owner", "text_sha256"]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hasher=_key
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the
    largest id stays.

    A null text equals the empty one. A null id counts in group_size, and stays only if its group has no other id;
    keep_id is then null. Of rows that repeat id and text exactly one is kept. Other columns are ignored, whatever
    their names. An empty table gives an empty result. hasher: bytes to a signed 64-bit key; texts that share a key
    are chained and told apart by their bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    local = scratch.write(
        rows.mapInArrow(
            lean(_collapse(hasher)),
            "part int, class long, key long, bytes long, text binary, n long, last long, docs array<long>",
        ),
        "classes",
    )
    total = local.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MOST_BITS, max(0, int(total // max(1, bucket_bytes))).bit_length() + 4)
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    prefix = F.shiftrightunsigned(unsigned, 64 - bits)
    weights = local.groupBy(prefix.alias("p")).agg(F.sum(F.col("bytes") + 64).alias("w")).collect()
    directory = Directory.build({r.p: r.w for r in weights}, bits, bucket_bytes)
    slots = scratch.write(
        spark.createDataFrame(list(enumerate(directory.slots)), "slot long, bucket int").coalesce(1), "directory"
    )
    slot = F.shiftrightunsigned(unsigned, 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
    # the directory has 2 ** MOST_BITS slots at most
    placed = local.select("part", "class", "key", "text", "n", "last", slot.alias("slot")).join(F.broadcast(slots), "slot")
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "key", "part", "class")
    index = scratch.write(
        owned.select("part", "class", "key", "text", "n", "last").mapInArrow(
            lean(_own),
            "part int, class long, key long, chain int, keep_id long, group_size long, owner boolean, text_sha256 string",
        ),
        "index",
    )
    found = local.select("part", "class", "docs").join(index, ["part", "class"])
    # the place of the row that stays is settled before the copies are dealt out, each of which then costs the same
    place = F.when(~F.col("owner"), 0).otherwise(F.when(F.col("keep_id").isNull(), 1).otherwise(F.array_position("docs", F.col("keep_id"))))
    each = found.withColumn("place", place).select("keep_id", "group_size", "text_sha256", "place", F.posexplode("docs").alias("at", "doc_id"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("at") + 1).alias("kept"), "text_sha256")
