"""What the operators of this subpackage share: tables, scratch tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
import weakref
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of text that a Python task handles at a time.
BLOCK_BYTES = 3 << 20
#: Spark's option to remove an execution's shuffle files when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Pieces, and their ids, from which a worker keeps no more between blocks; the length of those that it keeps.
KEPT, KEPT_IDS, KEPT_LENGTH = 350_000, 2_500_000, 40


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the context's checkpoint folder, or where
    neither is set a folder in the warehouse, which is shared too."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = kept.get() if kept.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return path


class Scratch:
    """Tables written below the shared folder. They cut lineage and survive lost executors.

    They stay until delete(). Those made in a function under @owning go some time after the DataFrame that it returned
    is no longer referenced: not at once, since others may have been made from it, but when the second such function
    after that begins."""

    open: list[list[Scratch]] = []
    released: list[Scratch] = []
    leaving: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if self.open:
            self.open[-1].append(self)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """df as a table that is read from now on. The shuffles that it took go as soon as it is written."""
        path, conf = f"{self.path}/{table}", self.spark.conf
        before = conf.get(FREED, None)
        conf.set(FREED, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.unset(FREED) if before is None else conf.set(FREED, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, table: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}" if table else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def owning(f):
    """The scratch tables made in f (spark, ...) go after the DataFrame that f returns."""

    @functools.wraps(f)
    def run(*args):
        args[0].sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # Python workers import this package
        for x in Scratch.leaving:
            _quietly(x.delete)
        Scratch.leaving, Scratch.released = Scratch.released, []
        Scratch.open.append([])
        try:
            out = f(*args)
        finally:
            made = Scratch.open.pop()
        for x in made:
            weakref.finalize(out, lambda x=x: Scratch.released.append(x)).atexit = False
        return out

    return run


def _quietly(delete) -> None:
    try:
        delete()
    except Exception:  # the session may be gone by then
        pass


def lean(run):
    """run, a function for mapInArrow, whose worker gives the memory back that it no longer needs when a task ends.
    Workers serve many tasks, those of later operators too."""
    if (context := SparkContext._active_spark_context) is not None:
        context.environment.setdefault("PYTHONPATH", ROOT)  # Python workers import this package

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidy


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


class Kept:
    """The ids of pieces of text, kept between the blocks of a worker in one flat array: the first KEPT pieces and those
    of one block more at most, some 60 MB."""

    def __init__(self):
        self.places, self.lengths, self.ids = {}, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, pieces: list, encode, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: the place of each, and by place the start and number of its ids in the last array.
        encode gets `step` unknown pieces at a time, and returns a list of ids for each."""
        places, base = self.places, len(self.lengths)
        at = np.fromiter(map(places.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        missing = [pieces[i] for i in new.tolist()]
        lengths, ids = [self.lengths], [self.ids]
        for k in range(0, len(missing), step):
            found = encode(missing[k : k + step])
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.array(list(chain.from_iterable(found)), np.uint32))
        at[new] = base + np.arange(len(new))
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        if base < KEPT and len(ids) <= KEPT_IDS:
            places.update((p, base + i) for i, p in enumerate(missing) if len(p) <= KEPT_LENGTH)
            self.lengths, self.ids = lengths, ids
        return at, np.cumsum(lengths) - lengths, lengths, ids


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES):
    """Record batches cut and joined so that each holds about `most` bytes of `column`, or one row beyond it."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).cumsum()
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(int(np.searchsorted(sizes, base + most - size, "right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1] - base)
            if to < batch.num_rows or size >= most:
                yield _joined(held)
                held, size = [], 0
            at = to
    if held:
        yield _joined(held)


def _joined(batches) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, the words as indices, and the distinct words (large binary).

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.binary_length(flat)) > 0  # blanks at a text's ends give empty parts
    if not filled.all():
        flat = flat.filter(pa.array(filled))
        offsets = np.concatenate(([0], np.cumsum(filled)))[offsets]
    coded = flat.dictionary_encode()
    return offsets, np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.large_binary())


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large binary array."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return offsets, data


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
