"""Removal of passages that repeat an earlier document, by prefix-partitioned suffix trees.

The suffixes that are indexed begin at anchors: the least-hashed run of PREFIX words of each window of `width` words. As
equal windows have equal anchors at the same place, every window is found from its anchor's suffix, and one word in
twenty or so begins a suffix instead of every one. A suffix comes with its context, the words of all windows that have
its anchor, so some of them stand to its left.

Suffixes are grouped by their first words, the anchor to begin with; groups of one document are left out, and equal
contexts are one. Where a group holds more than GROUP contexts, its prefix gets longer: the windows are parted by the
place of the anchor in them, which lengthens the run of words that all windows of a part have in common, and the suffix
then begins where that run does. This is repeated until each group fits; the longest prefix is a whole window.

A group becomes a subtree: its suffixes in order with their common prefixes, and the words before them likewise, read
backwards. A node `r` words deep in the one and a node `l` words deep in the other, r + l >= width, are a repeat; for
each place of the anchor the nodes at the depths that a window needs give the documents that share it, and the smallest
of them is where it starts first. Repeats that overlap in a document are joined to runs of maximal length.

The trees compare words. Contexts are told apart by 128-bit hashes. Documents are whole copies if the 64-bit hashes of
their words are the same in order: a wrong one needs texts that differ in words with equal hashes only, one pair of
words in 2e19.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, blocks, lean, words
from .shingles import runs, word_hashes

#: Words of an anchor; contexts that a tree holds (half a megabyte, so that tasks stay even); contexts that a task takes at a time; rows that may be broadcast.
PREFIX, GROUP, HELD, BROADCAST = 12, 1000, 6000, 300_000
_FOUND = "core long, context binary, doc long, lo int, n int, p int, a int, b int, words binary"


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` words the position of its least run of PREFIX words, the first of equals."""
    value = runs(hashes, PREFIX)
    span = width - PREFIX + 1
    n = len(value) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(value)), 1

    def less(a, b):
        return np.where(value[b] < value[a], b, a)

    while 2 * size <= span:
        at = less(at[:-size], at[size:])
        size *= 2
    return less(at[:n], at[span - size :][:n]) if size < span else at[:n]


def _sketched(width):
    def run(batches):
        for batch in blocks(batches):
            ends, hashes = word_hashes(batch.column("text"), lower=False)
            keys, prefixes, places = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = hashes[a:b]
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                at = anchors(own, width)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
                places.append(at.astype(np.int32))
                prefixes.append(runs(own, PREFIX)[at].view(np.int64) if len(at) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())),
                ],
                ["doc_id", "n_words", "key", "prefixes", "places"],
            )

    return run


def _rows(out: list[tuple]):
    """Rows of contexts. core: the hash of the suffix's prefix; context: its words and windows, as a hash; doc, lo: where
    its first window begins; n: its windows; p: the anchor's place in it; a, b: the places of the anchor in its windows
    that its group holds, so the prefix runs from word p - a to p - b + width."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), *[pa.int32()] * 5, pa.binary()]
    for k in range(0, len(out), 4000):
        columns = zip(*out[k : k + 4000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], _FOUND.replace(",", "").split()[::2])


def _row(core: int, doc, lo, n, p, a, b, words: bytes) -> tuple:
    return (core - (1 << 63), xxhash.xxh3_128_digest(b"%d %d %d %d " % (a, b, p, n) + words), doc, lo, n, p, a, b, words)


def _contexts(width):
    """Contexts of a document's shared anchors: the words of all windows that have the anchor as theirs."""

    def run(batches):
        for batch in blocks(batches, most=1 << 20):
            ends, hashes = word_hashes(batch.column("text"), lower=False)
            out: list[tuple] = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                said = batch.column("text")[i].as_py().encode().split()
                own = hashes[ends[i] : ends[i + 1]]
                at, prefix = anchors(own, width), runs(own, PREFIX)
                places = np.sort(np.asarray(batch.column("shared")[i].values).astype(np.int64))
                los, his = np.searchsorted(at, places, "left"), np.searchsorted(at, places, "right")
                for p, lo, hi in zip(places.tolist(), los.tolist(), his.tolist()):
                    if hi > lo:
                        context = b" ".join(said[lo : hi - 1 + width])
                        out.append(_row(int(prefix[p]), doc, lo, hi - lo, p - lo, 0, width - PREFIX, context))
                if len(out) >= 8000:
                    yield from _rows(out)
                    out = []
            yield from _rows(out)

    return run


def _split(width):
    """Contexts of groups that are too large as those of two groups each, with longer prefixes: windows that have the
    anchor at places a .. m, and at m + 1 .. b."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc", "lo", "n", "p", "a", "b", "words")), strict=True)
            for doc, lo, n, p, a, b, said in rows:
                said, m = said.split(b" "), (a + b) // 2
                for low, high in ((a, m), (m + 1, b)):
                    first, last = max(0, p - high), min(n - 1, p - low)  # windows
                    if low <= high and first <= last:
                        core = xxhash.xxh3_64_intdigest(b" ".join(said[p - low : p - high + width]), seed=low * 4096 + high)
                        out.append(_row(core, doc, lo + first, last - first + 1, p - first, low, high, b" ".join(said[first : last + width])))
                if len(out) >= 8000:
                    yield from _rows(out)
                    out = []
            yield from _rows(out)

    return run


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order, as the leaves of their tree, and how many leading numbers each has in common with the one before."""
    order = np.argsort(np.ascontiguousarray(rows).view([("", np.void, rows.itemsize * rows.shape[1])]).ravel(), kind="stable")
    own = rows[order]
    unlike = own[1:] != own[:-1]
    return order, np.concatenate(([0], np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])))


def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of the tree at this depth, or the edge, that each row is below."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def lowest(group, docs, contexts: pa.Array, n, p, a, width: int) -> np.ndarray:
    """For each window of each context, one after the other, the smallest document of its group that has the window."""
    ends, index, _ = words(contexts.cast(pa.string()))
    count, code = len(docs), np.append(index.astype(np.int32), 0)
    core, lengths = (p - a)[:, None], np.diff(ends)[:, None]
    alone = -1 - np.arange(count, dtype=np.int32)[:, None]  # a word like no other, beyond a context's ends
    at = core + np.arange(width)
    right = np.where(at < lengths, code[np.minimum(ends[:-1, None] + at, len(index))], alone)
    most = int((p - a).max(initial=0))
    at = core - 1 - np.arange(max(1, most))
    left = np.where(at >= 0, code[np.maximum(ends[:-1, None] + at, 0)], alone)
    after = ordered(np.column_stack((group.astype(np.int32), right.astype(np.int32))))
    before = ordered(left.astype(np.int32))
    starts = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    for t in range(most + 1):  # windows that begin t words before the prefix
        own = np.flatnonzero((core[:, 0] >= t) & (core[:, 0] - t < n))
        if len(own):
            node = nodes(*after, width - t + 1)[own] * (count + 1) + nodes(*before, t)[own]
            kind = np.argsort(node, kind="stable")
            begins = np.flatnonzero(np.concatenate(([True], np.diff(node[kind]) != 0)))
            low = np.minimum.reduceat(docs[own][kind], begins)
            rows = own[kind]
            out[starts[rows] + core[rows, 0] - t] = np.repeat(low, np.diff(np.append(begins, len(rows))))
    return out


def _trees(width):
    """Rows sorted by core; whole groups are taken together, about HELD contexts at a time. Contexts of which no window
    starts in an earlier document are left out."""

    def found(held):
        table = pa.Table.from_batches(held)
        core, docs, top, n, p, a = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("core", "doc", "top", "n", "p", "a"))
        group = np.cumsum(np.concatenate(([False], core[1:] != core[:-1])))
        low = lowest(group, docs, table["words"].combine_chunks(), n, p, a, width)
        ends = np.concatenate(([0], np.cumsum(n)))
        some = np.minimum.reduceat(low, ends[:-1]) < top
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(low))
        return pa.RecordBatch.from_arrays([table["context"].combine_chunks(), lists], ["context", "first"]).filter(pa.array(some))

    def run(batches):
        held, n, last = [], 0, None
        for batch in batches:
            core = np.asarray(batch.column("core"))
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, at + 2000)
                if n >= HELD:  # a group that has begun is finished first
                    other = core[at:] != last
                    same = int(np.argmax(other)) if other.any() else len(core) - at
                    if same == 0:
                        yield found(held)
                        held, n = [], 0
                    else:
                        to = at + same
                held.append(batch.slice(at, to - at))
                n += to - at
                last, at = core[to - 1], to
        if n:
            yield found(held)

    return run


def _key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(word_hashes(pa.array([text.decode()]), lower=False)[1].tobytes())


def _merged(width):
    """The windows marked in a document's contexts as runs of words: from (included) and to (excluded)."""

    def run(batches):
        for batch in batches:
            begins, ends = [], []
            for cuts in batch.column("cuts"):
                starts = np.unique(np.concatenate([c["lo"].as_py() + np.flatnonzero(np.asarray(c["gone"].values)) for c in cuts]))
                new = np.concatenate(([True], np.diff(starts) > width))
                begins.append(starts[new].astype(np.int32))
                ends.append((starts[np.append(new[1:], True)] + width).astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(begins, kind), pa.array(ends, kind)], ["doc_id", "from", "to"])

    return run


def _cut(text_col, names):
    """Drops the marked runs of words, or all words of a `whole` copy; columns whole, from, to and key come last."""

    def run(batches):
        at, whole_at, from_at, to_at, key_at = names.index(text_col), *range(len(names), len(names) + 4)
        for batch in blocks(batches, text_col):
            kept, total, removed = [], [], []
            texts = pc.fill_null(batch.column(at), "").cast(pa.binary()).to_pylist()
            marks = zip(texts, *(batch.column(i).to_pylist() for i in (whole_at, from_at, to_at, key_at)), strict=True)
            for text, whole, begins, ends, key in marks:
                said = text.split()
                stay = said
                if key is not None and _key(text) == key:
                    if whole:
                        stay = []
                    else:
                        edges = zip([0, *ends], [*begins, len(said)], strict=True)
                        stay = [w for a, b in edges for w in said[a:b]]
                total.append(len(said))
                removed.append(len(said) - len(stay))
                kept.append(b" ".join(stay))
            more = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, "n_words", "n_removed", "kept_text"])

    return run


def _sized(df: DataFrame, listed: str) -> DataFrame:
    """df to be broadcast if its rows and the items of its column of lists are few; else the join shuffles."""
    rows, items = df.agg(F.count("*"), F.sum(F.when(F.col(listed).isNotNull(), F.size(listed)))).first()
    return F.broadcast(df) if rows <= BROADCAST and (items or 0) <= 10 * BROADCAST else df


def _judged(rows: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(doc_id, key, whole, from, to) of rows (doc_id, text): what of which documents repeats an earlier one."""
    sketched = rows.mapInArrow(lean(_sketched(width)), "doc_id long, n_words long, key binary, prefixes array<long>, places array<int>")
    sketched = scratch.write(sketched.where(F.col("n_words") >= width), "sketches")
    # of rows that repeat an id one is judged; of equal texts the smallest id stands for all
    ids = scratch.write(sketched.groupBy("doc_id").agg(F.min(F.struct("n_words", "key")).alias("s")).select("doc_id", "s.key"), "ids")
    low = scratch.write(ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep"), "copies")
    status = ids.join(low, "key", "left").select("doc_id", "key", (F.col("doc_id") != F.coalesce("rep", "doc_id")).alias("whole"))
    status = scratch.write(status, "status")
    reps = status.where("not whole").select("doc_id", "key")
    placed = sketched.join(reps, ["doc_id", "key"]).select("doc_id", F.explode(F.arrays_zip("prefixes", "places")).alias("x"))
    placed = placed.select("doc_id", F.col("x.prefixes").alias("prefix"), F.col("x.places").alias("place"))
    shared = placed.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("prefix")
    # written first, so that the join's sides are plain rows and a very common prefix can be split
    shared = scratch.write(shared, "prefixes")
    mine = placed.join(shared, "prefix").groupBy("doc_id").agg(F.collect_list("place").alias("shared"))
    mine = scratch.write(mine, "shared")
    texts = rows.join(_sized(mine, "shared"), "doc_id")
    found = scratch.write(texts.mapInArrow(lean(_contexts(width)), _FOUND), "contexts0")
    every, firsts, step = None, None, 0
    while True:
        each = found.groupBy("core", "context").agg(
            F.min("doc").alias("doc"), F.max("doc").alias("top"), *(F.first(c).alias(c) for c in ("n", "p", "a", "words"))
        )
        each = scratch.write(each, f"distinct{step}")
        groups = each.groupBy("core").agg(F.count("*").alias("contexts"), F.min("doc").alias("lo"), F.max("top").alias("hi"))
        groups = scratch.write(groups.where("lo < hi").select("core", "contexts"), f"groups{step}")
        sized = each.join(groups.where(F.col("contexts") <= GROUP), "core")
        alone = sized.where("contexts = 1 and doc < top").selectExpr("context", "array_repeat(doc, n) as first")
        trees = sized.where("contexts > 1").select("core", "context", "doc", "top", "n", "p", "a", "words")
        trees = trees.repartition("core").sortWithinPartitions("core").mapInArrow(lean(_trees(width)), "context binary, first array<long>")
        first = scratch.write(alone.union(trees), f"first{step}")
        part = found.select("context", "doc", "lo")
        every, firsts = (part, first) if every is None else (every.union(part), firsts.union(first))
        large = groups.where(F.col("contexts") > GROUP).select("core")
        if large.isEmpty():
            break
        step += 1
        found = scratch.write(found.join(large, "core").select(found.columns).mapInArrow(lean(_split(width)), _FOUND), f"contexts{step}")
    gone = every.join(firsts, "context")
    gone = gone.select("doc", "lo", F.transform("first", lambda m: m < F.col("doc")).alias("gone")).where("exists(gone, x -> x)")
    cuts = gone.groupBy("doc").agg(F.collect_list(F.struct("lo", "gone")).alias("cuts"))
    cuts = cuts.select(F.col("doc").alias("doc_id"), "cuts").mapInArrow(lean(_merged(width)), "doc_id long, from array<int>, to array<int>")
    none = F.lit(None).cast("array<int>")
    marks = status.where("whole").select("doc_id", "key", F.lit(True).alias("whole"), none.alias("from"), none.alias("to"))
    marks = marks.union(cuts.join(status.select("doc_id", "key"), "doc_id").select("doc_id", "key", F.lit(False), "from", "to"))
    return scratch.write(marks, "marks")


def repeated_spans(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, whole, from, to) of the documents that repeat one with a smaller id: whole copies, and for others the
    runs of words, as long as they can be, that are covered by repeated windows (from included, to excluded). Rows are
    judged as in remove_repeats; documents that repeat nothing have no row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return _judged(rows, Scratch(docs.sparkSession, "substring"), width).select("doc_id", "whole", "from", "to")


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text: the words `[^\\x20\\x09-\\x0D]+` left, joined by one space, after
    each word went that is covered by a window of `width` words whose sequence also starts in a document with a smaller
    id. Windows are judged on the input, not on what is left.

    A null or blank text has no words. Repeats within one document stay. Rows with a null id keep all their words and
    take nothing from others. Of rows that repeat an id, the shortest with `width` words or more (then the one with the
    least hash) is judged; the others are cut only if their words are the same. Other columns pass through; columns of
    docs with the new names are replaced. An empty table gives an empty one. Windows on which a text of any length
    depends are all compared; there are no caps. width: more than PREFIX words."""
    scratch = Scratch(docs.sparkSession, "substring")
    docs = docs.drop("n_words", "n_removed", "kept_text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    marks = _judged(rows, scratch, width).select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "key", "whole", "from", "to")))
    names = docs.columns
    joined = docs.join(_sized(marks, "__from"), F.col(id_col).cast("long") == F.col("__doc_id"), "left")
    joined = joined.select(*[docs[n] for n in names], F.coalesce("__whole", F.lit(False)).alias("__whole"), "__from", "__to", "__key")
    fields = [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(lean(_cut(text_col, names)), T.StructType(fields))
