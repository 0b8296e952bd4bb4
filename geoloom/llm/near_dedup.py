"""Near-duplicate detection with SetSketch registers.

Each text's set of word shingles is summed up in registers: for register i the least of the exponentially distributed
hashes of its elements, on a logarithmic scale and truncated to an integer. Registers of a union are the maxima of
registers, and two sets agree in a register about as often as their similarity says. Groups of registers are bands;
sets that share a band are candidates, a joint maximum-likelihood estimate from the two sketches sorts out most of
them, and the full sets decide on the rest.

Equal sets are one class. In a bucket (classes that share a band) the class with most bucket mates, the leader, is
compared with all others. Then classes outside their bucket's largest component are compared with the few mates that
their sketches say are nearest, and at last, inside the bucket's task, with all mates of unlike components; no pair is
left out but those that the estimate, or the triangle inequality with the distances to the leader, rules out. So no
link between components is lost, and members of a large group of near copies, once linked, are not paired: of a large
bucket the members of its largest component are dealt out in blocks, once each, and meet the others there.

Shingles are compared by 64-bit hashes; a pair of sets of 20,000 shingles each has an unlike pair with one hash with a
probability of 2e-11, which would make one shingle too many common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, blocks, lean
from .components import components
from .shingles import mixed, shingle_sets

#: Registers, those in a band, and the sketch's parameters: base of the logarithm and rate of the exponentials.
REGISTERS, ROWS, BASE, RATE = 128, 4, 1.001, 20.0
#: Ids that may be broadcast; beyond, the join shuffles.
BROADCAST = 1_000_000
#: Classes of a block, and their shingles: larger buckets are dealt out as pairs of blocks, other than the pairs inside
#: the largest component.
BLOCK, BLOCK_SHINGLES = 768, 1_000_000
_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of sets of 64-bit hashes, one row each; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        to, size = at, 0
        while to < len(full) and (to == at or size + len(sets[full[to]]) <= 1 << 16):
            size += len(sets[full[to]])
            to += 1
        flat = np.concatenate([sets[i] for i in full[at:to]])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[at : to - 1])])
        least = np.empty((to - at, REGISTERS), np.uint64)
        for i, f in enumerate(_FACTORS):
            h = flat * f
            h ^= h >> np.uint64(29)
            h *= f
            least[:, i] = np.minimum.reduceat(h, starts)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2e-16)) / RATE
        out[full[at:to]] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)
        at = to
    return out


def similarity(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets by maximum likelihood from their registers and their known sizes."""
    more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (n_x / (n_x + n_y))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_more, p_less = p(u - v * grid), p(v - u * grid)
    log = lambda q: np.log(np.clip(q, 1e-12, 1))
    likely = more * log(p_more) + less * log(p_less) + same * log(1 - p_more - p_less)
    return grid[np.arange(len(grid)), likely.argmax(axis=1)]


def _sketched(k):
    def run(batches):
        for batch in blocks(batches):
            sets = shingle_sets(batch.column("text"), k)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            registers = [r.tobytes() for r in sketch(sets)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(registers, pa.binary()),
                ],
                ["doc_id", "n", "key", "registers"],
            )

    return run


def _estimated(batches):
    """Pairs with the similarity that their sketches suggest."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
            n_x, n_y = (np.asarray(part.column(c)).astype(np.float64) for c in ("n_a", "n_b"))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similarity(x, y, n_x, n_y))], ["a", "b", "likely"])


def _sets(k):
    def run(batches):
        for batch in blocks(batches, most=2 << 20):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), k)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            for i in range(0, len(sets), 200):
                part = sets[i : i + 200]
                lists = pa.ListArray.from_arrays(
                    pa.array(ends[i : i + len(part) + 1] - ends[i], pa.int32()), flat.slice(int(ends[i]), int(ends[i + len(part)] - ends[i]))
                )
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(part)), lists], ["id", "shingles"])

    return run


def _grouped(work):
    """Applies work to the rows of each (band, lo, hi), which come one after the other."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "lo", "hi")), strict=True))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if held and keys[at] != key:
                    yield work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = keys[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _candidates(rows: pa.Table, least: float, far: float, once: bool):
    """For each class outside the bucket's largest component its place, those of the mates of other components whose
    estimate is `least` at least, and the estimates. once: a pair counts in the first band that it shares only."""
    x = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    n, component, block = (rows[c].to_numpy() for c in ("n", "component", "block"))
    near, away = (np.nan_to_num(rows[c].to_numpy(zero_copy_only=False).astype(np.float64), nan=unknown) for c, unknown in (("near", 0.0), ("away", 1.0)))
    band, two = rows["at"][0].as_py(), rows["lo"][0].as_py() != rows["hi"][0].as_py()
    kinds, counts = np.unique(component, return_counts=True)
    for i in np.flatnonzero(component != kinds[counts.argmax()]).tolist():
        ok = (component != component[i]) & (n <= n[i] / far) & (n >= n[i] * far)
        # the leader's distances bound the pair's
        ok &= np.maximum(near[i] - away, near - away[i]) <= 1 - far + 1e-9
        if two:
            ok &= block != block[i]
        at = np.flatnonzero(ok)
        same = x[at] == x[i]
        good = same.sum(axis=1) >= (least - 0.05) * REGISTERS
        if once:
            good &= same.reshape(len(at), REGISTERS // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
        at = at[good]
        if len(at):
            likely = similarity(np.broadcast_to(x[i], (len(at), REGISTERS)), x[at], np.full(len(at), n[i], float), n[at].astype(float))
            if (likely >= least).any():
                yield i, at[likely >= least], likely[likely >= least]


def _nearest(least: float, far: float, most: int):
    """Pairs of each class outside the largest component with its most similar mates of other components."""

    def work(rows):
        ids = rows["id"].to_numpy()
        pairs = [(ids[i], ids[j]) for i, at, likely in _candidates(rows, least, far, False) for j in at[np.argsort(-likely, kind="stable")[:most]]]
        low, high = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1).T
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    return _grouped(work)


def _involved(least: float, far: float):
    """The rows that have a mate to be compared with."""

    def work(rows):
        some = np.zeros(rows.num_rows, bool)
        for i, at, _ in _candidates(rows, least, far, True):
            some[i] = True
            some[at] = True
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.filter(pa.array(some)).columns], rows.column_names)

    return _grouped(work)


def _joined(least: float, far: float, percent: int):
    """Links (a, b) that join components: all candidates of a bucket are compared by their full sets, but those whose
    components a link found here joins already."""

    def work(rows):
        ids, component = rows["id"].to_numpy(), rows["component"].to_numpy()
        sets = [np.asarray(v.values).view(np.uint64) for v in rows["shingles"]]
        root: dict[int, int] = {}

        def find(c):
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out = []
        for i, at, likely in _candidates(rows, least, far, True):
            for j in at[np.argsort(-likely, kind="stable")].tolist():
                a, b = find(component[i]), find(component[j])
                if a == b:
                    continue
                x, y = sorted((sets[i], sets[j]), key=len)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
        low, high = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1).T
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    return _grouped(work)


def _compared(batches):
    """Pairs with their sets' exact intersection and union."""
    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        both, either = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            x, y = np.asarray(xs[i].values).view(np.uint64), np.asarray(ys[i].values).view(np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both[i] = int((y[at] == x).sum())
            either[i] = len(x) + len(y) - both[i]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both), pa.array(either)], ["a", "b", "both", "either"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, margin: float = 0.18
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set: distinct k-word shingles, words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; with fewer words the
    whole sequence is the only shingle; null and blank texts have none and are linked with nothing. Documents are
    linked if 100 * intersection >= percent * union. component_id: the smallest doc_id reachable by links, itself
    included; kept: doc_id = component_id. At a similarity of 0.75 bands miss one pair in 190,000; candidates whose
    estimate is more than `margin` below the threshold (4.7 standard deviations) are not compared.

    doc_id identifies a document: of rows that repeat one, the row with the smallest set (then hash) counts, and there
    is one row for them. Rows with a null doc_id are left out. Other columns are ignored. An empty table gives an
    empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    sketched = rows.mapInArrow(lean(_sketched(k)), "doc_id long, n long, key binary, registers binary")
    sketched = sketched.groupBy("doc_id").agg(F.min(F.struct("n", "key", "registers")).alias("s")).select("doc_id", "s.*")
    sketched = scratch.write(sketched, "sketches")
    classes = sketched.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"))
    own = scratch.write(sketched.join(classes.select("id"), F.col("doc_id") == F.col("id")).select("id", "n", "registers"), "classes")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)),
        lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    banded = own.select("id", "n", F.posexplode(bands).alias("at", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    # written first: where both sides of a join are plain rows, a very large bucket or class can be split
    shared = scratch.write(shared, "shared")
    buckets = scratch.write(banded.join(shared, "band"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("mates").alias("degree"))
    ranked = scratch.write(buckets.join(degree, "id").select("band", "at", "id", "n", "mates", "degree"), "ranked")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("id")).alias("at"), "n")).alias("l"))
    leaders = scratch.write(leaders.select("band", (-F.col("l.at")).alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # sets that are linked differ little in size
    near_size = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    stars = ranked.join(leaders, "band").where(near_size & (F.col("id") != F.col("leader")))
    pairs = scratch.write(stars.select(*ordered(F.col("id"), F.col("leader"))).distinct(), "pairs1")
    x = own.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("x"))
    y = own.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("y"))
    guessed = scratch.write(pairs.join(x, "a").join(y, "b").mapInArrow(lean(_estimated), "a long, b long, likely double"), "estimated")
    likely, unlikely = (guessed.where(F.col("likely") >= percent / 100 - margin), guessed.where(F.col("likely") < percent / 100 - margin))
    compared = _verified(scratch, rows, likely.select("a", "b"), k, "1")
    links = compared.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")
    found = components(links, scratch, "joined1")
    # distances to leaders: exact, or the least that the estimate allows
    exact = (1 - F.col("both") / F.col("either"))
    apart = compared.select("a", "b", exact.alias("near"), exact.alias("away"))
    apart = scratch.write(apart.union(unlikely.select("a", "b", 1 - F.col("likely") - margin, F.lit(1.0))), "apart")
    for step, nearest in (("2", 3), ("3", None)):
        placed = ranked.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = scratch.write(placed.select("band", "at", "id", "n", "mates", "component"), f"placed{step}")
        sizes = placed.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        unlike = sizes.groupBy("band").agg(
            F.max(F.struct("c", "component", "s")).alias("m"), F.count("*").alias("kinds"), F.sum("c").alias("c"), F.sum("s").alias("s")
        )
        count = lambda c, s: F.ceil(F.greatest(F.lit(1.0), c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
        unlike = unlike.where("kinds > 1").select(
            "band", F.col("m.component").alias("main"), count(F.col("m.c"), F.col("m.s")).alias("mains"),
            count(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("others"), (count(F.col("c"), F.col("s")) == 1).alias("whole"),
        )
        unlike = scratch.write(unlike, f"unlike{step}")
        rest = placed.join(unlike, "band").join(leaders, "band")
        rest = rest.select("*", *ordered(F.col("id"), F.col("leader"))).join(apart, ["a", "b"], "left")
        rest = rest.withColumns({c: F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.col(c)) for c in ("near", "away")})
        # blocks of the largest component have numbers below 0
        inside, spot = F.col("component") == F.col("main"), F.xxhash64("id")
        block = F.when(F.col("whole"), 0).when(inside, -1 - F.pmod(spot, "mains")).otherwise(F.pmod(spot, "others")).cast("int")
        rest = rest.withColumn("block", block)
        pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
        every = F.sequence(F.lit(0), F.col("others") - 1)
        meets = (
            F.when(F.col("whole"), F.array(pair(F.lit(0), F.lit(0))))
            .when(inside, F.transform(every, lambda o: pair(F.col("block"), o)))
            .otherwise(F.concat(
                F.transform(every, lambda o: pair(F.least("block", o), F.greatest("block", o))),
                F.transform(F.sequence(F.lit(1), F.col("mains")), lambda m: pair(-m, F.col("block"))),
            ))
        )
        rest = rest.withColumn("met", F.explode(meets))
        rest = rest.select("band", "met.lo", "met.hi", "block", "at", "id", "n", "component", "near", "away")
        rest = rest.join(own.select("id", "registers"), "id")
        dealt = rest.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
        least, far = percent / 100 - margin, percent / 100
        if nearest:
            more = dealt.mapInArrow(lean(_nearest(least, far, nearest)), "a long, b long").distinct()
            more = scratch.write(more.join(pairs, ["a", "b"], "left_anti"), f"pairs{step}")
            compared = _verified(scratch, rows, more, k, step)
            links = links.union(compared.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b"))
        else:
            some = scratch.write(dealt.mapInArrow(lean(_involved(least, far)), dealt.schema), "involved")
            sets = _set_table(scratch, rows, some.select(F.col("id").alias("doc_id")).distinct(), k, step)
            dealt = some.join(sets, "id").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
            links = links.union(scratch.write(dealt.mapInArrow(lean(_joined(least, far, percent)), "a long, b long"), f"links{step}"))
        found = scratch.write(components(links, scratch, f"joined{step}"), f"components{step}")
    members = classes.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    members = scratch.write(members, "members")
    out = sketched.select("doc_id", "n", "key").join(members, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _set_table(scratch, rows, ids, k, name) -> DataFrame:
    """(id, shingles) of the ids (doc_id)."""
    ids = scratch.write(ids, f"ids{name}")
    side = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    sets = rows.join(side, "doc_id").mapInArrow(lean(_sets(k)), "id long, shingles array<long>")
    # of rows that repeat an id the smallest set counts
    least = F.min(F.struct(F.size("shingles").alias("n"), "shingles"))
    return scratch.write(sets.groupBy("id").agg(least.alias("s")).select("id", "s.shingles"), f"sets{name}")


def _verified(scratch, rows, pairs, k, name) -> DataFrame:
    """The pairs (a, b) with the intersection and union of their full sets."""
    sets = _set_table(scratch, rows, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), k, name)
    x, y = (sets.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return scratch.write(both.mapInArrow(lean(_compared), "a long, b long, both long, either long"), f"compared{name}")
