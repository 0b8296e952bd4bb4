import random
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from brute import near, repeats
from geoloom.llm import exact_dedup, near_dedup, substring_dedup
from geoloom.llm.common import Scratch
from geoloom.llm.components import components

DOCS = "/root/testdata/sf0.001/documents.parquet"


def passages(n=60, seed=1):
    """Texts that share passages of many lengths, with short, empty and null ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    stock = [[r.choice(words) for _ in range(r.choice([20, 49, 50, 51, 80, 200]))] for _ in range(8)]
    out = {0: None, 1: "", 2: " \n", 3: "one two"}
    for i in range(4, n):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += r.choice(stock) if r.random() < 0.6 else [r.choice(words) for _ in range(r.randrange(5, 60))]
        if r.random() < 0.3:
            parts[r.randrange(len(parts))] = "Changed"
        out[i] = r.choice([" ", "\n", "  "]).join(parts)
    return out


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_directory_splits_until_buckets_fit():
    weights = {p: 10 for p in range(16)} | {3: 1000}
    d = exact_dedup.Directory.build(weights, 4, 25)
    assert d.depth == 4 and len(d.slots) == 16
    loads = {}
    for p, w in weights.items():
        loads.setdefault(d.slots[p], []).append((p, w))
    assert all(sum(w for _, w in x) <= 25 or len(x) == 1 for x in loads.values())
    assert exact_dedup.Directory.build({}, 4, 25).slots == [0]


@pytest.mark.parametrize("hasher", [exact_dedup._key, lambda text: len(text) % 3])
def test_exact_copies(spark, hasher):
    rows = [(1, "a"), (2, "a "), (3, None), (4, ""), (5, "a"), (6, "x" * 70000), (7, "x" * 70000), (7, "x" * 70000), (None, "a"), (None, "lone"), (8, "y" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as keep_id", "'k' as key", "2 as n")
    got = exact_dedup.deduplicate(df.repartition(3), bucket_bytes=1000, hasher=hasher).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(5, 3, False)] and by[5] == [(5, 3, True)] and by[2] == [(2, 1, True)]
    assert by[3] == [(4, 2, False)] and by[4] == [(4, 2, True)]
    assert sorted(by[7]) == [(7, 3, False), (7, 3, True)] and by[6] == [(7, 3, False)]
    assert sorted(by[None], key=str) == [(5, 3, False), (None, 1, True)]
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark):
    texts = passages() | {100: "A b c d e f", 101: "a B C d e f", 102: "one two"}
    r = random.Random(4)
    base = [f"v{i}" for i in range(100)]
    for i in range(200, 260):  # a group whose members are linked through others
        own = list(base)
        for _ in range(r.randrange(1, 5)):
            own[r.randrange(100)] = f"z{r.random()}"
        texts[i] = " ".join(own)
    df = table(spark, texts).selectExpr("*", "text as id", "0 as band", "1 as component")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df.repartition(3)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near(texts).items()}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1000)
    texts = {t["doc_id"]: t["text"] for t in pq.read_table(DOCS, columns=["doc_id", "text"]).to_pylist()}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in near(texts).items()}


@pytest.mark.parametrize("group,held", [(1, 1), (4, 10), (1000, 6000)])
def test_repeats_equal_brute_force(spark, monkeypatch, group, held):
    """Groups of one context take prefixes of up to a whole window."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "HELD", held)
    texts = passages(80, 7) | {500: " ".join(["again", "and"] * 300), 501: " ".join(["x"] + ["again", "and"] * 200), 502: "ab " * 70, 503: "ab " * 60}
    df = table(spark, texts).selectExpr("*", "'x' as whole", "text as key", "1 as cuts")
    got = substring_dedup.remove_repeats(df.repartition(3))
    assert got.columns == ["doc_id", "text", "whole", "key", "cuts", "n_words", "n_removed", "kept_text"]
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()}
    assert rows == {i: (n, n - len(w), " ".join(w)) for i, (n, w) in repeats(texts).items()}


def test_spans_are_maximal_runs(spark):
    said = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(said), 2: " ".join(["a"] + said[20:120] + ["b"] + said[100:149] + ["c"] + said[140:190]), 3: " ".join(said)}
    got = {r.doc_id: (r.whole, r["from"], r["to"]) for r in substring_dedup.repeated_spans(table(spark, texts)).collect()}
    assert got == {2: (False, [1, 152], [101, 202]), 3: (True, None, None)}


def test_repeats_of_odd_tables(spark):
    said = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, said), (1, said), (1, said), (2, said), (2, "other"), (3, said + " x")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert rows == [(-1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 1, 0), (2, 60, 60), (3, 61, 60)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_texts_longer_than_a_block(spark):
    """Each row is more than a task takes at a time."""
    r = random.Random(11)
    said = [f"w{r.randrange(90000)}" for _ in range(620_000)]
    texts = {1: " ".join(said), 2: " ".join([*said, "more"]), 3: " ".join(said), 4: "short"}
    assert len(texts[1]) > 3 << 20
    df = table(spark, texts).repartition(2)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (620000, 0), 2: (620001, 620000), 3: (620000, 620000), 4: (1, 0)}
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {x.doc_id: x.keep_id for x in exact_dedup.deduplicate(df).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


def test_very_many_copies_of_one_text(spark):
    df = spark.range(200_000).selectExpr("id as doc_id", "if(id < 5, concat('own ', id), 'one text') as text").coalesce(1)
    got = exact_dedup.deduplicate(df).groupBy("keep_id", "group_size", "kept").count().collect()
    want = [(199_999, 199_995, False, 199_994), (199_999, 199_995, True, 1)] + [(i, 1, True, 1) for i in range(5)]
    assert sorted(tuple(x) for x in got) == sorted(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr("geoloom.llm.components.BROADCAST", most)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (5, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
