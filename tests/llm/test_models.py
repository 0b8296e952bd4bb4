import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import zlib

from geoloom.llm import chat, lm_scores, metric_search, packing, toxicity
from geoloom.llm.common import Scratch
from pyspark.sql import functions as F

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_bounds_and_best_fit():
    r = np.random.default_rng(2)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([4, 4, 4, 4]), 10) == 2 and packing.lower_bound(np.zeros(0, np.int64), 10) == 0
    for _ in range(200):
        lengths = r.integers(1, 21, r.integers(1, 40))
        bins, places, room = packing.best_fit(lengths, 20)
        for b in range(len(room)):
            own = sorted((places[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [p for p, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) == 20 - room[b]
        assert packing.lower_bound(lengths, 20) <= len(room)


def test_pieces_and_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 20)
    r = random.Random(3)
    texts = [None, "", "x", "Ünïcode\x85text  <|endoftext|> it's 123"] + [" ".join(r.choices(["the", "cat", "Sat."], k=r.randrange(900))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as item", "2 as length")
    own = Scratch(spark, "t").write(packing.pieces(df.repartition(3), WORDS, capacity=256), "pieces")
    rows = packing.pack_pieces(own, 256).collect()
    model = packing.encoder(WORDS).model
    got = {}
    for x in sorted(rows, key=lambda x: (x.doc_id, x.piece)):
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length <= 256 and x.start == x.piece * 256
        got.setdefault(x.doc_id, []).extend(ids)
    assert got == {i: model.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    sequences = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256
    lengths = np.array([x.length for x in rows])
    assert len(sequences) <= 1.05 * packing.lower_bound(lengths, 256) + 1
    none = packing.pieces(df.limit(0), WORDS)
    assert packing.pack_pieces(Scratch(spark, "t").write(none, "none")).count() == 0


def test_toxicity_is_learned_from_markers(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = r.choices([f"w{k}" for k in range(300)], k=30) + ([r.choice(["vilest", "vilely", "grosso"])] if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (2000, None, "y"), (2001, "", "z")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((s >= 0.7) == bool(t) for s, t in held) and 0 <= got[2000] == got[2001] < 0.5
    untaught = toxicity.train(docs, marks.limit(0))
    assert all(abs(x.score - 0.001) < 1e-9 for x in toxicity.score(docs, untaught).collect())
    assert toxicity.score(docs.limit(0), untaught).count() == 0


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a <|im_end|> \\ <\\| é", 1.0), (1, 3, 1, "assistant", "b", 2.0),
        (1, 4, 2, "user", None, 0.5), (1, 5, 99, "sys\ntem", "root too", None), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (None, 1, None, "user", "x", 0.0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit(1))
    whole = chat.conversations(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("loss_spans")))
    got = {x.leaf: x for x in whole.collect()}
    assert set(got) == {3, 4, 5} and {k: v["rank"] for k, v in got.items()} == {3: 1, 4: 2, 5: 3}
    assert [tuple(t) for t in got[4].turns] == [("user", "q"), ("assistant", rows[1][4]), ("user", "")]
    assert list(got[4].loss) == [rows[1][4]] and [tuple(t) for t in got[5].turns] == [("sys\ntem", "root too")] and list(got[5].loss) == []
    s = got[4].loss_spans[0]
    assert chat.BEGIN not in got[4].formatted[s.start : s.start + s.chars] and got[4].formatted[s.start : s.start + 2] == "a "
    assert [x.leaf for x in chat.conversations(df, branches=1).collect()] == [3] and chat.conversations(df.limit(0)).count() == 0


def test_long_chain(spark):
    df = spark.range(1, 301).selectExpr("7L as conv_id", "id as msg_id", "id - 1 as parent_id", "if(id % 2 = 0, 'assistant', 'user') as role", "concat('t', id) as text", "null as score")
    row = chat.conversations(df).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(row) == 1 and row[0].n_turns == 300 and list(row[0].loss) == [f"t{i}" for i in range(2, 301, 2)]


def backoff_scores(corpus, texts, order, backoff=0.4):
    """The ln score of each text under the n-gram counts of the corpus, by plain counting."""
    counts, total = Counter(), sum(map(len, corpus))
    for x in corpus:
        for n in range(1, order + 1):
            counts.update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    out = []
    for x in texts:
        score = 0.0
        for i in range(len(x)):
            for n in range(order, 0, -1):
                gram = tuple(x[i - n + 1 : i + 1]) if i >= n - 1 else None
                if n == 1:
                    score += math.log(max(counts[gram], 1) / total)
                elif gram and counts[gram]:
                    score += math.log(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    score += math.log(backoff)
        out.append(score)
    return out


def test_backoff_equals_counting(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randrange(40)) + [f"seen{i % 25}", f"once{i}"] * (i % 3))) for i in range(60)]
    rows += [(70, None), (70, "a lone"), (None, "once"), (80, " "), (81, "a b c " * 3000)]
    ws = [(t or "").split() for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as share", "2 as block", "'n' as n")
    monkeypatch.setattr(lm_scores, "SHARE", 500)  # many shares
    monkeypatch.setattr(lm_scores, "BLOCK", 300)
    for order in (1, 2, 3, 4):
        want = {}
        for (i, _), x in zip(rows, backoff_scores(ws, ws, order)):
            want[i] = want.get(i, 0.0) + x
        got = {x.doc_id: (x.n_tokens, x.log_score) for x in lm_scores.stupid_backoff(df, order=order).collect()}
        assert got.keys() == want.keys() and all(abs(got[i][1] - want[i]) < 1e-6 for i in want)
        assert got[80] == (0, 0.0) and got[81][0] == 9000 and got[70][0] == 2
    # other texts, with words and n-grams that the model lacks
    model = lm_scores.fit(df)
    others = [(i, " ".join(r.choices("abcdefghij", k=i % 12) + ["new"] * (i % 2))) for i in range(30)]
    got = {x.doc_id: x.log_score for x in lm_scores.stupid_backoff(spark.createDataFrame(others, "doc_id long, text string"), model=model).collect()}
    want = backoff_scores(ws, [t.split() for _, t in others], 3)
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(30))
    assert lm_scores.stupid_backoff(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("TREE", 64), ("PAGE", 8), ("BLOCK", 16)):
        monkeypatch.setattr(metric_search, name, value)
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-5, 6, 6).tolist()) for i in range(300)]
    rows += [(i, [1, 2, 3, 4, 5, 6]) for i in range(300, 340)] + [(400, [1, 2]), (450, [3, 4]), (500, []), (0, [9] * 6), (7, [8] * 6), (7, [8] * 6)]
    # products beyond 2 ** 53, and beyond a long
    rows += [(550, [2**40, 1, 0, 0, 0, 1]), (551, [2**40, 0, 0, 0, 0, 0]), (552, [2**40 + 2**10, 3, 0, 0, 0, 0]), (553, [0, 0, 0, 0, 2**900, 0])]
    odd = [(600, None), (650, [1.0, None]), (None, [1.0, 2.0]), (655, [1.0, float("nan")]), (660, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + odd, "vec_id long, vector array<double>").selectExpr("*", "1 as q", "2 as cell")
    got = sorted(tuple(x) for x in metric_search.top_k(df, df.where("vec_id % 50 = 0")).collect())
    expected = []
    for q in {i for i, _ in rows if i % 50 == 0}:
        scores = [(max(-metric_search.MOST, -sum(a * b for a, b in zip(v, w))), i) for j, v in rows if j == q for i, w in rows if i != q and len(w) == len(v)]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    assert got == sorted(expected)
    assert metric_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pruned_search_visits_few_pages():
    r = np.random.default_rng(5)
    centres = r.integers(-100, 100, (40, 8))
    vectors = np.concatenate([c + r.integers(-2, 3, (100, 8)) for c in centres])
    tree = metric_search.Tree(np.arange(len(vectors)), vectors)
    tree.vectors = tree.vectors.astype(float)
    q = vectors[5].astype(float)
    best = sorted(((float(s), -i) for i, s in enumerate(vectors @ vectors[5]) if i != 5), reverse=True)[:5]
    assert sorted(tree.search(5, q, 5, -np.inf), reverse=True) == best
