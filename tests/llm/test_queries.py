"""The registered queries as they are, over the smallest tables: every column of their contracts computed again in plain Python."""

import base64
import hashlib
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from brute import WORD, near, repeats
from geoloom.llm import packing, token_counts, toxicity
from geoloom.llm.common import load
from geoloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_op1(spark, texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    want = {}
    for i, t in texts.items():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want[i, n] = (a, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    bound = packing.lower_bound(np.array([n for _, n, _ in want.values()]), 2048)
    assert bound <= len(bins) <= bound + max(1, bound // 100)


def test_op2(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SMALL).collect()}
    model = toxicity.train(load(spark, SMALL, "documents"), load(spark, SMALL, "labels"))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    assert got.keys() == texts.keys() and weight
    for i, t in texts.items():
        own = {f for w in WORD.findall(t or "") for f in toxicity.features(w.encode())}
        z = model.bias + math.fsum(weight.get(f, 0.0) for f in own)
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.7)


def test_op3(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_substring_dedup"](spark, SMALL).collect()}
    assert got == {i: (n, n - len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, (n, w) in repeats(texts).items()}


def test_op4(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_byte_bpe"](spark, SMALL).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = model.encode_ordinary(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert got == want


def test_op7(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op7_near_dedup"](spark, SMALL).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near(texts).items()}


def test_op9(spark, texts):
    begin, go_on = token_counts.pieces_of(public_tokenizers.path("byte_bpe_50k.json"))
    most = max(map(len, begin | go_on))

    def pieces(word):
        at, n = 0, 0
        while at < len(word):
            own = begin if not at else go_on
            at = next((e for e in range(min(len(word), at + most), at, -1) if word[at:e] in own), None)
            if at is None:
                return 1
            n += 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op9_token_counts"](spark, SMALL).collect()}
    known: dict = {}
    want = {}
    for i, t in texts.items():
        own = [w.encode() for w in WORD.findall(t or "")]
        for w in own:
            if w not in known:
                known[w] = pieces(w)
        want[i] = (len(own), sum(known[w] for w in own))
    assert got == want
