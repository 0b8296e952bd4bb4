import base64
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from geoloom.llm import byte_bpe, packing, token_counts
from geoloom.llm.common import raw, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "  a  b ", "  x  y", "it's  we'll'S", "\x1c\x1d a\x85b", "\n\n x\n", "日本語 テスト", "é" * 300, "x" * 3000, "🙂🙃 ok", "١٢٣ 12345", "﻿a​b᠎c", "a　 b"]


def texts():
    own = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    r = random.Random(5)
    alphabet = "ab 's\tÄß\n 日🙂1٣.,!' \x1c\x85ét"
    return ODD + own + ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3000)]


def test_ids_equal_tiktoken_and_round_trip():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, all_texts = byte_bpe.codec(RANKS), texts()
    ends, ids = own.encode(all_texts)
    for i, t in enumerate(all_texts):
        got = ids[ends[i] : ends[i + 1]]
        assert got.tolist() == oracle.encode_ordinary(t), repr(t)
        assert own.decode(got)[1].tobytes() == t.encode()


def test_offsets_of_split_characters(spark):
    df = spark.createDataFrame([(1, "a🙂é", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in byte_bpe.encode(df, RANKS, offsets=True).collect()}
    assert list(rows[2].ids) == [] and list(rows[3].ids) == []
    r, own, data = rows[1], byte_bpe.codec(RANKS), "a🙂é".encode()
    for t, b, s, e in zip(r.ids, r.byte_start, r.char_start, r.char_end):
        piece = own.decode(np.array([t]))[1].tobytes()
        assert data[b : b + len(piece)] == piece
        assert piece.decode("utf-8", "ignore") in "a🙂é"[s:e]
    assert byte_bpe.text_of("é".encode()[:1]) == "�"
    back = {x.doc_id: bytes(x.decoded) for x in byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).collect()}
    assert back == {1: data, 2: b"", 3: b""}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS), RANKS).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abc"])
def test_counts_equal_greedy_word_pieces(letters):
    from tokenizers import models

    r = random.Random(len(letters))
    for _ in range(60):
        begin = {"".join(r.choices(letters, k=r.randrange(1, 5))) for _ in range(6)}
        go_on = {"".join(r.choices(letters, k=r.randrange(1, 5))) for _ in range(6)}
        pieces = ["[UNK]", *sorted(begin), *sorted("##" + x for x in go_on)]
        model = models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=10**6)
        own = token_counts.Automaton({x.encode() for x in begin}, {x.encode() for x in go_on})
        some = ["".join(r.choices(letters, k=r.randrange(1, 90))) for _ in range(30)] + ["", "a"]
        some += ["".join(r.choice([*begin, *go_on]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
        expected = [len(model.tokenize(w)) if w else 0 for w in some]
        assert [own.count(w.encode()) for w in some] == expected
        assert own.counts(*raw(pa.array([w.encode() for w in some], pa.large_binary()))).tolist() == expected


def test_count_tokens_of_table(spark):
    df = spark.createDataFrame([(1, "the cat  sat", "x"), (2, None, None), (3, " \n", "y")], "doc_id long, text string, n_words string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = token_counts.automaton(path)
    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(df, path).collect()}
    assert rows == {1: (3, sum(map(own.count, [b"the", b"cat", b"sat"]))), 2: (0, 0), 3: (0, 0)}


def test_words_are_split_at_ascii_space_only():
    ends, index, distinct = words(pa.array([" a\x1cb\tc d ", None, "a", "\x0b\x0c"]))
    own = distinct.to_pylist()
    got = [[own[i].decode() for i in index[a:b]] for a, b in zip(ends[:-1], ends[1:])]
    assert got == [["a\x1cb", "c d"], [], ["a"], []]


def test_word_ids_equal_the_tokenizer():
    r, own = random.Random(9), packing.Encoder(WORDS)
    odd = ["é", "É", "ÿ", "ß", "Þ", "×", "÷", "ª", "µ", "\u0301", "\x85", "\x00", "\x1c", "\x7f", "Σ", "İ", "ſ", "\u212a", "日", "🙂", "<|endoftext|>", "</w>"]
    hard, easy = [*"abzSTAM'sdlvre<|>&09 \n", *odd], [*"abcXYZ09.,&<> ", "É", "ö", "Ø"]
    some = ["".join(r.choices(hard, k=r.randrange(50))) for _ in range(3000)] + ["".join(r.choices(easy, k=r.randrange(50))) for _ in range(3000)]
    some += [*texts(), *odd, "'", "don't 'tis DON'T", "it''s &'s", "x" * 5000, None]
    ends, ids = own.encode(pa.array(some, pa.string()))
    for i, t in enumerate(some):
        assert ids[ends[i] : ends[i + 1]].tolist() == own.model.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert [x.tolist() for x in own.encode(pa.array([], pa.string()))] == [[0], []]
    with pytest.raises(ValueError):  # a byte that begins a character is no word
        own.encode(pa.array([b"a \xc3 b", b"\xc3"]).view(pa.string()))


def test_words_that_differ_in_case_and_signs_are_encoded_once(tmp_path):
    own = packing.Encoder(WORDS)
    said = [f"{a}{word}{b}" for word in ("cat", "CAT", "Été", "été") for a in ("", "(", "[[") for b in ("", ".", "...", "!", ",")]
    own.encode(pa.array([" ".join(said)]))
    assert set(own.kept.places) == {"cat", "été", "(", "[[", ".", "...", "!", ","}
    # a file that keeps case, or cuts elsewhere, is asked for whole words
    with open(WORDS, encoding="utf-8") as f:
        model = json.load(f)
    model["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(model), encoding="utf-8")
    other = packing.Encoder(str(tmp_path / "other.json"))
    ends, ids = other.encode(pa.array(["Cat. cat"]))
    assert other.plain is None and ids.tolist() == other.model.encode("Cat. cat").ids != own.model.encode("Cat. cat").ids
