"""BPE by pair occurrences against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symgraph.llm import pairs

SF = "/root/testdata/sf0.001"
LETTERS = [*"aabbccdé éßΣσς ΑΣ İIıſK'stre'll 12٣½  \n\t\x0b\x0c\x1c\x1d\x85  ​̣́̈あ漢👍🏽‍가<|>", "<|endoftext|>", "<|startoftext|>", "\x00", "ẛ̣", "가", "️", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(pairs.TOKENIZER))


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def rows(df):
    return {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()}


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(pairs.round_trip(docs)) == {r["doc_id"]: want(library, r["text"]) for r in docs.collect()}


def test_odd_texts(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert pairs.encode_batch(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    texts = [None, "", "   ", "same", "same", "x" * 5000, "ab" * 3000 + " tail", *texts[:200]]
    schema = "doc_id long, text string, n_tokens string, ids array<string>"
    got = rows(pairs.round_trip(spark.createDataFrame([(i, t, "z", ["q"]) for i, t in enumerate(texts)], schema)))
    assert got == {i: want(library, t) for i, t in enumerate(texts)}
    assert pairs.round_trip(spark.createDataFrame([], schema)).count() == 0
    encoded = pairs.encode(spark.createDataFrame([(i, t, "z", ["q"]) for i, t in enumerate(texts)], schema))
    back = {r["doc_id"]: r["text"] for r in pairs.decode_ids(encoded).collect()}
    assert back == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts)}


def test_stretches_and_forgetting(monkeypatch, library):
    """Small stretches and a small store of chunks change nothing."""
    monkeypatch.setattr(pairs, "STRETCH", 50)
    monkeypatch.setattr(pairs, "KEEP", 100)
    monkeypatch.setattr(pairs, "WORDS", 20)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcde'") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(30))) for _ in range(60)]
    assert pairs.encode_batch(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_long_text(spark, library):
    text = ("Some words of a text that is long, don't cut it. " * 30000) + "z" * 100_000
    got = rows(pairs.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got == {1: want(library, text)}


def test_ranks_in_turn(library):
    """Against merging one word alone: always its lowest pair, the first of equals."""
    v = pairs.load()
    rng = random.Random(6)
    words = list({"".join(rng.choice("aabenrstthi") for _ in range(rng.randrange(1, 14))) for _ in range(500)})
    for word, got in zip(words, v.merge(words)):
        ids = [v.ids[c] for c in [*word[:-1], word[-1] + "</w>"]]
        rank_of = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(v.of_rank)}
        while found := [(rank_of[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank_of]:
            _, i = min(found)
            ids[i : i + 2] = [rank_of[ids[i], ids[i + 1]][1]]
        assert got == ids


def test_unlearned_orders_are_refused(tmp_path):
    with open(public_tokenizers.path(pairs.TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order of learning"):
        pairs.load(str(path))
