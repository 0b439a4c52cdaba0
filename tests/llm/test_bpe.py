import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from kymo.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_usual_merges_on_random_text(codec, reference):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdehilnorst thé'  \n12") for _ in range(rng.randrange(80))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x500), rng.randrange(0x3000, 0x9000)])) for _ in range(rng.randrange(30))) for _ in range(800)]
    texts += ["aaaa" * 40, "ababab" * 30, " \t\n ", "\x1c\x85 x", "l'll I've", "٣½", "😀👨‍👩‍👧"]
    got = codec.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]


def test_words_alone_equal_words_together(codec):
    words = [w.encode() for w in (" antidisestablishment", "zzzzzzzz", "ñandúes", "tionstions", "x")]
    assert codec.replay(words) == [codec.alone(w) for w in words]


def test_long_text_in_pieces(codec, reference):
    text = "palabras y más " * 200_000
    assert len(text) > bpe.BLOCK_CHARS
    assert codec.encode([text])[0] == np.array(reference.encode_ordinary(text), "<u4").tobytes()


def test_memory_turns_over(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    texts = [f"alpha{i} beta{i % 3} gamma" for i in range(60)]
    assert [np.frombuffer(codec.encode([t])[0], "<u4").tolist() for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_round_trip_rows(odd_docs, no_docs, reference):
    rows = bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    want = {}
    for r in odd_docs.collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4")
        want.setdefault(r.doc_id, set()).add((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in rows)
    assert bpe.round_trip(no_docs, RANKS, P.PATTERN).collect() == []


def test_encode_then_decode(odd_docs):
    back = bpe.decode(bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((r.text or "").encode() for r in odd_docs.collect())
