"""The transducer against the public library, and the streaming decoder against decoding at once."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from strandlake.llm import transducer

LETTERS = [chr(i) for i in range(128)] + list("éèüñß中文字日本語кирилл😀🎉​ \u0085　٣४Ⅷ²½ǅʰ") + ["the", "ing", "\n", "aaaa", "  ", "'s", "'ll", "<|endoftext|>"]


def texts(rng, n):
    for _ in range(n):
        yield "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        yield "".join(rng.choice("abcden ") for _ in range(rng.randrange(150)))
        yield rng.choice("a -=!x中") * rng.randrange(300)


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks.rank), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("states", [200_000, 50])
def test_encoder(monkeypatch, name, states):
    monkeypatch.setattr(transducer, "STATES", states)
    monkeypatch.setattr(transducer, "REMEMBERED", 200)
    ranks = transducer.Ranks.parsed(transducer._read(public_tokenizers.path(name)))
    encoder, known = transducer.Encoder(ranks, public_tokenizers.PATTERN), library(ranks)
    for text in texts(random.Random(8), 400):
        assert encoder.encode(text) == known.encode_ordinary(text), text


@pytest.mark.parametrize("seed", range(12))
def test_small_vocabularies(seed):
    """Ranks drawn by chance, with tokens that merges never make and pairs of which several make one token."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 256 + rng.randrange(5, 60):
        new = b"".join(rng.choice(tokens[97:100] + tokens[256:]) for _ in range(rng.choice([2, 2, 2, 3])))
        if new not in tokens and len(new) < 12:
            tokens.append(new)
    ranks = transducer.Ranks({t: i for i, t in enumerate(tokens)})
    encoder, known = transducer.Encoder(ranks, public_tokenizers.PATTERN), library(ranks)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        assert encoder.encode(word) == known.encode_ordinary(word), (tokens[256:], word)


def test_lookahead_is_bounded_and_long_words_are_linear():
    ranks = transducer.Ranks.parsed(transducer._read(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    machine, state, longest, open_bytes = transducer.Transducer(ranks), None, max(map(len, ranks.rank)), 0
    state = machine.start
    for byte in random.Random(1).choices(b"abcdefgh", k=20_000):
        state, _ = state[byte]
        open_bytes = max(open_bytes, *(sum(len(ranks.text[t]) for t in owed) for owed, _ in state.ways))
    assert 0 < open_bytes <= 2 * longest
    word = b"ab" * 400_000
    ids = machine.tokens(word)
    assert b"".join(ranks.text[i] for i in ids) == word and len(ids) <= len(word) / 2


def test_ranks_need_all_bytes():
    with pytest.raises(ValueError, match="without a rank"):
        transducer.Ranks({b"a": 0})


def test_streamed_text(monkeypatch):
    """Cut at any byte, whole and broken UTF-8 gives what decoding at once gives."""
    rng = random.Random(3)
    for _ in range(3000):
        data = "".join(rng.choice("aé中😀\U0010ffffࠀ퟿") for _ in range(rng.randrange(8))).encode()
        if rng.random() < 0.7:
            data = bytes(rng.choice([*data, 0x80, 0xBF, 0xC0, 0xC2, 0xE0, 0xED, 0xA0, 0xF0, 0xF4, 0x90, 0xFF, 0x41]) if rng.random() < 0.3 else b for b in data) + bytes(rng.choices(range(256), k=rng.randrange(3)))
        machine, out, k = transducer.Utf8(), [], 0
        while k < len(data):
            n = rng.randrange(1, 4)
            out.append(machine.feed(data[k : k + n]))
            assert len(machine.held) <= 3
            k += n
        assert "".join([*out, machine.finish()]) == data.decode("utf-8", "replace")


def test_tables(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    long = " ".join(f"word{k % 4001}" for k in range(60_000))
    rows = [(1, "a b"), (1, "a b"), (None, "Über 東京"), (2, None), (3, ""), (4, "<|endoftext|> x"), (5, long), (6, "\x00�\n\n")]
    docs = spark.createDataFrame([(i, t, "i", "n", 7) for i, t in rows], "doc_id bigint, text string, ids string, n_tokens string, `a.b` int").repartition(3)
    ranks = transducer.Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))})
    known = library(ranks)
    want = []
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(known.decode_bytes(ids)).hexdigest()))
    got = transducer.report(docs, path, pattern)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    back = transducer.decoded(transducer.encoded(docs, path, pattern), path, pattern)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    broken = transducer.decoded(spark.createDataFrame([("x", [ranks.rank[b"\xe4"]]), ("y", None)], "doc_id string, ids array<int>"), path, pattern)
    assert sorted(map(tuple, broken.collect())) == [("x", "�"), ("y", "")]
    assert transducer.report(docs.limit(0), path, pattern).collect() == []


def test_transitions_of_a_large_corpus_are_kept():
    """A quarter of a million transitions, which texts of some 20 MB need, do not make a worker begin anew."""
    ranks = transducer.Ranks({bytes([b]): b for b in range(256)})
    machine = transducer.Transducer(ranks)
    first, machine.made = machine.start, 250_000
    assert machine.tokens(b"ab") == [97, 98] and machine.start is first
    machine.made = transducer.STATES + 1
    assert machine.tokens(b"ab") == [97, 98] and machine.start is not first
