"""Byte-level BPE: a backtracking encoder in linear time, and decoding by an offset table.

The vocabulary's merges are exact: a sequence of tokens is what the merges give if and only if
each neighbouring pair is compatible, that is, merging would not have joined across their
border. The encoder takes the longest token that an Aho-Corasick automaton finds at a
position; if it is not compatible with the token before it, the next shorter one is tried, and if
none fits, the last token is taken back. A bit per position keeps dead ends from being visited twice.

The vocabulary file is a parameter and is read on the driver; tasks get it as a broadcast.

Defined results: null and empty texts have no tokens; special tokens written in a text are
encoded as such; repeated documents and rows with a null doc_id have results row by row; doc_id must be a whole number or cast to one; of tokens that could be joined at
the same rank the left ones are, as the merges do; extra columns are ignored; an empty table
gives no rows. A text is encoded whole in one task, with about 40 bytes of memory for each of its tokens; a very long word takes time
linear in its length.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: The pattern that parts a text before merges, and the characters that stand for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Words whose tokens a worker remembers: at most this many new ones, and as many of the time before.
REMEMBERED = 60_000
#: Pairs of tokens whose compatibility a worker remembers; at most this many, then it starts anew.
PAIRS = 120_000


def byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes (held as Latin-1 text), their halves, and specials, from a tokenizers JSON file."""

    def __init__(self, spec: dict):
        byte = byte_of_char()
        raw = lambda s: "".join(chr(byte[c]) for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.tokens = {raw(k): v for k, v in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        #: For each token its rank in the merges (single bytes come first) and the two halves it is made of.
        self.rank = {v: -1 for v in self.tokens.values()}
        self.halves = {v: (v, v) for v in self.tokens.values()}
        self.joined = {}
        for k, (a, b) in enumerate(merges):
            x, y = vocab[a], vocab[b]
            both = vocab[a + b]
            self.joined[x, y] = (k, both)
            if self.rank[both] < 0:
                self.rank[both], self.halves[both] = k, (x, y)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text_of = {i: t for t, i in vocabulary.tokens.items()}
        self.sizes = {i: len(t) for i, t in self.text_of.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.tokens.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.widest = max(map(len, vocabulary.tokens), default=0)
        self.pattern = regex.compile(PATTERN)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.shorter: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        if token not in self.shorter:
            t, tokens = self.text_of[token], self.v.tokens
            self.shorter[token] = next((tokens[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in tokens), None)
        return self.shorter[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merges leave the border between the tokens a and b alone.

        Undo the later merge of the two, again and again. Whenever the pair at the border could have
        been joined before the last undone merge took place, joining would have won.
        """
        found = self.compatible.get((a, b))
        if found is None:
            found, x, y, limit = True, a, b, (1 << 40, 0)
            rank, halves, joined = self.v.rank, self.v.halves, self.v.joined
            while True:
                j = joined.get((x, y))
                if j is not None and (j[0], 0) < limit:
                    found = False
                    break
                if rank[x] < 0 and rank[y] < 0:
                    break
                # of equal merges the left one comes first, so the right one is undone first
                if rank[x] > rank[y]:
                    limit, x = (rank[x], 0), halves[x][1]
                else:
                    limit, y = (rank[y], 1), halves[y][0]
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[a, b] = found
        return found

    def longest(self, data: str, at: int) -> int | None:
        """The longest token that starts at a position; None past the end."""
        if at >= len(data):
            return None
        tokens, rest = self.v.tokens, data[at : at + self.widest]
        n = self.automaton.longest_prefix(rest)
        while rest[:n] not in tokens:
            n -= 1
        return tokens[rest[:n]]

    def word(self, data: str) -> list[int]:
        """Tokens of one word, given as Latin-1 text of its bytes."""
        out, pos, pairs = [], 0, self.compatible
        # the longest tokens one after the other, as far as each fits the one before it
        for _, (n, token) in self.automaton.iter_long(data):
            if out:
                last = out[-1]
                fit = pairs.get((last, token))
                if not (self.fits(last, token) if fit is None else fit):
                    break
            out.append(token)
            pos += n
        else:
            return out
        alive = bytearray(b"\1") * (len(data) + 1)
        sizes, shorter = self.sizes, self.shorter
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = pos + sizes[token]
                if alive[end]:
                    fit = last is None or pairs.get((last, token))
                    if fit or (fit is None and self.fits(last, token)):
                        out.append(token)
                        pos, token = end, self.longest(data, end)
                        break
                less = shorter[token] if token in shorter else self.prefix(token)
                if less is not None:
                    token = less
                    continue
                alive[pos] = 0
                token = out.pop()
                pos -= sizes[token]
                break
        return out

    def packed(self, word: str) -> bytes:
        """A word's tokens as uint32, remembered if the word is short."""
        ids = self.known.get(word) or self.earlier.get(word)
        if ids is None:
            ids = array("I", self.word(word.encode().decode("latin-1"))).tobytes()
        if len(word) < 64:
            if len(self.known) >= REMEMBERED:
                self.earlier, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        parts = []
        sections = self.special.split(text) if self.special else [text]
        for k, section in enumerate(sections):
            if k % 2:
                parts.append(np.uint32(self.v.special[section]).tobytes())
                continue
            words = self.pattern.findall(section)
            found = list(map(self.known.get, words))
            if None in found:
                found = [ids if ids is not None else self.packed(w) for w, ids in zip(words, found, strict=True)]
            parts += found
        return np.frombuffer(b"".join(parts), dtype=np.uint32)


class Decoder:
    """All tokens' bytes in one array, and where each token starts."""

    def __init__(self, vocabulary: Vocabulary):
        text = {i: t.encode("latin-1") for t, i in vocabulary.tokens.items()} | {i: t.encode() for t, i in vocabulary.special.items()}
        count = max(text) + 1
        self.sizes = np.array([len(text.get(i, b"")) for i in range(count)], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(text.get(i, b"") for i in range(count)), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.data[at].tobytes().decode("utf-8", "replace").encode()


_made: dict[str, tuple[Encoder, Decoder, list[str]]] = {}


def _tools(key: str, shared) -> tuple[Encoder, Decoder, list[str]]:
    """One encoder a worker process and vocabulary."""
    if key not in _made:
        v = Vocabulary(json.loads(shared.value))
        _made[key] = Encoder(v), Decoder(v), [str(i) for i in range(max([*v.tokens.values(), *v.special.values()]) + 1)]
    return _made[key]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian uint32), n_tokens, and SHA-256 of the ids and of the decoded text."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file

    def run(batches):
        encoder, decoder, decimal = _tools(key, shared)
        for b in pieces(batches):
            rows = []
            for text in b.column("text").to_pylist():
                ids = encoder.encode(text or "")
                listed = ",".join(map(decimal.__getitem__, ids.tolist()))
                rows.append((ids.tobytes(), len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def report(docs: DataFrame, path: str) -> DataFrame:
    return tokenized(docs, path).drop("ids")
