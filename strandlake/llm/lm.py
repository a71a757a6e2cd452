"""LM scoring: a smoothed bigram model in Elias-Fano tries, built and queried by shards.

The model is P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU) with P(w) = (c(w) + 1) / (N + V + 1).
Its logarithm is a sum of a part of v alone, a part of w alone and, for pairs seen in training, a part
of the pair. Each part is looked up where its words live, so texts never meet the whole model.

A shard holds the words that hash to it, each with the words seen before it (the trie is read
from the last word back). Level 1 is the Elias-Fano sequence of word numbers, with counts,
quantised log probabilities and monotone Elias-Fano pointers into level 2; level 2 has, for each
word, its predecessors in rising order, relative to that word, with quantised gains. A pair is found by a
successor search within its word's range. The levels lie in one file that the task maps to memory.

Words with over 1 / HOT of all training tokens (so fewer than HOT of them) are dealt to shards by
pair instead, and their own counts go to all tasks; so do the pairs that are as frequent.

Words are 64-bit hashes and predecessors 40 bits of one, so that no dictionary grows on any machine.

Defined results: a null or empty text is its end token alone; each row is a document, also where a
doc_id repeats; a null doc_id trains and is no held-out document; without training documents all
counts are 0; extra columns are ignored; an empty table gives no rows; doc_id must be a whole number or cast to one; nothing is ranked, so there
are no ties. A text is handled in one task with about 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Bytes, dropped, encoded, kept, mixed, pieces, released, small_batches

MU = 20.0
END, BEGIN = np.uint64(0x1F0E5F2B7C3A9D41), np.uint64(0x7A2D11C8E90B6653)
#: Bits of a predecessor's hash that the tries keep.
BEFORE = np.uint64(40)
#: Distinct n-grams that a task sums up before it hands them on.
HELD = 400_000
#: A model has this many shards at least, and so many that a shard has this many training tokens at most on average.
SHARDS, PER_SHARD = 48, 16_000_000


# ---------------------------------------------------------------------------- Elias-Fano
def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one of a given rank in each 64-bit word, by halving."""
    at = np.zeros(len(words), dtype=np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << half) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = rank >= count
        rank = rank - np.where(up, count, 0)
        words = np.where(up, words >> np.uint64(half), low)
        at += half * up
    return at


class EliasFano:
    """A rising sequence of numbers: low bytes as they are, high parts as gaps in unary.

    The sequence stays packed. Beside it stands how many ones there are before each 64-bit word of the
    unary part, from which ones and zeros are found by rank.
    """

    def __init__(self, n: int, width: int, unary: np.ndarray, low: np.ndarray):
        self.n, self.width, self.unary, self.low = n, np.uint64(width), unary, low
        self.mask = np.uint64((1 << width) - 1)
        ends = np.cumsum(np.bitwise_count(unary), dtype=np.int64)
        self.ones = (ends - np.bitwise_count(unary)).astype(np.uint32)
        self.zeros = (64 * np.arange(len(unary)) - self.ones).astype(np.uint32)
        self.n_zeros = 64 * len(unary) - n

    @staticmethod
    def packed(values: np.ndarray, universe_bits: int) -> bytes:
        n = len(values)
        width = min(56, max(0, -(-(universe_bits - max(n, 1).bit_length() + 1) // 8) * 8))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 64 if n else 64) // 64 * 64, dtype=np.uint8)
        bits[ones] = 1
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : width // 8]
        unary = np.packbits(bits, bitorder="little").tobytes()
        low = low.tobytes() + bytes(8)
        return struct.pack("<qqq", n, width, len(unary) // 8) + unary + low + b"\0" * (-len(low) % 8)

    @classmethod
    def opened(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, width, size = struct.unpack("<qqq", data[at : at + 24].tobytes())
        at += 24
        unary = data[at : at + 8 * size].view(np.uint64)
        at += 8 * size
        size = n * (width // 8) + 8
        # numbers of width bits, each read as the 8 bytes from its first on
        low = np.ndarray((n,), "<u8", data[at : at + size], 0, (width // 8,))
        return cls(n, width, unary, low), at + size + -size % 8

    def __len__(self) -> int:
        return self.n

    def at(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        place = 64 * word + _in_word(self.unary[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << self.width) | (self.low[i] & self.mask)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part under the given one."""
        out = np.where(high > 0, self.n, 0)
        todo = np.flatnonzero((high > 0) & (high <= self.n_zeros))
        rank = high[todo].astype(np.int64) - 1
        word = np.searchsorted(self.zeros, rank.astype(np.uint32), side="right") - 1
        out[todo] = 64 * word + _in_word(~self.unary[word], rank - self.zeros[word]) - rank
        return out

    def successor(self, first: np.ndarray, last: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each query the first place in [first, last) whose value is at least x, else last."""
        high, low = x >> self.width, x & self.mask
        lo = np.clip(self._below(high), first.astype(np.int64), last.astype(np.int64))
        hi = np.clip(self._below(high + np.uint64(1)), lo, last.astype(np.int64))
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = (self.low[mid] & self.mask) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return lo


def quantised(x: np.ndarray) -> tuple[float, float, np.ndarray]:
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return low, step, np.rint((x - low) / step).astype(np.uint8)


class Trie:
    """The levels of one shard; built() packs them, opened() maps them to memory."""

    @staticmethod
    def built(words: np.ndarray, counts: np.ndarray, pairs_of: np.ndarray, before: np.ndarray, gains: np.ndarray, logs: np.ndarray, contexts: np.ndarray) -> bytes:
        """words: rising; pairs_of: for each pair the place of its word, rising; before: the predecessor's 40 bits, rising within a word."""
        starts = np.searchsorted(pairs_of, np.arange(len(words) + 1)).astype(np.uint64)
        parts = [EliasFano.packed(words, 64), EliasFano.packed(starts, int(starts[-1]).bit_length() if len(starts) else 1)]
        keys = (pairs_of.astype(np.uint64) << BEFORE) | before.astype(np.uint64)
        parts.append(EliasFano.packed(keys, int(BEFORE) + len(words).bit_length()))
        for x in (logs, contexts, gains):
            low, step, code = quantised(x)
            parts.append(struct.pack("<qdd", len(code), low, step) + code.tobytes())
        parts.append(struct.pack("<q", len(counts)) + counts.astype(np.uint64).tobytes())
        return b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def opened(cls, data: bytes) -> Trie:
        out, at, up = cls(), 0, lambda n: n + -n % 8
        with os.fdopen(os.memfd_create("trie"), "w+b") as f:  # a file in memory, which goes with the mapping
            f.write(data)
            f.flush()
            mapped = np.memmap(f, dtype=np.uint8, mode="r")
        out.words, at = EliasFano.opened(mapped, at)
        out.starts, at = EliasFano.opened(mapped, up(at))
        out.keys, at = EliasFano.opened(mapped, up(at))
        at = up(at)
        for name in ("logs", "contexts", "gains"):
            n, low, step = struct.unpack("<qdd", mapped[at : at + 24].tobytes())
            setattr(out, name, (mapped[at + 24 : at + 24 + n], low, step))
            at = up(at + 24 + n)
        n = struct.unpack("<q", mapped[at : at + 8].tobytes())[0]
        out.counts = mapped[at + 8 : at + 8 + 8 * n].view(np.uint64)
        return out

    def value(self, name: str, i: np.ndarray) -> np.ndarray:
        code, low, step = getattr(self, name)
        return low + step * code[i].astype(np.float64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place and whether it is there."""
        n = len(self.words)
        if not n:
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        i = self.words.successor(np.zeros(len(words), np.int64), np.full(len(words), n), words)
        i, inside = np.minimum(i, n - 1), i < n
        return i, inside & (self.words.at(i) == words)

    def find_pairs(self, place: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (place of a word, predecessor) the pair's place and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        first, last = self.starts.at(place), self.starts.at(place + 1)
        x = (place.astype(np.uint64) << BEFORE) | before.astype(np.uint64)
        i = self.keys.successor(first, last, x)
        there = i < last.astype(np.int64)
        i = np.minimum(i, len(self.keys) - 1)
        return i, there & (self.keys.at(i) == x)


# ---------------------------------------------------------------------------- tokens
def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, the token before it and text number, for all tokens of a batch, ends included."""
    b = Bytes(texts, lower=True)
    s, e, doc = b.words()
    at = np.arange(len(s)) + doc  # each text before has one end token
    total = len(s) + len(texts)
    w, d = np.full(total, END, dtype=np.uint64), np.zeros(total, dtype=np.int64)
    w[at] = b.hashed(s, e)
    d[at] = doc
    ends = np.searchsorted(doc, np.arange(len(texts)), side="right") + np.arange(len(texts))
    d[ends] = np.arange(len(texts))
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[0:1] = BEGIN
    v[ends[:-1] + 1] = BEGIN
    return w, v, d


def pair_key(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(w * np.uint64(3) + mixed(v))


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of keys (major first) as one, with the sum of n."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    if not len(n):
        return keys, n
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n, at)


_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.float64)


def _least(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the smallest kind that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(k for k in _KINDS[:4] if top <= np.iinfo(k).max))


def _bytes(*arrays: np.ndarray) -> bytes:
    head = [x for a in arrays for x in (_KINDS.index(a.dtype.type), len(a))]
    return struct.pack(f"<{1 + len(head)}I", len(arrays), *head) + b"".join(a.tobytes() for a in arrays)


def _arrays(blob: bytes) -> list[np.ndarray]:
    count = struct.unpack_from("<I", blob)[0]
    head, at, out = struct.unpack_from(f"<{2 * count}I", blob, 4), 4 + 8 * count, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(blob, _KINDS[kind], size, at))
        at += out[-1].nbytes
    return out


def _shortened(v: np.ndarray) -> np.ndarray:
    return v >> (np.uint64(64) - BEFORE)


def _halved(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 40 bits in 5 bytes."""
    return (v >> np.uint64(8)).astype(np.uint32), v.astype(np.uint8)


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(8)) | low


class Model:
    """The numbers that every task needs; of fixed size."""

    def __init__(self, shards: int, n: int, v: int, texts: int, hot: list[tuple[int, int]]):
        self.shards, self.n, self.v, self.texts = shards, n, v, texts
        rows = sorted((w & (2**64 - 1), c) for w, c in hot)
        self.hot_words = np.array([w for w, _ in rows], dtype=np.uint64)
        self.hot_counts = np.array([c for _, c in rows], dtype=np.int64)
        self.pair_keys, self.pair_gains = np.zeros(0, np.uint64), np.zeros(0)

    def log_p(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1.0))

    def gain(self, pair: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What a pair seen `pair` times adds to a word seen c times."""
        return np.log10(pair / (MU * 10.0 ** self.log_p(c)) + 1.0)

    def hot_count(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot_words):
            return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        i = np.minimum(np.searchsorted(self.hot_words, w), len(self.hot_words) - 1)
        return self.hot_counts[i], self.hot_words[i] == w

    def shard(self, w: np.ndarray, v: np.ndarray, hot: np.ndarray) -> np.ndarray:
        return (np.where(hot, pair_key(w, v), mixed(w)) % np.uint64(self.shards)).astype(np.int64)


def _split(shard: np.ndarray, arrays: list[np.ndarray]):
    """(shard number, arrays) for each shard, in the order given."""
    order = np.argsort(shard, kind="stable")
    shard, arrays = shard[order], [a[order] for a in arrays]
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    for s, e in zip(at, np.append(at, len(shard))[1:], strict=True):
        yield int(shard[s]), [a[s:e] for a in arrays]


class Sums:
    """Counts of n-grams within a task, summed up whenever their number has doubled."""

    def __init__(self):
        self.rows, self.size, self.limit = [], 0, 2 * HELD

    def add(self, keys: list[np.ndarray], n: np.ndarray):
        self.rows.append((keys, n))
        self.size += len(n)
        if self.size > self.limit:
            self.squeeze()
            self.limit = 2 * max(HELD, self.size)

    def squeeze(self):
        if len(self.rows) > 1:
            keys = [np.concatenate(k) for k in zip(*(r[0] for r in self.rows), strict=True)]
            counts, self.rows = np.concatenate([r[1] for r in self.rows]), []
            self.rows = [summed(keys, counts)]
            self.size = len(self.rows[0][1])

    def take(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        self.squeeze()
        out, self.rows, self.size, self.limit = (self.rows[0] if self.rows else None), [], 0, 2 * HELD
        return out


def _texts(batches, train_only: bool):
    for b in pieces(batches):
        if train_only:
            b = b.filter(b.column("train"))
        if b.num_rows:
            yield b


def unigrams(docs: DataFrame) -> DataFrame:
    """(w, c): how often each token stands in the training texts."""

    def run(batches):
        sums = Sums()
        for b in _texts(batches, True):
            w, n = np.unique(tokens(encoded(b.column("text")))[0], return_counts=True)
            sums.add([w], n)
            if sums.size > HELD:
                sums.squeeze()
                if sums.size > HELD:
                    yield packed(sums.take())
        if (rest := sums.take()) is not None:
            yield packed(rest)

    def packed(x):
        return pa.record_batch({"w": pa.array(x[0][0].view(np.int64)), "c": pa.array(x[1].astype(np.int64))})

    return docs.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


BLOB = "shard int, kind int, blob binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, blob = zip(*rows, strict=True)
    return pa.record_batch({"shard": pa.array(shard, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _streams(df: DataFrame, shards: int) -> DataFrame:
    """Each shard's rows together in one task, in the order of their kind."""
    return df.repartition(shards, "shard").sortWithinPartitions("shard", "kind")


def _by_shard(batches):
    """(shard, kind, blob), row by row."""
    for b in batches:
        yield from zip(b.column("shard").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True)


def tries(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(shard, trie, hot): hot has the shard's pairs that are over 1 / HOT of all tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def words(batches):
        m = shared.value
        for b in batches:
            w, c = np.asarray(b.column("w")).view(np.uint64), np.asarray(b.column("c"))
            cold = ~m.hot_count(w)[1]
            w, c = w[cold], c[cold]
            if rows := [(s, 0, _bytes(*x)) for s, x in _split(m.shard(w, w, np.zeros(len(w), bool)), [w, c])]:
                yield _rows(rows)

    def pairs(batches):
        m, sums = shared.value, Sums()

        def out():
            found = sums.take()
            if found is None:
                return
            (w, v), n = found
            rows = []
            for s, (ws, vs, ns) in _split(m.shard(w, v, m.hot_count(w)[1]), [w, v, n]):
                at = np.flatnonzero(np.diff(ws, prepend=~ws[:1]))
                rows.append((s, 1, _bytes(ws[at], _least(np.diff(np.append(at, len(ws)))), *_halved(_shortened(vs)), _least(ns))))
            yield _rows(rows)

        for b in _texts(batches, True):
            w, v, _ = tokens(encoded(b.column("text")))
            sums.add(*summed([w, v], np.ones(len(w), np.int64)))
            if sums.size > HELD:
                sums.squeeze()
                if sums.size > HELD:
                    yield from out()
        yield from out()

    def build(batches):
        m, at, held, ws, cs = shared.value, None, Sums(), [], []

        def done():
            words = np.concatenate([*ws, np.zeros(0, np.uint64)])
            counts = np.concatenate([*cs, np.zeros(0, np.int64)])
            found = held.take()
            (w, v), n = found if found is not None else ([np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64))
            hot_c, hot = m.hot_count(w)
            extra = np.unique(w[hot])
            words, counts = np.concatenate([words, extra]), np.concatenate([counts, m.hot_count(extra)[0]])
            order = np.argsort(words)
            words, counts = words[order], counts[order]
            place = np.searchsorted(words, w)
            c = counts[place] if len(w) else np.zeros(0, np.int64)
            trie = Trie.built(words, counts, place, v, m.gain(n, c), m.log_p(counts), np.log10(counts + MU))
            often = n * float(HOT) > m.n
            return at, trie, _bytes(w[often], v[often], m.gain(n, c)[often])

        def row(x):
            return pa.record_batch({"shard": pa.array([x[0]], pa.int32()), "trie": pa.array([x[1]], pa.binary()), "hot": pa.array([x[2]], pa.binary())})

        for shard, kind, blob in _by_shard(batches):
            if shard != at:
                if at is not None:
                    yield row(done())
                at, held, ws, cs = shard, Sums(), [], []
            if kind == 0:
                w, c = _arrays(blob)
                ws.append(w)
                cs.append(c)
            else:
                w, runs, high, low, n = _arrays(blob)
                held.add([np.repeat(w, runs), _whole(high, low)], n.astype(np.int64))
        if at is not None:
            yield row(done())

    both = docs.mapInArrow(pairs, BLOB).unionByName(counts.mapInArrow(words, BLOB))
    return _streams(both, model.shards).mapInArrow(build, "shard int, trie binary, hot binary")


SUMS = "rid long, doc_id long, n_tokens long, n_known long, base double, score double"


def scores(docs: DataFrame, built: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, and sums of log10(c + 1) and of the model's log10, for each row number rid."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches):
        m = shared.value
        for b in _texts(batches, False):
            rid, ids = np.asarray(b.column("rid")), b.column("doc_id")
            w, v, d = tokens(encoded(b.column("text")))
            n_docs = len(rid)
            n_tokens = np.bincount(d, minlength=n_docs)
            c, hot = m.hot_count(w)
            # what each token gives as a context, if its word is hot; the text's begin is a context too
            own = np.where(w != END, m.log_p(c) - np.log10(c + MU), m.log_p(c)) + np.log10(MU)
            sums = lambda x, at, d=d, n=n_docs: np.bincount(d[at], weights=x[at], minlength=n).astype(np.float64)
            score = sums(own, hot) - np.log10(m.texts + MU)
            base, known = sums(np.log10(c + 1.0), hot), np.bincount(d[hot & (c > 0)], minlength=n_docs)
            key = pair_key(w, _shortened(v))
            if len(m.pair_keys):
                i = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
                often = m.pair_keys[i] == key
                score += sums(m.pair_gains[i], often)
            else:
                often = np.zeros(len(w), dtype=bool)
            ask = ~often  # such pairs end in hot words; all that they add is known here
            w, v, d = w[ask], v[ask], d[ask]
            shard = m.shard(w, v, hot[ask])
            (shard, w, v, d), n = summed([shard, w, _shortened(v), d], np.ones(len(w), np.int64))
            rows = []
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            for s, e in zip(at, np.append(at, len(shard))[1:], strict=True):
                ws = w[s:e]
                first = np.flatnonzero(np.diff(ws, prepend=~ws[:1]))
                who, place = np.unique(d[s:e], return_inverse=True)
                of = _least(rid[who] - rid[0]) if rid[-1] - rid[0] == n_docs - 1 else rid[who] - rid[0]
                rows.append((int(shard[s]), 1, _bytes(ws[first], _least(np.diff(np.append(first, len(ws)))), *_halved(v[s:e]), _least(place), _least(n[s:e]), rid[:1], of)))
            none = np.asarray(ids.is_null()).astype(np.uint8)
            rows.append((int(rid[0]) % m.shards, 2, _bytes(rid, np.asarray(ids.fill_null(0)), none, _least(n_tokens), _least(known), base, score)))
            yield _rows(rows)

    def answer(batches):
        at, trie = None, None
        m = shared.value
        for shard, kind, blob in _by_shard(batches):
            if kind == 0:
                at, trie = shard, Trie.opened(blob)
                continue
            if kind == 2:
                rid, ids, none, n_tokens, known, base, score = _arrays(blob)
                long = lambda x: pa.array(x.astype(np.int64))
                yield pa.record_batch({"rid": pa.array(rid), "doc_id": pa.array(ids, mask=none == 1), "n_tokens": long(n_tokens), "n_known": long(known), "base": pa.array(base), "score": pa.array(score)})
                continue
            if at != shard:
                at, trie = shard, Trie.opened(Trie.built(*[np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64, float, float, float)]))
            ws, runs, high, low, d, n, first, of = _arrays(blob)
            rid = first + of.astype(np.int64)
            place, there = trie.find(ws)
            hot = m.hot_count(ws)[1]
            c = np.where(there, trie.counts[place].astype(np.float64) if len(trie.counts) else 0.0, 0.0)
            if len(trie.counts):
                log_p = np.where(there, trie.value("logs", place), m.log_p(np.zeros(1))[0])
                context = np.where(there, trie.value("contexts", place), np.log10(MU))
            else:
                log_p, context = np.full(len(ws), m.log_p(np.zeros(1))[0]), np.full(len(ws), np.log10(MU))
            each = lambda x: np.repeat(x, runs)
            cold = each(~hot)
            score = np.where(cold, each(log_p + np.log10(MU) - np.where(ws != END, context, 0.0)), 0.0)
            which = each(there)
            if which.any():
                i, found = trie.find_pairs(each(place)[which], _whole(high, low)[which])
                score[which] += np.where(found, trie.value("gains", i), 0.0)
            weights = lambda x: np.bincount(d, weights=x * n, minlength=len(rid)).astype(np.float64)
            zero = np.zeros(len(rid), np.int64)
            known = weights((each(c > 0) & cold).astype(np.float64)).astype(np.int64)
            base = weights(np.where(cold, each(np.log10(c + 1.0)), 0.0))
            yield pa.record_batch({"rid": pa.array(rid), "doc_id": pa.nulls(len(rid), pa.int64()), "n_tokens": pa.array(zero), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(weights(score))})

    model_rows = built.select("shard", F.lit(0).alias("kind"), F.col("trie").alias("blob"))
    both = docs.mapInArrow(ask, BLOB).unionByName(model_rows)
    parts = _streams(both, model.shards).mapInArrow(answer, SUMS)
    return parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])


def held_out_rows() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def report(docs: DataFrame, shards: int | None = None) -> DataFrame:
    with small_batches(docs.sparkSession):
        return _report(docs, shards)


def _report(docs: DataFrame, shards: int | None) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (~held_out_rows()).alias("train"))
    texts = rows.select("text", "train")
    counts = kept(unigrams(texts), "lm-unigrams")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("c"))), F.lit(0)).alias("texts")).first()
    hot = counts.filter(F.col("c") * HOT > total["n"]).collect()  # fewer than HOT
    model = Model(shards or max(SHARDS, -(-total["n"] // PER_SHARD)), total["n"], total["v"], total["texts"], [(r["w"], r["c"]) for r in hot])
    built = kept(tries(texts, counts, model), "lm-tries")
    found = [_arrays(r["hot"]) for r in built.select("hot").toLocalIterator()]  # fewer than HOT pairs in all
    if found:
        w, v, gain = (np.concatenate(x) for x in zip(*found, strict=True))
        key = pair_key(w, v)
        order = np.argsort(key)
        model.pair_keys, model.pair_gains = key[order], gain[order]
    dropped(spark, counts)
    released(spark)
    # rows are numbered in the one pass that asks; the answers come back under the numbers
    sums = kept(scores(rows.withColumn("rid", F.monotonically_increasing_id()), built, model), "lm-scores")
    dropped(spark, built)
    out = sums.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))).alias("base_score"), "score")
    return out.select("doc_id", held_out_rows().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
