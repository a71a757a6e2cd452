"""Suffix-array dedup: remove 50-byte strings that start in a document with a smaller doc_id too.

Prefix doubling ranks text positions by their first h bytes, then by the pair (rank of the
position, rank of the position h on), which covers 2h bytes, and so on until a rank is unique or long
enough. Here h is 25, so the second rank covers the 50 bytes asked for. Two things keep the work
near the input's size. Ranks are names (64-bit hashes of the bytes, then of the pair of names)
instead of places in a sorted order, as only equality counts. And positions take part in the first
round only if they have the least name of some 26 neighbours (so each 50-byte string holds such an
anchor, the same one wherever it stands), one in 13.5; only those whose name is not unique go on.

  round 1  anchors with names in more than one document (the rest is unique and done)
  round 2  name of the anchor's 25 bytes with the 25 before and after: if a smaller document has it,
           every 50-byte string around the anchor is a copy and the stretch goes
  round 3  at the borders of copies, each 50-byte string on its own, as a pair of 25-byte names; the strings around an
           anchor are parts, and a part goes on only if the bytes that all its strings have are in another document too

Defined results: a null text is empty; matches never cross rows; rows that share a doc_id are
one document's rows: they are judged against smaller doc_ids and never against each other; a null
doc_id is larger than any other; doc_id must be a whole number or cast to one; extra columns are ignored; an empty table gives no rows. A text is handled
in one task with about 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bytes, dropped, encoded, kept, mixed, pieces, released, small_batches

LENGTH = 50
HALF = LENGTH // 2
#: Parts of the 50-byte strings around an anchor, by the first and the last number of bytes that they begin before it.
PARTS = ((0, 2), (3, 5), (6, 8), (9, 11), (12, 14), (15, 17), (18, 21), (22, 25))
#: Bits of the filter of names that are not unique. It is of fixed size; what it lets through is joined exactly.
FILTER_BITS = 1 << 27
#: Bytes of text that are worked on at once; arrays of this length fit a core's cache.
PIECE = 1 << 18
_FAR = np.iinfo(np.int64).max
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _window(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], for each i with a whole window."""
    out, done = x, 1
    while 2 * done <= width:
        out = op(out[: len(out) - done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = op(out[: len(out) - rest], out[rest:])
    return out


class Positions:
    """Names of stretches of a batch's texts, and the anchors among its positions."""

    def __init__(self, texts: list[bytes]):
        self.b = Bytes(texts)
        n = len(self.b.data)
        self.doc_end = np.repeat(self.b.ends, self.b.sizes)
        self.doc_start = np.repeat(self.b.starts, self.b.sizes)
        self.n = n

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.b.hashed(start, end)

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """The 25-byte name at each position, and for each 50-byte string the least name in it (0 if it crosses a border)."""
        name = self.b.hashed_all(HALF)
        name[self.doc_end[: len(name)] < np.arange(HALF, len(name) + HALF)] = _MOST
        least = _window(name, HALF + 1, np.minimum) if len(name) > HALF else name[:0]
        least[self.doc_end[: len(least)] < np.arange(len(least)) + LENGTH] = 0
        return name, least

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose 25-byte name is the least of some 50-byte string's, and the names."""
        return self._chosen(*self.least())

    def _chosen(self, name: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n < LENGTH:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        padded = np.concatenate([np.zeros(HALF, np.uint64), least, np.zeros(HALF, np.uint64)])
        chosen = np.flatnonzero(_window(padded, HALF + 1, np.maximum)[: len(name)] == name)
        chosen = chosen[name[chosen] != _MOST]
        return chosen, name[chosen]

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of an anchor with 25 bytes on both sides, as far as its text goes."""
        return np.maximum(at - HALF, self.doc_start[at]), np.minimum(at + 2 * HALF, self.doc_end[at])

    def parts(self, at: np.ndarray, name: np.ndarray, least: np.ndarray) -> np.ndarray:
        """8 bits for each of PARTS, of the bytes that all its strings have; 0 if none of them has this anchor or the text ends before. least: least()[1]."""
        out = np.zeros(len(at), np.uint64)
        for k, (fewest, most) in enumerate(PARTS):
            lo, hi = at - fewest, at - most + LENGTH
            there = np.zeros(len(at), dtype=bool)
            for before in range(fewest, most + 1):
                there |= least[np.clip(at - before, 0, len(least) - 1)] == name
            there &= (lo >= self.doc_start[at]) & (hi <= self.doc_end[at])
            part = np.maximum(self.names(lo[there], hi[there]) & np.uint64(0xFF), np.uint64(1))
            out[there] |= part << np.uint64(8 * k)
        return out


def _of_text(b: pa.RecordBatch):
    return np.asarray(b.column("id")), Positions(encoded(b.column("text")))


def _first_names(rows: DataFrame) -> DataFrame:
    """(name, low, high): anchor names that more than one document has, with the least doc_id."""

    def run(batches):
        for b in pieces(batches, PIECE):
            ids, p = _of_text(b)
            at, name = p.anchors()
            owner = ids[np.searchsorted(p.b.ends, at, side="right")]
            order = np.lexsort((owner, name))
            name, owner = name[order], owner[order]
            if not len(name):
                continue
            new = np.flatnonzero(np.diff(name, prepend=~name[:1]))
            last = np.append(new[1:], len(name)) - 1
            yield pa.record_batch({"name": pa.array(name[new].view(np.int64)), "low": pa.array(owner[new]), "high": pa.array(owner[last])})

    found = rows.mapInArrow(run, "name long, low long, high long")
    return found.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("name")


def _probes(name):
    """Two bit numbers of a name in the filter: for numpy numbers."""
    return name % np.uint64(FILTER_BITS), (name >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _filter(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size with the bits of all keys: bitwise OR by word, at most FILTER_BITS / 64 rows."""

    def run(batches):
        bits = None
        for b in batches:
            if bits is None:
                bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
            for x in _probes(np.asarray(b.column(0)).view(np.uint64)):
                np.bitwise_or.at(bits, x >> np.uint64(3), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        if bits is not None:
            words = bits.view(np.int64)
            at = np.flatnonzero(words)
            yield pa.record_batch({"at": pa.array(at), "bits": pa.array(words[at])})

    found = keys.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _passed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keep = np.ones(len(keys), dtype=bool)
    for x in _probes(keys):
        keep &= (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return keep


def _candidates(rows: DataFrame, bits) -> DataFrame:
    """(name, whole, parts, id, row, at): anchors that pass the filter; whole names the stretch around one, at is its place."""

    def run(batches):
        for b in pieces(batches, PIECE):
            ids, p = _of_text(b)
            names, least = p.least()
            at, name = p._chosen(names, least)
            keep = _passed(bits.value, name)
            at, name = at[keep], name[keep]
            lo, hi = p.around(at)
            # the anchor's place in the stretch counts: near a text's ends it is not in the middle
            whole = mixed(p.names(lo, hi) * np.uint64(3) + (at - lo).astype(np.uint64))
            doc = np.searchsorted(p.b.ends, at, side="right")
            yield pa.record_batch(
                {"name": pa.array(name.view(np.int64)), "whole": pa.array(whole.view(np.int64)), "parts": pa.array(p.parts(at, name, least).view(np.int64)), "id": pa.array(ids[doc]), "row": pa.array(np.asarray(b.column("row"))[doc]), "at": pa.array((at - p.b.starts[doc]).astype(np.int32))}
            )

    return rows.mapInArrow(run, "name long, whole long, parts long, id long, row long, at int")


def _judged(rows: DataFrame, bits) -> DataFrame:
    """(row, at, part): anchors whose whole stretch is a copy (part -1), and parts of others that are to be judged string by string."""
    # one shuffle by name; a document has few anchors of one name, but those of a passage that very many documents share meet in one task
    named, same = Window.partitionBy("name"), Window.partitionBy("name", "whole")
    found = _candidates(rows, bits).withColumns({"low": F.min("id").over(named), "high": F.max("id").over(named), "varied": F.min("whole").over(named) != F.max("whole").over(named)})
    found = found.filter("low < high").withColumn("first", F.min("id").over(same)).filter("first < id OR varied")
    # of documents that share a string the smallest has no copied stretch around it, so copied ones need not meet the others
    part = [F.shiftrightunsigned("parts", 8 * k).bitwiseAND(F.lit(0xFF)) + (k << 8) for k in range(len(PARTS))]
    found = found.select("name", "id", "row", "at", F.explode(F.when(F.col("first") < F.col("id"), F.array(F.lit(-1).cast("long"))).otherwise(F.array(*part))).alias("part"))
    alike = Window.partitionBy("name", "part")
    found = found.filter("part < 0 OR part % 256 > 0").withColumns({"low": F.min("id").over(alike), "high": F.max("id").over(alike)}).filter("part < 0 OR low < high")
    return found.select("row", "at", F.shiftright("part", 8).cast("int").alias("part"))


def _border_strings(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(pair, id, row, at): every 50-byte string of the given parts, named by the pair of its halves' names. judged: (row, at, part)."""
    places = judged.groupBy("row").agg(F.collect_set(F.col("at").cast("long") * len(PARTS) + F.col("part")).alias("places"))

    def run(batches):
        for b in pieces(batches, PIECE):
            texts = Bytes(encoded(b.column("text")))
            listed = b.column("places")
            doc, place = np.repeat(np.arange(len(listed)), np.asarray(pc.list_value_length(listed))), np.asarray(listed.flatten())
            at, part = texts.starts[doc] + place // len(PARTS), place % len(PARTS)
            pos = []
            for k, (fewest, most) in enumerate(PARTS):
                of = np.flatnonzero(part == k)
                first = (at[of, None] - np.arange(fewest, most + 1)).ravel()
                owner = np.repeat(doc[of], most - fewest + 1)
                pos.append(first[(first >= texts.starts[owner]) & (first + LENGTH <= texts.ends[owner])])
            pos = np.unique(np.concatenate(pos))
            pair = mixed(texts.hashed(pos, pos + HALF) * np.uint64(3) + texts.hashed(pos + HALF, pos + LENGTH))
            doc = np.searchsorted(texts.ends, pos, side="right")
            yield pa.record_batch({"pair": pa.array(pair.view(np.int64)), "id": pa.array(np.asarray(b.column("id"))[doc]), "row": pa.array(np.asarray(b.column("row"))[doc]), "at": pa.array((pos - texts.starts[doc]).astype(np.int32))})

    return rows.join(places, "row").select("id", "text", "row", "places").mapInArrow(run, "pair long, id long, row long, at int")


def _found(rows: DataFrame) -> DataFrame:
    """(row, spans): stretches to remove, overlapping, each as 128 times its place plus its length, which is 75 at most; rows: (row, id, text)."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(_filter(_first_names(rows)))
    released(spark)
    judged = kept(_judged(rows, bits), "suffix-judged")
    released(spark)
    copies = judged.filter("part < 0").select("row", F.greatest(F.col("at") - HALF, F.lit(0)).alias("lo"), (F.col("at") + 2 * HALF).alias("hi"))
    borders = _border_strings(rows, judged.filter("part >= 0"))
    single = borders.withColumn("first", F.min("id").over(Window.partitionBy("pair"))).filter("first < id")
    spans = copies.unionByName(single.select("row", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi")))
    out = kept(spans.groupBy("row").agg(F.collect_set(F.col("lo").cast("long") * 128 + F.col("hi") - F.col("lo")).alias("spans")), "suffix-spans")
    dropped(spark, judged)
    released(spark)
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left, binary), n_bytes, n_removed, n_spans and the spans for each row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FAR)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a row's number must not change when the table is read again; doc_id serves if it does not repeat
    repeated = rows.groupBy("id").count().filter("count > 1").head(1)
    rows = rows.withColumn("row", F.xxhash64("id", "text") if repeated else F.col("id"))
    with small_batches(rows.sparkSession):
        found = _found(rows)

    def run(batches):
        for b in pieces(batches, PIECE):
            texts, listed = Bytes(encoded(b.column("text"))), b.column("spans")
            doc = np.repeat(np.arange(len(listed)), np.asarray(pc.fill_null(pc.list_value_length(listed), 0)))
            span = np.asarray(listed.flatten())
            lo = texts.starts[doc] + span // 128
            hi = np.minimum(lo + span % 128, texts.ends[doc])
            n = len(texts.data) + 1
            gone = np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n))[:-1] > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edges = texts.starts[texts.sizes > 0]
            first[edges] = gone[edges]
            counted = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
            n_removed, n_spans = (c[texts.ends] - c[texts.starts] for c in counted)
            rest, ends = texts.data[~gone].tobytes(), np.cumsum(texts.sizes - n_removed)
            left = [rest[e - size : e] for e, size in zip(ends.tolist(), (texts.sizes - n_removed).tolist(), strict=True)]
            yield pa.record_batch(
                {"id": b.column("id"), "kept": pa.array(left, pa.binary()), "n_bytes": pa.array(texts.sizes), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}
            )

    out = rows.join(found, "row", "left").select("id", "text", "spans")
    out = out.mapInArrow(run, "id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("id") != _FAR, F.col("id")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def report(docs: DataFrame) -> DataFrame:
    return removed(docs).drop("kept")
