"""Importance resampling towards a target text: features hashed to buckets, gains of buckets, a drawn share of the documents.

Each task keeps a trie of words: a path from the root is a run of consecutive words, a feature. A node holds the feature's
count and the CRC-32 state after its bytes, so a longer run's bucket comes from its parent's state and one more word.
A trie over NODES nodes is added up to bucket totals and begun anew, so its memory is bounded. The tasks' totals,
one row a bucket and task, are merged by Spark; from the raw and the target totals each bucket has a gain. A second
pass walks the same paths in tries whose nodes carry their bucket's gain, and sums the gains for each document.

A document is drawn by its weight plus Gumbel noise that hangs on the seed and its doc_id alone. Documents are ranked by
a range sort of their scores (no texts are moved), and each part's first rank is the sum of the earlier parts' sizes.

Defined results: null and empty texts have no features, weight 0 and are too short to be drawn; rows with a null doc_id
have the noise of an empty id and stand after others of their score; repeated rows are rows of their own, and which of them has the lesser rank is
open; with an empty target or no documents all counts are 0 and the formula holds; extra columns are ignored, and carried by resampled() whatever
their names; doc_id may have any type that has an order. A text is handled in one task, with about 100 bytes of memory for each of its words.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, encoded, kept, pieces

BUCKETS, LONGEST, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Nodes of a task's trie before it is added up and begun anew.
NODES = 1 << 18
#: A-Z as a-z; what is no digit, letter or byte of a longer character parts words.
_PLAIN = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class _Roots(dict):
    """Nodes of single words, made when they are first met."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        self[word] = node = self.trie.added(zlib.crc32(word), word)
        return node


class Trie:
    def __init__(self, longest: int):
        self.longest = longest
        self.roots, self.below = _Roots(self), {}
        self.crc, self.last = array("I"), []
        self.count = np.zeros(0, dtype=np.int64)
        self.gain = np.zeros(0, dtype=np.int64)

    def added(self, crc: int, word: bytes) -> int:
        self.crc.append(crc)
        self.last.append(word)
        return len(self.crc) - 1

    def child(self, parent: int, root: int) -> int:
        """The node of a path with one more word, which is given by its own node at the root."""
        found = self.below.get((parent, root))
        if found is None:
            found = self.below[parent, root] = self.added(zlib.crc32(b" " + self.last[root], self.crc[parent]), b"")
        return found

    def paths(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that end a feature, and each one's text number; sizes: words of each text."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        first = np.fromiter(map(self.roots.__getitem__, words), dtype=np.int64, count=len(words))
        nodes, owners, node = [first], [text], first
        for more in range(1, self.longest):
            node = node[: max(0, len(first) - more)]
            inside = text[more:] == text[: len(first) - more] if len(first) > more else np.zeros(0, dtype=bool)
            key, at = np.unique((node[inside] << np.int64(32)) | first[more:][inside], return_inverse=True)
            deeper = np.full(len(node), -1, dtype=np.int64)
            deeper[inside] = np.array([self.child(k >> 32, k & 0xFFFFFFFF) for k in key.tolist()], dtype=np.int64)[at]
            nodes.append(deeper[inside])
            owners.append(text[: len(inside)][inside])
            node = deeper
        return np.concatenate(nodes), np.concatenate(owners)

    def _new(self, held: np.ndarray) -> np.ndarray:
        return np.array(self.crc[len(held) :], dtype=np.int64)

    def learn(self, nodes: np.ndarray) -> None:
        met = np.bincount(nodes, minlength=len(self.crc))
        met[: len(self.count)] += self.count
        self.count = met

    def add_to(self, totals: np.ndarray) -> None:
        np.add.at(totals, np.array(self.crc, dtype=np.int64) % len(totals), self.count)

    def gains_of(self, nodes: np.ndarray, gains: np.ndarray) -> np.ndarray:
        self.gain = np.concatenate([self.gain, gains[self._new(self.gain) % len(gains)]])
        return self.gain[nodes]


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    parted = [t.translate(_PLAIN).split() for t in texts]
    return [w for words in parted for w in words], np.array([len(w) for w in parted], dtype=np.int64)


def totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without one are left out."""

    def run(batches):
        found, trie = np.zeros(buckets, dtype=np.int64), Trie(longest)
        for b in pieces(batches):
            trie.learn(trie.paths(*_words(encoded(b.column("text"))))[0])
            if len(trie.crc) > NODES:
                trie.add_to(found)
                trie = Trie(longest)
        trie.add_to(found)
        at = np.flatnonzero(found)
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int64)), "n": pa.array(found[at])})

    parts = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain from the totals of both texts: as many numbers as buckets, whatever the data."""
    both = []
    for rows in (raw, target):
        found, n = rows.toArrow(), np.zeros(buckets, dtype=np.int64)
        n[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        both.append(n.tolist())
    s, t = both
    high, low = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * high / ((x + 1.0) * low))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_words, n_features and weight of each row."""
    names = ["doc_id", *carried]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        trie = Trie(longest)
        for b in pieces(batches):
            words, sizes = _words(encoded(b.column("text")))
            nodes, owner = trie.paths(words, sizes)
            weight, features = np.zeros(len(sizes), dtype=np.int64), np.bincount(owner, minlength=len(sizes))
            np.add.at(weight, owner, trie.gains_of(nodes, shared.value))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sizes), pa.array(features.astype(np.int64)), pa.array(weight)], names=[*names, "n_words", "n_features", "weight"])
            if len(trie.crc) > NODES:
                trie = Trie(longest)

    chosen = docs.select(*names, F.col("text").cast("string").alias("text"))
    kinds = [*chosen.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]
    return chosen.mapInArrow(run, T.StructType(kinds))


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with a score: the weight and Gumbel noise, in thousandths."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows with a rank: 1, 2, 3 ... for the drawn hundredths of the rows that have enough words, null for others. Reads a stored table."""
    spark = rows.sparkSession
    enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter(enough).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = kept(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "importance-order")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    place = F.col("_first") + F.col("_at") + 1
    chosen = F.when(place <= F.floor(F.col("_all") * share / 100), place).cast("long")
    out = dealt.join(F.broadcast(first), "_part").withColumn("rank", chosen).drop("_part", "_at", "_n", "_first", "_all")
    return out.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def _scores(docs: DataFrame, target: DataFrame, longest: int, buckets: int, carried: tuple[str, ...]) -> DataFrame:
    gain = gains(totals(docs, longest, buckets), totals(target, longest, buckets), buckets)
    return kept(scored(weighed(docs, gain, longest, carried)), "importance-scores")


def report(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document."""
    return ranked(_scores(docs, target, longest, buckets, ())).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents, with their own columns."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))
    scores = _scores(rows, target, longest, buckets, ("row",))
    out = kept(ranked(scores).filter("rank IS NOT NULL").select("row.*"), "importance-drawn")
    dropped(docs.sparkSession, scores)
    return out


SQL = r"""
WITH table_of AS (
  SELECT list(v ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
), texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT 't', 0, NULL, text FROM benchmark
), words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), hexed AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)
), bucketed AS (
  SELECT w, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM hexed, table_of
), counts AS (
  SELECT b.bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t FROM words JOIN bucketed b USING (w) GROUP BY ALL
), sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, sums
), weights AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scores AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (id) WHERE kind = 'd'
), places AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n_long FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n_long // 100 THEN place END AS rank FROM places
"""
