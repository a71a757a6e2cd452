"""SimHash near-dedup at a similarity: texts whose sets of 5-word shingles have a Jaccard similarity of at least 4/5.

The first round begins with SimHash's own, as in simhash.py: fingerprints that differ in up to 3 bits meet in a pigeonhole block and are linked there. But texts at that
similarity differ in some ten of 64 bits, too many for such blocks: any choice of blocks that keeps them together makes thousands of
keys a text, or keys of a few bits. So the pairs that are left to find meet under keys of MinHash values of the same
shingles: a pair of similarity 4/5 shares one of BANDS keys with probability 0.99995, a closer one more often. What meets in
a key is verified by Hamming distance of the SimHash fingerprints and by size (over four standard deviations below the similarity). The links of
all rounds are verified on the shingles themselves, so no other texts are linked.

No key makes all pairs of its texts, and none is gathered in one task. The first round, whose pairs are checked together with those of the blocks, draws one text of each key by a hash, in a few bands, and compares
a text with the closest of those that it meets; links found join texts to components, so a large group of near copies costs one pair a
text. Later rounds look only at keys that hold texts of several components. There, up to LARGE texts are compared pair by pair; of a larger key ROOTS texts are
drawn, and a text is compared with the closest of all that its larger keys have.

What the texts of such larger keys still may have in common is then found exactly, by their rarest shingles. With shingles in the order of how many of these texts have
them, two texts at the similarity share one of the first fifth of each, so a text whose first fifth is its own alone is done. The texts that share
such a shingle are cut into blocks of BLOCK texts; the blocks that hold texts outside of the shingle's largest component meet all its blocks, and
whole arrays of a pair of blocks are compared at once: component, size, place of the shingle, and bits. First each text's closest one of another component is
checked, then, with components joined, all that are left. So no partner is left out for being one of many.

Defined results: words are parted by ASCII space and compared without ASCII case; texts of under five
words have one shingle, the whole sequence; texts without words (null ones too) have one common shingle; equal texts, told by a 64-bit hash, are
one node. A group's representative has the least doc_id, nulls last, then the least text hash, so ids may be null or repeat;
of rows with one text and doc_id the one with the least hash of all columns stays. All columns are carried. A text is handled in one
task, with about 150 bytes of memory for each of its words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bytes, columns, dropped, encoded, kept, mixed, pieces, released, small_batches
from .simhash import components, links

WORDS, BANDS, ROWS = 5, 25, 5
#: Pairs with more different bits have a similarity under 4/5: some ten bits are expected, 28 are over six standard deviations more.
DISTANCE = 28
#: Bands of the first round; texts in a key that are compared pair by pair; texts that a larger key's are compared with; texts of a block.
FIRST, LARGE, ROOTS, BLOCK = 6, 32, 6, 256

_rng = np.random.Generator(np.random.PCG64(20240311))
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.arange(64, dtype=np.uint64)


def _joined(parts, first: int = 0) -> np.ndarray:
    """One number for each sequence of numbers; parts are the sequences' first numbers, second numbers and so on."""
    h = np.full(len(parts[0]), first, dtype=np.uint64)
    for p in parts:
        h = mixed(h * _STEP + p)
    return h


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, one text after the other, and where each text begins; one more at the end."""
    b = Bytes(texts, lower=True)
    start, end, text = b.words()
    words = b.hashed(start, end)
    n = max(0, len(words) - WORDS + 1)
    grams = _joined([words[k : k + n] for k in range(WORDS)])
    last = np.cumsum(np.bincount(text, minlength=len(texts)))
    out = []
    for s, e in zip(np.concatenate([[0], last[:-1]]), last, strict=True):
        if e - s >= WORDS:
            out.append(np.unique(grams[s : e - WORDS + 1]))
        else:
            out.append(_joined([words[k : k + 1] for k in range(s, e)]) if e > s else np.zeros(1, dtype=np.uint64))
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def fingerprints_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's shingles."""
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = np.add.reduceat(bits, at[:-1], axis=0, dtype=np.int64)
    return ((2 * ones > np.diff(at)[:, None]).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketched(batches):
    for b in pieces(batches):
        h, at = shingles_of(encoded(b.column("text")))
        least = np.stack([np.minimum.reduceat((h ^ x) * a, at[:-1]) for x, a in zip(_XOR, _ODD, strict=True)])
        keys = np.stack([_joined(least[k * ROWS : (k + 1) * ROWS], k + 1) for k in range(BANDS)], axis=1)
        yield pa.record_batch({"node": b.column("node"), "n": pa.array(np.diff(at)), "fp": pa.array(fingerprints_of(h, at).view(np.int64)), "keys": _lists(keys.ravel(), np.arange(b.num_rows + 1) * BANDS)})


def _shingled(batches):
    for b in pieces(batches):
        h, at = shingles_of(encoded(b.column("text")))
        yield pa.record_batch({"node": b.column("node"), "shingles": _lists(h, at)})


def _may(x: str, y: str) -> str:
    """SQL: two texts of different components that can have the similarity."""
    return f"{x}.owner <> {y}.owner AND bit_count({x}.fp ^ {y}.fp) <= {DISTANCE} AND 5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n)"


def _keys(sketches: DataFrame, bands: int) -> DataFrame:
    return sketches.select(F.explode(F.slice("keys", 1, bands)).alias("key"), F.struct("node", "fp", "n", "owner").alias("me"))


def _candidates(sketches: DataFrame, bands: int, roots: int, pairwise: int, salt: int) -> DataFrame:
    """(a, b): pairs of texts of a key in different components, b the lesser. pairwise: most texts of a key that are compared pair by pair."""
    rows = _keys(sketches, bands)
    drawn = [F.min_by("me", F.xxhash64(F.col("me.node"), "key", F.lit(salt * ROOTS + k))) for k in range(roots)]
    seen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("me.owner").alias("low"), F.max("me.owner").alias("high"), F.array(*drawn).alias("roots"))
    # a small key's texts all go on; those of a large one only if a root may be a partner
    seen = seen.filter("low < high").select(F.col("key").alias("k"), "size", "roots")
    fits = F.expr(f"size <= {pairwise} OR exists(roots, r -> {_may('r', 'me')})")
    met = rows.join(seen, (F.col("key") == F.col("k")) & fits)
    # one pair a text: of the roots of all its large keys the one with the fewest different bits
    closest = F.expr(f"array_min(transform(filter(roots, r -> {_may('r', 'me')}), r -> struct(bit_count(r.fp ^ me.fp), r.node)))")
    found = met.filter(F.col("size") > pairwise).select(F.col("me.node").alias("x"), closest.alias("r")).groupBy("x").agg(F.min("r").alias("r")).select("x", F.col("r.node").alias("y"))
    if pairwise:
        groups = met.filter(F.col("size") <= pairwise).groupBy("key").agg(F.array_sort(F.collect_list("me")).alias("m"))
        later = f"filter(slice(m, i + 2, size(m)), y -> {_may('x', 'y')})"
        found = found.unionByName(groups.select(F.expr(f"inline(flatten(transform(m, (x, i) -> transform({later}, y -> struct(x.node AS x, y.node AS y)))))")))
    return _pairs(found)


def _blocked(sketches: DataFrame) -> DataFrame:
    """(a, b): links that connect all texts whose fingerprints are within SimHash's distance, directly or by a chain; b the lesser."""
    nodes = kept(sketches.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp"), "near-prints")
    same = sketches.select(F.col("node").alias("x"), "fp").join(nodes.withColumnRenamed("node", "y"), "fp").filter("x <> y").select("x", "y")
    near = links(nodes).toDF("x", "y")
    pairs = _pairs(near.unionByName(same))
    dropped(sketches.sparkSession, near, nodes)
    return pairs


def _pairs(found: DataFrame) -> DataFrame:
    """(x, y) as a stored table (a, b), b the lesser, each pair once."""
    return kept(found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "near-pairs")


def _shingles(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes."""
    texts = docs.join(nodes, "node", "left_semi")
    return kept(texts.mapInArrow(_shingled, "node long, shingles array<long>").dropDuplicates(["node"]), "near-shingles")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share 4/5 of their shingles; pairs are deleted."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    found = kept(both.filter(F.expr("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))")).select("a", "b"), "near-links")
    dropped(pairs.sparkSession, pairs)
    return found


def _checked(docs: DataFrame, *found: DataFrame) -> DataFrame:
    """The links among the pairs (a, b) that one or more rounds found; these are deleted."""
    pairs = found[0]
    if len(found) > 1:
        pairs = kept(reduce(lambda a, b: a.unionByName(b), found).distinct(), "near-pairs")
        dropped(docs.sparkSession, *found)
    sets = _shingles(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    found = _alike(pairs, sets)
    dropped(pairs.sparkSession, sets)
    return found


def _joined_by(owners: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, owner) of the components that links make together with those so far; both are deleted."""
    if owners is not None and not links.head(1):
        dropped(links.sparkSession, links)
        return owners
    # the links so far and the components they make are the same thing
    edges = links if owners is None else owners.toDF("a", "b").unionByName(links)
    out = components(edges).toDF("node", "owner")
    dropped(links.sparkSession, links, *([] if owners is None else [owners]))
    return out


def _owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    return rows.join(owners, "node", "left").withColumn("owner", F.coalesce("owner", "node"))


def _first_fifths(sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """(token, node, fp, n, pos): for each text the shared ones among its first shingles, by how many of the texts have them, then by value.

    A text of n shingles has n - ceil(4n/5) + 1 first ones; two texts at the similarity share one of these.
    """
    tokens = sets.select("node", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    # shingles of one text alone come before all these
    rows = shared.join(sketches.select("node", "fp", "n"), "node").withColumn("alone", F.col("n") - F.size("t"))
    first = rows.withColumn("t", F.expr("slice(t, 1, greatest(0, int(n - (4 * n + 4) div 5 + 1 - alone)))"))
    return first.select("node", "fp", "n", "alone", F.posexplode("t").alias("i", "t")).select("t.token", "node", "fp", "n", (F.col("alone") + F.col("i")).alias("pos"))


def _met(closest: bool):
    """Rows (x, y) of two blocks' texts (node, owner, fp, n, pos) to pairs of different components; closest: one for each text only."""

    def columns_of(lists, k):
        flat, at = lists.values, np.asarray(lists.offsets)
        return [np.asarray(flat.field(j)).astype(np.int64)[at[k] : at[k + 1]] for j in range(5)]

    def run(batches):
        for batch in batches:
            found = [np.zeros((2, 0), dtype=np.int64)]
            for k in range(batch.num_rows):
                node, owner, fp, n, pos = columns_of(batch.column("x"), k)
                other, of, bits, m, at = columns_of(batch.column("y"), k)
                # numpy counts the bits of a signed number's absolute value
                apart = np.bitwise_count((fp[:, None] ^ bits[None, :]).view(np.uint64)).astype(np.int64)
                size = n[:, None] + m[None, :]
                may = (owner[:, None] != of[None, :]) & (apart <= DISTANCE)
                # at the first shingle that both have, no more are shared than what follows it
                may &= 9 * np.minimum((n - pos)[:, None], (m - at)[None, :]) >= 4 * size
                may &= 5 * np.minimum(n[:, None], m[None, :]) >= 4 * np.maximum(n[:, None], m[None, :])
                if closest and may.any():
                    apart[~may] = 99
                    one = np.zeros_like(may)
                    one[np.arange(len(node)), apart.argmin(1)] = True
                    one[apart.argmin(0), np.arange(len(other))] = True
                    may &= one
                x, y = np.nonzero(may)
                found.append(np.stack([node[x], other[y]]))
            x, y = np.concatenate(found, axis=1)
            yield pa.record_batch({"x": pa.array(x), "y": pa.array(y)})

    return run


def _across(firsts: DataFrame, owners: DataFrame, closest: bool) -> DataFrame:
    """(a, b): pairs of different components that share one of their first shingles. firsts: _first_fifths(), stored."""
    rows = _owned(firsts, owners)
    by_owner = rows.groupBy("token", "owner").agg(F.count(F.lit(1)).alias("c"))
    tokens = by_owner.groupBy("token").agg(F.max_by("owner", "c").alias("main"), F.max("c").alias("held"), F.sum("c").alias("size")).filter("held < size")
    # a shingle's largest component needs no comparison within itself
    sided = rows.join(tokens, "token").withColumn("side", (F.col("owner") != F.col("main")).cast("int"))
    blocks = F.expr(f"1 + (if(side = 1, size - held, held) - 1) div {BLOCK}")
    me = F.struct("node", "owner", "fp", "n", "pos")
    cut = sided.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).groupBy("token", "side", "block").agg(F.collect_list(me).alias("x"))
    cut = kept(cut, "near-blocks")
    other = cut.select("token", F.col("side").alias("s"), F.col("block").alias("b"), F.col("x").alias("y"))
    both = cut.filter("side = 1").join(other, "token").filter("s = 0 OR block <= b")
    pairs = _pairs(both.select("x", "y").mapInArrow(_met(closest), "x long, y long"))
    dropped(firsts.sparkSession, cut)
    return pairs


def groups(docs: DataFrame) -> DataFrame:
    """docs: (node, text). (node, group) of the nodes that have a near copy, but for each group's least node, which names it."""
    spark = docs.sparkSession
    with small_batches(spark):  # rows of blocks and of shingles are tens of KB long
        made = docs.mapInArrow(_sketched, "node long, n long, fp long, keys array<long>")
        sketches = kept(made.dropDuplicates(["node"]), "near-sketches")
        alone = sketches.withColumn("owner", F.col("node"))
        owners = _joined_by(None, _checked(docs, _blocked(sketches), _candidates(alone, FIRST, 1, 0, 0)))
        released(spark)  # of each round's plans the executors hold broadcasts, too, until the driver lets go of them
        # a small key's pairs need to be compared only once
        owners = _joined_by(owners, _checked(docs, _candidates(_owned(sketches, owners), BANDS, ROOTS, LARGE, 1)))
        released(spark)
        rows = _keys(_owned(sketches, owners), BANDS)
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("me.owner").alias("low"), F.max("me.owner").alias("high")).filter(f"size > {LARGE} AND low < high")
        hard = kept(rows.join(large.select("key"), "key").select("me.node").distinct(), "near-hard")
        if hard.head(1):
            sets = _shingles(hard, docs)
            firsts = kept(_first_fifths(sets, sketches), "near-firsts")
            for closest in (True, False):
                owners = _joined_by(owners, _alike(_across(firsts, owners, closest), sets))
            dropped(spark, firsts, sets)
            released(spark)
        dropped(spark, hard, sketches)
    return owners.toDF("node", "group")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies."""
    node = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(node.alias("node"), F.col("text").cast("string").alias("text"))
    ids = docs.select(node.alias("node"), F.col("doc_id").alias("id")).groupBy("node").agg(F.min("id").alias("id"))
    ids = kept(ids.join(groups(texts), "node", "left").withColumn("group", F.coalesce("group", "node")), "near-ids")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    best = ids.groupBy("group").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("group", F.col("best.node").alias("best"))
    losers = ids.join(best, "group").filter("node <> best").select(F.col("node").alias("_node"))
    row = F.struct(*columns(docs))
    rows = docs.select(node.alias("_node"), row.alias("_row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(row)).alias("_rank"))
    one = rows.groupBy("_node").agg(F.min_by("_row", "_rank").alias("_row"))
    return one.join(losers, "_node", "left_anti").select("_row.*")
