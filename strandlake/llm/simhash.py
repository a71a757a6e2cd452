"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components.

A fingerprint is cut into `blocks` blocks. Two that differ in at most `distance` bits agree
on at least blocks - distance whole blocks, so they meet under the key made of those blocks.
Keys with few fingerprints are compared directly. Keys with many are cut once more over the bits
that the key leaves open, which bounds a second-level key to 2**16 fingerprints, whatever the data.
Within a key the links found form stars to each local component's least document, never all
pairs. The stars are joined to components by alternating large-star and small-star steps.

A node is a fingerprint; ids of documents only meet the nodes again at the end, in built-in functions.

Defined results: null and empty texts and texts without words have fingerprint zero and link
like any other; texts of under three words have one shingle, the whole sequence; equal fingerprints
are one node; rows repeated with one doc_id get equal results; a component's id is its least doc_id that is not
null, and null if it has none; doc_id must be a whole number or cast to one; extra columns are ignored; an empty table gives no rows. A text is handled
in one task, with about 100 bytes of memory for each of its words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, encoded, kept, looked_up, pieces

BITS, DISTANCE, BLOCKS, WORDS = 64, 3, 6, 3
#: A first-level key with more fingerprints is cut again.
LARGE = 256


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """A bit is 1 if it is set in over half of the XXH64 (seed 42) of the text's shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest, shifts = xxhash.xxh64_intdigest, np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        w = text.lower().split()
        if not w:
            continue
        grams = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64)
        ones = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[i] = ((2 * ones > len(h)).astype(np.uint64) << shifts).sum()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) for each row."""

    def run(batches):
        for b in pieces(batches):
            fp = fingerprints_of(encoded(b.column("text")))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: list[int], blocks: int, whole: int) -> list[int]:
    """A mask for each choice of `whole` of the blocks that the bits are dealt into."""
    cut = [bits[k * len(bits) // blocks : (k + 1) * len(bits) // blocks] for k in range(blocks)]
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(cut, whole)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _numbered(masks: list[int]) -> F.Column:
    return F.array(*[F.struct(F.lit(k).alias("no"), F.lit(_signed(m)).cast("long").alias("mask")) for k, m in enumerate(masks)])


def _keys(rows: DataFrame, masks: F.Column, plan: str) -> DataFrame:
    """Each row under each of its masks: (plan, key, node, fp)."""
    out = rows.withColumn("_mask", F.explode(masks))
    return out.withColumns({plan: F.col("_mask.no"), f"{plan}_key": F.col("fp").bitwiseAND(F.col("_mask.mask"))}).drop("_mask")


def stars(node: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components within one key; each member once.

    Reached members leave the set that is still compared, so a group of close copies costs
    little more than one pass, and memory stays at a few rows of it.
    """
    order = np.argsort(node, kind="stable")
    node, fp = node[order], fp[order]
    left = np.arange(len(node))
    ends, roots = [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for one in front[:64]:
                near |= np.bitwise_count(fp[left] ^ fp[one]) <= distance
            front = np.concatenate([front[64:], left[near]])
            ends.append(left[near])
            roots.append(np.full(int(near.sum()), root))
            left = left[~near]
    if not ends:
        return node[:0], node[:0]
    return node[np.concatenate(ends)], node[np.concatenate(roots)]


def _linked(groups: DataFrame, distance: int) -> DataFrame:
    """Rows with an array `members` of (node, fp) to links (a, b), b the lesser."""

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            starts = np.asarray(members.offsets)
            flat = members.values if len(members) else pa.array([])
            node, fp = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            fp, a, b = fp.view(np.uint64), [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s == 2:
                    if int(fp[s] ^ fp[s + 1]).bit_count() <= distance:
                        x, y = int(node[s]), int(node[s + 1])
                        a.append([max(x, y)])
                        b.append([min(x, y)])
                else:
                    x, y = stars(node[s:e], fp[s:e], distance)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.record_batch({"a": pa.array(np.concatenate(a).astype(np.int64)), "b": pa.array(np.concatenate(b).astype(np.int64))})

    return groups.select("members").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """nodes: (node, fp), each fp once. Links that connect all nodes within `distance`, directly or by a chain."""
    masks = _masks(list(range(BITS)), blocks, blocks - distance)
    keyed = _keys(nodes, _numbered(masks), "k")
    sizes = keyed.groupBy("k", "k_key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = kept(keyed.join(sizes, ["k", "k_key"]), "simhash-keys")
    small = shared.filter(F.col("size") <= LARGE).groupBy("k", "k_key").agg(F.collect_list(F.struct("node", "fp")).alias("members"))
    # the masks over the bits that a first-level key's mask leaves open
    deeper = F.array(*[_numbered(_masks([b for b in range(BITS) if not mask >> b & 1], blocks, blocks - distance)) for mask in masks])
    large = _keys(shared.filter(F.col("size") > LARGE), deeper[F.col("k")], "m")
    large = large.groupBy("k", "k_key", "m", "m_key").agg(F.collect_list(F.struct("node", "fp")).alias("members")).filter(F.size("members") > 1)
    return _linked(small, distance).unionByName(_linked(large, distance)).distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether each node a of the links (a, b), b the lesser, has one link and is no other's b: then b is the least node that a reaches."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = down").head(1)


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) to (a, b) with b the least node that a reaches; the least nodes themselves are left out.

    Each step halves the depth at least in practice; a step is three shuffles, written to the shared folder. No step follows once all is told
    by one link a node, as executors and the driver keep compiled code and buffers of every plan.
    Aggregates come before joins, and a node of very many links is dealt out by skew joins.
    """
    now = kept(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _starred(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        after = kept(small, "links")
        dropped(now.sparkSession, now)
        now = after
    return now


def clustered(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) for each row."""
    prints = kept(fingerprints(docs), "fingerprints")
    total = prints.count()
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    groups = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance, blocks)).toDF("fp", "group")
    grouped = nodes.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    # the larger groups' least ids; a group of one node has its own
    least = grouped.join(groups.select("group").distinct(), "group", "left_semi").groupBy("group").agg(F.min("least").alias("component_id"))
    owner = kept(grouped.join(least, "group", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")), "simhash-owners")
    return looked_up(prints, owner, "fp", "copies", total).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return clustered(docs).select("doc_id", hexed, "component_id")
