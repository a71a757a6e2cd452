"""Importance resampling against plain Python, with runs of several words and tries that begin anew."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from strandlake.llm import importance

from . import brute

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = " ".join(f"w{k % 977}" for k in range(120_000))
SCHEMA = "doc_id bigint, text string, rank string, score string, `a.b` int, weight int, `_part` int, n_words string"


def features(text, longest):
    words = WORD.findall(brute.lower(text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def wanted(docs, target, longest=1, buckets=10_000, share=10, least=20):
    """(doc_id, n_features, weight, score, rank) by the formulas; rows of one score and doc_id share the set of their ranks."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest))
    t = Counter(bucket(f) for x in target for f in features(x, longest))
    high, low = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    rows = []
    for i, text in docs:
        found = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * high / ((s[b] + 1.0) * low))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text, 1))])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: share * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts():
    made = [(i, " ".join(f"W{(i * k * 7 + k) % (20 + i)}" for k in range(10 + i)) + ("! Über-Straße 9_9" if i % 3 else "")) for i in range(150)]
    return [*made, (3, made[3][1]), (3, made[3][1]), (None, made[140][1]), (900, None), (901, ""), (902, " \n.,"), (903, LONG), (None, None), (904, "x y été 東京 tokyo7 " * 9)]


@pytest.mark.parametrize("longest, nodes", [(1, 1 << 18), (3, 1 << 18), (1, 40), (3, 40)])
def test_report(spark, monkeypatch, longest, nodes):
    monkeypatch.setattr(importance, "NODES", nodes)
    rows, target = texts(), ["w1 w2 w3 straße", None, "", "W7 w7 w7 été"]
    docs = spark.createDataFrame([(i, t, "r", "s", 1, 2, 3, "n") for i, t in rows], SCHEMA).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.report(docs, goal, longest, 97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted(rows, target, longest, 97)


def test_drawn_documents_keep_their_columns(spark):
    rows, target = texts(), ["w1 w2 w3 straße"]
    docs = spark.createDataFrame([(i, t, "r", "s", i, 2, 3, "n") for i, t in rows], SCHEMA)
    got = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == docs.columns
    text = dict(rows)
    drawn = sorted(r[0] for r in wanted(rows, target) if r[4])
    assert sorted(r.doc_id for r in got.collect()) == drawn and all(r.text == text[r.doc_id] and r["a.b"] == r.doc_id and r.rank == "r" for r in got.collect())


def test_without_rows_and_with_other_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in texts()], "doc_id bigint, text string")
    none = docs.limit(0)
    assert importance.report(none, docs).collect() == []
    assert {(r.weight) for r in importance.report(docs, none).collect() if r.n_features == 0} == {0}
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert {(r.doc_id, r.score) for r in importance.report(named, docs).collect()} == {(None if r.doc_id is None else str(r.doc_id), r.score) for r in importance.report(docs, docs).collect()}
