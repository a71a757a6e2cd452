import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import bpe, chat, common, exact_dedup, lm, mixing, near, quality, sharding, simhash, suffix, toxicity
from strandlake.llm.queries import VOCABULARY

from . import brute

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = ["", None, " \t\n\x0b\x0c\r ", "one", "one two", "one two three four", "A b\n\nA b\nA  b", "x" * 3000, "na " * 4000, "é" * 60 + " ñ\n" * 30,
         "a b   c\u0085d", "# * $ % & | < >", "<|endoftext|> a<|endoftext|>", "'ll we'll  \n\n \t  end  ", "日本語 text \U0001f600\U0001f600"]


def rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark):
    """The driver's small documents, edge cases, copies, and chains of near copies."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts, rng = [], random.Random(3)
    for d in docs[:12]:
        words = d[1].split(" ")
        for _ in range(3):
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [docs[3][1][:400] + docs[4][1][100:700] + docs[5][1][-300:], docs[6][1][10:59], docs[6][1][10:60]]
    return docs + rows(EDGES * 2 + texts, 10_000)


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(docs, table):
    got = by_id(quality.report(docs))
    assert len(got) == len(table)
    for i, text, *_ in table:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_ablation(docs):
    ledger = quality.applied(quality.ledger(docs)).collect()
    found = {(r.policy, r.rule): r for r in quality.ablation(quality.ledger(docs)).collect()}
    for p, mask in quality.POLICIES.items():
        for rule, bit in quality.BIT.items():
            if mask & bit:
                r = found[p, rule]
                assert r.n_failed == sum(bool(x.fail_bits & bit) for x in ledger)
                assert r.n_only == sum(x.fail_bits & mask == bit for x in ledger)
                assert r.n_rejected == sum(bool(x.fail_bits & mask) for x in ledger)


def test_simhash(docs, table):
    got = by_id(simhash.report(docs))
    prints = {i: brute.fingerprint(t) for i, t, *_ in table}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    expected = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == expected


def test_simhash_null_and_repeated_ids(spark):
    """Large ids keep all their digits beside null ones; a component without ids has none; repeated rows get equal results."""
    big = 9007199254740993
    made = [(None, "one text of some words"), (big, "one text of some words"), (big + 1, "another text altogether, with more words"), (None, "a third that nobody owns"), (5, None), (None, ""), (big, "one text of some words")]
    rows = [(i, f"{brute.fingerprint(t):016x}", c) for (i, t), c in zip(made, [big, big, big + 1, None, 5, 5, big], strict=True)]
    got = simhash.report(spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_simhash_links_of_large_groups(spark, monkeypatch):
    """A ball of close fingerprints, larger than a first-level key may be, with chains out of it."""
    monkeypatch.setattr(simhash, "LARGE", 20)
    rng = random.Random(5)
    prints = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            prints.add(x)
        for _ in range(40):
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
            prints.add(x)
    nodes = dict(enumerate(sorted(prints, key=lambda _: rng.random())))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in nodes.items()]
    groups = simhash.components(simhash.links(spark.createDataFrame(signed, "node long, fp long")))
    found = {i: i for i in nodes} | {r.a: r.b for r in groups.collect()}
    assert found == brute.components(nodes, lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 3)


def test_sharding_moves_little_and_is_even(docs):
    names = [f"n{k}" for k in range(20)]
    before, after = sharding.table(names), sharding.table(names[:7] + names[8:])
    counts = np.bincount(before)
    assert counts.max() - counts.min() <= 1
    moved = np.array(names)[before] != np.array(names[:7] + names[8:])[after]
    assert moved.mean() < 0.2 and moved[before == 7].all()
    a, b = (by_id(sharding.report(docs)) for _ in range(2))
    assert a == b and len(a) == docs.count()


def test_sharding_table_is_filled_in_turns():
    names = ["a", "b", "c"]
    out, got = sharding.table(names, 31), {}
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        first, step = int.from_bytes(d[:8]) % 31, int.from_bytes(d[8:16]) % 30 + 1
        orders.append([(first + k * step) % 31 for k in range(31)])
    while len(got) < 31:
        for k, order in enumerate(orders):
            if len(got) < 31:
                got[next(s for s in order if s not in got)] = k
    assert [got[s] for s in range(31)] == out.tolist()


def test_lm(docs, table):
    got = by_id(lm.report(docs, shards=5))
    pairs = [(i, t) for i, t, *_ in table]
    base, model = brute.base_scores(pairs), brute.bigram_scores(pairs, lm.MU)
    assert set(got) == set(base)
    for i, (held, n, known, total, score) in base.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score == pytest.approx(model[i], abs=0.05 * n + 0.1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) == pytest.approx(sum(model[r.doc_id] for r in held), rel=0.005)


def test_lm_repeated_ids_and_long_texts(spark):
    """A row out for each row in, null ids kept; a text longer than the table of powers hashes its words like others."""
    words = [f"w{k % 997}" for k in range(220_000)]
    made = [(1, "a b a"), (1, "a b a"), (1, None), (None, "b"), (2, " ".join(words)), (3, "w1 w2 w3 " + "y" * 70), (4, ""), (7, "w1 w2")]
    assert len(made[4][1]) > common.STRETCH
    got = lm.report(spark.createDataFrame(made, "doc_id bigint, text string").repartition(2), shards=3).collect()
    # None as an id is the text None in the brute-force version, and trains too
    pairs = [(("r", k), t) for k, (_, t) in enumerate(made)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in made]
    tokens = [brute.WORD.findall(brute.lower(t or "")) + ["\n"] for _, t in pairs]
    n = sum(len(t) for t, h in zip(tokens, held) if not h)
    known = {w for t, h in zip(tokens, held) if not h for w in t}
    want = sorted((i or -1, h, len(t), sum(w in known for w in t), n) for (i, _), h, t in zip(made, held, tokens))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want


def test_elias_fano_successor():
    rng = np.random.default_rng(1)
    for bits in (6, 20, 64):
        x = np.sort(rng.integers(0, 1 << min(bits, 63), 500, dtype=np.uint64) * np.uint64(2 if bits == 64 else 1))
        data = np.frombuffer(lm.EliasFano.packed(x, bits), np.uint8)
        ef, end = lm.EliasFano.opened(data, 0)
        assert end == len(data) and (ef.at(np.arange(500)) == x).all()
        q = np.concatenate([rng.choice(x, 50) + rng.integers(0, 2, 50).astype(np.uint64), x[:2], x[-2:], np.array([0, (1 << bits) - 1], np.uint64)])
        assert (ef.successor(np.full(len(q), 100), np.full(len(q), 400), q) == 100 + np.searchsorted(x[100:400], q)).all()
        assert ef.unary.nbytes + ef.low.strides[0] * 500 <= 500 * (bits + 16) // 8 + 64  # it stays packed


def test_exact_dedup(docs, table):
    got = by_id(exact_dedup.decisions(docs))
    groups = defaultdict(list)
    for i, t, *_ in table:
        groups[t or ""].append(i)
    assert len(got) == len(table)
    for t, ids in groups.items():
        for i in ids:
            assert tuple(got[i]) == (i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_grows_by_batches(spark, docs):
    index = exact_dedup.fresh_index(spark)
    first = exact_dedup.deduplicated(docs.filter("doc_id % 2 = 0"), index).filter("kept").count()
    assert index.rows().count() == first
    second = exact_dedup.deduplicated(docs.filter("doc_id % 2 = 1"), index).filter("kept").count()
    assert index.rows().count() == first + second == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = exact_dedup.deduplicated(docs, index)
    assert again.filter("kept").count() == first + second


def test_exact_dedup_repeated_rows_and_batches(spark):
    """Of repeated rows one stays; later batches count their own rows beside the first one's."""
    schema = "doc_id bigint, text string, extra int"
    made = [(1, "a", 1), (1, "a", 1), (1, "a", 2), (2, "b", 1), (None, "b", 1), (None, "c", 1), (None, "c", 1), (3, None, 1), (4, "", 1), (5, "a ", 0)]
    df = spark.createDataFrame(made, schema).repartition(3)
    index = exact_dedup.fresh_index(spark)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicated(df, index).collect()]
    want = [(1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 2, True), (None, 2, 2, False), (None, None, 2, False), (None, None, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    more = spark.createDataFrame([(9, "a", 1), (10, "new", 1), (8, "a", 1)], schema)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicated(more, index).collect()} == {(9, 1, 5, False), (8, 1, 5, False), (10, 10, 1, True)}
    name = index.name
    index.drop()
    assert not spark.catalog.tableExists(name)
    left = [tuple(r) for r in exact_dedup.unique(df).collect()]
    assert sorted((i, t) for i, t, _ in left if i) == [(1, "a"), (2, "b"), (4, ""), (5, "a ")] and [t for i, t, _ in left if i is None] == ["c"]


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = by_id(toxicity.report(d, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    toxic = [p for y, p in held if y]
    assert sum(toxic) / len(toxic) >= 0.7


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(10_000, 1, 1), (10_001, 1, 0), (None, 1, 1), (0, 1, None)], "doc_id bigint, quality int, toxic int")
    assert len(by_id(toxicity.report(docs, labels))) == docs.count()
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}


def test_suffix(docs, table):
    got = by_id(suffix.report(docs))
    expected = brute.suffix([(i, t) for i, t, *_ in table])
    assert {i: tuple(r)[1:] for i, r in got.items()} == expected


def test_suffix_edges(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(300))
    made = [text, text, text[:49], text[:50], text[30:81] + "Z" + text[81:140], "a" * 120, "a" * 51, "b" + "a" * 49, "q" + text[100:149], text[250:] + "a" * 60 + text[:60]]
    made += [text[i : i + 50 + i % 7] for i in range(0, 200, 13)]
    df = spark.createDataFrame(rows(made), SCHEMA)
    assert {i: tuple(r)[1:] for i, r in by_id(suffix.report(df)).items()} == brute.suffix(list(enumerate(made)))


def test_suffix_borders_are_few(spark):
    """Words of 30 bytes in other surroundings: a 50-byte string is judged on its own only if 47 bytes around it may be in two documents."""
    rng = random.Random(5)
    noise = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    words = [noise(30) for _ in range(400)]
    made = ["".join(rng.choice(words) + noise(20) for _ in range(20)) for _ in range(60)] + [noise(70) + words[0] + words[1] + noise(70) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(made)), "row long, text string").withColumn("id", F.col("row"))
    judged = suffix._judged(df, spark.sparkContext.broadcast(suffix._filter(suffix._first_names(df))))
    found = suffix._border_strings(df, judged).groupBy("row").count().collect()
    assert {60, 61, 62} <= {r.row for r in found} and sum(r["count"] for r in found) < 1500  # 13,500 strings have one of these words' anchors
    assert {i: tuple(r)[1:] for i, r in by_id(suffix.report(df.select(F.col("id").alias("doc_id"), "text"))).items()} == brute.suffix(list(enumerate(made)))


def test_bpe(docs, table):
    got = by_id(bpe.report(docs, VOCABULARY))
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    for i, text, *_ in table:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), text


def test_bpe_random_words():
    t, e = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    rng = random.Random(9)
    for alphabet in ("ab", "theinon", "aaaab'", " \n\tx", "éèàñ", "0123456789-"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_bpe_forgets_and_takes_back(monkeypatch):
    """Small memories of words and pairs change nothing; neither do words whose longest tokens do not fit, or long ones."""
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    t, e = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    t.no_truncation()
    rng = random.Random(4)
    parts = [x for x in e.v.tokens if x.isascii() and x.isalpha() and len(x) > 2]
    taken_back = 0
    for size in [5] * 200 + [400] * 5:
        text = "".join(rng.choice(parts) for _ in range(size)) + " again again " + rng.choice(parts)
        ids = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text).tolist() == ids, text
        word = e.pattern.findall(text)[0]
        taken_back += e.word(word) != [token for _, (_, token) in e.automaton.iter_long(word)]
        assert len(e.known) <= 3 and len(e.earlier) <= 3 and len(e.compatible) <= 5
    assert taken_back > 50  # the second part of the encoder was met often


def in_order(doc_id):
    """The shuffled order's key: Spark's hash of a long."""
    return xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42) >> 1


def check_mixing(rows, out):
    sizes = defaultdict(int)
    for _, size, source in rows:
        sizes[source] += size
    want, taken = brute.targets(sizes), brute.taken(rows, in_order)
    source_of = {i: s for i, _, s in rows}
    assert len(out) == len(rows)
    for r in out:
        s = source_of[r.doc_id]
        assert (r.source_size, r.taken) == (sizes[s], taken[r.doc_id])
        assert r.target == pytest.approx(want[s], rel=1e-9) and r.taken <= 2 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in out if source_of[r.doc_id] == s) - want[s]) < 1 + 1e-6, s


def test_mixing(docs, table):
    out = mixing.mixed(docs, block=64).drop("rid").collect()
    check_mixing([(i, len(brute.WORD.findall(t or "")), s) for i, t, _, s, _ in table], out)
    assert sorted(out) == sorted(mixing.mixed(docs.repartition(7), block=64).drop("rid").collect())


def test_mixing_of_tiny_sources(spark):
    """Sources of one word beside a large one, and sources of equal rows; each target is met to the word."""
    rng = random.Random(8)
    made = [(k, "w " * rng.randrange(2000), "large") for k in range(300)] + [(1000 + k, "w", f"s{k:03d}") for k in range(150)] + [(2000 + k, "a b", None) for k in range(5)] + [(3000, None, "empty")]
    out = mixing.mixed(spark.createDataFrame(made, "doc_id bigint, text string, source string"), block=64).drop("rid").collect()
    check_mixing([(i, len((t or "").split()), s) for i, t, s in made], out)


def test_chat(spark):
    t = spark.createDataFrame(
        [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "b"), (1, 0, "user", "hi"), (1, 1, "assistant", "c"), (2, 0, "user", None),
         (2, 1, "assistant", "x"), (3, 0, "user", None), (3, 1, "assistant", "x"), (4, 0, None, "alone"), (None, 0, "user", "n")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = {r.pair_id: r for r in chat.report(t).collect()}
    assert set(got) == {0, 1}
    assert tuple(got[0]) == (0, 1, "<|user|>\nhi\n", "<|assistant|>\na\n<|user|>\nb\n", "<|assistant|>\nc\n", "14-16", "14-16")
    assert got[0].chosen[14:16] == "a\n" and got[1].n_common == 2 and got[1].chosen == got[1].rejected == ""


@pytest.mark.parametrize("run", [
    quality.report, simhash.report, sharding.report, lm.report, exact_dedup.decisions, suffix.report, mixing.mixed, mixing.mixture, near.representatives, exact_dedup.unique,
    lambda d: bpe.report(d, VOCABULARY), lambda d: toxicity.report(d, d.select("doc_id", F.lit(1).alias("toxic"))), lambda d: quality.ablation(quality.ledger(d)),
])
def test_empty_tables(spark, run):
    """Results on rows are in test_edges.py."""
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
