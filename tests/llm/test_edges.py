"""Each operator on nulls in every column, repeated rows, empty and very long texts, and columns with clashing names."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import bpe, chat, common, exact_dedup, lm, mixing, near, quality, sharding, simhash, suffix, toxicity
from strandlake.llm.queries import VOCABULARY

from . import brute

NAMES = "size bigint, fp bigint, digest string, kept boolean, score double, row int, shard int, slot string, n bigint, node bigint, owner bigint, key bigint, rid bigint, top string, train boolean, toxic int, label string, _row int, _times int, _copy int, _toxicity double, toxicity double, `a.b` int, `a b` int, `a``b` int, row_ int, x string, often int, pos int, size_ int, times int, copy int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {NAMES}"
WIDTH = len(SCHEMA.split(","))
LONG = " ".join(f"word{k % 4001}" for k in range(150_000))
TEXTS = [(1, "a b c"), (1, "a b c"), (4, "a b c"), (2, None), (None, None), (None, "A b c"), (3, ""), (5, LONG), (6, "f\nf\n\x0c\n" + "x" * 80), (7, "y " + "x" * 80 + " z")]


def filled(i, text):
    """A row with values in the other columns, or nulls in all of them."""
    if text is None:
        return (i, None) + (None,) * (WIDTH - 2)
    return (i, text, "en", "s", 5, 1, 2, "d", True, 0.5, 1, 1, "x", 1, 1, 1, 1, 1, "t", False, 1, "l", 7, 8, 9, 0.25, 0.75, 10, 11, 12, 13, "y", 14, 15, 16, 17, 18)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([filled(*x) for x in TEXTS], SCHEMA).repartition(3).cache()


def same(rows, wanted):
    assert Counter(map(str, map(tuple, rows))) == Counter(map(str, map(tuple, wanted)))


def untouched(out):
    """Columns of the input keep their values, whatever their names."""
    rows = [r for r in out.collect() if r.text is not None]
    assert rows and all(tuple(r) == filled(r.doc_id, r.text) for r in rows)


def test_quality(docs):
    got = quality.report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    same(got, [(i, *brute.quality(t)) for i, t in TEXTS])


def test_simhash(docs):
    prints = [brute.fingerprint(t) for _, t in TEXTS]
    groups = brute.components(range(len(TEXTS)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for k, (i, _) in enumerate(TEXTS):
        if i is not None:
            least[groups[k]] = min(i, least.get(groups[k], i))
    same(simhash.report(docs).collect(), [(i, f"{prints[k]:016x}", least.get(groups[k])) for k, (i, _) in enumerate(TEXTS)])


def test_sharding(docs):
    """A row's slot is Spark's hash of its key; a null key's is the hash's seed."""
    names = ["a", "b", "c"]
    owner = sharding.table(names, 31)
    got = sharding.placed(docs, "doc_id", names, 31)
    assert got.columns.count("slot") == got.columns.count("shard") == 1
    slot = {i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) + (1 << 63)) % (1 << 64) - (1 << 63) if i is not None else 42 for i, _ in TEXTS}
    same(got.select("doc_id", "text", "slot", "shard").collect(), [(i, t, slot[i] % 31, names[owner[slot[i] % 31]]) for i, t in TEXTS])


def test_lm(docs):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in TEXTS]
    tokens = [brute.WORD.findall(brute.lower(t or "")) + ["\n"] for _, t in TEXTS]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    got = lm.report(docs, shards=3).collect()
    same([r[:5] for r in got], [(i, h, len(t), sum(count[w] > 0 for w in t), n) for (i, _), h, t in zip(TEXTS, held, tokens)])
    base = sorted(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t) for t in tokens)
    assert sorted(r.base_score for r in got) == pytest.approx(base, rel=1e-9)


def test_exact_dedup(docs):
    text = [t or "" for _, t in TEXTS]
    groups = {t: [i for (i, _), u in zip(TEXTS, text) if u == t] for t in text}
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.decisions(docs)
    same(got.select("doc_id", "keep_id", "group_size", "text_sha256").collect(), [(i, top[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(TEXTS, text)])
    same([(r.doc_id, r.text_sha256) for r in got.filter("kept").collect()], [(i, hashlib.sha256(t.encode()).hexdigest()) for t, i in top.items()])
    left = exact_dedup.unique(docs)
    assert left.columns == docs.columns
    untouched(left)
    same([(r.doc_id, r.text or "") for r in left.collect()], [(i, t) for t, i in top.items()])


def test_toxicity(spark, docs):
    """Equal texts have one score, null and empty texts too; a label twice counts as toxic; the other columns stay."""
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 1, 0), (5, None, 0), (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.report(docs, labels).collect()
    text = {}
    for i, t in TEXTS:
        text.setdefault(i, set()).add(t or "")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len({r.score for r in got if text[r.doc_id] == {""}}) == 1 and len({r.score for r in got if text[r.doc_id] == {"a b c"}}) == 1
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.accepted(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    untouched(kept)


def hashed(word):
    """The byte kernel's hash of a run, on whole numbers."""
    table, m = common.byte_table(True), 1 << 64
    h = (sum(int(table[b]) * pow(common._MULT, k, m) for k, b in enumerate(word)) + len(word)) % m
    return int(common.mixed(np.array([h], np.uint64))[0])


def buckets(text, bits):
    plain = (text or "").encode().translate(bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)))
    h = [hashed(w.encode("latin-1")) for w in brute.WORD.findall(plain.decode("latin-1"))]
    pairs = [(h[k], h[k + gap], salt) for gap, salt in ((1, 0x5BD1E995), (2, 0x1B873593)) for k in range(len(h) - gap)]
    h += [int(common.mixed(np.array([(a * 3 + b + salt) % (1 << 64)], np.uint64))[0]) for a, b, salt in pairs]
    return sorted({x % (1 << bits) for x in h})


def test_toxicity_by_brute_force(spark):
    """The whole operator against FTRL on dictionaries, one coordinate after the other."""
    words = ["good", "kind", "calm", "bad", "vile", "rude", "Day", "night"]
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for i in range(80):
        toxic = int(rng.random() < 0.3)
        rows.append((i, " ".join(rng.choice(words[3 * toxic : 3 * toxic + 3] + words[6:], rng.integers(0, 12))) + ("!" if i % 3 else "")))
        truth.append((i, toxic))
    got = {r.doc_id: r.score for r in toxicity.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(truth, "doc_id bigint, toxic int")).collect()}
    at = {i: buckets(t, toxicity.BITS) + ["bias"] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    z, n, order = Counter(), Counter(), np.random.default_rng(7)

    def weight(k):
        return -np.sign(z[k]) * max(abs(z[k]) - toxicity.L1, 0) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for j in order.permutation(len(train)):
            i = train[j]
            w = {k: weight(k) for k in at[i]}
            g = (1 / (1 + np.exp(-sum(w.values()))) - truth[i][1]) * (toxicity.POSITIVE if truth[i][1] else 1)
            for k in at[i]:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA * w[k]
                n[k] += g * g
    want = {i: 1 / (1 + np.exp(-sum(weight(k) for k in at[i]))) for i in at}
    assert len(set(want.values())) > 10
    assert got == pytest.approx(want, abs=1e-9)


def test_suffix(docs):
    """Rows of one doc_id are judged against smaller ids only; a null id is larger than any other."""
    key = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in TEXTS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, key(i)), key(i))
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k] += 1
                gone[k + 50 if k + 50 <= len(b) else len(b)] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    same(suffix.report(docs).collect(), want)


def test_bpe(docs):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same(bpe.report(docs, VOCABULARY).collect(), want)


def test_mixing(docs):
    got = mixing.mixed(docs, block=16).collect()
    sizes = [(i, len(brute.WORD.findall(t or "")), filled(i, t)[3]) for i, t in TEXTS]
    total = Counter()
    for _, n, s in sizes:
        total[s] += n
    want = brute.targets(total)
    same([(r.doc_id, r.size, r.source_size) for r in got], [(i, n, total[s]) for i, n, s in sizes])
    assert all(r.target == pytest.approx(want[None if r.size == 0 and r.source_size == total[None] else "s"], rel=1e-9) and 0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(map(int, want.values()))
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns and all(r.text for r in mix.collect())
    untouched(mix)


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, pair_id bigint, side int, t string, c string, r string, prompt string, n_common bigint"
    made = [(0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, "assistant", LONG), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, None, None, None), (2, 0, "user", "x")]
    turns = spark.createDataFrame([(*x, 7, 1, "t", "c", "r", "p", 9) for x in made], schema).repartition(2)
    # a null turn stands first, so these two share nothing
    got = [tuple(r) for r in chat.report(turns).collect()]
    hi = "<|user|>\nhi\n"
    assert got == [(0, 0, "", f"{hi}{hi}<|assistant|>\n{LONG}\n", f"<||>\n\n{hi}{hi}", f"{2 * len(hi) + 14}-{2 * len(hi) + 15 + len(LONG)}", "")]
    same_turns = spark.createDataFrame([(0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.report(same_turns).first()
    assert (r.n_common, r.prompt, r.chosen, r.rejected) == (2, hi * 2, "<|assistant|>\na\n", "<|assistant|>\nb\n")
    assert chat.report(turns.limit(0)).collect() == []


def test_near(docs):
    left = near.representatives(docs)
    assert left.columns == docs.columns
    untouched(left)
    # with ASCII case apart, "a b c" and "A b c" are one group, and so are null and empty texts
    assert sorted((r.doc_id, r.text or "") for r in left.collect() if r.doc_id) == sorted([(1, "a b c"), (2, ""), (5, LONG), (6, TEXTS[8][1]), (7, TEXTS[9][1])])


def test_stages(spark, docs, tmp_path):
    """Each stage takes an empty table and one with nulls in every column, and all but the last keep the columns."""
    spark.createDataFrame([(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        left = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, left, str(tmp_path))
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() == 0 or rows is docs
            left = spark.createDataFrame(out.collect(), SCHEMA) if name != "bpe" else out
