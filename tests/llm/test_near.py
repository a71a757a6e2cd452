import random

import pyarrow as pa
import pytest

from strandlake.llm import near, simhash
from strandlake.llm.common import kept

from . import brute

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def close(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def test_near_copies_by_brute_force(spark):
    """Texts with 1 to 12 changed words on both sides of the threshold, a large group, and a passage in many texts."""
    rng = random.Random(11)
    made = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, passage = [None, "", " \n", "One two", "one  TWO", "one two three"], made(60)
    for _ in range(40):
        words = made(rng.randrange(60, 300))
        for _ in range(4):
            changed = list(words)
            for _ in range(rng.randrange(1, 13)):
                changed[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(changed))
    group = made(120)
    for k in range(80):
        texts.append(" ".join([*group, f"end{k}"]))
        texts.append(" ".join([*passage, *made(40)]))
    rng.shuffle(texts)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    groups = brute.components(sets, lambda a, b: close(sets[a], sets[b]))
    assert 0 < len(set(groups.values())) < len(texts) - 79
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in near.representatives(rows).collect()) == sorted(set(groups.values()))


def test_near_copies_are_left_by_three_bits(spark):
    """Two texts that SimHash at 3 bits leaves apart, and a table without rows."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    other = [*words[:40], "x", *words[41:90], "y", *words[91:]]
    texts = [" ".join(words), " ".join(other)]
    assert close(*map(shingles, texts)) and (brute.fingerprint(texts[0]) ^ brute.fingerprint(texts[1])).bit_count() > 3
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert [r.doc_id for r in near.representatives(rows).collect()] == [0]
    assert near.representatives(rows.filter("doc_id < 0")).collect() == []


def test_null_and_repeated_ids_with_different_texts(spark):
    """No unique text is lost to its id, and a group with a null id keeps one row."""
    words = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"x{k}" for k in range(60))
    rows = [(None, "a text of its own and no id"), (None, "another one that has none either"), (7, "one text of number seven here"), (7, "and an unrelated text of seven"),
            (None, words), (3, words + " end"), (5, words + " stop"), (None, other), (None, other + " end")]
    got = [tuple(r) for r in near.representatives(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got[:]) >= set(rows[:4]) and (3, words + " end") in got
    assert len(got) == 6 and sum(t.startswith(other) for _, t in got) == 1


def grown(rng, n, words, changes):
    """Texts that each change a few words of an earlier one: neighbours are alike, most of the others are not."""
    texts = [[f"w{rng.randrange(20000)}" for _ in range(words)]]
    while len(texts) < n:
        t = list(rng.choice(texts[-60:]))
        for _ in range(rng.randrange(1, changes)):
            t[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("large, roots, block", [(32, 6, 256), (2, 1, 5), (4, 1, 64)])
def test_large_keys_by_brute_force(spark, monkeypatch, large, roots, block):
    """Families in which a text is like a few of very many that share its keys; a common passage in texts that are not alike."""
    monkeypatch.setattr(near, "LARGE", large)
    monkeypatch.setattr(near, "ROOTS", roots)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(8)
    passage = " ".join(f"c{k}" for k in range(90))
    texts = grown(rng, 500, 240, 4) + grown(rng, 250, 150, 3) + [passage + "".join(f" q{rng.randrange(10**6)}" for _ in range(80)) for _ in range(200)]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    holders, links = {}, set()
    for i, s in enumerate(sets):
        links |= {(i, j) for j in {j for g in s for j in holders.get(g, ())} if close(s, sets[j])}
        for g in s:
            holders.setdefault(g, []).append(i)
    groups = brute.components(range(len(texts)), lambda a, b: (b, a) in links)
    assert len(links) > 1000 and 200 < len(set(groups.values())) < 700
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in near.representatives(rows).collect()) == sorted(set(groups.values()))


def test_a_large_key_makes_one_pair_a_text(spark):
    """A hundred texts that share all keys and may all be alike: not every one with every one."""
    rng = random.Random(5)
    rows = [(k, 50, rng.getrandbits(8), list(range(near.BANDS)), k) for k in range(100)]
    sketches = spark.createDataFrame(rows, "node long, n long, fp long, keys array<long>, owner long")
    pairs = near._candidates(sketches, near.BANDS, near.ROOTS, near.LARGE, 1).collect()
    assert 50 <= len(pairs) <= 100 and {x for p in pairs for x in p} == set(range(100))
    bits = {k: fp for k, _, fp, _, _ in rows}
    assert sum((bits[p.a] ^ bits[p.b]).bit_count() for p in pairs) < 100


def test_pigeonhole_blocks_link_fingerprints_within_three_bits(spark):
    """The blocks connect what brute force on the fingerprints connects, equal fingerprints too, whatever the MinHash keys are."""
    rng = random.Random(6)
    prints = [rng.getrandbits(63) for _ in range(60)]
    for _ in range(140):
        prints.append(rng.choice(prints) ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(0, 4))}))
    groups = brute.components(range(200), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    sketches = spark.createDataFrame([(k, fp) for k, fp in enumerate(prints)], "node long, fp long")
    links = {tuple(r) for r in near._blocked(sketches).collect()}
    assert all(a > b for a, b in links) and len(set(groups.values())) < 70
    assert brute.components(range(200), lambda a, b: (a, b) in links or (b, a) in links) == groups


def test_blocks_of_texts_that_differ_in_the_sign_bit():
    """Two texts whose fingerprints differ in the highest bit alone are compared."""
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("node", "owner", "fp", "n", "pos")]))
    side = lambda node, fp: pa.array([[{"node": node, "owner": node, "fp": fp, "n": 50, "pos": 0}]], kind)
    batch = pa.record_batch({"x": side(1, 7), "y": side(2, 7 - 2**63)})
    for closest in (True, False):
        (found,) = near._met(closest)([batch])
        assert found.to_pylist() == [{"x": 1, "y": 2}]


def test_components_end_with_the_step_that_settles_them(spark, monkeypatch):
    """Links that are stars already are stored once and not stepped through; a chain and a second link of a node are."""
    written = []
    monkeypatch.setattr(simhash, "kept", lambda df, name: written.append(name) or kept(df, name))
    stars = [(2, 1), (3, 1), (9, 1), (8, 5)]
    assert sorted(map(tuple, simhash.components(spark.createDataFrame(stars, "a long, b long")).collect())) == stars[:2] + [(8, 5), (9, 1)]
    assert len(written) == 1
    for links in ([(2, 1), (3, 2), (4, 3), (7, 6)], [(3, 1), (3, 2), (5, 2), (7, 6)]):
        groups = brute.components({x for link in links for x in link}, lambda a, b: (a, b) in links or (b, a) in links)
        found = {r.a: r.b for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert found == {a: b for a, b in groups.items() if a != b}
    assert not simhash.components(spark.createDataFrame([(4, 4)], "a long, b long")).head(1)


def test_batches_of_the_rounds_are_small(spark, monkeypatch):
    """Rows of shingles and of blocks are tens of KB long; what goes to Python at once is bounded by bytes, and the session's bound is back afterwards."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(near, "kept", lambda df, at: seen.append(spark.conf.get(name)) or kept(df, at))
    near.groups(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "node long, text string"))
    assert seen and set(seen) == {"4m"} and spark.conf.get(name) == before
