"""The audit against plain Python, with few digits a round so that values and bytes take several."""

import random
import re
from collections import Counter, defaultdict

import pytest

from strandlake.llm import divergence

from . import brute

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "text string, lang string, source string, doc_id bigint, id bigint, term string, n bigint, value bigint, `a.b` int"


def wanted(docs, least=3, top=200):
    """(lang, source, part, item, value, rank) with every kept term of every group."""
    docs = [tuple(x or "" for x in d) for d in docs]
    count, of_lang, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), {(d[1], d[2]) for d in docs}
    for text, lang, source in docs:
        terms = TERM.findall(brute.lower(text))
        count[lang, source].update(terms)
        of_lang[lang].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t in of_lang[lang] if seen[lang][t] >= least]

        def p(c):
            m = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // m for t in kept}

        q, here = p(of_lang[lang]), sorted(g[1] for g in groups if g[0] == lang)
        ps = {s: p(count[lang, s]) for s in here}
        f = lambda a, b: (a - b) ** 2 // b
        for s in here:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in here if o != s]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if count[lang, s][t] and ps[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, *r, k + 1) for k, r in enumerate(rows[:most])]
    return sorted(out)


def made(n=260):
    rng = random.Random(4)
    words = [a + b + c for a in ("Ba", "é", "zz", "日") for b in ("", "na", "Ø") for c in ("", "x", "yy", "zzz", "ñ")] + ["the", "of"]
    docs = []
    for k in range(n):
        lang = ("en", "de", None, "")[k % 4]
        source = f"s{min(k % 7, rng.randrange(7))}" if k % 9 else (None, "")[k % 2]
        docs.append((" ".join(rng.choice(words[rng.randrange(3) :: 3]) for _ in range(rng.randrange(0, 60))) + rng.choice(["", ". 1,2", "\nthe THE"]), lang, source))
    docs += [docs[0], docs[0], (None, "en", "lone"), ("", "xx", "a"), (None, "xx", "b"), ("once", "yy", "a"), (None, None, None), (" ".join(["long"] * 50_000 + ["the", "of"] * 9), "en", "s1")]
    return docs


@pytest.mark.parametrize("radix, few, top", [(12, 1000, 200), (3, 0, 7), (5, 2, 1), (31, 0, 30)])
def test_audit(spark, monkeypatch, radix, few, top):
    monkeypatch.setattr(divergence, "RADIX", radix)
    monkeypatch.setattr(divergence, "FEW", few)
    monkeypatch.setattr(divergence, "PAIRS", 40 if few == 2 else 1 << 19)
    monkeypatch.setattr(divergence, "ENTRIES", 30 if few == 2 else 1 << 19)
    docs = made()
    got = divergence.audit(spark.createDataFrame([(*d, 1, 2, "t", 3, 4, 5) for d in docs], SCHEMA).repartition(3), top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == wanted(docs, top=top)


def test_large_counts_are_divided_exactly(spark):
    """p at the bounds of its docstring, against whole numbers of any size."""
    rows = [(0, 1), (0, 3), (10**13, 10**13 + 7), (2 * 10**14 - 2, 2 * 10**14), (12345678901234, 98765432109876), (6, 7)]
    got = spark.createDataFrame(rows, "n bigint, m bigint").selectExpr(divergence._p("n", "m")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // m for n, m in rows]


def test_no_rows_and_no_terms(spark):
    docs = spark.createDataFrame([("1 2", "a", "x"), ("3", "a", "y")], "text string, lang string, source string")
    assert divergence.audit(docs.limit(0)).collect() == []
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
