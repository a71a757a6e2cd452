"""How the sources of a language differ in their words: pairs of sources by a chi-square-like distance, and each source's own terms.

Tasks count terms by (lang, source) before anything is shuffled; one shuffle by (lang, term) then adds up the counts, finds
in how many documents of the language a term is, and keeps the frequent ones. Only counts above zero are ever rows.

Pairs: a term that neither source has adds the same number f0 for all such terms, so the sum over all kept terms is V * f0 and
corrections: for the terms of the one source, for those of the other (both from a source's histogram of counts), and for
those of both. The last come from rows that list a term's sources; their pairs are summed up in whole arrays within a task, and a
task sends one row a pair of sources and array.

Terms: each group's 200th largest value is found by radix selection. Rounds over the values' bits, the highest first, count the rows of each digit
in each group; the digit in which the 200th lies is kept, and the next round looks only there. Where several terms share the
last value, rounds over two bytes of UTF-8 at a time settle them likewise. At most 200 + FEW rows a group are then sorted.

All arithmetic is on whole numbers: 10**9 * (c + 1) / M is divided in two steps, exact up to counts of 2 * 10**14.

Defined results: null text, lang and source count as empty, which is a value like any other; texts without terms make a group all the
same; repeated rows are documents of their own; a language without kept terms has pairs of value 0 and no terms; equal values rank by the
UTF-8 bytes of the item; an empty table gives no rows; other columns, doc_id too, are never read. A text is handled in one task, with
about 100 bytes of memory for each of its words. A language's sources are listed in a term's row, and their pairs are the result, so sources
may number some ten thousand a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, encoded, kept, pieces

LEAST_DOCS, TOP = 3, 200
#: Entries of a task's counts, and words it numbers, before they are sent on.
ENTRIES = 1 << 19
#: Bits of a round of the selection; undecided rows of a group that a sort may take instead of further rounds; pairs worked on at a time.
RADIX, FEW, PAIRS = 12, 1000, 1 << 19
#: A-Z as a-z; what is no letter or byte of a longer character parts words.
_PLAIN = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_LOW = np.int64((1 << 32) - 1)


class _Numbers(dict):
    """Numbers for values in the order in which they are met."""

    def __missing__(self, value) -> int:
        self[value] = found = len(self)
        return found


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys with the sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, dtype=np.int64)
    return [key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)]


def _counted(batches):
    """(lang, source, term, n, docs) of a task, where a group and term may have several rows."""
    groups, terms, held, size = _Numbers(), _Numbers(), [], 0

    def rows():
        key, n, docs = _summed(*map(np.concatenate, zip(*held, strict=True)))
        lang, source = (pa.array(list(c), pa.string()) for c in zip(*groups, strict=True))
        words = pa.array(list(terms), pa.binary()).cast(pa.string())
        for k in range(0, len(key), 1 << 16):
            g, t = pa.array(key[k : k + (1 << 16)] >> 32), pa.array(key[k : k + (1 << 16)] & _LOW)
            yield pa.record_batch({"lang": lang.take(g), "source": source.take(g), "term": words.take(t), "n": pa.array(n[k : k + (1 << 16)]), "docs": pa.array(docs[k : k + (1 << 16)])})

    for b in pieces(batches):
        parted = [t.translate(_PLAIN).split() for t in encoded(b.column("text"))]
        words = [w for x in parted for w in x]
        ids = np.fromiter(map(terms.__getitem__, words), dtype=np.int64, count=len(words))
        doc = np.repeat(np.arange(len(parted), dtype=np.int64), [len(x) for x in parted])
        group = np.array([groups[x] for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], dtype=np.int64)
        met, n = np.unique((doc << 32) | ids, return_counts=True)
        part = _summed((group[met >> 32] << 32) | (met & _LOW), n, np.ones(len(met), dtype=np.int64))
        held.append(part)
        size += len(part[0])
        if size > 2 * ENTRIES:
            held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
        # sent on when adding up no longer makes them few
        if ENTRIES < size <= len(held[0][0]) or len(terms) > ENTRIES:
            yield from rows()
            groups, terms, held, size = _Numbers(), _Numbers(), [], 0
    if held and size:
        yield from rows()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, of_lang, first): occurrences above zero of the kept terms; first: 1 in one of a term's rows."""
    parts = _texts(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # dealt once; what follows needs no other partitioning
    rows = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"of_lang": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("long")})
    return rows.filter(F.col("in_docs") >= least_docs).select("lang", "term", "source", "n", "of_lang", "first")


def _groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, lang, source, m, m_lang, v, p0): every group of docs; m: its total and the number of kept terms; p0: its p of a term it lacks."""
    every = _texts(docs).select("lang", "source").distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = own.groupBy("lang").agg(F.sum("own").alias("all")).join(terms.groupBy("lang").agg(F.sum("first").alias("v")), "lang")
    out = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "all", "v"])
    out = out.select(F.monotonically_increasing_id().alias("id"), "lang", "source", (F.col("own") + F.col("v")).alias("m"), (F.col("all") + F.col("v")).alias("m_lang"), "v")
    return kept(out.withColumn("p0", F.expr(f"if(m > 0, {_p('0L', 'm')}, 1L)")), "divergence-groups")


def _p(n: str, m: str) -> str:
    """SQL: 1 + floor(10**9 * (n + 1) / m), in two steps so that nothing overflows."""
    x = f"({n} + 1) * 31250L"
    return f"(1L + {x} div {m} * 32000L + {x} % {m} * 32000L div {m})"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _common(batches):
    """From rows (sources: id, p, p0 of a term) to (a, b, more): what terms of both a and b add, beyond what each adds alone."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        sources = batch.column("sources")
        at = np.asarray(sources.offsets).astype(np.int64)
        ids, p, p0 = (np.asarray(sources.values.field(k)).astype(np.int64) for k in range(3))
        ids, no = np.unique(ids, return_inverse=True)
        sizes, row = np.diff(at), 0
        done = np.concatenate([[0], np.cumsum(sizes * sizes)])
        while row < len(sizes):
            # whole rows with about PAIRS pairs; one row's pairs at least
            end = max(row + 1, int(np.searchsorted(done, done[row] + PAIRS, side="right")) - 1)
            size = sizes[row:end]
            count = size * size
            base = np.repeat(at[row:end], count)
            place = np.arange(count.sum()) - np.repeat(done[row:end] - done[row], count)
            wide = np.repeat(size, count)
            a, b = base + place // wide, base + place % wide
            other = a != b
            a, b = a[other], b[other]
            more = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key, total = _summed(no[a] * len(ids) + no[b], more)
            yield pa.record_batch({"a": pa.array(ids[key // len(ids)]), "b": pa.array(ids[key % len(ids)]), "more": pa.array(total)})
            row = end


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, item, value): ids of groups, each other source of the language, and the distance. rows: (lang, term, id, p, p0)."""
    small = groups.select("id", "lang", "source", "p0", "v")
    one = small.select(F.col("id").alias("a"), "lang", F.col("p0").alias("p_a"), "v")
    two = small.select(F.col("id").alias("b"), "lang", F.col("source").alias("item"), F.col("p0").alias("p_b"))
    both = one.join(two, "lang").filter("a != b").withColumn("f0", F.expr(_f("p_a", "p_b")))
    lists = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0")).alias("sources")).filter("size(sources) > 1")
    more = lists.select("sources").mapInArrow(_common, "a long, b long, more long").groupBy("a", "b").agg(F.sum("more").alias("more"))
    spread = rows.groupBy("lang", "id", "p").agg(F.count(F.lit(1)).alias("n"))
    met = spread.join(small.select("lang", F.col("id").alias("with"), F.col("p0").alias("q0")), "lang").filter("id != with")
    own = small.select("id", F.col("p0").alias("o0"))
    met = met.join(own, "id")
    alone = met.select(F.col("id").alias("a"), F.col("with").alias("b"), F.expr(f"n * ({_f('p', 'q0')} - {_f('o0', 'q0')})").alias("more"))
    alone = alone.unionByName(met.select(F.col("with").alias("a"), F.col("id").alias("b"), F.expr(f"n * ({_f('q0', 'p')} - {_f('q0', 'o0')})").alias("more")))
    added = alone.unionByName(more).groupBy("a", "b").agg(F.sum("more").alias("more"))
    value = F.expr("if(v = 0, 0L, v * f0 + coalesce(more, 0L))")
    return both.join(added, ["a", "b"], "left").select(F.col("a").alias("id"), "item", value.alias("value"))


def _bytes(first: int, last: int) -> str:
    """SQL: the item's UTF-8 bytes, from one to another, as hex digits, which sort like the bytes."""
    return f"substr(hex(encode(item, 'UTF-8')), {2 * first + 1}, {2 * (last - first)})"


def largest(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The k largest values of each id, equal ones by the item's bytes: rows (id, item, value) of a stored table, items distinct in an id."""
    spark, made = rows.sparkSession, []

    def chosen(digits: DataFrame, bounds: DataFrame, order) -> DataFrame:
        """bounds with the digit in which the last wanted row lies, how many are wanted there (need) and how many are there (size)."""
        before = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        there = digits.withColumn("above", F.coalesce(F.sum("size").over(before), F.lit(0))).join(bounds.drop("size"), "id")
        found = there.filter("above < need AND above + size >= need").withColumn("need", F.col("need") - F.col("above")).drop("above")
        made.append(kept(found, "divergence-bounds"))
        return made[-1]

    # groups with k rows or fewer give all of theirs
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.max("value").alias("most"))
    bounds = kept(counted.withColumn("need", F.least(F.col("size"), F.lit(k)).cast("long")).select("id", "size", "need", "most", F.lit(0).cast("long").alias("high")), "divergence-bounds")
    made.append(bounds)
    top, open_rows = bounds.agg(F.coalesce(F.max("most"), F.lit(0)), F.coalesce(F.max(F.when(F.col("size") > F.col("need"), F.col("size"))), F.lit(0))).first()
    bounds = bounds.drop("most")
    shift = min(63, max(1, int(top).bit_length()))
    while shift and open_rows > FEW:
        above, shift = shift, max(0, shift - RADIX)
        met = rows.join(bounds.select("id", "high"), "id").filter(f"shiftright(value, {above}) = high")
        digits = met.groupBy("id", F.expr(f"shiftright(value, {shift})").alias("digit")).agg(F.count(F.lit(1)).alias("size"))
        bounds = chosen(digits, bounds, F.col("digit").desc()).withColumn("high", F.col("digit")).drop("digit")
        open_rows = bounds.agg(F.coalesce(F.max(F.when(F.col("size") > F.col("need"), F.col("size"))), F.lit(0))).first()[0]
    bounds, width = bounds.withColumn("start", F.lit("")), 0
    while open_rows > FEW:
        # the values are settled; the items that share the last one go by their bytes
        met = rows.join(bounds.select("id", "high", "start"), "id").filter(f"value = high AND {_bytes(0, width)} = start")
        digits = met.groupBy("id", F.expr(_bytes(width, width + 2)).alias("digit")).agg(F.count(F.lit(1)).alias("size"))
        bounds = chosen(digits, bounds, F.col("digit").asc()).withColumn("start", F.concat("start", "digit")).drop("digit")
        width += 2
        open_rows = bounds.agg(F.coalesce(F.max(F.when(F.col("size") > F.col("need"), F.col("size"))), F.lit(0))).first()[0]
    left = rows.join(bounds.select("id", "high", "start"), "id")
    left = left.filter(f"shiftright(value, {shift}) > high OR shiftright(value, {shift}) = high AND {_bytes(0, width)} <= start").drop("high", "start")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("value").desc(), "item"))
    out = kept(left.withColumn("rank", place).filter(F.col("rank") <= k), "divergence-top")
    dropped(spark, *made)
    return out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' with all other sources, part 'term' with the source's `top` terms."""
    spark = docs.sparkSession
    terms = kept(counts(docs, least_docs), "divergence-counts")
    groups = _groups(docs, terms)
    rows = terms.join(groups, ["lang", "source"])
    rows = rows.select("lang", "term", "id", F.expr(_p("n", "m")).alias("p"), "p0", F.expr(_p("of_lang", "m_lang")).alias("q"))
    pairs = kept(_pairs(rows, groups), "divergence-pairs")
    own = kept(rows.filter("p > q").select("id", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value")), "divergence-own")
    best = largest(own, top)
    dropped(spark, own, terms)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("value").desc(), "item"))  # as many rows as the language has sources
    both = pairs.select("id", F.lit("pair").alias("part"), "item", "value", place.alias("rank")).unionByName(best.select("id", F.lit("term").alias("part"), "item", "value", "rank"))
    return both.join(groups.select("id", "lang", "source"), "id").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), terms AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), langs AS (SELECT lang, count(*) AS v, sum(n) AS n_all FROM terms GROUP BY lang
), own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN terms USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(s.n_all, 0) AS n_all FROM (SELECT DISTINCT lang, source FROM texts) g
  LEFT JOIN (SELECT lang, source, sum(n) AS n_all FROM own GROUP BY ALL) s USING (lang, source)
), dense AS (
  SELECT g.lang, g.source, t.term, coalesce(o.n, 0) AS c,
    1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (g.n_all + l.v) AS p, 1 + 1000000000::HUGEINT * (t.n + 1) // (l.n_all + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN terms t USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = t.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE c > 0 AND p > q
), places AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM both_parts
)
SELECT lang, source, part, item, value::BIGINT AS value, place::INT AS rank FROM places WHERE part = 'pair' OR place <= 200
"""
