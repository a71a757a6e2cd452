"""Quality rules as a bitmask ledger.

Every rule is evaluated once: the ledger keeps each document's measurements and one bit a failed
rule. A policy is a version name with a mask of rules; applying it is one bitwise AND. An ablation
counts, for each rule of a policy, the documents that fail it and those that fail nothing else.

Defined results: a null text counts as empty, has measurements 0 and fails too_few_words; ties
and repeated rows are measured row by row; an empty table gives an empty ledger; the ledger carries
no other column of the input, so names cannot clash. A text is measured whole in one task, which holds its five-word
windows (about six times the text) while it does; rows of one null or repeated doc_id stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Five words from each word on, in a text whose words are parted by one space.
GRAMS = r"(?<![^ ])(?=([^ ]++(?: [^ ]++){4}))[^ ]++"

#: Rules in bit order; a rule is never moved, only added.
RULES = {
    "too_few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "few_letters": "2 * n_letters < word_chars",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]
#: Policies by version.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["short_words"] | BIT["long_words"] | BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["few_letters"],
}
LATEST = "v1"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with measurements; built-in functions only, one pass, no shuffle."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns(
        {
            "plain": F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")),
            "lines": F.expr(r"filter(split(text, '\n'), x -> trim(BOTH ' \t\n\u000b\u000c\r' FROM x) != '')"),
        }
    )
    d = d.withColumns(
        {
            "word_chars": F.length(F.translate("plain", " ", "")).cast("long"),
            "n_symbols": (F.length("plain") - F.length(F.translate("plain", "#*$%&|<>", ""))).cast("long"),
            "n_letters": F.length(F.regexp_replace("plain", r"[^\p{L}]+", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "grams": F.regexp_extract_all("plain", F.lit(GRAMS), F.lit(1)),
        }
    )
    d = d.withColumn("n_words", F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.col("word_chars") + 1).cast("long"))
    # only a text that repeats a window pays for sorting its windows
    d = d.withColumn("sorted", F.expr("IF(size(array_distinct(grams)) < size(grams), sort_array(transform(grams, (g, i) -> struct(g, i))), NULL)"))
    d = d.withColumn("twice", F.expr("sort_array(transform(filter(sorted, (x, i) -> x.g = get(sorted, i - 1).g OR x.g = get(sorted, i + 1).g), x -> x.i))"))
    covered = f"aggregate(twice, struct(0L AS n, 0 AS upto), (a, p) -> struct(a.n + least({WINDOW}, p + {WINDOW} - a.upto) AS n, p + {WINDOW} AS upto), a -> a.n)"
    d = d.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and fail_bits of each document."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs).withColumn("fail_bits", total.cast("long"))


def applied(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """A ledger with base_failed and kept under a policy."""
    under = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    return rows.withColumns({"base_failed": under(BASE) != 0, "kept": under(POLICIES[policy] | BASE) == 0})


def ablation(rows: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that fail only it, and that the policy rejects.

    The ledger shrinks to at most 2**rules bit patterns before anything is compared.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(p, mask, r, BIT[r]) for p, mask in POLICIES.items() for r in RULES if mask & BIT[r]]
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for p, m, r, b in pairs]))
    rows = patterns.withColumn("x", grid).select("fail_bits", "n", "x.*")
    under = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("policy", "rule").agg(
        count(under.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(under == F.col("bit")).alias("n_only"),
        count(under != 0).alias("n_rejected"),
    )


def report(docs: DataFrame) -> DataFrame:
    out = applied(ledger(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM w
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(array_to_string(regexp_extract_all(text, '[#*$%&|<>]'), '')) AS n_symbols,
         length(array_to_string(regexp_extract_all(text, '\p{L}'), '')) AS n_letters,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 5 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END) AS fail_bits FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM f
"""
