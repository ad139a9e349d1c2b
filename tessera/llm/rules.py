"""Quality rules as a bitmask ledger, in DataFrame functions only.

ledger() evaluates every rule once and stores the failures of a document as the bits of one integer beside its
measurements. A policy is a versioned mask of rules: verdicts and ablations are bit operations on the ledger, and no text
is read again.

Defined cases: a null or empty text has no words and fails few_words alone; repeated rows are rows of their own; an empty
table gives no rows; other columns stay as they are in judged(), and play no part in the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, load, stored

#: Open word list of the abuse rule; ASCII lower case.
ABUSE = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "bastard", "bitch", "retard", "asshole", "fuck", "shit", "cunt", "whore", "slut")
SYMBOLS = "#*$%&|<>"



def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "upper_case": 2 * F.col("n_upper") > F.col("word_chars"),
        "abuse": F.col("n_abuse") >= 2,
    }


BITS = {name: 1 << k for k, name in enumerate(("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "upper_case", "abuse"))}
#: Versions stay as they were published; new ones are added. The base is part of each.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_words"],
    "v1": sum(BITS[x] for x in ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")),
    "v2": sum(BITS.values()),
}


def covered(keys: Column) -> Column:
    """Words that stand in a three-word window found twice or more; keys are the windows in order."""
    spots = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    # sorted by window, so equal ones are neighbours; bound to a variable, else each element would sort anew
    twice = F.transform(F.array(spots), lambda all_: F.filter(all_, lambda s, j: F.coalesce(F.get(all_, j - 1)["k"] == s["k"], F.lit(False)) | F.coalesce(F.get(all_, j + 1)["k"] == s["k"], F.lit(False))))[0]
    places = F.array_sort(F.transform(twice, lambda s: s["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + (i + 3 - F.greatest(i, a["end"]))).alias("n"), (i + 3).alias("end")), lambda a: a["n"])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the measurements of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whites = "\x20\x09\x0a\x0b\x0c\x0d"
    low = documents.select("doc_id", text.alias("_t"), F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    low = low.select("*", lines.alias("_l"), F.size("_w").alias("_n"))
    windows = lambda make: F.when(F.col("_n") >= 3, F.zip_with(F.zip_with("_w", F.slice("_w", 2, F.greatest(F.col("_n") - 2, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("_w", 3, F.greatest(F.col("_n") - 2, F.lit(1))), lambda p, c: make(p["a"], p["b"], c)))
    # short hashes first: where they are all distinct, so are the windows; else whole windows decide
    some = F.slice(windows(lambda a, b, c: F.xxhash64(a, b, c)), 1, F.greatest(F.col("_n") - 2, F.lit(0)))
    full = F.slice(windows(lambda a, b, c: F.concat_ws(" ", a, b, c)), 1, F.greatest(F.col("_n") - 2, F.lit(0)))
    repeats = F.when(F.col("_n") < 4, F.lit(0).cast("long")).when(F.size(F.array_distinct(some)) == F.col("_n") - 2, F.lit(0).cast("long")).otherwise(covered(full))
    size = lambda c: F.length(c).cast("long")
    return low.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        size(F.translate("_t", whites, "")).alias("word_chars"),
        (size(F.col("_t")) - size(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (size(F.col("_t")) - size(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        F.when(F.col("_t").rlike("(?i:" + "|".join(ABUSE) + ")"), F.regexp_count("_t", F.lit(r"(?i:\b(?:" + "|".join(ABUSE) + r")\b)"))).otherwise(F.lit(0)).cast("long").alias("n_abuse"),
    )


def ledger(documents: DataFrame) -> DataFrame:
    """The measurements and failures (long): one bit a rule."""
    rules = _rules()
    mask = sum((F.when(rules[name], F.lit(bit)).otherwise(F.lit(0)) for name, bit in BITS.items()), F.lit(0))
    return measured(documents).withColumn("failures", mask.cast("long"))


def passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """rule, failed, only: documents that fail each rule of a policy, and those that pass once that rule is dropped."""
    mask = POLICIES[policy]
    own = [(name, bit) for name, bit in BITS.items() if bit & mask]
    kept = F.col("failures").bitwiseAND(F.lit(mask))
    counts = book.agg(*[F.count_if(kept.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{name}") for name, bit in own], *[F.count_if(kept == bit).alias(f"o_{name}") for name, bit in own])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("failed"), F.col(f"o_{name}").alias("only")) for name, _ in own])))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; verdicts of its versions, and which rule alone rejects a document, are bit operations on it."""
    book = stored(ledger(load(spark, sf_dir, "documents")))
    failures = F.col("failures")
    sole = F.when(failures.bitwiseAND(failures - 1) == 0, failures).otherwise(F.lit(0)).cast("long")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v2").alias("kept"), "failures", passes("v1").alias("kept_v1"), sole.alias("sole_failure"))


_LIST = ", ".join(f"'{w}'" for w in ABUSE)
OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT row_no, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), g AS (
  SELECT row_no, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, k) AS n FROM g) WHERE n > 1
), r AS (
  SELECT row_no, count(DISTINCT j) AS n FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY row_no
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    len(regexp_extract_all(t, '(?i)\\b(?:{"|".join(ABUSE)})\\b')) AS n_abuse
  FROM w LEFT JOIN r USING (row_no)
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) + (CASE WHEN n_abuse >= 2 THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures, failures & 31 = 0 AS kept_v1, CASE WHEN failures & (failures - 1) = 0 THEN failures ELSE 0 END AS sole_failure FROM f
"""
