"""Secret scans: fixed patterns, and a randomness test battery over long tokens, in DataFrame functions only.

A token of TOKEN is read in the narrowest encoding that its characters allow. Three tests ask whether it may be random:
chi-squared for a uniform alphabet, runs about the middle of the alphabet, and serial correlation. Tokens that none of them
rejects are held against the opposite null, that the token is text: under it letters repeat, so that the expected
chi-squared grows with the length, and symbols of one class (upper, lower, digit, other) stand together, so that runs of one
class are few; this serial dependence of classes parts text from noise also where a token is too short for chi-squared alone.
The two deviations, each in units of its spread under text of that encoding, are drawn together into one p-value, so that a
long token that still looks uniform has a small one. A Benjamini-Hochberg step-up over the tokens of each encoding in the
corpus bounds the share of false finds among them, whatever the other encodings hold; its threshold is the fixed point of
t = q * #(p <= t) / #tokens, found by counting. A token ends at an inner '='.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; an empty table gives no rows; other
columns stay as they are in redacted(), and play no part in scan().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored

# The base kinds in their order. A run that is too short can hold no longer match, so the length is part of
# the pattern where the run is maximal; an assignment's is checked after the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: With '=' at the end only; of these, tokens are those of 20 characters or more.
TOKEN = r"[A-Za-z0-9+/_-]{16,}=*"
LEAST = 20
#: Encodings in the order in which they are tried: pattern, alphabet, and of text in it: k * (chance that two symbols agree)
#: - 1, share of symbols that change class, spread of that share within tokens (times root n) and between them. Set by
#: simulation: ASCII prose written in hex, upper-case prose with some digits, identifiers and paths.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", 0.0, 0.0, 1.0, 0.0),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.2, 0.2, 0.6, 0.0),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0, 0.08, 0.35, 0.03),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.6, 0.27, 0.8, 0.1),
)
ONE_CLASS = "[A-Z]+|[a-z]+|[0-9]+|[+/]+"
FALSE_SHARE = 0.01
REJECT = 0.001

#: Matches that are placed one after the other.
BLOCK = 256
SPAN = "array<struct<s:int,o:int,e:int>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, value=None) -> Column:
    """(start, kind, end) of the matches, leftmost and not overlapping; what stands between them gives the places."""
    p = F.lit(pattern)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, 0), lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("m")))
    if keep is not None:
        parts = F.zip_with(parts, F.regexp_extract_all(text, p, 2), lambda x, g: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), g.alias("g")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,o:int,e:int,m:string,ok:boolean>>").alias("out"))
    span = lambda s, e, m, ok: F.struct(s.alias("s"), F.lit(kind).alias("o"), e.alias("e"), m.alias("m"), ok.alias("ok"))

    def step(a, x):
        s = a["at"] + x["gap"]
        e = s + F.length(x["m"])
        ok = keep(x["g"]) if keep is not None else F.lit(True)
        return F.when(x["m"].isNull(), F.struct(s.alias("at"), a["out"].alias("out"))).otherwise(F.struct(e.alias("at"), F.concat(a["out"], F.array(span(s, e, x["m"], ok))).alias("out")))

    def within(p):
        # a block's places are counted from its own start, so that no list grows with all matches of the text
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(p, i * BLOCK + 1, F.lit(BLOCK)), begin, step))

    def joined(blocks):
        heads = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        heads = F.aggregate(blocks, heads, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, heads, lambda b, h: F.transform(b["out"], lambda x: span(x["s"] + h, x["e"] + h, x["m"], x["ok"]))))

    spans = F.transform(F.transform(F.array(parts), within), joined)[0]
    found = F.filter(spans, lambda x: x["ok"])
    out = F.transform(found, value or (lambda x: F.struct(x["s"], x["o"], x["e"])))
    none = F.filter(F.transform(F.array(F.struct(F.lit(0).alias("s"), F.lit(kind).alias("o"), F.lit(0).alias("e"), F.lit("").alias("m"), F.lit(False).alias("ok"))), value or (lambda x: F.struct(x["s"], x["o"], x["e"]))), lambda x: F.lit(False))
    return F.when(text.rlike(pattern), out).otherwise(none)


def normal_cdf(z: Column) -> Column:
    """Of the standard normal law, by a rational approximation (absolute error below 1e-7, relative one small in the tail)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


TEXT = ("phi", "change", "within", "between")


def _battery(token: Column) -> Column:
    """enc: index of the encoding; p: p_text of a token that may be random, 1 of one that is not, null of one not tested."""
    # upper-case hex counts as hex; the URL-safe digits of base64 as the plain ones; padding is not a symbol
    name = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        name = F.when(token.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(name)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), name + 1)
    head = F.struct(
        F.translate(F.when(name == 1, F.lower(token)).otherwise(token), "-_=", "+/").alias("t"),
        pick([e[2] for e in ENCODINGS]).alias("abc"), pick([float(len(e[2])) for e in ENCODINGS]).alias("k"), name.alias("enc"),
        *[pick([e[k] for e in ENCODINGS]).alias(n) for k, n in enumerate(TEXT, 3)],
    )

    def tests(x):
        n = F.length(x["t"]).cast("double")
        squares = F.aggregate(F.split(x["abc"], ""), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(F.pow((F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"), F.lit(2.0))))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "q", "c", "r", "u", "f")], F.lit(-1.0).alias("l"))

        def step(a, ch):
            v = (F.call_function("instr", x["abc"], ch) - 1).cast("double")
            first, up = a["l"] < 0, v * 2 >= x["k"]
            new = F.when(first | (up != (a["l"] * 2 >= x["k"])), F.lit(1.0)).otherwise(F.lit(0.0))
            return F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), F.when(first, F.lit(0.0)).otherwise(a["c"] + a["l"] * v).alias("c"), (a["r"] + new).alias("r"), (a["u"] + up.cast("double")).alias("u"), F.when(first, v).otherwise(a["f"]).alias("f"), v.alias("l"))

        sums = F.aggregate(F.filter(F.split(x["t"], ""), lambda c: c != ""), zero, step)
        return F.struct(n.alias("n"), x["k"].alias("k"), x["enc"].alias("enc"), *[x[c].alias(c) for c in TEXT], F.length(F.regexp_replace(x["t"], ONE_CLASS, "x")).cast("double").alias("g"), squares.alias("sq"), sums.alias("a"))

    def judge(x):
        n, k, a = x["n"], x["k"], x["a"]
        chi = k * x["sq"] / n - n
        free = k - 1
        p_uniform = 1 - normal_cdf((chi - free) / F.sqrt(2 * free * (n - 1) / n))
        low = n - a["u"]
        mean = 1 + 2 * a["u"] * low / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * normal_cdf(-F.abs(a["r"] - mean) / F.sqrt(F.abs(spread) + 1e-12))).otherwise(F.lit(0.0))
        m = a["s"] / n
        about = a["q"] - n * m * m
        r = (a["c"] - m * (2 * a["s"] - a["f"] - a["l"]) + (n - 1) * m * m) / F.greatest(about, F.lit(1e-9))
        p_serial = F.when(about > 0, 2 * normal_cdf(-F.abs((r + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0))
        random = 3 * F.least(p_uniform, p_runs, p_serial) > REJECT
        far = free + (n - 1) * x["phi"]
        even = (chi - far) / F.sqrt(2 * (free + 2 * (n - 1) * x["phi"]))
        apart = ((x["g"] - 1) / (n - 1) - x["change"]) / F.sqrt(x["within"] * x["within"] / (n - 1) + x["between"] * x["between"])
        p_text = normal_cdf((even - apart) / math.sqrt(2))
        p = F.when(x["enc"].isNull() | (x["enc"] == 0) | (n < 16), F.lit(None).cast("double")).when(random, p_text).otherwise(F.lit(1.0))
        return F.struct(p.alias("p"), x["enc"].alias("enc"))

    return F.transform(F.transform(F.array(head), tests), judge)[0]


def found(text: Column) -> dict[str, Column]:
    """base: (s, o, e) of the base kinds; tokens: (s, o, e, (p, enc)) of the tested tokens."""
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, lambda g: F.length(g) >= 12), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    tokens = _spans(text, TOKEN, 3, value=lambda x: F.struct(x["s"], x["o"], x["e"], F.when(F.length(x["m"]) >= LEAST, _battery(x["m"])).alias("b")))
    return {"_base": base, "_tokens": F.filter(tokens, lambda x: x["b"]["p"].isNotNull())}


def scanned(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t")).select("doc_id", *[c.alias(n) for n, c in found(F.col("_t")).items()])


def threshold(book: DataFrame, q: float = FALSE_SHARE) -> list[float]:
    """For each encoding, the p-value up to which tokens count as found: the step-up's, over its tokens in the scanned corpus."""
    p = stored(book.select(F.explode("_tokens").alias("x")).select("x.b.p", "x.b.enc"))
    n = {r["enc"]: r["count"] for r in p.groupBy("enc").count().collect()}
    t = [q if k in n else -1.0 for k in range(len(ENCODINGS))]
    while any(x > 0 for x in t):
        hits = {r["enc"]: r["count"] for r in p.where(F.col("p") <= _of(t, F.col("enc"))).groupBy("enc").count().collect()}
        new = [min(x, q * hits[k] / n[k]) if k in hits else -1.0 for k, x in enumerate(t)]
        if new == t:
            break
        t = new
    return t


def _of(t: list[float], enc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in t]), enc + 1)


def accepted(t: list[float]) -> Column:
    """Token spans up to the threshold of their encoding that touch no base span."""
    hits = F.filter("_tokens", lambda x: (x["b"]["p"] <= _of(t, x["b"]["enc"])) & ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.transform(hits, lambda x: F.struct(x["s"], x["o"], x["e"]))


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def scan(documents: DataFrame, q: float = FALSE_SHARE) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (s, o, e), o an index in KINDS."""
    book = stored(scanned(documents))
    return book.select("doc_id", F.col("_base").alias("base"), F.array_sort(F.concat("_base", accepted(threshold(book, q)))).alias("spans"))


def redacted(documents: DataFrame, q: float = FALSE_SHARE, mark: str = "[SECRET]") -> DataFrame:
    """documents with each secret of a text replaced by mark; overlapping spans by one."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("text").alias("_t"))
    rows = stored(rows.select("_row", *[c.alias(n) for n, c in found(F.coalesce(F.col("_t"), F.lit(""))).items()]))  # each text is scanned once
    t = threshold(rows, q)
    rows = rows.withColumn("_t", F.col("_row.text"))
    spans = F.array_sort(F.concat("_base", accepted(t)))
    # at: what is written so far ends there; shown: end of the last span
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        new = F.concat(a["out"], F.array(F.substr("_t", a["at"] + 1, x["s"] - a["at"]), F.lit(mark)))
        return F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

    text = F.aggregate(spans, begin, step, lambda a: F.concat(F.concat_ws("", a["out"]), F.substr("_t", a["at"] + 1)))
    text = F.when(F.size(spans) > 0, text).otherwise(F.col("_t"))
    return rows.withColumn("_new", text).select(*[F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(load(spark, sf_dir, "documents"))
    n = lambda o: F.size(F.filter("base", lambda x: x["o"] == o)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
