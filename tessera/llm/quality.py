"""Quality classifier by importance resampling.

Two generative models over n-grams (known by their whole 64-bit hash), of the target text (labelled good and not toxic) and of
the raw text (all documents), give a document the log weight sum of log(p_target(g) / p_raw(g)) over its n-grams. Documents
are drawn without replacement by these weights: each gets its log weight plus standard Gumbel noise, and the k largest are
kept, the whole law of Gumbel top-k, with no other cut. k is a share of the documents: the one that is given, or the share
that rejection sampling by the same weights is expected to accept, the mean of min(1, weight).

An n-gram says nothing where its ratio is within a factor of twenty or a chance deviation, nor where the labelled bad rows do
not confirm it: text that is frequent in the raw text only because it is copied often is not bad for that. So neither length
nor rare words nor copies decide. The model holds every n-gram that passes these tests, so it grows with what the labelled
rows tell; n-grams of which the labelled rows alone say nothing are not counted over all documents.

Each n-gram counts once a text. N-grams are words and word pairs (ASCII lower case, letters and digits) and shapes of
white-space words and shape pairs.

Defined cases: a null or empty text weighs 0; the noise is a hash of doc_id and text, so that rows that share an id or have
none are drawn each for itself and exact copies of one row together; rows of labels that disagree count as bad, as do toxic
ones whatever their quality; without labels of both kinds all documents are kept; an empty table gives no rows; doc_id may
be of any type; other columns stay as they are in selected(), whatever their names, and play no part in weighed().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Chunk, chunks, cut_at, load, mixed, prefix, span, stored, words_of

#: Bytes of text whose n-grams are made at a time: the arrays take some eighty times as much, in each worker.
PIECE = 1 << 18
#: Added to the hashes of words, word pairs, shapes and shape pairs, so that these are apart.
WORDS, SHAPES = (np.uint64(1), np.uint64(2)), (np.uint64(3), np.uint64(4))
#: Labelled rows that the target model is fitted on at most, those of the least hashed id.
LABEL_LIMIT = 100_000
#: Added to both counts of a ratio.
PRIOR = 0.5
#: An n-gram counts if its ratio, either way, and its deviation in standard errors are at least these.
LEAST_RATIO = 20.0
LEAST_DEVIATION = 4.0
#: And it stands in so many labelled documents, good or bad ones.
LEAST_DOCUMENTS = 4

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_IS_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_SHAPE = np.arange(256, dtype=np.uint8)
for _b in range(256):
    _SHAPE[_b] = 65 if 65 <= _b < 91 else 97 if 97 <= _b < 123 or _b >= 128 else 48 if 48 <= _b < 58 else _b


def _grams(hashes: np.ndarray, heads: np.ndarray, kinds: tuple[np.uint64, np.uint64]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the single items and of pairs of consecutive ones within a text, and the text of each."""
    doc = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    same = doc[1:] == doc[:-1]
    pairs = mixed(hashes[:-1][same] * np.uint64(3) + hashes[1:][same])
    return np.concatenate([mixed(hashes + kinds[0]), mixed(pairs + kinds[1])]), np.concatenate([doc, doc[1:][same]])


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each n-gram of the chunk's texts, as often as it stands there."""
    if not len(c.buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # words of letters and digits: other bytes become blanks
    clean = Chunk(np.where(_IS_WORD[c.buf], _PLAIN[c.buf], np.uint8(32)), c.offs, c.first)
    starts, ends, heads = words_of(clean)
    g1, d1 = _grams(mixed(span(prefix(clean.buf), starts, ends)), heads, WORDS)
    # shapes: classes of bytes, runs of one class drawn together, within a white-space word
    starts, ends, heads = words_of(c)
    shape = _SHAPE[c.buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    g2, d2 = _grams(mixed(span(prefix(shape[keep]), at[starts], at[ends])), heads, SHAPES)
    return np.concatenate([g1, g2]), np.concatenate([d1, d2])


def _once(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each n-gram of a text: a line repeated a thousand times says no more than one."""
    return mixed(gram + mixed(doc.astype(np.uint64) + np.uint64(1)))


def distinct(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once a text."""
    at = np.unique(_once(gram, doc), return_index=True)[1]
    return gram[at], doc[at]


class Table:
    """Sorted n-grams, found by their hash; most others are passed over by its upper bits."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.shift = np.uint64(64 - min(24, max(12, len(grams).bit_length() + 4)))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)
        self.some[(grams >> self.shift).astype(np.int64)] = True

    def find(self, gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table and text of those n-grams that it has, each once a text."""
        near = np.flatnonzero(self.some[(gram >> self.shift).astype(np.int64)])
        gram, doc = gram[near], doc[near]
        if not len(gram):
            return np.zeros(0, np.int64), doc
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = self.grams[at] == gram
        gram, doc = distinct(gram[hit], doc[hit])
        return np.searchsorted(self.grams, gram), doc


def key_of(doc_id: Column, kind: T.DataType) -> Column:
    """A 64-bit number for ids of any type: integers stand for themselves."""
    return doc_id.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(doc_id)


def labelled(labels: DataFrame, limit: int = LABEL_LIMIT, kind: T.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and whether each is good, of at most limit labelled documents. kind: the type of the documents' ids."""
    kind = kind or labels.schema["doc_id"].dataType
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    own = labels.where("doc_id is not null and (quality is not null or toxic = 1)").select(F.col("doc_id").try_cast(kind).alias("_id"), good.cast("int").alias("_good"))
    rows = own.where("_id is not null").groupBy(key_of(F.col("_id"), kind).alias("id")).agg(F.min("_good").alias("good"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(limit).toPandas().sort_values("id")
    return rows["id"].to_numpy(np.int64), rows["good"].to_numpy(np.int8)


def look_up(ids: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of ids, -1 where not known."""
    if not len(known):
        return np.full(len(ids), -1, np.int8)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, values[at], np.int8(-1))


def over(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log ratio; none where it may be chance or is small."""
    ratio = np.log((seen + PRIOR) / (expected + PRIOR))
    return np.where((np.abs(seen - expected) < LEAST_DEVIATION * np.sqrt(expected + 1)) | (np.abs(ratio) < np.log(LEAST_RATIO)), 0.0, ratio)


def ratios(documents: DataFrame, labels: DataFrame, limit: int = LABEL_LIMIT) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The n-grams that count, sorted, with log(p_target / p_raw) of each, from counts over all documents; and the labelled ids."""
    sc = documents.sparkSession.sparkContext
    kind = documents.schema["doc_id"].dataType
    known = labelled(labels, limit, kind)
    told = sc.broadcast(known)
    texts = documents.select(key_of(F.col("doc_id"), kind).alias("id"), F.col("text").cast("binary"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = look_up(batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), *told.value)
            own = label >= 0
            batch, label = batch.filter(pa.array(own)), label[own]
            for c in chunks(batch.column(1), PIECE):
                gram, doc = distinct(*features(c))
                gram, at = np.unique(gram, return_inverse=True)
                good = label[c.first + doc] == 1
                sums = [np.bincount(at[x], minlength=len(gram)) for x in (good, ~good)]
                # without a gram: the sums over all
                yield pa.RecordBatch.from_arrays([pa.array(np.append(gram.view(np.int64), 0), mask=np.arange(len(gram) + 1) == len(gram)), *[pa.array(np.append(x, x.sum())) for x in sums]], ["gram", "good", "bad"])

    seen = texts.mapInArrow(tell, "gram long, good long, bad long").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seen = stored(seen.where((F.greatest("good", "bad") >= LEAST_DOCUMENTS) | F.col("gram").isNull()))
    totals = seen.where("gram is null").first()
    n_good, n_bad = (float(totals["good"]), float(totals["bad"])) if totals else (0.0, 0.0)
    seen = seen.where("gram is not null")
    none = (np.zeros(0, np.uint64), np.zeros(0))
    if not n_good or not n_bad:
        return none, known
    # what over() may take of labelled good against bad: the others have no weight, whatever their count over all documents
    expected = F.col("good") * (n_bad / n_good)
    apart = (F.abs(F.col("bad") - expected) >= (LEAST_DEVIATION - 1e-6) * F.sqrt(expected + 1)) & (F.abs(F.log((F.col("bad") + PRIOR) / (expected + PRIOR))) >= np.log(LEAST_RATIO) - 1e-6)
    rows = seen.where(apart).toArrow()
    grams, target, bad = (rows.column(k).to_numpy() for k in range(3))
    order = np.argsort(grams.view(np.uint64))
    grams, target, bad = grams.view(np.uint64)[order], target[order].astype(float), bad[order].astype(float)
    sent = sc.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        sums, total = np.zeros(len(table.grams), np.int64), 0
        for batch in batches:
            for c in chunks(batch.column(1), PIECE):
                gram, doc = features(c)
                total += len(np.unique(_once(gram, doc)))
                sums += np.bincount(table.find(gram, doc)[0], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(total, sums[at]))], ["at", "raw"])

    raw, n_raw = np.zeros(len(grams)), 0.0
    rows = texts.mapInArrow(count, "at long, raw long").groupBy("at").agg(F.sum("raw").alias("raw")).toArrow()
    at, sums = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    raw[at[at >= 0]], n_raw = sums[at >= 0], float(sums[at < 0].sum())
    ratio = over(target, raw * (n_good / n_raw))
    ratio[ratio * over(bad, target * (n_bad / n_good)) >= 0] = 0
    return (grams[ratio != 0], ratio[ratio != 0]), known


def noise(doc_id: Column, text: Column, seed: int) -> Column:
    """Standard Gumbel noise."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, doc_id.isNull(), text, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def with_weight(documents: DataFrame, ratio: tuple[np.ndarray, np.ndarray], names: tuple[str, str], text: bool, seed: int = 11) -> DataFrame:
    """documents (or doc_id alone) with two more columns: the log weight, and the log weight plus Gumbel noise."""
    sent = documents.sparkSession.sparkContext.broadcast(ratio)
    kept = documents.columns if text else ["doc_id"]

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, ratio = sent.value
        table = Table(grams)
        for texts in batches:
            weight = np.zeros(len(texts))
            for c in chunks(texts, PIECE):
                at, doc = table.find(*features(c))
                weight[c.first : c.first + c.n] = np.bincount(doc, ratio[at], c.n)
            yield pa.array(weight)

    # the text goes to Python once, a number comes back; the columns stay in the JVM
    own = documents.select(*[F.col(f"`{c}`") for c in kept], noise(F.col("doc_id"), F.col("text"), seed).alias(names[1]), score(F.col("text").cast("binary")).alias(names[0]))
    return own.select(*[F.col(f"`{c}`") for c in kept], names[0], (F.col(names[0]) + F.col(names[1])).alias(names[1]))


def top_cut(scores: DataFrame, names: tuple[str, str], share: float | None) -> float:
    """The value of the perturbed log weight over which the k rows of the sample lie; -inf if all are kept."""
    weight, z = F.col(names[0]), F.col(names[1])
    n, least, most, accepted = scores.agg(F.count("*"), F.min(z), F.max(z), F.sum(F.least(F.exp(F.least(weight, F.lit(0.0))), F.lit(1.0)))).first()
    k = round(n * share) if share is not None else round(accepted or 0)
    if k >= n or least == most:
        return -np.inf
    span = (most - least) * (1 + 1e-9)
    cut = cut_at(scores.select(((F.lit(most) - z) / span).alias("_key")), "_key", None, k)
    return most - cut * span


def free_names(documents: DataFrame) -> tuple[str, str]:
    """Two column names that documents does not have, whatever their case."""
    taken, k = {c.lower() for c in documents.columns}, 0
    while {f"_weight{k}", f"_drawn{k}"} & taken:
        k += 1
    return f"_weight{k}", f"_drawn{k}"


def weighed(documents: DataFrame, labels: DataFrame, text: bool = False, share: float | None = None, seed: int = 11) -> tuple[DataFrame, tuple[str, str], float]:
    """doc_id (or all columns) with the log weight and the perturbed one, their names, and the cut of the latter. Stored once."""
    ratio, _ = ratios(documents, labels)
    names = free_names(documents)
    scores = stored(with_weight(documents, ratio, names, text, seed))
    return scores, names, top_cut(scores, names, share) if len(ratio[0]) else -np.inf


def selected(documents: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11) -> DataFrame:
    """The documents that are kept."""
    scores, (_, drawn), cut = weighed(documents, labels, True, share, seed)
    return scores.where(F.col(drawn) > cut).select(*[F.col(f"`{c}`") for c in documents.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, (weight, drawn), cut = weighed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scores.select("doc_id", F.col(weight).alias("log_weight"), F.col(drawn).alias("perturbed"), (F.col(drawn) > cut).alias("kept"))
