import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks, repeats, suffixes


def brute(texts, w, split, join):
    items = [split((t or "").encode()) for t in texts]
    seen = Counter(tuple(x[i : i + w]) for x in items for i in range(len(x) - w + 1))
    out = []
    for x in items:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = True
        kept = join([v for v, g in zip(x, gone, strict=True) if not g])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.integers(0, 200))) for _ in range(60)]
    texts += [" ".join([*[word() for _ in range(rng.integers(0, 60))], *passage[rng.integers(0, 12) : rng.integers(40, 61)], *[word() for _ in range(rng.integers(0, 60))]]) for _ in range(60)]
    texts += [texts[3], texts[3] + " end", texts[70].replace(" ", "  "), None, "", "ab " * 400, "ab " * 401 + "c", "x" * 500, texts[5][:150] + "é" + texts[5][150:]]
    df = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")] * 3, "doc_id long, text string, h string")
    return df, [i if i % 9 else None for i in range(len(texts))] + [3] * 3, [*texts, *[texts[3]] * 3]


OPERATORS = {"bytes": (suffixes, 200, bytes, bytes, "n_bytes"), "words": (blocks, 35, bytes.split, b" ".join, "n_words")}


def rows_of(df, size):
    return sorted(((r["doc_id"], r[size], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def wanted(ids, texts, items):
    _, w, split, join, _ = OPERATORS[items]
    return sorted(((i, *x) for i, x in zip(ids, brute(texts, w, split, join), strict=True)), key=repr)


@pytest.mark.parametrize("items", OPERATORS)
@pytest.mark.parametrize("limit", [2048, 3])
def test_against_brute_force(docs, items, limit):
    df, ids, texts = docs
    assert rows_of(OPERATORS[items][0].deduplicated(df, limit=limit), OPERATORS[items][4]) == wanted(ids, texts, items)


@pytest.mark.parametrize("items", OPERATORS)
def test_long_texts_are_read_in_stretches(docs, items, monkeypatch):
    """The workers import the module anew, so its parts are called here."""
    monkeypatch.setattr(repeats, "STRETCH", 64)
    text = np.frombuffer(("  ".join(t or "" for t in docs[2]) * 2).encode(), np.uint8)
    whole = repeats.Chunk(text, np.array([0, len(text)]), 0)
    a, b, _ = repeats.words_of(whole)
    got = repeats.word_spans(text, True)
    assert got[0].tolist() == a.tolist() and got[1].tolist() == b.tolist() and got[2].tolist() == repeats.word_hashes(whole, a, b).tolist()
    values, w = (got[2], 35) if items == "words" else (text, 200)
    windows = lambda rs: sorted((lo + k, h) for r in rs for lo, n, h in zip(r["lo"].tolist(), r["n"].tolist(), r["h"].tolist(), strict=True) for k in range(n))
    assert windows(repeats.runs_within(values, w, 8)) == windows([repeats.runs_of(values, np.array([0, len(values)]), w, 8)])
    own = repeats.Text(text, items == "words")
    assert own.list is None
    words = text.tobytes().split()
    kept = b" ".join(words[:5] + words[300:]) if items == "words" else text.tobytes()[:5] + text.tobytes()[300:]
    assert own.kept(np.array([5]), np.array([300])) == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("items", OPERATORS)
@pytest.mark.parametrize("limit", [2048, 3])
def test_nothing_is_removed_without_the_method(docs, items, limit):
    df, _, texts = docs
    module = OPERATORS[items][0]
    kind = module.kind()
    blind = repeats.Kind(kind.words, kind.w, kind.g, lambda r: np.arange(len(r.n)), lambda r: np.zeros(int(r.n.sum()), bool))
    assert repeats.repeated(df, blind, limit).count() == 0


@pytest.mark.parametrize("items", OPERATORS)
def test_ids_of_any_type(docs, spark, items):
    _, ids, texts = docs
    df = spark.createDataFrame([(None if i is None else f"d{i}", t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id string, text string, t int")
    got = rows_of(OPERATORS[items][0].deduplicated(df, limit=3), OPERATORS[items][4])
    assert got == wanted([None if i is None else f"d{i}" for i in ids], texts, items)


@pytest.mark.parametrize("places", [0, 1, 32])
def test_extension_and_window_classes_mark_the_same(docs, places, monkeypatch):
    """Over the runs of every gram at once, whatever the number of places that are extended one by one."""
    monkeypatch.setattr(blocks, "PLACES", places)
    texts = [t.encode() for t in docs[2] if t and len(t.split()) >= 35]
    joined = [b" ".join(t.split()) for t in texts]
    buf, offs = np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in joined])])
    n = np.array([len(t.split()) - 34 for t in texts])
    same = np.zeros(len(n), np.int64)
    # one group; where the gram stands is not used but to tell windows apart, so that it must not
    r = repeats.Runs(buf, offs, np.arange(len(n)), same, n, same, 35)
    r.meeting = lambda run, at: np.zeros(len(run), np.uint64)
    seen = Counter(tuple(t.split()[i : i + 35]) for t in texts for i in range(len(t.split()) - 34))
    want = [seen[tuple(t.split()[i : i + 35])] > 1 for t in texts for i in range(len(t.split()) - 34)]
    assert blocks.resolve(r).tolist() == want


def test_a_class_of_other_bytes_is_left_alone(spark):
    """Where the digest is not that of the document's own bytes, as with a collision of hashes, nothing goes."""
    text = "w " * 30 + "end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for digest, gone in ((b"0" * 16, 0), (hashlib.blake2b(text.encode()[:20], digest_size=16).digest(), 20)):
        entry = F.struct(F.lit(0).alias("a"), F.lit(20).alias("b"), F.lit(0).alias("lo"), F.lit(20).alias("hi"), F.lit(digest).alias("digest"))
        assert repeats.removed(df, repeats.texts_of(df).select("t", F.array(entry).alias("r")), suffixes.kind()).first()["n_removed"] == gone


def test_empty(empty):
    assert suffixes.deduplicated(empty).count() == 0 and blocks.deduplicated(empty).count() == 0


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(2)
    buf = np.concatenate([rng.integers(97, 99, 300), np.full(200, 97), rng.integers(97, 99, 300)]).astype(np.uint8)
    starts = rng.permutation(len(buf) - 60)
    key = rng.integers(0, 3, len(starts)).astype(np.uint64)
    length = np.array([40, 13, 60])[key.astype(np.int64)]
    order, same = suffixes.Suffixes(buf).neighbours(starts, key, length)
    text = lambda i: (key[i], buf[starts[i] : starts[i] + length[i]].tobytes())
    assert [text(i) for i in order] == sorted(map(text, range(len(starts))))
    assert same.tolist() == [k > 0 and text(order[k]) == text(order[k - 1]) for k in range(len(order))]


def test_collisions_are_caught():
    buf = np.frombuffer(b"abcdeabcdx", np.uint8)
    assert repeats.equal_bytes(buf, np.array([0, 0]), np.array([5, 5]), np.array([4, 5])).tolist() == [True, False]
