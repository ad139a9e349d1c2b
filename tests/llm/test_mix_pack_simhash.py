import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, simhash
from tessera.llm.common import load

from .conftest import words


def water(size, weights=(1, 2, 3)):
    """Targets by refilling until no source is above three times its size."""
    order = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    left, open_, want = float(sum(size.values())), set(size), {}
    while open_:
        share = left / sum(weight[x] for x in open_)
        over = {x for x in open_ if share * weight[x] > 3 * size[x]}
        if not over:
            break
        for x in over:
            want[x] = 3.0 * size[x]
            left -= want[x]
        open_ -= over
    return want | {x: share * weight[x] for x in open_}


def test_targets_fill_water(spark):
    size = {"a": 10, "b": 1000, "c": 20, "d": 0, None: 500, "é": 7, "Z": 3}
    sizes = spark.createDataFrame([(k, v, 1) for k, v in size.items()], "source string, size long, n long")
    assert {r["source"]: r["target"] for r in mixing.targets(sizes).collect()} == pytest.approx(water(size))
    many = {f"host{k}": (k * 37) % 91 for k in range(300)}
    sizes = spark.createDataFrame([(k, v, 1) for k, v in many.items()], "source string, size long, n long").repartition(7)
    assert {r["source"]: r["target"] for r in mixing.targets(sizes).collect()} == pytest.approx(water(many))


def brute_rates(sizes, target):
    """Tilted rates of one source by bisection of the multiplier."""
    mean = sum(sizes) / sum(x > 0 for x in sizes)
    rates = lambda lam: [min(3.0, math.exp(min(lam * x / mean, 50))) if x else 1.0 for x in sizes]
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r * x for r, x in zip(rates(mid), sizes, strict=True)) < target else (lo, mid)
    return rates(lo)


def test_mix_meets_targets_and_agrees(spark):
    sf = "/root/testdata/sf0.01"
    got = mixing.op1(spark, sf).collect()
    docs = {r["doc_id"]: r for r in load(spark, sf, "documents").collect()}
    taken, target, longest, rates = Counter(), {}, Counter(), defaultdict(list)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == len(words(docs[r["doc_id"]]["text"]))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and abs(r["copies"] - r["rate"]) < 1
        taken[s] += r["taken"]
        target[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
        rates[s].append((r["size"], r["rate"]))
    assert len(got) == len(docs)
    size = Counter()
    for d in docs.values():
        size[d["source"]] += len(words(d["text"]))
    assert target == pytest.approx(water(dict(size)))
    for s, own in rates.items():
        assert [r for _, r in own] == pytest.approx(brute_rates([x for x, _ in own], target[s]), rel=1e-6)
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op1(spark, sf).collect()))


def test_repeated_rows_meet_their_targets(spark, tmp_path, monkeypatch):
    """Rows that agree in all columns, that share an id or have none; chunks far smaller than the groups."""
    from tessera.llm import common

    monkeypatch.setattr(common, "CHUNK", 7)
    rows = [(1, "w w w w", "s")] * 40 + [(2, "one", "t")] * 5 + [(None, "a b c d", "u")] * 30 + [(None, "x y z", "u")] * 9 + [(3, "e f", "u")] * 2 + [(4, None, "v")] * 12
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    want = water(dict(size))
    got = mixing.op1(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.op1(spark, str(tmp_path)).collect()))
    source = {1: "s", 2: "t", None: "u", 3: "u", 4: "v"}
    taken, mixed = Counter(), Counter()
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
    out = mixing.mix(df.withColumn("_k1", F.lit("x")).withColumn("_place", F.array(F.lit(1))))
    assert out.columns == ["doc_id", "text", "source", "_k1", "_place"]
    for r in out.collect():
        mixed[r["source"]] += len(words(r["text"]))
    assert sum(r["source"] == "v" for r in out.collect()) == 12
    for s in want:
        assert abs(taken[s] - want[s]) <= 4 and abs(mixed[s] - want[s]) <= 4, (s, taken, mixed, want)


def test_mix_edges(rows, empty):
    out = mixing.mix(rows)
    assert out.columns == rows.columns and {r["doc_id"] for r in out.collect()} >= {4, 5, 6}
    assert mixing.mix(empty).count() == 0


def brute_prints(texts):
    out = []
    for t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def brute_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 64)
    for i, d in enumerate(ids):
        least[top(i)] = min(least[top(i)], d)
    return [least[top(i)] for i in range(len(ids))]


def test_simhash_against_brute_force(spark, rows):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").union(rows.select(F.col("doc_id") + 100_000, "text"))
    have = docs.collect()
    prints = brute_prints([r["text"] for r in have])
    want = sorted(zip([r["doc_id"] for r in have], prints, brute_components([r["doc_id"] for r in have], prints), strict=True))
    got = sorted((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_simhash_hot_shards_are_dealt_anew(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6).tolist()
    prints = sorted({c ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for c in centres for _ in range(60)} | set(rng.integers(0, 1 << 63, 200).tolist()))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    want = brute_components(prints, prints)
    for limit, mean in ((4096, 64), (20, 64), (16, 1), (4096, 1)):
        labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, limit=limit, mean=mean)).collect()}
        assert [labels.get(p, p) for p in prints] == want


def test_block_masks_lose_no_link():
    rng = np.random.default_rng(8)
    for blocks in (5, 6, 8, 13):
        masks = simhash.block_masks(blocks)
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            assert any(x & m == 0 for m in masks)
    assert [simhash.blocks_for(n) for n in (0, 1000, 200_000, 15_000_000, 10**9, 10**11)] == [5, 5, 5, 6, 7, 8]


def test_components_raise_where_rounds_run_out(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in simhash.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(chain, rounds=1)


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 12, 300).tolist()
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in rng.integers(0, 1 << 12, 40).tolist():
        assert sorted(tree.near(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_simhash_edges(rows, empty):
    kept = simhash.deduplicated(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()).count(2) == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_each_group_whatever_the_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i * i % 97}" for i in range(80))
    # groups 1 and 5 have ids, 2 and 3 none, 4 shares the id of a copy of 1
    data = [(3, text(1)), (7, text(1)), (7, text(4)), (None, text(2)), (None, text(2)), (None, text(3)), (9, text(5)), (None, text(5)), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, _text string")
    kept = [(r["doc_id"], r["text"] or "") for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(3, text(1)), (7, text(4)), (None, text(2)), (None, text(3)), (9, text(5)), (None, "")], key=repr)


def test_packing_round_trip(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = spark.createDataFrame([(900, " a  b \n c "), (901, "<|endoftext|> it's 3rd\t\tx"), (902, "\n"), (903, "a \nb"), (904, "q " * 5000), (905, "x  y  z ½ ²3")], "doc_id long, text string")
    docs = load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(rows.select(F.col("doc_id") + 100_000, "text").distinct()).union(odd)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        want = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[r["doc_id"]])
        assert [i for p in own for i in p[1]] == want and all(p[2] == len(want) for p in own)
        assert [p[0] for p in own] == [sum(len(q[1]) for q in own[:k]) for k in range(len(own))]
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_op8_finds_added_tokens_as_the_tokenizers_file_does(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.ADDED == {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    e = "<|endoftext|>"
    texts = [e, f"one two{e}three four", f"a {e} b", f"a  {e}  b\n{e}", f"x <|endoftext |> y{e}{e} z's", f"q {e}", f" {e}s it's", "plain words here"]
    encoder = packing.Encoder(added=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(texts) + encoder.batch(texts)] == 2 * [t.encode(x, add_special_tokens=False).ids for x in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(texts)}
    for out in (packing.op8(spark, str(tmp_path)), corpus_pipeline.sequence_packing(spark, load(spark, str(tmp_path), "documents"), str(tmp_path))):
        got = out.collect()
        assert {r["doc_id"] for r in got} == set(want)
        for r in got:
            assert r["doc_tokens"] == len(want[r["doc_id"]])
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@pytest.mark.parametrize("longest, share", [(300, 0.1), (900, 0.3), (1500, 0.6)])
def test_packing_balances_cost(longest, share):
    """Costs of full sequences spread far less than where pieces come in the order of their documents; nothing is padded."""
    lengths = np.random.default_rng(1).integers(1, longest, 3000).tolist()
    pieces, n = packing.assign(lengths)
    assert sum(p[2] for p in pieces) == sum(lengths)
    loads, costs, plain, at = Counter(), Counter(), Counter(), 0
    for _, _, size, seq, _ in pieces:
        loads[seq] += size
        costs[seq] += packing.cost(size)
    assert n == len(loads) and sum(x != 2048 for x in loads.values()) <= 11 and all(x & (x - 1) == 0 for x in loads.values())
    for size in lengths:
        while size:
            part = min(size, 2048 - at % 2048)
            plain[at // 2048] += packing.cost(part)
            at, size = at + part, size - part
    assert np.std([costs[s] for s in costs if loads[s] == 2048]) < share * np.std(list(plain.values())[:-1])


def test_packing_ids_of_all_documents():
    """The rank file and the tokenizers file give the same ids on every document of the 0.1 tables and on odd characters."""
    tokenizers = pytest.importorskip("tokenizers")
    import random

    import public_tokenizers
    import pyarrow.parquet as pq

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(added=True)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "a", "Bc", "é", "ß", "日本", "1", "23", "½", "'s", "'", "'ll", "!", "...", "<|endoftext|>", "_", "\u0301", "😀", "\u200b", "\ufeff", "-", "word", "\x00"]
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)]
    for lo in range(0, len(texts), 256):
        some = texts[lo : lo + 256]
        assert encoder.batch(some) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]


def test_packing_empty(empty):
    assert packing.packed(empty).count() == 0


def test_packing_other_columns_and_repeated_rows(spark):
    """Columns named as the query's own, null ids and texts, rows that repeat, and one text longer than a sequence by far."""
    data = [(1, "a b c"), (1, "a b c"), (None, "d e"), (2, None), (3, ""), (4, "word " * 30_000)]
    named = spark.createDataFrame([(*r, 1, "x", 2) for r in data], "doc_id long, text string, start int, ids string, length int").coalesce(1)
    plain = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    told = lambda df: sorted(map(repr, packing.packed(df).collect()))
    assert told(named) == told(plain)
    size = lambda t: len(packing.Encoder().batch([t or ""])[0]) // 4 + 1
    got = Counter()
    for r in packing.packed(named).collect():
        got[r["doc_id"]] += r["length"]
    assert got == Counter({1: 2 * size("a b c"), None: size("d e"), 2: 1, 3: 1, 4: size(data[-1][1])})


def test_simhash_other_columns_and_nulls(spark):
    data = [(5, "a b c d e f"), (3, "A b C d e F"), (None, "a b c d e f"), (7, None), (8, ""), (9, " \n")]
    named = spark.createDataFrame([(*r, "x", "y") for r in data], "doc_id long, text string, fingerprint string, component_id string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(named).collect()]
    assert sorted(got, key=repr) == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 7)], key=repr)
