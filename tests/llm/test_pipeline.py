"""The pipeline, stage by stage, each held against brute force over its own input, and as a whole."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import packing, secrets
from tessera.llm.common import load, stored

from .conftest import words
from .test_mix_pack_simhash import brute_components, brute_prints, water
from .test_scan_rank_judge import base_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    out = {"": load(spark, SF, "documents")}
    docs = out[""]
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF))
    return out


def texts(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scans", "source_mixing", "sequence_packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages[""].columns


def test_classifier_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages["quality_classifier"].collect()}
    told = load(spark, SF, "labels").collect()
    clean = [r["doc_id"] for r in told if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert set(map(repr, stages["quality_classifier"].collect())) <= set(map(repr, stages[""].collect()))


def test_one_of_each_group_stays(stages):
    before = texts(stages["quality_classifier"])
    ids = [d for d, _, _ in before]
    want = set(brute_components(ids, brute_prints([t for _, t, _ in before])))
    assert sorted(d for d, _, _ in texts(stages["simhash_near_dedup"])) == sorted(want)


def test_secrets_are_replaced(stages):
    before, after = {d: t for d, t, _ in texts(stages["simhash_near_dedup"])}, {d: t for d, t, _ in texts(stages["secret_scans"])}
    assert before.keys() == after.keys()
    changed = 0
    for d, t in before.items():
        for a, _, b in base_spans(t):
            assert t[a:b] not in after[d]
        if t == after[d]:
            continue
        changed += 1
        # what stands between the marks is the text in its order
        at = 0
        for piece in after[d].split("[SECRET]"):
            assert (at := t.index(piece, at)) >= 0
            at += len(piece)
    assert changed >= sum(bool(base_spans(t)) for t in before.values()) > 0


def test_mix_meets_the_targets_of_what_is_left(stages):
    before, after = texts(stages["secret_scans"]), texts(stages["source_mixing"])
    size, taken, longest = Counter(), Counter(), Counter()
    for _, t, s in before:
        size[s] += len(words(t))
        longest[s] = max(longest[s], len(words(t)))
    for _, t, s in after:
        taken[s] += len(words(t))
    for s, target in water(dict(size)).items():
        assert abs(taken[s] - target) <= longest[s] + 1
    assert max(Counter(after).values()) <= 3 and set(after) <= set(before)


def test_packing_holds_every_token(stages):
    encoder = packing.Encoder(added=True)
    want = Counter()
    for d, t, _ in texts(stages["source_mixing"]):
        want[d] += len(encoder.batch([t or ""])[0]) // 4 + 1
    got, seqs = Counter(), defaultdict(list)
    for r in stages["sequence_packing"].collect():
        got[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for own in seqs.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_run_chains_the_stages(spark, stages):
    """The draw, the dithers and the marks are hashes, so that a second run over the same documents takes the same."""
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages["sequence_packing"].columns
    count = lambda df: Counter((r["doc_id"], r["start"] == 0, r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert count(out) == count(stages["sequence_packing"])
    assert re.fullmatch(r"\[[A-Z]+\]", "[SECRET]") and secrets.KINDS[3] == "random"
