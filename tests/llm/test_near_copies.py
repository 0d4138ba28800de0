"""Near copies against every pair's Jaccard similarity."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from strandwise.llm import near_copies, simhash


def brute(docs, least=0.8):
    sets = []
    for _, t in docs:
        words = (t or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 10 * len(a & b) >= 10 * least * len(a | b) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {d[0]: min(docs[j][0] for j in range(len(docs)) if group[j] == group[i]) for i, d in enumerate(docs)}


def test_near_copies_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs, at = [(900, None), (901, ""), (902, "one two"), (903, "One  two")], 0
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(20, 120))]
        for _ in range(6):
            changed = list(words)
            for place in rng.integers(0, len(words), rng.integers(0, 4)):
                changed[place] = f"x{rng.integers(0, 99)}"
            docs.append((at, " ".join(changed)))
            at += 1
    docs += [(500 + i, "the same five words here " + " ".join(f"v{x}" for x in rng.integers(0, 999, 12))) for i in range(12)]
    want = brute(docs)
    for bucket in (2048, 4):
        monkeypatch.setattr(near_copies, "BUCKET", bucket)
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == want
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_links_by_fingerprints_and_by_similarity(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = lambda k: " ".join(f"t{x}" for x in rng.integers(0, 9999, k))
    docs = [(i, "alpha beta gamma " * 90 + words(12)) for i in range(6)]  # repeats rule the fingerprints, not the sets
    base = [words(60) for _ in range(8)]
    docs += [(100 + 10 * i + j, t if not j else t.rsplit(" ", 4 * j)[0]) for i, t in enumerate(base) for j in range(3)]
    prints = {i: int.from_bytes(simhash.fingerprint(t), "big") for i, t in docs}
    near = brute(docs)
    group = dict(near)
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert any(group[i] != near[i] for i in group)
    assert any(group[i] == group[j] and (prints[i] ^ prints[j]).bit_count() > 3 for i, j in ((100 + 10 * k, 101 + 10 * k) for k in range(8)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, rows, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))


def test_common_passages_bring_no_texts_together(spark):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{x}" for x in range(60))
    docs = [(i, passage + " " + " ".join(f"u{i}x{x}" for x in rng.integers(0, 9999, 80))) for i in range(30)]
    texts = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    common = near_copies.common_shingles(texts)
    assert set(common[0]) == set.intersection(*[set(near_copies.shingles(t)) for _, t in docs])
    heads = [near_copies.head(near_copies.shingles(t), *common) for _, t in docs]
    assert all(len(h) == near_copies.prefix(len(near_copies.shingles(t))) for h, (_, t) in zip(heads, docs))
    assert len(np.unique(np.concatenate(heads))) == sum(map(len, heads))
