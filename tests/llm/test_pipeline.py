"""The pipeline: columns, decisions, odd rows and empty tables."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from tests.llm.test_operators import DOCS, ODD
from tripwright.llm import nearcopies, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == COLUMNS
        counts.append(docs.count())
    assert before > counts[0] >= counts[1] > counts[2] == counts[3]
    assert docs.where("text RLIKE '[a-z]@mail[0-9]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[3]


def test_stages_take_odd_and_empty_rows(spark):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(*r, "s", "b", "f", "l") for r in ODD], DOCS)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == odd.columns
            stage(spark, docs, sf).count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_at_a_similarity_of_five_words(spark, monkeypatch):
    rng = random.Random(8)
    rows, doc = [], 0
    for edits in (0, 1, 2, 3, 4, 5) * 4 + (30,) * 4:
        line = [f"w{rng.randint(0, 10**6)}" for _ in range(250)]
        for _ in range(2):
            rows.append((doc, " ".join(line)))
            doc += 1
            for k in range(edits):
                line[k * (240 // max(edits, 1)) + 7] = f"z{rng.randint(0, 10**6)}"
    base = [f"q{rng.randint(0, 10**6)}" for _ in range(200)]
    for _ in range(90):  # one group that parts of 16 cut
        line = list(base)
        line[rng.randrange(200)] = f"y{rng.randint(0, 10**6)}"
        rows.append((doc, " ".join(line)))
        doc += 1
    sets, up = [five(t) for _, t in rows], list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((up[a], up[b]))
                up = [low if x == high else x for x in up]
    want = sorted(set(up))
    assert len(want) < len(rows) - 90
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for part in (2048, 16):
        monkeypatch.setattr(nearcopies, "PART", part)
        assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "").collect()) == want


def test_near_copies_meet_by_fingerprints(spark):
    """Links come from fingerprints where no band is shared, and only from pairs within the radius where one is."""
    line = [f"w{i}" for i in range(400)]
    a, b, c = " ".join(line), " ".join([*line[:399], "z"]), " ".join(f"q{i}" for i in range(400))
    fp = lambda text: simhash.majority(nearcopies.shingles(text))
    assert 0 < (fp(a) ^ fp(b)).bit_count() <= simhash.RADIUS
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    schema = "digest long, text string, fp long, bands array<long>"
    found = lambda *rows: {tuple(sorted(r)) for r in nearcopies.links(spark.createDataFrame(rows, schema), 5, 0.8).collect()}
    apart = [(1, a, signed(fp(a)), [11]), (2, b, signed(fp(b)), [12]), (3, c, signed(fp(c)), [13])]
    assert found(*apart) == {(1, 2)}
    equal = [(4, a, 5, [14]), (5, b, 5, [15]), (6, c, 5, [16])]
    assert found(*equal) == {(4, 5)}  # the shingles decide, not the fingerprint
    met = [(7, a, 0, [17]), (8, b, (1 << 28) - 1, [17]), (9, a + " end", signed((1 << 64) - 1), [17])]
    assert found(*met) == {(7, 8)}


def test_fingerprints_decide_which_sets_are_opened():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(40)]
    far = np.array([0, (1 << 64) - 1], np.uint64)
    work = Counter()
    assert nearcopies.forest(sets[:2], far, 0.8, work) == [] and work["opened"] == 0
    copies = sets + [np.append(s[:-1], s[-1] + np.uint64(1)) for s in sets]
    prints = np.array([simhash.majority(s) for s in copies], np.uint64)
    assert sorted(nearcopies.forest(copies, prints, 0.8, work)) == [(i, 40 + i) for i in range(40)] and work["opened"] > 0


def test_fingerprints_at_a_similarity_of_08_lie_within_the_radius():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        same, extra = (n := int(rng.integers(1, 60))) * 4, n  # 4 n of 5 n shingles
        hashes = rng.integers(0, 1 << 64, same + extra, dtype=np.uint64)
        cut = same + int(rng.integers(0, extra + 1))
        a, b = simhash.majority(hashes[:cut]), simhash.majority(np.concatenate([hashes[:same], hashes[cut:]]))
        assert (a ^ b).bit_count() <= nearcopies.RADIUS
    words = "Ein Satz von fünf Worten und noch einer dazu".split()
    counts = Counter(bit for i in range(len(words) - 4) for h in [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).lower().encode(), 42)] for bit in range(64) if h >> bit & 1)
    assert simhash.majority(nearcopies.shingles(" ".join(words))) == sum(1 << b for b, n in counts.items() if 2 * n > len(words) - 4)


def test_wide_bit_slices_equal_counting():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    for n, radius in ((1, 28), (64, 28), (200, 28), (200, 31), (200, 12), (200, 64)):
        want = np.bitwise_count(values[:n, None] ^ values[None, :n]) <= radius
        got = np.unpackbits(simhash.reach(values[:n], radius).view(np.uint8), axis=1, count=n, bitorder="little").astype(bool)
        assert (got == want).all()
        assert len(simhash.near(values[:n], values[:n], radius, same=True)) == np.triu(want, 1).sum()
