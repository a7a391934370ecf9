"""The learned operators against slow references, and the whole pipeline against its stages."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import ODD
from tests.llm.test_late_operators import frame
from tripwright.llm import langid, quality

SMALL = "/root/testdata/sf0.001"


# Languages: features counted one by one, losses summed one by one


def slow_language(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    data = list(f" {text.lower()} ".encode())
    counts = defaultdict(int)
    for a, b, c in zip(data, data[1:], data[2:]):
        mixed = (a * 2654435761 + b * 40503 + c * 97) % 2**32
        counts[(mixed * 2246822519) % 2**32 >> 21] += 1
    norm = math.sqrt(sum(counts.values()))
    losses = []
    for word in model.code:
        loss = 0.0
        for bit, side in enumerate(word):
            margin = model.weights[-1, bit] + sum(math.sqrt(n) / norm * model.weights[k, bit] for k, n in counts.items())
            loss += math.log1p(math.exp(-max(-30.0, min(30.0, margin * side))))
        losses.append(loss)
    shares = [math.exp(min(losses) - x) for x in losses]
    shares = sorted((s / sum(shares) for s in shares), reverse=True)
    return model.languages[losses.index(min(losses))], shares[0], shares[0] - (shares[1] if len(shares) > 1 else 0) < model.ambiguous


def test_languages_equal_a_slow_decoder(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    odd = [(i, t) for i, t, *_ in ODD if t is None or len(t) < 10_000]
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").limit(60).collect()] + odd
    got = langid.predict(frame(spark, rows), model).select("text", "__tw_language.*").collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score, unclear = slow_language(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
        if abs(score - 0.5) > 0.1:
            assert r.is_ambiguous == unclear


# Quality: co-training over lists


def slow_quality(docs, labels, rounds=4, step=200, labelled=3000):
    """The rounds over Python's dictionaries; fits and calibration are the operator's own."""
    said = defaultdict(set)
    for i, q in labels:
        if i is not None and q is not None:
            said[i].add(q)
    y = {i: (1 if min(v) > 0 else -1) for i, v in said.items() if len(v) == 1 and i in docs}
    total = {side: sum(v == side for v in y.values()) for side in (1, -1)}
    prior = total[1] / (total[1] + total[-1])
    assert total[1] + total[-1] <= labelled  # all are learned from
    view = {i: (quality.text_view(t or "").astype("f4").astype(float), quality.meta_view(a, b, c).astype(float)) for i, (t, a, b, c, _) in docs.items()}
    own = sorted(y)
    sides = np.array([y[i] for i in own])
    held = quality._held(sides)
    fit = np.setdiff1d(np.arange(len(own)), held)
    rows = [[view[own[k]][v] for k in fit] for v in (0, 1)]
    wanted = [[sides[k] for k in fit] for _ in (0, 1)]
    weights = [quality._fit(np.array(r), np.array(w)) for r, w in zip(rows, wanted)]
    share = np.array([total[s] / (sides[held] == s).sum() for s in sides[held]])
    of_key = {}
    for i, (*_, key) in docs.items():
        if i not in said or len(said[i]) != 1:
            of_key[key] = i
    given, exchanged = [set(), set()], []
    for _ in range(rounds):
        known = [quality._calibrated(np.array([quality._logit(view[own[k]][v][None, :], weights[v])[0] for k in held]), weights[v], sides[held], share) for v in (0, 1)]
        chance = {key: [float(quality._sigmoid(quality._logit(view[i][v][None, :], known[v]))[0]) for v in (0, 1)] for key, i in of_key.items()}
        new = ({}, {})
        for v in (0, 1):
            for side in (1, -1):
                floor = max(0.5, prior if side > 0 else 1 - prior)
                ranked = sorted((-(p[v] if side > 0 else 1 - p[v]), key) for key, p in chance.items() if key not in given[1 - v])
                new[1 - v].update({key: side for q, key in ranked[:step] if -q > floor})
        exchanged.append((len(new[0]), len(new[1])))
        if not (new[0] or new[1]):
            break
        for v in (0, 1):
            for key in sorted(new[v]):
                rows[v].append(view[of_key[key]][v])
                wanted[v].append(new[v][key])
            given[v] |= set(new[v])
            weights[v] = quality._fit(np.array(rows[v]), np.array(wanted[v]))
    return weights, exchanged


def test_quality_equals_slow_rounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    keyed = docs.withColumn("key", F.xxhash64("text", "lang", "source", "n_chars")).collect()
    table = {r.doc_id: (r.text, r.lang, r.source, r.n_chars, r.key) for r in keyed}
    weights, exchanged = slow_quality(table, [(r.doc_id, r.quality) for r in labels.collect()])
    model = quality.train(docs, labels)
    assert exchanged == list(model.exchanged)
    for got, want in zip(model.views, weights):
        assert got == pytest.approx(want, abs=1e-3)


# The whole pipeline


def test_run_equals_its_stages_one_after_the_other(spark):
    """What a document is at the end: its stages without files between them, its ids by the tokenizer's own library."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    want = {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(list)
    used = defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id].append((r.piece, r.start, list(r.ids)))
        used[r.sequence_id].append((r.offset, r.length))
    assert got.keys() == want.keys() and 0 < len(want) < 200
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, pieces in got.items():
        ids = [x for _, _, own in sorted(pieces) for x in own]
        assert ids == [*tokenizer.encode(want[doc] or "", add_special_tokens=False).ids, 2]
        assert all(len(own) == 1024 for _, _, own in sorted(pieces)[1:])
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
