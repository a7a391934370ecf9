"""Operators 11 to 13 against brute force, SQL and the cases that tables can hold."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.compare import difference
from tests.llm.test_operators import DOCS, ODD
from tripwright.llm import alignment, queries, substrings, veccodes

PLAIN, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


def frame(spark, texts):
    """Documents of (doc_id, text), with the other columns of tables and of operators."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "s", "b", "f", "l") for i, t in texts], DOCS)


# 11


def without_repeats(rows, n):
    """(doc_id, words, words kept, intervals) by comparing whole windows; a missing doc_id is after all others."""
    rows = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in rows:
        for k in range(len(words) - n + 1):
            first[tuple(words[k : k + n])] = min(i, first.get(tuple(words[k : k + n]), i))
    out = []
    for i, words in rows:
        gone = {k + j for k in range(len(words) - n + 1) if first[tuple(words[k : k + n])] < i for j in range(n)}
        runs = [[k, k + 1] for k in sorted(gone) if k - 1 not in gone]
        for run in runs:
            while run[1] in gone:
                run[1] += 1
        out.append((None if i == float("inf") else i, len(words), [w for k, w in enumerate(words) if k not in gone], [tuple(r) for r in runs]))
    return out


def check_repeats(docs, rows, n):
    want = without_repeats(rows, n)
    got = sorted((tuple(r) for r in substrings.digests(docs, n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == sorted(((i, size, size - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, size, kept, _ in want), key=repr)
    texts = {t is None for _, t in rows} and sorted((r.doc_id, r.text, [tuple(x) for x in r["__tw_removed"]]) for r in substrings.remove_repeats(docs, n).where("text IS NOT NULL AND doc_id IS NOT NULL").collect())
    assert texts == sorted((i, " ".join(kept), runs) for (i, _, kept, runs), (_, t) in zip(want, rows) if t is not None and i is not None)


def test_repeats_in_random_texts(spark, monkeypatch):
    rng = random.Random(1)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(5)]
    rows = []
    for i in range(300):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, 250), rng.choice([" ", "\n", "\t \x0b", "\x0c\r"]).join(parts)))
    check_repeats(frame(spark, rows).repartition(7), rows, 4)
    monkeypatch.setattr(substrings, "FLUSH", 50)  # many messages for each window
    monkeypatch.setattr(substrings, "BUCKET", 40)
    check_repeats(frame(spark, rows).repartition(3), rows, 13)


def test_repeats_over_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD] + [(8, "é" * 3 + " x y \x1c z"), (9, "word " * 12), (10, "word " * 14), (-5, "word " * 13)]
    check_repeats(frame(spark, rows), rows, 13)
    assert substrings.digests(frame(spark, []), 13).count() == 0
    kept = substrings.remove_repeats(frame(spark, rows))
    assert kept.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "__tw_removed"]
    assert {r.text for r in kept.where("doc_id = 1").collect()} == {None}


def test_a_hot_window_is_told_to_all_but_its_first_document(spark):
    passage = " ".join(f"w{k}" for k in range(50))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(2000)]
    got = {r.doc_id: r.n_removed for r in substrings.digests(frame(spark, rows).repartition(16)).collect()}
    assert got == {i: 50 * (i > 0) for i in range(2000)}


def test_intervals_merge():
    assert substrings.intervals(np.array([1, 1, 0, 1, 0, 0, 1], bool)) == [(0, 2), (3, 4), (6, 7)]
    assert substrings.intervals(np.zeros(0, bool)) == []


# 12


def spelled(rows):
    """(doc_id, a ids, b ids, a bytes, b bytes) by the two libraries, empty where they do not spell the text."""
    first, second = Tokenizer.from_file(PLAIN), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False) if text else None
        b = second.encode(text) if text else []
        left = [bytes(byte_of[c] for c in t) for t in a.tokens] if text else []
        names = [second.id_to_piece(x) for x in b]
        right = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode() for n in names]
        if not text or not (b"".join(left) == b"".join(right) == (" " + text).encode()):
            yield i, [], [], [], []
        else:
            yield i, a.ids, b, left, right


def ranges(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist() if tokens else []
    return list(zip([0, *ends], ends))


def aligned_by_hand(rows):
    found, counts = [], Counter()
    for i, a, b, left, right in spelled(rows):
        at, bt = ranges(left), ranges(right)
        cuts = [e for e in [x[1] for x in at] if e in {x[1] for x in bt}]
        inside = lambda spans, ids, lo, hi: ",".join(str(t) for t, (s, e) in zip(ids, spans) if lo <= s and e <= hi)
        line = ";".join(f"{inside(at, a, lo, hi)}|{inside(bt, b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        links = [(x, y) for x, (s, e) in zip(a, at) for y, (u, v) in zip(b, bt) if s < v and u < e]
        counts.update(set(links))
        found.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(line.encode()).hexdigest() if a else ""))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted(((i, a, b, g, len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), h) for i, a, b, g, ls, h in found), key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["Hello, world!", " two  spaces ", "<|endoftext|> and </s> <0x41>", "naïve café 日本語\U0001f642\n\n\tx", "a▁b", "▁", "\x00\x01", " ", "\n", "the " * 300, "x" * 3000, "Ｆｕｌｌ ﬁ ligature", None, "", "é"]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_alignment_equals_overlaps_of_byte_ranges(spark, most):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(None, "Hello, world!"), (3, "Hello, world!"), (3, "Hello, world!"), (2**60, "Hello there")]
    rows += [(100 + k, "".join(rng.choice(["the ", "cat", "é", "日本", " ", "1", "<s>", "\n", "qzx"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    got = alignment.digests(frame(spark, rows).repartition(5), PLAIN, PIECES, broadcast=most)
    assert sorted((tuple(r) for r in got.select(*ALIGNED).collect()), key=repr) == aligned_by_hand(rows)
    assert alignment.digests(frame(spark, []), PLAIN, PIECES).count() == 0


def test_alignment_over_a_table_and_its_groups(spark):
    found = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 900").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in found]
    docs, want = frame(spark, rows), aligned_by_hand(rows)
    assert sorted((tuple(r) for r in alignment.digests(docs, PLAIN, PIECES).select(*ALIGNED).collect()), key=repr) == want
    digests = {r[0]: r[-1] for r in want}
    for r in alignment.groups(docs, PLAIN, PIECES).collect():
        x = r["__tw_aligned"]
        line = ";".join(f"{','.join(map(str, x.a[a:c]))}|{','.join(map(str, x.b[b:d]))}" for a, b, c, d in zip([0, *x.a_stops], [0, *x.b_stops], x.a_stops, x.b_stops))
        assert (hashlib.sha256(line.encode()).hexdigest() if x.a else "") == digests[r.doc_id]


@given(st.lists(st.integers(1, 5)), st.lists(st.integers(1, 5)))
def test_bits_rank_and_links(a, b):
    total = max(sum(a), sum(b))
    a, b = a + [1] * (total - sum(a)), b + [1] * (total - sum(b))
    found = alignment.Aligned(np.array(a, int), np.array(b, int))
    spans = lambda s: list(zip([0, *np.cumsum(s).tolist()], np.cumsum(s).tolist()))
    assert found.cuts.tolist() == sorted({e for _, e in spans(a)} & {e for _, e in spans(b)})
    assert sorted(zip(*map(np.ndarray.tolist, found.links()))) == [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (u, v) in enumerate(spans(b)) if s < v and u < e]


# 13


def coded_by_hand(rows, parts, entries, rounds, scale):
    """Plain loops over Python's integers."""
    kept = [(i, label, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, label in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(kept[0][2]) // parts
    cut = lambda q, p: q[p * wide : (p + 1) * wide]
    books = [[cut(q, p) for _, _, q in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, _, q in kept:
                members.setdefault(near(cut(q, p), book)[1], []).append(cut(q, p))
            for e, own in members.items():
                book[e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[near(cut(q, p), books[p]) for p in range(parts)] for _, _, q in kept]
    errors = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, label, _), e in zip(kept, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), e, total[label], digest) for (i, label, _), f, e in zip(kept, found, errors)), key=repr)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    hot = [0.25, -0.5, 0.125, 1.0, -1.0, 0.0, 3.0, -2.5]
    rows = [(int(i), [float(x) for x in np.round(rng.standard_normal(8), 1)], [None, "a", "b"][int(rng.integers(3))]) for i in rng.permutation(120)]
    rows += [(200 + k, hot, "hot") for k in range(80)] + [(5, hot, "a"), (5, hot, "a"), (None, hot, None), (7, None, "a"), (8, [], "a"), (9, [float("nan")] * 8, "a"), (10, [None] * 8, "b"), (11, [float("inf")] * 8, "a")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").selectExpr("*", "1 AS position", "'x' AS key", "2L AS weight").repartition(6)
    for entries, rounds in ((16, 4), (256, 2), (1, 1)):
        got = veccodes.digests(vectors, 4, entries, rounds)
        assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == coded_by_hand(rows, 4, entries, rounds, 1024)
    assert veccodes.digests(vectors.limit(0)).count() == 0
    assert veccodes.digests(vectors.where("vec_id IN (200, 201) AND embedding IS NULL")).count() == 0


def test_nearest_is_exact_for_large_integers():
    rows = np.array([[2**25 - 1, -(2**25)], [3, 4]], np.int64)
    book = np.array([[2**25 - 2, -(2**25)], [0, 0], [6, 8], [0, 0]], np.int64)
    codes, errors = veccodes.nearest(rows, book)
    assert codes.tolist() == [0, 1] and errors.tolist() == [1, 25]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), SMALL, queries.ORACLE_SQL[name]) == ""


# The exchange of co-training, and the languages that a code is made for


def test_both_views_hand_texts_over(spark):
    from tripwright.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert sum(a for a, _ in model.exchanged) > 0 and sum(b for _, b in model.exchanged) > 0
    assert all(a <= 400 and b <= 400 for a, b in model.exchanged)


def test_languages_beyond_the_commonest_are_not_learned(spark):
    from tripwright.llm import langid

    rows = [(k, f"{'abc' if k % 2 else 'xyz'} {k % 5} words here", "one" if k % 2 else "two", "s", 0, "s", "b", "f", "l") for k in range(400)]
    rows += [(1000 + k, f"noise {k}", f"lang{k}", "s", 0, "s", "b", "f", "l") for k in range(50)]
    model = langid.train(spark.createDataFrame(rows, DOCS), most_languages=2)
    assert model.languages == ["one", "two"]


def test_levels_end_on_any_number_of_partitions(spark, monkeypatch):
    """More partitions than chunks must not keep a level from shrinking."""
    from tripwright.llm import sharding

    monkeypatch.setattr(sharding, "CHUNK", 256)
    monkeypatch.setattr(sharding, "LAST", 512)
    kind = type(spark.range(1))
    many = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols: many(self, max(64, n), *cols) if cols else many(self, n))
    rows = [(k, "x" * (1 + k * k % 997)) for k in range(3000)]
    got = sharding.shard(frame(spark, rows), 8).collect()
    totals = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert sorted(r.doc_id for r in got) == list(range(3000)) and max(totals) - min(totals) <= 8
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))
