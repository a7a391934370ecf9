"""Each operator against brute force on small tables, with the cases that tables can hold."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tripwright.llm import bpe, langid, nearcopies, packing, pii, preference, quality, sharding, simhash, topk, vecdedup
from tripwright.llm.graph import components

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, base string, fingerprint string, label string"
#: Nulls, empty and very long texts, repeated rows and doc_ids, and columns whose names operators use.
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9), (4, "A B c d E", "fr", "s", 9),
    (None, "a b c d e", None, None, -1), (None, "only here, with no id", "en", "s", 3), (9007199254740993, "word " * 30000 + "end", "en", "s", 5), (6, "x" * 60000, "de", "t", 7), (7, "mail a@b.co and +1 (222) 333-4444 end", "en", "s", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", "b", "f", "l") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


# 1


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(MULTI))


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("truth", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tab'st12²é"))))
def test_bpe_equals_the_library(encoder, truth, text):
    assert encoder.encode(text) == truth.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=8), st.data())
def test_bpe_appends_and_edits_re_encode_exactly(encoder, data, new, choose):
    a = choose.draw(st.integers(0, len(data)))
    b = choose.draw(st.integers(a, len(data)))
    piece = bpe.Prefixes(encoder.vocabulary, data)
    piece.splice(a, b, new)
    piece.append(new)
    whole = data[:a] + new + data[b:] + new
    assert piece.ids() == bpe.Prefixes(encoder.vocabulary, whole).ids() == (encoder.vocabulary.merge(whole) if whole else [])


def test_bpe_edit_stops_where_the_table_repeats(encoder):
    piece = bpe.Prefixes(encoder.vocabulary, b"abcdefgh" * 400)
    assert piece.splice(10, 11, b"z") < 400
    assert piece.ids() == encoder.vocabulary.merge(piece.data)


def test_bpe_over_odd_rows(odd, empty, truth):
    got = [tuple(r) for r in bpe.round_trip(odd, MULTI).collect()]
    want = []
    for doc, text, *_ in ODD:
        ids = truth.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(empty, MULTI).count() == 0
    ids = bpe.decode(bpe.encode(odd, MULTI), MULTI)
    assert sorted(bytes(r.decoded) for r in ids.collect()) == sorted((t or "").encode() for _, t, *_ in ODD)


# 2

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_spans(spark, docs, odd, empty):
    rng = random.Random(5)
    made = [(10_000 + i, "".join(rng.choice("ab@.1230-+ () 4é🙂5,_%") for _ in range(rng.randint(0, 90)))) for i in range(1500)]
    made += [(1, "4111 1111 1111 1111 +1.222.333.4444 1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1"), (2, "1" * 3000), (3, "a@b" + ".c" * 3000), (4, "7 " * 5000), (5, "x@y.z " * 400)]
    texts = {i: t for i, t in made} | {r.doc_id: r.text for r in docs.collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in pii.find(frame).collect():
        want = base_spans(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x.startswith(k) for x in want) for k, _ in KINDS]
        assert set(want) <= set(row.spans.split(",")) or not want
    assert pii.find(odd).count() == len(ODD)
    assert pii.find(empty).count() == 0


def test_pii_patterns_of_high_confidence_discover(spark):
    seeds = [(i, f"please write to: u{i}@site{i}.com today") for i in range(9)] + [(i + 20, f"nothing {i} of note 77{i}{i}{i}9 here") for i in range(5)]
    frame = spark.createDataFrame([*seeds, (50, "please write to: john_at_site5 today"), (51, "see ticket: 889911 today")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(frame).collect()}
    assert rows[50].spans == "email:17:30" and rows[50].n_email == 0 and rows[50].n_found == 1
    assert rows[51].spans == "" and all(rows[i + 20].spans == "" for i in range(5))


def test_pii_discovers_in_hops_and_in_all_forms(spark):
    """Found values are the seeds of other patterns; groups of digits and long tokens are candidates."""
    seeds = [f"note {i}; call us: +49 30 555 {1000 + i} soon" for i in range(12)]
    first = [f"call us: 0301 55 7{10 + i} soon" for i in range(6)]  # no base form, behind a pattern of base seeds
    second = [f"Fax number: 0301 55 7{10 + i}" for i in range(6)] + ["Fax number: (0399) 123 4567"]  # known values induce a second pattern
    mails = [f"write to {'name' * 3}{i}@host{i}.org or wait" for i in range(8)] + ["write to " + "x1" * 60 + " or wait"]
    clean = [f"chapter {i} has {i * 37} pages and the code A{i}77{i}99B of item 12.50.{i}" for i in range(40)]
    texts = seeds + first + second + mails + clean
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in sorted(pii.find(frame).collect())]
    got = [texts[r.doc_id][int(x.split(":")[1]) : int(x.split(":")[2])] for r in rows for x in r.spans.split(",") if x and r.n_found]
    want = [f"0301 55 7{10 + i}" for i in range(6)] * 2 + ["(0399) 123 4567", "x1" * 60]
    assert sorted(got) == sorted(want)  # recall and precision of the planted ones
    assert pii.redact(frame).where("doc_id = 24").first().text == "Fax number: [PHONE]"
    one_hop = pii.bootstrap(pii.occurrences(pii.scan(frame), "doc_id"), rounds=1)
    assert "1 number: " not in [r.pattern for r in one_hop.collect()]


def test_pii_long_texts_of_many_numbers(spark):
    text = " ".join(f"{i} a{i}b77 +1 222 333 {1000 + i % 9000}, x" for i in range(20000))
    began = time.time()
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_phone == 20000 and time.time() - began < 60
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text.count("[PHONE]") == 20000


def test_pii_redacts_and_keeps_columns(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert texts[7].text == "mail [EMAIL] and [PHONE] end" and texts[1].text is None and texts[2].text == "" and texts[7].base == "b"


# 3


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = find(i), find(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
    named = {}
    for i, doc in enumerate(ids):
        named.setdefault(find(i), []).append(doc)
    return [min((d for d in named[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash_bit_slices_equal_counting():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    values = np.array([base[i % 5] ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, i % 7, False)), np.uint64(0)) for i in range(300)], np.uint64)
    for radius in range(4):
        want = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        for n in (1, 63, 64, 300):
            assert sorted(map(tuple, simhash.near(values[:n], values, radius).tolist())) == list(zip(*(x.tolist() for x in np.nonzero(want[:n]))))
            assert sorted(map(tuple, simhash.near(values[:n], values[:n], radius, same=True).tolist())) == list(zip(*(x.tolist() for x in np.nonzero(np.triu(want[:n, :n], 1)))))
        assert simhash.near_pairs(values, values[::-1].copy(), radius).tolist() == np.flatnonzero(want[np.arange(300), np.arange(300)[::-1]]).tolist()
    edges = simhash._spanning(300, simhash.near(values, values, same=True))
    assert len(edges) == 300 - len(set(roots(values, list(range(300)))))


def test_simhash_abandons_blocks_past_the_radius():
    """Of a bucket of unlike fingerprints nearly all blocks go before their last bit; those of near copies stay."""
    rng, mask = np.random.default_rng(2), np.uint64(simhash._key_mask(0))
    values = rng.integers(0, 1 << 63, 2048, dtype=np.uint64) & ~mask
    work = Counter()
    assert len(simhash.near(values, values, skip=int(mask), same=True, work=work)) == 0
    assert work["blocks"] == 2048 * 32 and work["abandoned"] > 0.99 * work["blocks"]
    work = Counter()
    assert len(simhash.near_pairs(values, values[::-1].copy(), work=work)) == 0 and work["abandoned"] == work["blocks"] == 32
    close, work = values[:1] ^ (np.uint64(1) << rng.integers(30, 64, 128).astype(np.uint64)), Counter()
    assert len(simhash.near(close, close, skip=int(mask), same=True, work=work)) == 128 * 127 // 2
    assert work["blocks"] - work["abandoned"] == 64 * 2 + 64 - 2  # all but those that lie wholly at or before the row itself


@pytest.mark.parametrize("part", [2048, 16])
def test_simhash_groups(spark, odd, empty, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(2)
    line = [f"w{rng.randint(0, 999)}" for _ in range(900)]
    rows = [(r[0], r[1]) for r in ODD]
    for i in range(120):
        words = list(line)
        for _ in range(i % 4):
            words[rng.randrange(900)] = "z"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(20))) for i in range(60)]
    got = [tuple(r) for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    prints = [brute_print(t) for _, t in rows]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, roots(np.array(prints, np.uint64), [d for d, _ in rows]))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.groups(empty).count() == 0


def test_simhash_keeps_one_of_each_group(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([1, 3, 6, 7, 9007199254740993, None], key=repr)  # 2 is as empty as 1; 4 and the first null id are copies of 3
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_one, nearcopies.keep_one])
def test_one_row_stays_where_a_doc_id_has_several_texts(spark, keep):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a, "x"), (5, b, "x"), (9, b, "x"), (7, c, "y"), (7, c, "x"), (3, c, "z"), (None, d, "x"), (None, d + " end", "x"), (None, a, "x")]
    want = {(5, a, "x"), (5, b, "x"), (3, c, "z")}
    for order in (rows, rows[::-1]):
        got = [tuple(r) for r in keep(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)).collect()]
        named = [r for r in got if r[0] is not None]
        assert set(named) == want and len(named) == 3
        if keep is nearcopies.keep_one:  # one of the two near copies without ids
            assert len(got) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)] + [(500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 500: 500, 501: 500}


# 4 and 5


def test_quality_on_labels(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    got = quality.classify(docs, train).toPandas().merge(test, on="doc_id")
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.97
    assert quality.classify(odd, labels).count() == len(ODD)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("NOT kept").count() == 0


def test_quality_with_few_labels_of_a_class(spark):
    """0.5% low-quality labels: the sample of each class tells them apart, where the base rate would keep all."""
    rng = random.Random(6)
    good = [f"The {rng.choice('abcdef')}{rng.randint(0, 99)} house stood by a quiet river, and people came to see it." for _ in range(3980)]
    bad = [f"$$$ WIN {rng.randint(0, 10**6)} WIN WIN {rng.randint(0, 10**6)} CLICK!!!" for _ in range(20)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame([(i, int(i < 3980)) for i in range(4000) if i % 2], "doc_id long, quality int")
    got = quality.classify(frame, given).toPandas().set_index("doc_id")
    low = [i for i in range(3980, 4000) if i % 2 == 0]
    assert got["score"].nunique() > 1 and got.loc[low, "score"].max() < got.loc[:3979, "score"].min() and not got.loc[low, "kept"].any() and got.loc[:3979, "kept"].all()


def test_quality_hands_over_from_all_unlabelled(spark, monkeypatch):
    """A later round hands over other documents than an earlier one, out of more than any sample."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(6000)
    labels, sizes, fit = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id % 20 = 0"), [], quality._fit
    seen, chances = [], quality._chances
    monkeypatch.setattr(quality, "_fit", lambda x, y: sizes.append(len(x)) or fit(x, y))
    monkeypatch.setattr(quality, "_chances", lambda f, w: seen.append(f.count()) or chances(f, w))
    quality.train(docs, labels, rounds=3, step=50)
    assert seen == [6000] * 3
    grown = sizes[::2], sizes[1::2]
    assert len(sizes) == 8 and any(all(b >= a + 50 for a, b in zip(side, side[1:])) for side in grown)


def test_language_on_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert set(got.loc[got["held_out"], "doc_id"]) == {i for i in got["doc_id"] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"und"}
    assert langid.identify(empty).count() == 0
    blind = docs.withColumn("lang", docs["lang"].substr(1, 0)).where("lang IS NULL")
    assert langid.identify(blind).count() == 0


def test_language_codes_are_apart():
    for n in (1, 2, 4, 5, 9):
        table = langid.code(n)
        assert len({tuple(x) for x in table.tolist()}) == n


# 6 and 8


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q string, s string")


BAD = [(9900, None, 1, "", ""), (9901, [None, 1.0, 2.0, 3.0], 1, "", ""), (9902, [float("nan"), 1.0, 2.0, 3.0], 1, "", ""), (9903, [float("inf"), 1.0, 2.0, 3.0], 1, "", ""), (9904, [], 1, "", ""), (None, [1.0, 0.0, 0.0, 0.0], 1, "", "")]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    table = rng.choice([-0.5, -0.25, 0.0, 0.25, 0.7], (400, 4)).astype("f4")
    rows = [(i, list(map(float, v)), 1, "", "") for i, v in enumerate(table)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(vectors(spark, rows + rows[:3] + BAD), "vec_id % 50 = 0").collect())
    ints, want = np.floor(256 * table.astype(float)).astype(int), []
    for q in range(0, 400, 50):
        scores = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert topk.search(vectors(spark, BAD), "vec_id % 50 = 0").count() == 0
    assert [r.vec_id for r in topk.search(vectors(spark, rows[:2]), "vec_id % 50 = 0").collect()] == [1]


def test_topk_histograms_count_every_score(spark, monkeypatch):
    """With blocks far smaller than the table the result stays, and the first histograms hold all pairs of the queries."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(9)
    table = np.concatenate([rng.standard_normal((500, 8)), np.tile(rng.standard_normal(8), (200, 1))]).astype("f4")  # the last 200 tie for everyone
    frame, rounds, counted = vectors(spark, [(i, list(map(float, v)), 1, "", "") for i, v in enumerate(table)]), [], topk.histograms
    monkeypatch.setattr(topk, "histograms", lambda *a: rounds.append(counted(*a)) or rounds[-1])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, "vec_id % 50 = 0").collect())
    ints, want = np.floor(256 * table.astype(float)).astype(int), []
    for q in range(0, 700, 50):
        best = sorted((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    first = rounds[0].toPandas()
    assert len(rounds) >= 2 and first.groupby("query_id")["n"].sum().tolist() == [699] * 14 and first["bin"].nunique() > 20


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(40):
        center = rng.standard_normal(32)
        rows += [(center + rng.standard_normal(32) * 0.15 * rng.random(), c % 3) for _ in range(1 + c % 6)]
    center = rng.standard_normal(32)
    rows += [(center + rng.standard_normal(32) * 0.1, 1) for _ in range(1300)] + [(center, 1)] * 200
    table, label = np.array([r[0] for r in rows], "f4").astype(float), np.array([r[1] for r in rows])
    unlabelled = [(5000, list(map(float, table[0])), None, "", ""), (5001, [0.0] * 32, 1, "", "")]
    frame = vectors(spark, [(i, list(map(float, v)), int(k), "", "") for i, (v, k) in enumerate(zip(table, label))] + unlabelled + BAD + [(3, None, 1, "", "")])
    got = vecdedup.links(frame).toPandas().set_index("vec_id").sort_index()
    size = np.linalg.norm(table, axis=1)
    near = ((table @ table.T) / size[:, None] / size >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert (got.loc[: len(table) - 1, "n_links"].to_numpy() == near.sum(axis=1)).all()
    rest = got.loc[5000:]
    assert (rest["n_links"] == 0).all() and (rest["component_id"] == rest.index).all()
    assert (got["kept"] == (got["component_id"] == got.index)).all()
    assert vecdedup.links(frame.limit(0)).count() == 0


def test_vector_links_recall_over_many_partitions(spark, monkeypatch):
    """Recall of planted links, and the same result for any partitioning and any place of the block edges."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(150):
        center = rng.standard_normal(48)
        rows += [(center + rng.standard_normal(48) * rng.uniform(0.05, 0.2), c % 3) for _ in range(1 + c % 4)]
    rows += [(rng.standard_normal(48), c % 3) for c in range(1400)]
    table, label = np.array([r[0] for r in rows], "f4").astype(float), np.array([r[1] for r in rows])
    size = np.linalg.norm(table, axis=1)
    near = ((table @ table.T) / size[:, None] / size >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    frame, results = vectors(spark, [(i, list(map(float, v)), int(k), "", "") for i, (v, k) in enumerate(zip(table, label))]), {}
    for passes, partitions, block in ((12, 1, 4096), (12, 200, 4096), (2, 1, 4096), (2, 200, 64)):
        monkeypatch.setattr(vecdedup, "BLOCK", block)
        got = vecdedup.links(frame.repartition(partitions), passes=passes).toPandas().set_index("vec_id").sort_index()
        results[passes, partitions] = got
        found, true = got["n_links"].sum() / 2, near.sum() / 2
        print(f"passes {passes}, partitions {partitions}: {found:.0f} of {true:.0f} links")
        assert true > 100 and 0.9 * true <= found <= true or passes == 2
        assert (got["n_links"].to_numpy() <= near.sum(axis=1)).all()
    assert results[12, 1].equals(results[12, 200]) and results[2, 1].equals(results[2, 200])


def test_vector_labels_of_any_kind(spark):
    rows = [(1, [1.0, 0.0], "1.5"), (2, [1.0, 0.0], "1.7"), (3, [1.0, 0.0], "x"), (4, [1.0, 0.01], "x"), (5, [1.0, 0.0], None)]
    text = {r.vec_id: r.n_links for r in vecdedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert text == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}
    numbers = spark.createDataFrame([(i, v, float(k)) for i, v, k in rows[:2]], "vec_id long, embedding array<float>, label double")
    assert [r.n_links for r in vecdedup.links(numbers).collect()] == [0, 0]


# 7


def test_sharding_law(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(9000 + i, "same text") for i in range(900)] + [(r[0], r[1]) for r in ODD if r[0] not in (9007199254740993, 6)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(sizes) == 8 and sizes.max() - sizes.min() <= 2
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got[got["doc_id"] >= 9000]["shard"].nunique() == 1
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=9), st.integers(2, 3))
def test_differencing_against_all_partitions(sizes, parts):
    """Brute force: the spread is never below the best one, and for equal sizes it is the best one."""
    array = np.array(sizes, np.int64)
    spread = lambda labels: int(np.ptp(np.bincount(labels, weights=array, minlength=parts)))
    got = sharding.even_out(array, sharding.difference(array, parts), parts)
    best = min((spread(np.array(x, np.int64)) for x in product(range(parts), repeat=len(sizes))), default=0)
    assert len(got) == len(sizes) and spread(got) >= best
    assert spread(got) <= spread(sharding.difference(array, parts)) <= max(sizes, default=0)
    if len(set(sizes)) < 2:
        assert spread(got) == best


def test_sharding_differences_in_tasks_at_every_size(spark):
    """Even a small table goes through a level of chunks, and little comes to the driver."""
    groups = spark.createDataFrame([(bytes([i // 256, i % 256]), 10 + i * 7 % 311) for i in range(900)], "item binary, size long")
    seen, kept = [], sharding.difference
    sharding.difference = lambda sizes, parts: seen.append(len(sizes)) or kept(sizes, parts)
    try:
        out = sharding.assign(groups, 8)
    finally:
        sharding.difference = kept
    assert len(seen) == 1 and seen[0] < 900 and out.count() == 900


def test_sharding_in_levels_is_as_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LAST", 500)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 4000) + str(i)) for i in range(6000)] + [(9000 + i, "h" * 3000) for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = sorted(got.groupby("shard")["size"].sum())
    assert len(got) == len(rows) and sizes[6] - sizes[0] < sizes[0] / 1000  # the group of copies is larger than a fair share


# 9


def talk(conv, *turns):
    return [(conv, i, r, t) for i, (r, t) in enumerate(turns)]


def test_preferences(spark):
    hello = ("user", "hello")
    rows = talk(64, hello, ("assistant", "hi"), ("user", "more")) + talk(128, hello, ("assistant", "hi"), ("user", "more"), ("assistant", "long answer"))
    rows += talk(3, ("user", "a"), ("assistant", "one"), ("user", "b"), ("assistant", "two")) + talk(4, ("user", "x"), ("assistant", "y")) + rows[:1]
    rows += talk(6, ("user", "x2"), ("assistant", "y2")) + talk(7, ("system", "s"), ("user", "u"), ("assistant", "alone"))
    rows += [(None, 0, "user", "lost"), (5, None, None, None)]
    frame = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, kind string, said int")
    got = {r.chosen_id: r for r in preference.format_preferences(frame).collect()}
    assert set(got) == {128, 3, 4, 5, 6, 7}
    pair = got[128]
    assert (pair.rejected_id, pair.kind, pair.prefix_turns) == (64, "shared", 3)
    assert pair.prompt == "<|user|>\nhello\n<|assistant|>\nhi\n<|user|>\nmore\n" and pair.rejected_completion == "" and pair.rejected_mask == ""
    a, b = map(int, pair.chosen_mask.split(":"))
    assert pair.chosen_completion[a:b] == "long answer"
    assert (got[3].kind, got[3].prefix_turns, got[3].rejected_completion) == ("swapped", 3, "<|assistant|>\none\n")
    for own, other, said in ((4, 6, "y2"), (6, 4, "y")):  # alike in the roles of their turns
        pair = got[own]
        a, b = map(int, pair.rejected_mask.split(":"))
        assert (pair.kind, pair.rejected_id, pair.prefix_turns, pair.rejected_completion[a:b]) == ("borrowed", other, 1, said)
    assert (got[7].kind, got[7].prefix_turns, got[7].chosen_completion, got[7].rejected_completion) == ("single", 2, "<|assistant|>\nalone\n", "")
    assert (got[5].kind, got[5].prompt, got[5].chosen_completion) == ("single", "<||>\n\n", "")
    assert preference.format_preferences(frame.limit(0)).count() == 0


def brute_format(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, "".join(f"<|{r}|>\n{t}\n" for r, t in chosen[:n])]
    for side in (chosen, rejected):
        text, mask = "", []
        for role, said in side[n:]:
            text += f"<|{role}|>\n"
            if role == "assistant":
                mask.append(f"{len(text)}:{len(text) + len(said)}")
            text += said + "\n"
        out += [text, ",".join(mask)]
    return [out[0], out[1], out[2], out[4], out[3], out[5]]


def test_preference_formatting_equals_brute_force(spark):
    rng, rows = random.Random(12), []
    for i in range(300):
        side = lambda: [(rng.choice(("user", "assistant", "system", "")), rng.choice(("", "a", "é🙂", "long " * 3))) for _ in range(rng.randint(0, 6))]
        base = side()
        rows.append((i, base + side(), base + side()))
    kind = "array<struct<role:string,text:string>>"
    frame = spark.createDataFrame(rows, f"i long, chosen {kind}, rejected {kind}")
    for r in preference.format_pairs(frame).collect():
        assert list(r)[1:] == brute_format(*rows[r.i][1:])
    long = spark.createDataFrame([(1, [("assistant", "w" * 1000)] * 3000, [("user", "x" * 10**6)])], f"i long, chosen {kind}, rejected {kind}")
    assert list(preference.format_pairs(long).first())[1:] == brute_format([("assistant", "w" * 1000)] * 3000, [("user", "x" * 10**6)])


def test_preference_pairs_within_a_hot_first_turn(spark):
    rows = [r for c in range(401) for r in talk(c, ("user", "same"), ("assistant", "w" * (c % 7)))]
    got = preference.format_preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    ids = got["chosen_id"].tolist() + got["rejected_id"].dropna().astype(int).tolist()
    assert sorted(ids) == list(range(401)) and (got["kind"] == "shared").sum() == 200
    assert all(c % 7 >= r % 7 for c, r in zip(got["chosen_id"], got["rejected_id"].fillna(0).astype(int)) if got["rejected_id"].notna().any() and r)


# 10


def test_packing(docs, odd, empty):
    truth = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame in (docs, odd):
        got = packing.pack_documents(frame, PLAIN).toPandas()
        want = []
        for row in frame.select("doc_id", "text").collect():
            ids = truth.encode(row.text or "", add_special_tokens=False).ids + [2]
            want += [(row.doc_id, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in packing.cut(len(ids), 1024)]
        have = [(None if pd.isna(d) else int(d), s, n, c) for d, s, n, c in zip(got["doc_id"].astype(object), got["start"], got["length"], got["ids_crc32"])]
        if frame is docs:
            assert sorted(have, key=repr) == sorted(want, key=repr)
        assert sorted(x[1:] for x in have) == sorted(x[1:] for x in want)
        for _, rows in got.sort_values("offset").groupby("sequence_id"):
            assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 1024
        assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 1024 + 1
    assert packing.pack_documents(empty, PLAIN).count() == 0


def test_packing_carries_ids(docs):
    truth = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r.doc_id: truth.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack_documents(docs, PLAIN, ids=True).collect()
    assert sum(r.length for r in rows) == sum(map(len, whole.values()))
    assert all(r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_packing_plan_uses_every_piece(counts):
    bins = packing.plan(counts, 40)
    used = {}
    for lengths, times in bins:
        assert sum(lengths) <= 40 and times > 0
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
