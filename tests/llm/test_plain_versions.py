"""Operators against plain versions that share no code with them, and all of them on very long texts and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from lexiloom.llm import byte_bpe, license_scan, near_copies, order_minhash, registry, sharding, simhash, token_files, toxicity, words

M64 = (1 << 64) - 1


def mixed(x):
    """splitmix64's finaliser."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def word_hash(word):
    a, b = (int(s) for s in words._SALTS)
    lanes = [int.from_bytes(word[i : i + 8], "little") for i in range(0, len(word), 8)]
    return mixed((sum(mixed(lane ^ mixed((i * a + b) & M64)) for i, lane in enumerate(lanes)) + len(word)) & M64)


def plain_signature(text, k=5, sketches=64, size=2):
    """Order MinHash step by step: k-mers, their occurrence numbers, the least ones of each sketch in text order."""
    seeds = [[int(x) for x in row] for row in order_minhash._SEEDS]
    found = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    if not found:
        return []
    kmers = [mixed(sum(h * seeds[sketches + j][0] for j, h in enumerate(found[i : i + k])) & M64) for i in range(max(1, len(found) - k + 1))]
    seen = Counter()
    numbered = []
    for x in kmers:
        numbered.append(mixed((x + seen[x] * seeds[-1][0]) & M64))
        seen[x] += 1
    out = []
    for a, b in seeds[:sketches]:
        values = []
        for place, x in enumerate(numbered):
            v = ((x ^ a) * b) & M64
            v = ((v ^ v >> 32) * a) & M64
            values.append((v >> 28, place))
        code = 0
        for place in sorted(p for _, p in sorted(values)[:size]):
            code = mixed((code * seeds[-2][0] + numbered[place]) & M64)
        out.append(code >> 32)
    return out


def test_order_minhash(documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(60).collect() if len(r.text) < 6000]
    texts += ["", " \n", "one", "a b c d e", "a b c d e f", "x " * 40, "same same " * 30, "é日 " * 9, "b" * 300 + " " + "b" * 300, "e" + "b" * 255 + "a" + "b" * 43]
    for t, s in zip(texts, order_minhash.signatures(texts), strict=True):
        assert s.tolist() == plain_signature(t), t[:80]


def test_different_long_words_differ():
    one, two = "b" * 300, "e" + "b" * 255 + "a" + "b" * 43
    a, b = order_minhash.signatures([f"x {one} y z", f"x {two} y z"])
    assert not (a == b).any()


def test_many_rows_of_one_id(spark):
    """A third of all rows without id, copies of one row, and an id of many texts: every row is there and has the right successor."""
    rows = [(None, f"null {i % 50}") for i in range(200)] + [(7, "copy copy copy copy copy copy")] * 150 + [(9, f"nine {i}") for i in range(100)] + [(i, f"text {i}") for i in range(100, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    got = order_minhash.fingerprint_with_next(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    whole = {t: order_minhash.signatures([t])[0].astype(">u4").tobytes().hex() for _, t in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((k, whole[t]) for k, t in rows)
    text = {i: f"text {i}" for i in range(100, 250)}
    for r in got:
        if r.doc_id is not None and 100 <= r.doc_id < 249:
            t, f = text[r.doc_id], text[r.doc_id + 1]
            n = len(t) // 4
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + f[:n]).encode()).hexdigest()
    last = [r for r in got if r.doc_id == 249]
    t = text[249]
    assert last[0].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 4] + "null 1"[: len(t) // 4]).encode()).hexdigest()
    ranges = order_minhash.ranges(docs.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("w")), 16)
    assert set(ranges.inner) and ranges.first[-1] > 8


def plain_places(text, docs_with, n):
    """Every template at every place of the text: those accepted, as (label, start, base, cover)."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    weigh = lambda x: math.log((n + 1) / (docs_with.get(x, 0) + 0.5))
    every = [(label, t.split(), t.split(), True) for label, t in license_scan.BASE] + [(label, t.split(), key.split(), False) for label, t, key in license_scan.TEMPLATES]
    rare = {x for _, t, *_ in every for x in t if docs_with.get(x, 0) <= license_scan.COMMON * n} | {max(t, key=lambda x: (weigh(x), x)) for _, t, *_ in every}
    out = []
    for label, t, key, base in every:
        at = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
        for start in range(-len(t), len(w)):
            here = [w[start + i] if 0 <= start + i < len(w) else "" for i in range(len(t))]
            if here[at : at + len(key)] != key or not any(a == b and b in rare for a, b in zip(here, t, strict=True)):
                continue
            cover = min(1.0, sum(weigh(b) for a, b in zip(here, t, strict=True) if a == b) / sum(map(weigh, t)))
            if base or cover >= license_scan.COVER:
                out.append((label, start, base, cover))
    return len(w), out


LICENCES = [
    "This worK is licensed under the GNU General Public License, version 3.",  # the Kelvin sign is no k
    "This work is licensed under the GNU General Public License, version 3. MIT License too; all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "permission hereby granted free of charge", "Licensed under CC BY-SA 4.0 and CC BY 4.0", "cc by 4", "RELEASED under cc0 1.0 universal",
    "general public license " * 4, "redistribution and use in source and binary forms, with changes, are permitted", "terms of the GNU Affero General Public License, GNU Lesser General Public License",
]


def test_licences(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + i, t) for i, t in enumerate(LICENCES)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = {w for _, t, *_ in [*license_scan.BASE, *license_scan.TEMPLATES] for w in t.split()}
    docs_with = Counter()
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        docs_with.update(vocabulary & set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)))
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    some = 0
    for k, t in rows:
        n, places = plain_places(t, docs_with, len(rows))
        g = got[k]
        starts = [s for _, s, base, _ in places if base]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None))
        assert g.base_labels == ",".join(sorted({label for label, _, base, _ in places if base})) and g.labels == ",".join(sorted({label for label, *_ in places})), t
        assert g.score == pytest.approx(max((c for *_, c in places), default=0.0)) and len(g.places) == len(places)
        some += bool(places)
    assert some >= len(LICENCES)


def test_risk_gradient():
    rng = np.random.default_rng(2)

    def texts(n):
        return toxicity.sparse([np.sort(rng.choice(9, rng.integers(0, 6), replace=False)) for _ in range(n)])

    for seed in range(6):
        p, u, prior = texts(20), texts(50), 0.05 + 0.08 * seed
        w = np.random.default_rng(seed).normal(size=10) * (1 + 2 * (seed % 2))
        toxic, clean = toxicity.risks(w, p, u, prior)
        x = lambda texts: [(w[:-1][texts[1][texts[0] == i]]).sum() + w[-1] for i in range(texts[2])]
        loss = lambda z, y: math.log1p(math.exp(-z if y else z))
        assert toxic == pytest.approx(prior * np.mean([loss(z, 1) for z in x(p)]))
        assert clean == pytest.approx(np.mean([loss(z, 0) for z in x(u)]) - prior * np.mean([loss(z, 0) for z in x(p)]))
        got = toxicity.descent(w, p, u, prior)
        aim = (lambda v: -toxicity.risks(v, p, u, prior)[1]) if clean < 0 else (lambda v: sum(toxicity.risks(v, p, u, prior)))
        for i in range(10):
            step = np.eye(10)[i] * 1e-6
            assert got[i] == pytest.approx((aim(w + step) - aim(w - step)) / 2e-6, abs=1e-7)


def test_reversal_where_the_clean_risk_is_negative():
    p, u = toxicity.sparse([np.array([0])] * 5), toxicity.sparse([np.array([0])] * 1 + [np.array([1])] * 9)
    w = np.array([9.0, -9.0, 0.0])
    assert toxicity.risks(w, p, u, 0.4)[1] < 0
    assert toxicity.descent(w, p, u, 0.4)[0] > 0  # a step against it lowers what the texts were learnt by heart with


def test_features_counted_in_spark_are_those_of_the_sample(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"word{i}" for i in range(60)], 20)) + (" scumbag filth" if i % 4 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]

    def distinct(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return np.unique(toxicity.text_features(raw, np.array([0, len(raw)]))[1])

    prior = (sum(i % 4 == 0 for i in train) + 1) / (len(train) + 2)
    want = toxicity.train([distinct(texts[i]) for i in train if i % 4 == 0], [distinct(texts[i]) for i in train], prior)
    assert model.prior == pytest.approx(prior) and (model.features == want.features).all() and len(want.features)
    assert np.allclose(model.weights, want.weights, atol=1e-6)


def test_rare_toxicity_keeps_its_prior(spark):
    docs = spark.createDataFrame([(i, "plain words here") for i in range(2000)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") == 1).cast("int").alias("toxic")))
    assert model.prior < 0.002


def test_nothing_to_learn_from(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (odd.limit(0), odd):
        model = toxicity.fit(docs, labels)
        assert not len(model.features) and model.prior == toxicity.MOST_PRIOR
        assert toxicity.keep_clean(docs, labels).count() == docs.count()


def test_token_ids_of_the_whole_table(spark, documents, tmp_path):
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    token_files.write_tokens(documents, P.path("word_bpe_49k.json"), str(tmp_path / "t"))
    got = {r.doc_id: r for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for r in documents.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.fixture(scope="module")
def long(spark):
    """Very long texts: many words, one word, one line."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30_000, 250_000)), "x" * 1_500_000, "日本語" * 200_000, "a b\n" * 200_000, "short text"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_very_long_texts(spark, long, tmp_path):
    docs, texts = long
    shards = {r.doc_id: r for r in sharding.assign(docs).collect()}
    assert all(shards[i].size == len(t.encode()) + 8 and shards[i].text_crc32 == zlib.crc32(t.encode()) for i, t in enumerate(texts))
    found = {r.doc_id: r for r in order_minhash.fingerprint_with_next(docs).collect()}
    assert [found[i].n_chars for i in range(5)] == [len(t) for t in texts]
    assert found[0].edited_sha256 == hashlib.sha256((texts[0][: len(texts[0]) - len(texts[0]) // 4] + texts[1][: len(texts[0]) // 4]).encode()).hexdigest()
    assert found[1].fingerprint == order_minhash.signatures([texts[1]])[0].astype(">u4").tobytes().hex()
    marks = {r.doc_id: r.fp for r in simhash.classes(docs).collect()}
    assert all(marks[i] % 2**64 == simhash.fingerprint(t) for i, t in enumerate(texts)) and len(set(marks.values())) == 5
    assert len({r.fp for r in near_copies.classes(docs).collect()}) == 5
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    few = docs.where("doc_id in (0, 2, 3)")
    ids = {r.doc_id: r for r in byte_bpe.encode_documents(few, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i in (0, 3):
        assert ids[i].ids_sha256 == hashlib.sha256(np.array(own.encode_ordinary(texts[i]), "<u4").tobytes()).hexdigest()
    assert all(ids[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in (0, 2, 3))
    assert license_scan.scan(docs.where("doc_id <> 0")).count() == 4
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.5)
    assert toxicity.score(docs, model).count() == 5


def test_matches_forgotten_within_a_text(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_MATCHES", 5)
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    text = " ".join(f"word{i % 37}" for i in range(500))
    assert bpe.decode(bpe.encode(text)) == text.encode() and len(bpe.cache) <= 5


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert near_copies.keep_one(none).collect() == [] and simhash.keep_one(none).collect() == []
    assert near_copies.keep_one(none).columns == odd.columns
    assert set(registry.QUERIES) == {"op1_token_files", "op2_mixing", "op3_sharding", "op4_order_minhash", "op5_multiprobe", "op6_simhash", "op7_toxicity", "op8_byte_bpe", "op9_license_scan", "op10_html_text"}
