import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import byte_bpe, token_files

WORD_BPE = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 5000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-n * bits // 8)
    assert (token_files.unpack(raw, n, bits) == ids).all()


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_segment_random_access():
    ids = np.random.default_rng(0).integers(0, 50_000, 10_000).astype(np.uint32)
    seg = token_files.Segment(token_files.write_segment([5, None, 9], [4000, 0, 6000], ids, 17))
    assert seg.doc_ids == [5, None, 9]
    assert (seg.document(0) == ids[:4000]).all() and not len(seg.document(1)) and (seg.document(2) == ids[4000:]).all()
    for a, b in ((0, 1), (4095, 4097), (3, 9999), (10, 10)):
        assert (seg.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_files.Segment(b"nope" + bytes(40))


@pytest.fixture(scope="module")
def encoder():
    return token_files.WordEncoder(open(WORD_BPE, encoding="utf-8").read())


def encode(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, count = encoder(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB éÉßñ.,'’s-1\n\t́ΣK日 <|>")), min_size=1, max_size=5))
def test_word_encoder_equals_the_library(encoder, texts):
    assert encode(encoder, texts) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def far_apart():
    """Long words that differ in bytes at places 256 apart, unspaced text, base64, and a very long text."""
    rng = np.random.default_rng(4)
    texts = []
    for n in (255, 256, 257, 300, 1000, 5000):
        word = bytearray(rng.choice(list(b"abcdefgh"), n).tolist())
        other = bytearray(word)
        other[0] += 3
        other[min(256, n - 1)] -= 1
        texts += [word.decode(), other.decode(), f"{word.decode()}, {other.decode()}!"]
    texts += ["b" * 300, "e" + "b" * 255 + "a" + "b" * 43, "日本語テキスト" * 60 + "。" + "漢字" * 200]
    texts.append(base64.b64encode(rng.bytes(30_000)).decode())
    texts.append(" ".join(f"w{x}" for x in rng.integers(0, 40_000, 300_000)))
    return texts


def test_long_words(encoder):
    texts = far_apart()
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(encoder, texts) == want and encode(encoder, texts[::-1]) == want[::-1]


def test_hashes_may_collide(monkeypatch):
    """With hashes of four bits most words share one; the ids stay those of the library."""
    plain = token_files.find_words

    def poor(*a, **k):
        w = plain(*a, **k)
        return w._replace(hashes=w.hashes & np.uint64(15))

    monkeypatch.setattr(token_files, "find_words", poor)
    own = token_files.WordEncoder(open(WORD_BPE, encoding="utf-8").read())
    texts = ["one two three, four. five! Six six seven (eight) nine-ten", "eleven two été Über twelve... x1", "one " * 50] * 3
    assert encode(own, texts) == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(encoder):
    table = token_files.IdTable(10)
    for lo in range(0, 100, 5):
        table.next_round()
        names = np.arange(lo, lo + 5, dtype=np.uint64)
        new = table.missing(names)
        table.add(names[new], np.repeat(names[new], 2).astype(np.uint32), np.full(int(new.sum()), 2), np.full(int(new.sum()), 4), names[new])
        assert table.runs(table.at(names)).tolist() == np.repeat(names, 2).tolist()
        assert table.same(table.at(names), np.full(5, 4), names).all() and not table.same(table.at(names), np.full(5, 4), names + np.uint64(1)).any()
    assert len(table.names) <= 15


def read(spark, docs, tmp_path):
    token_files.write_tokens(docs, WORD_BPE, str(tmp_path / "t"))
    return token_files.read_tokens(spark, str(tmp_path / "t")).collect()


def test_files(spark, odd, tmp_path, encoder):
    got = read(spark, odd, tmp_path)
    ids = {}
    for r in odd.collect():
        whole = np.array([*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(r.doc_id, []).append((len(whole), zlib.crc32(whole.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((d, *x) for d, v in ids.items() for x in v), key=repr)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in ordered)
    found = token_files.read_document(spark, str(tmp_path / "t"), 9)
    assert sorted(x.tolist() for x in found) == sorted([*encoder.tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in odd.collect() if r.doc_id == 9)


def test_empty_table(spark, odd, tmp_path):
    assert read(spark, odd.limit(0), tmp_path) == []


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_own():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_byte_bpe_equals_the_library(bpe, tiktoken_own, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe.encode(text)
    assert list(memoryview(ids).cast("I")) == tiktoken_own.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_gaps_in_the_ranks():
    small = byte_bpe.ByteBpe({**{bytes([b]): b for b in range(256)}, b"ab": 300, b"abc": 301}, P.PATTERN)
    assert list(memoryview(small.encode("abcab")).cast("I")) == [301, 300]


def test_encode_documents(odd, tiktoken_own):
    got = byte_bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = []
    for r in odd.collect():
        ids = tiktoken_own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_documents(odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
