"""Byte-level BPE through a sentencepiece model made from the rank vocabulary.

Each byte sequence of the vocabulary becomes a piece: its bytes mapped to printable
characters, scored by the negative rank. Merging the best-scored neighbours is then
merging the lowest-ranked pair. The model is serialised here (protocol buffer wire
format), with identity normalisation; nothing is trained. Texts are cut by the
vocabulary's pattern, and each match is encoded by itself; a match that is a
vocabulary entry is that entry, as in the rank library. Decoding maps ids back to bytes.

Defined cases: a null text counts as empty and has no ids; a very long text is encoded whole,
match by match, and a match has no bound either; of equal scores the leftmost pair merges first,
as in the rank library; lone surrogates cannot occur in Arrow strings; repeated rows are separate
rows, null ids stay null; other columns, whatever their names, are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_arrow, table

#: Matches remembered by a worker, and the longest one worth remembering, in characters.
CACHE_MATCHES, CACHE_LENGTH = 300_000, 48


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol buffer field: varint for int, 32-bit for float, length-delimited for the rest."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto whose ids are the ranks; the unknown piece follows them.

    Field numbers of sentencepiece_model.proto, fixed values: ModelProto pieces 1, trainer_spec 2,
    normalizer_spec 3; SentencePiece piece 1, score 2, type 3 (normal 1, unknown 2, unused 5);
    TrainerSpec model_type 3 (BPE 2), vocab_size 4, treat_whitespace_as_suffix 24, unk_id 40, bos_id 41,
    eos_id 42, pad_id 43; NormalizerSpec name 1, add_dummy_prefix 3, remove_extra_whitespaces 4,
    escape_whitespaces 5. An id of -1 is 2**64 - 1 as a varint.
    """
    letters = byte_letters()
    size = max(ranks.values(), default=-1) + 1
    by_id = {rank: "".join(letters[b] for b in token) for token, rank in ranks.items()}
    out = []
    for i in range(size):
        if i in by_id:
            out.append(_field(1, _field(1, by_id[i]) + _field(2, -float(i)) + _field(3, 1)))
        else:  # a gap in the ranks
            out.append(_field(1, _field(1, f"<gap {i}>") + _field(2, -float(i)) + _field(3, 5)))
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = 2**64 - 1
    out.append(_field(2, _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.matches = regex.compile(pattern).findall
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def encode_match(self, match: str) -> bytes:
        """The ids of one match as little-endian unsigned 32-bit integers."""
        raw = match.encode()
        if (whole := self.ranks.get(raw)) is not None:
            return struct.pack("<I", whole)
        ids = self.model.encode(raw.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        cache, out = self.cache, []
        for match in self.matches(text):
            ids = cache.get(match)
            if ids is None:
                ids = self.encode_match(match)
                if len(match) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_MATCHES:
                        cache.clear()
                    cache[match] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with keep_ids also ids (binary, as hashed)."""
    with open(ranks_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in shipped.value.splitlines() if line.strip())}
        bpe = ByteBpe(ranks, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema, 1)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
