"""Token ids in fixed-width bit-packed files.

Each id takes the fewest bits that hold the vocabulary. A segment is a self-contained
blob: header, document index, block offsets, packed blocks. Blocks hold BLOCK ids and
start on a byte, so any run of ids is read by unpacking only the blocks it touches.
Segments are rows of a Parquet table, so Spark's committer makes the files appear
whole or not at all, and min/max statistics on the document bounds find a document.

Defined cases: a null text counts as empty; each document ends with the end id, so an
empty one has one id; a null doc_id sorts first and reads back as null; repeated
doc_ids stay separate documents, ordered by their text's hash; a very long text
is encoded whole and closes its segment; other columns, whatever their names, are not looked at;
an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.byte_bpe import byte_letters
from lexiloom.llm.common import column_bytes, map_arrow, parts, table, work_path
from lexiloom.llm.words import Words, find_words, lanes_of, places_in

MAGIC = b"LXTB"
BLOCK = 4096
#: A segment is closed after the document with which it reaches this many ids.
SEGMENT = 1 << 16
#: Words remembered by a worker (half as many pieces), and pieces known to be odd.
CACHE_WORDS, CACHE_PIECES = 600_000, 100_000
#: Longer words, in bytes, are encoded whenever they are met, so that what is remembered is bounded.
LONGEST = 256
#: Bytes at which texts are cut into words.
WORD_ENDS = np.zeros(256, bool)
WORD_ENDS[[9, 10, 13, 32]] = True
#: All bytes but those of letters (taking every byte above ASCII for one), and all but marks (printable ASCII; the apostrophe begins some pieces).
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
NO_MARK = np.array([not 33 <= b <= 126 or chr(b).isalnum() or chr(b) == "'" for b in range(256)])
HEADER = struct.Struct("<4sBBHIQ")  # magic, version, bits, block length, documents, ids


def width(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, lowest bit first, without gaps; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little")
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    return b"".join([
        HEADER.pack(MAGIC, 1, bits, BLOCK, len(doc_ids), len(ids)),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.cumsum([0, *lengths]).astype("<u8").tobytes(),
        np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(),
        *blocks,
    ])


class Segment:
    """Random access to one segment."""

    def __init__(self, raw: bytes):
        magic, _, self.bits, self.block, n_docs, self.n_ids = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size
        known = np.frombuffer(raw, np.uint8, n_docs, at)
        at += n_docs
        named = np.frombuffer(raw, "<i8", n_docs, at)
        self.doc_ids = [int(d) if k else None for d, k in zip(named, known, strict=True)]
        at += 8 * n_docs
        self.ends = np.frombuffer(raw, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64)
        self.data = memoryview(raw)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        found = [
            unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits)
            for k in range(a, b + 1)
        ]
        return np.concatenate(found)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k]), int(self.ends[k + 1]))


class IdTable:
    """Runs of ids by the bytes of a word, found by their hash, in sorted arrays; it forgets words not met lately."""

    def __init__(self, size: int):
        self.size, self.round = size, 0
        self.names, self.begin, self.count, self.last, self.length, self.lane = (np.zeros(0, t) for t in (np.uint64, *[np.int32] * 5))
        self.pool, self.lanes = np.zeros(0, np.uint32), np.zeros(0, np.uint64)

    def missing(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.ones(len(names), bool)
        return self.names[np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)] != names

    def add(self, names: np.ndarray, ids: np.ndarray, count: np.ndarray, lengths: np.ndarray, lanes: np.ndarray) -> None:
        """names ascend and are missing; ids holds their runs one after the other, lanes their bytes."""
        at = np.searchsorted(self.names, names)
        begin = np.cumsum(count) - count + len(self.pool)
        lane = np.cumsum(lanes_of(lengths)) - lanes_of(lengths) + len(self.lanes)
        self.pool, self.lanes = np.concatenate([self.pool, ids]), np.concatenate([self.lanes, lanes])
        self.names, self.begin, self.count = np.insert(self.names, at, names), np.insert(self.begin, at, begin), np.insert(self.count, at, count)
        self.length, self.lane = np.insert(self.length, at, lengths), np.insert(self.lane, at, lane)
        self.last = np.insert(self.last, at, self.round)

    def at(self, names: np.ndarray) -> np.ndarray:
        """Places of names, none of which is missing."""
        at = np.searchsorted(self.names, names)
        self.last[at] = self.round
        return at

    def same(self, at: np.ndarray, lengths: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """Whether the words at these places have these bytes, not only their hash."""
        same = self.length[at] == lengths
        count = lanes_of(lengths)
        equal = self.lanes[np.minimum(np.repeat(self.lane[at], count) + places_in(count), len(self.lanes) - 1)] == lanes if len(lanes) else np.zeros(0, bool)
        if not equal.all():
            same &= np.logical_and.reduceat(equal, np.cumsum(count) - count)
        return same

    def runs(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places, one run after the other."""
        count = self.count[at]
        return self.pool[np.repeat(self.begin[at], count) + places_in(count)]

    def next_round(self) -> None:
        self.round += 1
        if len(self.names) > self.size:
            order = np.argsort(-self.last, kind="stable")[: self.size // 2]
            keep = np.sort(order)
            pool, count, lanes = self.runs(keep), self.count[keep], lanes_of(self.length[keep])
            self.lanes = self.lanes[np.repeat(self.lane[keep], lanes) + places_in(lanes)]
            self.names, self.count, self.last, self.length = self.names[keep], count, self.last[keep], self.length[keep]
            self.begin, self.lane = ((np.cumsum(c) - c).astype(np.int32) for c in (count, lanes))
            self.pool = pool


class WordEncoder:
    """Encodes whole texts with a tokenizer that never joins across white space, remembering its words.

    Text is cut at blanks, tabs and line ends only; all of these end a word for the
    tokenizer's own splitter, so the ids are those of the whole text. A word of letters
    and then ASCII punctuation is two pieces of that splitter; a piece of letters goes
    straight to the library's merge model. Any other word goes through the whole
    tokenizer. Known words and pieces are found by 64-bit hashes and compared byte by byte;
    one that only shares a hash is encoded by itself.
    """

    of_process: dict[int, WordEncoder] = {}

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.merge = self.tokenizer.model.tokenize
        self.bytes_to_letters = str.maketrans(dict(enumerate(byte_letters())))
        self.words, self.pieces = IdTable(CACHE_WORDS), IdTable(CACHE_WORDS // 2)
        self.odd = np.zeros(0, np.uint64)  # pieces of letters and other characters
        #: whether pieces may go straight to the merges: splitter and normaliser of the known kind, tried on a sample
        self.direct = True
        sample = "Plain words, été... Ünder!? don't a;'s ß ŋ<| İx. ΑΣ. x1 (a) b-c"
        raw = np.frombuffer(sample.encode(), np.uint8)
        if self(raw, np.array([0, len(raw)]))[0].tolist() != self._whole(sample):
            self.direct, self.words = False, IdTable(CACHE_WORDS)

    @classmethod
    def shared(cls, tokenizer_json: str) -> WordEncoder:
        """The encoder of this worker process: its words outlast a task."""
        key = hash(tokenizer_json)
        if key not in cls.of_process:
            cls.of_process[key] = cls(tokenizer_json)
        return cls.of_process[key]

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn_pieces(self, raw: bytes, data: np.ndarray, ends: np.ndarray, separators: np.ndarray, letters: bool) -> tuple[Words, np.ndarray]:
        """The runs of other bytes than separators, all of them among the pieces, and whether each is there under its own bytes."""
        w = find_words(data, ends, separators, lower=letters)
        names, sample = np.unique(w.hashes, return_index=True)
        new = self.pieces.missing(names) & ~np.isin(names, self.odd)
        found: list[list[int]] = []
        odd = []
        some = sample[new]
        for i, (a, n) in enumerate(zip(w.starts[some].tolist(), w.lengths[some].tolist(), strict=True)):
            piece = raw[a : a + n].decode()
            if letters:
                piece = piece.lower() if piece.isascii() else self.normal(piece)
                if not piece.isalpha():
                    odd.append(i)
                    found.append([])
                    continue
                piece = piece.encode().decode("latin-1").translate(self.bytes_to_letters)
            found.append([t.id for t in self.merge(piece)])
        good = np.ones(len(found), bool)
        good[odd] = False
        added = names[new]
        self.odd = np.union1d(self.odd, added[~good])[-CACHE_PIECES:]
        count = np.array([len(f) for f in found], np.int64)
        some = some[good]
        self.pieces.add(added[good], np.array([x for f in found for x in f], np.uint32), count[good], w.lengths[some], _lanes(w, some))
        known = ~self.pieces.missing(w.hashes)
        known[known] = self.pieces.same(self.pieces.at(w.hashes[known]), w.lengths[known], _lanes(w, known.nonzero()[0]))
        return w, known

    def _learn(self, words: Words, some: np.ndarray, data: np.ndarray) -> None:
        """Encode some of the words and put them among the known ones; their hashes ascend and are missing."""
        starts, lengths = words.starts[some], words.lengths[some]
        ends = np.cumsum(lengths)
        data = data[np.repeat(starts, lengths) + places_in(lengths)]  # the words, one after the other
        raw, begins = data.tobytes(), ends - lengths
        simple = np.zeros(len(some), bool)
        heads = tails = np.zeros(0, np.int64)
        if self.direct:
            bounds = np.concatenate([begins, ends[-1:]])
            core, core_known = self._learn_pieces(raw, data, bounds, NO_LETTER, True)
            marks, marks_known = self._learn_pieces(raw, data, bounds, NO_MARK, False)
            at, size = core.starts, core.lengths
            if len(at):  # letters from the start, then marks to the end
                i = np.minimum(np.searchsorted(at, begins), len(at) - 1)
                rest = np.concatenate([[0], np.cumsum(NO_MARK[data])])
                after = begins + size[i]
                simple = (at[i] == begins) & (rest[ends] == rest[np.minimum(after, ends)]) & core_known[i]
                with_marks = simple & (after < ends)
                j = np.searchsorted(marks.starts, after[with_marks])
                simple[with_marks] = marks_known[j]
                with_marks &= simple
                j = j[marks_known[j]]
                heads = self.pieces.at(core.hashes[i][simple])
                tails = np.full(len(some), -1)
                tails[with_marks] = self.pieces.at(marks.hashes[j])
                tails = tails[simple]
        ids: list[np.ndarray] = []
        count = np.zeros(len(some), np.int64)
        order = np.stack([heads, tails], axis=1).ravel() if len(heads) else np.zeros(0, np.int64)
        order = order[order >= 0]
        joined = self.pieces.runs(order)
        count[simple] = self.pieces.count[heads] + np.where(tails >= 0, self.pieces.count[np.maximum(tails, 0)], 0) if len(heads) else 0
        whole = (~simple).nonzero()[0]
        for k in whole.tolist():
            ids.append(np.array(self._whole(raw[begins[k] : ends[k]].decode()), np.uint32))
            count[k] = len(ids[-1])
        out = np.empty(int(count.sum()), np.uint32)
        of_whole = np.repeat(~simple, count)
        out[~of_whole] = joined
        out[of_whole] = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.words.add(words.hashes[some], out, count, lengths, _lanes(words, some))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[bounds[i]:bounds[i + 1]] together, and each text's number of ids."""
        self.words.next_round()
        self.pieces.next_round()
        w = find_words(data, bounds, WORD_ENDS)
        own = w.lengths > LONGEST  # words encoded by themselves
        listed = (~own).nonzero()[0]
        names, sample, which = np.unique(w.hashes[listed], return_index=True, return_inverse=True)
        new = self.words.missing(names)
        if new.any():
            self._learn(w, listed[sample[new]], data)
        at = self.words.at(names)[which]
        same = self.words.same(at, w.lengths[listed], _lanes(w, listed) if own.any() else w.lanes)
        own[listed[~same]] = True
        count = np.zeros(len(w.hashes), np.int64)
        count[listed] = self.words.count[at]
        ids = self.words.runs(at[same])
        if own.any():
            raw = data.tobytes()
            found = [np.array(self._whole(raw[a : a + n].decode()), np.uint32) for a, n in zip(w.starts[own].tolist(), w.lengths[own].tolist(), strict=True)]
            count[own] = [len(f) for f in found]
            of_own = np.repeat(own, count)
            both = np.empty(len(of_own), np.uint32)
            both[~of_own], both[of_own] = ids, np.concatenate(found)
            ids = both
        per_word = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(per_word[np.searchsorted(w.starts, bounds)])


def _lanes(words: Words, some: np.ndarray) -> np.ndarray:
    """The lanes of some of the words."""
    count = lanes_of(words.lengths[some])
    return words.lanes[np.repeat(words.heads[some], count) + places_in(count)]


SCHEMA = "part int, seq int, first_doc long, last_doc long, n_docs long, n_ids long, part_start long, payload binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, in ascending id order, and write the segments under path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    bits = width(max(Tokenizer.from_str(source).get_vocab_size(True), end_id + 1))
    shipped = spark.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.shared(shipped.value)
        part, seq, done = TaskContext.get().partitionId(), 0, 0
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0
        end = np.array([end_id], np.uint32)

        def segment() -> pa.RecordBatch:
            blob = write_segment(held_docs, [len(x) for x in held], np.concatenate(held), bits)
            known = [d for d in held_docs if d is not None]
            row = [part, seq, min(known, default=None), max(known, default=None), len(held), n, done, blob]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            ids, count = encode(*column_bytes(batch.column(1)))
            for doc, own in zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(count)[:-1]), strict=True):
                held_docs.append(doc)
                held.append(np.concatenate([own, end]))
                n += len(own) + 1
                if n >= SEGMENT:
                    yield segment()
                    seq, done, n = seq + 1, done + n, 0
                    held_docs.clear()
                    held.clear()
        if held:
            yield segment()

    chosen = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    tie = F.xxhash64("t")
    ordered = chosen.repartitionByRange(parts(spark), F.col("k"), tie).sortWithinPartitions(F.col("k"), tie)
    map_arrow(ordered, run, SCHEMA, 1).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, part, seq, doc_no."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each task that wrote
    before, starts = 0, {}
    for part, n in totals:
        starts[part] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for part, seq, part_start, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seg = Segment(payload)
                base = starts[part] + part_start
                ids = seg.ids(0, seg.n_ids).astype("<u4")
                for k, doc in enumerate(seg.doc_ids):
                    a, b = int(seg.ends[k]), int(seg.ends[k + 1])
                    rows.append((doc, base + a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seq, k))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "doc_no"])

    return map_arrow(files.select("part", "seq", "part_start", "payload"), run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int, doc_no int", 3)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of that id, read from the segments whose bounds hold it."""
    files = spark.read.schema(SCHEMA).parquet(path)
    found = files.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "seq").select("payload")
    out = []
    for row in found.toLocalIterator():
        seg = Segment(bytes(row.payload))
        out += [seg.document(k) for k, d in enumerate(seg.doc_ids) if d == doc_id]
    return out


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_tokens(spark, path)
