"""Token ids of all documents in files of fixed-width bit-packed blocks.

File format: Parquet files, one per range of doc_id and numbered by ``part``,
whose rows are blocks. A block holds whole documents, in ascending doc_id order:

    part, block   place of the file, and of the block in it
    first         ids in the file before the block
    n_ids, bits   ids in the block, bits of each
    doc_ids       the documents' ids
    doc_ends      for each document, the ids of the block up to its end
    payload       the ids, ``bits`` bits each, most significant bit first

Id number i of a block lies at bit ``i * bits`` of its payload, so any slice is
read without its predecessors and numpy unpacks it in one go. Parquet's row
groups and column chunks are the block offsets: a reader of few documents skips
the others by the statistics of part and block.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, blocks_for, small_batches, text_or_empty

END_ID = 2
#: A block is closed once it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 15
#: Chunks that a Python worker remembers; it forgets all when there would be more.
CACHED = 1_000_000
#: Bytes of text that are encoded at once.
GATHERED = 8 << 20
SCHEMA = "part int, block int, first long, n_ids long, bits int, doc_ids array<long>, doc_ends array<long>, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, most significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out = [np.packbits(((ids[i : i + 65536, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1).astype(np.uint8).ravel()) for i in range(0, len(ids), 65536)]
    return b"".join(x.tobytes() for x in out)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a payload as uint32, from the bytes that hold them alone."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f">u{bits // 8}")[start:stop].astype(np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    at = np.arange(start, stop, dtype=np.int64) * bits
    first, shift = at >> 3, (at & 7).astype(np.uint64)
    low, high = int(first[0]), int(min(len(raw), first[-1] + 8))
    part = np.zeros(high - low + 8, np.uint64)
    part[: high - low] = raw[low:high]
    # Eight bytes hold the 7 bits before an id and up to 57 of it.
    word = np.zeros(len(at), np.uint64)
    for i in range(min(8, (bits + 14) // 8)):
        word |= part[first - low + i] << np.uint64(56 - 8 * i)
    return ((word << shift) >> np.uint64(64 - bits)).astype(np.uint32)


#: Kinds of bytes: white space, ASCII letters, ASCII punctuation but the apostrophe, other printable ASCII, the second
#: byte of a character, the first of a two-byte one that isn't white space; 0 is all else.
_BLANK, _LETTER, _MARK, _PLAIN, _NEXT, _TWO = 1, 2, 3, 4, 5, 6


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = _PLAIN
    for c in range(0x21, 0x7F):
        if chr(c).isalpha():
            kinds[c] = _LETTER
        elif not chr(c).isdigit() and chr(c) != "'":
            kinds[c] = _MARK
    kinds[[9, 10, 11, 12, 13, 32]] = _BLANK
    kinds[0x80:0xC0] = _NEXT
    kinds[0xC3:0xE0] = _TWO
    return kinds


_KINDS = _kinds()


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Whether a byte starts a chunk: places where a byte-level vocabulary always cuts, whatever stands around them.

    Such a vocabulary takes white space only at the front of a piece or by itself,
    so there is a cut before white space that follows anything else. And a run of
    letters ends before punctuation.
    """
    kind = _KINDS[data]
    out = np.zeros(len(data), bool)
    if len(data):
        solid = (kind >= _LETTER) & (kind <= _PLAIN)
        solid[1:] |= (kind[1:] == _NEXT) & (kind[:-1] == _TWO)
        out[1:] = (kind[1:] == _BLANK) & solid[:-1] | (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
        out[0] = True
    return out


class ChunkEncoder:
    """A tokenizer's ids by way of distinct chunks of text, which are remembered.

    Arrow finds the distinct chunks of many texts at once, the tokenizer encodes
    those it has not seen, and numpy lays their ids out. A text with a special
    token's string goes to the tokenizer whole, as do all texts if it isn't of the
    byte-level kind with the usual pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        made = json.loads(t.to_str())
        kind = made.get("pre_tokenizer") or {}
        self.chunked = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made.get("normalizer") and not (made.get("truncation") or made.get("padding"))
        # One character stands for one byte in the names of such a vocabulary.
        vocab = t.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for name, i in vocab.items():
            self.bytes_of[i] = len(name)
        self._forget()
        if self.chunked:
            self.chunked = self._agrees()

    def _agrees(self) -> bool:
        """Whether chunks give what the tokenizer gives for texts with every kind of cut."""
        probe = ["It's a test, isn't it?  Two  blanks\n\n and\tmore 12,345.67 (x) \"q\" né à l'été; ß \u00a0 \u3000x  ", "", "  ", "a" * 40 + "!" * 20 + " 1 a_b"]
        ids, counts = self._by_chunks(pa.array(probe))
        return [ids[b - n : b].tolist() for n, b in zip(counts, np.cumsum(counts), strict=True)] == [x.tolist() for x in self._raw(probe)]

    def _forget(self) -> None:
        #: chunk -> its place in ``first`` and ``size``, which point into ``ids``
        self.known: dict[bytes, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks that start with white space and end with ASCII are encoded in a row, and told apart by the bytes the ids stand for."""
        rows, alone = [], []
        for c in chunks:
            (rows if _KINDS[c[0]] == _BLANK and _LETTER <= _KINDS[c[-1]] <= _PLAIN else alone).append(c)
        ids, sizes = [], []
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            got = self._raw([b"".join(part).decode()])[0]
            ends = np.searchsorted(np.cumsum(self.bytes_of[got]), np.cumsum([len(w) for w in part])) + 1
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        for i in range(0, len(alone), 1024):
            got = self._raw([c.decode() for c in alone[i : i + 1024]])
            ids += got
            sizes.append(np.array([len(x) for x in got]))
        size = np.concatenate(sizes)
        at = len(self.known)
        self.known.update(zip([*rows, *alone], range(at, at + len(chunks)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, *ids])

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:].astype(np.int64) - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = chunk_starts(data)
        starts[ends[ends < len(data)]] = True
        starts = np.flatnonzero(starts).astype(np.int32)
        cut = np.append(starts, np.int32(len(data)))
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(data)]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHED:
            self._forget()
        known = self.known
        if fresh := [c for c in distinct if c not in known]:
            self._learn(fresh)
        slot = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        size = self.size[slot]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[slot] - (upto - size), size) + np.arange(upto[-1])]
        done = np.append(0, upto)[np.searchsorted(starts, ends)]
        return ids, np.diff(done, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as uint32, and each text's count of them. Null texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            got = self._raw(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)
        ids, counts = self._by_chunks(texts)
        raw = texts.buffers()[2]
        if raw is None or not any(raw.to_pybytes().find(s) >= 0 for s in self.special):
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, t in enumerate(texts.to_pylist()):
            if any(s in t.encode() for s in self.special):
                parts[i] = self._raw([t])[0]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The rows in batches of up to about ``most`` bytes of text, or one row."""
    held, size = [], 0
    for batch in batches:
        sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, bits: int | None = None, text: str = "text") -> None:
    """Encode every document and write the files to ``path``.

    Null and empty texts have the end id alone (none without ``end_id``). Null
    doc_ids come first, equal ones in the order of a hash of their text. An empty
    table gives files without blocks. ``bits``: by default what the largest id of
    the vocabulary needs.
    """
    spark = docs.sparkSession
    if bits is None:
        from tokenizers import Tokenizer

        largest = max(Tokenizer.from_file(tokenizer).get_vocab().values())
        bits = max(largest, end_id or 0).bit_length()
    small_batches(spark)
    n = blocks_for(docs, text, 16 << 20)
    rows = docs.select("doc_id", text_or_empty(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        encode, extra = encoder(tokenizer).encode, int(end_id is not None)
        docs_, sizes, pieces, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes))
            row = {"part": part, "block": block, "first": first, "n_ids": held, "bits": bits, "doc_ids": [d for x in docs_ for d in x], "doc_ends": ends, "payload": pack(np.concatenate(pieces), bits)}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in _gathered(batches, "text"):
            ids, counts = encode(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            if extra:
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                counts = counts + 1
            upto, start, done = np.cumsum(counts), 0, 0
            while start < len(doc_ids):
                # The document that fills the block is its last.
                stop = min(int(np.searchsorted(upto, done + BLOCK_IDS - held)) + 1, len(doc_ids))
                docs_.append(doc_ids[start:stop])
                sizes.append(counts[start:stop])
                pieces.append(ids[done : upto[stop - 1]])
                held += int(upto[stop - 1]) - done
                start, done = stop, int(upto[stop - 1])
                if held >= BLOCK_IDS:
                    yield closed()
                    block, first = block + 1, first + held
                    docs_, sizes, pieces, held = [], [], [], 0
        if docs_:
            yield closed()

    rows.mapInArrow(blocks, SCHEMA).write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(path)


ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def _bases(files: DataFrame) -> dict[int, int]:
    """The ids before each file. The driver gets a row for each: as many as the writing job had partitions."""
    base, upto = {}, 0
    for part, n in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        base[part] = upto
        upto += n
    return base


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, its ids.

    Rows with one doc_id, and those without, come back as often as they were
    written. Files without blocks give an empty table.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    base = _bases(files)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = base[r["part"]] + r["first"]
                every = unpack(r["payload"], r["bits"], 0, r["n_ids"]).astype("<u4")
                raw = every.tobytes()
                starts = [0, *r["doc_ends"][:-1]]
                spans = list(zip(starts, r["doc_ends"], strict=True))
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array([at + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array([*starts, r["n_ids"]], pa.int32()), pa.array(every.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    small_batches(spark)
    return files.mapInArrow(read, out)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of all ids in a row, as uint32, whatever documents they are of.

    Only blocks that hold some of them are read, and only the bytes of those ids
    are unpacked. Places beyond the last id give nothing.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    base = _bases(files)
    asked = [(F.col("part") == p) & (F.col("first") < stop - at) & (F.col("first") + F.col("n_ids") > start - at) for p, at in base.items() if at < stop]
    rows = files.where(reduce(or_, asked, F.lit(False))).orderBy("part", "block").select("part", "first", "n_ids", "bits", "payload").collect()
    parts = []
    for r in rows:
        at = base[r.part] + r.first
        parts.append(unpack(bytes(r.payload), r.bits, max(start - at, 0), min(stop - at, r.n_ids)))
    return np.concatenate([np.zeros(0, np.uint32), *parts])


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the rows with this doc_id, in file order; no other document's payload is unpacked."""
    files = spark.read.schema(SCHEMA).parquet(path)
    out = []
    for r in files.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("part", "block").select("bits", "doc_ids", "doc_ends", "payload").collect():
        edges = [0, *r.doc_ends]
        out += [unpack(bytes(r.payload), r.bits, edges[i], edges[i + 1]) for i, d in enumerate(r.doc_ids) if d == doc_id]
    return out


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, write, and read back: doc_id, start, n_tokens and ids_crc32."""
    stash = Stash(docs.sparkSession, "token-files")
    write_tokens(docs, f"{stash.root}/ids", tokenizer)
    return read_tokens(docs.sparkSession, f"{stash.root}/ids", ids=False)
