"""Scoring texts by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER``. A symbol that a context has
not seen is escaped to the next shorter one, with the escape estimate of method
D (each distinct symbol gives half a count to the escape); symbols that the
longer context had are excluded there. Below order 0 all remaining symbols are equally
likely. A text ends with a symbol of its own, so the model is one of whole texts.

The trie may outgrow any one machine. It is never sent anywhere: blocks of
documents ask the buckets that hold it for the code lengths of the distinct
(context, symbol) pairs they have (see exchange.py). The same goes for the word
counts of the unigram baseline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, blocks_for, small_batches
from .exchange import coded, decoded, packed, sorted_lookup, summed, unpacked, with_blocks
from .hashing import U, WordHashes, mix

ORDER = 5
#: The symbol before a text's start and after its end; bytes are 0 to 255.
EDGE = 256
SYMBOLS = 257
BITS = 9
#: Positions that are sorted at once.
SLICE = 1 << 18
#: Keys of slices that are held before they are added up.
MERGED = 1 << 20
WORDS, GRAMS, PAIRS, TOTALS = 0, 1, 2, 3
BUCKETS = 256


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


class Block:
    """The texts of a block as arrays: symbols with edges, words as hashes."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, order: int):
        self.order = order
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + order + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        total = int((sizes + order + 1).sum())
        self.symbols = np.full(total + order, EDGE, np.uint16)
        for at, t in zip(self.first, texts, strict=True):
            self.symbols[at + order : at + order + len(t)] = np.frombuffer(t, np.uint8)
        self.sizes, self.total = sizes, total
        words = [hashes.of(t.split()) for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, U)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In slices: the distinct (context, symbol) keys, each place's index among them, each place's document."""
        n = self.order + 1
        for a, b, doc, inside in self._places():
            key = np.zeros(b - a, U)
            for j in range(n):
                key = (key << U(BITS)) | self.symbols[a + j : b + j]
            distinct, place = np.unique(key[inside], return_inverse=True)
            yield distinct, place.astype(np.int32), doc[inside]

    def _places(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """In slices: first and last + 1 place, the document of each, and whether it is within its text and end."""
        for a in range(0, self.total, SLICE):
            b = min(self.total, a + SLICE)
            doc = (np.searchsorted(self.first, np.arange(a, b), side="right") - 1).astype(np.int32)
            yield a, b, doc, np.arange(a, b) - self.first[doc] <= self.sizes[doc]

    def owners(self) -> Iterator[np.ndarray]:
        """The documents of the places that grams() gives, in the same slices."""
        for _, _, doc, inside in self._places():
            yield doc[inside]


def _gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two symbols of the context, so a bucket has all of a context's shorter forms down to order 2."""
    return (mix((keys >> U(BITS)) & U((1 << 2 * BITS) - 1)) % U(buckets)).astype(np.int64)


def _word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % U(buckets)).astype(np.int64)


def _split(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys), in the order that the answers will have."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _distinct(block: Block, train: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per kind the distinct keys of the block with their counts in documents to learn from."""
    words = np.unique(block.words, return_inverse=True)
    word_train = np.repeat(train, block.n_words)
    found = {WORDS: (words[0], np.bincount(words[1], word_train, len(words[0])).astype(np.int64))}
    keys, counts, held, most = [np.zeros(0, U)], [np.zeros(0, np.int32)], 0, MERGED
    for distinct, place, doc in block.grams():
        keys.append(distinct)
        counts.append(np.bincount(place, train[doc], len(distinct)).astype(np.int32))
        held += len(distinct)
        if held > most:
            # Slices have many keys in common, so adding them up on the way takes less memory.
            merged = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [merged[0]], [merged[1].astype(np.int32)], len(merged[0])
            most = max(MERGED, 2 * held)
    keys, counts = summed(np.concatenate(keys), np.concatenate(counts))
    found[GRAMS] = keys, counts.astype(np.int64)
    return found


ASKED = "kind int, bucket int, block int, keys binary, counts binary"
_ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_BUCKET_OF = {WORDS: _word_bucket, GRAMS: _gram_bucket}


def _rows(table: pa.Table, order: int) -> tuple[Block, np.ndarray]:
    texts = [normalised(t) for t in table.column("text").to_pylist()]
    return Block(texts, WordHashes(), order), np.array(table.column("train").to_pylist(), bool).astype(np.float64)


def _ask(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        block, train = _rows(table, order)
        out = []
        for kind, (keys, counts) in _distinct(block, train).items():
            for bucket, at in _split(keys, _BUCKET_OF[kind](keys, buckets)):
                out.append((kind, bucket, number, packed(keys[at], True), packed(counts[at].astype(np.int32))))
            if kind == GRAMS:
                pairs = summed(keys & U((1 << 2 * BITS) - 1), counts)
                out.append((PAIRS, 0, number, pairs[0].tobytes(), pairs[1].tobytes()))
        totals = np.array([(block.n_words * train).sum() + train.sum(), train.sum()], np.int64)
        out.append((TOTALS, 0, number, b"", totals.tobytes()))
        return pa.Table.from_pylist([dict(zip(_ASKED.names, r, strict=True)) for r in out], schema=_ASKED)

    return run


class Trie:
    """Counts of (context, symbol) for one order, with what excluding the next longer order takes away."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, longer: Trie | None, mask: int | None):
        self.keys, self.counts = keys, counts
        ctx = keys >> U(BITS)
        self.ctx, self.n = summed(ctx, counts)
        self.d = summed(ctx, np.ones(len(ctx), np.int64))[1]
        if longer is not None:
            # For each context of the longer order: the counts here of the symbols it has.
            here = sorted_lookup(longer.keys & U(mask), keys, counts, 0)
            longer.lost = summed(longer.keys >> U(BITS), here)[1]


def build(keys: np.ndarray, counts: np.ndarray, order: int, pairs: tuple[np.ndarray, np.ndarray]) -> list[Trie]:
    """Orders from the highest down to 0. ``keys`` have all of their contexts' shorter forms down to order 2;
    ``pairs`` are the whole corpus's counts of order 1, which are at most 257 * 257.
    """
    keys, counts = keys[counts > 0], counts[counts > 0]
    levels: list[Trie] = []
    for k in range(order, -1, -1):
        mask = (1 << (k + 1) * BITS) - 1
        if k >= 2:
            level = summed(keys & U(mask), counts)
        else:
            level = summed(pairs[0] & U(mask), pairs[1])
        levels.append(Trie(*level, levels[-1] if levels else None, mask))
    levels[-1].lost = np.zeros(len(levels[-1].ctx), np.int64)
    return levels


def log10_probability(asked: np.ndarray, levels: list[Trie], order: int) -> np.ndarray:
    """Of each (context, symbol), escapes included."""
    out = np.zeros(len(asked))
    open_ = np.ones(len(asked), bool)
    gone_n, gone_d = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    for k, level in zip(range(order, -1, -1), levels, strict=True):
        key = asked & U((1 << (k + 1) * BITS) - 1)
        node = key >> U(BITS)
        n = sorted_lookup(node, level.ctx, level.n, 0)
        d = sorted_lookup(node, level.ctx, level.d, 0)
        c = sorted_lookup(key, level.keys, level.counts, 0)
        left_n, left_d = n - gone_n, d - gone_d
        hit = open_ & (c > 0)
        out[hit] += np.log10((2 * c[hit] - 1) / (2 * left_n[hit]))
        escape = open_ & (c == 0) & (left_n > 0)
        out[escape] += np.log10(left_d[escape] / (2 * left_n[escape]))
        open_ &= c == 0
        gone_n, gone_d = sorted_lookup(node, level.ctx, level.lost, 0), d
    out[open_] -= np.log10(SYMBOLS - gone_d[open_])
    return out


ANSWERED = "kind int, bucket int, block int, answers binary"


def _answer(order: int, pairs: tuple[np.ndarray, np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        asked = [unpacked(x, U, True) for x in table.column("keys").to_pylist()]
        keys, counts = summed(np.concatenate(asked), np.concatenate([unpacked(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64))
        if kind == WORDS:
            values = counts
            # How many words of this bucket were learned.
            blocks, asked = [*blocks, -1], [*asked, None]
        else:
            values = log10_probability(keys, build(keys, counts, order, pairs), order)
        pack = packed if kind == WORDS else coded
        answers = [pack(values[np.searchsorted(keys, a)]) if a is not None else np.array([(counts > 0).sum()], np.int64).tobytes() for a in asked]
        m = len(blocks)
        return pa.table({"kind": pa.array([kind] * m, pa.int32()), "bucket": pa.array([bucket] * m, pa.int32()), "block": pa.array(blocks, pa.int32()), "answers": pa.array(answers, pa.binary())})

    return run


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, buckets: int, n_train: int, n_train_docs: int, vocabulary: int):
    def run(docs: pa.Table, answered: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": [], "train": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []}, schema=_SCORED)
        got = {(k, b): a for k, b, a in zip(*(answered.column(c).to_pylist() for c in ("kind", "bucket", "answers")), strict=True)}
        block, train = _rows(docs, order)
        n = docs.num_rows

        def filled(keys: np.ndarray, kind: int, dtype) -> np.ndarray:
            values = np.zeros(len(keys), dtype)
            for bucket, at in _split(keys, _BUCKET_OF[kind](keys, buckets)):
                values[at] = unpacked(got[kind, bucket], dtype) if kind == WORDS else decoded(got[kind, bucket])
            return values

        owner = np.repeat(np.arange(n), block.n_words)
        words, place = np.unique(block.words, return_inverse=True)
        counts = filled(words, WORDS, np.int64)
        scale = np.log10(n_train + vocabulary + 1)
        base = np.bincount(owner, (np.log10(counts + 1) - scale)[place], n) + np.log10(n_train_docs + 1) - scale
        known = np.bincount(owner, (counts > 0)[place].astype(np.float64), n) + (n_train_docs > 0)
        # Each place's document is found again, as it would take as much memory as all else.
        slices = [(distinct, place) for distinct, place, _ in block.grams()]
        every = np.unique(np.concatenate([s[0] for s in slices]))
        lengths = filled(every, GRAMS, np.float64)
        score = np.zeros(n)
        for (distinct, place), doc in zip(slices, block.owners(), strict=True):
            score += np.bincount(doc, lengths[np.searchsorted(every, distinct)][place], n)
        return pa.table([docs.column("doc_id"), docs.column("train"), pa.array(block.n_words + 1), pa.array(known.astype(np.int64)), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(score)], schema=_SCORED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, train: Column, order: int = ORDER, text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Learn from the rows where ``train`` holds; score all rows.

    Texts are lower-cased (A-Z). Tokens are words cut at ASCII white space and
    one end per text. Returns doc_id, train, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (log10 of the unigram model with add-one
    smoothing, one more type for the unseen) and score (log10 of the PPM
    probability of the text and its end). Null texts are empty. Without a row to
    learn from, PPM codes each symbol as one of 257. Rows that repeat are scored
    alike. An empty table gives an empty one. Words are known by a 64-bit hash.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6, as a context and a symbol make a 64-bit key")
    spark = docs.sparkSession
    small_batches(spark)
    stash = Stash(spark, "lm-score")
    n = blocks_for(docs, text, block_bytes)
    buckets = max(BUCKETS, n // 2)
    blocks = with_blocks(docs.withColumn("__train", F.coalesce(train, F.lit(False))), n, text, F.col("__train").alias("train"))
    asked = stash.keep(blocks.groupBy("block").applyInArrow(_ask(order, buckets), ASKED), "asked")
    pairs, n_train, n_train_docs = _small(asked)
    answers = stash.keep(asked.where(F.col("kind") <= GRAMS).groupBy("kind", "bucket").applyInArrow(_answer(order, pairs), ANSWERED), "answers")
    stash.drop("asked")
    vocabulary = _types(answers) + (n_train_docs > 0)
    run = _score(order, buckets, n_train, n_train_docs, vocabulary)
    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(run, SCORED)


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's order-1 counts and totals as dense arrays of fixed size, added up."""
    table, totals = np.zeros(1 << 2 * BITS, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
            values = np.frombuffer(counts, np.int64)
            if kind == PAIRS:
                table[np.frombuffer(keys, U).astype(np.int64)] += values
            else:
                totals += values
    at = np.flatnonzero(table)
    yield pa.record_batch({"key": pa.array([-1, -2, *at.tolist()], pa.int64()), "n": pa.array([*totals.tolist(), *table[at].tolist()], pa.int64())})


def _small(asked: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
    """Order 1, at most 257 * 257 counts, and the two totals."""
    merged = asked.where(F.col("kind") >= PAIRS).select("kind", "keys", "counts").mapInArrow(_merge_pairs, "key long, n long")
    got = merged.groupBy("key").agg(F.sum("n").alias("n")).toPandas().set_index("key")["n"]
    pairs = got[got.index >= 0].sort_index()
    return (pairs.index.to_numpy(np.uint64), pairs.to_numpy(np.int64)), int(got.get(-1, 0)), int(got.get(-2, 0))


def _types(answers: DataFrame) -> int:
    """Distinct words learned: a count from each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(np.frombuffer(x, np.int64)[0]) for b in batches for x in b.column("answers").to_pylist())
        yield pa.record_batch({"n": pa.array([total], pa.int64())})

    return answers.where("block = -1").select("answers").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


class Adaptive:
    """The same code with a model that starts empty and learns each symbol after coding it, one text at a time."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], dict[int, int]] = {}

    def log10(self, text: str) -> float:
        past: tuple[int, ...] = ()
        total = 0.0
        for s in [*normalised(text), EDGE]:
            gone: set[int] = set()
            for k in range(min(self.order, len(past)), -1, -1):
                node = self.counts.get(past[len(past) - k :])
                if not node:
                    continue
                left = {x: c for x, c in node.items() if x not in gone}
                n, d = sum(left.values()), len(left)
                if s in left:
                    total += float(np.log10((2 * left[s] - 1) / (2 * n)))
                    break
                if n:
                    total += float(np.log10(d / (2 * n)))
                gone |= node.keys()
            else:
                total -= float(np.log10(SYMBOLS - len(gone)))
            for k in range(min(self.order, len(past)) + 1):
                node = self.counts.setdefault(past[len(past) - k :], {})
                node[s] = node.get(s, 0) + 1
            past = (*past, s)[-self.order :]
        return total


def score_adaptive(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """(doc_id, score): each text's log10 code length under a model of its own that learns as it goes.

    Null texts are empty: their end alone is coded, as one of 257 symbols. A very
    long text is coded whole; its model is held by the one task that codes it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array([Adaptive(order).log10(t) for t in batch.column("text").to_pylist()], pa.float64())})

    return rows.mapInArrow(run, "doc_id long, score double")


def score_digest(docs: DataFrame) -> DataFrame:
    """Learn from documents whose remainder by 7 isn't 2, score all."""
    out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(docs, ~out).withColumn("held_out", ~F.col("train")).drop("train")
