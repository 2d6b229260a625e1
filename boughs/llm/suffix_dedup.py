"""Removing passages that an earlier document has, by prefix doubling over sampled positions.

A position's rank names the string of the current length that starts there;
the ranks of two positions at an offset make the rank at the double length.
Within a document the doubling runs on 64-bit names (1, 2, 4, 8, 16, 24, 32, 50
bytes), where the two ranks of a pair stand side by side. Across documents Spark
sorts and reranks in three rounds, each at a greater length, and each round goes
on only with the positions that the one before has not settled:

1. Anchors, at 24 bytes. Of the 27 starts of 24 bytes within a string of 50, the
   one of least name is the string's anchor; equal strings have equal anchors.
   Strings with one anchor are neighbours and make a run. An anchor that no
   other run shares is unique, and its strings with it.
2. Runs, at the length of the run (50 to 76 bytes), sorted in the same step. A
   run equal to one of an earlier document is removed whole. Of equal runs only
   the first document's goes on, and only if its anchor has unequal runs too.
3. Strings, at 50 bytes, of the runs that are left.

So each string of 50 bytes is compared with all others, without a row for every
byte of the corpus. Names are hashes and no bytes are compared: unlike runs under
one anchor are taken for equal if 64 bits agree, unlike strings if 96 do. Sorted names go between blocks of documents and buckets of
names as arrays; each block sends a name once, whoever has it (see exchange.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, blocks_for, small_batches
from .exchange import with_blocks
from .hashing import U, mix

LENGTH, ANCHOR = 50, 24
SPAN = LENGTH - ANCHOR + 1
#: String starts that are named at once.
SLICE = 1 << 17
BUCKETS = 64
#: Orders rows without doc_id after all others.
LAST = np.iinfo(np.int64).max

_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in a row."""
    z = a * _A
    z += b
    z ^= z >> U(29)
    z *= _B
    z ^= z >> U(32)
    return z


def _doubled(names: np.ndarray, offset: int) -> np.ndarray:
    return _pair(names[:-offset], names[offset:])


#: Turns the bytes' names into others, for more bits of a string's name.
_OTHER = U(0xC2B2AE3D27D4EB4F)


def names(data: np.ndarray, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 24 and the 50 bytes from each position on; ``turned`` gives independent ones."""
    h = mix(_BYTES ^ _OTHER)[data] if turned else _BYTES[data]
    for k in (1, 2, 4):
        h = _doubled(h, k)
    eight = h
    h = _doubled(h, 8)
    anchor = _pair(h[: len(h) - 8], eight[16:])
    h = _doubled(h, 16)
    return anchor, _doubled(h, LENGTH - 32)


def least_within(anchor: np.ndarray) -> np.ndarray:
    """For each string the offset of its anchor: the first of the least of SPAN names."""
    m = anchor & ~U(255)
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:] + U(k))
    m = np.minimum(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :] + U(SPAN - 16))
    return (m & U(255)).astype(np.int64)


class Texts:
    """A block's documents in ascending order of doc_id, as one array of bytes."""

    def __init__(self, doc_ids: list[int | None], texts: list[bytes]):
        ids = np.array([LAST if d is None else d for d in doc_ids], np.int64)
        order = np.argsort(ids, kind="stable")
        self.doc_ids, self.ids = [doc_ids[i] for i in order], ids[order]
        self.texts = [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.texts], np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first position, 24-byte names, 50-byte names, documents, whether a string ends within its document)."""
        for a in range(0, max(0, len(self.data) - LENGTH + 1), SLICE):
            part = self.data[a : a + SLICE + LENGTH - 1]
            anchor, fifty = names(part)
            doc = np.searchsorted(self.ends, np.arange(a, a + len(fifty)), side="right")
            yield a, anchor, fifty, doc, np.arange(a, a + len(fifty)) + LENGTH <= self.ends[doc]

    def runs(self) -> dict[str, np.ndarray]:
        """All runs: start, count of strings, name of the anchor, name of the run, document."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("start", "count", "anchor", "run", "doc")}
        for a, anchor, fifty, doc, whole in self.slices():
            p = np.flatnonzero(whole)
            if not len(p):
                continue
            at = p + least_within(anchor)[p]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
            count = np.diff(np.concatenate([first, [len(p)]]))
            key = anchor[at[first]]
            # The names of a run's strings, added up, name the run.
            run = np.add.reduceat(mix(fifty[p]), first)
            for k, v in zip(out, (p[first] + a, count, key, mix(key * _A + run), doc[p[first]]), strict=True):
                out[k].append(v)
        kinds = {"start": np.int64, "count": np.int64, "anchor": U, "run": U, "doc": np.int64}
        return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}

    def strings(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, 50-byte names, 32 further bits of them) of the strings of runs, which are in order."""
        total = int(count.sum())
        pos = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)
        found, more = np.zeros(total, U), np.zeros(total, np.uint32)
        for a in range(0, len(self.data), SLICE):
            lo, hi = np.searchsorted(pos, [a, a + SLICE])
            if hi > lo:
                first, last = int(pos[lo]), int(pos[hi - 1])
                found[lo:hi] = names(self.data[first : last + LENGTH])[1][pos[lo:hi] - first]
                more[lo:hi] = names(self.data[first : last + LENGTH], True)[1][pos[lo:hi] - first].astype(np.uint32)
        return pos, found, more


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % U(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = _firsts(bucket[order])
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _short(x: np.ndarray, size: int) -> bytes:
    """The lowest bytes of little-endian integers."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _long(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8").astype(U)


def _doc_bytes(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Ids as differences from the least, in four bytes if they fit."""
    base = int(ids.min()) if len(ids) else 0
    off = ids.astype(U) - U(base & (2**64 - 1))
    width = 4 if not len(off) or int(off.max()) < 2**32 else 8
    return base, width, _short(off, width)


def _doc_ids(base: int, width: int, raw: bytes) -> np.ndarray:
    return (_long(raw, width) + U(base & (2**64 - 1))).view(np.int64)


#: Bytes of an anchor's name that are sent; its bucket adds 6 bits or more. Runs are compared under one anchor, by all 8 bytes of their names.
ANCHOR_BYTES, RUN_BYTES = 5, 8
ASKED = "bucket int, block int, anchors binary, names binary, base long, width int, docs binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("names", pa.binary()), ("base", pa.int64()), ("width", pa.int32()), ("docs", pa.binary())])
ANSWERED = "block int, bucket int, codes binary"
ALONE, REMOVED, GOES_ON = 0, 1, 2


def _texts(table: pa.Table) -> Texts:
    return Texts(table.column("doc_id").to_pylist(), [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()])


def _classes(runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of runs by name and document, first run of each name in it)."""
    order = np.argsort(runs["run"], kind="stable")  # runs come in order of document
    return order, _firsts(runs["run"][order])


def _ask_runs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        texts = _texts(table)
        runs = texts.runs()
        order, first = _classes(runs)
        first = order[first]
        key, name, doc = runs["anchor"][first], runs["run"][first], texts.ids[runs["doc"][first]] if len(first) else np.zeros(0, np.int64)
        number, out = table.column("block")[0].as_py(), []
        for bucket, at in _split(_bucket(key, buckets)):
            out.append((bucket, number, _short(key[at], ANCHOR_BYTES), _short(name[at], RUN_BYTES), *_doc_bytes(doc[at])))
        return pa.Table.from_pylist([dict(zip(_ASKED.names, r, strict=True)) for r in out], schema=_ASKED)

    return run


def _gathered(table: pa.Table, column: str, size: int) -> np.ndarray:
    return np.concatenate([_long(x, size) for x in table.column(column).to_pylist()])


def _codes_back(table: pa.Table, codes: np.ndarray, size: int, column: str) -> pa.Table:
    ends = np.cumsum([len(x) // size for x in table.column(column).to_pylist()])
    raw = codes.astype(np.uint8).tobytes()
    parts = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "codes": pa.array(parts, pa.binary())})


def _all_docs(table: pa.Table) -> np.ndarray:
    return np.concatenate([_doc_ids(*x) for x in zip(*(table.column(c).to_pylist() for c in ("base", "width", "docs")), strict=True)])


def _rank_runs(table: pa.Table) -> pa.Table:
    """Sort a bucket's runs by anchor, name and document: which are removed, and which go on."""
    key, name, doc = _gathered(table, "anchors", ANCHOR_BYTES), _gathered(table, "names", RUN_BYTES), _all_docs(table)
    order = np.lexsort((doc, name, key))
    k, n, d = key[order], name[order], doc[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_name = new_key | np.concatenate([[True], n[1:] != n[:-1]])
    group, cls = np.cumsum(new_key) - 1, np.cumsum(new_name) - 1
    least = d[np.flatnonzero(new_name)][cls]
    classes = np.bincount(group[new_name])[group]
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.where(d > least, REMOVED, np.where(classes > 1, GOES_ON, ALONE))
    return _codes_back(table, codes, ANCHOR_BYTES, "anchors")


#: What the second round gives: finished documents, with what they keep, whole documents that wait for their strings, and the strings.
SECOND = "kind int, block int, bucket int, doc_id long, n_bytes long, data binary, spans array<long>, strings array<long>, names binary, base long, width int, docs binary"
_SECOND = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary()), ("spans", pa.list_(pa.int64())), ("strings", pa.list_(pa.int64())), ("names", pa.binary()), ("base", pa.int64()), ("width", pa.int32()), ("docs", pa.binary())])
DONE, OPEN, STRINGS = 0, 1, 2


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(c, np.uint8) for b, c in zip(table.column("bucket").to_pylist(), table.column("codes").to_pylist(), strict=True)}


def _covered(start: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches (first, last + 1) of n bytes that the strings of runs cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + count + (LENGTH - 1), -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(step)[:n] > 0, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _by_doc(texts: Texts, first: np.ndarray, last: np.ndarray) -> list[list[int]]:
    """Stretches as [first, last + 1, ...] within each document; one that goes on in the next document is cut."""
    out: list[list[int]] = [[] for _ in texts.texts]
    doc = np.searchsorted(texts.ends, first, side="right")
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
        while a < b:
            end = min(b, int(texts.ends[d]))
            if end > a:
                out[d] += [a - int(texts.starts[d]), end - int(texts.starts[d])]
            a, d = end, d + 1
    return out


def _kept(text: bytes, spans: list[int]) -> bytes:
    edges = [0, *spans, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text


def _settle_runs(buckets: int):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SECOND.empty_table()
        texts, got, number = _texts(table), _answers(answered), table.column("block")[0].as_py()
        runs = texts.runs()
        order, first = _classes(runs)
        code = np.zeros(len(first), np.uint8)
        for bucket, at in _split(_bucket(runs["anchor"][order[first]], buckets)):
            code[at] = got[bucket]
        cls = np.empty(len(order), np.int64)
        cls[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
        earlier = texts.ids[runs["doc"]] > texts.ids[runs["doc"][order[first]]][cls] if len(order) else np.zeros(0, bool)
        gone = earlier | (code[cls] == REMOVED)
        on = ~gone & (code[cls] == GOES_ON)
        spans = _by_doc(texts, *_covered(runs["start"][gone], runs["count"][gone], len(texts.data)))
        open_ = np.zeros(len(texts.texts), bool)
        open_[runs["doc"][on]] = True
        strings: list[list[int]] = [[] for _ in texts.texts]
        for d, s, c in zip(runs["doc"][on].tolist(), (runs["start"][on] - texts.starts[runs["doc"][on]]).tolist(), runs["count"][on].tolist(), strict=True):
            strings[d] += (s, c)
        out = []
        for i, t in enumerate(texts.texts):
            out.append({"kind": OPEN if open_[i] else DONE, "block": number, "doc_id": texts.doc_ids[i], "n_bytes": len(t), "data": t if open_[i] else _kept(t, spans[i]), "spans": spans[i], "strings": strings[i]})
        out += _asked_strings(texts, runs["start"][on], runs["count"][on], number, buckets)
        return pa.Table.from_pylist(out, schema=_SECOND)

    return run


def _first_strings(texts: Texts, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(positions, distinct names, their further bits, each position's index among them, the first document of each name)."""
    pos, name, more = texts.strings(start, count)
    order = np.lexsort((more, name))  # stable, so equal names stay in the order of their documents
    name, more = name[order], more[order]
    new = np.ones(len(order), bool)
    new[1:] = (name[1:] != name[:-1]) | (more[1:] != more[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = pos[order[new]]
    return pos, name[new], more[new], place, texts.ids[np.searchsorted(texts.ends, first, side="right")] if len(pos) else np.zeros(0, np.int64)


def _asked_strings(texts: Texts, start: np.ndarray, count: np.ndarray, number: int, buckets: int) -> list[dict]:
    _, distinct, more, _, doc = _first_strings(texts, start, count)
    rows = []
    for bucket, at in _split(_bucket(distinct, buckets)):
        base, width, docs = _doc_bytes(doc[at])
        rows.append({"kind": STRINGS, "block": number, "bucket": bucket, "names": distinct[at].tobytes(), "data": more[at].tobytes(), "base": base, "width": width, "docs": docs})
    return rows


def _rank_strings(table: pa.Table) -> pa.Table:
    name, more, doc = _gathered(table, "names", 8), np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]), _all_docs(table)
    order = np.lexsort((doc, more, name))
    n, m = name[order], more[order]
    new = np.concatenate([[True], (n[1:] != n[:-1]) | (m[1:] != m[:-1])])
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    codes = np.empty(len(order), np.uint8)
    codes[order] = np.where(doc[order] > least, REMOVED, ALONE)
    return _codes_back(table, codes, 8, "names")


FOUND = "doc_id long, n_bytes long, data binary, spans array<long>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary()), ("spans", pa.list_(pa.int64()))])


def _settle_strings(buckets: int):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FOUND.empty_table()
        got = _answers(answered)
        ids, data = table.column("doc_id").to_pylist(), table.column("data").to_pylist()
        order = np.argsort(np.array([LAST if d is None else d for d in ids], np.int64), kind="stable")
        texts = Texts(ids, data)
        spans, strings = table.column("spans").to_pylist(), table.column("strings").to_pylist()
        start, count, gone_s, gone_c = [], [], [], []
        for i, row in enumerate(order.tolist()):
            s = np.array(strings[row], np.int64)
            start.append(s[::2] + texts.starts[i])
            count.append(s[1::2])
            g = np.array(spans[row], np.int64)
            # A stretch is LENGTH bytes or more: as many strings as bring it out again.
            gone_s.append(g[::2] + texts.starts[i])
            gone_c.append(g[1::2] - g[::2] - (LENGTH - 1))
        pos, distinct, _, place, doc = _first_strings(texts, np.concatenate(start), np.concatenate(count))
        code = np.zeros(len(distinct), np.uint8)
        for bucket, at in _split(_bucket(distinct, buckets)):
            code[at] = got[bucket]
        own = texts.ids[np.searchsorted(texts.ends, pos, side="right")]
        hit = (code[place] == REMOVED) | (own > doc[place])
        more = pos[hit]
        first, last = _covered(np.concatenate([*gone_s, more]), np.concatenate([*gone_c, np.ones(len(more), np.int64)]), len(texts.data))
        return pa.Table.from_pylist([{"doc_id": d, "n_bytes": len(t), "data": _kept(t, s), "spans": s} for d, t, s in zip(texts.doc_ids, texts.texts, _by_doc(texts, first, last), strict=True)], schema=_FOUND)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, spans ([first, last + 1, ...] of its maximal removed stretches), kept (the remaining bytes) and kept_sha256.

    A byte is removed if a string of 50 bytes covers it that also starts in a
    document with a smaller doc_id; what is removed there doesn't matter. Null
    and empty texts, and texts under 50 bytes, keep all. Rows with one doc_id
    don't remove each other's bytes. Rows without doc_id come after all others.
    An empty table gives an empty one; further columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stash = Stash(spark, "suffix-dedup")
    n = blocks_for(docs, text, block_bytes)
    buckets = max(BUCKETS, n // 2)
    blocks = with_blocks(docs, n, text)
    asked = blocks.groupBy("block").applyInArrow(_ask_runs(buckets), ASKED)
    ranked = stash.keep(asked.groupBy("bucket").applyInArrow(_rank_runs, ANSWERED), "runs")
    second = blocks.groupBy("block").cogroup(ranked.groupBy("block")).applyInArrow(_settle_runs(buckets), SECOND)
    second = stash.keep(second, "settled")
    stash.drop("runs")
    strings = second.where(F.col("kind") == STRINGS).select("bucket", "block", "names", "data", "base", "width", "docs")
    ranked = stash.keep(strings.groupBy("bucket").applyInArrow(_rank_strings, ANSWERED), "strings")
    waiting = second.where(F.col("kind") == OPEN).select("block", "doc_id", "data", "spans", "strings")
    last = waiting.groupBy("block").cogroup(ranked.groupBy("block")).applyInArrow(_settle_strings(buckets), FOUND)
    found = second.where(F.col("kind") == DONE).select("doc_id", "n_bytes", "data", "spans").unionByName(last)
    # In the JVM: a second Python worker for each task would take its memory besides the first one's.
    removed = F.col("n_bytes") - F.octet_length("data")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "spans", F.col("data").alias("kept"), F.sha2("data", 256).alias("kept_sha256"))


def op4_sql() -> str:
    """The same over DuckDB: a row for each string of 50 bytes."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
    m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
    x AS (SELECT doc_id, i FROM s JOIN m USING (g) WHERE doc_id > least),
    r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM x)),
    p AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM r GROUP BY doc_id, run),
    q AS (SELECT doc_id, k, b, a - coalesce(lag(b) OVER w, 0) AS gap, coalesce(lag(b) OVER w, 0) AS start FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    t AS (SELECT doc_id, count(*) AS n_spans, string_agg(substr(h, 2 * start + 1, 2 * gap), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, ((len(h) - len(coalesce(kept, h))) // 2)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN t USING (doc_id)"""
