"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words make one automaton. Training words stream through
it; the state after each word gives the longest suffix of the words so far that
occurs in any item. Wherever that reaches a window's length, or a whole short
item ends, the words of the match are hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

WINDOW = 8
#: Automata are of at most so many words, some 10 MB of arrays in each Python worker; longer items come in parts that overlap.
MOST_WORDS = 250_000
#: Lower-cased bytes that belong to no word.
_BLANK = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_BLANK = bytes.maketrans(_BLANK, b" " * len(_BLANK))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SLOTS = 22


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_BLANK).split()


class _Builder:
    """The states of a suffix automaton over word numbers, built up an item at a time."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


class Automaton:
    """Suffix automaton over word numbers, as flat arrays; unknown words are 0 and lead to the root.

    ``keys`` are the sorted transitions (state, word), ``targets`` where they lead.
    ``whole`` is for each state that of its last ``window`` words. ``found`` lists
    items by state: a state's are those at ``edges[state]`` up to the next. Those
    shorter than a window are found along ``short``, which leads from a state to
    the next suffix that is such an item.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        held, self.need = [], window
        for name, words in items:
            if words:
                held.append((name, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]))
                self.need = min(self.need, len(words))
        made = _Builder()
        for _, ids in held:
            made.add(ids)
        self.size = len(self.vocab) + 1
        self.link, self.length = np.array(made.link, np.int32), np.array(made.length, np.int32)
        keys = np.array([state * self.size + c for state, out in enumerate(made.next) for c in sorted(out)], np.int64)
        targets = np.array([out[c] for out in made.next for c in sorted(out)], np.int32)
        self.keys, self.targets = keys, targets
        # A suffix link leads to a shorter state, so all are settled in the order of their lengths.
        order = np.argsort(self.length, kind="stable").tolist()
        link, length = made.link, made.length
        whole = list(range(len(length)))
        for s in order[1:]:
            if length[link[s]] >= window:
                whole[s] = whole[link[s]]
        self.whole = np.array(whole, np.int32)
        self.names = list(dict.fromkeys(name for name, _ in held))
        number = {name: i for i, name in enumerate(self.names)}
        ends, pairs = set(), [np.zeros(0, np.int64)]
        for name, ids in held:
            state = 0
            for i, c in enumerate(ids):
                state = made.next[state][c]
                if i + 1 >= window:
                    ends.add((whole[state], number[name]))
            if len(ids) < window:
                # Short items of one state have one length, as they are the same words.
                ends.add((state, number[name]))
            pairs.append(self._pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)))
        at = np.array(sorted(ends), np.int64).reshape(-1, 2)
        self.edges, self.found = np.searchsorted(at[:, 0], np.arange(len(length) + 1)).astype(np.int32), at[:, 1].astype(np.int32)
        brief = {state for name, ids in held if len(ids) < window for state in [self._end(made, ids)]}
        short = [0] * len(length)
        for s in order[1:]:
            short[s] = link[s] if link[s] in brief else short[link[s]]
        self.brief = np.array([s in brief for s in range(len(length))], bool)
        self.short = np.array(short, np.int32)
        self.known = np.zeros(1 << _SLOTS, bool)
        self.known[self._slot(np.concatenate(pairs))] = True

    @staticmethod
    def _end(made: _Builder, ids: list[int]) -> int:
        state = 0
        for c in ids:
            state = made.next[state][c]
        return state

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * self.size + b

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges that can hold a match: enough known word pairs in a row. Only these are walked."""
        if self.need == 1:
            good, least, extra = ids > 0, 1, 0
        else:
            a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
            good, least, extra = (a > 0) & (b > 0), self.need - 1, 1
            good &= self.known[self._slot(self._pair(a, b))]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= least
        return list(zip(starts[long].tolist(), (stops[long] + extra).tolist(), strict=True))

    def _step(self, state: int, c: int) -> int:
        """Where a word leads, or -1."""
        key = state * self.size + c
        at = int(self.keys.searchsorted(key))
        return int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def walk(self, ids: list[int], base: int) -> Iterator[tuple[int, int, list[int]]]:
        """(first, last + 1, items) of the words of each match, from word ``base`` on."""
        state = n = 0
        for i, c in enumerate(ids, base + 1):
            to = self._step(state, c)
            while to < 0 and state:
                state = int(self.link[state])
                n = int(self.length[state])
                to = self._step(state, c)
            if to >= 0:
                state, n = to, n + 1
            if n >= self.window:
                s = int(self.whole[state])
                if hit := self._items(s):
                    yield i - n, i, hit
            # A state stands for suffixes of several lengths; a short item is its longest, as it starts its text.
            s = state if self.brief[state] and n >= self.length[state] else int(self.short[state])
            while s:
                yield i - int(self.length[s]), i, self._items(s)
                s = int(self.short[s])

    def _items(self, state: int) -> list[int]:
        return self.found[self.edges[state] : self.edges[state + 1]].tolist()


def _pieces(words: list[bytes], most: int, window: int) -> Iterator[list[bytes]]:
    """An item's words in parts of at most ``most``, which overlap by half, so every window lies whole in one."""
    step = max(1, min(most // 2, most - window + 1))
    for a in range(0, max(1, len(words) - most + step), step):
        yield words[a : a + most]


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> Iterator[Automaton]:
    """Automata over all items, one after the other, each over at most ``most_words`` words. Items stream to the driver, a part at a time."""
    most = max(most_words, window)
    part, n, made = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("k"), F.col("text").alias("t")).toLocalIterator():
        for words in _pieces(normalised(r["t"]), most, window):
            if part and n + len(words) > most:
                yield Automaton(part, window)
                part, n, made = [], 0, True
            part.append((r["k"], words))
            n += len(words)
    if part or not made:
        yield Automaton(part, window)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(automaton: Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None], int]:
    """Hit word ranges of a text, the items with occurring windows, and the longest match's words."""
    ids = np.fromiter(map(automaton.vocab.get, words, repeat(0)), np.int32, len(words))
    spans, items, longest = [], set(), 0
    for a, b in automaton.runs(ids):
        for first, last, hit in automaton.walk(ids[a:b].tolist(), a):
            longest = max(longest, last - first)
            if spans and first <= spans[-1][1]:
                spans[-1] = (min(first, spans[-1][0]), max(last, spans[-1][1]))
            else:
                spans.append((first, last))
            items.update(hit)
    return _merge(spans), {automaton.names[i] for i in items}, longest


_FOUND = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """Add n_words, hit_spans (merged [first, last + 1) word ranges), hit_items (sorted) and longest_match to ``keep``.

    Every item counts, whatever their number and length: what one automaton can't
    hold goes to a further pass. (A match over half of ``most_words`` words counts
    with the words it has in one part for longest_match.) Null texts and items have no words and match nothing;
    items without id count as one, which is a null at the end of hit_items. Input columns with the added names are
    replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["n_words", "hit_spans", "hit_items", "longest_match"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    df = docs.select(*keep, text_or_empty(text).alias("__text"))
    for turn, automaton in enumerate(automata(benchmark, window, most_words)):
        shared = spark.sparkContext.broadcast(automaton)
        del automaton  # the driver holds one at a time
        base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in added)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(len(w), *find(shared.value, w)) for w in map(normalised, batch.column("__text").to_pylist())]
                spans, items, longest = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
                if turn:
                    spans = [_merge([*x, *map(tuple, y)]) for x, y in zip(spans, batch.column("hit_spans").to_pylist(), strict=True)]
                    items = [x.union(y) for x, y in zip(items, batch.column("hit_items").to_pylist(), strict=True)]
                    longest = list(map(max, longest, batch.column("longest_match").to_pylist()))
                old = [n for n in batch.schema.names if n not in added]
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x, key=lambda k: (k is None, k or "")) for x in items], pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in old] + new, names=old + added)

        df = df.mapInArrow(run, base + ", n_words long, hit_spans array<array<long>>, hit_items array<string>, longest_match long")
    return df if "__text" in keep else df.drop("__text")


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the bytes from each span's first word to its last, and blanks that double up."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data.lower())]
    out, at = [], 0
    for first, last in spans:
        out.append(data[at : places[first][0]])
        at = places[last - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_match: int = WINDOW, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """Remove every run of hit words; drop a document of whose words more than ``max_coverage`` are hit.

    ``max_match`` is the window: matches of fewer words, unless they are whole
    items, stay. Documents without hits stay as they are, null texts too. The
    columns are those of ``docs``, with n_chars, where present, as the text is
    now.
    """
    found = matches(docs.withColumn("__row", F.struct(*[F.col(c) for c in docs.columns])).select("__row", F.col(text).alias("__t")), benchmark, ["__row", "__t"], "__t", max_match)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    found = found.where(hit <= max_coverage * F.col("n_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else without_spans(t, s) for t, s in zip(batch.column("__t").to_pylist(), batch.column("hit_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], names=["__row", "__t"])

    kind = docs.schema.simpleString()
    cleaned = found.select("__row", "__t", "hit_spans").mapInArrow(cut, f"__row {kind}, __t string")
    new = {text: F.col("__t")} | ({"n_chars": F.when(F.col("__t") != F.col(f"__row.{text}"), F.char_length("__t").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("__row.n_chars"))} if "n_chars" in docs.columns else {})
    return cleaned.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = matches(docs, benchmark, ["doc_id"])
    n = F.size("hit_items")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda k, s: k + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n.cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_sql() -> str:
    """The same over DuckDB: windows of items joined with the documents' words."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
    g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
    h AS (SELECT doc_id, item, g.n, i FROM g JOIN win ON g.n = win.n AND g.gram = win.gram),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""
