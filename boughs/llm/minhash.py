"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in each of the first T rounds every shingle is thrown into one of T bins,
in the next T rounds all shingles go to one bin each; a bin keeps its least
(round, value), and the throwing ends once all bins are full. So every coordinate
fills, and two sets agree in a coordinate with their Jaccard similarity as
probability, with the concentration of T independent draws.

Banding: documents that agree in all coordinates of a band are candidates. With
40 bands of 6 a pair at similarity 0.8 is missed with probability 5e-6.

Verification: no bucket is capped and no large one emits all its pairs. Buckets
whose documents are known to be one component are done. In the others a document
or so, chosen by a hash, is a hub, which is compared with all others, first in a
few bands, then in all. In what large buckets are then not one component, parts
of bounded size are compared as a whole, by matrix products of their sets. So
each pair of a bucket is either compared on full sets or connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash, small_batches, text_or_empty
from .hashing import U, WordHashes, mix, shingles

BANDS, ROWS = 40, 6
#: Bands that are compared first, with one hub a bucket: they connect most of every large group.
FIRST_BANDS = 8
#: Buckets of so many documents are compared pair by pair, larger ones in parts of about so many.
SMALL, PART = 32, 512
#: Members of a large bucket that one task joins with what is known of the bucket, about.
SPREAD = 256
#: Shingles that are compared at once.
STRIP = 2048

_seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) * U(0xD1342543DE82EF95))


def sketch(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` coordinates per set; of an empty set all ones."""
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, U)
    flat = out.reshape(-1)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    seeds = _seeds if len(_seeds) == 2 * size else mix(np.arange(1, 2 * size + 1, dtype=U) * U(0xD1342543DE82EF95))
    x, owner = None, None
    for r in range(2 * size):
        if not len(todo):
            break
        if x is None:
            x = np.concatenate([sets[i] for i in todo])
            owner = np.repeat(todo, [len(sets[i]) for i in todo])
        h = mix(x ^ seeds[r])
        value = (h & U(0xFFFFFFFF)) | (U(r) << U(32))
        place = ((h >> U(32)) * U(size) >> U(32)).astype(np.int64) if r < size else np.full(len(x), r - size)
        np.minimum.at(flat, owner * size + place, value)
        open_ = (out[todo] == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.all():
            todo, x = todo[open_], None
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per set and band; its lowest 8 bits are the band's number."""
    s = sketches.reshape(len(sketches), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=U), s.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + s[:, :, j])
    return ((h & ~U(255)) | np.arange(bands, dtype=U)).view(np.int64)


def _words(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: exactly A-Z, blank and tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes.of(_words(t)), k) for t in batch.column("text").to_pylist()]
            keys = band_keys(sketch(sets))
            full = [bool(len(s)) for s in sets]
            lists = pa.array([row.tolist() if ok else None for row, ok in zip(keys, full, strict=True)], pa.list_(pa.int64()))
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, full, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), same, lists], names=["doc_id", "n", "same", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes.of(_words(t)), k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _verified(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similarity * (len(p) + len(q) - common))
            picked = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(picked) for c in ("la", "lb")], names=["a", "b"])

    return run


def _blocks_verified(similarity: int):
    """All pairs of two parts of a bucket, or of one part, that have unlike labels, on full sets."""

    def run(table: pa.Table) -> pa.Table:
        part = np.array(table.column("part").to_pylist())
        label = np.array(table.column("label").to_pylist(), np.int64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, cols = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links: set[tuple[int, int]] = set()
        if len(rows) and len(cols) and len(np.unique(label)) > 1:
            sets = [np.frombuffer(x, U) for x in table.column("set").to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            known, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), size)
            common = np.zeros((len(rows), len(cols)), np.float32)
            # A strip of shingles at a time, so memory stays the same for long texts.
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(0, len(known) + STRIP, STRIP))
            for k in range(len(edges) - 1):
                at = order[edges[k] : edges[k + 1]]
                strip = np.zeros((len(sets), STRIP), np.float32)
                strip[owner[at], place[at] - k * STRIP] = 1
                common += strip[rows] @ strip[cols].T
            common = common.astype(np.int64)
            either = size[rows][:, None] + size[cols][None] - common
            x, y = np.nonzero((100 * common >= similarity * either) & (label[rows][:, None] != label[cols][None]))
            found = np.stack([label[rows][x], label[cols][y]], axis=1)
            links = set(map(tuple, np.unique(np.sort(found, axis=1), axis=0).tolist()))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def components(edges: DataFrame, stash: Stash, name: str) -> DataFrame:
    """(node, label): the least node each node of the edges (a, b) is connected with.

    Large-star and small-star operations in turn until nothing changes, which
    takes about log2 of a component's diameter rounds. Minima are combined
    before each shuffle, and the joins are on keys that Spark can split.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, turn = None, 0
    while True:
        # Large star: every neighbour above u is tied to the least of u's neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its lower neighbours are tied to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = stash.keep(tied.select("e.*").where("u <> v").distinct(), f"{name}-{turn}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if turn:
            stash.drop(f"{name}-{turn - 1}")
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before, turn = now, turn + 1


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. Two
    documents are linked if ``100 * |A & B| >= similarity * |A | B|`` for their
    sets of ``shingle`` consecutive words; component_id is the least doc_id that
    links lead to, kept whether that is the document's own. Null and empty texts
    have empty sets and are linked with nothing. Rows with one doc_id are one
    document, which has the links of all of them. Null doc_ids are linked with
    nothing, have a null component_id and are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stash = Stash(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    all_ = stash.keep(rows.mapInArrow(_sketched(shingle), "doc_id long, n long, same binary, bands array<long>"), "sketches")

    # Equal sets are one node, the least of their doc_ids.
    linked = all_.where("n > 0 and doc_id is not null")
    nodes = linked.groupBy("same").agg(F.min("doc_id").alias("node"))
    placed = stash.keep(linked.select("doc_id", "n", "same", "bands").join(nodes, "same").select("doc_id", "n", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")), "placed")
    members = placed.where("bands is not null").select("node", "n", F.explode("bands").alias("key")).distinct()
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    draw = (F.xxhash64("node", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) * F.col("size")
    members = stash.keep(members.join(sizes, "key").select("key", "node", "n", "size", draw.alias("draw")), "members")

    # One document may carry several sets, if its id is repeated.
    ids = members.select("node").distinct()
    wanted = rows.join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = stash.keep(wanted.mapInArrow(_sets(shingle), "node long, set binary").distinct(), "sets")

    labels = own = ids.withColumn("label", F.col("node"))
    twice = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").limit(1)
    if twice.count():
        # A repeated id ties the nodes of its rows together, those that share no bucket too.
        merged = components(placed.select(F.col("doc_id").alias("a"), F.col("node").alias("b")), stash, "repeated")
        labels = _relabelled(placed.select("node").distinct().withColumn("label", F.col("node")), merged)
        labels = stash.keep(labels, "labels-repeated")

    for turn in range(3):
        now = members.join(labels, "node")
        if turn == 0:
            now = now.where(F.pmod(F.col("key"), F.lit(256)) < FIRST_BANDS)
        elif turn == 2:
            now = now.where(F.col("size") > SMALL)
        unlike = now.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("size").alias("size")).where("l0 <> l1").select("key", "size")
        # A large bucket's members are joined in groups of about SPREAD, so no task gets them all.
        now = now.withColumn("group", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("size") / SPREAD)).cast("int"))
        now = stash.keep(now.join(_for_each_group(unlike).drop("size"), ["key", "group"]), f"open-{turn}")
        if turn < 2:
            every = F.lit(False) if turn == 0 else F.col("size") <= SMALL
            hubs = now.where(every | (F.col("draw") < 1)).select("key", F.col("node").alias("hub"), F.col("n").alias("hn"), F.col("draw").alias("hdraw"), F.col("label").alias("la"), "size")
            hubs = _for_each_group(hubs).drop("size")
            later = (F.col("draw") > F.col("hdraw")) | ((F.col("draw") == F.col("hdraw")) & (F.col("node") > F.col("hub")))
            near = (100 * F.least("n", "hn") >= similarity * F.greatest("n", "hn")) & (F.col("label") != F.col("la")) & later
            pairs = now.join(hubs, ["key", "group"]).where(near).select("hub", "node", "la", F.col("label").alias("lb")).distinct()
            found = pairs.join(sets.select("node", F.col("set").alias("x")), "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("y")), "hub").select("la", "lb", "x", "y").mapInArrow(_verified(similarity), "a long, b long")
        else:
            parts = F.ceil(F.col("size") / PART).cast("int")
            placed_in = now.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(sets, "node")
            dealt = placed_in.select("key", "label", "set", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part"), "label", "set")
            found = dealt.groupBy("key", "i", "j").applyInArrow(_blocks_verified(similarity), "a long, b long")
        found = stash.keep(found.distinct(), f"links-{turn}")
        if not found.isEmpty():
            labels = stash.keep(_relabelled(labels, components(found, stash, f"components-{turn}")), f"labels-{turn}")

    if labels is own:  # nothing is linked
        labels = placed.select("node").distinct().withColumn("label", F.col("node"))
    # What follows reads the nodes and their labels alone.
    stash.drop("members", "sets", *(f"{name}-{turn}" for name in ("open", "links") for turn in range(3)))
    final = placed.select("doc_id", "n", "node").join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("component_id"))
    alone = all_.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    empty = all_.where("n = 0 and doc_id is not null").select("doc_id")
    if placed.join(empty, "doc_id", "left_semi").limit(1).count():
        # A row without words has the links of the other rows of its id.
        linked_to = final.groupBy("doc_id").agg(F.min("component_id").alias("to"))
        alone = alone.join(linked_to, "doc_id", "left").select("doc_id", "n", F.coalesce("to", "component_id").alias("component_id"))
    out = final.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _for_each_group(rows: DataFrame) -> DataFrame:
    """Rows about a bucket of ``size`` members, one for each of its groups; small buckets are one group."""
    return rows.withColumn("group", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / SPREAD) - 1).cast("int"))))


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after their components have been merged."""
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("__to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("__to", "label").alias("label"))


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: int = 80, text: str = "text") -> DataFrame:
    """The documents with one of each group of near-duplicates, that of the least doc_id; columns as in ``docs``.

    Of rows that share a doc_id, and of which one has words, one stays: that with
    the least text by code points, then by the other columns that have an order.
    Documents without words, and rows without doc_id, all stay.
    """
    found = near_duplicates(docs, shingle, similarity, text)
    keep = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__id"), (F.col("n_shingles") > 0).alias("__full"))
    once = keep.groupBy("__id").agg(F.max("__full").alias("__full"), F.count(F.lit(1)).alias("__rows"))
    joined = docs.join(once, docs["doc_id"] == F.col("__id"))
    single = joined.where("__rows = 1 or not __full").select(*docs.columns)
    # A text without words comes after all that have some.
    none = F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")) < 1
    order = [F.coalesce(none, F.lit(True)), F.col(text), *[F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]]
    first = F.row_number().over(Window.partitionBy("__id").orderBy(*order))
    several = joined.where("__rows > 1 and __full").withColumn("__first", first).where("__first = 1").select(*docs.columns)
    return single.unionByName(several).unionByName(docs.where("doc_id is null"))


def op1_sql() -> str:
    """The same over DuckDB, with every pair that shares a shingle compared."""
    return """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
    SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""
