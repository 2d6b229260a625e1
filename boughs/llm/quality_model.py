"""A byte-level convolutional network, in numpy, that tells good documents from bad.

Bytes are embedded; learned filters run over overlapping chunks that cover the
whole document; each filter's maximum over a chunk is what the chunk is known by;
a linear layer turns it into the chunk's evidence, and the mean evidence of all
chunks gives the document's one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

CHUNK, HOP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 6, 24
PAD = 256
#: Training takes at most so many labelled documents of each class, and so many chunks spread over each.
SAMPLE, CHUNKS = 2000, 12
#: A step sees so many documents, half of each class, and so many chunks of each, drawn anew.
STEPS, BATCH, DRAWN, RATE = 800, 32, 4, 0.01
#: This share of the chunks is cut short in training.
SHORT = 0.3


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes start: each HOP bytes, to the end; one for an empty text."""
    return np.arange(0, max(1, n - (CHUNK - HOP)), HOP)


def chunked(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The chunks as rows of CHUNK symbols; what lies past the end is PAD."""
    need = int(starts[-1]) + CHUNK
    padded = np.full(need, PAD, np.uint16)
    padded[: min(len(data), need)] = np.frombuffer(data, np.uint8)[:need]
    return padded[starts[:, None] + np.arange(CHUNK)]


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # FILTERS
    offset: float

    @staticmethod
    def fresh(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        return Network(embed, filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED), as a view where it can be."""
        e = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.ascontiguousarray(view)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over each chunk, rectified, and its place."""
        win = self.windows(chunks)
        out = win.reshape(-1, WIDTH * EMBED) @ self.filters
        out = out.reshape(len(chunks), -1, FILTERS)
        at = out.argmax(axis=1)
        top = np.take_along_axis(out, at[:, None], axis=1)[:, 0] + self.bias
        return np.maximum(top, 0), at

    def evidence(self, chunks: np.ndarray) -> np.ndarray:
        """One figure per chunk, made in slices of bounded size."""
        return np.concatenate([self.pooled(chunks[i : i + 64])[0] @ self.head for i in range(0, len(chunks), 64)])

    def probability(self, texts: list[str]) -> np.ndarray:
        """Of label 1, per text, from all of its bytes."""
        out = np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush() -> None:
            if held:
                np.add.at(out, np.concatenate(owner), self.evidence(np.concatenate(held)).astype(np.float64))

        counts = np.ones(len(texts))
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass")
            starts = chunk_starts(len(data))
            counts[i] = len(starts)
            for j in range(0, len(starts), 256):
                part = starts[j : j + 256]
                held.append(chunked(data[part[0] : part[-1] + CHUNK], part - part[0]))
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= 256:
                    flush()
                    held, owner, size = [], [], 0
        flush()
        return 1 / (1 + np.exp(-np.clip(out / counts + self.offset, -500, 500)))


def gradients(net: Network, offset: float, chunks: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross entropy of documents, each of the same number of chunks in a row, and its gradient by every parameter."""
    per = len(chunks) // len(labels)
    win = net.windows(chunks)
    out = (win.reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(chunks), -1, FILTERS)
    at = out.argmax(axis=1)
    top = np.take_along_axis(out, at[:, None], axis=1)[:, 0] + net.bias
    pooled = np.maximum(top, 0)
    logit = (pooled @ net.head).reshape(-1, per).mean(axis=1) + offset
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    wrong = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) / len(labels)
    each = np.repeat(wrong / per, per).astype(out.dtype)
    back = each[:, None] * net.head[None] * (top > 0)
    best = win[np.arange(len(chunks))[:, None], at]  # (chunks, FILTERS, WIDTH * EMBED)
    symbols = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
    embed = np.zeros_like(net.embed)
    np.add.at(embed, symbols.reshape(-1), (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED))
    return loss, {"head": pooled.T @ each, "offset": np.array([wrong.sum()], out.dtype), "bias": back.sum(axis=0), "filters": np.einsum("nf,nfw->wf", back, best), "embed": embed}


def train(samples: list[tuple[np.ndarray, int]], odds: float = 1.0, seed: int = 0) -> Network:
    """Fit by Adam on (chunks of a document, label); ``odds`` of label 1 to 0 among all labelled documents.

    Each step draws documents of both classes alike and ``DRAWN`` chunks of each,
    and cuts a share of the chunks short, of both classes alike, as short texts
    are rare. The sample may be balanced otherwise, so the last offset is moved
    by the difference. Without documents of both classes every score is 1/2.
    """
    net = Network.fresh(seed)
    labels = np.array([y for _, y in samples], np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.head[:] = 0
        return net
    rng = np.random.default_rng(seed + 1)
    by_class = [np.nonzero(labels == k)[0] for k in (0, 1)]
    params = {"embed": net.embed, "filters": net.filters, "bias": net.bias, "head": net.head, "offset": np.zeros(1, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(ix, BATCH // 2) for ix in by_class])
        chunks = np.concatenate([samples[i][0][rng.permutation(max(DRAWN, len(samples[i][0])))[:DRAWN] % len(samples[i][0])] for i in rows])
        cut = np.where(rng.random(len(chunks)) < SHORT, np.exp(rng.uniform(np.log(8), np.log(CHUNK), len(chunks))), CHUNK)
        chunks = np.where(np.arange(CHUNK) < cut[:, None], chunks, np.uint16(PAD))
        _, grads = gradients(net, float(params["offset"][0]), chunks, labels[rows])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, p in params.items():
            m, v = moments[k]
            g = grads[k] + 1e-4 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    drawn = len(by_class[1]) / len(by_class[0])  # the batches are balanced, whatever the sample is
    net.offset = float(params["offset"][0] + np.log(odds if odds > 0 else drawn))
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, chunks: int = CHUNKS, seed: int = 0, text: str = "text") -> Network:
    """Train on at most ``sample`` documents of each class, the first by a hash of their ids, and ``chunks`` chunks of each.

    The chunks are spread evenly over a longer text; these two bounds are what
    the driver holds. ``labels`` has doc_id and the label, and only rows that may
    be learned from. Rows with a null or another label are left out; null texts
    are empty; a repeated id counts as often as it is there. Without labels of
    both classes every score is 1/2.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("__y"))
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.where("__y = 0").orderBy(order).limit(sample).unionByName(known.where("__y = 1").orderBy(order).limit(sample))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for t in batch.column("text").to_pylist():
                data = t.encode("utf-8", "surrogatepass")
                starts = chunk_starts(len(data))
                starts = np.unique(starts[np.linspace(0, len(starts) - 1, chunks).round().astype(int)])
                parts = [data[a : a + CHUNK] for a in starts.tolist()]
                found.append(b"".join(parts))
                sizes.append([len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__y"), pa.array(found, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], names=["doc_id", "y", "chunks", "sizes"])

    # At most two samples of ids, a bound that doesn't grow with the data.
    rows = docs.select("doc_id", text_or_empty(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.mapInArrow(spread, "doc_id long, y int, chunks binary, sizes array<int>").toPandas().sort_values(["doc_id", "y", "chunks"])

    def stacked(data: bytes, sizes: list[int]) -> np.ndarray:
        out, at = np.full((len(sizes), CHUNK), PAD, np.uint16), 0
        for row, size in zip(out, sizes, strict=True):
            row[:size] = np.frombuffer(data, np.uint8, size, at)
            at += size
        return out

    samples = [(stacked(c, z), int(y)) for c, z, y in zip(got["chunks"], got["sizes"], got["y"], strict=True)]
    return train(samples, n.get(1, 0) / n[0] if n.get(0) else 1.0, seed)


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (double, 0 to 1) and predicted (1 where score >= 0.5) to the columns ``keep`` of all documents.

    Null and empty texts are scored as a chunk of padding. Input columns with
    the added names are replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows = docs.select(*keep, text_or_empty(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 20 KB, whatever the data

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "__text"]
            p = shared.value.probability(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(judge, (kinds + ", " if kinds else "") + "score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """The rows no label is learned from: remainder 1 of 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1
