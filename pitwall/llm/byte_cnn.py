"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it (a chunk starts where the last
filter position of the previous one ended, so no position is lost or seen twice). Learned byte
embeddings and FILTERS filters of WIDTH bytes run over each chunk, STRIDE bytes from place to place (every byte lies in WIDTH / STRIDE windows); each filter's outputs are max-pooled within
the chunk, and the chunks' values are combined by their maximum and their mean into a small
hidden layer and one probability. Low-variety text fires few filters, odd characters fire their own.

The network is fitted on at most TRAIN_DOCUMENTS labelled documents with whole texts (a documented bound: those
of smallest hash of doc_id), by Adam with hand-written gradients, on the driver, always with the same seed.
Labels of held-out documents are never read. Scoring covers all bytes of all documents.

Defined results: a null or empty text is one chunk of padding and has its fixed score; repeated texts have equal
scores; without labels of both kinds the score is the prior (0.5 without any); an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8_parts
from .kneser_ney import remainder

TRAIN_DOCUMENTS = 3000
CHUNK, WIDTH, STRIDE = 256, 6, 2
STEP = CHUNK - WIDTH + STRIDE
EMBEDDED, FILTERS, HIDDEN = 8, 48, 16
#: Passes over the training texts: about STEPS batches in all, within these limits.
EPOCHS, STEPS, BATCH, RATE = (10, 40), 1250, 24, 4e-3
PAD = 256
THRESHOLD = 0.7


@dataclass
class Network:
    embed: np.ndarray  # (257, EMBEDDED), the last row is padding and stays 0
    filters: np.ndarray  # (WIDTH * EMBEDDED, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (2 * FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (257, EMBEDDED))
        embed[PAD] = 0
        parts = embed, r.normal(0, 0.3, (WIDTH * EMBEDDED, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.15, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.3, HIDDEN), np.zeros(1)
        return cls(*(p.astype(np.float32) for p in parts))

    def parameters(self) -> list[np.ndarray]:
        return list(vars(self).values())


def chunks_of(texts: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) byte values, PAD behind a text's end, and the number of chunks of each text."""
    counts = np.array([max(1, -(-(len(t) - WIDTH + STRIDE) // STEP)) for t in texts], dtype=np.int64)
    out = np.full((counts.sum(), CHUNK), PAD, dtype=np.int16)
    row = 0
    for text, n in zip(texts, counts, strict=True):
        padded = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.int16)
        padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        out[row : row + n] = np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP * 2, 2))
        row += n
    return out, counts


def _windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    seen = net.embed[chunks].reshape(len(chunks), CHUNK * EMBEDDED)
    places = (CHUNK - WIDTH) // STRIDE + 1
    step = seen.strides[1]
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(seen, (len(chunks), places, WIDTH * EMBEDDED), (seen.strides[0], STRIDE * EMBEDDED * step, step)))


def pooled(net: Network, chunks: np.ndarray, block: int = 384) -> np.ndarray:
    """Each filter's maximum in each chunk."""
    out = np.empty((len(chunks), FILTERS), dtype=net.filters.dtype)
    for i in range(0, len(chunks), block):
        w = _windows(net, chunks[i : i + block])
        out[i : i + block] = (w.reshape(-1, WIDTH * EMBEDDED) @ net.filters).reshape(*w.shape[:2], FILTERS).max(axis=1)
    return np.maximum(out + net.bias, 0)


def combined(peaks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    return np.concatenate([np.maximum.reduceat(peaks, starts, axis=0), np.add.reduceat(peaks, starts, axis=0) / counts[:, None]], axis=1).astype(peaks.dtype)


def scores(net: Network, texts: list) -> np.ndarray:
    chunks, counts = chunks_of(texts)
    h = np.tanh(combined(pooled(net, chunks), counts) @ net.hidden + net.hidden_bias)
    return 1 / (1 + np.exp(-(h @ net.out + net.out_bias[0]).astype(np.float64)))


def _gradients(net: Network, texts: list, labels: np.ndarray) -> list[np.ndarray]:
    chunks, counts = chunks_of(texts)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    w = _windows(net, chunks)
    raw = (w.reshape(-1, WIDTH * EMBEDDED) @ net.filters).reshape(*w.shape[:2], FILTERS)
    place = raw.argmax(axis=1)
    peaks = np.maximum(np.take_along_axis(raw, place[:, None], axis=1)[:, 0] + net.bias, 0)
    x = combined(peaks, counts)
    h = np.tanh(x @ net.hidden + net.hidden_bias)
    p = 1 / (1 + np.exp(-(h @ net.out + net.out_bias[0])))
    dz = ((p - labels) / len(texts)).astype(net.filters.dtype)
    dh = dz[:, None] * net.out * (1 - h * h)
    dx = dh @ net.hidden.T
    # The mean's share goes to all chunks, the maximum's to the first chunk that has it.
    dpeak = dx[owner, FILTERS:] / counts[owner, None].astype(net.filters.dtype)
    top = peaks == x[owner, :FILTERS]
    rank = np.cumsum(top, axis=0)
    first = top & (rank - (rank[starts] - top[starts])[owner] == 1)
    dpeak += dx[owner, :FILTERS] * first
    dpeak *= peaks > 0
    chosen = w[np.arange(len(chunks))[:, None], place]  # (chunks, FILTERS, WIDTH * EMBEDDED)
    dfilters = np.einsum("cf,cfw->wf", dpeak, chosen, optimize=True)
    dwindow = dpeak[:, :, None] * net.filters.T[None]
    where = chunks[np.arange(len(chunks))[:, None, None], (place * STRIDE)[:, :, None] + np.arange(WIDTH)]
    flat = where.reshape(-1)
    dembed = np.stack([np.bincount(flat, dwindow.reshape(-1, EMBEDDED)[:, k], minlength=257) for k in range(EMBEDDED)], axis=1)
    dembed[PAD] = 0
    return [dembed, dfilters, dpeak.sum(axis=0), x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> Network:
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    labels = labels.astype(np.float32)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    net.out_bias[0] = np.log(share / (1 - share))
    if not len(labels) or labels.min() == labels.max():
        net.out[:] = 0
        return net
    order_by = np.array([len(t) for t in texts])
    first = [np.zeros_like(p, dtype=np.float64) for p in net.parameters()]
    second = [np.zeros_like(p, dtype=np.float64) for p in net.parameters()]
    epochs = epochs or min(EPOCHS[1], max(EPOCHS[0], STEPS * BATCH // len(texts)))
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        shuffled = r.permutation(len(texts))
        for i in range(0, len(texts), BATCH):
            part = shuffled[i : i + BATCH]
            # Very long texts go in runs of bounded size.
            for run in np.array_split(part, max(1, int(order_by[part].sum() // 400_000))):
                if not len(run):
                    continue
                step += 1
                rate = RATE * max(0.1, 1 - step / (1.1 * steps))
                for p, g, a, b in zip(net.parameters(), _gradients(net, [texts[k] for k in run], labels[run]), first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Network:
    """Fit on at most ``most`` of the labelled documents that are not held out."""
    named = labels.where("quality IS NOT NULL").where(remainder("doc_id", 4) != 2).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most TRAIN_DOCUMENTS rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], np.array([int(r["quality"]) for r in rows]))


def _score(net: Network):
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8_parts(batch.column(2))
            out = np.empty(batch.num_rows)
            lo = 0
            while lo < batch.num_rows:  # some MB of text at a time
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 2_000_000)) - 1)
                out[lo:hi] = scores(net, [data[a:b] for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)])
                lo = hi
            out = np.round(out, 5)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return one

    return make


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return arrow_map(texts, _score(net), "doc_id long, held_out boolean, score double, predicted int")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
