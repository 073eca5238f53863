"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

1. Documents are tokenised once and written with a lexical sketch (a min-hash of their token pairs).
2. Sorting by sketch puts related documents next to each other; ranges of about SHARD_TOKENS are
   shards, whatever the session's number of partitions, and a large group of equal documents may spread over several of them.
3. A shard gets one inverted BM25 index over the token ids of all its documents. A window starts with
   a seed (what the last window cut off, else the next unused document); all its terms
   retrieve unused neighbours, which fill the window best first. The document that
   reaches the end is cut there and its rest seeds the next window.
4. The last, short window of a shard is cut into sequences of a power of two, so nothing is padded.

Memory is bounded by a shard and its longest document. Each document is in one shard, hence each id in one piece.

Defined results: a null or empty text is its end token alone; equal documents, and rows that repeat a doc_id or have none, are packed like
others; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents_of, written
from .words import mixed

WINDOW = 2048
END = 1
SHARD_TOKENS = 3_000_000
K1, B = 1.2, 0.75
_TOKEN = np.dtype("<u4")


def _tokenised(path: str | None):
    def make():
        from .tokens import encoder

        encode = encoder(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed, lengths, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.array([*(encode(text) if text else ()), END], dtype=np.uint32)
                pairs = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:]
                sketches.append(int(mixed(pairs).min().view(np.int64)) if len(pairs) else 0)
                # Two bytes an id, as long as the vocabulary allows it.
                packed.append(ids.astype("<u2").tobytes() if int(ids.max()) < 65_536 else b"\x00" + ids.astype("<u4").tobytes())
                lengths.append(len(ids))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(sketches, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "sketch", "ids"])

        return one

    return make


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2") if len(raw) % 2 == 0 else np.frombuffer(raw, dtype="<u4", offset=1)


class Index:
    """BM25 over the documents of a shard: postings sorted by term, weights precomputed."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.float64)
        terms, counts = [], []
        for ids in docs:
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            counts.append(c)
        sizes = np.array([len(t) for t in terms])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        term, count, owner = np.concatenate(terms), np.concatenate(counts), np.repeat(np.arange(n, dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        self.distinct, self.first, self.df = np.unique(term[order], return_index=True, return_counts=True)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        at = np.searchsorted(self.distinct, term)
        norm = K1 * (1 - B + B * lengths[owner] / max(lengths.mean(), 1.0))
        self.owner, self.weight = owner[order].astype(np.int64), (idf[at] * count * (K1 + 1) / (count + norm))[order]
        self.term_of_doc = at
        # Terms of more than a quarter of the documents as full rows, which add up faster than postings: at most four numbers for each posting.
        frequent = np.flatnonzero(self.df * 4 > n)
        self.row = np.full(len(self.df), -1)
        self.row[frequent] = np.arange(len(frequent))
        held = np.flatnonzero(self.row[at[order]] >= 0)
        self.full = np.zeros((len(frequent), n), dtype=np.float32)
        self.full[self.row[at[order][held]], self.owner[held]] = self.weight[held]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct terms of ``doc``."""
        own = self.term_of_doc[self.starts[doc] : self.starts[doc + 1]]
        rows = self.row[own]
        own = own[(self.df[own] > 1) & (rows < 0)]
        size = self.df[own]
        at = np.repeat(self.first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[at], self.weight[at], minlength=len(self.starts) - 1) + self.full[rows[rows >= 0]].sum(axis=0, dtype=np.float32)

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``doc``, best first, ties by position."""
        scores = self.scores(doc)
        scores[used] = 0.0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


class Windows:
    """The open window of a shard; collects the pieces of closed ones."""

    def __init__(self, base: int, window: int):
        self.base, self.window, self.sequence, self.open, self.filled = base, window, 0, [], 0
        self.pieces: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Append what fits; returns where the rest starts."""
        length = min(self.window - self.filled, len(ids) - start)
        self.open.append((doc_id, start, ids[start : start + length], len(ids), self.filled))
        self.filled += length
        if self.filled == self.window:
            self.close()
        return start + length

    def close(self) -> None:
        for doc_id, start, ids, total, offset in self.open:
            self.pieces.append((doc_id, start, len(ids), zlib.crc32(ids.astype(_TOKEN).tobytes()), total, self.base + self.sequence, offset))
        self.sequence, self.open, self.filled = self.sequence + 1, [], 0

    def finish(self) -> None:
        """Cut the open window into sequences of a power of two."""
        rest, self.open, left, self.filled = self.open, [], self.filled, 0
        full = self.window
        for doc_id, start, ids, total, _ in rest:
            at = 0
            while at < len(ids):
                self.window = 1 << (left.bit_length() - 1) if not self.filled else self.window
                take = min(self.window - self.filled, len(ids) - at)
                self.open.append((doc_id, start + at, ids[at : at + take], total, self.filled))
                self.filled, at = self.filled + take, at + take
                if self.filled == self.window:
                    left -= self.window
                    self.close()
        self.window = full

    def taken(self) -> pa.RecordBatch | None:
        if not self.pieces:
            return None
        columns = list(zip(*self.pieces, strict=True))
        self.pieces = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def fill(ids: list, docs: list[np.ndarray], windows: Windows) -> None:
    """Pack one shard."""
    index, used = Index(docs), np.zeros(len(docs), dtype=bool)
    next_unused, seed, at = 0, None, 0
    while True:
        if seed is None:
            while next_unused < len(docs) and used[next_unused]:
                next_unused += 1
            if next_unused == len(docs):
                return
            seed, at = next_unused, 0
            used[seed] = True
        while seed is not None:  # windows of this seed alone, then its neighbours
            at = windows.put(ids[seed], docs[seed], at)
            if at == len(docs[seed]):
                last, seed = seed, None
        if not windows.filled:
            continue
        for near in index.neighbours(last, used):
            used[near] = True
            at = windows.put(ids[near], docs[near], 0)
            if at < len(docs[near]):
                seed = near
                break
            if not windows.filled:
                break


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId() << 36, window)
        ids: list = []
        docs: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            docs += [unpack_ids(raw.as_py()) for raw in batch.column(1)]
        if docs:
            fill(ids, docs, windows)
        windows.finish()
        if (out := windows.taken()) is not None:
            yield out

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``window`` is a power of two."""
    tokens = written(arrow_map(documents_of(docs), _tokenised(tokenizer_path), "doc_id long, n_tokens long, sketch long, ids binary"), "tokens", "zstd")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = tokens.select("sketch", "doc_id", "ids").repartitionByRange(shards, "sketch", "doc_id").sortWithinPartitions("sketch", "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(_pack(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
