"""Exact substring deduplication after blockwise suffix sorting with a difference cover.

A byte goes if it lies in a LENGTH-byte string that also starts elsewhere in the table. Only suffixes compared to
LENGTH bytes matter, and whether they tie, so ranks are fingerprints of fixed depth: equal where suffixes tie.

1. Copies: documents with an equal text of LENGTH bytes or more go as a whole; one of each group stays in the corpus.
2. The other texts are joined into segments of some MB, written once to the shared folder.
3. Cover sample: positions whose remainder modulo PERIOD is in a difference cover COVER. Any two positions i, j
   have a shift d < PERIOD with i + d and j + d both sampled, so two equal LENGTH-byte strings contain equal
   sampled suffixes of depth LENGTH - PERIOD + 1. These are ranked, one bucket of fingerprints at
   a time; a sampled suffix that ties with no other is unique.
4. Suffix buckets: a suffix is a candidate only if a sampled suffix within its next PERIOD positions has a tie. Candidates
   are sorted to full depth, again one bucket at a time, so memory is bounded by a segment or a bucket.
5. A segment's ties come back as bits in the order in which it sent its suffixes; spans are formed and cut out there.

A fingerprint has 32 bits beside the bucket for the sample (a false tie only makes a candidate). For full depth
it has ``key_bytes`` (96 bits) beside the bucket: 48 of one polynomial, the others of a second with
its own letters. No byte is compared; with a tenth of the positions as candidates, less than 1e-8 wrong ties are expected on 100 GB.

Defined results: a null or empty text has no bytes; a row without a doc_id counts like any other; texts shorter than LENGTH lose nothing; matches
never cross documents but may overlap inside one; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, arrow_batches, discard, documents_of, utf8_parts, written
from .words import LETTERS as _LETTERS
from .words import Fingerprints, mixed

LENGTH = 200
PERIOD = 73
#: A perfect difference set: every remainder modulo 73 is a difference of two members.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
SEGMENT_BYTES = 3 << 20
#: Positions whose fingerprints are made at once.
BLOCK = 1 << 19
BITS_BROADCAST = 64 << 20
#: An Arrow batch for the workers holds few segments, and so do a file's row groups, whatever the partition's size.
BATCH_BYTES = 4 << 20
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Suffixes of a bucket that are sorted at once; larger buckets are dealt by a byte of the fingerprint.
SORTED = 1 << 20
_U = np.uint64
#: Of the second fingerprint.
_LETTERS2 = mixed(np.arange(1, 257, dtype=_U) * _U(0xE7037ED1A0B428DB))
KEY_BYTES = 12
#: Buckets follow the input up to 2 ** BUCKET_BITS of 8 MB of text each, 8 TB; beyond, buckets grow.
BUCKET_BITS = 20
#: Bytes of the first fingerprint that say something beside the bucket.
_FIRST_BYTES = 6


def _segments(most: int):
    def run(batches):
        ids, lengths, parts, size, made = [], [], [], 0, 0
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal ids, lengths, parts, size, made
            out = pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["segment", "doc_ids", "lengths", "body"],
            )
            ids, lengths, parts, size, made = [], [], [], 0, made + 1
            return out

        for batch in batches:
            data, at = utf8_parts(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                if size and size + b - a > most:
                    yield flush()
                ids.append(doc)
                lengths.append(int(b - a))
                parts.append(bytes(data[a:b]))
                size += int(b - a)
        if ids:
            yield flush()

    return run


class Segment:
    """One segment's suffixes: which are sampled, which are candidates, in the order in which they are sent.

    Fingerprints are made BLOCK positions at a time, so that memory follows the text and the suffixes that are sent.
    """

    def __init__(self, lengths: np.ndarray, body: np.ndarray, prints: Fingerprints, buckets: int, length: int = LENGTH):
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.body, self.buckets, self.length, self.prints = body, buckets, length, prints
        self.depth = length - PERIOD + 1
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def _blocks(self):
        """First position, and for each position of the block its document's start and the bytes left in the document."""
        for lo in range(0, len(self.body), BLOCK):
            hi = min(len(self.body), lo + BLOCK)
            a, b = np.searchsorted(self.ends, (lo, hi - 1), side="right")
            counts = np.minimum(self.ends[a : b + 1], hi) - np.maximum(self.starts[a : b + 1], lo)
            yield lo, np.repeat(self.starts[a : b + 1], counts), np.repeat(self.ends[a : b + 1], counts) - np.arange(lo, hi)

    def _prints(self, positions: np.ndarray, width: int, letters: np.ndarray = _LETTERS) -> np.ndarray:
        """Fingerprints of windows at positions in ascending order."""
        out = np.empty(len(positions), dtype=_U)
        for lo in range(0, len(self.body), BLOCK):
            i, j = np.searchsorted(positions, (lo, lo + BLOCK))
            if j > i:
                out[i:j] = self.prints.of(self.body[lo : lo + BLOCK + width], letters).at(positions[i:j] - lo, width)
        return out

    def _dealt(self, positions: np.ndarray, width: int):
        keys = self._prints(positions, width)
        bucket = (keys >> _U(65 - self.buckets.bit_length())).astype(np.int32)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        return positions[order], keys[order], bucket[order], order

    def sample(self):
        # The period must fit the longest tail: a sampled suffix within the last LENGTH bytes still has its depth.
        chosen = np.zeros(PERIOD, dtype=bool)
        chosen[list(COVER)] = True
        found = [(lo + np.flatnonzero(chosen[(np.arange(lo, lo + len(left)) - start) % PERIOD] & (left >= self.depth))).astype(np.int32) for lo, start, left in self._blocks()]
        return self._dealt(np.concatenate([np.zeros(0, np.int32), *found]), self.depth)

    def suffixes(self, sample_bits: dict) -> np.ndarray:
        """Positions of candidates, ascending."""
        positions, _, bucket, _ = self.sample()
        tied = positions[gathered(bucket, sample_bits)]
        # i is a candidate if a tied sample lies in [i, i + PERIOD): mark the PERIOD positions up to each one.
        marks = np.zeros(len(self.body) + 1, dtype=np.int32)
        np.add.at(marks, np.maximum(tied - PERIOD + 1, self.starts[np.searchsorted(self.ends, tied, side="right")]), 1)
        np.add.at(marks, tied + 1, -1)
        np.cumsum(marks, out=marks)
        found = [(lo + np.flatnonzero((marks[lo : lo + len(left)] > 0) & (left >= self.length))).astype(np.int32) for lo, _, left in self._blocks()]
        return np.concatenate([np.zeros(0, np.int32), *found])

    def candidates(self, sample_bits: dict):
        """Bucket and both fingerprints of every candidate."""
        positions = self.suffixes(sample_bits)
        second = self._prints(positions, self.length, _LETTERS2)
        _, keys, bucket, order = self._dealt(positions, self.length)
        return bucket, keys, second[order]

    def covered(self, sample_bits: dict, candidate_bits: dict) -> np.ndarray:
        positions, _, bucket, _ = self._dealt(self.suffixes(sample_bits), self.length)
        again = positions[gathered(bucket, candidate_bits)]
        marks = np.zeros(len(self.body) + 1, dtype=np.int32)
        marks[again] += 1
        np.subtract.at(marks, again + self.length, 1)
        return np.cumsum(marks[:-1], out=marks[:-1]) > 0


def _rows(batch: pa.RecordBatch, *bits: str):
    """(segment, doc_ids, lengths, body, bits by bucket for each name) row by row, the bodies where they lie in the batch."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        body = np.frombuffer(columns["body"][i].as_buffer(), dtype=np.uint8)
        found = [{x["bucket"]: x["bits"] for x in columns[name][i].as_py() or ()} for name in bits]
        yield columns["segment"][i].as_py(), columns["doc_ids"][i].values if "doc_ids" in columns else None, columns["lengths"][i].values.to_numpy(zero_copy_only=False), body, *found


def _bytes(keys: np.ndarray, most: int) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :most]


def full_keys(keys: np.ndarray, second: np.ndarray, key_bytes: int) -> np.ndarray:
    """(suffixes, key_bytes) bytes of both fingerprints, 14 at most."""
    return np.concatenate([_bytes(keys, _FIRST_BYTES), _bytes(second, 8)], axis=1)[:, :key_bytes]


def gathered(bucket: np.ndarray, bits: dict) -> np.ndarray:
    """Ties of suffixes in sending order from the bits of each bucket."""
    out = np.zeros(len(bucket), dtype=bool)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    for i, j in zip(cuts, cuts[1:], strict=False):
        packed = bits.get(int(bucket[i]))
        if packed is not None:
            out[i:j] = np.unpackbits(np.frombuffer(packed, np.uint8), count=j - i)
    return out


def _sent(buckets: int, length: int, key_bytes: int, full: bool):
    def run(batches):
        prints = Fingerprints()
        for batch in batches:
            for number, _, lengths, body, *bits in _rows(batch, *["sample_bits"] * full):
                segment = Segment(lengths, body, prints, buckets, length)
                if full:
                    bucket, keys, second = segment.candidates(*bits)
                    raw = full_keys(keys, second, key_bytes)
                else:
                    _, keys, bucket, _ = segment.sample()
                    raw = _bytes(keys, 4)
                if not len(keys):
                    continue
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                packed = [np.ascontiguousarray(raw[i:j]).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([number] * len(packed), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "segment", "packed"])

    return run


def _tied(raw: np.ndarray) -> np.ndarray:
    """Which rows of ``raw`` equal another one."""
    width = raw.shape[1]
    words = -(-width // 8)
    keys = np.zeros((len(raw), 8 * words), np.uint8)
    keys[:, :width] = raw
    keys = keys.view("<u8")
    order = np.lexsort(keys.T) if words > 1 else np.argsort(keys[:, 0], kind="stable")
    keys = keys[order]
    same = (keys[1:] == keys[:-1]).all(axis=1)
    tied = np.zeros(len(keys), dtype=bool)
    tied[order[1:]] = same
    tied[order[:-1]] |= same
    return tied


def _ties(width: int):
    """Sort one bucket; say for every segment which of its suffixes tie. Only segments with a tie get a row."""

    def reduce(rows: pa.Table) -> pa.Table:
        chunks = [c.cast(pa.large_binary()) for c in rows.column("packed").chunks]
        raw = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(c.buffers()[2] or b"", np.uint8)[o[0] : o[-1]] for c in chunks for o in [_offsets(c)])]).reshape(-1, width)
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(_offsets(c)) for c in chunks)]) // width
        if len(raw) <= SORTED:
            tied = _tied(raw)
        else:
            tied = np.zeros(len(raw), dtype=bool)
            for part in range(16):
                at = np.flatnonzero(raw[:, 0] & 15 == part)
                tied[at] = _tied(raw[at])
        ends = np.cumsum(sizes)
        out = [(s, b, np.packbits(tied[i:j]).tobytes()) for s, b, i, j in zip(rows.column("segment").to_pylist(), rows.column("bucket").to_pylist(), ends - sizes, ends, strict=True) if tied[i:j].any()]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"segment": pa.array(columns[0], pa.int64()), "bucket": pa.array(columns[1], pa.int32()), "bits": pa.array(columns[2], pa.binary())})

    return reduce


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def _returned(ties: DataFrame, name: str) -> DataFrame:
    """Bits of a segment in one row, broadcast if measured to be small."""
    ties = written(ties, name)
    by_segment = ties.groupBy("segment").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    size = ties.agg(F.sum(F.octet_length("bits") + 48)).first()[0] or 0
    # Beyond the bound segments are dealt to the bits, and only bits are held: sorting would hold the bodies.
    return F.broadcast(by_segment) if size <= BITS_BROADCAST else by_segment.hint("shuffle_hash")


def _cut_out(buckets: int, length: int):
    def run(batches):
        prints = Fingerprints()
        for batch in batches:
            for _, ids, lengths, body, *bits in _rows(batch, "sample_bits", "full_bits"):
                segment = Segment(lengths, body, prints, buckets, length)
                gone = segment.covered(*bits)
                removed, spans, shas = [], [], []
                for start, n in zip(segment.starts, segment.lengths, strict=True):
                    own = gone[start : start + n]
                    removed.append(int(own.sum()))
                    spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                    shas.append(hashlib.sha256(segment.body[start : start + n][~own].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([ids, pa.array(segment.lengths), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_substrings(docs: DataFrame, length: int = LENGTH, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    texts = documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    info = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text"), 256)).alias("sha")), "texts")
    able = info.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
    # Hashes of texts that occur twice; broadcast if they are few, so that no task gets all copies of one text.
    groups = written(able.groupBy("sha").agg(F.min("doc_id").alias("stays"), F.count("*").alias("n")).where("n > 1"), "groups")
    copies = written(able.join(F.broadcast(groups) if groups.count() <= BROADCAST_KEYS // 4 else groups, "sha").select("doc_id", "n_bytes", "stays"), "copies")
    absent = copies.where("doc_id <> stays").select("doc_id")
    absent = F.broadcast(absent) if copies.count() <= BROADCAST_KEYS else absent
    segments = written(texts.join(absent, "doc_id", "left_anti").mapInArrow(_segments(SEGMENT_BYTES), "segment long, doc_ids array<long>, lengths array<long>, body binary"), "segments", "zstd", **ROW_GROUPS)

    size = info.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 << min(BUCKET_BITS, max(5, int(np.ceil(np.log2(1 + size / (8 << 20))))))
    sent = "bucket int, segment long, packed binary"
    tied = "segment long, bucket int, bits binary"
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        sample = segments.select("segment", "lengths", "body").mapInArrow(_sent(buckets, length, key_bytes, False), sent)
        sample_bits = _returned(sample.groupBy("bucket").applyInArrow(_ties(4), tied), "sample_bits")
        full = segments.select("segment", "lengths", "body").join(sample_bits, "segment", "left").mapInArrow(_sent(buckets, length, key_bytes, True), sent)
        full_bits = _returned(full.groupBy("bucket").applyInArrow(_ties(key_bytes), tied), "full_bits")
        cut = written(segments.join(sample_bits, "segment", "left").join(full_bits, "segment", "left").mapInArrow(_cut_out(buckets, length), result), "cut")
    discard(segments)
    whole = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    stays = copies.where("doc_id = stays").select("doc_id")
    return cut.join(stays, "doc_id", "left_anti").unionByName(whole)


def op5(spark, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
