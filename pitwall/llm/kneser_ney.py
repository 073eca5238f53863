"""Interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting (order N, words as 64-bit hashes, N - 1 start marks before and one end token after each text):

* A map task gathers the N-grams of many texts, sorts them, and sends each distinct one with its
  count, packed by ranges of the N-gram's hash. Frequent words don't gather anywhere: a bucket holds a range of hashes.
* The task of a bucket adds the counts and writes the sorted hashes and their counts to the shared
  folder. It passes on partial sums for contexts (total, and how many N-grams have count 1, 2 and
  3 or more) and for the next lower order (distinct left words, occurrences), already summed within the bucket.
* The same happens with continuation counts at each lower order, down to single words, where the occurrences are the plain word counts.

Scoring maps the arrays of all buckets and looks up a batch's sorted hashes; a worker holds
no more of the model than the pages it touches.

Only counts of counts, totals and discounts come to the driver; the arrays grow with the corpus.

Defined results: a null or empty text is its end token alone; equal texts have equal
scores; with nothing to learn from every token has probability 1; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import arrow_map, scratch_path, utf8_parts, written
from .words import TextWords, mixed

ORDER = 2
_U = np.uint64
START, END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
#: N-grams that a map task gathers before it sorts them.
GATHERED = 3_000_000


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of the rows of (n, order) word hashes; a single word's hash is mixed, too."""
    out = np.full(len(words), words.shape[1], dtype=_U)
    for k in range(words.shape[1]):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + words[:, k])
    return out


def _dtype(order: int) -> np.dtype:
    """n: the order's own count (occurrences at the highest, left words below); raw: occurrences."""
    return np.dtype([("w", "<u8", (order,)), ("n", "<u8"), ("raw", "<u8")])


_CONTEXT = np.dtype([("key", "<u8"), ("total", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the index of one row of each, and the values' sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def ranges(buckets: int):
    """Bucket of a hash: ranges of equal width, so that buckets in order are sorted as a whole."""
    shift = _U(64 - (buckets.bit_length() - 1))
    return lambda keys: (keys >> shift).astype(np.int32)


def token_hashes(words: np.ndarray, order: int) -> np.ndarray:
    out = np.empty(len(words) + order, dtype=_U)
    out[: order - 1] = START
    out[order - 1 : -1] = words
    out[-1] = END
    return out


def grams_of(tokens: np.ndarray, order: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(tokens, order)


def _count(order: int, buckets: int):
    def run(batches):
        words, packer, bucket = TextWords(), blobs.Packer(buckets), ranges(buckets)
        held, size = [], 0

        def counted():
            grams = np.concatenate(held)
            keys, at, (n,) = _summed(gram_hash(grams), np.ones(len(grams), dtype=_U))
            # A count takes one byte; a larger one is spread over several records.
            copies = ((n + _U(254)) // _U(255)).astype(np.int64)
            records = np.empty(int(copies.sum()), dtype=_packed(order))
            records["w"], records["n"] = np.repeat(grams[at], copies, axis=0), 255
            records["n"][np.cumsum(copies) - 1] = n - (copies.astype(_U) - _U(1)) * _U(255)
            return np.repeat(bucket(keys), copies), records

        for batch in batches:
            data, at = utf8_parts(batch.column(0))
            for _, hashes in words.each(data, at):
                grams = grams_of(token_hashes(hashes, order), order)
                held.append(grams)
                size += len(grams)
                if size >= GATHERED:
                    yield from packer.add(*counted())
                    held, size = [], 0
        if held:
            yield from packer.add(*counted())
        yield from packer.flush()

    return run


def _packed(order: int) -> np.dtype:
    return np.dtype([("w", "<u8", (order,)), ("n", "u1")])


def _write(folder: str, name: str, *columns: np.ndarray) -> None:
    """One file of consecutive arrays, complete or absent, so that a repeated task does no harm."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.array([len(columns[0])], dtype="<u8").tobytes())
        for column in columns:
            out.write(np.ascontiguousarray(column).data)
    store.move(part, f"{root}/{name}")


def _reduce(order: int, top: bool, folder: str, buckets: int):
    """Sum a bucket of N-grams; write its arrays; pass on contexts (kind 1), lower order (2) and totals (0)."""
    bucket = ranges(buckets)

    def reduce(records: np.ndarray) -> pa.Table:
        raw = records["n"].astype(_U) if top else records["raw"]
        keys, at, (n, raw) = _summed(gram_hash(records["w"]), records["n"].astype(_U), raw)
        words = records["w"][at]
        number = int(bucket(keys[:1])[0])
        _write(folder, f"grams{order}-{number}", keys, np.minimum(n, _U(0xFFFFFFFF)).astype("<u4"), *([raw] if order == 1 else []))
        ones = [(n == _U(k)).sum() for k in (1, 2, 3, 4)]
        out = [(0, 0, np.array([*ones, len(n), n.sum(), raw.sum()], dtype="<u8").tobytes())]
        if order > 1:
            ctx, _, sums = _summed(gram_hash(words[:, :-1]), n, (n == 1).astype(_U), (n == 2).astype(_U), (n > 2).astype(_U))
            context = np.empty(len(ctx), dtype=_CONTEXT)
            for name, column in zip(_CONTEXT.names, (ctx, *sums), strict=True):
                context[name] = column
            low, at, (left, raw) = _summed(gram_hash(words[:, 1:]), np.ones(len(words), dtype=_U), raw)
            lower = np.empty(len(low), dtype=_dtype(order - 1))
            lower["w"], lower["n"], lower["raw"] = words[at][:, 1:], left, raw
            for kind, key, rows in ((1, ctx, context), (2, low, lower)):
                cuts = np.searchsorted(bucket(key), np.arange(buckets + 1))
                out += [(kind, b, rows[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        kind, to, packed = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(to, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return reduce


def _contexts(order: int, folder: str, buckets: int):
    def reduce(records: np.ndarray) -> pa.Table:
        keys, _, sums = _summed(records["key"], *(records[name] for name in _CONTEXT.names[1:]))
        _write(folder, f"contexts{order}-{int(ranges(buckets)(keys[:1])[0])}", keys, *sums)
        return pa.table({"bucket": pa.array([len(keys)], pa.int32())})

    return reduce


@dataclass
class Model:
    """What scoring needs besides the arrays."""

    folder: str
    order: int
    buckets: int
    discounts: dict = field(default_factory=dict)
    total: float = 0.0
    types: int = 0
    train_tokens: int = 0


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; where these are too thin, the usual halves."""
    if not (n1 and n2):
        return (0.5, 0.75, 1.0)
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), (d1, d2, d3), strict=True))


def train(texts: DataFrame, order: int = ORDER, buckets: int | None = None) -> Model:
    """Count the column ``text``. ``buckets`` is a power of two; by default it follows the input's size."""
    spark = texts.sparkSession
    if buckets is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = 1 << max(4, math.ceil(math.log2(1 + size / (8 << 20))))
    model = Model(scratch_path(spark, "kneser-ney"), order, buckets)
    packed = texts.select("text").mapInArrow(_count(order, buckets), blobs.SCHEMA)
    for k in range(order, 0, -1):
        dtype = _packed(order) if k == order else _dtype(k)
        passed = written(blobs.by_bucket(packed, dtype, _reduce(k, k == order, model.folder, buckets), "kind int, bucket int, packed binary"), f"order{k}", "zstd")
        sums = np.zeros(7, dtype=object)
        for row in passed.where("kind = 0").select("packed").toLocalIterator():  # 56 bytes a bucket
            sums += np.frombuffer(row[0], dtype="<u8").astype(object)
        model.discounts[k] = discounts(*(int(x) for x in sums[:4]))
        if k == 1:
            model.types, model.total, model.train_tokens = int(sums[4]), float(sums[5]), int(sums[6])
            d, n1, n2 = model.discounts[1], int(sums[0]), int(sums[1])
            model.discounts[0] = (d[0] * n1 + d[1] * n2 + d[2] * (model.types - n1 - n2)) / model.total if model.total else 1.0
        else:
            blobs.by_bucket(passed.where("kind = 1").select("bucket", "packed"), _CONTEXT, _contexts(k, model.folder, buckets), "bucket int").write.format("noop").mode("overwrite").save()
            packed = passed.where("kind = 2").select("bucket", "packed")
    return model


class Arrays:
    """Sorted arrays of all buckets of one kind, mapped from the shared folder when first needed.

    In a store that cannot be mapped a bucket is read as a whole, and only the last HELD ones are kept.
    """

    HELD = 16

    def __init__(self, model: Model, name: str, *dtypes: str):
        self.model, self.name, self.dtypes, self.open = model, name, dtypes, {}
        self.bucket = ranges(model.buckets)

    def _map(self, number: int):
        from pyarrow import fs

        if number in self.open:
            return self.open[number]
        store, root = fs.FileSystem.from_uri(self.model.folder)
        path, arrays = f"{root}/{self.name}-{number}", None
        if store.get_file_info(path).type != fs.FileType.NotFound:
            if isinstance(store, fs.LocalFileSystem):
                raw = np.memmap(path, dtype=np.uint8, mode="r")
            else:
                with store.open_input_stream(path) as source:
                    raw = np.frombuffer(source.read(), dtype=np.uint8)
                if len(self.open) >= self.HELD:
                    self.open.pop(next(iter(self.open)))
            n, at, arrays = int(raw[:8].view("<u8")[0]), 8, []
            for dtype in ("<u8", *self.dtypes):
                size = n * np.dtype(dtype).itemsize
                arrays.append(raw[at : at + size].view(dtype))
                at += size
        self.open[number] = arrays
        return arrays

    def look_up(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of sorted ``keys``; 0 where a key is absent."""
        out = [np.zeros(len(keys), dtype=d) for d in self.dtypes]
        numbers = self.bucket(keys)
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if i < j and (arrays := self._map(int(numbers[i]))) is not None:
                at = np.searchsorted(arrays[0], keys[i:j])
                at[at == len(arrays[0])] = 0
                hit = arrays[0][at] == keys[i:j]
                for column, values in zip(out, arrays[1:], strict=True):
                    column[i:j][hit] = values[at[hit]]
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, TextWords()
        self.grams = {k: Arrays(model, f"grams{k}", "<u4", *(["<u8"] if k == 1 else [])) for k in range(1, model.order + 1)}
        self.contexts = {k: Arrays(model, f"contexts{k}", "<u8", "<u8", "<u8", "<u8") for k in range(2, model.order + 1)}

    def _values(self, arrays: Arrays, keys: np.ndarray) -> list[np.ndarray]:
        distinct, back = np.unique(keys, return_inverse=True)
        return [v[back] for v in arrays.look_up(distinct)]

    def probabilities(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(last word | words before) for the rows of (n, order) hashes, and the last words' plain counts."""
        m = self.model
        left, raw = self._values(self.grams[1], gram_hash(grams[:, -1:]))
        p = np.full(len(grams), m.discounts[0] / (m.types + 1))
        if m.total:
            p += self._discounted(left, 1) / m.total
        for k in range(2, m.order + 1):
            own = grams[:, m.order - k :]
            (n,) = self._values(self.grams[k], gram_hash(own))
            total, n1, n2, n3 = (v.astype(np.float64) for v in self._values(self.contexts[k], gram_hash(own[:, :-1])))
            d = m.discounts[k]
            seen = total > 0
            total[~seen] = 1.0
            p = np.where(seen, (self._discounted(n, k) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / total, p)
        return p, raw

    def _discounted(self, n: np.ndarray, k: int) -> np.ndarray:
        d = np.array([0.0, *self.model.discounts[k]])
        return np.maximum(n.astype(np.float64) - d[np.minimum(n, 3)], 0.0)


def _score(model: Model, most: int = 400_000):
    def make():
        scorer = Scorer(model)
        floor = model.train_tokens + 0.5 * (model.types + 1)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8_parts(batch.column(2))
            n = batch.num_rows
            tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            held: list[np.ndarray] = []
            owners: list[int] = []

            def flush() -> None:
                if not held:
                    return
                sizes = np.array([len(g) for g in held])
                p, raw = scorer.probabilities(np.concatenate(held))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                known[owners] = np.add.reduceat((raw > 0).astype(np.int64), starts)
                base[owners] = np.add.reduceat(np.log10((raw + 0.5) / floor), starts)
                score[owners] = np.add.reduceat(np.log10(p), starts)
                tokens[owners] = sizes
                held.clear()
                owners.clear()

            size = 0
            for i, hashes in scorer.words.each(data, at):
                held.append(grams_of(token_hashes(hashes, model.order), model.order))
                owners.append(i)
                size += len(held[-1])
                if size >= most:
                    flush()
                    size = 0
            flush()
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(known), pa.array(np.full(n, model.train_tokens)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return one

    return make


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` has doc_id, held_out and text; perplexity is 10 ** (-score / n_tokens)."""
    return arrow_map(docs.select("doc_id", "held_out", "text"), _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def remainder(doc_id: str, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 1).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return score(docs, train(docs.where("NOT held_out")))
