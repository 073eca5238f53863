"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Each document's set of word shingles is hashed to 64-bit values; K multiplicative
permutations give its signature. Every (coordinate, value) pair is a token under
which documents are posted, and a pair of documents is a candidate when at least
MATCH of the K coordinates collide:

1. Equal sets collapse to their smallest doc_id, so that copies cost nothing further.
2. Tokens that only one document has are dropped; a document that keeps fewer than
   MATCH tokens can have no partner and is skipped.
3. Prefix: with tokens in one global order (rarest first), two documents with MATCH
   common tokens share one among their first K - MATCH + 1. Only these lists are merged; those of
   frequent tokens are skipped: a posting carries a byte of each coordinate, so that the collisions
   in all lists, skipped ones too, are counted where two documents first meet (a byte agrees by chance in one of
   256 coordinates, which can only add a candidate).
4. Lists are merged around leaders, large ones without pairing all (see :mod:`linking`).
5. Candidates are confirmed on the full shingle sets, exactly.
6. Documents with a candidate in another component may still be linked across. For these few an exact
   prefix join over their shingles, rarest first and with the bound on the overlap that positions
   give, yields the pairs left to confirm (:func:`across`); a document with a fifth of shingles of its own drops out at once.

With K = 48 and MATCH = 25, a pair at similarity 0.8 is missed with a probability of about 2e-6.

Defined results: a null or empty text has no shingles, is linked with nothing and kept; so is a row without a
doc_id (its component_id is null); fewer words than a shingle form one shingle of the whole sequence; repeated texts form one
component; the smallest doc_id wins; an empty table gives an empty table.
doc_id is unique. Other columns are ignored (:func:`deduplicate` passes them through, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import BROADCAST_KEYS, arrow_map, discard, documents_of, isolated, only, restored, utf8_parts, written
from .linking import link
from .words import TextWords, mixed

K = 48
MATCH = 25
_U = np.uint64


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=_U)
    for k in range(width):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    out.sort()
    keep = np.empty(len(out), dtype=bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[:k] | _U(1), seeds[k:]


def signatures(sets: list[np.ndarray], k: int = K) -> np.ndarray:
    """(documents, k) tokens: the coordinate's smallest permuted value, salted by the coordinate. No set is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    factors, salts = _permutations(k)
    out = np.empty((len(sets), k), dtype=_U)
    scratch = np.empty_like(flat)
    for c in range(k):
        np.multiply(flat, factors[c], out=scratch)
        out[:, c] = mixed(np.minimum.reduceat(scratch, starts) ^ salts[c])
    return out


def _sign(size: int, k: int):
    def make():
        import xxhash

        words = TextWords()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8_parts(batch.column(1))
            n = batch.num_rows
            counts, digests, tokens = [0] * n, [None] * n, [None] * n
            held: list = []

            def flush() -> None:
                if held:
                    for (i, _), row in zip(held, signatures([s for _, s in held], k), strict=True):
                        tokens[i] = row.tobytes()
                    held.clear()

            gathered = 0
            for i, hashes in words.each(data, at):
                own = shingle_set(hashes, size)
                if len(own):
                    counts[i], digests[i] = len(own), xxhash.xxh3_128_digest(own.tobytes())
                    held.append((i, own))
                    gathered += len(own)
                    if gathered > 100_000:
                        flush()
                        gathered = 0
            flush()
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "set_key", "tokens"])

        return one

    return make


def _sets(size: int):
    def make():
        words = TextWords()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8_parts(batch.column(1))
            sets = [shingle_set(hashes, size) for _, hashes in words.each(data, at)]
            ends = np.cumsum([0, *[len(s) for s in sets]])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["id", "shingles"])

        return one

    return make


_TOKEN = np.dtype([("token", "<u8"), ("id", "<i8")])
_COUNTED = np.dtype([("token", "<u8"), ("id", "<i8"), ("n", "<u4")])


def _signature_rows(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, k)


def _tokens_dealt(k: int, buckets: int):
    """(token, id) of every coordinate, by bucket of the token."""

    def run(batches):
        packer = blobs.Packer(buckets)
        for batch in batches:
            rows = _signature_rows(batch.column(1), k)
            for c in range(k):
                records = np.empty(len(rows), dtype=_TOKEN)
                records["token"], records["id"] = rows[:, c], batch.column(0).to_numpy()
                yield from packer.add(_bucket(rows[:, c], buckets), records)
        yield from packer.flush()

    return run


def _shared_tokens(buckets: int):
    """Drop tokens of one document only; deal the others, with their number of documents, by document."""

    def reduce(records: np.ndarray) -> pa.Table:
        records = records[np.argsort(records["token"], kind="stable")]
        _, back, counts = np.unique(records["token"], return_inverse=True, return_counts=True)
        keep = counts[back] > 1
        out = np.empty(int(keep.sum()), dtype=_COUNTED)
        out["token"], out["id"], out["n"] = records["token"][keep], records["id"][keep], np.minimum(counts[back][keep], 0xFFFFFFFF)
        return _packed_by("id", out, buckets)

    return reduce


def _ranked(match: int):
    """Of documents with ``match`` shared tokens or more: the prefix, rarest tokens first."""

    def reduce(records: np.ndarray) -> pa.Table:
        records = records[np.lexsort((records["token"], records["n"], records["id"]))]
        ids, first, counts = np.unique(records["id"], return_index=True, return_counts=True)
        wanted = counts >= match
        ids, first, size = ids[wanted], first[wanted], counts[wanted] - match + 1
        flat = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        offsets = np.concatenate([[0], np.cumsum(size)])
        return pa.table({"id": pa.array(ids), "prefix": pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(records["token"][flat].view(np.int64))).cast(pa.list_(pa.int64()))})

    return reduce


def posting(k: int) -> np.dtype:
    """A document under a token: its set's size and one byte of every coordinate's value."""
    return np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<u4"), ("sketch", "u1", (k,))])


def _posted(k: int, buckets: int):
    dtype = posting(k)

    def run(batches):
        packer = blobs.Packer(buckets)
        for batch in batches:
            prefix = batch.column(2)
            size = np.diff(prefix.offsets.to_numpy())
            records = np.empty(int(size.sum()), dtype=dtype)
            records["key"] = prefix.flatten().to_numpy().view(np.uint64)
            records["id"], records["n"] = np.repeat(batch.column(0).to_numpy(), size), np.repeat(np.minimum(batch.column(1).to_numpy(), 0xFFFFFFFF), size)
            records["sketch"] = np.repeat((_signature_rows(batch.column(3), k) & _U(255)).astype(np.uint8), size, axis=0)
            yield from packer.add(_bucket(records["key"], buckets), records)
        yield from packer.flush()

    return run


def _collide(percent: int, match: int):
    """Whether two documents agree in ``match`` coordinates and their sizes allow the similarity."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
        fits = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        return fits & (np.count_nonzero(x["sketch"] == y["sketch"], axis=-1) >= match)

    return near


_POSTED = np.dtype([("s", "<u8"), ("id", "<i8"), ("component", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(_U)) % _U(buckets)).astype(np.int32)


def _packed_by(key: str, records: np.ndarray, buckets: int) -> pa.Table:
    packer = blobs.Packer(buckets)
    batches = [*packer.add(_bucket(records[key], buckets), records), *packer.flush()]
    return pa.Table.from_batches(batches, pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))


def _posted_shingles(size: int, buckets: int):
    def run(batches):
        words, packer = TextWords(), blobs.Packer(buckets)
        for batch in batches:
            data, at = utf8_parts(batch.column(2))
            docs, components = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, hashes in words.each(data, at):
                doc, component, shingles = docs[i], components[i], shingle_set(hashes, size)
                records = np.zeros(len(shingles), dtype=_POSTED)
                records["s"], records["id"], records["component"], records["n"] = shingles, doc, component, len(shingles)
                yield from packer.add(_bucket(shingles, buckets), records)
        yield from packer.flush()

    return run


def _counted(buckets: int):
    """Keep shingles of two documents or more, with their number of documents in ``at``; deal them by document."""

    def reduce(records: np.ndarray) -> pa.Table:
        records = records[np.argsort(records["s"], kind="stable")]
        _, back, counts = np.unique(records["s"], return_inverse=True, return_counts=True)
        records["at"] = counts[back]
        return _packed_by("id", records[records["at"] > 1], buckets)

    return reduce


def _prefixes(percent: int, buckets: int):
    """Each document's shingles up to its prefix, with their positions; deal them by shingle."""

    def reduce(records: np.ndarray) -> pa.Table:
        records = records[np.lexsort((records["s"], records["at"], records["id"]))]
        _, first, counts = np.unique(records["id"], return_index=True, return_counts=True)
        n = records["n"].astype(np.int64)
        # Shingles of no other document come before all others.
        at = np.arange(len(records)) - np.repeat(first, counts) + n - np.repeat(counts, counts)
        keep = at < n - -(-percent * n // 100) + 1
        records["at"] = at
        return _packed_by("s", records[keep], buckets)

    return reduce


def _across(percent: int, block: int = 1024):
    """Pairs of different components under a shingle that can still reach the overlap."""

    def reduce(records: np.ndarray) -> pa.Table:
        records = records[np.lexsort((records["component"], records["s"]))]
        cuts = np.flatnonzero(records["s"][1:] != records["s"][:-1]) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip([0, *cuts], [*cuts, len(records)], strict=True):
            own = records[i:j]
            if len(own) < 2 or own["component"][0] == own["component"][-1]:
                continue
            # The most frequent component meets the rest only; blocks bound the memory of a frequent shingle.
            values, counts = np.unique(own["component"], return_counts=True)
            rest = own[own["component"] != values[counts.argmax()]]
            for lo in range(0, len(rest), block):
                for hi in range(0, len(own), block):
                    x, y = rest[lo : lo + block, None], own[None, hi : hi + block]
                    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
                    left = 1 + np.minimum(nx - x["at"] - 1, ny - y["at"] - 1)
                    p, q = np.nonzero((x["component"] != y["component"]) & ((100 + percent) * left >= percent * (nx + ny)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)))
                    a.append(rest["id"][lo + p])
                    b.append(own["id"][hi + q])
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return reduce


def across(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, component) in different components, among them all with the given similarity."""
    members = written(members.select(F.col("id").alias("doc_id"), "component"), "members")
    found = only(texts, members, "doc_id").select("doc_id", "component", "text")
    characters = found.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(32, characters * _POSTED.itemsize // 5 // (24 << 20))
    posted = found.mapInArrow(_posted_shingles(size, buckets), blobs.SCHEMA)
    counted = blobs.by_bucket(posted, _POSTED, _counted(buckets), blobs.SCHEMA)
    prefixes = blobs.by_bucket(counted, _POSTED, _prefixes(percent, buckets), blobs.SCHEMA)
    return blobs.by_bucket(prefixes, _POSTED, _across(percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K, match: int = MATCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Links have 100 * intersection >= ``percent`` * union over sets of ``size``-word shingles.
    ``match`` must suit ``percent``: the default holds for 80 and more.
    """
    texts = documents_of(docs)
    signed = written(arrow_map(texts, _sign(size, k), "doc_id long, n_shingles long, set_key binary, tokens binary"), "signatures")
    # One representative for each distinct set.
    able = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = written(able.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "sets")
    one = sets.select(F.col("id").alias("doc_id"))
    classes = written(able.join(F.broadcast(one) if one.count() <= BROADCAST_KEYS else one, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "tokens"), "classes")

    number = classes.count()
    buckets = max(32, number * k * _TOKEN.itemsize // (24 << 20))
    tokens = classes.select("id", "tokens").mapInArrow(_tokens_dealt(k, buckets), blobs.SCHEMA)
    shared = blobs.by_bucket(tokens, _TOKEN, _shared_tokens(buckets), blobs.SCHEMA)
    ranked = written(blobs.by_bucket(shared, _COUNTED, _ranked(match), "id long, prefix array<long>"), "prefixes")
    nodes = classes.join(F.broadcast(ranked) if number <= BROADCAST_KEYS // 16 else ranked, "id").select("id", "n", "prefix", "tokens")
    dtype = posting(k)
    width = max(32, (ranked.agg(F.sum(F.size("prefix"))).first()[0] or 0) * dtype.itemsize // (24 << 20))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        own = written(arrow_map(only(texts, wanted, "doc_id").select("doc_id", "text"), _sets(size), "id long, shingles array<long>"), "shingles", "zstd")
        left, right = own.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), own.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
        links = written(both.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"), "links")
        discard(wanted, own)
        return links

    def residual(members: DataFrame) -> DataFrame:
        return across(texts, members, size, percent)

    linked = link(nodes.mapInArrow(_posted(k, width), blobs.SCHEMA), dtype, _collide(percent, match), verify, width, residual=residual)
    light = F.broadcast if linked.count() <= BROADCAST_KEYS else lambda df: df
    own = sets.join(light(linked), "id", "left")
    # Copies of a text and members of a component take its smallest id; all others keep their own.
    several = written(own.where("copies > 1 OR component <> id").select("set_key", F.coalesce("component", "id").alias("component")), "components")
    discard(classes, ranked, linked, sets)
    return (
        signed.select("doc_id", "n_shingles", "set_key").join(F.broadcast(several) if several.count() <= BROADCAST_KEYS // 2 else several, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest doc_id of their component, all columns kept; those without a doc_id stay."""
    gone = written(near_duplicates(docs, **options).where("NOT kept").select("doc_id"), "gone")
    own = isolated(docs, doc_id="doc_id").select("row", F.col("doc_id").cast("long").alias("doc_id"))
    return restored(own.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "doc_id", "left_anti"), docs)


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=2, percent=80)
