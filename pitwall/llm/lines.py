"""Fuzzy line deduplication: MinHash bands, SimHash, edit similarity, connected groups.

1. Lines are normalised (lower case, digits to 0, ASCII punctuation and white space to single spaces).
   A line without a word is no line and stays.
2. Equal normalised lines collapse; each distinct line gets a 64-bit SimHash and a MinHash signature of its
   tokens: its words, of words longer than LONG_WORD bytes all pieces of PIECE bytes, so that text without spaces has tokens too.
3. Lines are joined on each of BANDS blocks of ROWS signature rows; two lines share a block with the probability
   1 - (1 - J ** ROWS) ** BANDS at a Jaccard similarity J of the tokens: 0.96 at 2/3, where a fifth of the words is replaced.
   (Blocks of the SimHash itself find pairs only within a few bits, which a fifth of changed words far exceeds.)
4. Pairs within DISTANCE bits, with AGREE equal signature rows of four bits each (both wide enough for edit similarity 80%), and of a possible length are verified by edit similarity
   (100 * distance <= (100 - percent) * longer length): common ends are cut, bounds decide most pairs, an exact bit-parallel distance the others.
5. Of each connected group of lines one occurrence stays: the first by (doc_id, line number).

Defined results: a null or empty text has no lines to remove and stays as it is, like a text without a doc_id; a line
that repeats inside one document counts like any other; lines of fewer than ``min_chars`` bytes (default 0: none) are left alone; an
empty table gives an empty table; doc_id is unique; other columns, whatever their names, pass through :func:`deduplicate_lines` untouched.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import BROADCAST_KEYS, WORD, arrow_map, discard, documents_of, isolated, position, restored, written
from .linking import link
from .words import borders, mixed, run_hashes

BANDS, ROWS = 14, 4
#: SimHash bits: of the pairs at edit similarity 80% in check tables 99.8% lie within.
DISTANCE = 20
LONG_WORD = 12
PIECE = 6
#: Line numbers by document are broadcast up to this measured size, else joined by a shuffle.
LINES_BROADCAST = 24 << 20
#: Texts are cut into lines in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Bytes of lower-cased UTF-8: digits become 0, other ASCII that is no letter a space; the line end stays.
_PLAIN = bytes(b if b > 127 or b == 10 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0, 10, 32]] = True
#: Of the BANDS * ROWS signature rows, cut to four bits: at J = 0.6 35 +- 4 agree, at J = 0.1 9 +- 3. Of pairs at edit similarity 80% in check
#: tables 99% had 36 or more.
AGREE = 26
#: A line under a block: first only its name, then, where a block is shared, what the cheap test needs. Lengths count up to LONGEST.
_NAMED = np.dtype([("key", "<u4"), ("spread", "<u2"), ("id", "<i8")])
_LINE = np.dtype([("key", "<u8"), ("id", "<i8"), ("sim", "<u8"), ("size", "<u2"), ("sketch", "u1", (BANDS * ROWS // 2,))])
LONGEST = 65_535
#: Bytes stored of a block's key: 4 for grouping, 2 for its bucket.
_KEY = 6


def plain_words(text: str) -> list[list[bytes]]:
    """The normalised words of every line."""
    return [line.split() for line in text.lower().encode().translate(_PLAIN).split(b"\n")]


def normalised(line: str) -> str:
    return b" ".join(plain_words(line)[0]).decode()


#: Each bit of a byte in a byte of its own, so that a 64-bit sum counts eight bits at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
_LANE = 255


def simhashes(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of word hashes: the sign of every bit's sum. No run is empty, and runs follow each other."""
    pieces = -(-counts // _LANE)  # a lane holds sums up to 255
    first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    lanes = np.add.reduceat(_SPREAD[np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)], np.repeat(starts, pieces) + within * _LANE, axis=0)
    ones = lanes.view(np.uint8).reshape(-1, 64)
    ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64) if len(ones) > len(counts) else ones
    return np.packbits(2 * ones.astype(np.int64) > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, bands) keys, equal where all rows' smallest permuted token hashes are equal, and those rows' last four bits, two a byte. No run is empty, and runs follow each other."""
    short = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    factors = (mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out, sketch = np.empty((len(starts), bands), dtype=np.uint64), np.zeros((len(starts), bands * rows // 2), dtype=np.uint8)
    for band in range(bands):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for row in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(short * factors[row], starts)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
            # The smallest values have few leading bits set, so the last ones tell them apart.
            sketch[:, row // 2] |= ((least & np.uint32(15)) << np.uint32(4 * (row % 2))).astype(np.uint8)
        out[:, band] = key
    return out, sketch


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal four-bit rows in two sketches."""
    differ = x ^ y
    return np.count_nonzero((differ & 15) == 0, axis=-1) + np.count_nonzero(differ < 16, axis=-1)


def _least_distance(x: str, y: str) -> int:
    """A lower bound: characters that one has more often than the other must be changed."""
    from collections import Counter

    more = Counter(x)
    more.subtract(y)
    return max(sum(n for n in more.values() if n > 0), -sum(n for n in more.values() if n < 0))


def _most_distance(x: str, y: str, enough: int, look: int = 8) -> int:
    """An upper bound from aligning words greedily; gives up beyond ``enough``."""
    a, b = x.split(" "), y.split(" ")
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        p = q = look
        for total in range(1, look + 1):
            hit = next((k for k in range(total + 1) if i + k < len(a) and j + total - k < len(b) and a[i + k] == b[j + total - k]), None)
            if hit is not None:
                p, q = hit, total - hit
                break
        cost += max(sum(map(len, a[i : i + p])) + p, sum(map(len, b[j : j + q])) + q)
        if cost > enough:
            return cost
        i, j = i + p, j + q
    return cost + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j) if i < len(a) or j < len(b) else cost


def edit_distance(x: str, y: str) -> int:
    """Exact, with a column of the table in the bits of two integers."""
    if len(x) < len(y):
        x, y = y, x
    if not y:
        return len(x)
    where: dict = {}
    for k, c in enumerate(y):
        where[c] = where.get(c, 0) | 1 << k
    full, top, score = (1 << len(y)) - 1, 1 << (len(y) - 1), len(y)
    up, down = full, 0
    for c in x:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(diagonal | up) & full, diagonal & up
        score += 1 if rise & top else -1 if fall & top else 0
        rise = rise << 1 | 1
        up = (fall << 1 | ~(diagonal | rise)) & full
        down = diagonal & rise & full
    return score


def similar(x: str, y: str, percent: int) -> bool:
    """Whether 100 * edit distance <= (100 - percent) * longer length."""
    most = (100 - percent) * max(len(x), len(y)) // 100
    if abs(len(x) - len(y)) > most:
        return False
    ahead = _common(x, y)
    x, y = x[ahead:], y[ahead:]
    behind = _common(x[::-1], y[::-1])
    x, y = x[: len(x) - behind], y[: len(y) - behind]
    if max(len(x), len(y)) <= most or _most_distance(x, y, most) <= most:
        return True
    return _least_distance(x, y) <= most and edit_distance(x, y) <= most


def _common(x: str, y: str) -> int:
    """Length of the common start, by halving."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _verified(percent: int):
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = [similar(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

        return one

    return make


class Lines:
    """Normalised lines of many texts as arrays: hash, size, tokens, SimHash and block keys, without a step for each word."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, min_chars: int = 0):
        self.bands, self.rows, self.min_chars = bands, rows, min_chars
        self.seen: set = set()

    def of(self, texts: list[str]) -> dict:
        """Arrays over the lines: text (its number), line, hash (two words), size; and of those not seen before new, sim, keys."""
        import xxhash

        body = np.frombuffer(b"\0".join(t.lower().encode().translate(_PLAIN) for t in texts), dtype=np.uint8)
        starts, ends = borders(body, _BLANK)
        breaks = np.flatnonzero((body == 0) | (body == 10))
        ending = body[breaks] == 0
        line_of = np.searchsorted(breaks, starts)
        first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(starts) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        number = line_of[first] if len(first) else first
        text_of = np.concatenate([[0], np.cumsum(ending)])[number]
        first_line = np.concatenate([[0], np.flatnonzero(ending) + 1])[text_of]
        # Words and one space between two of a line, one line after the other.
        keep = ~_BLANK[body]
        follows = line_of[1:] == line_of[:-1]
        keep[ends[:-1][follows]] = True
        plain = body[keep]  # blanks inside of lines are spaces already
        ends_at = np.cumsum(ends - starts + np.append(follows, False)) if len(starts) else ends
        lo, hi = (np.concatenate([[0], ends_at[last[:-1]]]), ends_at[last]) if len(first) else (first, first)
        raw = plain.tobytes()
        big = np.flatnonzero(hi - lo >= self.min_chars)
        lo, hi, first, last, number, text_of, first_line = (x[big] for x in (lo, hi, first, last, number, text_of, first_line))
        digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        inside = np.append((plain & 0xC0) != 0x80, False)
        sizes = np.add.reduceat(inside, np.stack([lo, hi], axis=1).reshape(-1), dtype=np.int64)[::2] if len(lo) else lo
        if len(self.seen) > 250_000:
            self.seen.clear()
        new = np.zeros(len(digests), dtype=bool)
        for k, digest in enumerate(digests):
            if digest not in self.seen:
                self.seen.add(digest)
                new[k] = True
        hashes, token_starts, counts = self._tokens(body, starts, ends, first[new], last[new])
        sim, keys, sketch = np.zeros(0, np.uint64), np.zeros((0, self.bands), np.uint64), np.zeros((0, self.bands * self.rows // 2), np.uint8)
        if len(counts):
            sim, (keys, sketch) = simhashes(hashes, token_starts, counts), band_keys(hashes, token_starts, self.bands, self.rows)
        return {
            "text": text_of, "line": number - first_line, "hash": np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2), "size": sizes, "new": new,
            "sim": sim, "keys": keys, "sketch": sketch,
        }

    def _tokens(self, body, starts, ends, first, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the tokens of lines given by their first and last words, and each line's first token and number of tokens."""
        words = last - first + 1
        word = np.repeat(first, words) + np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
        size = ends[word] - starts[word]
        pieces = np.where(size <= LONG_WORD, 1, size - PIECE + 1)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        hashes = run_hashes(body, np.repeat(starts[word], pieces) + within, np.repeat(np.where(size <= LONG_WORD, size, PIECE), pieces))
        counts = np.add.reduceat(pieces, np.cumsum(words) - words) if len(words) else pieces
        return hashes, np.cumsum(counts) - counts, counts


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, width * n + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The rows of bytes of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _occurrences(min_chars: int):
    def make():
        lines = Lines(min_chars=min_chars)

        def part(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = lines.of(texts)
            spots = np.full(len(found["new"]), -1)
            spots[found["new"]] = np.arange(len(found["sim"]))
            index = pa.array(spots, mask=spots < 0)
            keys = found["keys"].view(np.uint8).reshape(len(found["keys"]), -1, 8)[:, :, :_KEY].reshape(len(found["keys"]), -1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(ids, dtype=np.int64)[found["text"]]), pa.array(found["line"].astype(np.int32)), pa.array(found["hash"][:, 0].copy()), pa.array(found["hash"][:, 1].copy()),
                    pa.array(found["size"].astype(np.int32)), pa.array(found["sim"].view(np.int64)).take(index), _binary(keys).take(index), _binary(found["sketch"]).take(index),
                ],
                ["doc_id", "line", "h1", "h2", "size", "sim", "keys", "sketch"],
            )

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts, ids, texts, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= GROUP_BYTES:
                    parts.append(part(ids, texts))
                    ids, texts, size = [], [], 0
            if texts:
                parts.append(part(ids, texts))
            return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if any(p.num_rows for p in parts) else None

        return run

    return make


#: An occurrence, or several of one line: the first place and the number.
_PLACE = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<u4")])


def _gathered(records: np.ndarray) -> np.ndarray:
    """One record for each line: its first place by (doc_id, line) and the sum of the numbers."""
    records = records[np.lexsort((records["line"], records["doc"], records["h2"], records["h1"]))]
    new = np.ones(len(records), dtype=bool)
    new[1:] = (records["h1"][1:] != records["h1"][:-1]) | (records["h2"][1:] != records["h2"][:-1])
    first = np.flatnonzero(new)
    out = records[first].copy()
    if len(first):
        out["n"] = np.minimum(np.add.reduceat(records["n"].astype(np.uint64), first), 0xFFFFFFFF)
    return out


def _places(buckets: int, most: int = 500_000):
    """Occurrences by bucket of the line's hash; a task adds up its own first, so that a common line weighs one record a task."""

    def run(batches):
        packer, held, size = blobs.Packer(buckets), [], 0
        for batch in batches:
            records = np.ones(batch.num_rows, dtype=_PLACE)
            for name, column in zip(("h1", "h2", "doc", "line"), batch.columns, strict=True):
                records[name] = column.to_numpy()
            held.append(records)
            size += len(records)
            if size >= most:
                records = _gathered(np.concatenate(held))
                yield from packer.add((mixed(np.ascontiguousarray(records["h1"]).view(np.uint64)) % np.uint64(buckets)).astype(np.int32), records)
                held, size = [], 0
        if held:
            records = _gathered(np.concatenate(held))
            yield from packer.add((mixed(np.ascontiguousarray(records["h1"]).view(np.uint64)) % np.uint64(buckets)).astype(np.int32), records)
        yield from packer.flush()

    return run


def _firsts(records: np.ndarray) -> pa.Table:
    found = _gathered(records)
    return pa.table({"h1": pa.array(found["h1"].copy()), "h2": pa.array(found["h2"].copy()), "n": pa.array(found["n"].astype(np.int64)), "doc_id": pa.array(found["doc"].copy()), "line": pa.array(found["line"].copy())})


def _dealt(bands: int, buckets: int):
    """Distinct lines of a task under each block, packed by bucket."""

    def run(batches):
        packer = blobs.Packer(buckets)
        for batch in batches:
            n = batch.num_rows
            raw = _bytes(batch.column(1), bands * _KEY).reshape(n, bands, _KEY)
            keys = np.ascontiguousarray(raw[:, :, :4]).view("<u4").reshape(n, bands)
            spread = np.ascontiguousarray(raw[:, :, 4:]).view("<u2").reshape(n, bands)
            for band in range(bands):
                records = np.empty(n, dtype=_NAMED)
                records["key"], records["spread"], records["id"] = keys[:, band], spread[:, band], batch.column(0).to_numpy()
                yield from packer.add(spread[:, band].astype(np.int64) * buckets >> 16, records)
        yield from packer.flush()

    return run


def _shared(records: np.ndarray) -> pa.Table:
    """Blocks of two lines or more."""
    key = records["spread"].astype(np.int64) << 32 | records["key"]
    order = np.lexsort((records["id"], key))
    key, own = key[order], records["id"][order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    several = blobs.repeats(key)
    return pa.table({"key": key[several], "id": own[several]})


def _posted(buckets: int):
    """Lines under shared blocks, with what the cheap test needs, packed by bucket."""

    def run(batches):
        packer = blobs.Packer(buckets)
        for batch in batches:
            records = np.empty(batch.num_rows, dtype=_LINE)
            records["key"], records["id"] = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            records["sim"], records["size"] = batch.column(2).to_numpy().view(np.uint64), np.minimum(batch.column(3).to_numpy(), LONGEST)
            records["sketch"] = _bytes(batch.column(4), BANDS * ROWS // 2)
            yield from packer.add((mixed(records["key"]) % np.uint64(buckets)).astype(np.int32), records)
        yield from packer.flush()

    return run


def _near(percent: int):
    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        small, big = np.minimum(x["size"], y["size"]).astype(np.int64), np.maximum(x["size"], y["size"]).astype(np.int64)
        fits = (np.bitwise_count(x["sim"] ^ y["sim"]) <= DISTANCE) & ((100 * small >= percent * big) | (big == LONGEST))
        return fits & (agreeing(x["sketch"], y["sketch"]) >= AGREE)

    return near


def duplicate_lines(docs: DataFrame, percent: int = 80, min_chars: int = 0) -> DataFrame:
    """(doc_id, line): the line numbers to remove from each document, written; ``discard`` deletes it."""
    texts = documents_of(docs).where("doc_id IS NOT NULL")
    seen = written(arrow_map(texts, _occurrences(min_chars), "doc_id long, line int, h1 long, h2 long, size int, sim long, keys binary, sketch binary"), "occurrences")
    buckets = max(32, (seen.count() * _PLACE.itemsize) // (12 << 20))
    lines = written(blobs.by_bucket(seen.select("h1", "h2", "doc_id", "line").mapInArrow(_places(buckets), blobs.SCHEMA), _PLACE, _firsts, "h1 long, h2 long, n long, doc_id long, line int"), "lines")
    buckets = max(32, lines.count() * BANDS * _NAMED.itemsize // (12 << 20))
    # Half of a line's hash names it here: lines that agree in this half are compared like any others.
    told = seen.where("keys IS NOT NULL")
    shared = written(blobs.by_bucket(told.select("h1", "keys").mapInArrow(_dealt(BANDS, buckets), blobs.SCHEMA), _NAMED, _shared, "key long, id long"), "shared")
    meeting = shared.count()
    posted = shared.join(told.select(F.col("h1").alias("id"), "sim", "size", "sketch"), "id").select("key", "id", "sim", "size", "sketch")
    buckets = max(32, meeting * _LINE.itemsize // (12 << 20))
    packed = posted.mapInArrow(_posted(buckets), blobs.SCHEMA)

    def bodies(wanted: DataFrame) -> DataFrame:
        """(id, body) of lines, cut out of their first documents."""
        named = wanted.select(F.col("id").alias("h1"))
        at = written(lines.join(named, "h1", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("line", F.col("h1").alias("id"))).alias("at")), "wanted")
        found = written(arrow_map(texts.join(_small(at, F.size("at") * 12), "doc_id").select("text", F.col("at.line"), F.col("at.id")), _picked, "id long, body string"), "bodies", "zstd")
        discard(at)
        return found

    def verify(pairs: DataFrame) -> DataFrame:
        body = bodies(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = pairs.join(body.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(body.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
        links = written(arrow_map(both.select("a", "b", "x", "y"), _verified(percent), "a long, b long"), "links")
        discard(body)
        return links

    grouped = link(packed, _LINE, _near(percent), verify, buckets, bodies=bodies, alike=partial(similar, percent=percent))
    few = grouped.count() <= BROADCAST_KEYS
    light = F.broadcast if few else lambda df: df
    own = lines.join(light(grouped.withColumnRenamed("id", "h1")), "h1", "left")
    placed = own.select("h1", "h2", "component", "n", F.struct("doc_id", "line").alias("stays"))
    stays = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("stays").alias("stays"))
    linked = placed.where("component IS NOT NULL").drop("stays").join(light(stays), "component").select("h1", "h2", "stays")
    marked = written(linked.unionAll(placed.where("component IS NULL AND n > 1").select("h1", "h2", "stays")), "marked")
    marked_few = F.broadcast(marked) if marked.count() <= BROADCAST_KEYS // 2 else marked
    gone = seen.select("doc_id", "line", "h1", "h2").join(marked_few, ["h1", "h2"]).where((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("line") != F.col("stays.line"))).select("doc_id", "line")
    out = written(gone, "gone")
    discard(seen, lines, shared, grouped, marked)
    return out


def _small(df: DataFrame, size) -> DataFrame:
    measured = df.agg(F.sum(size + 32)).first()[0] or 0
    return F.broadcast(df) if measured <= LINES_BROADCAST else df


def _picked():
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bodies = [], []
        for text, numbers, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = (text or "").split("\n")
            ids += own
            bodies += [normalised(lines[n]) for n in numbers]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], ["id", "body"])

    return one


def _masks():
    """Line numbers as a mask over a document's lines."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks = []
        for numbers in batch.column(1):
            numbers = numbers.values.to_numpy()
            mask = np.zeros(int(numbers.max()) + 1, dtype=bool)
            mask[numbers] = True
            masks.append(mask)
        ends = np.cumsum([0, *[len(m) for m in masks]])
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(masks)))
        return pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array([int(m.sum()) for m in masks], pa.int64())], ["doc_id", "gone", "n_removed"])

    return one


def deduplicate_lines(docs: DataFrame, percent: int = 80, min_chars: int = 0, removed_column: str | None = None, length_column: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """The documents, in their columns, without the removed lines.

    ``removed_column`` adds their number, ``length_column`` names the column of the text's code points, to be counted
    again; with ``drop_emptied`` documents that lost lines and have no word left go.
    """
    found = duplicate_lines(docs, percent, min_chars)
    gone = written(arrow_map(found.groupBy("doc_id").agg(F.collect_set("line").alias("line")), _masks, "doc_id long, gone array<boolean>, n_removed long"), "removed")
    discard(found)
    own = isolated(docs, doc_id="doc_id", text="text").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = own.join(_small(gone, F.size("gone")), "doc_id", "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get(F.col("gone"), i), F.lit(False))), "\n")
    cleaned = joined.select("row", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text")).alias("text"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))
    cleaned = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)) if drop_emptied else cleaned
    length = {length_column: F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")[f"c{position(docs, length_column)}"]).cast(docs.schema[position(docs, length_column)].dataType)} if length_column else {}
    return restored(cleaned, docs, {"text": F.col("text"), **length}, {removed_column: F.col("n_removed")} if removed_column else None)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = deduplicate_lines(docs.withColumn("n_lines", lines.cast("long")), removed_column="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
