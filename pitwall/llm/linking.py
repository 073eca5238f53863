"""Linking of near copies without all pairs, and connected components.

Blocking gives every node some keys; nodes under one key are candidates of each other. A key of a
large group of near copies has very many nodes, so :func:`link` does not pair them all:

1. The task of a bucket of keys pairs the nodes of a small group (up to SMALL) that pass a cheap test. In
   a larger one the node with the smallest id leads: nodes that pass the test with it are paired with it only; those
   that fail get the next leader, and so on, so that a group yields at most one pair a node.
2. Distinct pairs are verified; links give components.
3. What can still be missing are links between different components under one key of a large group. Such groups come back
   with the components of their nodes. Pairs across that pass the test are verified in the task that holds the group, which skips what is
   joined already and gives out links only (or, with ``residual``, by an exact join of the few nodes concerned).

The components are exact for the given keys and test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import BROADCAST_KEYS, discard, written
from .words import mixed

#: Groups up to this size are paired whole.
SMALL = 8
#: Edges that one task joins at most (32 MB); more are joined in rounds of all tasks.
EDGES_IN_TASK = 2_000_000
#: Measured bytes of bodies that are broadcast at most; more are joined by a shuffle.
BODIES_BROADCAST = 16 << 20
#: Nodes of a group compared with as many others at once.
BLOCK = 512


# ------------------------------------------------------------------------------------------------- components


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each can reach, by hooking and pointer jumping."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while True:
        px, py = parent[x], parent[y]
        open_ = px != py
        if not open_.any():
            return ids, ids[parent]
        x, y, px, py = x[open_], y[open_], px[open_], py[open_]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contracted(everything: bool):
    """Edges of a task as a forest of stars; ``everything``: of all its batches, else of blocks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def stars():
            ids, least = roots(a, b)
            moved = ids != least
            return ids[moved], least[moved]

        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > EDGES_IN_TASK and not everything:
                a, b = stars()
                if len(a) > EDGES_IN_TASK // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = stars()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def components(edges: DataFrame, in_task: int = EDGES_IN_TASK) -> DataFrame:
    """(id, component): the smallest id reachable, for ids with an edge to another. ``edges`` has a and b.

    Each task first joins its own edges, which leaves a forest. As long as that is larger than ``in_task``,
    large-star and small-star steps alternate with this; then one task of bounded size ends it.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = written(pairs.mapInArrow(_contracted(False), "a long, b long"), "edges")
    before = None
    while (left := now.count()) > in_task:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(up, "a").select("b", "m").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionAll(up.select("a", F.col("m").alias("b"))).distinct()
        after = written(small.mapInArrow(_contracted(False), "a long, b long").distinct(), "edges")
        digest = (left, *after.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if digest == before:  # stars only: nothing changes any more
            break
        before = digest
    else:
        stars = written(now.coalesce(1).mapInArrow(_contracted(True), "a long, b long"), "stars")
        discard(now)
        now = stars
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    out._scratch = now._scratch
    return out


# ---------------------------------------------------------------------------------------------------- linking


def _grouped(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records by (key, id) without repetitions, the start of each key's group and its size."""
    order = np.lexsort((records["id"], records["key"]))
    key, own = records["key"][order], records["id"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    records = records[order[new]]
    starts = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]])) if len(records) else np.zeros(0, np.int64)
    return records, starts, np.diff(np.append(starts, len(records)))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("packed", pa.binary())])


def _first_pairs(near):
    """Pairs of a bucket, and its large groups packed in a last row."""

    def reduce(records: np.ndarray) -> pa.Table:
        records, starts, sizes = _grouped(records)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, SMALL + 1):
            at = starts[sizes == size]
            for i in range(size - 1 if len(at) else 0):
                for j in range(i + 1, size):
                    x, y = records[at + i], records[at + j]
                    ok = near(x, y)
                    a.append(x["id"][ok])
                    b.append(y["id"][ok])
        kept = []
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            own = records[start : start + size]
            if size <= BLOCK:
                meet = np.triu(near(own[:, None], own[None, :]), 1)
                edges = int(np.count_nonzero(meet))
                if not edges:
                    continue
            free, found = np.arange(size), 0
            while len(free) > 1:  # sorted by id: the first leads
                ok = meet[free[0], free[1:]] if size <= BLOCK else near(own[free[:1]], own[free[1:]])
                if ok.any():
                    a.append(np.broadcast_to(own["id"][free[0]], int(ok.sum())))
                    b.append(own["id"][free[1:][ok]])
                    found += int(ok.sum())
                free = free[1:][~ok]
                if size <= BLOCK and found < edges and len(free) > 32:
                    free = free[meet[free][:, free].any(axis=1) | meet[free][:, free].any(axis=0)]
            if size > BLOCK or found < edges:
                kept.append(own)
        x, y = _distinct(np.concatenate(a), np.concatenate(b))
        out = [pa.table([pa.array(x), pa.array(y), pa.nulls(len(x), pa.binary())], schema=_PAIRS)]
        if kept:
            out.append(pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([np.concatenate(kept).tobytes()], pa.binary())], schema=_PAIRS))
        return pa.concat_tables(out)

    return reduce


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def _unpacked_rows(dtype: np.dtype, buckets: int):
    """Records of large groups as rows: bucket, id and the record."""
    width = dtype.itemsize

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                records = np.frombuffer(raw.as_buffer(), dtype=dtype)
                # Groups with the same first node, mostly of the same nodes under other keys, meet in one task, which compares a pair once.
                starts = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]]))
                leads = np.repeat(records["id"][starts], np.diff(np.append(starts, len(records))))
                dealt = (mixed(np.ascontiguousarray(leads).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                for lo in range(0, len(records), 1 << 16):
                    part = records[lo : lo + (1 << 16)]
                    bodies = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, width * (len(part) + 1), width, dtype=np.int32)), pa.py_buffer(part.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(dealt[lo : lo + (1 << 16)]), pa.array(part["id"]), bodies], ["bucket", "id", "record"])

    return run


def _crossings(rows: pa.Table, dtype: np.dtype, near) -> Iterator[np.ndarray]:
    """(a, b, component of a, component of b) of nodes of different components under one key that pass the test, in blocks."""
    records = blobs.unpacked(rows.column("record"), dtype)
    component = rows.column("component").to_numpy()
    order = np.lexsort((records["id"], component, records["key"]))
    records, component = records[order], component[order]
    starts = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]])) if len(records) else np.zeros(0, np.int64)
    for i, j in zip(starts, np.append(starts[1:], len(records)), strict=False):
        own, of = records[i:j], component[i:j]
        if of[0] == of[-1]:
            continue
        for lo in range(0, len(own), BLOCK):
            for hi in range(lo, len(own), BLOCK):
                x, y = own[lo : lo + BLOCK], own[hi : hi + BLOCK]
                cx, cy = of[lo : lo + BLOCK], of[hi : hi + BLOCK]
                if cx[0] != cy[-1]:
                    p, q = np.nonzero((cx[:, None] < cy[None, :]) & near(x[:, None], y[None, :]))
                    yield np.stack([x["id"][p], y["id"][q], cx[p], cy[q]])


def _linked_across(dtype: np.dtype, near, alike: Callable[[str, str], bool]):
    """Links (a, b) between components, found by comparing bodies here: what is joined already needs no further look, and no pair leaves the task but a link."""

    def reduce(rows: pa.Table) -> pa.Table:
        bodies = dict(zip(rows.column("id").to_pylist(), rows.column("body").to_pylist(), strict=True))
        parent: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        links: list[tuple[int, int]] = []
        for found in _crossings(rows, dtype, near):
            for a, b, ca, cb in found.T.tolist():
                x, y = find(ca), find(cb)
                if x == y or (a, b) in tried:
                    continue
                if alike(bodies[a], bodies[b]):
                    links.append((a, b))
                    parent[max(x, y)] = min(x, y)
                elif len(tried) < 1_000_000:  # beyond, a pair is only compared again
                    tried.add((a, b))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return reduce


def _meeting(dtype: np.dtype, near):
    """The nodes that have such a pair, with their components."""

    def reduce(rows: pa.Table) -> pa.Table:
        met: dict[int, int] = {}
        for a, b, ca, cb in _crossings(rows, dtype, near):
            met.update(zip(a.tolist(), ca.tolist(), strict=True))
            met.update(zip(b.tolist(), cb.tolist(), strict=True))
        return pa.table({"id": pa.array(met.keys(), pa.int64()), "component": pa.array(met.values(), pa.int64())})

    return reduce


def link(
    packed: DataFrame, dtype: np.dtype, near: Callable[[np.ndarray, np.ndarray], np.ndarray], verify: Callable[[DataFrame], DataFrame], buckets: int, *,
    residual: Callable[[DataFrame], DataFrame] | None = None, bodies: Callable[[DataFrame], DataFrame] | None = None, alike: Callable[[str, str], bool] | None = None,
) -> DataFrame:
    """(id, component) for the nodes that have a link.

    ``packed`` has records of ``dtype`` (key, id and what ``near`` needs) by bucket of the key, see :mod:`blobs`. ``near`` is
    the cheap test on arrays of records, symmetric. ``verify`` gets distinct pairs (a < b) and returns those that are links, written.
    For the links that are left between components either ``residual`` gets (id, component) of the nodes that pass the test with
    one of another component under a key, and returns pairs (a, b) that contain every link between these components; or
    ``bodies`` returns (id, body) for such nodes and ``alike`` decides on two bodies, in the task that has the key's nodes.
    """
    dtype = np.dtype(dtype)
    first = written(blobs.by_bucket(packed, dtype, _first_pairs(near), "a long, b long, packed binary"), "matches")
    tried = written(first.where("packed IS NULL").select("a", "b").distinct(), "pairs")
    links = verify(tried)
    grouped = components(links)
    discard(links)

    few = F.broadcast(grouped) if grouped.count() <= BROADCAST_KEYS else grouped
    rows = first.where("packed IS NOT NULL").select("packed").mapInArrow(_unpacked_rows(dtype, buckets), "bucket int, id long, record binary")
    large = rows.join(few, "id", "left").select("bucket", "id", "record", F.coalesce("component", "id").alias("component"))
    members = written(large.groupBy("bucket").applyInArrow(_meeting(dtype, near), "id long, component long").distinct(), "members")
    if members.isEmpty():
        discard(first, tried, members)
        return grouped
    if residual is not None:
        todo = written(residual(members).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = verify(todo)
        discard(todo)
    else:
        named = bodies(members.select("id"))
        size = named.agg(F.sum(F.octet_length("body") + 32)).first()[0] or 0
        texts = F.broadcast(named) if size <= BODIES_BROADCAST else named
        more = written(large.join(texts, "id").select("bucket", "id", "record", "component", "body").groupBy("bucket").applyInArrow(_linked_across(dtype, near, alike), "a long, b long"), "links")
        discard(named)
    discard(first, tried, members)
    if not more.isEmpty():
        # A component's members point to its smallest id, so links between components complete the old stars.
        after = components(more.unionAll(grouped.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))))
        discard(grouped)
        grouped = after
    discard(more)
    return grouped
