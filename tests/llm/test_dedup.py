import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pitwall.llm import lines, linking, minhash, suffix_dedup
from tests.llm.helpers import AWKWARD, awkward, documents, nothing, texts

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, size):
    w = text.encode().translate(LOWER).split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def near_copies(spark, n=90):
    """Groups of near copies with edits: some links hold only through others."""
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(3):
        base = [r.choice(vocabulary) for _ in range(120)]
        for k in range(n // 3):
            own = list(base)
            for _ in range(r.randint(0, 14)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((group * 1000 + k * 7 % (n // 3), "common first line of many documents\n" + " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("make", [documents, awkward, near_copies])
@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, make, size):
    docs = make(spark)
    sets = {d: shingles(t, size) for d, t in texts(docs).items()}
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, size=size).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), groups.find(d), groups.find(d) == d) for d in ids}


def test_deduplicate_keeps_columns(spark):
    out = minhash.deduplicate(awkward(spark))
    assert out.columns == awkward(spark).columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 5, 7, 8]
    assert minhash.near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("in_task", [linking.EDGES_IN_TASK, 3])
def test_components_of_random_graphs(spark, in_task):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    groups = Groups()
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    got = {x.id: x.component for x in linking.components(spark.createDataFrame(edges, "a long, b long"), in_task).collect()}
    assert got == {k: groups.find(k) for k in groups}


@pytest.mark.parametrize("make", [documents, awkward])
def test_repeated_substrings_equal_brute_force(spark, make):
    docs = make(spark)
    bodies = {d: t.encode() for d, t in texts(docs).items()}
    seen = Counter(hash(b[i : i + 200]) for b in bodies.values() for i in range(len(b) - 199))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_substrings(docs).collect()}
    for d, b in bodies.items():
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, mask, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if mask[i] and (i == 0 or not mask[i - 1]))
        assert got[d] == (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_cover_meets_every_pair_and_empty(spark):
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    assert suffix_dedup.repeated_substrings(nothing(spark)).count() == 0


def test_memory_of_a_task_follows_neither_its_partition_nor_the_candidates(spark, monkeypatch):
    """A worker reads segments of which every suffix is a candidate, many in one batch; a bucket holds only suffixes that tie."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(3)
    size, buckets = suffix_dedup.SEGMENT_BYTES, 16
    bodies = [r.integers(0, 256, size, dtype=np.uint8).tobytes() for _ in range(2)] * 4
    n = 1 + size // suffix_dedup.PERIOD * len(suffix_dedup.COVER)
    bits = [[{"bucket": b, "bits": b"\xff" * n} for b in range(buckets)]] * len(bodies)
    batch = pa.RecordBatch.from_pydict({"segment": [*range(len(bodies))], "lengths": [[size]] * len(bodies), "body": pa.array(bodies, pa.binary()), "sample_bits": bits})
    tracemalloc.start()
    try:
        sent = sum(len(p) for out in suffix_dedup._sent(buckets, 200, 12, True)(iter([batch])) for p in out.column("packed").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent == len(bodies) * 12 * (size - 199)
    assert peak < 300 << 20
    # Spark's own batches are bounded, too, while the operator runs, and as before afterwards.
    seen, key, returned = [], "spark.sql.execution.arrow.maxBytesPerBatch", suffix_dedup._returned
    before = spark.conf.get(key)
    monkeypatch.setattr(suffix_dedup, "_returned", lambda *a: (seen.append(spark.conf.get(key)), returned(*a))[1])
    suffix_dedup.repeated_substrings(documents(spark).limit(20)).count()
    assert seen == [str(suffix_dedup.BATCH_BYTES)] * 2 and spark.conf.get(key) == before


def test_large_buckets_and_bits_that_are_not_broadcast(spark, monkeypatch):
    docs = documents(spark)
    expected = sorted(suffix_dedup.repeated_substrings(docs).collect())
    monkeypatch.setattr(suffix_dedup, "BITS_BROADCAST", -1)
    monkeypatch.setattr(suffix_dedup, "SORTED", 10)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 20_000)
    assert sorted(suffix_dedup.repeated_substrings(docs).collect()) == expected


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited_lines(spark):
    r = random.Random(4)
    base = [" ".join(f"term{r.randrange(90)}" for _ in range(40)) for _ in range(12)]
    rows = []
    for doc in range(40):
        own = []
        for line in r.sample(base, 4):
            w = line.split()
            if r.random() < 0.6:
                w[r.randrange(len(w))] = f"term{r.randrange(90)}"
            own.append((" ".join(w) + ".").capitalize())
        rows.append((doc, "\n".join([*own, "short", "short"])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def line_places(docs):
    """Places of each distinct normalised line."""
    places = {}
    for d, t in sorted(texts(docs).items()):
        for n, w in enumerate(lines.plain_words(t)):
            if w:
                places.setdefault(b" ".join(w).decode(), []).append((d, n))
    return places


def alike(x, y):
    return 100 * edits(x, y) <= 20 * max(len(x), len(y)) if max(len(x), len(y)) < 5000 else y.startswith(x) or x.startswith(y)


@pytest.mark.parametrize("make", [edited_lines, awkward])
def test_duplicate_lines_equal_all_pairs(spark, make):
    """Against edit similarity of all pairs, without any filter."""
    docs = make(spark)
    places, groups = line_places(docs), Groups()
    distinct = list(places)
    for i, x in enumerate(distinct):
        for j in range(i + 1, len(distinct)):
            if alike(x, distinct[j]):
                groups.join(i, j)
    first = {}
    for i, x in enumerate(distinct):
        first.setdefault(groups.find(i), []).extend(places[x])
    want = {p for own in first.values() for p in own if p != min(own)}
    got = {(r.doc_id, r.line) for r in lines.duplicate_lines(docs).collect()}
    assert got == want and got


def test_hot_groups_and_rows_without_id(spark, monkeypatch):
    """A large group under one key is not paired whole, and links beyond its leaders are still found."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for k in range(80):  # a chain: neighbours are similar, its ends are not
        base[(3 * k) % 60] = f"x{k}"
        rows.append((k, " ".join(base)))
    rows += [(1000 + k, "the very same line of many documents") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionAll(spark.createDataFrame([(None, rows[0][1])], "doc_id long, text string"))
    out = {r.doc_id: r.text for r in lines.deduplicate_lines(docs).collect()}
    assert out[0] and out[1000] and out[None] == rows[0][1] and not any(out[k] for k in [*range(1, 80), *range(1001, 1050)])
    near = {r.doc_id: r for r in minhash.near_duplicates(docs.withColumn("text", F.concat("text", F.lit(" and so on"))), size=1, percent=90).collect()}
    assert near[79].component_id == 0 and near[None].kept and near[None].component_id is None and near[1049].component_id == 1000


def test_lines_are_cut_out_and_columns_kept(spark):
    docs = awkward(spark)
    out = lines.deduplicate_lines(docs, removed_column="lines_gone")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "lines_gone"] and got[1].text is None and got[6].text == "" and got[6].lines_gone == 1 and got[5].lines_gone == 0 and got[8].text == AWKWARD[7][1]
    assert got[8].component == docs.where("doc_id = 8").first().component
    assert lines.deduplicate_lines(nothing(spark)).count() == 0


def varied_lines(spark):
    """Short and long lines with up to a tenth of their words changed, and lines without spaces."""
    r = random.Random(9)
    rows = []
    for doc in range(60):
        words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(r.choice((10, 14, 20, 50)))]
        for copy in range(2):
            own = list(words)
            for _ in range(copy * max(1, len(own) // 10)):
                k = r.randrange(len(own))
                own[k] = "".join(r.choice("uvwxyz") for _ in own[k])
            rows.append((2 * doc + copy, ("" if doc < 15 else " ").join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_recall_against_edit_similarity_alone(spark):
    docs = varied_lines(spark)
    bodies = [(d, lines.normalised(t)) for d, t in sorted(texts(docs).items())]
    want = {(b, 0) for (a, x), (b, y) in zip(bodies[::2], bodies[1::2], strict=True) if x != y and 100 * edits(x, y) <= 20 * max(len(x), len(y))}
    got = {(r.doc_id, r.line) for r in lines.duplicate_lines(docs).collect()}
    assert len(want) > 50 and got <= want and len(got) >= 0.9 * len(want)
    assert any(" " not in bodies[d][1] for d, _ in got)


def test_candidates_of_replaced_words(spark):
    """Real lines of 4 to 1,000 words, one, two or a tenth of their words replaced: pairs at edit similarity 80% are candidates."""
    r = random.Random(6)
    real = [lines.normalised(x) for t in texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)).values() for x in t.split("\n")]
    vocabulary = sorted({w for x in real for w in x.split()})
    found = {}
    finder = lines.Lines()
    for low, high in ((4, 7), (8, 15), (16, 39), (40, 99), (100, 1000)):
        own = [x for x in real if low <= len(x.split()) <= high]
        for k in (1, 2, 0):
            pairs = []
            for x in r.sample(own, min(len(own), 150)):
                w = x.split()
                for _ in range(k or max(1, len(w) // 10)):
                    w[r.randrange(len(w))] = r.choice(vocabulary)
                y = " ".join(w)
                if x != y and (len(x) > 1000 or alike(x, y)):
                    pairs.append((x, y))
            finder.seen.clear()
            both = [finder.of([x]) | {"other": finder.of([y])} for x, y in pairs]
            hits = [bool((f["keys"] == f["other"]["keys"]).any() and (f["sim"] ^ f["other"]["sim"]).item().bit_count() <= lines.DISTANCE) for f in both if len(f["keys"]) and len(f["other"]["keys"])]
            found[low, k] = (sum(hits) / max(1, len(hits)), len(hits))
    assert all(share >= 0.9 for share, n in found.values() if n > 20), found


def test_suffixes_do_not_tie_by_half_a_fingerprint():
    import inspect

    import pyarrow as pa

    assert inspect.signature(suffix_dedup.repeated_substrings).parameters["key_bytes"].default >= 12
    r = np.random.default_rng(5)
    body = r.integers(0, 256, 2000, dtype=np.uint8)
    body[1000:1300] = body[:300]
    at = np.arange(len(body) - 199)
    second = suffix_dedup.Fingerprints().of(body, suffix_dedup._LETTERS2).at(at, 200)
    for first in (np.zeros(len(at), dtype=np.uint64), suffix_dedup.Fingerprints().of(body).at(at, 200)):
        raw = suffix_dedup.full_keys(first, second, 12)
        rows = pa.table({"segment": [7], "bucket": pa.array([0], pa.int32()), "packed": pa.array([raw.tobytes()], pa.binary())})
        out = suffix_dedup._ties(12)(rows).to_pylist()
        tied = np.flatnonzero(np.unpackbits(np.frombuffer(out[0]["bits"], np.uint8), count=len(at)))
        assert tied.tolist() == [*range(101), *range(1000, 1101)]
