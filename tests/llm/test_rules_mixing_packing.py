import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitwall.llm import catalog, mixing, packing, quality_rules, tokens
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, awkward, documents, nothing, texts


def words(text):
    return text.encode().split()


def repeated(w):
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})


def test_statistics_of_awkward_texts(spark):
    out = quality_rules.apply_rules(awkward(spark))
    got = {r.doc_id: r for r in out.collect()}
    results = (*quality_rules.BASE, "base_failed", "kept")
    assert len(got) == len(AWKWARD) and out.columns == [*[c for c in awkward(spark).columns if c.lower() not in results], *results] and got[1].text is None
    for doc, text, *_ in AWKWARD:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        assert (got[doc].n_words, got[doc].n_repeat_words, got[doc].n_dup_lines) == (len(w), repeated(w), len(lines) - len(set(lines)))
        assert got[doc].word_chars == sum(len(x.decode()) for x in w)
    assert got[1].base_failed and not got[1].kept and got[5].base_failed and got[1].component == "mine 10"


def test_verdict_does_not_depend_on_the_order(spark):
    docs = documents(spark)
    plan = quality_rules.plan_cascade(docs)
    assert [p.rule.name for p in plan] == [p.rule.name for p in quality_rules.plan_cascade(docs)]
    assert sorted(p.rule.name for p in plan) == sorted(r.name for r in quality_rules.RULES) and all(a.rank >= b.rank for a, b in zip(plan, plan[1:], strict=False))
    one, other = (quality_rules.apply_rules(docs, order).select("doc_id", "kept").collect() for order in (plan, plan[::-1]))
    assert sorted(one) == sorted(other)
    assert quality_rules.apply_rules(nothing(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet') AS src")
    found = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_fit_meets_the_targets_where_it_can():
    cells = [(s, lang, t, n) for (s, lang, t), n in zip(((s, lang, t) for s in "ab" for lang in ("en", "de") for t in "xy"), (300, 200, 150, 100, 80, 70, 60, 40), strict=True)]
    weights = mixing.fit_locally(cells, {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"x": 0.5, "y": 0.5}}, 1.0, 0.4, rounds=200)
    assert all(w <= c[3] + 1e-9 for w, c in zip(weights, cells, strict=True))
    share = lambda k, v: sum(w for w, c in zip(weights, cells, strict=True) if c[k] == v) / sum(weights)
    assert abs(share(0, "a") - 0.6) < 0.02 and abs(share(1, "en") - 0.7) < 0.02 and abs(sum(weights) - 400) < 8


def test_distributed_fit_equals_local(spark):
    docs = documents(spark)
    one = {r.doc_id: r for r in mixing.keep_probabilities(docs, rounds=3).collect()}
    two = {r.doc_id: r for r in mixing.keep_probabilities(docs, rounds=3, cells_on_driver=1).collect()}
    assert len(one) == docs.count() and all(abs(one[k].keep_prob - two[k].keep_prob) < 2e-6 for k in one)


def test_mixing_awkward_and_empty(spark):
    got = {r.doc_id: r for r in mixing.keep_probabilities(awkward(spark)).collect()}
    assert len(got) == len(AWKWARD) and got[2].lang == "" and got[3].source == "" and all(0 <= r.keep_prob <= 1 for r in got.values())
    assert mixing.keep_probabilities(nothing(spark)).count() == 0 and mixing.mix(awkward(spark)).columns == awkward(spark).columns
    assert {r.doc_id for r in mixing.mix(awkward(spark)).collect()} == {k for k, r in got.items() if r.kept}


def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 1]


def check_pieces(rows, docs):
    encode = ids_of()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc, text in docs.items():
        ids, at = np.array(encode(text), dtype="<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_tokens_equal_the_tokenizers_library(spark):
    encode, ours = ids_of(), tokens.encoder()
    for text in [*texts(documents(spark)).values(), *(t for _, t, *_ in AWKWARD if t)]:
        assert [*ours(text), 1] == encode(text)


def test_packing(spark):
    assert 50256 in tokens.encoder()(AWKWARD[7][1])
    for docs in (documents(spark), awkward(spark)):
        check_pieces(packing.pack(docs).collect(), texts(docs))
    check_pieces(packing.pack(documents(spark), shard_tokens=20_000).collect(), texts(documents(spark)))
    assert packing.pack(nothing(spark)).count() == 0


def test_neighbours_share_rare_terms():
    r = np.random.default_rng(0)
    docs = [np.concatenate([r.integers(0, 50, 80), 1000 * (i % 4) + r.integers(1000, 1060, 40)]).astype(np.uint16) for i in range(40)]
    index = packing.Index(docs)
    best = index.neighbours(0, np.arange(40) == 0)[:9]
    assert all(b % 4 == 0 for b in best)


def test_scores_equal_bm25_by_definition():
    import math

    r = np.random.default_rng(3)
    docs = [r.integers(0, 30, r.integers(1, 60)).astype(np.uint16) for _ in range(25)]
    index = packing.Index(docs)
    mean = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))
    for q in range(len(docs)):
        got = index.scores(q)
        for k, d in enumerate(docs):
            counts, want = Counter(d.tolist()), 0.0
            for t in set(docs[q].tolist()):
                if df[t] > 1 and counts[t]:
                    idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                    want += idf * counts[t] * (packing.K1 + 1) / (counts[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
            lone = [t for t in set(docs[q].tolist()) if df[t] == 1 and len(docs) >= 4]  # a term of no other document adds to the query's own score only
            assert abs(got[k] - want) < 1e-5 * max(1, want) or k == q and lone  # frequent terms add up in single precision
        used = r.random(len(docs)) < 0.3
        best = index.neighbours(q, used)
        assert not used[best].any() and all(got[a] > got[b] or got[a] == got[b] and a < b for a, b in zip(best, best[1:]))


def test_partitions_of_the_session_do_not_matter(spark):
    docs, found = documents(spark), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(tuple(r) for r in packing.pack(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_topics_and_achieved_marginals(spark):
    from pyspark.sql import functions as F

    rows = [(k, " ".join(f"{'ab'[k % 2]}{j % 7}" for j in range(60)), "s", "en") for k in range(40)] + [(100, None, None, None)]
    found = mixing.keep_probabilities(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    topics = {r.doc_id: r.topic for r in found.collect()}
    assert len({topics[k] for k in range(0, 40, 2)}) == 1 and len({topics[k] for k in range(40)}) == 2 and topics[100] == "none"
    got = mixing.achieved(mixing.keep_probabilities(documents(spark))).collect()
    assert {r.marginal for r in got} == set(mixing.MARGINALS)
    for name in mixing.MARGINALS:
        own = [r for r in got if r.marginal == name]
        assert abs(sum(r.wanted for r in own) - 0.8 * sum(r.tokens for r in own)) < 1
        # Only the last marginal raked is met exactly; what a category lacks bounds it.
        assert all(r.expected <= r.tokens + 1e-6 for r in own) and sum(abs(r.expected - r.wanted) for r in own) < 0.1 * sum(r.wanted for r in own), own


def test_windows_follow_the_retrieved_order():
    docs = [np.full(600, 10 + i % 2, dtype=np.uint16) for i in range(6)]
    windows = packing.Windows(0, 2048)
    packing.fill(list(range(6)), docs, windows)
    windows.finish()
    first = [p[0] for p in windows.pieces if p[5] == 0]
    assert first[:3] == [0, 2, 4] and sum(p[2] for p in windows.pieces) == 3600
