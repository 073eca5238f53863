"""Every stage of the pipeline on what the one before kept, against brute force; and the queries themselves on awkward tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitwall.llm import catalog, mixing, quality_rules
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, awkward, texts
from tests.llm.test_dedup import Groups, alike, line_places, shingles
from tests.llm.test_rules_mixing_packing import check_pieces


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def in_duck(df, sql):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toPandas())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def lines_by_brute_force(docs):
    """Texts without their repeated lines, from all pairs of lines."""
    places, groups = line_places(docs), Groups()
    distinct = list(places)
    for i, x in enumerate(distinct):
        for j in range(i + 1, len(distinct)):
            if abs(len(x) - len(distinct[j])) <= max(len(x), len(distinct[j])) // 5 and len(set(x.split()) & set(distinct[j].split())) * 5 >= len(x.split()) and alike(x, distinct[j]):
                groups.join(i, j)
    first = {}
    for i, x in enumerate(distinct):
        first.setdefault(groups.find(i), []).extend(places[x])
    gone = {p for own in first.values() for p in own if p != min(own)}
    out = {}
    for d, t in texts(docs).items():
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        if kept.split() or kept == t:
            out[d] = kept
    return out


def components_by_brute_force(docs):
    sets = {d: shingles(t, 5) for d, t in texts(docs).items()}
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {d for d in ids if groups.find(d) == d}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF).cache()
    assert {r.doc_id for r in kept.collect()} == {r["doc_id"] for r in in_duck(docs, quality_rules.ORACLE) if r["kept"]} and kept.columns == docs.columns
    cleaned = stages["line dedup"](spark, kept, SF).cache()
    assert texts(cleaned) == lines_by_brute_force(kept) and all(r.n_chars == len(r.text) for r in cleaned.collect())
    single = stages["minhash near-dedup"](spark, cleaned, SF).cache()
    assert {r.doc_id for r in single.collect()} == components_by_brute_force(cleaned)
    mixed = stages["mixing"](spark, single, SF).cache()
    assert {r.doc_id for r in mixed.collect()} == {r["doc_id"] for r in in_duck(single, mixing.oracle()) if r["kept"]}
    pieces = stages["packing"](spark, mixed, SF).collect()
    check_pieces(pieces, texts(mixed))
    assert rows_of(corpus_pipeline.run(spark, SF)) == sorted((tuple(r) for r in pieces), key=repr)


def test_stages_take_awkward_tables(spark):
    docs = awkward(spark).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= 2 * docs.count() + 200 and (out.columns == docs.columns or name == "packing"), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder with awkward documents, pages and labels."""
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*row, len(row[1] or "")) for row in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://a.example/x", ""), (3, "nonsense", "<p>a<div>b"), (4, "http://a.example/y", "<article>" + "<div>" * 2000 + "x")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_take_awkward_tables(spark, folder, name):
    out = catalog.QUERIES[name](spark, folder)
    rows = out.collect()
    assert len({r[0] for r in rows}) == (4 if name.startswith("op4") else len(AWKWARD))
