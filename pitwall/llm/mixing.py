"""Mixing sources to target weights: bounded iterative proportional fitting.

Documents fall into cells (source, language, topic). Their tokens are raked to the target shares of
the three marginals, in turn, for ROUNDS rounds; a cell's fitted weight never exceeds what it
has, so that weight / tokens is a probability. Each document is then kept by comparing that probability with a
number drawn from its doc_id, so the sample is the same on every run and in every engine. :func:`achieved` tells
how far each marginal is from its target.

Unless targets are given, a marginal's target shares are its token shares to the power TEMPER, which lifts
rare sources, languages and topics, and the sample aims at SHARE of all tokens.

Topics are clusters of vocabulary, learned from all documents: each word falls into one of 16 hashed terms (by its first and last letters and its length), a document is the
vector of its shares, and TOPICS centroids start from the term in which a document exceeds the corpus most and move
REFINED times to the token-weighted mean of their documents. All sums are of integers, so any order of rows gives the same centroids.

Cells and centroids, not documents, are fitted: they are aggregated first, which also takes the weight off a hot
source. Up to CELLS_ON_DRIVER cells are fitted on the driver; more are fitted by the same steps as DataFrames.

Defined results: null source or language is its own category ''; a null or empty text
has no tokens, the topic 'none', no weight and probability 1; an empty table gives an empty table; repeated rows are
judged by their doc_id, rows without one alike; other columns, whatever their names, pass through :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, isolated, restored, written

ROUNDS = 12
TEMPER = 0.7
SHARE = 0.8
CELLS_ON_DRIVER = 50_000
MARGINALS = ("source", "lang", "topic")
TOPICS = 6
REFINED = 2
TERMS = "0123456789abcdef"
#: Parts into which a cell's documents are dealt where cells are joined by a shuffle.
SALTS = 32


def draw(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from the doc_id: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _term(word: Column) -> Column:
    """One of TERMS from a word's first and last letters and its length, which both engines compute cheaply."""
    number = F.lit(7) * F.ascii(word) + F.lit(3) * F.ascii(F.substring(word, -1, 1)) + F.length(word)
    return F.substring(F.lit(TERMS), F.pmod(number, F.lit(len(TERMS))) + F.lit(1), F.lit(1))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n_tokens, terms): each document's words by hashed term; the only pass over the texts."""
    own = isolated(docs, doc_id="doc_id", text="text", source="source", lang="lang")
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, -1), lambda w: w != "")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    split = own.select("doc_id", named("source"), named("lang"), words.alias("words"))
    hashed = split.select("doc_id", "source", "lang", F.size("words").cast("long").alias("n_tokens"), F.array_join(F.transform("words", _term), "").alias("h"))
    return hashed.select("doc_id", "source", "lang", "n_tokens", F.array(*[F.length("h") - F.length(F.replace("h", F.lit(t), F.lit(""))) for t in TERMS]).alias("terms"))


def _sums(features: DataFrame, *by: str) -> DataFrame:
    return features.groupBy(*by).agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("terms")[i]).alias(f"t{i}") for i in range(len(TERMS))])


def _share(i: int) -> Column:
    return F.col("terms")[i].cast("double") / F.col("n_tokens").cast("double")


def _nearest(centroids: list[tuple[int, list[float]]]) -> Column:
    """The topic whose centroid is nearest, the lower one of two; without tokens 'none'."""
    if not centroids:
        return F.lit("none")
    best = None
    for k, centre in centroids:
        distance = None
        for i, c in enumerate(centre):
            step = (_share(i) - F.lit(c)) * (_share(i) - F.lit(c))
            distance = step if distance is None else distance + step
        best = [*(best or []), F.struct(distance.alias("d"), F.lit(f"topic {k}").alias("k"))]
    return F.when(F.col("n_tokens") > 0, F.array_min(F.array(*best))["k"]).otherwise("none")


def learn_topics(features: DataFrame, topics: int = TOPICS, refined: int = REFINED) -> list[tuple[int, list[float]]]:
    """(number, centroid) of each topic; only sums of 16 terms come to the driver."""
    all_ = _sums(features).first()
    if not all_["n"]:
        return []
    excess = F.array(*[F.struct((_share(i) - F.lit(all_[f"t{i}"] / all_["n"])).alias("e"), F.lit(-i).alias("i")) for i in range(len(TERMS))])
    placed = features.where("n_tokens > 0").withColumn("topic", F.pmod(-F.array_max(excess)["i"], F.lit(topics)))
    centroids: list = []
    for step in range(refined + 1):
        rows = sorted((r.asDict() for r in _sums(placed if not step else features.where("n_tokens > 0").withColumn("topic", F.substring(_nearest(centroids), 7, 9).cast("int")), "topic").collect()), key=lambda r: r["topic"])  # a row for each topic
        centroids = [(r["topic"], [r[f"t{i}"] / r["n"] for i in range(len(TERMS))]) for r in rows]
    return centroids


def categorised(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens), written; ``discard`` deletes it."""
    features = written(counted(docs), "terms", "zstd")
    out = features.select("doc_id", "source", "lang", _nearest(learn_topics(features)).alias("topic"), "n_tokens")
    out._scratch = features._scratch
    return out


def _targets(tokens: dict, given: dict | None, temper: float, total: float, share: float) -> dict:
    """Tokens wanted of each category of one marginal."""
    weights = {k: float(given.get(k, 0.0)) for k in tokens} if given else {k: float(v) ** temper if v else 0.0 for k, v in tokens.items()}
    whole = sum(weights[k] for k in sorted(weights))
    return {k: share * total * w / whole if whole else 0.0 for k, w in weights.items()}


def fit_locally(cells: list[tuple], targets: dict | None, temper: float, share: float, rounds: int = ROUNDS) -> list[float]:
    """Fitted token weights of (source, lang, topic, tokens) cells."""
    total = float(sum(c[3] for c in cells))
    weights = [float(c[3]) for c in cells]
    wanted = wanted_tokens(cells, targets, temper, share)
    for _ in range(rounds):
        for m in range(len(MARGINALS)):
            now: dict = {}
            for c, w in zip(cells, weights, strict=True):
                now[c[m]] = now.get(c[m], 0.0) + w
            weights = [min(float(c[3]), w * wanted[m][c[m]] / now[c[m]]) if now[c[m]] > 0 else 0.0 for c, w in zip(cells, weights, strict=True)]
    return weights if total else [0.0] * len(cells)


def wanted_tokens(cells: list[tuple], targets: dict | None, temper: float, share: float) -> list[dict]:
    """For each marginal the tokens wanted of its categories."""
    total, out = float(sum(c[3] for c in cells)), []
    for m, name in enumerate(MARGINALS):
        sums: dict = {}
        for c in cells:
            sums[c[m]] = sums.get(c[m], 0) + c[3]
        out.append(_targets(sums, (targets or {}).get(name), temper, total, share))
    return out


def fit_distributed(cells: DataFrame, targets: dict | None, temper: float, share: float, rounds: int = ROUNDS) -> DataFrame:
    """The same for a table of cells too large for the driver: MARGINALS, tokens, weight."""
    spark = cells.sparkSession
    now = written(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {}
    for name in MARGINALS:
        sums = now.groupBy(name).agg(F.sum("tokens").alias("have"))
        if (targets or {}).get(name):
            given = spark.createDataFrame(list(targets[name].items()), f"{name} string, part double")
            sums = sums.join(given, name, "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
        else:
            sums = sums.withColumn("part", F.when(F.col("have") > 0, F.pow(F.col("have").cast("double"), F.lit(temper))).otherwise(0.0))
        whole = float(sums.agg(F.sum("part")).first()[0] or 0)
        wanted[name] = written(sums.select(name, (F.lit(share * total) * F.col("part") / F.lit(whole or 1.0)).alias("wanted")), "wanted")
    for _ in range(rounds):
        after = now
        for name in MARGINALS:
            factor = after.groupBy(name).agg(F.sum("weight").alias("have")).join(wanted[name], name)
            after = after.join(factor, name).select(*MARGINALS, "tokens", F.when(F.col("have") > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("wanted") / F.col("have"))).otherwise(0.0).alias("weight"))
        after = written(after, "cells")
        discard(now)
        now = after
    discard(*wanted.values())
    return now


def keep_probabilities(docs: DataFrame, targets: dict | None = None, temper: float = TEMPER, share: float = SHARE, rounds: int = ROUNDS, cells_on_driver: int = CELLS_ON_DRIVER) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, keep_prob, kept); ``targets`` maps a marginal to {category: share}."""
    placed = categorised(docs)
    cells = placed.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens"))
    taken = cells.limit(cells_on_driver + 1).collect()
    if len(taken) <= cells_on_driver:
        rows = sorted((tuple(r) for r in taken), key=lambda r: r[:3])
        weights = fit_locally(rows, targets, temper, share, rounds)
        fitted = docs.sparkSession.createDataFrame([(*r[:3], w / r[3] if r[3] else 1.0) for r, w in zip(rows, weights, strict=True)], "source string, lang string, topic string, p double")
        joined = placed.join(F.broadcast(fitted), list(MARGINALS))  # at most cells_on_driver rows
    else:
        fitted = fit_distributed(cells, targets, temper, share, rounds).select(*MARGINALS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("p"))
        # A cell may hold a third of the documents: each is met in SALTS parts.
        dealt = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*MARGINALS, "salt"])
    return joined.select("doc_id", *MARGINALS, "n_tokens", F.round("p", 6).alias("keep_prob"), (draw() < F.round("p", 6)).alias("kept"))


def achieved(probabilities: DataFrame, targets: dict | None = None, temper: float = TEMPER, share: float = SHARE) -> DataFrame:
    """(marginal, category, tokens, wanted, expected, sampled) of a result of :func:`keep_probabilities`.

    ``expected`` are the tokens that the probabilities give, ``sampled`` those of the documents kept. A category cannot give more than it has,
    so that what it lacks stays a difference between wanted and expected.
    """
    out = None
    for name in MARGINALS:
        sums = probabilities.groupBy(F.col(name).alias("category")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("keep_prob")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("sampled"))
        if (targets or {}).get(name):
            given = probabilities.sparkSession.createDataFrame(list(targets[name].items()), "category string, part double")
            sums = sums.join(given, "category", "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
        else:
            sums = sums.withColumn("part", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(temper))).otherwise(0.0))
        whole, tokens = sums.agg(F.sum("part"), F.sum("tokens")).first()
        rows = sums.select(F.lit(name).alias("marginal"), "category", "tokens", (F.lit(share * float(tokens or 0) / (whole or 1.0)) * F.col("part")).alias("wanted"), "expected", "sampled")
        out = rows if out is None else out.unionByName(rows)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, all columns kept. Of rows with one doc_id all or none stay."""
    kept = keep_probabilities(docs, **options).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))
    own = isolated(docs, doc_id="doc_id").select("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))
    return restored(own.join(kept, "key", "left_semi"), docs)


def op8(spark, sf_dir: str) -> DataFrame:
    return keep_probabilities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))


def oracle(rounds: int = ROUNDS, temper: float = TEMPER, share: float = SHARE) -> str:
    """The same topics and the same fit in DuckDB SQL, one step after the other."""
    n = len(TERMS)
    share_of = lambda i: f"(t{i}::DOUBLE / n_tokens::DOUBLE)"
    sums = f"sum(n_tokens)::DOUBLE AS n, {', '.join(f'sum(t{i})::DOUBLE AS s{i}' for i in range(n))}"
    parts = [
        "WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)",
        f"h AS (SELECT doc_id, source, lang, len(words)::BIGINT AS n_tokens, array_to_string([substr('{TERMS}', (7 * ascii(w) + 3 * ascii(right(w, 1)) + len(w)) % {n} + 1, 1) FOR w IN words], '') AS h FROM t)",
        f"f AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, {', '.join(f'len(h) - len(replace(h, {chr(39)}{c}{chr(39)}, {chr(39) * 2})) AS t{i}' for i, c in enumerate(TERMS))} FROM h)",
        f"whole AS (SELECT {sums} FROM f)",
        f"g0 AS (SELECT f.*, list_position([{', '.join(f'e{i}' for i in range(n))}], greatest({', '.join(f'e{i}' for i in range(n))})) - 1 AS top FROM (SELECT f.*, {', '.join(f'{share_of(i)} - s{i} / n AS e{i}' for i in range(n))} FROM f, whole WHERE n_tokens > 0) f)",
        f"a0 AS MATERIALIZED (SELECT doc_id, n_tokens, {', '.join(f't{i}' for i in range(n))}, top % {TOPICS} AS topic FROM g0)",
    ]
    for step in range(REFINED + 1):
        parts.append(f"c{step} AS MATERIALIZED (SELECT topic, {sums} FROM a{step} GROUP BY topic)")
        distance = " + ".join(f"({share_of(i)} - s{i} / n) * ({share_of(i)} - s{i} / n)" for i in range(n))
        columns = ", ".join(f"a0.t{i}" for i in range(n))
        parts.append(f"d{step} AS (SELECT a0.doc_id, a0.n_tokens, {columns}, c{step}.topic, {distance} AS distance FROM a0, c{step})")
        parts.append(f"a{step + 1} AS MATERIALIZED (SELECT doc_id, n_tokens, {', '.join(f't{i}' for i in range(n))}, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, topic) AS r FROM d{step}) WHERE r = 1)")
    parts += [
        f"d AS MATERIALIZED (SELECT f.doc_id, source, lang, coalesce('topic ' || a.topic, 'none') AS topic, f.n_tokens FROM f LEFT JOIN a{REFINED + 1} a USING (doc_id))",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "all_tokens AS (SELECT sum(tokens) AS total FROM c)",
    ]
    for m in MARGINALS:
        parts.append(f"m_{m} AS (SELECT {m}, {share} * (SELECT total FROM all_tokens) * CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {temper}) ELSE 0 END / sum(CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {temper}) ELSE 0 END) OVER () AS wanted FROM c GROUP BY {m})")
    last, step = "(SELECT *, tokens AS weight FROM c)", 0
    for _ in range(rounds):
        for m in MARGINALS:
            step += 1
            parts.append(f"w{step} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN have > 0 THEN least(tokens, weight * wanted / have) ELSE 0 END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {m}) AS have FROM {last}) JOIN m_{m} USING ({m}))")
            last = f"w{step}"
    parts.append(f"p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END, 6) AS keep_prob FROM {last})")
    return ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, n_tokens, keep_prob, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < keep_prob AS kept FROM d JOIN p USING (source, lang, topic)"
