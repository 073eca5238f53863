"""Rule-based quality filter as a short-circuit cascade, in DataFrame expressions only.

Every document gets the base statistics. The rules behind the base test are
predicates over the text; :func:`plan_cascade` estimates each one's cost and
rejection share on a sample and orders them by rejection per cost, and
:func:`apply_rules` evaluates them as one lazy CASE, so that a document that an early
rule rejects never pays for a later one. The order changes the cost, never the verdict.

The sample is drawn from all rows with equal probability, SAMPLE_ROWS of them on average. A rule's cost is the mean number of operations that it
declares for a document (characters met, times what one costs), not a time, so that the order is the same on every run.

Defined results: a null or empty text has no words and fails the base test; a
text without white space is one word; repeated rows are judged alike; a row without a doc_id is judged like any other; an empty
table gives an empty table; other input columns, whatever their names, pass
through untouched unless they carry the name of a result column in any case, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, discard, isolated, restored, written

#: Rows of the sample, on average, on which cost and selectivity are estimated.
SAMPLE_ROWS = 600
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Operations for a character: of a plain search, and of a regular expression that copies what it keeps.
SEARCH, PATTERN = 1, 12


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over ``text`` and the base statistics, never null; ``work`` the SQL number of its operations for a document."""

    name: str
    fails: str
    work: str = "4"


@dataclass(frozen=True)
class Planned:
    rule: Rule
    cost: float
    rejects: float

    @property
    def rank(self) -> float:
        return self.rejects / self.cost


def _left(keep: str) -> str:
    """SQL for the number of code points that match the character class body ``keep``."""
    return f"length(regexp_replace(text, '[^{keep}]+', ''))"


_MATCHED = f"{PATTERN} * length(text)"
RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > (1 + length(text) - length(replace(text, '\n', '')))", f"{SEARCH} * length(text)"),
    Rule("letters", f"10 * {_left(r'\\p{L}')} < 6 * word_chars", _MATCHED),
    Rule("capitals", f"10 * {_left(r'\\p{Lu}')} > 4 * word_chars", _MATCHED),
    Rule("exclamations", f"10 * {_left('!')} > 3 * n_words", _MATCHED),
    Rule("digits", f"10 * {_left('0-9')} > 3 * word_chars", _MATCHED),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; Catalyst cannot duplicate it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more, the first included.

    The windows' hashes are compared first: where all differ, nothing repeats. Otherwise the windows
    themselves are sorted with their positions, equal neighbours are marked and the union of their words counted.
    """

    def window_hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def suspects(w: Column, h: Column) -> Column:
        """(window, position) for windows, sorted."""
        pairs = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.struct(F.element_at(h, i).alias("h"), F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("g"), i.alias("at")))
        return F.sort_array(pairs)

    def marked(s: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
        n = F.size(s)
        return F.sort_array(F.transform(F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0))))) | ((i + 1 < n) & same(x, F.get(s, F.least(i + 1, n - 1))))), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")), lambda acc: acc["n"])

    def count(w: Column) -> Column:
        return _let(window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(suspects(w, h), lambda s: covered(marked(s)))))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(words, count))


def with_statistics(own: DataFrame) -> DataFrame:
    """Add the base statistics (long) to a table with ``text``, which is made non-null."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [c for c in own.columns if c != "text"]
    return (
        own.select(*rest, body.alias("text"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"))
        .select(
            "*",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
        )
        .drop("words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def plan_cascade(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Planned]:
    """Order ``rules`` by rejection per cost, both estimated on a sample of all documents, ``rows`` on average.

    Documents that fail the base test don't count: no rule sees them. Ties keep the order of names.
    """
    share = min(1.0, rows / max(1, docs.count()))
    sample = written(with_statistics(isolated(docs, text=text).select("text").sample(share, seed=11)).where(~base_failed()), "sample")
    found = sample.agg(F.count("*").alias("n"), *[F.count_if(F.expr(r.fails)).alias(f"hits{i}") for i, r in enumerate(rules)], *[F.avg(F.expr(r.work).cast("double")).alias(f"work{i}") for i, r in enumerate(rules)]).first()
    discard(sample)
    planned = [Planned(r, max(found[f"work{i}"] or 1.0, 1.0), (found[f"hits{i}"] + 0.5) / (found["n"] + 1)) for i, r in enumerate(rules)]
    return sorted(planned, key=lambda p: (-p.rank, p.rule.name))


def apply_rules(docs: DataFrame, order: list[Planned] | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Add the statistics, ``base_failed`` and ``kept``; plans the cascade unless an order is given."""
    return restored(_judged(docs, order, rules, text), docs, added={name: F.col(name) for name in (*BASE, "base_failed", "kept")})


def keep_good(docs: DataFrame, order: list[Planned] | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, in their own columns only."""
    return restored(_judged(docs, order, rules, text).where("kept"), docs)


def _judged(docs: DataFrame, order: list[Planned] | None, rules, text: str) -> DataFrame:
    order = plan_cascade(docs, rules, text) if order is None else order
    verdict = F.expr(" ".join(["CASE WHEN base_failed THEN false", *(f"WHEN {p.rule.fails} THEN false" for p in order), "ELSE true END"]))
    return with_statistics(isolated(docs, text=text)).withColumn("base_failed", base_failed()).withColumn("kept", verdict)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", *BASE, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
s AS (
  SELECT doc_id, text, words, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM w),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
t AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS g FROM t WHERE pos <= len(words) - 2),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r) GROUP BY doc_id),
b AS (
  SELECT s.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM s LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > (1 + length(text) - length(replace(text, chr(10), '')))
    OR 10 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 6 * word_chars
    OR 10 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 4 * word_chars
    OR 10 * length(regexp_replace(text, '[^!]+', '', 'g')) > 3 * n_words
    OR 10 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > 3 * word_chars AS rule_failed
  FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT rule_failed AS kept
FROM f
"""
