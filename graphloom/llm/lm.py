"""Stupid-backoff scores, relationally.

Words are those of the decontamination operator (A-Z lower-cased).  The model is
of order two over all words and all pairs of neighbours of all documents.  With
corpus counts c and N words in all, a document scores the sum of ln S:

    S(first word)  = c(w) / N
    S(w after v)   = c(v w) / c(v)      if c(v w) >= MIN_COUNT
                   = ALPHA * c(w) / N   otherwise

Counts are exact for every word.  The ``CODED`` most frequent ones are broadcast
with rank and count (words over 64 bytes by their SHA-256, so the size is bounded);
a rarer word holds at most one in ``CODED`` of all tokens, so its rows fit a task.

* Pairs of two of the ``HOT`` most frequent words are counted with partial
  aggregation and their table is broadcast (HOT^2 rows at most).
* All others are shuffled once.  Two coded words meet by pair.  A rarer second
  word's rows meet by that word, which counts the word and its pairs in one
  partition; a rarer first word's rows meet by the first word likewise (with a row
  for the end of a document, as every occurrence must be counted).  A pair of two
  rarer words is in both places: where it is seen the first word's place scores it,
  else the second's.

Sums leave that stage partially aggregated.

Null text has no words: zero counts and a null score.  Rows are scored by row,
so repeated rows or null ids keep their own; an empty table gives no rows; extra
columns are ignored.  Rows are numbered by their place in the scan, which only a
plain scan repeats; any other frame is written once before it is numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import lowered
from graphloom.plans.shared import stage

CODED, HOT, MIN_COUNT, ALPHA = 262_144, 512, 2, 0.4
LONG = 64
#: Fixed value: what separates words of a text whose A-Z are not lower-cased yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In place of a rank: the place before the first word, the place after the last.
START, END = -2, -3
#: Keys of rows that meet by a rarer first, or second, word: these and a hash below them, above all keys of pairs.
FIRST, SECOND, HASH = 1 << 62, 3 << 61, (1 << 61) - 1


def _words(text: str) -> Column:
    """Words of a text before lower-casing; a null text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), "")


def _short(word: str | Column) -> Column:
    """A word lower-cased, or its digest if it is over ``LONG`` bytes (words hold no ``#``)."""
    word = lowered(F.col(word) if isinstance(word, str) else word)
    return F.when(F.octet_length(word) > LONG, F.concat(F.lit("#"), F.sha2(word, 256))).otherwise(word)


def vocabulary(docs: DataFrame, coded: int = CODED) -> tuple[DataFrame, int]:
    """``word, id, c`` of the ``coded`` most frequent words (ties by word), a bounded table, and the number of words in all."""
    counts = stage(docs.select(F.explode(_words("text")).alias("word")).select(_short("word").alias("word")).groupBy("word").agg(F.count("*").alias("c")), "lm-counts")
    # `top` is at most `coded` rows
    top = stage(counts.orderBy(F.desc("c"), "word").limit(coded), "lm-top")
    known = top.select("word", (F.row_number().over(Window.orderBy(F.desc("c"), "word")) - 1).alias("id"), "c")
    return stage(known, "lm-vocabulary"), counts.agg(F.sum("c")).head()[0] or 0


def scanned(docs: DataFrame) -> bool:
    """Whether every reading of ``docs`` gives the same rows in the same places: a scan of files, or columns or a filter of one."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" :+-!").split()[0].partition("[")[0] for line in plan.toString().splitlines() if line.strip()}
    return bool(plan.deterministic()) and nodes <= {"Project", "Filter", "Relation"}


def score(docs: DataFrame, coded: int = CODED, hot: int = HOT, min_count: int = MIN_COUNT, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_words, n_backoff, logprob`` per row of ``docs``; ``coded`` and ``hot`` do not change results."""
    if not scanned(docs):
        docs = stage(docs.select("doc_id", "text"), "lm-documents")
    known, total = vocabulary(docs, coded)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _words("text").alias("w"))
    # pairs of neighbours; the first word's has no word before it, the last one's none after it
    none = F.array(F.lit(None).cast("string"))
    pairs = F.arrays_zip(F.concat(none, "w").alias("v"), F.concat("w", none).alias("w"))
    exploded = rows.where(F.size("w") > 0).select("row", F.explode(pairs).alias("p")).select("row", _short(F.col("p.v")).alias("v"), _short(F.col("p.w")).alias("w"))
    place = lambda word, id_, edge: F.when(F.col(word).isNull(), F.lit(edge)).otherwise(F.col(id_))
    ranks = lambda word, id_: known.select(F.col("word").alias(word), F.col("id").alias(id_))
    pairs = exploded.join(F.broadcast(ranks("w", "b")), "w", "left").join(F.broadcast(ranks("v", "a")), "v", "left")
    pairs = pairs.select("row", "v", "w", place("v", "a", START).alias("a"), place("w", "b", END).alias("b"))
    # ids are ranks: below `hot` are the most frequent words; the start is hot too; a null id is that of a rarer word
    frequent = (F.col("a") < hot) & (F.col("b") < hot) & (F.col("b") != END)
    # never null, so that no filter lower-cases the words once more (there is no empty word)
    often = exploded.withColumn("w", F.coalesce("w", F.lit(""))).join(F.broadcast(ranks("w", "b").where(F.col("b") < hot)), "w").join(F.broadcast(ranks("v", "a").where(F.col("a") < hot)), "v", "left")
    often = often.where("a IS NOT NULL OR v IS NULL").select("row", place("v", "a", START).alias("a"), "b")
    often = stage(often, "lm-hot")
    table = stage(often.groupBy("a", "b").agg(F.count("*").alias("c2")), "lm-hot-pairs")
    mine = often.join(F.broadcast(table), ["a", "b"])
    after = F.broadcast(known.select(F.col("id").alias("a"), F.col("c").alias("ca")))
    single = F.broadcast(known.select(F.col("id").alias("b"), F.col("c").alias("c1")))

    def summed(part: DataFrame) -> DataFrame:
        seen = (F.col("a") != START) & (F.col("c2") >= min_count)
        p1 = F.log(F.col("c1") / F.lit(float(max(total, 1))))
        ln = F.when(F.col("a") == START, p1).when(seen, F.log(F.col("c2") / F.col("ca"))).otherwise(F.lit(math.log(alpha)) + p1)
        backoff = ((F.col("a") != START) & ~seen).cast("long")
        return part.groupBy("row").agg(F.sum(ln).alias("ln"), F.sum(backoff).alias("backoff"), F.count("*").alias("n"))

    # the other pairs, each where its words are counted
    known_a, known_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    rest = pairs.where(~F.coalesce(frequent, F.lit(False)) & (~known_a | (F.coalesce("b", F.lit(0)) != END)))
    two = F.when(known_a | known_b, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    rest = rest.select("row", "v", "w", "a", "b", F.explode(two).alias("again"))
    other = lambda word, id_: F.coalesce(F.concat(F.lit("#"), F.col(id_).cast("string")), F.col(word))
    hashed = lambda role, word: F.lit(role).bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit(HASH)))
    pair, first = known_a & known_b, ~known_a & (known_b | ~F.col("again"))
    rest = rest.select(
        "row",
        F.when(pair, F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).when(first, hashed(FIRST, "v")).otherwise(hashed(SECOND, "w")).alias("key"),
        F.when(first, F.col("v")).when(~pair, F.col("w")).alias("word"),
        F.when(first, other("w", "b")).when(~pair, other("v", "a")).alias("other"),
    )
    rest = rest.repartition("key", "word").sortWithinPartitions("key", "word", "other")
    rest = rest.withColumn("c", F.count("*").over(Window.partitionBy("key", "word"))).withColumn("c2", F.count("*").over(Window.partitionBy("key", "word", "other")))
    coded_pair, by_first = F.col("word").isNull(), F.col("key") < SECOND
    rank = F.when(F.col("other").startswith("#") & (F.octet_length("other") < LONG), F.substring("other", 2, 10).cast("int"))
    rest = rest.select("row", "key", "word", "c", "c2", F.when(coded_pair, F.shiftright("key", 32).cast("int")).otherwise(rank).alias("x"))
    # a pair of two rarer words scores in one of its places; a document's end scores in none
    seen = F.col("c2") >= min_count
    rest = rest.where(coded_pair | F.when(by_first, (F.coalesce("x", F.lit(0)) != END) & (seen | F.col("x").isNotNull())).otherwise(~seen | F.col("x").isNotNull()))
    rest = rest.select(
        "row",
        "c2",
        F.when(~coded_pair & by_first, F.col("c")).alias("cv"),
        F.when(~coded_pair & ~by_first, F.col("c")).alias("cw"),
        F.when(coded_pair | ~by_first, F.col("x")).alias("a"),
        F.when(coded_pair, F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).when(by_first, F.col("x")).alias("b"),
    )
    rest = rest.join(after, "a", "left").join(single, "b", "left")
    rest = rest.select("row", F.coalesce("a", F.lit(0)).alias("a"), "c2", F.coalesce("ca", "cv").alias("ca"), F.coalesce("c1", "cw").alias("c1"))
    mine = mine.join(after, "a", "left").join(single, "b", "left")
    sums = summed(mine).unionByName(summed(rest)).groupBy("row").agg(F.sum("ln").alias("ln"), F.sum("backoff").alias("n_backoff"), F.sum("n").alias("n_words"))
    out = rows.select("row", "doc_id").join(sums, "row", "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("n_backoff", F.lit(0).cast("long")).alias("n_backoff"), F.round("ln", 4).alias("logprob"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored under the model of all ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
x AS MATERIALIZED (SELECT r, i, word AS b FROM t),
p AS MATERIALIZED (SELECT r, i, lag(b) OVER (PARTITION BY r ORDER BY i) AS a, b FROM x),
c1 AS (SELECT b, count(*) AS c FROM x GROUP BY b),
c2 AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY a, b),
n AS (SELECT count(*) AS n FROM x),
s AS (SELECT p.r, count(*) AS words, sum(CASE WHEN p.a IS NOT NULL AND c2.c < 2 THEN 1 ELSE 0 END) AS backoff,
    sum(CASE WHEN p.a IS NULL THEN ln(c1.c / n.n) WHEN c2.c >= 2 THEN ln(c2.c / ca.c) ELSE ln(0.4) + ln(c1.c / n.n) END) AS lp
  FROM p CROSS JOIN n JOIN c1 ON c1.b = p.b LEFT JOIN c1 ca ON ca.b = p.a LEFT JOIN c2 ON c2.a = p.a AND c2.b = p.b GROUP BY p.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.backoff, 0) AS BIGINT) AS n_backoff, round(s.lp, 4) AS logprob
FROM d LEFT JOIN s USING (r)
"""
