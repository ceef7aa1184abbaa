"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

1. Corpus frequencies of the benchmark's terms are counted over all documents.
2. In every item, the rarest terms that together meet every window are its
   *anchors*: going through the windows, one that holds no anchor yet gets its
   rarest term (ties: the later place, which serves more windows to come).
3. The index stores, for every training token that is an anchor term, a posting
   ``(row, term, position)`` with the token's neighbours up to a window away, so
   that a list can be intersected with the others of a phrase at their offsets
   where it lies.  It is written once and is the only copy made of the corpus.
4. Postings meet the item places of their term (an equi-join on the term), and
   the neighbours are intersected at their offsets from the item: the matching
   run around the place, if it holds a window, is a hit.  All windows of a run
   are found at once, so a passage costs a few rows, not one per window.

A window is ``WINDOW`` consecutive words of an item; an item of fewer, but not
none, is one window.  Null text has no words (and an item of none has no
windows); rows are matched by row, so repeated rows and shared or null ids each
keep their own result; empty tables give no rows, or no hits; extra columns are
ignored by the operator and kept, whatever their names, by the filter.  The term
filter inside the scan is a literal set while the benchmark has at most
``LITERAL_TERMS`` anchor terms; beyond, it is a literal bitmap of hashed terms of
at most 8 MB, which lets a few other tokens through (their postings meet nothing).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.sieve import sieve
from graphloom.plans.shared import stage

WINDOW = 10
LITERAL_TERMS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(c: Column) -> Column:
    """A-Z lower-cased, and nothing else; ASCII takes the short way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(text: str | Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    split = F.split(lowered(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), SEPARATORS)
    return F.array_remove(split, "")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df``: how often each of ``terms`` occurs in the corpus; absent ones are left out."""
    found = docs.select(F.explode(words("text")).alias("term"))
    n = terms.count()
    if n <= LITERAL_TERMS:
        found = found.where(F.col("term").isin([r["term"] for r in terms.select("term").collect()]))
    else:
        found = found.join(terms.select("term"), "term", "left_semi")
    return found.groupBy("term").agg(F.count("*").alias("df"))


def anchors(items: DataFrame, df: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_key, item_id, q, term, item_words, n``: the places whose rare terms meet every window."""
    placed = items.select("item_key", "item_id", F.col("w").alias("item_words"), F.size("w").alias("n"), F.posexplode("w").alias("q", "term"))
    ranked = placed.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_item = ranked.groupBy("item_key", "item_id", "n").agg(F.first("item_words").alias("item_words"), F.sort_array(F.collect_list(F.struct("q", "df"))).alias("ranks"))
    # the rarest place of each window, unless the last one chosen lies in the window already
    rarest = lambda i: F.array_min(F.transform(F.slice("ranks", i + 1, F.least(F.lit(window), F.col("n"))), lambda s: F.struct(s["df"].alias("df"), (-s["q"]).alias("q"))))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    chosen = F.aggregate(starts, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= i), acc).otherwise(F.concat(acc, F.array(-rarest(i)["q"]))))
    out = by_item.select("item_key", "item_id", "n", "item_words", F.explode(chosen).alias("q"))
    return out.withColumn("term", F.col("item_words")[F.col("q")])


def _listed(terms: DataFrame, literal: int = LITERAL_TERMS):  # noqa: ANN202
    """Whether a word is one of ``terms`` (or, beyond ``literal`` terms, hashes like one)."""
    n = terms.count()
    if n <= literal:
        words_ = [r["term"] for r in terms.select("term").collect()]
        return lambda w: w.isin(words_)
    may = sieve(terms.select(F.xxhash64("term").alias("h")), "h")
    return lambda w: may(F.xxhash64(w))


def build_index(docs: DataFrame, terms: DataFrame, window: int = WINDOW, literal: int = LITERAL_TERMS) -> DataFrame:
    """One row per document: ``row, doc_id, text_hash, n_words, postings``; a posting is its place, term and neighbours."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    listed = _listed(terms, literal)
    places = F.sequence(F.lit(0), F.size("w") - 1)
    keep = F.filter(places, lambda i: listed(F.col("w")[i]))
    around = lambda i: F.struct(i.alias("p"), F.col("w")[i].alias("term"), F.slice("w", F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1))).alias("left"), F.slice("w", i + 2, window - 1).alias("right"))
    postings = F.when(F.size("w") > 0, F.transform(keep, around)).otherwise(F.array())
    return stage(rows.select("row", "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), postings.alias("postings")), "positional-index")


def _run(here: Column, there: Column) -> Column:
    """How many leading elements of two arrays agree."""
    n = F.least(F.size(here), F.size(there))
    same = F.zip_with(F.slice(here, 1, n), F.slice(there, 1, n), lambda a, b: a == b)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def phrase_matches(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, item_key, item_id, s, e``: runs of document words (``s`` to ``e``, inclusive) that hold a window."""
    postings = index.select("row", F.explode("postings").alias("t")).select("row", "t.*")
    met = postings.join(places, "term")
    w, q, n = F.col("item_words"), F.col("q"), F.col("n")
    before = F.reverse(F.slice(w, F.greatest(q - window + 2, F.lit(1)), F.least(q, F.lit(window - 1))))
    after = F.slice(w, q + 2, window - 1)
    met = met.withColumn("l", _run(F.reverse("left"), before)).withColumn("r", _run(F.col("right"), after))
    hit = met.where(F.col("l") + F.col("r") + 1 >= F.least(n, F.lit(window)))
    return hit.select("row", "item_key", "item_id", (F.col("p") - F.col("l")).alias("s"), (F.col("p") + F.col("r")).alias("e"))


def proximity_matches(index: DataFrame, places: DataFrame, within: int = WINDOW) -> DataFrame:
    """``row, item_key, item_id, s, e``: places where two neighbouring anchors of an item stand in its order within ``within`` words.

    The index must hold ``within`` neighbours of a posting: the second anchor is
    looked up there, so the postings of a document are not joined with themselves.
    """
    postings = index.select("row", F.explode("postings").alias("t")).select("row", "t.p", "t.term", "t.right")
    order = Window.partitionBy("item_key").orderBy("q")
    following = places.select("item_key", "item_id", "term", F.lead("term").over(order).alias("next")).where("next IS NOT NULL").distinct()
    after = F.filter(F.transform("right", lambda x, i: F.when(x == F.col("next"), i + 1)), lambda k: k.isNotNull() & (k <= within))
    both = postings.join(following, "term").select("row", "item_key", "item_id", F.col("p").alias("s"), F.explode(after).alias("k"))
    return both.select("row", "item_key", "item_id", "s", (F.col("s") + F.col("k")).alias("e")).distinct()


def proximity_places(items: DataFrame, df: DataFrame, window: int = WINDOW) -> DataFrame:
    """The anchors, and for an item of one anchor its rarest place beside it (ties: the nearer one); an item of one word has none."""
    places = anchors(items, df, window)
    alone = places.groupBy("item_key").agg(F.count("*").alias("k"), F.first("q").alias("only")).where("k = 1").select("item_key", "only")
    other = items.join(alone, "item_key").select("item_key", "item_id", F.size("w").alias("n"), F.col("w").alias("item_words"), "only", F.posexplode("w").alias("q", "term")).where("q != only")
    rank = Window.partitionBy("item_key").orderBy(F.coalesce("df", F.lit(0)), F.abs(F.col("q") - F.col("only")), "q")
    other = other.join(df, "term", "left").withColumn("rank", F.row_number().over(rank)).where("rank = 1")
    return places.unionByName(other.select(*places.columns))


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, s, e`` of every proximity match of every document row: passages with words put in or changed between two anchors."""
    items = stage(benchmark.select(F.monotonically_increasing_id().alias("item_key"), F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0), "items")
    df = stage(frequencies(docs, items.select(F.explode("w").alias("term")).distinct()), "frequencies")
    places = stage(proximity_places(items, df, window), "anchors")
    index = build_index(docs, places.select("term").distinct(), window + 1)
    return proximity_matches(index, places, window).join(index.select("row", "doc_id"), "row").select("doc_id", "item_id", "s", "e")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated``."""
    items = stage(benchmark.select(F.monotonically_increasing_id().alias("item_key"), F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0), "items")
    df = frequencies(docs, items.select(F.explode("w").alias("term")).distinct())
    places = stage(anchors(items, df, window), "anchors")
    index = build_index(docs, places.select("term").distinct(), window)
    hits = stage(phrase_matches(index, places, window).distinct(), "hits")
    # the union of the runs of a row: what each adds beyond the furthest end before it
    order = Window.partitionBy("row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.greatest(F.col("e") + 1 - F.greatest(F.col("s"), F.coalesce(F.max("e").over(order) + 1, F.lit(0))), F.lit(0))
    covered = hits.select("row", "s", "e").distinct().select("row", gain.alias("gain")).groupBy("row").agg(F.sum("gain").cast("long").alias("n_hit"))
    listed = hits.select("row", "item_key", "item_id").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("ids"))
    out = index.drop("postings").join(covered.join(listed, "row"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "text_hash", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; repeated rows and null ids stay or go by their text."""
    i, h, bad_i, bad_h = (f"{c}_{uuid4().hex}" for c in ("id", "h", "id", "h"))
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias(bad_i), F.col("text_hash").alias(bad_h)).distinct()
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    bad = stage(bad, "contaminated")
    maybe = sieve(bad, bad_h)(F.col(h))  # only what may go is joined
    out = keyed.where(maybe).join(bad, F.col(i).eqNullSafe(F.col(bad_i)) & (F.col(h) == F.col(bad_h)), "left_anti")
    return keyed.where(~maybe).unionByName(out).select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("text_hash")


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of all ``documents`` with all of ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return proximity(docs, items)


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT k, item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS x
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT dp.r, dp.i, bw.k, bw.item_id, bw.n FROM (SELECT DISTINCT n FROM bw) s
    JOIN dp ON dp.i + s.n - 1 <= len(dp.w) JOIN bw ON bw.n = s.n AND bw.x = array_to_string(dp.w[dp.i : dp.i + s.n - 1], ' ')),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, k, item_id FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c USING (r) LEFT JOIN listed l USING (r)
"""
