"""Operator 8: benchmark decontamination by winnowing, in DataFrame expressions only.

Of the hashes of all runs of ``K`` words, the smallest of every ``WINDOW - K + 1`` consecutive ones is a
fingerprint, so any span of ``WINDOW`` words shares one with its copy.  Distinct fingerprints of documents meet
those of the benchmark; only documents with a hit go on.  There the hits are extended: each document window that
is also an item window covers its words.  Items below ``WINDOW`` words are one window of their own length, which
may hold no fingerprint of a document, so documents' runs of just those lengths are looked up as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

K, WINDOW = 4, 10
# explode() would have Spark test the array's size in a filter that it pushes below the steps that build the array,
# where they are written out again and again; explode_outer() has no such filter.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_in(text: Column) -> Column:
    """Runs of 0-9, letters and all beyond ASCII; case is folded by hashes."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def _folded(word: Column) -> Column:
    """A to Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(_folded(w)))


def _pairwise(x: Column, y: Column, by: int, f) -> Column:
    """f of each element of x and the element of y that is by places further on; null beyond the end."""
    return F.zip_with(x, F.slice(y, F.lit(by + 1), F.greatest(F.size(y), F.lit(1))), f)


def _mix(a: Column, b: Column) -> Column:
    """Null where a run would go beyond the end."""
    return F.when(b.isNotNull(), F.xxhash64(a, b))


def runs(frame: DataFrame, hashes: str, lengths: range | tuple, to: str) -> DataFrame:
    """Adds arrays ``{to}{n}`` for each n: the hash of the run of n words that begins at each place, null at the end.

    Built by doubling; each step is a column of its own so that none is computed twice.
    """
    for n in lengths:
        column, have = None, 0
        part = 1
        rest = n
        while rest:
            if rest & 1:
                name = f"_{to}_p{part}"
                if name not in frame.columns:
                    frame = _power(frame, hashes, part, to)
                column = F.col(name) if column is None else _pairwise(column, F.col(name), have, _mix)
                have += part
            rest >>= 1
            part <<= 1
        frame = frame.withColumn(f"{to}{n}", column)
    return frame


def _power(frame: DataFrame, hashes: str, n: int, to: str) -> DataFrame:
    name = f"_{to}_p{n}"
    if name in frame.columns:
        return frame
    if n == 1:
        return frame.withColumn(name, F.col(hashes))
    frame = _power(frame, hashes, n // 2, to)
    half = F.col(f"_{to}_p{n // 2}")
    return frame.withColumn(name, _pairwise(half, half, n // 2, _mix))


def fingerprints(frame: DataFrame, hashes: str, to: str) -> DataFrame:
    """Adds the array of distinct fingerprints: minima of the run hashes over every window of words."""
    frame = runs(frame, hashes, (K,), "run")
    least, have = F.col(f"run{K}"), 1
    want = WINDOW - K + 1
    while have < want:
        step = min(have, want - have)
        frame = frame.withColumn(f"_least{have + step}", _pairwise(least, least, step, lambda a, b: F.least(a, b)))
        have += step
        least = F.col(f"_least{have}")
    # least() skips nulls, so the windows at the end are minima of what there is: more fingerprints, none fewer
    return frame.withColumn(to, F.array_compact(F.array_distinct(least)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Written table of item_id, n (words of the window), h and g (two hashes of it)."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), hashes_of(words_in(F.col("text"))).alias("_h")).filter(F.size("_h") > 0)
    words = store.written(words.withColumn("n", F.least(F.size("_h"), F.lit(WINDOW))), "items")
    found = [_windows(words.filter(F.col("n") == n), n, "item_id") for n in lengths_of(words)]
    empty = words.limit(0).select("item_id", F.lit(0).alias("at"), "n", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"))
    return store.written(reduce(DataFrame.union, found, empty).select("item_id", "n", "h", "g").distinct(), "windows")


def lengths_of(windows: DataFrame) -> list[int]:
    """The windows' lengths: at most WINDOW different ones."""
    return sorted(r["n"] for r in windows.select("n").distinct().collect())


def _windows(frame: DataFrame, n: int, *keys: str) -> DataFrame:
    """keys, at, n, h and g of each run of n words; h and g are two hashes of it. frame: keys and the word hashes _h."""
    frame = frame.select(*keys, "_h", F.transform("_h", lambda x: F.xxhash64(x, F.lit(1))).alias("_g"))
    frame = runs(runs(frame, "_h", (n,), "h"), "_g", (n,), "g").select(*keys, F.arrays_zip(F.col(f"h{n}").alias("h"), F.col(f"g{n}").alias("g")).alias("w"))
    return frame.select(*keys, F.posexplode_outer("w").alias("at", "w")).select(*keys, "at", F.lit(n).alias("n"), "w.h", "w.g").filter("h IS NOT NULL")


def text_key() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_t"] == b["_t"])


def matched_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Written table of doc_id, _t (text_key), at, n and item_id: the item's window of n words occurs at word at.

    Once for repeated rows.
    """
    windows = item_windows(benchmark)
    lengths = lengths_of(windows)
    bench = fingerprints(benchmark.select(hashes_of(words_in(F.col("text"))).alias("_h")), "_h", "_f")
    prints = bench.select(F.explode_outer("_f").alias("f")).distinct()

    hashed = docs.select("doc_id", text_key().alias("_t"), hashes_of(words_in(F.col("text"))).alias("_h"))

    looked = [fingerprints(hashed, "_h", "_f").select("doc_id", "_t", F.explode_outer("_f").alias("f"))]
    small = tuple(n for n in lengths if n < WINDOW)
    if small:  # items with too few words for a sure fingerprint
        short = windows.filter(F.col("n") < WINDOW).select(F.col("h").alias("f"))
        prints = prints.union(short).distinct()
        frame = runs(hashed, "_h", small, "h")
        looked += [frame.select("doc_id", "_t", F.explode_outer(F.array_distinct(f"h{n}")).alias("f")) for n in small]
    candidates = store.written(reduce(DataFrame.union, looked).join(prints, "f", "left_semi").select("doc_id", "_t").distinct(), "candidates")

    closer = hashed.join(candidates, same(hashed, candidates), "left_semi").dropDuplicates(["doc_id", "_t"])
    found = [_windows(closer, n, "doc_id", "_t") for n in lengths]
    if not found:
        return hashed.limit(0).select("doc_id", "_t", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("item_id"))
    return store.written(reduce(DataFrame.union, found).join(windows, ["n", "h", "g"]).select("doc_id", "_t", "at", "n", "item_id"), "spans")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs (doc_id, text).

    benchmark: item_id, text.  Null texts have no words; an item without words has no window; an empty benchmark
    hits nothing, and no documents give no rows.  Rows with the same doc_id and text get the same result, once for
    each; rows with the same doc_id and different texts are told apart.  Texts of any length are looked at whole, and
    further columns of any name are ignored.
    """
    spans = matched_spans(docs, benchmark)
    counted = docs.select("doc_id", text_key().alias("_t"), F.size(words_in(F.col("text"))).cast("long").alias("n_words"))
    covered = spans.select("doc_id", "_t", "at", "n").distinct().select("doc_id", "_t", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    covered = covered.groupBy("doc_id", "_t").agg(F.count("*").alias("n_hit"))
    items = spans.select("doc_id", "_t", "item_id").distinct().groupBy("doc_id", "_t").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    both = covered.join(items, same(covered, items)).select(covered["doc_id"].alias("_d"), covered["_t"].alias("_u"), "n_hit", "n_items", "items_sha256")
    out = counted.join(both, counted["doc_id"].eqNullSafe(both["_d"]) & (counted["_t"] == both["_u"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: all documents against all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in DuckDB's words.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
spans AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM spans) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM spans) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
