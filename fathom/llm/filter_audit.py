"""Operator 13: how filters of a corpus interact, from one pass over it.

Every document fails some of five filters: a mask of five bits.  For each part and label the pass only adds up
32 signed parity sums, W[S] = sum of (-1) ** |S & mask|, the Walsh-Hadamard transform of the mask counts.  The
transform is its own inverse but for a factor of 32, so the counts come back exactly; what each filter removes in
any order, alone, or on average over all orders then needs no document any more.  A document with k failures falls
to each of its filters in 120 / k of the 120 orders, which gives the sum over orders in closed form.

Filter E is about the whole table: a text that any smaller doc_id has as well.  Copies are counted, not paired:
rows are added up by text, part and label, and only the rows with a text's smallest doc_id pass.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm import store

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
SPACES = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, 1 where the text fails."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (
        n < 50,
        100 * distinct < 65 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of rows: part, good, toxic, mask (A to D), n_passing and n_failing of filter E.

    A row a text, part and label, so copies count once, however many they are.  A doc_id is good or toxic if any row
    of labels says so; null doc_ids have no label, and E, which compares doc_ids, neither fails nor meets them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = store.written(rows.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    says = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.filter("doc_id IS NOT NULL").join(says, "doc_id", "left")
    unknown = rows.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    label = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    own = ("digest", "part", "mask", "good", "toxic")
    # repeated rows of a doc_id are alike for E; known rows are dealt by doc_id already
    ids = known.select("doc_id", *own[:3], *label).groupBy("doc_id", *own).agg(F.count("*").alias("n"))
    ids = ids.unionByName(unknown.groupBy("doc_id", *own).agg(F.count("*").alias("n")))
    texts = ids.groupBy(*own).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("n_null") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    return texts.select(*own[1:], passing.alias("n_passing"), (F.col("n") - passing).alias("n_failing"))


def parity_sums(counted: DataFrame) -> DataFrame:
    """part, good, toxic and w0 to w31: the signed sums."""
    last = 1 << (len(LETTERS) - 1)
    sums = []
    for s in range(MASKS):
        both = F.col("n_passing") + (-F.col("n_failing") if s & last else F.col("n_failing"))
        odd = F.bit_count(F.col("mask").bitwiseAND(F.lit(s & (last - 1)))) % 2 == 1
        sums.append(F.sum(F.when(odd, -both).otherwise(both)).alias(f"w{s}"))
    return counted.groupBy("part", "good", "toxic").agg(*sums)


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def cells(sums: DataFrame) -> DataFrame:
    """part and three arrays of 32 counts by mask: every, good, toxic; exact, as all sums are whole numbers."""
    masks, signed = F.sequence(F.lit(0), F.lit(MASKS - 1)), F.array(*(f"w{s}" for s in range(MASKS)))

    def count(mask: Column) -> Column:
        back = F.transform("w", lambda x, s: F.when(F.bit_count(s.bitwiseAND(mask)) % 2 == 1, -x).otherwise(x))
        return F.shiftright(_added(back), len(LETTERS))

    # a part has four labels at most
    labelled = sums.withColumn("w", signed).select("part", F.struct("good", "toxic", F.transform(masks, count).alias("n")).alias("label"))
    parts = labelled.groupBy("part").agg(F.collect_list("label").alias("labels"))

    def of(some) -> Column:
        return F.transform(masks, lambda m: _added(F.transform("labels", lambda x: F.when(some(x), x["n"][m]).otherwise(0))))

    return parts.select("part", of(lambda x: F.lit(True)).alias("every"), of(lambda x: x["good"]).alias("good"), of(lambda x: x["toxic"]).alias("toxic"))


def _steps() -> Column:
    """All orders of the filters and their steps: order, step, bit of the step's filter, bits of those before it."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        name, before = "".join(LETTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            rows.append(f"('{name}', {step}, {1 << i}, {before})")
            before |= 1 << i
    return F.expr(f"CAST(array({', '.join(rows)}) AS ARRAY<STRUCT<filter_order: STRING, step: INT, bit: INT, earlier: INT>>)")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs has doc_id, text and source, labels doc_id, quality and toxic; other columns are ignored.  Null texts are
    empty ones (no word, no sign, copies of each other), a null source is the part "", texts of any length are taken
    whole, and repeated rows each count.  Without documents there are no parts, so no rows.
    """
    each = cells(parity_sums(failures(docs, labels))).select("*", F.explode(_steps()).alias("s"))

    def total(counts: str, wanted) -> Column:
        """Sum of the counts whose mask is wanted."""
        return _added(F.transform(counts, lambda n, mask: F.when(wanted(mask), n).otherwise(0)))

    bit, earlier = F.col("s.bit"), F.col("s.earlier")
    falls = lambda mask: (mask.bitwiseAND(bit) != 0) & (mask.bitwiseAND(earlier) == 0)
    share = F.transform("every", lambda n, mask: F.when(mask.bitwiseAND(bit) != 0, F.lit(120) / F.bit_count(mask)).otherwise(0).cast("long") * n)
    return each.select(
        "part", "s.filter_order", "s.step",
        total("every", lambda mask: mask.bitwiseAND(earlier.bitwiseOR(bit)) == 0).alias("kept"),
        total("every", falls).alias("removed"),
        total("every", lambda mask: (mask.bitwiseAND(bit) != 0) & (mask.bitwiseAND(earlier) != 0)).alias("redundant"),
        F.element_at("every", bit + 1).alias("unique_fails"),
        total("good", falls).alias("good_lost"),
        total("toxic", falls).alias("toxic_lost"),
        _added(share).alias("shapley"),
    )


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: By counting documents themselves, order by order, in DuckDB's words.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT part, EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic,
         map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
  FROM words d),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
masks AS (
  SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL),
judged AS (
  SELECT part, filter_order, step, x, n, good, toxic, f[x] AS fails,
         len(list_filter(string_split(before, ''), lambda y: y <> '' AND f[y])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) AS k
  FROM masks, steps),
counted AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
