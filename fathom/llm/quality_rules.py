"""Operator 5: line-first quality rules, in DataFrame expressions only.

Punctuation, navigation and boilerplate rules judge each line.  Lines that fail are removed, and a document that
loses too much of its text, or fails the base rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Punctuation that says nothing of sentences.
UNSAID = "\"#%&'*/@\\"
#: A document may lose this share (in percent) of the characters of its lines.
MOST_LOST = 40
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|(accept|use) (all )?cookies|enable javascript|lorem ipsum|click here|sign (in|up) (to|for)|subscribe to|share this|back to top|skip to content)\b"


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _count(text: Column, part: str) -> Column:
    """Occurrences of a fixed string."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def line_fails(line: Column) -> Column:
    """True for a line that a rule removes."""
    n, spaces = F.length(line), _count(line, " ")
    shouted = 10 * _count(line, "!!") > spaces + 1
    symbols = 20 * F.regexp_count(line, F.lit(SYMBOLS)) > n
    # sentences of any script end in other punctuation; these signs of it are no marks of sentences
    unpunctuated = (spaces >= 30) & ~F.translate(line, UNSAID, "").rlike(r"\p{Po}")
    navigation = _count(line, " | ") >= 2
    boilerplate = (spaces < 25) & line.rlike(BOILERPLATE)
    return shouted | symbols | unpunctuated | navigation | boilerplate


def repeated_words(hashes: Column, n: Column) -> tuple[Column, Column]:
    """Hashes of the 3-word windows of a document's word hashes, and whether one occurs twice."""
    two = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice(hashes, F.lit(3), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0)))
    return windows, F.size(F.array_distinct(windows)) < F.size(windows)


def judge(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_percent, clean_text, kept.

    A null text is an empty one: no words, so base_failed.  Columns of docs other than these stay; ones of these
    names are replaced.  Rows are judged one by one, so repeated rows get the same verdict; texts of any length are
    judged whole, and no rows give none.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_percent", "clean_text", "kept")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in made)).alias("_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(own, text.alias("_text"), words_in(text).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    two = one.select(
        "_row", "_text", "_lines",
        F.size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_clean"),
    )
    windows, twice = repeated_words(F.col("_hashes"), F.col("n_words"))
    three = two.withColumn("_windows", windows)
    three = three.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    beside = F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.size("_windows") + 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    four = three.withColumn("_found", F.sort_array(F.array_distinct(F.flatten(F.filter(beside, lambda p: p.isNotNull())))))
    covered = F.aggregate(F.zip_with("_found", F.slice("_found", F.lit(2), F.size("_found") + 1), lambda p, q: F.coalesce(F.least(q - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    total, left = F.length(F.array_join("_lines", "")), F.length(F.array_join("_clean", ""))
    five = four.select(
        "_row",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_found").isNotNull() & (F.size("_found") > 0), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(total > 0, 100 * (total - left) / total).otherwise(0.0).alias("lost_percent"),
        F.array_join("_clean", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    six = five.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_percent") <= MOST_LOST))
    return six.select("_row.*", *made)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: all documents."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*columns)


#: The same in DuckDB's words.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
twice AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id),
judged AS (
  SELECT doc_id, unnest(lines) AS x FROM d),
failing AS (
  SELECT doc_id, x, length(x) AS n, length(x) - length(replace(x, ' ', '')) AS spaces FROM judged),
lost AS (
  SELECT doc_id, sum(n) AS total, sum(CASE WHEN
      10 * (n - length(replace(x, '!!', ''))) / 2.0 > spaces + 1
      OR 20 * len(regexp_extract_all(x, '[#*$%&|<>]')) > n
      OR (spaces >= 30 AND NOT regexp_matches(translate(x, '"#%&''*/@\', ''), '\p{Po}'))
      OR (n - length(replace(x, ' | ', ''))) / 3.0 >= 2
      OR (spaces < 25 AND regexp_matches(x, '(?i)\b(all rights reserved|terms of (use|service)|privacy policy|(accept|use) (all )?cookies|enable javascript|lorem ipsum|click here|sign (in|up) (to|for)|subscribe to|share this|back to top|skip to content)\b'))
    THEN n ELSE 0 END) AS gone
  FROM failing GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(100.0 * gone / total, 0) AS lost_percent
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_percent <= 40 AS kept
FROM base
"""
