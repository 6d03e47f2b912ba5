"""Which texts hold which parts, without letting every part meet every text.

A part can only be inside a text that has all of its grams (runs of characters).  A part as long as one of SIZES is its
own gram, so it meets just the texts that hold it.  Another one meets texts at the one of its grams, as long as it has
them, that the fewest texts have.  Texts are cut into the sizes that parts ask for, no others.  The texts of a gram that
stays frequent, or that many parts meet at, are split into blocks, and the parts go to each block, so no task gets all of
one gram.  Words in order are first looked for in the distinct words of the texts, which are few and short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.sources import work

GRAM = 3
#: Lengths of grams of whole texts, and of single words.
SIZES = (1, 2, GRAM, 6, 20)
WORD_SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20)
#: Texts of one gram that meet parts in one place, and about how many pairs they make there.
BLOCK, PAIRS = 20_000, 1_000_000


def _tasks(rows: DataFrame) -> int:
    """Few bytes may be many pairs, so the work is dealt out by number, not by size."""
    return 2 * max(rows.sparkSession.sparkContext.defaultParallelism, 16)


def grams(text: Column, size: int | Column = GRAM) -> Column:
    """Distinct runs of so many characters, in lower case; none for a shorter text or a null."""
    low, size = F.lower(text), F.lit(size) if isinstance(size, int) else size
    n = F.length(low) - size + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, size)))).otherwise(F.array().cast("array<string>"))


def cuts(text: Column, sizes: tuple[int, ...] = SIZES, least: int = GRAM) -> Column:
    """The grams of the longest of sizes that the text has, if that is least or more."""
    return grams(text, F.coalesce(*(F.when(F.length(F.lower(text)) >= s, s) for s in sorted(sizes, reverse=True) if s >= least), F.lit(least)))


def _cut(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """text and gram for the distinct texts, in the sizes that asked (gram) has."""
    sizes = asked.select(F.length("gram").alias("size")).distinct()
    known = texts.select("text").filter("text IS NOT NULL").distinct().repartition(_tasks(texts), "text")
    # a row for each size
    return known.join(F.broadcast(sizes), F.length(F.lower("text")) >= F.col("size")).select("text", F.explode(grams(F.col("text"), F.col("size"))).alias("gram"))


def _dealt(rarest: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """Joins rarest (gram, n, with n texts of that gram, and others) and known (text, gram), in blocks of so many texts at most, and so many pairs."""
    tasks, at = _tasks(known), ["gram", "place"]
    places = rarest.groupBy("gram").agg(F.first("n").alias("n"), F.count("*").alias("k"))
    places = places.select("gram", F.greatest(F.ceil(F.col("n") / block), F.least("n", F.ceil(F.col("n") * F.col("k") / PAIRS))).cast("int").alias("blocks"))
    dealt = known.join(places, "gram").select("text", "gram", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("place"))
    spread = rarest.drop("n").join(places, "gram").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return spread.repartition(tasks, *at).join(dealt.repartition(tasks, *at), at).drop("place")


def met(asked: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of asked (key, grams) and texts (text), both distinct, that share the rarest of the key's grams.

    A key without grams, or with one that no text has, meets nothing, nor does a null text.
    """
    each = asked.select("key", F.explode("grams").alias("gram"))
    known = _cut(texts, each).join(each.select("gram").distinct(), "gram", "left_semi")
    often = known.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(often, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).filter("x.n > 0").select("key", "x.gram", "x.n")
    return _dealt(rarest, known, block).select("key", "text")


def by_part(parts: DataFrame, least: int = GRAM, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The distinct parts of at least so many characters as keys of ``met``; one shorter than a gram is its own gram."""
    own = F.when(F.length("key") < GRAM, F.array(F.lower("key"))).otherwise(cuts(F.col("key"), sizes))
    return parts.filter(F.length("part") >= least).select(F.col("part").alias("key")).distinct().withColumn("grams", own)


def held(parts: DataFrame, texts: DataFrame, least: int = GRAM, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """part and text for each distinct text that holds a distinct part of at least so many characters, in any case."""
    low = F.lower("part")
    alone = F.length(low).isin(*sizes)
    # a part that is its own gram needs no choice, and its meetings are the results
    whole = parts.select("part").filter((F.length("part") >= least) & alone).distinct().withColumn("gram", low)
    found = _cut(texts, whole).join(whole, "gram").select("part", "text")
    rest = met(by_part(parts.filter(~alone), least, sizes), texts).filter(F.contains(F.lower("text"), F.lower("key"))).select(F.col("key").alias("part"), "text")
    return found.unionByName(rest)


def in_order(parts: DataFrame, texts: DataFrame, least: int = GRAM) -> DataFrame:
    """part and text for each distinct text that has the words of a part one after another, anything between them, in any case.

    Words end at spaces.  A part without a word of least characters finds nothing.
    """
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: w != "")
    keys = parts.select(F.col("part").alias("key")).filter("key IS NOT NULL").distinct()
    # no word goes over a space, so each lies in one word of a text; short ones tell little and are asked only alone
    long = F.filter(words("key"), lambda w: F.length(w) >= GRAM)
    telling = F.when(F.size(long) > 0, long).otherwise(F.filter(words("key"), lambda w: F.length(w) >= least))
    asked = keys.select("key", F.explode(F.array_distinct(telling)).alias("word"))
    known = texts.select("text").filter("text IS NOT NULL").distinct().select("text", F.explode(F.array_distinct(words("text"))).alias("gram"))
    often = known.groupBy("gram").agg(F.count("*").alias("n"))
    # read three times
    inside = work.written(held(asked.select(F.col("word").alias("part")), often.select(F.col("gram").alias("text")), 1, WORD_SIZES).select(F.col("part").alias("word"), F.col("text").alias("gram")).join(often, "gram"), "words")
    total = inside.groupBy("word").agg(F.sum("n").alias("total"))
    rarest = asked.join(total, "word", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "word")).alias("x")).filter("x.total > 0").select("key", "x.word")
    pairs = _dealt(rarest.join(inside, "word"), known)
    # a text that holds the word at several places is met at the first
    first = F.get(F.filter(words("text"), lambda w: F.contains(w, F.col("word"))), F.lit(0))
    escaped = F.transform(words("key"), lambda w: F.regexp_replace(w, r"([\\%_])", r"\\$1"))
    like = F.concat(F.lit("%"), F.array_join(escaped, "%"), F.lit("%"))
    return pairs.withColumn("like", like).filter(F.expr("lower(text) LIKE like")).filter(first == F.col("gram")).select(F.col("key").alias("part"), "text")
