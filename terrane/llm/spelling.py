"""Spelling variants: words that differ by one code point, grouped by what they share, without pairs of them.

A word is in one wildcard group for each of its places (place, prefix, suffix): the members differ in that place only, so a group
has no more of them than the alphabet has letters (LETTERS), and each member learns from it how many others there are and the
most frequent of these.  Each word's deletions join the vocabulary: where one is a word, the two are near by an insertion.
What a word learns from all its groups and joins comes together in one aggregation.

Defined results: null texts have no words; a null id counts as the empty text in the crc; repeated rows count each; equally
frequent near words go by code points; empty tables have no words; texts are taken whole.  Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrane.llm.common import remove, written

#: Letters of words: A-Z, lower-cased, a-z and the range after them.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Least code points and occurrences of a word; how much more frequent its form is; a run whose crc is a multiple loses a letter.
SHORTEST, LEAST, TIMES, EVERY = 5, 3, 2, 97


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n, its occurrences.  every: runs whose crc32 with their document's id it divides lose one code point; None: none."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run")
    if every:
        h = F.crc32(F.concat(F.col("id"), F.lit(":"), word).cast("binary"))
        at = (h % F.length(word)).cast("int")
        runs = runs.select("run", F.when(h % every == 0, at).alias("at"))
        word = F.when(F.col("at").isNull(), word).otherwise(F.concat(F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.length(word))))
    counted = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _places(word) -> F.Column:
    return F.sequence(F.lit(1), F.length(word))


def _without(word, i) -> F.Column:
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def near(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, best (negated count and word of the most frequent near word, null without one); vocabulary: word, n."""
    word, me = F.col("word"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("word"))
    # Replacements: a group's members in order, so that the first two are all that any member needs.
    wild = F.transform(_places(word), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit("?"), F.substring(word, i + 1, F.length(word))))
    groups = vocabulary.select(F.explode(wild).alias("group"), me.alias("me")).groupBy("group").agg(F.array_sort(F.collect_list("me")).alias("all")).where(F.size("all") > 1)
    first, second = F.col("all")[0], F.col("all")[1]
    told = groups.select(first.alias("first"), second.alias("second"), (F.size("all") - 1).cast("long").alias("others"), F.explode("all").alias("me"))
    replaced = told.select(F.col("me.word").alias("word"), F.col("others").alias("n_near"), F.when(F.col("me.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # Insertions and deletions: the shorter word is a deletion of the longer one, and each tells the other.
    shorter = vocabulary.select(F.explode(F.array_distinct(F.transform(_places(word), lambda i: _without(word, i)))).alias("short"), me.alias("long"))
    joined = shorter.join(vocabulary.select(F.col("word").alias("short"), (-F.col("n")).alias("m")), "short")
    both = joined.select(F.explode(F.array(F.struct(F.col("long.word").alias("word"), F.struct("m", F.col("short").alias("word")).alias("best")), F.struct(F.col("short").alias("word"), F.col("long").alias("best")))).alias("t"))
    moved = both.select("t.word", F.lit(1).cast("long").alias("n_near"), "t.best")
    alone = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(joined.schema["long"].dataType).alias("best"))
    every = alone.unionByName(replaced.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")).unionByName(moved.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best"))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def forms(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word, where it is `times` as frequent at least."""
    far = F.col("best.m") * -1 >= F.col("n") * times
    return near(vocabulary).select("word", "n", "n_near", F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """formed with root: where following forms ends.  A form is more frequent than its word, so there are no circles.

    Each round looks up the root so far of the root so far, which doubles the steps gone; counts grow `times` fold at each step,
    so the rounds are few.  Only words with a form take part.
    """
    spark = formed.sparkSession
    moving = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = moving.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = written(moving.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        remove(moving)
        moving = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return formed.join(moving, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the documents."""
    vocabulary = written(words(docs, id_col, text_col, every, shortest, least), "words")
    formed = written(forms(vocabulary, times), "forms")
    remove(vocabulary)
    return rooted(formed).select("word", "form", "root", "n", "n_near", "form_n")
