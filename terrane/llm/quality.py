"""Quality rules combined by weak supervision; DataFrame functions only.

Each rule votes 1 (good), -1 (bad) or abstains with 0.  The votes of all documents are counted by pattern (at most
3 to the number of rules, whatever the input's size), expectation-maximisation on those counts estimates how often each
vote of each rule is right, and the posterior probability of being good decides.

Null and empty texts have no words, so they fail the base rule.  An empty table gives an empty result (the model is then
its prior).  Repeated rows each get the same verdict.  Features live in one struct column whose name the caller chooses,
so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from terrane.llm.common import WHITE, free_name, written

SYMBOLS = "[#*$%&|<>]"


def with_features(df: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """df with a struct column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper.

    Row-local, so nothing is shuffled.  Repeated 3-word windows are told by 64-bit hashes with their positions: sorted,
    equal hashes are neighbours, and the covered words are counted from the sorted positions.
    """
    a, b, c, d, e, g = (free_name(f"{into}_{i}", [*df.columns, into]) for i in "abcdeg")
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    out = df.withColumn(a, F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(g, F.transform(F.col(a), lambda w: F.xxhash64(w)))
    word = F.col(g)
    out = out.withColumn(b, F.slice(F.transform(word, lambda h, i: F.xxhash64(h, F.get(word, i + 1), F.get(word, i + 2))), F.lit(1), F.greatest(F.size(word) - 2, F.lit(0))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    out = out.withColumn(e, lines)
    repeats = F.size(F.col(b)) > F.size(F.array_distinct(F.col(b)))
    out = out.withColumn(c, F.when(repeats, F.sort_array(F.transform(F.col(b), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.col(c)
    again = F.filter(pairs, lambda x, i: F.get(pairs, i - 1)["h"].eqNullSafe(x["h"]) | F.get(pairs, i + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn(d, F.sort_array(F.transform(again, lambda x: x["i"])))
    at = F.col(d)
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.get(at, i + 1) - p)), F.lit(0), lambda s, x: s + x)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return out.withColumn(
        into,
        F.struct(
            F.size(F.col(a)).cast("long").alias("n_words"),
            F.length(F.array_join(a, "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            (F.size(F.col(e)) - F.size(F.array_distinct(F.col(e)))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(F.col(e)).cast("long").alias("n_lines"),
            count("[A-Z]").alias("n_upper"),
        ),
    ).drop(a, b, c, d, e, g)


def rules(q: Column) -> dict[str, tuple[Column, Column]]:
    """Name: (votes bad, votes good); neither: abstains.  Shares are compared by products, so no division by zero.

    Most rules know one fault each and abstain where they don't find it; one also speaks for a text.
    """
    n, chars, never = q["n_words"], q["word_chars"], F.lit(False)
    return {
        "length": (n < 50, never),
        "repeats": (100 * q["n_repeat_words"] > 40 * n, never),
        "lines": (100 * q["n_dup_lines"] > 30 * q["n_lines"], never),
        "symbols": (100 * q["n_symbols"] > 20 * n, never),
        "word_length": ((chars < 2 * n) | (chars > 20 * n), (2 * chars >= 7 * n) & (chars <= 8 * n)),
        "capitals": (100 * q["n_upper"] > 35 * chars, never),
    }


def votes(q: Column) -> dict[str, Column]:
    return {k: F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in rules(q).items()}


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


#: (P(vote | bad), P(vote | good)) of each vote before any data, how much of the rows this counts for, P(good), and the
#: most of the good texts that a rule may be taken to call bad.
BELIEF = {-1: (0.3, 0.01), 1: (0.5, 0.9)}
WEIGHT, PRIOR, FALSE_ALARM = 0.5, 0.8, 0.01


def fit(df: DataFrame, into: str = "quality", rounds: int = 60) -> dict:
    """The model from all rows' votes: {rule: {vote: (P(vote | bad), P(vote | good))}}; abstaining says nothing.

    The driver gets one row a pattern of votes: at most 3 ** 6 = 729, whatever the input's size.  Each round takes the
    posterior of each pattern, then each rule's rates from the posteriors.  Pseudo-counts (WEIGHT of the rows, and one)
    hold the rates near BELIEF, so that a rule which no other speaks on keeps its say, and good stays good.
    """
    named = votes(F.col(into))
    rows = df.select([v.alias(k) for k, v in named.items()]).groupBy(*named).count().collect()
    patterns = [({k: r[k] for k in named}, r["count"]) for r in rows]
    weak = 1 + WEIGHT * sum(n for _, n in patterns)
    before = (weak * (1 - PRIOR), weak * PRIOR)
    model = {k: dict(BELIEF) for k in named}
    for _ in range(rounds):
        mass, cast = list(before), {k: {v: [before[y] * BELIEF[v][y] for y in (0, 1)] for v in BELIEF} for k in named}
        for seen, n in patterns:
            p = posterior(model, seen)
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                mass[y] += w
                for k, v in seen.items():
                    if v:
                        cast[k][v][y] += w
        model = {k: {v: (cast[k][v][0] / mass[0], min(cast[k][v][1] / mass[1], FALSE_ALARM if v < 0 else 1)) for v in BELIEF} for k in named}
    return model


def posterior(model: dict, seen: dict) -> float:
    odds = math.log(PRIOR / (1 - PRIOR)) + sum(_weight(model[k][v]) for k, v in seen.items() if v)
    return 1 / (1 + math.exp(-odds))


def _weight(rates: tuple[float, float]) -> float:
    return math.log(rates[1] / rates[0])


def probability(model: dict, q: Column) -> Column:
    """The posterior probability of being good, as an expression."""
    odds = F.lit(math.log(PRIOR / (1 - PRIOR)))
    for k, v in votes(q).items():
        odds = odds + F.when(v == -1, _weight(model[k][-1])).when(v == 1, _weight(model[k][1])).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(df: DataFrame, model: dict, into: str = "quality", least: float = 0.5) -> DataFrame:
    """df with quality_probability, base_failed and kept added to the struct column."""
    q = F.col(into)
    p = probability(model, q)
    return df.withColumn(into, q.withField("probability", p).withField("base_failed", base_failed(q)).withField("kept", ~base_failed(q) & (p >= least)))


def keep_good(df: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df that the rules keep, with df's columns.  Features are written once, then counted and judged."""
    into = free_name("quality", df.columns)
    scored = written(with_features(df, text_col, into), "quality")
    model = fit(scored.select(into), into)
    return judged(scored, model, into, least).where(F.col(into)["kept"]).drop(into)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row a document: id, features, probability, base_failed, kept.  The features are written once and read twice."""
    features = written(with_features(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "quality").select("doc_id", "quality"), "quality")
    return judged(features, fit(features), least=least).select("doc_id", "quality.*")
