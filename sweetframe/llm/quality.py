"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a text's measures. Expectation-maximisation over the counts of vote
patterns estimates how often each rule's votes are bad on good texts and on texts that are bad in one of several ways, and
how many texts are so; a text is kept where its posterior probability of being good is at least one half, and no hard rule
fails it.

Rules that look at one thing are not independent given good and bad alone; given the way of being bad they nearly are. Each
way is seeded by two or more rules that should agree on it. What rules agree on becomes a way; a rule whose bad votes stand
alone comes out as no better on bad texts than on good ones, and drops nothing by itself. A few texts' worth of prior
counts keep the estimates off 0 and 1; nothing else bounds them.

All of it is column expressions. Measures are computed once and written; a pattern table has at most 3 ** rules rows, and
each round of the estimation is one aggregation over it, of which only the new parameters come to the driver.

Defined cases: null, empty and blank texts have no words, all measures 0, and fail the hard rule; ties of the posterior
keep; repeated rows get the same answer each; very long texts are rows like others; an empty table gives no rows; a column
of the table with the name of a measure or a result is kept with ``_`` appended. Words of repeated windows are found by
64-bit hashes of the windows, and then told apart by the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweetframe.llm._common import cut, freed, spare

_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(windows: Column, hashes: Column, width: int) -> Column:
    """Words in windows that occur twice or more; windows of ``width`` words in order, and their hashes.

    Where hashes repeat, windows are sorted by hash and words, so that equal ones are neighbours.
    """
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["x"] == y["x"]), F.lit(False))

    def places(ordered: Column) -> Column:
        none = F.slice(F.transform(ordered, lambda t: F.when(F.lit(False), t)), 1, 1)
        beside = F.arrays_zip(ordered.alias("own"), F.concat(none, ordered).alias("before"), F.slice(ordered, 2, F.size(ordered)).alias("after"))
        twice = F.filter(beside, lambda t: same(t["own"], t["before"]) | same(t["own"], t["after"]))
        return F.sort_array(F.transform(twice, lambda t: t["own"]["i"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda a, i: F.struct((i + width).alias("end"), (a["sum"] + width - F.greatest(F.lit(0), a["end"] - i)).alias("sum"))
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(F.get(hashes, i).alias("h"), x.alias("x"), i.alias("i"))))
    counted = _let(ordered, lambda o: F.aggregate(places(o), start, step, lambda a: a["sum"]))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_distinct", "n_odd_words", "n_marks", "n_upper_starts")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns and the MEASURES.

    Odd words aren't letters with at most one mark of punctuation behind; upper starts are words that begin in upper case.
    """
    own = spare(docs.columns, "__text")
    docs = freed(docs.withColumnRenamed(text, own), MEASURES)
    others = [c for c in docs.columns if c != own]
    whole = F.coalesce(F.col(own), F.lit(""))
    words = F.array_remove(F.split(whole, _SPACE), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = {
        "n_symbols": "[#*$%&|<>]",
        "n_capitals": "\\p{Lu}",
        "n_odd_words": "(?<!\\S)(?!\\p{L}++[.,;:?!]?(?!\\S))\\S",
        "n_marks": "[!?]",
        "n_upper_starts": "(?<!\\S)\\p{Lu}",
    }
    counted = [F.regexp_count(whole, F.lit(pattern)).alias(name) for name, pattern in counts.items()]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    split = docs.select(row.alias("row"), words.alias("w"), lines.alias("l"), *counted)
    n = F.size("w")
    shifted = lambda k: F.slice("w", k, F.greatest(n, F.lit(1)))
    windows = F.slice(F.arrays_zip(F.col("w").alias("a"), shifted(2).alias("b"), shifted(3).alias("c")), 1, F.greatest(n - 2, F.lit(0)))
    hashed = split.withColumn("h", F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"])))  # no lambda in a lambda: each would be run anew
    found = {
        "n_words": n,
        "word_chars": F.length(F.array_join("w", "")),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": _covered(windows, F.col("h"), 3),
        "n_distinct": F.size(F.array_distinct("w")),
    } | {c: F.col(c) for c in counts}
    return hashed.select(*(["row.*"] if others else []), *[found[c].cast("long").alias(c) for c in MEASURES])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the measures; a text without words is bad to all."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    none = F.col("n_words") == 0
    share = lambda c, of=n: F.col(c) / of
    lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_lines", "word_chars"))
    return {
        "length": _vote(n >= 80, n < 50),
        "repeats": _vote(share("n_repeat_words") < 0.1, none | (share("n_repeat_words") > 0.25)),
        "variety": _vote((share("n_distinct") > 0.35) | (n > 2000), none | ((share("n_distinct") < 0.2) & (n <= 2000))),
        "lines": _vote(F.col("n_dup_lines") == 0, none | ((F.col("n_dup_lines") > 2) & (share("n_dup_lines", lines) > 0.3))),
        "symbols": _vote(share("n_symbols") < 0.02, none | (share("n_symbols") > 0.1)),
        "odd_words": _vote(share("n_odd_words") < 0.1, none | (share("n_odd_words") > 0.3)),
        "marks": _vote(share("n_marks") < 0.05, none | (share("n_marks") > 0.2)),
        "letters": _vote(share("word_chars").between(3, 9), none | ~share("word_chars").between(2, 12)),
        "capitals": _vote(share("n_capitals", chars) < 0.15, none | (share("n_capitals", chars) > 0.4)),
        "upper_starts": _vote(share("n_upper_starts") < 0.45, none | (share("n_upper_starts") > 0.75)),
    }


def hard_fail() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The ways of being bad, by the rules that should agree on them.
WAYS = (("repeats", "variety", "lines"), ("symbols", "odd_words"), ("capitals", "upper_starts", "marks"), ("letters", "odd_words"))

#: Before any text is seen: the share of bad votes among a rule's votes on good texts, and on texts that are bad in a way
#: that it looks at; how many votes that weighs; and the share of good texts.
START, WEIGHT, SHARE_GOOD = (0.01, 0.7), 10.0, 0.9


@dataclass(frozen=True)
class Fit:
    """By class, good first, then each way of being bad: the share of each rule's votes that are bad, and of texts."""

    bad_votes: tuple[dict[str, float], ...]
    share: tuple[float, ...]


def seeded(names: list[str], ways: tuple[tuple[str, ...], ...]) -> Fit:
    classes = ({c: START[c in way] for c in names} for way in ((), *ways))
    return Fit(tuple(classes), (SHARE_GOOD, *[(1 - SHARE_GOOD) / len(ways)] * len(ways)))


def _odds(fit: Fit, names: list[str]) -> list[Column]:
    """Of each class against good, given the columns of votes; abstaining says nothing.

    Logarithms are looked up in arrays by vote, so that the generated code is the same in each round and compiled once.
    """
    good, out = fit.bad_votes[0], []
    for rates, share in zip(fit.bad_votes, fit.share, strict=True):
        told = [(log(rates[c] / good[c]), 0.0, log((1 - rates[c]) / (1 - good[c]))) for c in names]
        terms = [f"get(array({', '.join(f'{x!r}D' for x in t)}), `{c}` + 1)" for c, t in zip(names, told, strict=True)]
        out.append(F.expr(f"exp({log(share / fit.share[0])!r}D + {' + '.join(terms)})"))
    return out


def posterior(fit: Fit, names: list[str]) -> Column:
    """Probability of good, given the columns of votes."""
    return 1 / reduce(add, _odds(fit, names))


def estimate(patterns: DataFrame, names: list[str], ways: tuple[tuple[str, ...], ...] = WAYS, rounds: int = 40, enough: float = 1e-4) -> Fit:
    """patterns: a column of votes for each rule, and n. Rounds go on until no share changes by more than ``enough``."""
    fit = first = seeded(names, ways)
    classes = range(len(first.share))
    for _ in range(rounds):
        odds = patterns.select("n", F.array(*names).alias("votes"), F.array(*_odds(fit, names)).alias("odds"))
        parts = odds.select("n", "votes", F.expr("transform(odds, x -> n * x / aggregate(odds, 0D, (a, y) -> a + y))").alias("part"))
        sums = [F.sum(F.col("part")[k]).alias(f"class_{k}") for k in classes]
        told = parts.select("n", "part", F.posexplode("votes").alias("rule", "vote")).groupBy("rule", "vote").agg(F.sum("n").alias("n"), *sums).collect()
        if not told:
            break
        got = {(names[r["rule"]], r["vote"], k): r[f"class_{k}"] for r in told for k in classes}
        texts = sum(r["n"] for r in told if r["rule"] == 0)
        of_class = [sum(r[f"class_{k}"] for r in told if r["rule"] == 0) for k in classes]
        votes = lambda c, v, k: got.get((c, v, k), 0.0)  # noqa: E731, B023
        rate = lambda c, k: (votes(c, -1, k) + WEIGHT * first.bad_votes[k][c]) / (votes(c, -1, k) + votes(c, 1, k) + WEIGHT)  # noqa: E731, B023
        last, fit = fit, Fit(tuple({c: rate(c, k) for c in names} for k in classes), tuple((n + WEIGHT * s) / (texts + WEIGHT) for n, s in zip(of_class, first.share, strict=True)))
        moved = [abs(x - y) for x, y in zip(fit.share, last.share, strict=True)] + [abs(x[c] - y[c]) for x, y in zip(fit.bad_votes, last.bad_votes, strict=True) for c in names]
        if max(moved) <= enough:
            break
    return fit


RESULTS = ("base_failed", "posterior", "kept")


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """measures(docs) with base_failed, posterior and kept."""
    votes = rules()
    measured = cut(measures(freed(docs, RESULTS), text))
    # texts that a hard rule fails are decided; what is bad among the others is to be learnt from the others
    patterns = cut(measured.where(~hard_fail()).select(*[c.alias(k) for k, c in votes.items()]).groupBy(*votes).agg(F.count("*").alias("n")))
    fit = estimate(patterns, list(votes))
    own = [f"`{c}`" for c in measured.columns]
    vote_columns = {c: spare(measured.columns, f"__{c}") for c in votes}
    voted = measured.select(*own, *[v.alias(vote_columns[c]) for c, v in votes.items()])
    fit = Fit(tuple({vote_columns[c]: x for c, x in rates.items()} for rates in fit.bad_votes), fit.share)
    judged = voted.select(*own, hard_fail().alias("base_failed"), posterior(fit, list(vote_columns.values())).alias("posterior"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
