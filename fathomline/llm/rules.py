r"""Quality rules with weak supervision.

Every rule looks at one figure of the text and votes good (1), weakly bad (-1) or strongly bad (-2), or
abstains (0).  A document is sound or one of some kinds of bad text, each of which starts as the kind
that its own rules accuse.  The share of every kind, and the probability of every vote given the
kind, are estimated by expectation-maximisation over the counts of vote patterns; each document gets
the posterior probability of being sound.  Bad texts mostly fail by one rule, which a single bad kind
could not tell from a noisy rule.  One accusation is weighed against the other rules' good votes:
whether it drops a document depends on what the table says of that rule.

Defined results: a null or blank text has no words and fails the base rule; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import SPACES, cut, words

SYMBOLS = "#*$%&|<>"
ROUNDS = 50
KEEP_AT = 0.5
#: Votes that are evidence (an abstention is silence), and their probabilities before anything is seen: of a rule that does not accuse the kind, and of one that does.
VOTES = (1, -1, -2)
QUIET, ACCUSING = (0.955, 0.04, 0.005), (0.15, 0.35, 0.50)
#: Kinds of text, their shares before anything is seen, and the rules that accuse them; what is set out here counts as WORTH documents.
SOUND = "sound"
SHARES = {SOUND: 0.80, "marks": 0.05, "shouting": 0.05, "boilerplate": 0.05, "scraps": 0.05}
ACCUSED_BY = {SOUND: (), "marks": ("symbols",), "shouting": ("upper",), "boilerplate": ("repeats", "dup_lines"), "scraps": ("word_length",)}
WORTH = 20

#: Share of every kind, and by kind and rule the probability of every vote.
Model = tuple[dict[str, float], dict[str, dict[str, dict[int, float]]]]


def text_figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper of whole texts."""
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = base.withColumn("_words", words(F.col("_text")))
    # 3-word windows as (hash, position), sorted: equal windows are neighbours.  Parts of one document only.
    hashed = split.withColumn(
        "_windows",
        F.sort_array(
            F.when(
                F.size("_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("at")
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
        ),
    )
    repeated = F.filter(
        "_windows",
        lambda w, k: (w["h"] == F.get("_windows", k - 1)["h"]) | (w["h"] == F.get("_windows", k + 1)["h"]),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2))))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    out = hashed.withColumn("_lines", lines)
    return out.select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _high_is_bad(figure: Column, good_to: float, weak_from: float, strong_from: float) -> Column:
    return F.when(figure >= strong_from, -2).when(figure >= weak_from, -1).when(figure <= good_to, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Rule name to vote: 1 good, -1 weakly bad, -2 strongly bad, 0 abstains (as does a figure that is null)."""
    length = _share("word_chars", "n_words")
    return {
        "symbols": _high_is_bad(_share("n_symbols", "word_chars"), 0.02, 0.03, 0.06),
        "repeats": _high_is_bad(_share("n_repeat_words", "n_words"), 0.20, 0.30, 0.45),
        "upper": _high_is_bad(_share("n_upper", "word_chars"), 0.12, 0.20, 0.30),
        "dup_lines": _high_is_bad(_share("n_dup_lines", "n_words"), 0.01, 0.02, 0.05),
        "word_length": F.when((length < 2.5) | (length > 14.0), -2).when((length < 3.0) | (length > 11.0), -1).when(length.between(3.5, 10.0), 1).otherwise(0),
    }


def starts(rules: list[str]) -> Model:
    return dict(SHARES), {kind: {r: dict(zip(VOTES, ACCUSING if r in ACCUSED_BY[kind] else QUIET, strict=True)) for r in rules} for kind in SHARES}


def estimate(patterns: list[tuple[dict[str, int], int]], rules: list[str], rounds: int = ROUNDS) -> Model:
    """Shares of the kinds and vote probabilities; patterns: distinct votes by rule (at most 4 to the number of rules) and their counts."""
    first_share, first_chance = share, chance = starts(rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        size = {kind: WORTH * s for kind, s in first_share.items()}
        seen = {kind: {r: {v: WORTH * first_share[kind] * p for v, p in by_vote.items()} for r, by_vote in by_rule.items()} for kind, by_rule in first_chance.items()}
        for pattern, n in patterns:
            weight = {kind: share[kind] * math.prod(chance[kind][r][v] for r, v in pattern.items() if v) for kind in share}
            every = sum(weight.values())
            for kind, w in weight.items():
                size[kind] += n * w / every
                for r, v in pattern.items():
                    if v:
                        seen[kind][r][v] += n * w / every
        was, share = share, {kind: s / (total + WORTH) for kind, s in size.items()}
        chance = {kind: {r: {v: c / sum(by_vote.values()) for v, c in by_vote.items()} for r, by_vote in by_rule.items()} for kind, by_rule in seen.items()}
        if max(abs(share[kind] - was[kind]) for kind in share) < 1e-7:
            break
    return share, chance


def posterior(model: Model) -> Column:
    """Probability of being sound, from the votes' columns."""
    share, chance = model
    against = F.lit(0.0)
    for kind in share:
        if kind != SOUND:
            odds = F.lit(math.log(share[kind] / share[SOUND]))
            for rule, by_vote in chance[kind].items():
                sound = chance[SOUND][rule]
                said = F.lit(0.0)
                for v in VOTES:
                    said = F.when(F.col(rule) == v, math.log(by_vote[v] / sound[v])).otherwise(said)
                odds = odds + said
            against = against + F.exp(odds)
    return 1 / (1 + against)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures, votes, posterior p_good, base_failed and kept of every document."""
    rules = votes()
    figures = cut(text_figures(docs, key, text).select("*", *[v.cast("int").alias(name) for name, v in rules.items()]), "rules")
    counted = figures.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).orderBy(*rules).collect()  # at most 4^5 patterns
    model = estimate([({r: row[r] for r in rules}, row["n"]) for row in counted], list(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = figures.withColumn("p_good", posterior(model)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))
