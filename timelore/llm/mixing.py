"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed into cells (source, lang, topic); raking multiplies the cells of one marginal at a
time until every marginal has its target share; each document then stays with the calibrated probability
of its cell, decided by a hash of its id, so a rerun keeps the same documents. Main path: DataFrame
functions only.

Targets default to tempered shares, `share ** temper` normalised, for each marginal; a caller may give a
DataFrame (value, share) for any of them. `rate` is the share of all tokens to keep, and no cell can give
more tokens than it has, so raking is bounded: a cell's weight is the least of its own tokens and of the
product of its tokens with one factor for each of its values, and rounds go on until the kept tokens have
all target shares. A target above all tokens of its value can't be met at this rate: that value is kept
whole and the rest is shared by the other values in the ratio of their targets (`reachable`). Should
marginals that can each be met contradict each other, rounds stop when they no longer come closer.

Defined cases: null source, language or topic is a value of its own ("<null>"); a null text has no tokens
and falls in topic prose; documents without tokens stay (they weigh nothing); a null id is hashed as
"<null>"; a very long text is counted whole; rows with one id share their fate; an empty table stays empty; further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelore.llm.common import materialise

MARGINALS = ("source", "lang", "topic")
NULL = "<null>"
#: Rounds end when no marginal misses its goal by more than this share of all tokens, or after so many blocks.
TOLERANCE = 1e-12
MOST_BLOCKS = 25
#: So many cells are raked in one task; more stay dealt out by the values of the marginals.
ONE_TASK_CELLS = 1 << 17


def token_count(text: Column) -> Column:
    """Tokens: blanks and line ends, plus one, or none for an empty text."""
    blanks = F.length(text) - F.length(F.translate(text, " \n\t", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(blanks + 1).cast("long")


def topic_of(text: Column) -> Column:
    """The kind of text, as the documents table has no topic of its own."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("@"), "contact")
        .when(text.contains("http://") | text.contains("https://"), "links")
        .when(text.contains("icense") | text.contains("opyright"), "legal")
        .when(text.contains("!!") | text.contains("***"), "noise")
        .otherwise("prose")
    )


def _value(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NULL))


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """`row` (all columns of docs), _source, _lang, _topic and _tokens; no name of docs can clash."""
    text = F.col("text")
    values = {"_source": _value(F.col("source")), "_lang": _value(F.col("lang")), "_topic": _value(topic if topic is not None else topic_of(text)), "_tokens": token_count(text)}
    return docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in values.items()])


def tempered_targets(cells: DataFrame, marginal: str, temper: float) -> DataFrame:
    shares = cells.groupBy(f"_{marginal}").agg(F.sum("tokens").alias("n")).filter("n > 0")
    weight = F.pow(F.col("n").cast("double"), F.lit(temper))
    return shares.select(F.col(f"_{marginal}"), (weight / F.sum(weight).over(Window.partitionBy())).alias(f"target_{marginal}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], iterations: int) -> DataFrame:
    """cells with `weight`: the share of all tokens that the cell is to have, without regard to what it holds.

    `cells` has a row for each (source, lang, topic) that occurs, so its size is that of the vocabulary of
    labels and not of the corpus.
    """
    total = F.sum("tokens").over(Window.partitionBy())
    out = cells.withColumn("weight", F.col("tokens") / total)
    for m in MARGINALS:
        out = out.join(targets[m], f"_{m}", "left").fillna(0.0, [f"target_{m}"])
    for _ in range(iterations):
        for m in MARGINALS:
            here = F.sum("weight").over(Window.partitionBy(f"_{m}"))
            out = out.withColumn("weight", F.when(here > 0, F.col("weight") * F.col(f"target_{m}") / here).otherwise(0.0))
    return out


def filled(rows: DataFrame, group: list[str], want: str, most: str, goal: Column) -> DataFrame:
    """`rows` with `want` scaled by one factor for each group, so that least(want, most) sums to `goal` there.

    The sum is a concave function of the factor, the least of the lines "the first k rows by want / most are
    full"; so the factor is the largest at which one of these lines reaches the goal. Where the goal is
    above the sum of `most`, every row becomes full.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(want) / F.col(most)))
    before = F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(want).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    lines = rows.withColumns({"before": before, "rest": rest})
    line = F.when(F.col("rest") > 0, (goal - F.col("before")) / F.col("rest")).otherwise(0.0)
    factor = F.greatest(F.lit(0.0), F.max(line).over(Window.partitionBy(*group)))
    return lines.withColumn(want, F.col(want) * factor).drop("before", "rest")


def reachable(cells: DataFrame, target: DataFrame, marginal: str, rate: float) -> DataFrame:
    """(value, target_m, goal_m): the target share, and the tokens to keep of each value that occurs.

    goal_m is rate * all tokens * target_m (targets scaled to sum to one) unless that passes the value's tokens.
    """
    m, t = f"_{marginal}", f"target_{marginal}"
    values = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("most")).join(target, m, "left").fillna(0.0, [t])
    values = values.withColumns({"goal": F.col(t), "whole": F.sum("most").over(Window.partitionBy()) * rate})
    return filled(values, [], "goal", "most", F.col("whole")).select(m, t, F.least("goal", "most").alias(f"goal_{marginal}"))


def bounded_rake(cells: DataFrame, targets: dict[str, DataFrame], rate: float, iterations: int) -> DataFrame:
    """cells with `weight` (share of the kept tokens) and `probability`, both from raking within the cells' tokens.

    `want` is a cell's tokens times the factors of its values; it isn't cut at `tokens` between rounds, so a
    cell that was full can open again. Each marginal's step is exact, which makes the rounds an ascent to the
    one solution. `iterations` rounds are one written block; blocks follow until every marginal is met.
    """
    out = cells.withColumns({"want": F.col("tokens") * F.lit(float(rate)), "most": F.col("tokens").cast("double")})
    for m in MARGINALS:
        out = out.join(F.broadcast(reachable(cells, targets[m], m, rate)), f"_{m}")  # one row for each value
    kept = F.least("want", "most")
    one_task = cells.count() <= ONE_TASK_CELLS
    last = None
    for _ in range(MOST_BLOCKS):
        for _ in range(iterations):
            for m in MARGINALS:
                out = filled(out, [f"_{m}"], "want", "most", F.col(f"goal_{m}"))
        out = materialise(out, "raked")
        out = out.coalesce(1) if one_task else out
        misses = [F.abs(F.sum(kept).over(Window.partitionBy(f"_{m}")) - F.col(f"goal_{m}")) for m in MARGINALS]
        row = out.select(F.greatest(*misses).alias("miss"), "tokens").agg(F.max("miss").alias("miss"), F.sum("tokens").alias("tokens")).first()  # one row
        if row.miss is None or row.miss <= TOLERANCE * row.tokens or (last is not None and row.miss > 0.99 * last):
            break
        last = row.miss
    total = F.sum(kept).over(Window.partitionBy())
    return out.withColumns({"weight": F.when(total > 0, kept / total).otherwise(0.0), "probability": kept / F.col("most")})


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id, the same on any engine that has MD5."""
    digits = F.substring(F.md5(F.concat(_value(id_col), F.lit(seed)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def mixture_cells(docs: DataFrame, temper: float = 0.7, rate: float = 0.6, iterations: int = 8, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The raked cells with their probabilities."""
    keys = [f"_{m}" for m in MARGINALS]
    cells = materialise(described(docs).groupBy(*keys).agg(F.sum("_tokens").alias("tokens")).filter("tokens > 0"), "cells")
    given = targets or {}
    goals = {m: given[m].toDF(f"_{m}", f"target_{m}") if m in given else tempered_targets(cells, m, temper) for m in MARGINALS}
    return bounded_rake(cells, goals, rate, iterations).select(*keys, "tokens", "weight", "probability")


def sample_mixture(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The documents that stay: row, _source, _lang, _topic, _tokens, weight and probability."""
    cells = materialise(mixture_cells(docs, **options), "mixture").drop("tokens")
    keys = [f"_{m}" for m in MARGINALS]
    joined = described(docs).join(cells, keys, "left")
    chance = F.when(F.col("_tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0)))
    return joined.withColumn("probability", chance).filter(uniform(F.col("row.doc_id"), seed) < F.col("probability"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns of docs."""
    return sample_mixture(docs, **options).select("row.*")
