"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells (source, language, topic). The cells' token weights are raked in turn to the target shares of
each marginal in rounds; a document's weight is the factor of its cell, and documents are sampled with probabilities
in proportion to it. Probability 1 is that of the largest weight that binds: the cells of still larger weights, which
together hold at most NEGLIGIBLE of the target tokens, are kept whole and fall short of their targets. So no row is
repeated, the other cells' expected tokens have their target shares to each other, and a few stray rows do not thin out the rest.

Targets: {column: {value: weight}}; values without a weight, and columns without targets, get their share of tokens to
the power TEMPER of the column. Weights of values that no document has are ignored, the rest is scaled to 1.

Raking ends when all marginals hold to TOLERANCE, or after MAX_ROUNDS: targets that contradict each other can't hold
together (a language that one source alone has, with another share). The largest difference of a marginal's share and its
target is reported as marginal_error: 0 where all targets hold.

Defined results: null and empty texts have no tokens, null categories are the category ''; cells without tokens keep
weight 1 before scaling; very long texts count whole; rows with the same doc_id share one decision; an empty table gives
an empty result; extra columns, whatever their names, are carried by keep_sample() and else not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, scratch

DIMS = ("source", "lang", "topic")
#: Power of a value's share of tokens in its default target; 1 keeps the share.
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 1.0}
MAX_ROUNDS, ROUNDS_PER_CUT, TOLERANCE = 40, 5, 1e-9
#: Share of the target tokens that cells may hold together without setting the rate of the sample.
NEGLIGIBLE = 0.001
#: Cells up to so many are raked in one task and broadcast; beyond, both are dealt out.
SMALL_CELLS = 20_000


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A plain stand-in for a topic model: the form of the text."""
    return F.when(n_tokens < 60, "note").when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact").otherwise("prose")


def _prefix(docs: DataFrame) -> str:
    """The beginning of names that no column of docs has."""
    p = "__mix"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    return p + "_"


def measured(docs: DataFrame, prefix: str) -> DataFrame:
    """docs with source, lang, topic and tokens by prefixed names."""
    text = F.coalesce("text", F.lit(""))
    tokens = f"{prefix}tokens"
    with_tokens = docs.withColumn(tokens, F.regexp_count(text, F.lit(WORD)).cast("long"))
    kind = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return with_tokens.withColumns({f"{prefix}source": kind("source"), f"{prefix}lang": kind("lang"), f"{prefix}topic": topic_of(text, F.col(tokens))})


def targets_of(cells: DataFrame, dim: str, given: dict[str, float] | None = None) -> DataFrame:
    """value and share of a marginal."""
    by = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    power = F.lit(TEMPER[dim])
    free = F.pow(F.col("n"), power)
    if given:
        known = F.create_map(*[F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))])
        free = F.coalesce(F.element_at(known, F.col("value")), free / F.pow(F.lit(1.0) + F.col("n"), power) * min(given.values()))
    # a marginal has as many rows as values: one task sums them
    return by.select("value", (free / F.sum(free).over(Window.partitionBy(F.lit(0)))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, float]:
    """cells(source, lang, topic, tokens) with weight: tokens times weight have the target shares of every marginal, but
    for the difference that is returned with them."""
    small = cells.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    if small:
        cells = cells.coalesce(1)
    for d in DIMS:
        goal = targets_of(cells, d, (targets or {}).get(d)).toDF(d, f"goal_{d}")
        cells = cells.join(F.broadcast(goal) if small else goal, d, "left")
    state, worst = cut(cells.withColumn("w", F.col("tokens").cast("double")), "mixing-cells"), 0.0
    for at in range(0, MAX_ROUNDS, ROUNDS_PER_CUT):
        if small:
            state = state.coalesce(1)
        for _ in range(ROUNDS_PER_CUT):
            for d in DIMS:
                held = F.sum("w").over(Window.partitionBy(d))
                state = state.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"goal_{d}") / held).otherwise(F.col("w")))
        state = cut(state, "mixing-cells")
        worst = 0.0
        for d in DIMS:
            off = state.groupBy(d, f"goal_{d}").agg(F.sum("w").alias("w")).agg(F.max(F.abs(F.col("w") - F.col(f"goal_{d}")))).first()[0]
            worst = max(worst, off or 0.0)
        if worst < TOLERANCE:
            break
    total = float(state.agg(F.sum("tokens")).first()[0] or 0)
    weight = F.when(F.col("tokens") > 0, F.col("w") * F.lit(total) / F.col("tokens")).otherwise(F.lit(1.0))
    return state.select(*DIMS, "tokens", weight.alias("weight")), worst


def binding(raked: DataFrame) -> float | None:
    """The largest weight whose cells, with those of larger weights, hold more than NEGLIGIBLE of the target tokens; the
    largest of all where no cell has tokens."""
    goal = F.col("tokens") * F.col("weight")
    above = F.sum(goal).over(Window.orderBy(F.desc("weight")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # by distinct weight, so that the one task of the window gets no more than that
    held = raked.groupBy("weight").agg(F.sum("tokens").alias("tokens")).select("weight", above.alias("above"))
    total = float(raked.agg(F.sum(goal)).first()[0] or 0)
    return held.agg(F.coalesce(F.max(F.when(F.col("above") > F.lit(NEGLIGIBLE * total), F.col("weight"))), F.max("weight"))).first()[0]


def _decided(docs: DataFrame, targets: dict[str, dict[str, float]] | None) -> tuple[DataFrame, str, float]:
    """docs with source, lang, topic, tokens, weight, p and kept by prefixed names, the prefix, and the error of raking."""
    p = _prefix(docs)
    rows = measured(docs, p)
    with scratch(docs.sparkSession) as keep:
        cells = cut(rows.groupBy(*[F.col(p + d).alias(d) for d in DIMS]).agg(F.sum(p + "tokens").alias("tokens")), "mixing-counts")
        raked, off = rake(cells, targets)
        top = binding(raked)
        chance = F.least(F.lit(1.0), F.col("weight") / F.lit(top))
        raked = keep(cut(raked.select(*[F.col(d).alias(p + d) for d in DIMS], F.col("weight").alias(p + "weight"), chance.alias(p + "p")), "mixing-weights"))
    small = raked.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    rows = rows.join(F.broadcast(raked) if small else raked, [p + d for d in DIMS])
    # a number in [0, 1) that depends on the doc_id alone
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn(p + "kept", u < F.col(p + "p")), p, off


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cell, tokens, weight, probability, decision and the error of raking, of each row."""
    rows, p, off = _decided(docs.select("doc_id", "text", "source", "lang"), targets)
    cells = [F.col(p + d).alias(d) for d in DIMS]
    return rows.select("doc_id", *cells, F.col(p + "tokens").alias("n_tokens"), F.round(p + "weight", 5).alias("weight"), F.round(p + "p", 5).alias("probability"), F.col(p + "kept").alias("kept"), F.round(F.lit(off), 5).alias("marginal_error"))


def keep_sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of docs, all columns as they are."""
    rows, p, _ = _decided(docs, targets)
    return rows.where(p + "kept").select(*docs.columns)
