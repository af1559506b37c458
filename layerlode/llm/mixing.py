"""Mixing by iterative proportional fitting: token weights raked to marginals of source, language and topic."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlode.llm.common import DRIVER_ROWS, materialise, split_by_size

#: Target marginals are the corpus's own shares to these powers, made to sum to 1: under 1, rare values gain.
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ITERATIONS, SEED = 60, "mix-1"
#: Share of the corpus's tokens that a mix keeps; how far a share may be from its target before a warning says so.
KEEP, TOLERANCE = 0.5, 1e-3
DIMENSIONS = ("source", "lang", "topic")
_UNKNOWN = "unknown"


def n_tokens(text: Column) -> Column:
    """Words between white space (space, tab, line feed, carriage return)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def unit_hash(seed: str, identity: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the row's identity only: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), identity)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def topics_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, topic): the label as a string, the least of repeated rows."""
    own = embeddings.where("vec_id is not null and label is not null")
    return own.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("label").cast("string").alias("topic"))


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], iterations: int = ITERATIONS) -> np.ndarray:
    """Weights of cells, columns ``DIMENSIONS`` and ``tokens``, whose marginals meet the targets: factors that multiply
    the tokens. Each iteration scales the cells to one marginal after the other."""
    if cells.empty:
        return np.zeros(0)
    tokens = cells["tokens"].to_numpy("float64")
    weights = tokens / max(tokens.sum(), 1)
    coded = {d: np.unique(cells[d].to_numpy(), return_inverse=True) for d in DIMENSIONS}
    for _ in range(iterations):
        for d in DIMENSIONS:
            names, at = coded[d]
            now = np.bincount(at, weights, minlength=len(names))
            want = np.array([targets[d].get(x, 0.0) for x in names])
            weights = weights * np.divide(want, now, out=np.zeros_like(now), where=now > 0)[at]
    return np.divide(weights * tokens.sum(), tokens, out=np.zeros_like(weights), where=tokens > 0)


def misses(cells: pd.DataFrame, weights: np.ndarray, targets: dict[str, dict[str, float]]) -> list[tuple[str, str, float, float]]:
    """(dimension, value, target, share reached) where weighted tokens miss a target by more than ``TOLERANCE``."""
    tokens = cells["tokens"].to_numpy("float64") * weights
    out = []
    for d in DIMENSIONS:
        reached = pd.Series(tokens / max(tokens.sum(), 1e-300)).groupby(cells[d].to_numpy()).sum()
        out += [(d, v, want, float(reached.get(v, 0.0))) for v, want in targets[d].items() if abs(reached.get(v, 0.0) - want) > TOLERANCE]
    return out


def _rake_by_joins(cells: DataFrame, targets: dict[str, DataFrame], iterations: int) -> DataFrame:
    """As ``rake`` for cells beyond what a driver holds. A step is one aggregation and one join."""
    total = F.broadcast(cells.agg(F.sum("tokens").alias("total")))
    out = materialise(cells.crossJoin(total).withColumn("w", F.col("tokens") / F.col("total")), "cells")
    for _ in range(iterations):
        for d in DIMENSIONS:
            now = out.groupBy(d).agg(F.sum("w").alias("now")).join(targets[d], d).selectExpr(d, "case when now > 0 then want / now else 0D end as f")
            out = out.join(split_by_size(now), d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        out = materialise(out, "cells")
    return out.selectExpr(*DIMENSIONS, "case when tokens > 0 then w * total / tokens else 0D end as factor")


def fill(have: np.ndarray, want: np.ndarray, amount: float) -> np.ndarray:
    """``min(have, scale * want)`` at the scale where they sum to ``amount``; all that is wanted if that is less."""
    wanted, full = want > 0, np.zeros(len(have), dtype=bool)
    while True:
        rest = want[~full].sum()
        if rest <= 0:
            return np.where(wanted, have, 0.0)
        scale = max(amount - have[full].sum(), 0.0) / rest
        now = full | (wanted & (scale * want >= have))
        if (now == full).all():
            return np.where(full, have, scale * want)
        full = now


def rake_within(cells: pd.DataFrame, factors: np.ndarray, targets: dict[str, dict[str, float]], keep: float, iterations: int = ITERATIONS) -> np.ndarray:
    """Share of each cell's tokens to keep, at most 1, so that ``keep`` of all tokens stay and their marginals meet the
    targets as far as the cells have tokens: what a value or cell lacks is spread over the others in proportion."""
    if cells.empty:
        return np.zeros(0)
    tokens = cells["tokens"].to_numpy("float64")
    amount = keep * tokens.sum()
    kept = fill(tokens, tokens * factors, amount)
    coded = {d: np.unique(cells[d].to_numpy(), return_inverse=True) for d in DIMENSIONS}
    wants = {}
    for d, (names, at) in coded.items():
        wants[d] = fill(np.bincount(at, tokens, minlength=len(names)), np.array([targets[d].get(x, 0.0) for x in names]), amount)
    for _ in range(iterations):
        for d, (names, at) in coded.items():
            now = np.bincount(at, kept, minlength=len(names))
            kept = np.minimum(tokens, kept * np.divide(wants[d], now, out=np.zeros_like(now), where=now > 0)[at])
    kept = fill(tokens, kept, amount)
    return np.divide(kept, tokens, out=np.zeros_like(kept), where=tokens > 0)


def _filled(df: DataFrame, have: str, want: str, amount: float) -> Column:
    """As ``fill``: the column of a table of any size. A step is one aggregation."""
    wanted, scale, count = F.col(want) > 0, 0.0, -1
    while True:
        full = wanted & (F.lit(scale) * F.col(want) >= F.col(have)) if count >= 0 else F.lit(False)
        r = df.agg(F.sum(F.when(full, F.col(have)).otherwise(0)).cast("double").alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col(want))).alias("rest"), F.count_if(full).alias("n")).first()
        if not r["rest"]:
            return F.when(wanted, F.col(have).cast("double")).otherwise(0.0)
        if r["n"] == count:
            return F.least(F.col(have).cast("double"), F.lit(scale) * F.col(want))
        count, scale = r["n"], max(amount - r["held"], 0.0) / r["rest"]


def _rake_within_by_joins(cells: DataFrame, factors: DataFrame, targets: dict[str, DataFrame], keep: float, iterations: int) -> DataFrame:
    """As ``rake_within`` for cells beyond what a driver holds."""
    amount = keep * cells.agg(F.sum("tokens")).first()[0]
    out = cells.join(factors, list(DIMENSIONS)).withColumn("w", F.col("tokens") * F.col("factor"))
    out = materialise(out.withColumn("w", _filled(out, "tokens", "w", amount)), "cells")
    wants = {}
    for d in DIMENSIONS:
        own = materialise(cells.groupBy(d).agg(F.sum("tokens").alias("have")).join(targets[d], d), "wants")
        wants[d] = own.select(d, _filled(own, "have", "want", amount).alias("want"))
    for _ in range(iterations):
        for d in DIMENSIONS:
            now = out.groupBy(d).agg(F.sum("w").alias("now")).join(wants[d], d, "left").selectExpr(d, "case when now > 0 then coalesce(want, 0D) / now else 0D end as f")
            out = out.join(split_by_size(now), d).withColumn("w", F.least(F.col("tokens").cast("double"), F.col("w") * F.col("f"))).drop("f")
        out = materialise(out, "cells")
    out = out.withColumn("w", _filled(out, "tokens", "w", amount))
    return out.selectExpr(*DIMENSIONS, "factor", "case when tokens > 0 then w / tokens else 0D end as probability")


def _own_targets(cells: DataFrame, alphas: dict[str, float], given: dict[str, dict[str, float]]) -> dict[str, DataFrame]:
    spark, out = cells.sparkSession, {}
    for d in DIMENSIONS:
        if d in given:
            frame = pd.DataFrame(list(given[d].items()), columns=[d, "want"])
            own = spark.createDataFrame(frame, f"{d} string, want double").join(cells.select(d).distinct(), d)
        else:
            own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").selectExpr(d, f"pow(t, {alphas[d]}D) as want")
        out[d] = own.crossJoin(F.broadcast(own.agg(F.sum("want").alias("all")))).selectExpr(d, "want / all as want")
    return out


def _facts(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", n_tokens(F.col("text")).alias("tokens"), _identity().alias("identity"))
    named = narrow.join(split_by_size(topics_of(embeddings)), narrow["doc_id"] == F.col("vec_id"), "left").drop("vec_id")
    for d in DIMENSIONS:
        named = named.withColumn(d, F.coalesce(F.col(d).cast("string"), F.lit(_UNKNOWN)))
    return materialise(named, "facts")


def cell_probabilities(
    facts: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    alphas: dict[str, float] = ALPHAS,
    iterations: int = ITERATIONS,
    driver_rows: int = DRIVER_ROWS,
    keep: float | None = None,
) -> DataFrame:
    """(source, lang, topic, weight, probability) of each cell; see ``mix_documents``."""
    cells = materialise(facts.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = _own_targets(cells, alphas, targets or {})
    if cells.limit(driver_rows + 1).count() <= driver_rows:
        frame = cells.orderBy(*DIMENSIONS).toPandas()
        wants = {d: {r[d]: r["want"] for r in wanted[d].collect()} for d in DIMENSIONS}
        frame["factor"] = rake(frame, wants, iterations)
        if len(frame) and (apart := misses(frame, frame["factor"].to_numpy(), wants)):
            told = "; ".join(f"{d} {v}: {share:.4f} for {want:.4f}" for d, v, want, share in apart[:5])
            warnings.warn(f"{len(apart)} targets aren't met after {iterations} rounds, as no weights of the cells may meet them: {told}", stacklevel=2)
        kind = "source string, lang string, topic string, factor double"
        if keep is not None:
            frame["probability"] = rake_within(frame, frame["factor"].to_numpy(), wants, keep, iterations)
            kind += ", probability double"
        rows = cells.sparkSession.createDataFrame(frame.drop(columns="tokens"), kind)
    else:
        rows = _rake_by_joins(cells, wanted, iterations)
        if keep is not None:
            rows = _rake_within_by_joins(cells, rows, wanted, keep, iterations)
    if keep is not None:
        return rows.withColumnRenamed("factor", "weight")
    most = rows.agg(F.max("factor").alias("most"))
    return rows.crossJoin(F.broadcast(most)).selectExpr(*DIMENSIONS, "factor as weight", "case when most > 0 then factor / most else 0D end as probability")


def mix_documents(
    docs: DataFrame,
    embeddings: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    alphas: dict[str, float] = ALPHAS,
    iterations: int = ITERATIONS,
    seed: str = SEED,
    driver_rows: int = DRIVER_ROWS,
    keep: float | None = KEEP,
) -> DataFrame:
    """Sample documents so that tokens meet target marginals of source, language and topic.

    Tokens are counted over whole texts of all rows and summed by cell (source, language, topic). Iterative
    proportional fitting rakes the cells to the targets: ``targets[dimension]`` where given (shares of the values,
    scaled to 1; values that the corpus lacks are left out, values without a target get 0), else the corpus's own
    shares to the power ``alphas[dimension]``. A cell's weight is its fitted share over its own share.

    Its rows are kept with a probability such that ``keep`` of all tokens stay in expectation, whatever the sizes of the
    cells: raking again with at most 1 for each cell (``rake_within``). Values and cells with too few tokens for their
    share are kept whole and the others make up for them; ``weight / probability`` is what a kept row counts for where
    the exact targets are wanted. With ``keep`` None the probability is weight / largest weight: marginals hold exactly
    in expectation, but the rarest wanted cell sets how much of all others is kept.

    Targets that contradict each other, given which cells have tokens, can't be met by any weights. Raking ends after
    ``iterations`` rounds in any case; a warning names the targets that are missed by more than ``TOLERANCE``. A row is kept if a hash of the seed and doc_id is under its probability: the same rows each time.

    A row's topic is the label of the embedding with its doc_id. One row for each kept row: doc_id, source, lang,
    topic, n_tokens, weight, probability. A null source, language or topic is the value "unknown". A null or empty
    text has 0 tokens; a cell without tokens has weight 0, so its rows aren't kept. Rows with a null doc_id are drawn
    by their text; repeated rows are kept or not together. An empty table gives no rows. Cells beyond ``driver_rows``
    are raked by joins, with the same result.
    """
    facts = _facts(docs, embeddings)
    cells = cell_probabilities(facts, targets, alphas, iterations, driver_rows, keep)
    drawn = facts.join(split_by_size(cells), list(DIMENSIONS)).where(unit_hash(seed, F.col("identity")) < F.col("probability"))
    return drawn.select("doc_id", *DIMENSIONS, F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def sample_documents(docs: DataFrame, embeddings: DataFrame, targets: dict[str, dict[str, float]] | None = None, alphas: dict[str, float] = ALPHAS, iterations: int = ITERATIONS, seed: str = SEED, keep: float | None = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that ``mix_documents`` keeps. Texts stay where they are if the topics and
    cells can be broadcast (size checked)."""
    cells = cell_probabilities(_facts(docs, embeddings), targets, alphas, iterations, keep=keep)
    names = docs.columns
    tag = "_" * (1 + max(len(x) for x in names))
    topics = topics_of(embeddings).select(F.col("vec_id").alias(f"{tag}v"), F.col("topic").alias(f"{tag}topic"))
    own = docs.withColumn(f"{tag}u", unit_hash(seed, _identity()))
    own = own.join(split_by_size(topics), own["doc_id"].cast("bigint") == F.col(f"{tag}v"), "left")
    known = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": F.col(f"{tag}topic")}
    own = own.withColumns({f"{tag}{d}_": F.coalesce(c, F.lit(_UNKNOWN)) for d, c in known.items()})
    cells = cells.select(*[F.col(d).alias(f"{tag}{d}_") for d in DIMENSIONS], F.col("probability").alias(f"{tag}p"))
    kept = own.join(split_by_size(cells), [f"{tag}{d}_" for d in DIMENSIONS]).where(F.col(f"{tag}u") < F.col(f"{tag}p"))
    return kept.select(*names)
