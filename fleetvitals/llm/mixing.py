"""A mixture of sources with target weights, by repeating whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
SEED = "mixture-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Target words per source, from one row (``_source``, ``source_size``) for each.

    Sources in code point order, null last, weigh as ``weights`` says, repeating, and share ``budget`` times all
    words by weight.  No target passes ``most`` times its source: with sources in order of most * size / weight,
    those that are full leave the rest (budget - full) / (weights left) a unit of weight.  The level is the
    largest such quotient that its own source doesn't pass, which is where resharing the excess ends.
    The windows see one row per source.
    """
    everything = Window.partitionBy()
    row = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    units = F.array(*(F.lit(int(w)) for w in weights))
    full = F.col("source_size") * int(most)
    weighed = sizes.withColumn("_weight", F.element_at(units, ((row - 1) % len(weights) + 1).cast("int")).cast("bigint")).withColumn("_full", full)
    ratio = F.col("_full").cast("double") / F.col("_weight")
    by_ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    fuller = F.coalesce(F.sum("_full").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    level = (total.cast("double") * F.lit(float(budget)) - fuller.cast("double")) / left.cast("double")
    leveled = weighed.withColumn("_ratio", ratio).withColumn("_level", level)
    held = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    target = F.least(F.col("_full").cast("double"), F.coalesce(held, F.lit(float("inf"))) * F.col("_weight"))
    return leveled.select("_source", "source_size", target.alias("target"))


def _draw(seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the hash of a row's id (its text, if it has none)."""
    name = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("text "), F.col("_text")), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed} "), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_rates(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    seed: str = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often the mixture takes each row: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``.

    Words are summed per source inside the input tasks first.  A source's rate is target / words, and each of
    its rows is taken floor(rate) times, and once more when its hash, seeded and uniform in [0, 1), is below
    the fraction.  Columns named in ``carry`` come along as ``_carry0`` ...

    A null or empty text has size 0 and follows its source's rate all the same; a source without words has
    rate 0.  Rows that repeat an id get the same draw.  No rows give no rows.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.when(F.col("doc_id").isNull(), F.col("text")).alias("_text"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("size"),
        *(F.col(f"`{name}`").alias(f"_carry{i}") for i, name in enumerate(carry)),
    )
    sized = docs.select(F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, most).withColumnRenamed("_source", "_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once_more = F.when(_draw(seed) < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    return rows.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.floor(rate) + once_more).cast("bigint").alias("copies"),
        *(F.col(f"_carry{i}") for i in range(len(carry))),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``mix_rates`` takes it; columns as given."""
    names = docs.columns
    rated = mix_rates(docs, carry=names, **settings)
    repeated = rated.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return repeated.select(*(F.col(f"_carry{i}").alias(name) for i, name in enumerate(names)))


def mixing_query(documents: DataFrame) -> DataFrame:
    rated = mix_rates(documents)
    return rated.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM sizes
), leveled AS (
  SELECT *, most::DOUBLE / weight AS ratio,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
    least(most::DOUBLE, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target
  FROM leveled
), drawn AS (
  SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED} ' || coalesce(doc_id::VARCHAR, 'text ' || text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""
