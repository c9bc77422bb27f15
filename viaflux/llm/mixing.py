"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source, targets are filled like water under a cap of
`max_repeats` times a source's size, and a source's rate is its target over its
size. Each document is emitted floor(rate) times plus one copy with probability
equal to the fraction, decided by a hash of the document's identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
#: Hash range of the Bernoulli draw.
_RANGE = float(1 << 32)


def n_words(text: str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null has none."""
    # \S+ runs become one sign each, so nothing but their number is built
    runs = F.regexp_replace(F.col(f"`{text}`"), r"[^\x20\x09-\x0D]+", "a")
    return F.coalesce(F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source of (source, source_size): target and rate.

    Sources in code-point order, null last, weigh `weights` in turn and share
    the sum of all sizes; a target stops at max_repeats times its source's
    size and the excess is shared again by weight until none is above. The
    level of that filling is found in closed form: sorted by cap over weight,
    the capped sources are a prefix. Sources without words have the target 0.
    The input has one row for each source, so its windows see few rows.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("all", F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    # the first source in filling order whose cap isn't reached sets the level of all after it
    s = s.withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    s = s.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "target", rate.alias("rate"))


def draw(identity: list[Column], seed: str = SEED) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the identity."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in identity]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_RANGE)


def planned(docs: DataFrame, *, text: str = "text", source: str = "source", identity: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes each row).

    Null texts have size 0 and null sources are one source, the last. Rows that
    repeat an identity share its draw. A source without words keeps none of its
    rows. Equal inputs give equal results in any partitioning. An empty table
    gives an empty one. Input columns of the added names are replaced.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    base = docs.drop(*added)
    of, rate = tk.fresh(base.columns, "of", "rate")
    own = F.col(f"`{source}`")
    sized = base.withColumn("mix_size", n_words(text))
    sizes = docs.select(own.alias("source"), n_words(text).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    rates = source_targets(sizes, weights, max_repeats).select(F.col("source").alias(of), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias(rate))
    # few sources: Spark broadcasts the rates where their size allows it, and splits skewed sources where not
    out = sized.join(rates, own.eqNullSafe(F.col(of)), "left")
    whole = F.floor(rate)
    copies = whole + F.when(draw([F.col(f"`{c}`") for c in identity], seed) < F.col(rate) - whole, 1).otherwise(0)
    return out.withColumn("mix_copies", copies.cast("long")).drop(of, rate)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as `planned` takes it, in the input's columns, whatever their names.

    Nulls, repeated rows and empty tables are as `planned` says; texts without
    words have size 0 and are taken at the rate of their source.
    """
    row, copies, nth = "row", "copies", "nth"
    names = {"text": "text", "source": "source", "identity": ("doc_id",)} | {k: v for k, v in options.items() if k in ("text", "source", "identity")}
    keys = [f"i{k}" for k in range(len(names["identity"]))]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    inner = docs.select(F.struct(*columns).alias(row), F.col(f"`{names['text']}`").alias("t"), F.col(f"`{names['source']}`").alias("s"), *[F.col(f"`{c}`").alias(k) for c, k in zip(names["identity"], keys, strict=True)])
    plan = planned(inner, **(options | {"text": "t", "source": "s", "identity": tuple(keys)})).select(row, F.col("mix_copies").alias(copies)).filter(F.col(copies) > 0)
    taken = plan.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return taken.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return planned(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )


#: The same over any relation `{docs}` with doc_id, text and source.
RATES_SQL = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighted AS (SELECT *, ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM sizes),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
   / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM weighted),
level AS (SELECT arg_min(own_level, cap / w) FILTER (WHERE cap > own_level * w) AS level FROM levels),
rates AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, level * w), 0.0) AS target,
   CASE WHEN source_size > 0 THEN least(coalesce(least(cap::DOUBLE, level * w), 0.0) / source_size, 3.0) ELSE 0.0 END AS rate FROM levels, level),
drawn AS (SELECT s.*, r.source_size, r.target, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1|' || coalesce(s.doc_id::VARCHAR, chr(0))), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
   FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
"""
ORACLE = "WITH " + RATES_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM drawn"
