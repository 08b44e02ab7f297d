"""Evaluation of models: merged results, reciprocal ranks and their statistics."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = ["line_location_rank", "exact_location_rank", "valid_fix_rank", "true_fix_rank"]
CONFIG = ["hidden_layers", "context_length", "training_set_size", "batch_size", "learning_rate", "optimizer", "dropout_label"]


def reciprocal_rank(rank: str | Column) -> Column:
    """1 / rank; a missing rank, or one below 1, counts as 0."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r >= 1, F.lit(1.0) / r).otherwise(F.lit(0.0))


def merge_results(parts: dict[str, DataFrame]) -> DataFrame:
    """Result tables of several models as one, with model_id; ids need to be unique within a model only."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("model_id", F.lit(key)) for key, df in parts.items()])


def merge_result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files of several models as one table; model_id is the name of each file's folder."""
    return spark.read.parquet(pattern).withColumn("model_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def plain_identifier(text: str) -> bool:
    """Whether a column name may stand unquoted in SQL."""
    return text.isascii() and text[:1].isalpha() and text.islower() and text.replace("_", "").isalpha()


def labelled_models(model: DataFrame) -> DataFrame:
    """Models with dropout as text ('None' where there is none) and the mean validation loss."""
    return model.distinct().withColumn("dropout_label", F.coalesce(F.col("dropout").cast("string"), F.lit("None"))).withColumn(
        "mean_val_loss", (F.col("forwards_val_loss") + F.col("backwards_val_loss")) / 2
    )


def ranked_results(result: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct results with the reciprocal ranks and their model's settings. The models are a small
    dimension: as many rows as were ever trained."""
    rr = result.distinct().select("model_id", "id", "mutation", "tool", "partition", *RANKS, *(reciprocal_rank(r).alias(r.replace("_rank", "_rr")) for r in RANKS))
    settings = labelled_models(model).withColumnRenamed("id", "model_id").drop("partition")
    return rr.join(settings, "model_id")


def mrr_by_config(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Mean reciprocal ranks and validation loss per group; rows without a mean loss are left out."""
    return ranked.where("mean_val_loss IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("mean_val_loss"), 6).alias("mean_val_loss"),
        *(F.round(F.avg(r.replace("_rank", "_rr")), 6).alias(r.replace("_rank", "_mrr")) for r in RANKS),
    )


def rank_histogram(result: DataFrame, rank: str, cap: int = 5) -> DataFrame:
    """rank (ranks from ``cap`` on, and missing ones, as cap), n, share."""
    counts = result.distinct().groupBy(F.least(F.coalesce(rank, F.lit(cap)), F.lit(cap)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 6))


def paired_effect(ranked: DataFrame, factor: str, first: str, second: str, value: str) -> DataFrame:
    """Means of ``value`` under two levels of a factor, per setting of all others, and their difference."""
    keys = [k for k in CONFIG if k != factor]
    means = ranked.where(F.col(factor).isin(first, second)).groupBy(*keys).pivot(factor, [first, second]).agg(F.avg(value))
    both = means.select(*keys, F.round(F.col(f"`{first}`"), 6).alias("first"), F.round(F.col(f"`{second}`"), 6).alias("second"))
    return both.where("first IS NOT NULL AND second IS NOT NULL").withColumn("difference", F.round(F.col("first") - F.col("second"), 6))


def paired_t(effect: DataFrame) -> DataFrame:
    """n, mean difference and t of a paired comparison; t is null below two pairs or without variation."""
    n, sd = F.count("difference"), F.stddev_samp("difference")
    return effect.agg(n.alias("n"), F.round(F.avg("difference"), 6).alias("mean_difference"), F.round(F.when(sd > 0, F.avg("difference") / (sd / F.sqrt(n))), 6).alias("t"))


def one_sample_t(values: DataFrame, column: str, mu: float) -> DataFrame:
    """n, mean and t against ``mu``."""
    n, sd = F.count(column), F.stddev_samp(column)
    return values.agg(n.alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.when(sd > 0, (F.avg(column) - mu) / (sd / F.sqrt(n))), 6).alias("t"))


def loss_correlation(ranked: DataFrame, value: str) -> DataFrame:
    """Correlation of the mean loss with ``value``, the line fitted to them, and the median of value."""
    known = ranked.where("mean_val_loss IS NOT NULL")
    return known.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("mean_val_loss", value), 6).alias("r"), F.round(F.regr_slope(value, "mean_val_loss"), 6).alias("slope"),
        F.round(F.regr_intercept(value, "mean_val_loss"), 6).alias("intercept"), F.round(F.percentile(value, 0.5), 6).alias("median"),
    )


def linear_model(ranked: DataFrame, value: str, factors: list[str]):
    """Least squares of ``value`` on categorical factors; the fitted summary has the p-values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    stages = [StringIndexer(inputCol=f, outputCol=f"{f}_i", stringOrderType="alphabetAsc") for f in factors]
    stages += [OneHotEncoder(inputCols=[f"{f}_i" for f in factors], outputCols=[f"{f}_v" for f in factors]), VectorAssembler(inputCols=[f"{f}_v" for f in factors], outputCol="features")]
    stages += [GeneralizedLinearRegression(family="gaussian", labelCol=value)]
    frame = ranked.select(value, *(F.col(f).cast("string").alias(f) for f in factors)).na.drop()
    return Pipeline(stages=stages).fit(frame).stages[-1].summary


def t_tail(t: float, df: float) -> float:
    """One-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + top / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    beta = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return beta / 2 if t >= 0 else 1 - beta / 2


@dataclass(frozen=True)
class Training:
    """Settings of a training run, with the usual values."""

    hidden_layers: tuple[int, ...] = (128,)
    context_length: int = 9
    batch_size: int = 32
    learning_rate: float = 0.001
    patience: int = 3
    optimizer: str = "rmsprop"
    training_files: int = 11_000
    validation_files: int = 5_500
    partition: int = 0
    backwards: bool = False

    def slug(self) -> str:
        """key-value of all settings in order, joined by commas; layers by plus signs."""
        shown = {**asdict(self), "hidden_layers": "+".join(map(str, self.hidden_layers)), "backwards": str(self.backwards).lower()}
        return ",".join(f"{k}-{shown[k]}" for k in sorted(shown))

    def steps(self, samples: int) -> int:
        """Batches of an epoch."""
        return -(-samples // self.batch_size)

    def stops(self, losses: list[float]) -> bool:
        """Whether the loss has not fallen for ``patience`` epochs."""
        return len(losses) > self.patience and min(losses[-self.patience :]) >= min(losses[: -self.patience])


def weight_files(model: DataFrame) -> DataFrame:
    """model_id, direction, file: the name under which a training run stores its weights."""
    named = lambda way: F.format_string("intermediate-%.4f-%02d.hdf5", F.col(f"{way}_val_loss"), F.col("patience"))
    both = [model.where(f"{way}_val_loss IS NOT NULL").select(F.col("id").alias("model_id"), F.lit(way).alias("direction"), named(way).alias("file")) for way in ("forwards", "backwards")]
    return both[0].unionByName(both[1])


def parsed_weights(files: DataFrame) -> DataFrame:
    """files with loss and epoch, as their names say; other names are left out."""
    pattern = r"intermediate-([0-9]+(?:\.[0-9]+)?)-([0-9]+)"
    return files.where(F.col("file").rlike(pattern)).withColumn("loss", F.regexp_extract("file", pattern, 1).cast("double")).withColumn("epoch", F.regexp_extract("file", pattern, 2).cast("int"))


def best_weights(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the file of least loss and the one of the last epoch; equal ones go by name."""
    return parsed_weights(files).groupBy(*keys).agg(F.min_by("file", F.struct("loss", "file")).alias("best"), F.max_by("file", F.struct("epoch", "file")).alias("latest"))


def complete_pairs(files: DataFrame) -> DataFrame:
    """model_id, forwards, backwards: the best weights of models that have both directions."""
    best = best_weights(files, ["model_id", "direction"])
    way = lambda w: best.where(F.col("direction") == w).select("model_id", F.col("best").alias(w))
    return way("forwards").join(way("backwards"), "model_id")


def config_grid(spark: SparkSession, *grids: dict[str, list]) -> DataFrame:
    """slug, model_id of every combination of each grid's values; grids follow one another.

    The slug is 'key-value' of all keys in order, joined by commas; the id its SHA-256. The product is
    unfolded from arrays, value lists being a handful each.
    """
    out = None
    for grid in grids:
        df = spark.range(1).select(*(F.array(*(F.lit(str(v)) for v in values)).alias(key) for key, values in grid.items()))
        for key in grid:
            df = df.withColumn(key, F.explode(key))
        slug = F.concat_ws(",", *(F.concat(F.lit(f"{key}-"), F.col(key)) for key in sorted(grid)))
        part = df.select(slug.alias("slug"), F.sha2(slug, 256).alias("model_id"))
        out = part if out is None else out.unionByName(part)
    return out


def experiment_plan(configs: DataFrame, evaluations: list[dict[str, str]]) -> DataFrame:
    """Each configuration with each way of evaluating it."""
    return configs.withColumn("evaluation", F.explode(F.array(*(F.lit(",".join(f"{k}-{v}" for k, v in sorted(e.items()))) for e in evaluations))))


def batches_per_epoch(samples: Column, batch: int) -> Column:
    return F.ceil(samples / batch)


def parse_layers(text: str) -> list[int]:
    """'300,300' as layer sizes; ValueError unless all are positive whole numbers."""
    layers = [int(x) for x in text.split(",")]
    if not layers or min(layers) <= 0:
        raise ValueError(text)
    return layers


def parse_split(text: str) -> tuple[float, float, float]:
    """'80/10/10' as fractions; ValueError unless three parts sum up to 100."""
    parts = [int(x) for x in text.split("/")]
    if len(parts) != 3 or sum(parts) != 100 or min(parts) < 0:
        raise ValueError(text)
    return parts[0] / 100, parts[1] / 100, parts[2] / 100
