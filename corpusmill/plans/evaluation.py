"""Queries over results and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluation as e
from corpusmill.sources.tables import read


def _ranked(spark, d):
    return e.ranked_results(read(spark, d, "result"), read(spark, d, "model"))


def results_with_models(spark, d):
    return _ranked(spark, d).select("model_id", "id", "optimizer", "dropout_label", *(F.round(r.replace("_rank", "_rr"), 6).alias(r.replace("_rank", "_rr")) for r in e.RANKS))


def mrr_by_config(spark, d):
    return e.mrr_by_config(_ranked(spark, d), e.CONFIG)


def mrr_by_partition(spark, d):
    return e.mrr_by_config(_ranked(spark, d), ["partition", "training_set_size"])


def mrr_of_set_size(spark, d):
    return e.mrr_by_config(_ranked(spark, d).where("training_set_size = 11000"), ["mutation"])


def rank_histogram(spark, d):
    return e.rank_histogram(read(spark, d, "result"), "true_fix_rank")


def optimizer_effect(spark, d):
    return e.paired_effect(_ranked(spark, d), "optimizer", "adam", "rmsprop", "line_location_rr")


def dropout_effect(spark, d):
    return e.paired_effect(_ranked(spark, d), "dropout_label", "None", "0.75", "valid_fix_rr")


def paired_t(spark, d):
    keys = ["training_set_size", "tool"]
    means = _ranked(spark, d).where(F.col("optimizer").isin("adam", "rmsprop")).groupBy(*keys).pivot("optimizer", ["adam", "rmsprop"]).agg(F.avg("line_location_rr"))
    return e.paired_t(means.where("adam IS NOT NULL AND rmsprop IS NOT NULL").select((F.col("adam") - F.col("rmsprop")).alias("difference")))


def one_sample_t(spark, d):
    return e.one_sample_t(_ranked(spark, d), "exact_location_rr", 0.25)


def val_loss_correlation(spark, d):
    return e.loss_correlation(_ranked(spark, d), "valid_fix_rr")


def model_best(spark, d):
    return e.best_weights(e.weight_files(read(spark, d, "model")), ["direction"])


def model_losses(spark, d):
    return e.parsed_weights(e.weight_files(read(spark, d, "model"))).select("model_id", "direction", "file", "loss", "epoch")


def model_pairs(spark, d):
    return e.complete_pairs(e.weight_files(read(spark, d, "model")))


def model_manifest(spark, d):
    m = read(spark, d, "model").distinct()
    return m.select(F.col("id").alias("model_id"), F.array_join(F.split("hidden_layers", ","), "-").alias("layers"), e.batches_per_epoch(F.col("training_set_size"), 32).alias("batches"))


_GRID = ({"optimizer": ["adam", "rmsprop"], "context": [9, 15, 20], "dropout": ["None", 0.75], "partition": [0, 1, 2, 3, 4]}, {"optimizer": ["nadam"], "context": [9], "partition": [0]})


def config_grid(spark, d):
    return e.config_grid(spark, *_GRID)


def experiment_plan(spark, d):
    return e.experiment_plan(e.config_grid(spark, *_GRID), [{"mutations": "all"}, {"mutations": "insertion", "limit": "10"}])


QUERIES = {
    f.__name__: f
    for f in (
        results_with_models, mrr_by_config, mrr_by_partition, mrr_of_set_size, rank_histogram, optimizer_effect, dropout_effect, paired_t, one_sample_t,
        val_loss_correlation, model_best, model_losses, model_pairs, model_manifest, config_grid, experiment_plan,
    )
}

_RR = ", ".join(f"CASE WHEN r.{x} >= 1 THEN CAST(1 AS DOUBLE) / r.{x} ELSE 0 END AS {x.replace('_rank', '_rr')}" for x in e.RANKS)
_RANKED = f"""(SELECT r.model_id, r.id, r.mutation, r.tool, r.partition, m.* EXCLUDE (id, partition), coalesce(CAST(m.dropout AS VARCHAR), 'None') AS dropout_label,
    (m.forwards_val_loss + m.backwards_val_loss) / 2 AS mean_val_loss, {_RR}
  FROM (SELECT DISTINCT * FROM result) r JOIN (SELECT DISTINCT * FROM model) m ON m.id = r.model_id)"""
_MRR = "count(*) AS n, round(avg(mean_val_loss), 6) AS mean_val_loss, " + ", ".join(f"round(avg({x.replace('_rank', '_rr')}), 6) AS {x.replace('_rank', '_mrr')}" for x in e.RANKS)


def _mrr(keys: str, where: str = "TRUE") -> str:
    return f"SELECT {keys}, {_MRR} FROM {_RANKED} WHERE mean_val_loss IS NOT NULL AND {where} GROUP BY ALL"


def _effect(factor: str, first: str, second: str, value: str) -> str:
    keys = ", ".join(k for k in e.CONFIG if k != factor)
    return f"""SELECT {keys}, "first", "second", round("first" - "second", 6) AS difference FROM (
        SELECT {keys}, round(avg({value}) FILTER ({factor} = '{first}'), 6) AS "first", round(avg({value}) FILTER ({factor} = '{second}'), 6) AS "second"
        FROM {_RANKED} GROUP BY ALL) WHERE "first" IS NOT NULL AND "second" IS NOT NULL"""


_FILES = " UNION ALL ".join(
    f"SELECT id AS model_id, '{w}' AS direction, printf('intermediate-%.4f-%02d.hdf5', {w}_val_loss, patience) AS file, {w}_val_loss AS loss, patience AS epoch FROM model WHERE {w}_val_loss IS NOT NULL"
    for w in ("forwards", "backwards")
)
_CONFIGS = """
  SELECT 'context-' || c || ',dropout-' || x || ',optimizer-' || o || ',partition-' || p AS slug
  FROM (VALUES ('adam'), ('rmsprop')) a(o), (VALUES ('9'), ('15'), ('20')) b(c), (VALUES ('None'), ('0.75')) d(x), (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) f(p)
  UNION ALL SELECT 'context-9,optimizer-nadam,partition-0'"""

ORACLES = {
    "results_with_models": f"SELECT model_id, id, optimizer, dropout_label, " + ", ".join(f"round({x.replace('_rank', '_rr')}, 6) AS {x.replace('_rank', '_rr')}" for x in e.RANKS) + f" FROM {_RANKED}",
    "mrr_by_config": _mrr(", ".join(e.CONFIG)),
    "mrr_by_partition": _mrr("partition, training_set_size"),
    "mrr_of_set_size": _mrr("mutation", "training_set_size = 11000"),
    "rank_histogram": """SELECT least(coalesce(true_fix_rank, 5), 5) AS rank, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM (SELECT DISTINCT * FROM result) GROUP BY 1""",
    "optimizer_effect": _effect("optimizer", "adam", "rmsprop", "line_location_rr"),
    "dropout_effect": _effect("dropout_label", "None", "0.75", "valid_fix_rr"),
    "paired_t": f"""
        WITH d AS (SELECT avg(line_location_rr) FILTER (optimizer = 'adam') - avg(line_location_rr) FILTER (optimizer = 'rmsprop') AS x FROM {_RANKED} GROUP BY training_set_size, tool)
        SELECT count(x) AS n, round(avg(x), 6) AS mean_difference, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) AS t FROM d""",
    "one_sample_t": f"""SELECT count(*) AS n, round(avg(exact_location_rr), 6) AS mean, round((avg(exact_location_rr) - 0.25) / (stddev_samp(exact_location_rr) / sqrt(count(*))), 6) AS t
        FROM {_RANKED}""",
    "val_loss_correlation": f"""SELECT count(*) AS n, round(corr(mean_val_loss, valid_fix_rr), 6) AS r, round(regr_slope(valid_fix_rr, mean_val_loss), 6) AS slope,
        round(regr_intercept(valid_fix_rr, mean_val_loss), 6) AS intercept, round(quantile_cont(valid_fix_rr, 0.5), 6) AS median FROM {_RANKED} WHERE mean_val_loss IS NOT NULL""",
    "model_best": f"SELECT direction, arg_min(file, (round(loss, 4), file)) AS best, arg_max(file, (epoch, file)) AS latest FROM ({_FILES}) GROUP BY direction",
    "model_losses": f"SELECT model_id, direction, file, CAST(printf('%.4f', loss) AS DOUBLE) AS loss, epoch FROM ({_FILES})",
    "model_pairs": f"""WITH f AS ({_FILES}), b AS (SELECT model_id, direction, arg_min(file, (loss, file)) AS best FROM f GROUP BY 1, 2)
        SELECT x.model_id, x.best AS forwards, y.best AS backwards FROM b x JOIN b y ON x.model_id = y.model_id AND x.direction = 'forwards' AND y.direction = 'backwards'""",
    "model_manifest": "SELECT DISTINCT id AS model_id, replace(hidden_layers, ',', '-') AS layers, CAST(ceil(training_set_size / 32) AS BIGINT) AS batches FROM model",
    "config_grid": f"SELECT slug, sha256(slug) AS model_id FROM ({_CONFIGS})",
    "experiment_plan": f"SELECT slug, sha256(slug) AS model_id, evaluation FROM ({_CONFIGS}), (VALUES ('mutations-all'), ('limit-10,mutations-insertion')) v(evaluation)",
}
