"""Operational, classification and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import exact_percentiles

# Fixed value: the four outcomes, in report order.
OUTCOMES = ("allow", "tests", "approval", "block")
LOW_SAMPLE = 5


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Ratio with a defined value for an empty denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(empty))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates of the same keys side by side; global ones meet as a scalar subquery."""
    if keys:
        return left.join(right, keys)
    return left.withColumn("_right", right.select(F.struct("*")).scalar()).select("*", "_right.*").drop("_right")


def decision_distribution(metrics: DataFrame) -> DataFrame:
    return metrics.where("decision IS NOT NULL").groupBy("decision").agg(F.count("*").alias("n"))


def ops_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, unknown and shadow rates, latency percentiles and the low-sample flag."""
    prepared = metrics.withColumn(
        "duration_ms", F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0))
    )
    base = prepared.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("unknown").alias("unknowns"),
        F.coalesce(F.sum("shadow_findings"), F.lit(0)).alias("shadow_hit_count"),
        F.count_if(F.col("shadow_findings") > 0).alias("shadow_hits"),
    )
    tails = exact_percentiles(prepared, keys, "duration_ms", [50.0, 95.0])
    return beside(base, tails, keys).select(
        *keys,
        "n",
        share(F.col("unknowns"), F.col("n")).alias("unknown_rate"),
        "shadow_hit_count",
        share(F.col("shadow_hits"), F.col("n")).alias("shadow_hit_rate"),
        F.col("p50").alias("duration_ms_p50"),
        F.col("p95").alias("duration_ms_p95"),
        (F.col("n") < LOW_SAMPLE).alias("low_sample"),
    )


def confusion_cells(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per truth and prediction; labels outside the vocabulary are ignored."""
    keys = keys or []
    return (
        predictions.where(F.col("truth").isin(*OUTCOMES) & F.col("prediction").isin(*OUTCOMES))
        .groupBy(*keys, "truth", "prediction")
        .agg(F.count("*").alias("n"))
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return (
        confusion_cells(predictions)
        .groupBy("truth")
        .pivot("prediction", list(OUTCOMES))
        .agg(F.sum("n"))
        .fillna(0)
    )


def class_scores(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 per class in one pass over the cells."""
    keys = keys or []
    cells = confusion_cells(predictions, keys).withColumn(
        "state", F.explode(F.array_distinct(F.array("truth", "prediction")))
    )
    hit = (F.col("truth") == F.col("state")) & (F.col("prediction") == F.col("state"))
    totals = cells.groupBy(*keys, "state").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("prediction") == F.col("state"), F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when(F.col("truth") == F.col("state"), F.col("n")).otherwise(0)).alias("actual"),
    )
    precision = share(F.col("tp"), F.col("called"))
    recall = share(F.col("tp"), F.col("actual"))
    return totals.select(
        *keys, "state", precision.alias("precision"), recall.alias("recall")
    ).withColumn(
        "f1",
        share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def gate_quality(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro F1, recalls and the two error rates a release gate watches."""
    keys = keys or []
    scores = class_scores(predictions, keys)

    def of(state: str, measure: str) -> Column:
        return F.coalesce(
            F.max(F.when(F.col("state") == state, F.col(measure))), F.lit(0.0)
        )

    per_class = scores.groupBy(*keys).agg(
        (F.sum("f1") / len(OUTCOMES)).alias("macro_f1"),
        of("block", "recall").alias("critical_violation_recall"),
        of("approval", "precision").alias("approval_precision"),
        of("approval", "recall").alias("approval_recall"),
        of("tests", "recall").alias("required_test_recall"),
    )
    truth, called = F.col("truth"), F.col("prediction")
    known = truth.isin(*OUTCOMES) & called.isin(*OUTCOMES)
    rates = predictions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(known & (truth == "block")).alias("blocks"),
        F.count_if(known & (truth == "block") & (called == "allow")).alias("unsafe"),
        F.count_if(known & (truth != "block") & (called == "block")).alias("false_blocks"),
        F.count_if("impact").alias("impacts"),
        F.count_if(F.col("impact") & (called != "allow")).alias("impact_hits"),
    )
    return beside(per_class, rates, keys).select(
        *keys, "macro_f1", "critical_violation_recall", "approval_precision", "approval_recall",
        "required_test_recall",
        share(F.col("unsafe"), F.col("blocks")).alias("unsafe_allow_rate"),
        share(F.col("false_blocks"), F.col("n") - F.col("blocks")).alias("false_block_rate"),
        share(F.col("impact_hits"), F.col("impacts"), 1.0).alias("impact_recall"),
    )


def duration_summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    base = samples.groupBy(*keys).agg(F.avg(value).alias("avg"), F.count("*").alias("n"))
    return base.join(exact_percentiles(samples, keys, value, [50.0, 95.0]), keys)


def content_sums(files: DataFrame, keys: list[str], path: str, content: str) -> DataFrame:
    """Order-independent content sums per group.

    Each file hash is cut into eight 32-bit words that are summed, so any number of files
    combines on the map side and no list is ever sorted or collected.
    """
    hashed = files.withColumn(
        "_hash",
        F.sha2(F.concat(F.length(path).cast("string"), F.lit(":"), F.col(path), F.lit(":"),
                        F.sha2(F.col(content), 256)), 256),
    )
    words = [
        F.sum(F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}")
        for i in range(8)
    ]
    return hashed.groupBy(*keys).agg(F.count("*").alias("n_files"), *words)


def digest_of_sums() -> Column:
    return F.sha2(
        F.concat_ws(",", F.col("n_files"), *[F.col(f"w{i}") for i in range(8)]), 256
    )


def content_digests(files: DataFrame, keys: list[str], path: str, content: str) -> DataFrame:
    return content_sums(files, keys, path, content).select(
        *keys, "n_files", digest_of_sums().alias("digest")
    )


def edge_dedupe(edges: DataFrame, order: str) -> DataFrame:
    """One edge per id, the first seen wins; manual edges are certain."""
    columns = ["source_id", "target_id", "kind", "source", "evidence_uri"]
    first = edges.groupBy("edge_id").agg(
        F.min_by(F.struct(*columns), F.col(order)).alias("_row")
    )
    return first.select("edge_id", "_row.*").withColumn(
        "confidence", F.when(F.col("source") == "manual", 1.0).otherwise(0.9)
    )


def node_merge(facts: DataFrame, properties: DataFrame) -> DataFrame:
    """First kind and label win, later property values win; properties in long form."""
    first = facts.groupBy("id").agg(
        F.min_by("kind", "seq").alias("kind"), F.min_by("label", "seq").alias("label")
    )
    newest = properties.groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
    return first.join(newest, "id", "left")


def recall_at_k(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries with a relevant document among the first k, from one ranking."""
    per_query = ranked.groupBy("query_id").agg(
        *[
            F.bool_or(F.col("relevant") & (F.col("position") <= k)).alias(f"hit_{k}") for k in ks
        ]
    )
    return per_query.agg(
        F.count("*").alias("n_queries"),
        *[F.avg(F.col(f"hit_{k}").cast("double")).alias(f"recall_at_{k}") for k in ks],
    )
