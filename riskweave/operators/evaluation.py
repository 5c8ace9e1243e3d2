"""Prediction quality: confusion counts, F1 family, false-positive rates, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.salting import salted_left_join
from riskweave.sources.tables import require_columns

BLANK_CLASSES = ["", "nan", "None"]


def join_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows present on both sides: ``true``, ``pred`` and, if given, ``department``.

    Joined on ``event_id`` where both have it, else on ``user_id``. With an
    ``anomaly_type`` on both sides the classes are the types, else 0 and 1.
    """
    key = "event_id" if "event_id" in predictions.columns and "event_id" in labels.columns else "user_id"
    require_columns(predictions, key, "is_anomaly")
    require_columns(labels, key, "is_anomaly")
    typed = "anomaly_type" in predictions.columns and "anomaly_type" in labels.columns

    def klass(c: str = "is_anomaly") -> Column:
        if typed:
            return F.coalesce(F.col("anomaly_type"), F.lit(""))
        return F.col("is_anomaly").cast("int").cast("string")

    extra = ["department"] if "department" in predictions.columns else []
    left = predictions.select(key, klass().alias("pred"), *extra)
    return left.join(labels.select(key, klass().alias("true")), key, "inner")


def confusion_matrix(joined: DataFrame) -> DataFrame:
    """(true, pred, n), one row per pair of classes that occurs."""
    return joined.groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined.

    Every confusion cell adds to its true and to its predicted class, so one
    grouping serves all classes. Blank classes count in totals but get no row.
    """
    sides = F.array(
        F.struct(F.col("true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    sums = confusion.select(F.explode(sides).alias("s")).groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp")
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    both = F.col("predicted") + F.col("support")
    return sums.select(
        "class", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"),
        F.when(both > 0, 2 * F.col("tp") / both).otherwise(F.lit(0.0)).alias("f1"),
    )


def summary_metrics(joined: DataFrame, binary: bool = True) -> DataFrame:
    """One row: overall, macro and weighted F1, and the false-positive rate.

    Overall is the positive class's F1 for two classes, else micro F1.
    """
    per_class = class_metrics(confusion_matrix(joined))
    rows = F.sum("support")
    positive = F.coalesce(F.max(F.when(F.col("class") == "1", F.col("f1"))), F.lit(0.0))
    micro = F.when(rows > 0, F.sum("tp") / rows).otherwise(F.lit(0.0))
    weighted = F.when(rows > 0, F.sum(F.col("f1") * F.col("support")) / rows).otherwise(F.lit(0.0))
    negatives = F.max(F.when(F.col("class") == "0", F.col("support")))
    true_negatives = F.max(F.when(F.col("class") == "0", F.col("tp")))
    fpr = F.coalesce(F.when(negatives > 0, (negatives - true_negatives) / negatives), F.lit(0.0))
    return per_class.agg(
        F.coalesce(rows, F.lit(0)).alias("rows"),
        (positive if binary else micro).alias("overall_f1"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(weighted, F.lit(0.0)).alias("weighted_f1"),
        (fpr if binary else F.lit(0.0)).alias("false_positive_rate"),
    )


def fpr_by_department(joined: DataFrame) -> DataFrame:
    """False-positive rate of every department that has rows; 0 without negatives."""
    negative = F.col("true") == "0"
    fp = F.count_if(negative & (F.col("pred") == "1"))
    return joined.where("department is not null").groupBy("department").agg(
        F.when(F.count_if(negative) > 0, fp / F.count_if(negative)).otherwise(F.lit(0.0)).alias("false_positive_rate")
    )


def metric_report(joined: DataFrame, binary: bool = True) -> DataFrame:
    """Everything in one long table: (metric, class, department, value)."""
    no_text = F.lit(None).cast("string")
    whole = summary_metrics(joined, binary)
    names = ["overall_f1", "macro_f1", "weighted_f1", "false_positive_rate"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    parts = [whole.select(F.explode(pairs).alias("p")).select("p.metric", no_text.alias("class"), no_text.alias("department"), "p.value")]
    per_class = class_metrics(confusion_matrix(joined)).where(~F.col("class").isin(BLANK_CLASSES))
    class_pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("precision", "recall", "f1")])
    parts.append(per_class.select("class", F.explode(class_pairs).alias("p")).select(
        "p.metric", "class", no_text.alias("department"), "p.value"))
    parts.append(confusion_matrix(joined).select(
        F.concat(F.lit("confusion_true_"), "true").alias("metric"), F.col("pred").alias("class"),
        no_text.alias("department"), F.col("n").cast("double").alias("value")))
    if binary and "department" in joined.columns:
        parts.append(fpr_by_department(joined).select(
            F.lit("false_positive_rate").alias("metric"), no_text.alias("class"), "department",
            F.col("false_positive_rate").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metric_gate(summary: DataFrame, min_f1: float = 0.75, max_fpr: float = 0.20) -> DataFrame:
    ok_f1, ok_fpr = F.col("overall_f1") > min_f1, F.col("false_positive_rate") < max_fpr
    return summary.select(
        "overall_f1", "false_positive_rate", ok_f1.alias("f1_met"), ok_fpr.alias("fpr_met"), (ok_f1 & ok_fpr).alias("passed")
    )


def align_labels(identities: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label`` to every identity; the unlabelled count as 0."""
    one = labels.groupBy("user_id").agg(F.max("is_anomaly").alias("label"))
    return identities.join(one, "user_id", "left").fillna(0, ["label"])


def evaluation_status(aligned: DataFrame) -> DataFrame:
    """One row: rows, matching positives, and whether a holdout can be run."""
    positives, rows = F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))
    return aligned.agg(
        rows.alias("rows"), positives.alias("label_match_count"),
        F.when(positives == 0, "label_mismatch").when((positives == rows) | (rows < 10), "empty")
        .otherwise("ok").alias("status"),
    )


def event_predictions(event_labels: DataFrame, events: DataFrame, user_predictions: DataFrame) -> DataFrame:
    """Each labelled event takes its user's prediction; unknown events and users get 0."""
    known = events.select("event_id", "user_id").join(event_labels.select("event_id"), "event_id", "left_semi")
    predicted = user_predictions.select("user_id", F.col("is_anomaly").alias("p"))
    per_event = salted_left_join(known, predicted, ["user_id"], F.col("event_id"))
    best = per_event.groupBy("event_id").agg(F.max("p").alias("p"))
    out = event_labels.select("event_id").join(best, "event_id", "left")
    return out.select("event_id", F.coalesce(F.col("p").cast("int"), F.lit(0)).alias("is_anomaly"))


def event_confusion(event_labels: DataFrame, user_predictions: DataFrame) -> DataFrame:
    """(true, pred, n) of labelled events (user_id, is_anomaly) whose users have predictions (user_id, is_anomaly).

    An event takes its user's prediction, 0 where there is none, so an event's pair of classes
    follows from its user and label: what leaves the log are counts by (user, label), combined
    before they are moved, and no event row is shuffled. For labels that don't carry the user
    there is ``event_predictions``.
    """
    require_columns(event_labels, "user_id", "is_anomaly")
    require_columns(user_predictions, "user_id", "is_anomaly")
    counts = event_labels.groupBy("user_id", F.col("is_anomaly").cast("int").cast("string").alias("true")).agg(F.count(F.lit(1)).alias("n"))
    guessed = user_predictions.groupBy("user_id").agg(F.max(F.col("is_anomaly").cast("int")).alias("p"))
    pred = F.coalesce("p", F.lit(0)).cast("string")
    return counts.join(guessed, "user_id", "left").groupBy("true", pred.alias("pred")).agg(F.sum("n").alias("n"))
