"""Classification metrics as aggregates and windows: confusion, exact ROC-AUC and average precision, top-k recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Slices of a score's range for running sums.
SLICES = 4096


def confusion(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts, accuracy, precision, recall, F1 (0 where undefined) and false-negative rate (null without positives)."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return out.withColumns({"accuracy": part(tp + tn, tp + fp + fn + tn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn),
                            "f1": part(2 * tp, 2 * tp + fp + fn), "false_negative_rate": F.try_divide(fn.cast("double"), tp + fn)})


def ranked(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC (ties count half), average precision (steps over distinct scores) and Brier score; null for one class.

    Rows are first counted per distinct score, so the running sums order thresholds, not rows.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    steps = rows.groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("b"))
    # Running sums within slices of the score, then the sums of the slices above: no task holds all scores of a model.
    ends = steps.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    slice_ = F.coalesce(F.floor(F.try_divide(F.col("s").cast("double") - F.col("lo"), F.col("hi").cast("double") - F.col("lo")) * SLICES), F.lit(0))
    steps = steps.join(ends, by).withColumn("slice", slice_).drop("lo", "hi")
    above = W.partitionBy(*by).orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy(*by, "slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    sums = sums.select(*by, "slice", *[F.coalesce(F.sum(x).over(above), F.lit(0.0)).alias(f"{x}_above") for x in ("sp", "sn")])
    down = W.partitionBy(*by, "slice").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumns({"cp": F.sum("p").over(down), "cn": F.sum("n").over(down)}).join(sums, [*by, "slice"])
    steps = steps.withColumns({"cp": F.col("cp") + F.col("sp_above"), "cn": F.col("cn") + F.col("sn_above")})
    negatives_below = F.col("all_n") - F.col("all_p") - (F.col("cn") - F.col("cp"))
    steps = steps.join(steps.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")), by)
    out = steps.groupBy(*by).agg(
        (F.sum(F.col("p") * (negatives_below + (F.col("n") - F.col("p")) / 2.0)) / F.nullif(F.max("all_p") * (F.max("all_n") - F.max("all_p")), F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.nullif(F.max("all_p"), F.lit(0.0))).alias("average_precision"), (F.sum("b") / F.sum("n")).alias("brier"),
        (F.max("all_p") * (F.max("all_n") - F.max("all_p")) == 0).alias("single_class"),
    )
    return out.withColumn("average_precision", F.when(~F.col("single_class"), F.col("average_precision"))).drop("single_class")


def top_k_recall(df: DataFrame, by: list[str], key: str, ks: tuple[int, ...] = (10, 25, 50), label: str = "label", score: str = "score") -> DataFrame:
    """(k, recall): share of the positives among the k best scores."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), key))
    total = df.groupBy(*by).agg(F.sum(label).alias("all_p"))
    best = df.withColumn("place", place).where(F.col("place") <= max(ks)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("place <= k")
    return best.groupBy(*by, "k").agg(F.sum(label).alias("hits")).join(total, by).select(*by, "k", F.try_divide(F.col("hits").cast("double"), F.col("all_p")).alias("recall"))


def stratified(df: DataFrame, label: str, key: str, test_share: float = 0.25, seed: int = 42, shares: tuple[tuple[str, float | None], ...] | None = None) -> DataFrame:
    """``df`` with split: the first share of each class in the order of md5(key:seed) is ``test``, the rest ``train``.

    ``shares`` names other parts, in order, the last of them (share None) taking the rest. Labels with one row only are
    all in the last part, or in ``train`` where there is one.
    """
    shares = shares or (("test", test_share), ("train", None))
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    out = df.withColumns({"_o": order, "_b": F.substring(order, 1, 3)})
    # Ranks within each of the 4096 first three digits, plus the rows of the digits before: at most 4096 sums a label.
    sizes = out.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_k")).agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(W.partitionBy("_l").orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_l", "_k", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(W.partitionBy("_l")).alias("_n"))
    out = out.withColumn("_r", F.row_number().over(W.partitionBy(label, "_b").orderBy("_o", key)))
    out = out.join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_k")))
    place = F.col("_r") + F.col("_before")
    names = [name for name, _ in shares]
    split, upto = F.when(F.col("_n") == 1, "train" if "train" in names else names[-1]), 0.0
    for name, share in shares[:-1]:
        upto += share
        split = split.when(place <= F.round(F.col("_n") * upto), name)
    split = split.otherwise(names[-1])
    return out.withColumn("split", split).select(*df.columns, "split")
