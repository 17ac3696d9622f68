"""Prediction quality over proposals: deltas, confusion matrix, metrics, thresholds, histogram.

All of these run over the whole proposals table as a handful of aggregates;
nothing is fetched page by page or pulled to the driver.  The per-proposal
frame (``quality_frame``) has ``actual``, ``predicted``, ``delta1`` and
``delta2`` columns and is the single input of the matrix, the thresholds and
the histogram, so a caller that needs all three can cache it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PF, PA, PB = "predicted_for_shares", "predicted_against_shares", "predicted_abstain_shares"
TF, TA, TB = "total_for_shares", "total_against_shares", "total_abstain_shares"

# fixed values: delta thresholds of the summary table, in order
DELTA_THRESHOLDS = (0.15, 0.30, 0.50, 0.75)


def _num0(c: str) -> Column:
    """A present column's NULL counts as 0 in the delta formulas."""
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


# ------------------------------------------------------------------ A18 / A19
def _absent(columns: Sequence[str] | None, needed: Sequence[str]) -> bool:
    """Whether a table of these columns lacks one that a delta needs."""
    return columns is not None and any(c not in columns for c in needed)


def delta1(form: str = "table", columns: Sequence[str] | None = None) -> Column:
    """|pred_for - true_for| / |true_for|; NULL where ``columns``, the table's,
    lack one of the two.

    ``table``: a zero (or NULL) true_for divides by 1.  ``quality``: NULL then.
    """
    if _absent(columns, (PF, TF)):
        return F.lit(None).cast("double")
    pred, truth = _num0(PF), _num0(TF)
    num = F.abs(pred - truth)
    if form == "table":
        return num / F.when(truth == 0, F.lit(1.0)).otherwise(F.abs(truth))
    if form == "quality":
        return F.when(truth != 0, num / F.abs(truth))
    raise ValueError(f"unknown form {form!r}")


def delta2(form: str = "table", columns: Sequence[str] | None = None) -> Column:
    """|pf/(pf+pa+pb) - tf/(tf+ta+tb)|; zero denominators -> 1 (table) or NULL
    (quality); NULL where ``columns``, the table's, lack one of the six."""
    if _absent(columns, (PF, PA, PB, TF, TA, TB)):
        return F.lit(None).cast("double")
    pf, pa, pb, tf, ta, tb = (_num0(c) for c in (PF, PA, PB, TF, TA, TB))
    pd, td = pf + pa + pb, tf + ta + tb
    if form == "table":
        pd1 = F.when(pd == 0, F.lit(1.0)).otherwise(pd)
        td1 = F.when(td == 0, F.lit(1.0)).otherwise(td)
        return F.abs(pf / pd1 - tf / td1)
    if form == "quality":
        return F.when((pd != 0) & (td != 0), F.abs(pf / pd - tf / td))
    raise ValueError(f"unknown form {form!r}")


def with_deltas(proposals: DataFrame, form: str = "table") -> DataFrame:
    cols = proposals.columns
    return proposals.withColumn("delta1", delta1(form, cols)).withColumn("delta2", delta2(form, cols))


def quality_set(proposals: DataFrame) -> DataFrame:
    """Proposals that enter the quality deltas: true_for exactly 0 is excluded
    from both metrics; a NULL true_for stays (it only loses Delta1)."""
    if TF not in proposals.columns:
        return proposals
    tf = F.col(TF)
    return proposals.filter(tf.isNull() | (tf != 0))


# ---------------------------------------------------------------------- F5
def delta_filter(proposals: DataFrame, max_delta1: float | None = None,
                 max_delta2: float | None = None) -> DataFrame:
    """Keep proposals whose (table-form) deltas are known and within bounds; None = no bound."""
    df = with_deltas(proposals, "table")
    if max_delta1 is not None:
        df = df.filter(F.col("delta1").isNotNull() & (F.col("delta1") <= max_delta1))
    if max_delta2 is not None:
        df = df.filter(F.col("delta2").isNotNull() & (F.col("delta2") <= max_delta2))
    return df


# ---------------------------------------------------------------------- F7
def quality_filter(proposals: DataFrame, issuer: str | None = None, proposal_type: str | None = None,
                   outcome: str | None = None, category: str | None = None,
                   subcategory: str | None = None) -> DataFrame:
    """Case-sensitive filters of the quality view; None means no filter.

    ``outcome`` is 'Approved' or 'Rejected' on ``approved``; category and
    subcategory also match the alternative ``categorization`` /
    ``subcategorization`` columns when the table has them.
    """
    cols = set(proposals.columns)
    cond = F.lit(True)
    if issuer is not None:
        cond = cond & (F.col("issuer_name") == issuer)
    if proposal_type is not None:
        cond = cond & (F.col("proposal_type") == proposal_type)
    if outcome == "Approved":
        cond = cond & (F.col("approved") == F.lit(True))
    elif outcome == "Rejected":
        cond = cond & (F.col("approved") == F.lit(False))
    elif outcome is not None:
        raise ValueError(f"unknown outcome {outcome!r}")
    for value, names in ((category, ("categorization", "category")),
                         (subcategory, ("subcategorization", "subcategory"))):
        if value is None:
            continue
        present = [n for n in names if n in cols]
        if not present:
            raise ValueError(f"no column among {names}")
        m = F.lit(False)
        for n in present:
            m = m | F.coalesce(F.col(n) == value, F.lit(False))
        cond = cond & m
    return proposals.filter(F.coalesce(cond, F.lit(False)))


# --------------------------------------------------------------------- A16
def _actual(cols: Sequence[str]) -> tuple[Column, Column]:
    """(valid, actual): row by row from the first of approved,
    proposal_approved and outcome that holds a value."""
    found = []
    for c in ("approved", "proposal_approved"):
        if c in cols:
            found.append(F.col(c).try_cast("boolean"))
    if "outcome" in cols:
        c = F.col("outcome").cast("string")
        found.append(F.when(c.isNotNull(), c.isin("approved", "Approved", "1")))
    if not found:
        raise ValueError("no outcome column (approved / proposal_approved / outcome)")
    value = F.coalesce(*found) if len(found) > 1 else found[0]
    return value.isNotNull(), value


def _predicted(cols: Sequence[str], actual: Column) -> Column:
    """Predicted approval; the fallback is chosen from the columns present (plan time)."""
    if PF in cols and PA in cols:
        by_shares = _num0(PF) > _num0(PA)
    elif "for_percentage" in cols:
        by_shares = _num0("for_percentage") > 0.5
    elif "Target_encoded" in cols:
        by_shares = F.coalesce(F.col("Target_encoded").cast("string") == "1", F.lit(False))
    else:
        # the first in the table's column order
        model = [c for c in cols if "prediction_model" in c or "score_model" in c]
        by_shares = _num0(model[0]) > 0.5 if model else F.lit(False)
    if "prediction_correct" in cols:
        pc = F.col("prediction_correct").cast("boolean")
        return F.when(pc.isNotNull(), F.when(pc, actual).otherwise(~actual)).otherwise(by_shares)
    return by_shares


def quality_frame(proposals: DataFrame) -> DataFrame:
    """Per proposal: valid, actual, predicted (the confusion-matrix inputs)."""
    cols = proposals.columns
    valid, actual = _actual(cols)
    actual_b = F.coalesce(actual, F.lit(False))
    return proposals.select(
        "*",
        valid.alias("valid"),
        actual_b.alias("actual"),
        F.coalesce(_predicted(cols, actual_b), F.lit(False)).alias("predicted"),
    )


def confusion_matrix(proposals: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """TP / FP / FN / TN over valid proposals, plus total and valid counts.

    One aggregate (optionally per group): a partial aggregate per map task,
    so a single hot group costs nothing extra.
    """
    q = quality_frame(proposals)
    v, a, p = F.col("valid"), F.col("actual"), F.col("predicted")
    aggs = [
        F.count_if(v & p & a).cast("bigint").alias("tp"),
        F.count_if(v & p & ~a).cast("bigint").alias("fp"),
        F.count_if(v & ~p & a).cast("bigint").alias("fn"),
        F.count_if(v & ~p & ~a).cast("bigint").alias("tn"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(v).cast("bigint").alias("valid"),
    ]
    return q.groupBy(*group_by).agg(*aggs)


# --------------------------------------------------------------------- A17
def metrics_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Accuracy, precision, recall, F1; each 0 when its denominator is 0."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    total = tp + fp + fn + tn
    acc = F.when(total > 0, (tp + tn) / total).otherwise(F.lit(0.0))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return [acc.alias("accuracy"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1_score")]


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Append the four metrics to a confusion-matrix frame (any grouping)."""
    return matrix.select("*", *metrics_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


# --------------------------------------------------------------------- A20
def delta_long(proposals: DataFrame) -> DataFrame:
    """Quality-form deltas as (id, metric, value) rows, NULL values dropped."""
    d = with_deltas(quality_set(proposals), "quality")
    return d.select("id", F.expr("stack(2, 'delta1', delta1, 'delta2', delta2) AS (metric, value)")) \
        .filter(F.col("value").isNotNull())


def threshold_table(proposals: DataFrame, thresholds: Sequence[float] = DELTA_THRESHOLDS) -> DataFrame:
    """Per metric and threshold: proposals with delta <= threshold, their percent
    (1 decimal) of all non-NULL deltas.  Cumulative counts, not bins."""
    d = delta_long(proposals)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(F.col("value") <= t).alias(f"c{i}") for i, t in enumerate(thresholds)]
    per = d.groupBy("metric").agg(*aggs)
    stack = ", ".join(f"CAST({t} AS DOUBLE), c{i}" for i, t in enumerate(thresholds))
    long = per.select("metric", "n", F.expr(f"stack({len(thresholds)}, {stack}) AS (threshold, cnt)"))
    return long.select(
        "metric", "threshold",
        F.col("cnt").cast("bigint").alias("count"),
        F.col("n").cast("bigint").alias("total"),
        F.when(F.col("n") > 0, F.round(F.col("cnt") * 100.0 / F.col("n"), 1)).otherwise(F.lit(0.0)).alias("percent"),
    )


# --------------------------------------------------------------------- A21
def histogram(values: DataFrame, value_col: str = "value", bins: int = 10) -> DataFrame:
    """Equal-width histogram between min and max; the last bin is closed; one
    bin holding everything when min = max.  Output: bin, label (bin start,
    2 decimals), bin_start, count."""
    one = values.select(F.lit(0).alias("_g"), F.col(value_col).alias("_v"))
    return histograms(one, "_g", "_v", bins).drop("_g")


def histograms(values: DataFrame, group_col: str, value_col: str = "value", bins: int = 10) -> DataFrame:
    """``histogram`` for every group of ``group_col`` at once: one min/max
    aggregate per group, one binning aggregate.

    The stats frame has one row per group.  It is not hinted for broadcast:
    its size depends on the caller's grouping, so AQE measures the
    materialised stats stage and broadcasts it only when it is small.  Bins
    come from ``explode(sequence(...))`` on the stats row, so empty bins show
    0 without any cross join.
    """
    v = values.select(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v")) \
        .filter(F.col("v").isNotNull())
    stats = v.groupBy("g").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    single = F.col("mx") == F.col("mn")
    size = F.when(single, F.lit(0.0)).otherwise((F.col("mx") - F.col("mn")) / F.lit(float(bins)))
    stats = stats.select("g", "mn", "mx", size.alias("size"))
    idx = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("mn")) / F.col("size")).cast("int"), F.lit(bins - 1)))
    counts = v.join(stats, "g").groupBy("g", idx.alias("bin")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    frame = stats.select("g", "mn", "size", F.explode(F.sequence(
        F.lit(0), F.when(F.col("size") == 0, F.lit(0)).otherwise(F.lit(bins - 1)))).alias("bin"))
    start = F.col("mn") + F.col("bin") * F.col("size")
    return frame.join(counts, ["g", "bin"], "left").select(
        F.col("g").alias(group_col), "bin",
        F.format_string("%.2f", start).alias("label"), start.alias("bin_start"),
        F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("count"))


def delta_histogram(proposals: DataFrame, metric: str | None = None, bins: int = 10) -> DataFrame:
    """Histogram of the quality-form deltas (both metrics, or one).

    The ranges of both metrics are one row, used as a scalar subquery: values
    are binned and counted without a join on the metric."""
    wanted = [metric] if metric is not None else ["delta1", "delta2"]
    d = with_deltas(quality_set(proposals), "quality").select(*wanted)
    bounds = d.agg(F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*[
        F.struct(F.min(m).alias("mn"), F.max(m).alias("mx")) for m in wanted])).alias("b"))

    def placed(df: DataFrame) -> DataFrame:
        r = F.element_at("_b", F.col("metric"))
        size = F.when(r["mx"] == r["mn"], F.lit(0.0)).otherwise((r["mx"] - r["mn"]) / F.lit(float(bins)))
        return df.withColumn("_b", bounds.scalar()).withColumn("mn", r["mn"]).withColumn("size", size).drop("_b")

    args = ", ".join(f"'{m}', `{m}`" for m in wanted)
    long = d.select(F.expr(f"stack({len(wanted)}, {args}) AS (metric, value)")).filter("value is not null")
    idx = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("mn")) / F.col("size")).cast("int"), F.lit(bins - 1)))
    counts = placed(long).groupBy("metric", idx.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    # a row a bin, counted or not; metrics without values have none
    frame = placed(proposals.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("metric"))) \
        .filter("mn is not null").select("metric", "mn", "size", F.explode(F.sequence(
            F.lit(0), F.when(F.col("size") == 0, F.lit(0)).otherwise(F.lit(bins - 1)))).alias("bin"))
    start = F.col("mn") + F.col("bin") * F.col("size")
    return frame.join(counts, ["metric", "bin"], "left").select(
        "metric", "bin", F.format_string("%.2f", start).alias("label"), start.alias("bin_start"),
        F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("count"))


def quality_report(proposals: DataFrame, group_by: Sequence[str] = (), materialize: bool = False) -> dict[str, DataFrame]:
    """Matrix + metrics, threshold table and histograms from one proposals
    input; ``materialize`` writes the input once to the shared checkpoint
    folder so the three reports read files instead of recomputing it."""
    if materialize:
        from ballotlens.session import materialize as _mat
        proposals = _mat(proposals, "quality-input")
    m = classification_metrics(confusion_matrix(proposals, group_by))
    return {"metrics": m, "thresholds": threshold_table(proposals), "histograms": delta_histogram(proposals)}
