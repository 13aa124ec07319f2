"""Tokens, pooled embeddings, role detection and detector metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import local_table
from ..config import ROLE_DEFAULT_CALL
from ..functions.decisions import role_of
from .ranges import with_slots


def tokens(df: DataFrame, max_length: int = 256) -> DataFrame:
    """Adds tokens: lower-case words, at most max_length."""
    return df.withColumn("tokens", F.slice(F.split(F.lower("text"), r"\s+"), 1, max_length))


def pooled(df: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Mean of the tokens' vectors. df: key, token_ids; vectors: token_id, vector.

    Tokens are counted per text first, so a vector is fetched once per text and token; whole vectors are averaged with partial
    aggregates, one row a text and task, and come apart by dimension only at the end."""
    counted = df.select(key, F.explode("token_ids").alias("token_id")).groupBy(key, "token_id").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(vectors, "token_id").select(key, "n", array_to_vector(F.col("vector").cast("array<double>")).alias("vector"))
    means = met.groupBy(key).agg(Summarizer.mean(F.col("vector"), F.col("n").cast("double")).alias("mean"))
    return means.select(key, F.posexplode(vector_to_array("mean")).alias("dim", "value"))


def with_role(df: DataFrame) -> DataFrame:
    role, matched = role_of(F.col("text"))
    return df.withColumn("role", role).withColumn("matched", matched)


def with_default_call(df: DataFrame) -> DataFrame:
    """Fills tool_name, resource and params of a role's default call where the caller gave none (a given null resource stays)."""
    rows = [(r, t, res, p) for r, (t, res, p) in ROLE_DEFAULT_CALL.items()]
    table = local_table(df.sparkSession, rows, "role string, d_tool string, d_resource string, d_params map<string,string>")
    out = df.join(F.broadcast(table), "role", "left")
    for c, d in (("tool_name", "d_tool"), ("params", "d_params")):
        out = out.withColumn(c, F.coalesce(c, d))
    given = F.col("resource_given") if "resource_given" in df.columns else F.col("resource").isNotNull()
    return out.withColumn("resource", F.when(given, F.col("resource")).otherwise(F.col("d_resource"))).drop("d_tool", "d_resource", "d_params")


def binary_metrics(df: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """loss, accuracy, precision, recall and F1 of columns label and score; empty denominators count as 0."""
    y, flagged = F.col("label") == 1, F.col("score") >= threshold
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score")))
    counts = df.groupBy(*by).agg(
        F.count_if(y & flagged).alias("tp"),
        F.count_if(~y & flagged).alias("fp"),
        F.count_if(y & ~flagged).alias("fn"),
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.when(y, F.log(p)).otherwise(F.log(1 - p))).alias("loss"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.select(*by, F.round("loss", 6).alias("loss"), F.round((F.col("n") - fp - fn) / F.col("n"), 6).alias("accuracy"), F.round(zero(tp, tp + fp), 6).alias("precision"), F.round(zero(tp, tp + fn), 6).alias("recall"), F.round(zero(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def roc_auc(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with ties; null if a class is missing.

    Rows become one per distinct score. Running sums are two-level: within score ranges of about equal numbers and over the
    ranges' totals, so no task sorts all scores, however they crowd."""
    keys = [*by, "slot"]
    scores = df.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    scores = with_slots(scores, by, "score")
    run = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = scores.withColumn("below_in", F.coalesce(F.sum("q").over(run), F.lit(0)))
    slots = inside.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("below_in") + F.col("q") / 2)).alias("wins"))
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    total = slots.withColumn("below", F.coalesce(F.sum("q").over(over), F.lit(0)))
    return total.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("wins") + F.col("p") * F.col("below")), F.sum("p") * F.sum("q")), 6).alias("auc"))
