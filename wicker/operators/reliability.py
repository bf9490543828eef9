"""Reliability of co-occurrence evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.params import ReliabilityParams


def reliability_of(p: ReliabilityParams = ReliabilityParams()) -> Column:
    lift, joint = F.col("lift"), F.col("joint_count")
    lift_part = F.when(lift <= 1, F.lit(0.0)).otherwise(1 - F.lit(1.0) / lift)
    joint_part = F.when(joint <= 0, F.lit(0.0)).otherwise(
        1 - F.exp(-joint / F.lit(float(p.joint_count_scale)))
    )
    score = (
        F.lit(p.confidence_weight) * F.col("confidence")
        + F.lit(p.lift_weight) * lift_part
        + F.lit(p.support_weight) * F.col("support")
        + F.lit(p.joint_count_weight) * joint_part
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def with_reliability(df: DataFrame, p: ReliabilityParams = ReliabilityParams()) -> DataFrame:
    """Adds `reliability`; a row of another evidence kind fails the job."""
    value = reliability_of(p)
    if "evidence_kind" in df.columns:
        value = F.when(F.col("evidence_kind") == "co_occurrence", value).otherwise(
            F.raise_error(
                F.concat(F.lit("reliability needs co_occurrence evidence, got "), F.col("evidence_kind"))
            ).cast("double")
        )
    return df.withColumn("reliability", value)
