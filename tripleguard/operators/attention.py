"""Gated attention over neighbourhoods, relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleguard.functions.vectors import dot, gate, leaky_relu


def gated_attention(rows: DataFrame, alpha: float = 0.2, mu: float = 0.001) -> DataFrame:
    """grp, at, value: the attended vector of each group, one row for each place.

    rows: grp, slot (0 is the centre), vec, logit weights a_own and a_centre (arrays). Weights are a softmax in the group, gated, and not normalised again.
    """
    group = Window.partitionBy("grp")
    centre = rows.where("slot = 0").select("grp", F.col("vec").alias("centre"))
    e = leaky_relu(dot(F.col("a_own"), F.col("vec")) + dot(F.col("a_centre"), F.col("centre")), alpha)
    scored = rows.join(centre, "grp").withColumn("e", e)
    raised = scored.withColumn("x", F.exp(F.col("e") - F.max("e").over(group)))
    weighed = raised.withColumn("att", gate(F.col("x") / F.sum("x").over(group), mu))
    return weighed.select("grp", "att", F.posexplode("vec").alias("at", "v")).groupBy("grp", "at").agg(F.sum(F.col("att") * F.col("v").cast("double")).alias("value"))
