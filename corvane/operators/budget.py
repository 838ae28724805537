"""Token budgets: the ranked prefix that fits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check_budget(budget: float) -> float:
    if isinstance(budget, bool) or not isinstance(budget, (int, float)) or not math.isfinite(budget) or budget < 0:
        raise ValueError("budget must be a non-negative finite number")
    return budget


def fit_to_budget(items: DataFrame, group: list[str], order: list[str], size: str, budget: F.Column | float) -> DataFrame:
    """``items`` with ``used``, the running total, and ``included``: whether the item lies before the first overflow.

    Sizes are not negative, so the items whose running total stays within the budget are a prefix; nothing smaller
    behind the first overflow is let in.  ``group`` partitions the items, as by task; each group is a ranked list.
    """
    limit = budget if isinstance(budget, F.Column) else F.lit(check_budget(budget))
    used = F.sum(size).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return items.withColumn("used", used).withColumn("included", F.col("used") <= limit)
