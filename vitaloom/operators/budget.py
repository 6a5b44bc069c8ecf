"""Context within a token budget: prefixes, suffixes and lines by running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.functions import fixed


def prefix(df: DataFrame, by: list[str], order: list, cost: str, budget: int, first_free: bool = True) -> DataFrame:
    """Rows in order while their running cost fits; the first one may exceed the budget. Costs are at least 1, so what fits is a prefix."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumns({"used": run, "place": F.row_number().over(w)})
    return out.where((F.col("used") <= budget) | (F.col("place") == 1) if first_free else F.col("used") <= budget)


def suffix(df: DataFrame, by: list[str], newest: list, cost: str, budget: int = fixed.TURN_TOKENS) -> DataFrame:
    """Newest rows whose running cost fits; none is exempt."""
    return prefix(df, by, newest, cost, budget, first_free=False)


def lines(docs: DataFrame, id_col: str, text_col: str, budget: int, estimate) -> DataFrame:
    """Text cut to whole lines within the budget, with a note if anything was cut."""
    note = "\n\n(Older entries omitted to stay within the review limit.)"
    costs = F.transform(F.split(text_col, "\n"), lambda x: F.struct(x.alias("line"), estimate(x).alias("cost")))
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(acc, x):
        over = acc["over"] | (acc["used"] + x["cost"] > budget)
        return F.struct(F.when(over, acc["used"]).otherwise(acc["used"] + x["cost"]).alias("used"), over.alias("over"), F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["line"]))).alias("kept"))

    kept = F.aggregate(costs, zero, step)["kept"]
    whole = estimate(F.col(text_col)) <= budget
    return docs.select(id_col, F.when(whole, F.col(text_col)).otherwise(F.concat(F.array_join(kept, "\n"), F.lit(note))).alias("text"), (~whole).alias("cut"))
