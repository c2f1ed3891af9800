"""Long nutrient rows to wide vectors, and the tail that stays long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larder import fixed

NutrientMap = Mapping[str, Sequence[int]]


def pivot_columns(nutrients: NutrientMap, nutrient_id: str = "nutrient_id",
                  amount: str = "amount") -> list[Column]:
    """One aggregate per column: the first of its ids that has a value.

    Written as conditional maxima because the order of the ids is the point;
    a pivot would drop it and shuffle once more.
    """
    def of(n: int) -> Column:
        return F.max(F.when(F.col(nutrient_id) == n, F.col(amount)))

    return [F.coalesce(*[of(n) for n in ids]).alias(name) for name, ids in nutrients.items()]


def wide(rows: DataFrame, key: str, nutrients: NutrientMap = fixed.APP_NUTRIENTS) -> DataFrame:
    return rows.groupBy(key).agg(*pivot_columns(nutrients))


def in_wide(nutrients: NutrientMap = fixed.APP_NUTRIENTS, nutrient_id: str = "nutrient_id") -> Column:
    return F.col(nutrient_id).isin([n for ids in nutrients.values() for n in ids])


def nutrient_dimension(rows: DataFrame, nutrients: NutrientMap = fixed.APP_NUTRIENTS) -> DataFrame:
    """Name, unit and sort order of every nutrient left out of the wide vector."""
    return rows.filter(~in_wide(nutrients) & F.col("nutrient_name").isNotNull()).groupBy("nutrient_id").agg(
        F.min("nutrient_name").alias("name"),
        F.min("unit_name").alias("unit"),
        F.coalesce(F.min("nutrient_rank"), F.lit(fixed.MISSING_RANK)).cast("int").alias("sort_order"),
    )


def long_tail(rows: DataFrame, key: str, nutrients: NutrientMap = fixed.APP_NUTRIENTS) -> DataFrame:
    """Amounts that are not a wide column, of nutrients that have a name somewhere."""
    tail = rows.filter(~in_wide(nutrients) & F.col("amount").isNotNull())
    return tail.join(nutrient_dimension(rows, nutrients), "nutrient_id", "left_semi").select(
        key, "nutrient_id", "amount"
    )


def macro_input(foods: DataFrame, rows: DataFrame, key: str = "fdc_id",
                nutrients: NutrientMap | None = None) -> DataFrame:
    """Foods with their three macros and how many nutrients each carries."""
    chosen = nutrients or {m: fixed.APP_NUTRIENTS[m] for m in fixed.MERGE_MACROS}
    macros = rows.groupBy(key).agg(*pivot_columns(chosen), F.count(F.lit(1)).alias("n_nutrients"))
    return foods.drop(*chosen, "n_nutrients").join(macros, key, "left").withColumn(
        "n_nutrients", F.coalesce("n_nutrients", F.lit(0)).cast("bigint")
    )
