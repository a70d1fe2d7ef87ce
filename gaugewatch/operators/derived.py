"""Measures computed from several tags of a row, and how far alternative sums of one flow lie apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.functions.columns import tick

# Coefficients of the two turbine stages and the names of the results.
HP_COEFFICIENT, LP_COEFFICIENT = 44.18, 355.45
DERIVED = (
    "HP_TURBINE_STEAM_FLOW",
    "HP_turbine_steam_flow_calculated",
    "GES_calculated",
    "Total_turbine_steam_flow_calculated",
    "LP_turbine_steam_flow_calculated",
)
TWO_PHASE = (
    "HP_VENTURI_STEAM_plus_HP_BRINE",
    "Sum_of_wells",
    "HP_VENTURI_STEAM_plus_LP_BRINE_plus_LP_STEAM",
    "TOTAL_TURBINE_FLOW_plus_GES_plus_LP_BRINE",
)


def stage_flow(coefficient: float, before: Column, after: Column) -> Column:
    """Steam through a turbine stage between two absolute pressures; NULL where the pressure rises."""
    return F.when(before >= after, F.lit(coefficient) * F.sqrt(before * before - after * after))


def derived_tags(
    wide: DataFrame,
    hp_coefficient: float = HP_COEFFICIENT,
    lp_coefficient: float = LP_COEFFICIENT,
    to_absolute: float = 0.0,
) -> DataFrame:
    """The wide table with the measures of ``DERIVED``; NULL where an input is.

    ``to_absolute`` is added to the chamber pressures, for tags that measure against the
    surrounding air; the condenser pressure is absolute.
    """
    steam, supply = tick("HP_STEAM_FLOW_ALL"), tick("HP_GES_STEAM_SUPPLY")
    hp_chamber = tick("Turbine_Hp_Chamber_Pressure") + to_absolute
    lp_chamber = tick("Turbine_Lp_Chamber_Pressure") + to_absolute
    through_hp = stage_flow(hp_coefficient, hp_chamber, lp_chamber)
    through_both = stage_flow(lp_coefficient, lp_chamber, tick("Condenser_Pressure_A"))
    measures = (steam - supply, through_hp, steam - through_hp, through_both, through_both - through_hp)
    return wide.withColumns(dict(zip(DERIVED, measures)))


def cross_check(wide: DataFrame, wells: tuple[str, ...], least_flow: float = 0.0) -> DataFrame:
    """The wide table with the sums of ``TWO_PHASE``, their spread, and the spread over their mean.

    Wells below ``least_flow`` count as closed. A sum is NULL where an input is; the spread
    is that of the sums that are there, NULL without any.
    """
    if not wells:
        raise ValueError("name the columns of the wells")
    steam, supply, reinjected = tick("HP_STEAM_FLOW_ALL"), tick("HP_GES_STEAM_SUPPLY"), tick("BRINE_FLOW_TO_REINJECTION")
    closed = lambda well: F.when(tick(well) >= least_flow, tick(well)).when(tick(well).isNotNull(), 0.0)
    sums = (
        steam + tick("HP_BRINE_FLOW"),
        reduce(Column.__add__, map(closed, wells)),
        steam + reinjected + tick("LP_STEAM_FLOW"),
        tick("Total_Turbine_Steam_Flow") + supply + reinjected,
    )
    summed = wide.withColumns(dict(zip(TWO_PHASE, sums)))
    columns = [tick(name) for name in TWO_PHASE]
    there = reduce(Column.__add__, [c.isNotNull().cast("int") for c in columns])
    total = reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) for c in columns])
    spread = F.greatest(*columns) - F.least(*columns)
    return summed.withColumn("spread", spread).withColumn(
        "relative_spread", F.try_divide("spread", F.try_divide(total, there))
    )
