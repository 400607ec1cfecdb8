"""Modelling dataset: features, close and the forward-return target."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.operators.columns import drop_any_null, drop_incomplete
from barloom.operators.indicators import blocked_target
from barloom.operators.joins import join_in_segments
from barloom.operators.series import positions_in_blocks, positions_in_segments
from barloom.schemas import FEATURE_PRESETS, KEYS, TARGET


def preset(features: str | Sequence[str]) -> list[str]:
    if isinstance(features, str):
        if features not in FEATURE_PRESETS:
            raise ValueError(f"unknown feature preset {features}: {sorted(FEATURE_PRESETS)}")
        return list(FEATURE_PRESETS[features])
    return list(features)


def modeling_dataset(
    feature_rows: DataFrame, bars: DataFrame, features="core4", drop: str = "subset"
) -> DataFrame:
    """``ticker, date, close``, the features and ``target_5d``, complete rows only.

    The target looks ahead in the joined rows, before incomplete ones are dropped. ``drop="any"``
    checks every column, ``"subset"`` the features and the target.
    """
    return _complete_rows(feature_rows, bars, features, drop).drop("rn", "_blk")


def _complete_rows(feature_rows: DataFrame, bars: DataFrame, features, drop: str = "subset") -> DataFrame:
    """The dataset's rows with their place ``rn`` among the joined rows and its block ``_blk``."""
    names = preset(features)
    joined = join_in_segments(feature_rows.select(*KEYS, *names), bars)
    rows = blocked_target(positions_in_segments(joined.select(*KEYS, "close", *names, "_seg")))
    if drop == "any":
        return drop_any_null(rows)
    if drop != "subset":
        raise ValueError(f"drop must be 'subset' or 'any', not {drop!r}")
    return drop_incomplete(rows, [*names, TARGET])


def positioned_dataset(feature_rows: DataFrame, bars: DataFrame, features="core4") -> DataFrame:
    """The dataset with ``rn`` and ``n``, the basis of every split."""
    return positions_in_blocks(_complete_rows(feature_rows, bars, features))
