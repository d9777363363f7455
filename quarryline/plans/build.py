"""The whole way of a file: bronze, silver and gold tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.infer import cast_typed, collect_types, infer_types
from ..operators.medallion import choose_dimension, promote_gold, promote_silver
from ..sources.tables import load_bronze, replace_table


@dataclass(frozen=True)
class Layers:
    bronze: DataFrame
    silver: DataFrame
    gold: DataFrame
    dimension: str


def build_layers(
    text: DataFrame,
    name: str,
    source: str,
    mode: str = "replace",
    key: list[str] | None = None,
    dimension: str | None = None,
    measure: str | None = None,
    aggregation: str = "COUNT",
    approx: bool = False,
) -> Layers:
    """Text columns typed and stored as ``<name>_bronze``, ``_silver`` and ``_gold``.

    Every layer is read back from its table, so nothing is computed twice and a lost executor
    costs no more than the layer at hand. ``approx`` chooses the dimension by sketches of the
    distinct values, for tables where exact counts are too much.
    """
    typed = cast_typed(text, collect_types(infer_types(text)))
    bronze = load_bronze(typed, name, source, mode)
    silver = replace_table(promote_silver(bronze, key), f"{name}_silver")
    chosen = dimension or choose_dimension(silver, approx)
    gold = replace_table(promote_gold(silver, chosen, measure, aggregation), f"{name}_gold")
    return Layers(bronze, silver, gold, chosen)
