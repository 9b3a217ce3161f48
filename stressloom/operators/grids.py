"""Parameter grids. A grid is a literal array in the plan and is exploded next to each row, so no join is
planned; what follows is one partial aggregation keyed by the grid fields."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stressloom import schema as S


def _type(v) -> str:
    if isinstance(v, (list, tuple)):
        return f"array<{_type(v[0])}>"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int"
    return "string" if isinstance(v, str) else "double"


def literal(rows: list[dict]) -> Column:
    """The grid as one constant: a JSON literal, which keeps the plan small whatever the number of points."""
    fields = ", ".join(f"`{k}`: {_type(v)}" for k, v in rows[0].items())
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def explode_grid(df: DataFrame, grid: list[dict]) -> DataFrame:
    """One copy of each row per grid point, grid fields as columns."""
    return df.select(*df.columns, F.inline(literal(grid)))


def grid_index(weights: str = "w", channels=None) -> Column:
    """Composite under the weight array of the grid point."""
    cols = channels or S.CHANNELS
    return reduce(lambda a, b: a + b, [F.col(weights)[i] * F.col(c) for i, c in enumerate(cols)])


def renormalise(w: list[float]) -> list[float]:
    w = [max(x, 0.0) for x in w]
    total = sum(w)
    return [x / total for x in w] if total > 0 else [1.0 / len(w)] * len(w)


def ablated_weights(base: dict, drop: str) -> list[float]:
    return renormalise([0.0 if k == drop else v for k, v in base.items()])


def shifted_weights(base: dict, name: str, delta: float) -> list[float]:
    return renormalise([v + delta if k == name else v for k, v in base.items()])
