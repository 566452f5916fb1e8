"""Formulas for the work of an op, registered by op type and compiled to one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrain.functions import scalars


class Formulas:
    """Op types to formulas over named columns. A type without a formula is refused: a wrong figure is worse than none."""

    def __init__(self):
        self.known: dict[str, Callable[..., Column]] = {}

    def register(self, *types: str) -> Callable:
        def add(formula: Callable[..., Column]) -> Callable[..., Column]:
            for name in types:
                if name in self.known:
                    raise ValueError(f"{name} has a formula already")
                self.known[name] = formula
            return formula

        return add

    def column(self, kind: Column, unknown: str = "refuse", **columns: Column) -> Column:
        """The formula of each row's type. unknown: refuse (the query fails with the type's name) or null."""
        out = F.raise_error(F.concat(F.lit("no formula for "), F.coalesce(kind, F.lit("null")))).cast("double") if unknown == "refuse" else F.lit(None).cast("double")
        for name, formula in self.known.items():
            out = F.when(kind == name, formula(**columns).cast("double")).otherwise(out)
        return out


def standard() -> Formulas:
    """Matrix products, plain and in batches, over m, n, k and batch."""
    own = Formulas()
    own.register("MatMul", "MatMulV2")(lambda m, n, k, batch: scalars.gemm_flops(m, n, k))
    own.register("BatchMatMul", "BatchMatMulV2")(lambda m, n, k, batch: scalars.gemm_flops(m, n, k, batch))
    return own
