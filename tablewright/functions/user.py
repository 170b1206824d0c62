"""User-defined functions with declared arguments and return types, of kind scalar or aggregate.

A scalar one is an SQL function of the session. An aggregate one is a composition of Spark's own aggregates, so it combines
partial results before a shuffle and never holds a group; it is called with columns, in ``agg`` or over a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UserFunction:
    """``body`` is an SQL expression over the argument names (scalar), or makes a column of aggregates out of columns."""

    name: str
    arguments: Sequence[tuple[str, str]]
    returns: str
    body: str | Callable[..., Column]
    description: str = ""
    tags: Sequence[str] = field(default_factory=tuple)

    @property
    def kind(self) -> str:
        return "scalar" if isinstance(self.body, str) else "aggregate"

    def create(self, spark: SparkSession) -> None:
        """Makes a scalar function known to SQL; an aggregate one is known by its object."""
        if self.kind == "scalar":
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({', '.join(f'{n} {t}' for n, t in self.arguments)}) RETURNS {self.returns} RETURN {self.body}")

    def __call__(self, *values: Column | str) -> Column:
        """The function of ``values``, which are cast to the declared types, as is the result."""
        if len(values) != len(self.arguments):
            raise TypeError(f"{self.name} takes {len(self.arguments)} arguments, not {len(values)}")
        typed = [(F.col(v) if isinstance(v, str) else v).cast(t) for v, (_, t) in zip(values, self.arguments)]
        made = F.call_function(self.name, *typed) if isinstance(self.body, str) else self.body(*typed)
        return made.cast(self.returns)


def function_inventory(spark: SparkSession, functions: Sequence[UserFunction]) -> DataFrame:
    """(name, kind, arguments, returns, tags) of declared functions."""
    rows = [(f.name, f.kind, ", ".join(f"{n} {t}" for n, t in f.arguments), f.returns, sorted(f.tags)) for f in functions]
    return spark.createDataFrame(rows, "name string, kind string, arguments string, returns string, tags array<string>")


#: Mean of ratios: of positive numbers, others are left out.
GEOMETRIC_MEAN = UserFunction("geometric_mean", [("x", "double")], "double", lambda x: F.exp(F.avg(F.when(x > 0, F.ln(x)))))
#: Mean by weight; null without weight.
WEIGHTED_MEAN = UserFunction("weighted_mean", [("x", "double"), ("weight", "double")], "double", lambda x, w: F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))))
