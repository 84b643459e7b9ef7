"""Multi-valued attributes: a list of scalar columns (kept inside generated code) or one array column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import FunctionType

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def _column(c: Column | str | FunctionType) -> Column:
    return F.col(c) if isinstance(c, str) else c() if isinstance(c, FunctionType) else c


class Values:
    """The values of an attribute: columns, their names, or functions that make them (for definitions made before a session starts).

    With scalar columns, tests unfold to plain boolean expressions; arrays use higher-order functions. Of scalar columns, the
    values are those before the first null: an attribute whose first column is null is absent.
    """

    def __init__(self, *cols: Column | str | FunctionType, array: Column | str | FunctionType | None = None):
        self._cols, self._array = cols, array

    @property
    def cols(self) -> list[Column]:
        out: list[Column] = []
        here = None  # all columns so far have a value
        for c in map(_column, self._cols):
            out.append(c if here is None else F.when(here, c))
            here = c.isNotNull() if here is None else here & c.isNotNull()
        return out

    @property
    def array(self) -> Column | None:
        return None if self._array is None else _column(self._array)

    def any(self, test: Test) -> Column:
        found = reduce(lambda a, b: a | b, (F.coalesce(test(c), F.lit(False)) for c in self.cols)) if self.array is None else F.exists(self.array, lambda x: F.coalesce(test(x), F.lit(False)))
        return F.coalesce(found, F.lit(False))

    def all(self, test: Test) -> Column:
        found = reduce(lambda a, b: a & b, (c.isNull() | F.coalesce(test(c), F.lit(False)) for c in self.cols)) if self.array is None else F.forall(self.array, lambda x: F.coalesce(test(x), F.lit(False)))
        return F.coalesce(found, F.lit(False))

    def at(self, number: int | Column) -> Column:
        """The value of a 1-based number, null beyond the end."""
        if isinstance(number, int) and self.array is None:
            return self.cols[number - 1] if number <= len(self._cols) else F.lit(None)
        return F.try_element_at(self.as_array(), number if isinstance(number, Column) else F.lit(number))

    def size(self) -> Column:
        """How many values are there."""
        if self.array is not None:
            return F.coalesce(F.size(self.array), F.lit(0))
        out = F.lit(len(self._cols))
        for k, c in reversed(list(enumerate(self.cols))):
            out = F.when(c.isNull(), k).otherwise(out)
        return out

    def as_array(self) -> Column:
        return F.array(*self.cols) if self.array is None else self.array
