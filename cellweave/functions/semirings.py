"""Path algebras: how values add up along a path and over paths, in Python and as columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """zero and plus gather paths; one and times go along a path."""

    zero: object
    one: object
    plus: Callable
    times: Callable
    gather: Callable[[Column], Column]
    along: Callable[[Column, Column], Column]


SEMIRINGS = {
    "tropical": Semiring(math.inf, 0.0, min, lambda a, b: a + b, F.min, lambda a, b: a + b),
    "viterbi": Semiring(0.0, 1.0, max, lambda a, b: a * b, F.max, lambda a, b: a * b),
    "sum": Semiring(0.0, 1.0, lambda a, b: a + b, lambda a, b: a * b, F.sum, lambda a, b: a * b),
    "bool": Semiring(False, True, lambda a, b: a or b, lambda a, b: a and b, F.bool_or, lambda a, b: (a > 0) & (b > 0)),
}
