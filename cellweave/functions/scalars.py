"""Column functions: delay laws, signs, guarded arithmetic, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Names in the languages of the tools, and characters outside them.
IDENTIFIER, NO_IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*", "[^A-Za-z0-9_]"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def law_mean(rates: str | Column) -> Column:
    """Mean of a law given by its phases' rates."""
    return F.aggregate(_col(rates), F.lit(0.0), lambda s, r: s + 1 / r)


def law_rate(rates: str | Column) -> Column:
    """Reciprocal of the mean; 0 without phases."""
    return F.when(F.size(_col(rates)) > 0, 1 / law_mean(rates)).otherwise(0.0)


def phase_count(rates: str | Column) -> Column:
    return F.size(_col(rates))


def is_exponential(kind: str | Column) -> Column:
    return _col(kind) == "exp"


def erlang_rates(k: str | Column, rate: str | Column) -> Column:
    return F.array_repeat(_col(rate), _col(k))


def sign_product(a: str | Column, b: str | Column) -> Column:
    """Of signs 1, -1 and 0 for both; 0 stays 0."""
    return _col(a) * _col(b)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(_col(b) == 0, 0.0).otherwise(_col(a) / F.when(_col(b) == 0, 1.0).otherwise(_col(b)))


def clamp(x: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(x)))


def identifier(name: str | Column) -> Column:
    """The name where it is an identifier, else '_' and the name with other characters replaced."""
    return F.when(_col(name).rlike(f"^{IDENTIFIER}$"), _col(name)).otherwise(F.concat(F.lit("_"), F.regexp_replace(_col(name), NO_IDENTIFIER, "_")))


def local_state(automaton: str | Column, level: str | Column) -> Column:
    return F.concat_ws("=", _col(automaton), _col(level).cast("string"))
