"""Named providers that turn hub features into names; users register their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PROVIDERS: dict[str, Callable[..., Column]] = {}


def register(name: str, provider: Callable[..., Column]) -> None:
    """A provider takes feature columns and returns a column of names (an expression or a pandas UDF)."""
    _PROVIDERS[name] = provider


def names_by(name: str, *features: str) -> Column:
    if name not in _PROVIDERS:
        raise KeyError(f"no provider is named {name}; there are {sorted(_PROVIDERS)}")
    return _PROVIDERS[name](*map(F.col, features))


def from_pandas(function: Callable[..., pd.Series]) -> Callable[..., Column]:
    """A provider from a function of pandas series."""
    return F.pandas_udf(function, "string")


register("tiered", lambda hub, tier: F.concat_ws(" ", F.when(tier == 1, "Capital").when(tier == 2, "Town").otherwise("Village"), hub.cast("string")))
