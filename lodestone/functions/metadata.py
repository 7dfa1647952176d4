"""Predicates on metadata held as JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_KEY = re.compile(r"^[A-Za-z0-9_]{1,64}$")
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def _year(value) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError(f"not a number: {value!r}")
    return float(value)


def metadata_filter(asked: dict | None, metadata: str = "metadata", author: str = "author") -> Column | None:
    """All of asked must hold, null never matches. `author` compares without case, `year_from` and `year_to` bound the
    year where it is a number, any other key compares its text. Bad keys and values are errors."""
    out = None
    year = F.get_json_object(F.col(metadata), "$.year")
    year = F.when(F.rlike(year, F.lit(_NUMBER)), F.expr(f"try_cast(get_json_object({metadata}, '$.year') as double)"))
    for key in sorted(asked or {}):
        value = asked[key]
        if not _KEY.match(key):
            raise ValueError(f"bad metadata key: {key!r}")
        if key in ("year_from", "year_to"):
            bound = _year(value)
            one = year >= bound if key == "year_from" else year <= bound
        elif not isinstance(value, str):
            raise ValueError(f"the value of {key} must be a string")
        elif key == "author":
            one = F.lower(F.col(author)) == value.lower()
        else:
            one = F.get_json_object(F.col(metadata), f"$.{key}") == value
        one = F.coalesce(one, F.lit(False))
        out = one if out is None else out & one
    return out
