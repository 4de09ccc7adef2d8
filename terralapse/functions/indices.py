"""Spectral indices as expressions over band roles."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralapse.sources.config import cube

#: Published definitions of the indices.
INDICES = [
    ("ndvi", "(nir - red) / (nir + red)", "nir,red", "Normalized Difference Vegetation Index"),
    ("kndvi", "tanh(pow((nir - red) / (nir + red), 2))", "nir,red", "Kernel NDVI (tanh of NDVI squared)"),
    ("ndmi", "(nir - swir16) / (nir + swir16)", "nir,swir16", "Normalized Difference Moisture Index"),
]


def index_table(spark) -> DataFrame:
    return spark.createDataFrame(INDICES, "index string, formula string, roles string, description string")


def _row(index: str) -> tuple[str, str, str, str]:
    for row in INDICES:
        if row[0] == index:
            return row
    raise ValueError(f"Unknown index {index!r}; choose one of {', '.join(r[0] for r in INDICES)}")


def index_roles(index: str) -> list[str]:
    return [r.strip() for r in _row(index)[2].split(",")]


def plain_number(x: float) -> str:
    """Without an exponent."""
    return format(Decimal(repr(float(x))).normalize(), "f")


def scaled(asset: str, scale: float = 1.0, offset: float = 0.0) -> str:
    """How a band stands in a formula: bare, or with its scale and offset."""
    if scale == 1 and offset == 0:
        return asset
    sign = "-" if offset < 0 else "+"
    return f"({asset} * {plain_number(scale)} {sign} {plain_number(abs(offset))})"


def resolve(index: str, roles: dict[str, str], scale: float = 1.0, offset: float = 0.0) -> str:
    """The formula with bands in place of roles; the longest role names go first."""
    out, wanted = _row(index)[1], index_roles(index)
    if absent := [r for r in wanted if r not in roles]:
        raise ValueError(f"index {index!r} needs roles that the map lacks: {', '.join(absent)}")
    for role in sorted(wanted, key=len, reverse=True):
        out = re.sub(rf"\b{re.escape(role)}\b", scaled(roles[role], scale, offset), out)
    return out


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0, and for NaN."""
    q = F.try_divide(top.cast("double"), bottom.cast("double"))
    return F.when(F.isnan(q), None).otherwise(q)


def index_column(index: str, roles: dict[str, str], scale: float | Column = 1.0, offset: float | Column = 0.0) -> Column:
    """The index as a column; scale and offset may differ from row to row."""
    if absent := [r for r in index_roles(index) if r not in roles]:
        raise ValueError(f"index {index!r} needs roles that the map lacks: {', '.join(absent)}")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    band = {r: F.col(roles[r]) * as_column(scale) + as_column(offset) for r in index_roles(index)}
    if index == "ndmi":
        return ratio(band["nir"] - band["swir16"], band["nir"] + band["swir16"])
    ndvi = ratio(band["nir"] - band["red"], band["nir"] + band["red"])
    return F.tanh(F.pow(ndvi, 2.0)) if index == "kndvi" else ndvi


def index_expr(index: str, source: str = "sentinel-2-l2a", roles: dict[str, str] | None = None, scale: float | None = None, offset: float | None = None) -> str:
    config = cube(source)
    return resolve(index, roles or config.roles, config.scale if scale is None else scale, config.offset if offset is None else offset)
