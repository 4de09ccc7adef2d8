"""The registry of image sources."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Source:
    name: str
    collection: str
    asset: str | None = None
    cube: bool = False
    available_years: tuple[int, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    mask_values: tuple[int, ...] = ()
    scale: float = 1.0
    offset: float = 0.0
    offset_boundary: str | None = None
    offset_before: float | None = None
    available_datetime: str | None = None
    stac_url: str = "https://planetarycomputer.microsoft.com/api/stac/v1"


#: Collections, band names, scaling and mask classes as their publishers document them.
SOURCES = {
    "io-lulc": Source("io-lulc", "io-lulc-annual-v02", "data", available_years=tuple(range(2017, 2024))),
    "esa-worldcover": Source("esa-worldcover", "esa-worldcover", "map", available_years=(2020, 2021)),
    "sentinel-2-l2a": Source(
        "sentinel-2-l2a",
        "sentinel-2-l2a",
        cube=True,
        roles={"red": "B04", "nir": "B08", "swir16": "B11", "mask": "SCL"},
        # Cloud shadow, medium and high cloud, thin cirrus, snow.
        mask_values=(3, 8, 9, 10, 11),
        # Digital numbers to reflectance; the offset holds from baseline 04.00 on.
        scale=1e-4,
        offset=-0.1,
        offset_boundary="2022-01-25",
        offset_before=0.0,
        available_datetime="2017-01-01/2024-12-31",
    ),
}


def source_config(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"source must be one of {', '.join(SOURCES)}")
    return SOURCES[name]


def categorical(name: str) -> Source:
    if (found := source_config(name)).cube:
        raise ValueError(f"{name} is a cube source; use stac_cube()")
    return found


def cube(name: str) -> Source:
    if not (found := source_config(name)).cube:
        raise ValueError(f"{name} is not a cube source; use stac_fetch()")
    return found
