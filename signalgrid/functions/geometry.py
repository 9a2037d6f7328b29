"""Bounding boxes, grid cells and great circles as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from signalgrid.dims import Box


def inside(lon: Column, lat: Column, west, south, east, north) -> Column:
    """Inclusive point-in-box test; a NaN coordinate is never inside."""
    return lon.between(west, east) & lat.between(south, north)


def first_box(boxes: Sequence[Box], lon: str = "lon", lat: str = "lat") -> Column:
    """Code of the best-priority box that holds the point, or NULL.

    One CASE expression inside the scan's stage: no join and no shuffle.
    """
    tests = " ".join(
        f"WHEN {_holds(b, lon, lat)} THEN '{_quoted(b.code)}'"
        for b in sorted(boxes, key=lambda b: b.priority)
    )
    return F.expr(f"CASE {tests} END")


def boxes_holding(boxes: Sequence[Box], lon: str = "lon", lat: str = "lat") -> Column:
    """Array with the codes of all boxes that hold the point."""
    tests = ", ".join(
        f"CASE WHEN {_holds(b, lon, lat)} THEN '{_quoted(b.code)}' END" for b in boxes
    )
    return F.expr(f"array_compact(array({tests}))")


def _holds(box: Box, lon: str, lat: str) -> str:
    return (f"{lon} BETWEEN {float(box.west)!r}D AND {float(box.east)!r}D"
            f" AND {lat} BETWEEN {float(box.south)!r}D AND {float(box.north)!r}D")


def _quoted(code: str) -> str:
    return code.replace("\\", "\\\\").replace("'", "\\'")


def cell(coordinate: Column, size) -> Column:
    """Index of the grid cell along one axis."""
    return F.floor(coordinate / size)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
