"""The record that travels with a product, and the hash that names what it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from cellbasis import __version__
from cellbasis.functions.grid import Grid
from cellbasis.functions.refusals import RecordRefusal


@dataclass(frozen=True)
class Input:
    """One tile that was read; catalogue figures are absent, not copied, where there is no catalogue."""

    item_id: str
    file_name: str
    sha256: str
    point_count_measured: int
    density_measured: float
    point_count_noise_excluded: int = 0
    point_count_catalogue: int | None = None
    flight_date: str | None = None

    def __post_init__(self) -> None:
        if self.file_name in ("", ".", "..") or any(c in self.file_name for c in "/\\"):
            raise RecordRefusal(f"not a bare file name: {self.file_name!r}")


def canonical(value: object) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def record(
    grid: Grid, parameters: Mapping[str, object], inputs: Sequence[Input], honesty: Mapping[str, float], agreement: Mapping[str, float] | None, attribution: str,
    flight_dates: Sequence[str] = (), mixed_epochs: bool = False, uncalibrated: Sequence[str] = (), limitations: Sequence[str] = (), created: str | None = None,
) -> dict:
    """The record as a dictionary. Its hash covers version, grid, parameters and the inputs' digests: not the time, the
    results or the attribution, so that a second run can be told from a different one."""
    if not attribution.strip():
        raise RecordRefusal("the attribution must name the data's source and licence")
    listed = sorted(inputs, key=lambda i: i.item_id)
    where = {"origin_x": grid.origin_x, "origin_y": grid.origin_y, "cell": grid.cell, "n_cols": grid.n_cols, "n_rows": grid.n_rows, "crs_epsg": grid.epsg}
    hashed = {"package_version": __version__, "grid": where, "parameters": dict(parameters), "inputs": [{"item_id": i.item_id, "sha256": i.sha256} for i in listed]}
    return {
        **hashed, "inputs": [asdict(i) for i in listed], "created_utc": created or datetime.now(UTC).isoformat(), "flight_dates": sorted(set(flight_dates)), "mixed_epochs": mixed_epochs,
        "honesty": dict(honesty), "agreement": None if agreement is None else dict(agreement), "attribution": attribution, "uncalibrated_thresholds": sorted(uncalibrated),
        "known_limitations": list(limitations), "reproducibility_hash": hashlib.sha256(canonical(hashed).encode("utf-8")).hexdigest(),
    }


def selection_document(selection, bounds: tuple[float, float, float, float]) -> str:
    """A selection as JSON: bounds, coverage, stamps by sortie, tiles with their boxes and densities."""
    tiles = [r.asDict() for r in selection.tiles.collect()]  # tiles of one area
    groups: dict[int, set[str]] = {}
    for t in tiles:
        groups.setdefault(t["sortie"], set()).add(t.get("flight_date") or str(t["stamp"]))
    listed = [
        {k: t[k] for k in ("item_id", "href", "file_size", "point_count", "flight_date") if k in t}
        | {"density": t["point_count"] / ((t["maxx"] - t["minx"]) * (t["maxy"] - t["miny"])), "bbox": [t["minx"], t["miny"], t["maxx"], t["maxy"]]}
        for t in tiles
    ]
    doc = {
        "aoi_bounds": list(bounds), "covered_fraction": selection.covered_fraction, "flight_dates": sorted(set().union(*groups.values())) if groups else [], "sorties": [sorted(groups[k]) for k in sorted(groups)],
        "mixed_epochs": selection.mixed_epochs, "dropped_duplicates": selection.dropped, "tiles": listed,
    }
    return json.dumps(doc, indent=2, ensure_ascii=False)


def append_lines(rows, path: str) -> None:
    """Add the rows of a frame to a folder of JSON lines."""
    rows.write.mode("append").json(path)
