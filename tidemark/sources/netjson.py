"""A network as JSON: positions, series and models, without observations."""

from __future__ import annotations

import json

from tidemark.solve.models import ModelSpec, from_arch, to_arch


def dump(name: str, locations: dict[str, list[float]], default_models: dict[str, list[ModelSpec]], station_models: dict[str, dict[str, list[ModelSpec]]] | None = None, series: dict[str, dict[str, dict]] | None = None) -> str:
    """default_models by series description; station_models and series by station and series description. Models that
    every station shares need only stand among the defaults."""
    stations = {
        s: {"location": list(map(float, at)), "timeseries": (series or {}).get(s, {}), "models": {ts: to_arch(m) for ts, m in (station_models or {}).get(s, {}).items()}}
        for s, at in locations.items()
    }
    return json.dumps({"name": name, "locations": {s: v["location"] for s, v in stations.items()}, "default_local_models": {ts: to_arch(m) for ts, m in default_models.items()}, "stations": stations})


def load(text: str) -> dict:
    """The parts of dump(); a station's models are the defaults of its series, replaced by its own of the same name.
    Models for series a station does not have stand under 'unused'."""
    raw = json.loads(text)
    defaults = {ts: from_arch(a) for ts, a in raw.get("default_local_models", {}).items()}
    out = {"name": raw["name"], "default_models": defaults, "stations": {}}
    for s, v in raw.get("stations", {}).items():
        at = v.get("location") or raw.get("locations", {}).get(s)
        if at is None or len(at) != 3:
            raise ValueError(f"no position for {s}")
        models, unused = {}, {}
        for ts in {*defaults, *v.get("models", {})}:
            own = {m.name: m for m in [*defaults.get(ts, []), *from_arch(v.get("models", {}).get(ts, {}))]}
            (models if ts in v.get("timeseries", {}) else unused)[ts] = list(own.values())
        out["stations"][s] = {"location": at, "timeseries": v.get("timeseries", {}), "models": models, "unused": unused}
    return out
