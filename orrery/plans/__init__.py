"""All queries of the core: name -> callable, name -> SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["data_quality", "projections", "relations", "kernels", "fits", "composites", "statements", "checks", "assets"]
FLAGSHIP = "a11_axis_box"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"orrery.plans.{m}").QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"orrery.plans.{m}").ORACLES.items()}
