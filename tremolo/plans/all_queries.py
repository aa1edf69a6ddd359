"""Every query of the reference operators: importing this fills the registry."""

import importlib

from tremolo.plans.registry import ORACLES, QUERIES

for _name in ("signals", "spectra", "models", "learning"):
    importlib.import_module(f"tremolo.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
