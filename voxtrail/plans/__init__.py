"""Importing the plan modules fills the registry."""

import importlib

from voxtrail.plans.registry import CHECKS, QUERIES

for _name in ("groups", "contracts", "files", "pattern_plans", "decoding", "series", "spatial_plans"):
    importlib.import_module(f"voxtrail.plans.{_name}")

__all__ = ["CHECKS", "QUERIES"]
