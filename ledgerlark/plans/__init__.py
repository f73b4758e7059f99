"""Registered queries by family."""

import importlib

FAMILIES = ("usage", "billing", "dashboard", "funnel", "outreach", "identity", "deals", "onboarding", "directory", "quality", "streams")


def load():
    """Import every family and return the registry."""
    for family in FAMILIES:
        importlib.import_module(f"ledgerlark.plans.{family}")
    return importlib.import_module("ledgerlark.plans.registry")
