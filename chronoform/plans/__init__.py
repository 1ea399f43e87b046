"""Registered queries over the driver tables, each beside its SQL."""

import importlib
import pkgutil
from types import ModuleType


def load() -> ModuleType:
    """The registry, after every module of queries here has filled it."""
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
    return importlib.import_module(f"{__name__}.registry")
