"""Named queries over the derived tables, one module per family, with the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """The register with every query module of this package imported."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
