"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for info in pkgutil.iter_modules(__path__):
        if info.name != "registry":
            importlib.import_module(f"{__name__}.{info.name}")
