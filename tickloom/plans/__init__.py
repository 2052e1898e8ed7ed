"""Query catalogue. Importing the package registers every query."""

import importlib
import pkgutil

from tickloom.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401

_SKIP = {"registry", "views_sql"}


def load_all() -> None:
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m not in _SKIP:
            importlib.import_module(f"{__name__}.{m}")
