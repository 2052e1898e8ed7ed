"""Operators for preparing training text at corpus scale.

``load_all()`` imports the modules that register queries; nothing outside this package imports it.
"""

import importlib

from tickloom.llm.registry import ORACLES, QUERIES  # noqa: F401

MODULES = ("mixing", "sharding", "merkle", "fertility", "langid", "tokenbin", "chat", "htmltext", "setjoin", "segment", "veccodes", "neardup", "periodic")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
