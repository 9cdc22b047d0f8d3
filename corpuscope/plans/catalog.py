"""All query modules; ``load`` registers every one of them."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "ingestion", "planning", "lists", "evaluation", "metering", "agentic", "stateful")


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"corpuscope.plans.{module}")
