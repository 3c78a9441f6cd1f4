"""Registered queries by family."""

from importlib import import_module

FAMILIES = [
    "sources", "grid", "chunking", "relational", "resolve", "access", "questions", "retrieval",
    "conversations", "evaluation", "events",
]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"gridlake.plans.{family}")
