"""One query per operator on the given tables, each with independent SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from proofs.registry import PROOFS

for _module in ("reporting", "tables", "customers", "segments", "texts", "learning"):
    import_module(f"proofs.{_module}")

__all__ = ["PROOFS"]
