"""Settings and literals that live in files: secrets for plug-ins, and word lists in Python sources."""

from __future__ import annotations

import ast
import importlib
import os
from collections.abc import Mapping
from pathlib import Path
from types import ModuleType

from lexloom.functions.text import PLACEHOLDERS


def secret(name: str, file: str | Path | None = None, environ: Mapping[str, str] | None = None, shortest: int = 10) -> str:
    """The named secret from the environment, else from `NAME=value` lines of a file; raises on what cannot be a real one.

    A value is never shown in an error.
    """
    environ = os.environ if environ is None else environ
    lines = Path(file).read_text("utf-8").splitlines() if file and Path(file).exists() else []
    pairs = [x.partition("=") for x in lines if "=" in x and not x.lstrip().startswith("#")]
    value = environ.get(name, {k.strip(): v.strip() for k, _, v in reversed(pairs)}.get(name, "")).strip()
    if not value:
        raise ValueError(f"{name} is not set")
    if value.lower() in PLACEHOLDERS or value.lower().startswith("your") or len(value) < shortest:
        raise ValueError(f"{name} holds a placeholder")
    return value


def optional_module(name: str) -> ModuleType | None:
    """A module, or None where it is not installed."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def named_literal(source: str | Path, name: str):
    """The literal bound to a name at the top of a Python file, read without running the file."""
    bound = {}
    for statement in ast.parse(Path(source).read_text("utf-8")).body:
        for target in getattr(statement, "targets", None) or [getattr(statement, "target", None)]:
            if isinstance(target, ast.Name) and getattr(statement, "value", None) is not None:
                bound.setdefault(target.id, statement.value)
    if name not in bound:
        raise KeyError(f"{source} binds no {name}")
    return ast.literal_eval(bound[name])
