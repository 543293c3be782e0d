"""What must be installed, by name, before a run begins."""

from __future__ import annotations

import importlib.util
import sys

REQUIRED = {"pyspark": "pyspark", "pyarrow": "pyarrow", "pandas": "pandas", "numpy": "numpy"}


def missing(required: dict[str, str] | None = None) -> list[str]:
    """Names of packages (by module) that can't be found."""
    return sorted(name for module, name in (required or REQUIRED).items() if importlib.util.find_spec(module) is None)


def check(required: dict[str, str] | None = None) -> None:
    """Ends with code 2 and says what is missing."""
    if gone := missing(required):
        print(f"missing packages: {', '.join(gone)}", file=sys.stderr)
        raise SystemExit(2)
