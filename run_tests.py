"""Runs every test file under the given roots (``tests`` without any) in a process of its own, and ends with 1 where one fails or shows no test."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

SIGNAL = re.compile(r"\b(\d+) passed\b")


def found(roots: list[str]) -> list[Path]:
    files = sorted({f for r in roots for f in ([Path(r)] if r.endswith(".py") else Path(r).rglob("test_*.py"))})
    if not files:
        raise SystemExit(f"no test files under {', '.join(roots)}")
    return files


def ran(path: Path) -> tuple[bool, str]:
    """Whether a file's tests passed, and what to say of it: without a visible number of passed tests it has failed."""
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", str(path)], capture_output=True, text=True, check=False)
    seen = SIGNAL.search(done.stdout)
    if done.returncode:
        return False, f"exit code {done.returncode}\n{done.stdout[-2000:]}"
    return (True, f"{seen[1]} passed") if seen and int(seen[1]) else (False, "no test ran")


def main(roots: list[str]) -> int:
    bad = 0
    for path in found(roots or ["tests"]):
        good, text = ran(path)
        bad += not good
        print(f"{'ok' if good else 'FAILED'} {path}: {text}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
