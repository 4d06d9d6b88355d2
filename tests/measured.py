"""Measured data to check against, from the folder that an environment variable names."""

import os
import re
from pathlib import Path

# Folder with measured data to check against; tests that need it are skipped without it.
DATA = os.environ.get("LUMISWEEP_DATA")


def _csv_files():
    for path in sorted(Path(DATA).glob("**/*.csv")) if DATA else []:
        lines = path.read_text(encoding="utf-8", errors="replace").splitlines()
        if lines:
            yield path, lines


def optical_tables() -> dict[str, str]:
    """Material -> path; the three tables are told apart by their number of rows."""
    rows = {121: "si", 201: "sio2", 710: "si3n4"}
    return {rows[len(lines) - 1]: re.sub(r"[\[\]{}]", "?", str(path))
            for path, lines in _csv_files()
            if "nm" in lines[0] and "," in lines[0] and len(lines) - 1 in rows}


def result_files() -> dict[str, list[Path]]:
    """Per-repeat results and rolled-up results, by their header line."""
    found: dict[str, list[Path]] = {"repeats": [], "rollups": []}
    for path, lines in _csv_files():
        names = lines[0].lstrip("\ufeff").split(";")
        if "Cutoff_MHz" in names:
            found["repeats" if "Mess" in names else "rollups"].append(path)
    return found
