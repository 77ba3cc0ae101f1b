"""Settings of a run: a YAML file with dotted names, and the commit it runs at."""

from __future__ import annotations

import json
import os
import subprocess
from typing import Any


class Settings:
    def __init__(self, path: str):
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            self.values = yaml.safe_load(text)
        except ModuleNotFoundError:  # JSON is YAML too
            self.values = json.loads(text)
        if self.values is None:
            raise ValueError(f"{path} is empty")

    def get(self, name: str, default: Any = None) -> Any:
        """The value at a dotted name, the default where any part of it is missing."""
        at = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at


def commit(path: str = ".") -> str:
    """The short name of the commit that a folder stands at, or `unknown`."""
    try:
        out = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, cwd=path, timeout=5, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return "unknown"
    return out.stdout.strip() or "unknown"
