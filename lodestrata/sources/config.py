"""Configuration: one dataclass, filled from a mapping or a JSON or YAML-like file, with the older names of its fields [S28]."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

# Names under which the output folder may come, first wins.
OUTPUT_NAMES = ("output_root", "output_dir", "output_path")


@dataclass(frozen=True)
class Config:
    project_root: str = "."
    output_root: str = "output"
    max_chars_per_batch: int = 8000
    chunk_chars: int = 3000

    @classmethod
    def from_mapping(cls, data: dict) -> Config:
        """Unknown fields are ignored; numbers may be texts."""
        out = next((str(data[n]) for n in OUTPUT_NAMES if data.get(n)), cls.output_root)
        return cls(str(data.get("project_root") or cls.project_root), out, int(data.get("max_chars_per_batch") or cls.max_chars_per_batch), int(data.get("chunk_chars") or cls.chunk_chars))


@lru_cache
def load_config(path: str) -> Config:
    """A JSON file, or lines ``name: value``; read once per path."""
    text = Path(path).read_text(encoding="utf-8")
    if text.lstrip().startswith("{"):
        return Config.from_mapping(json.loads(text))
    pairs = (line.split("#", 1)[0].partition(":") for line in text.splitlines())
    return Config.from_mapping({k.strip(): v.strip().strip("\"'") for k, _, v in pairs if v.strip()})
