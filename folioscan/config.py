"""Settings: validated field by field, unknown keys kept, written atomically, a corrupt file set aside."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

DEFAULT_EXCLUDED = [".git", "node_modules", "temp", "__pycache__"]


@dataclass
class Settings:
    directories: list[str] = field(default_factory=list)
    include_subdirectories: bool = True
    exclude_patterns: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDED))
    search_filters: dict = field(default_factory=dict)
    ocr_enabled: bool = False
    db_path: str | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Settings:
        file = Path(path)
        if not file.exists():
            return cls()
        try:
            data = json.loads(file.read_text("utf-8"))
            if not isinstance(data, dict):
                raise ValueError("not an object")
        except ValueError:
            os.replace(file, file.with_suffix(file.suffix + ".corrupt"))
            return cls()
        out, names = cls(), {f.name for f in fields(cls)} - {"extra"}
        for key, value in data.items():
            if key not in names:
                out.extra[key] = value
            elif isinstance(value, type(getattr(out, key))) or key == "db_path" and (value is None or isinstance(value, str)):
                if not isinstance(value, list) or all(isinstance(x, str) for x in value):
                    setattr(out, key, value)
        return out

    def save(self, path: str) -> None:
        data = self.extra | {f.name: getattr(self, f.name) for f in fields(self) if f.name != "extra"}
        part = Path(path).with_suffix(".part")
        part.write_text(json.dumps(data, ensure_ascii=False, indent=1), "utf-8")
        os.replace(part, path)
