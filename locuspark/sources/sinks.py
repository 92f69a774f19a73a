"""Result files."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

_RESERVED = re.compile(r'[<>:"/\\|?*\x00-\x1f]')


def safe_name(value: object) -> str:
    """A file name's part: reserved and control characters become underscores."""
    return _RESERVED.sub("_", str(value)).strip(" .") or "unnamed"


@dataclass(frozen=True)
class OutputFiles:
    gwas: str | None = None
    prediction: str | None = None
    kinship: str | None = None
    pca: str | None = None
    manhattan: str | None = None
    qq: str | None = None

    def paths(self) -> list[str]:
        return [getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None]


def write_csv(frame: DataFrame, path: str) -> str:
    """A folder of CSV parts with headers, in the frame's order."""
    frame.write.mode("overwrite").option("header", True).csv(path)
    return path


def result_path(folder: str, model: str | None, trait: str, what: str) -> str:
    parts = ["GWAS", *([safe_name(model)] if model else []), safe_name(trait), what, "csv"]
    return f"{folder.rstrip('/')}/{'.'.join(parts)}"
