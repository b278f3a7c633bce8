"""Settings of an engine, from defaults or a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from quarry.errors import ParseError


@dataclass(frozen=True)
class Config:
    """Names and defaults are fixed values that settings files carry.

    lcs_l2_max_bytes and min_group_rows are read and not used: segments have no second level, and a group of any size is answered exactly.
    """

    accuracy_target: float = 0.9
    k: float = 2.0
    aqp_mode: str = "balanced"
    seed: int = 42
    bloom_fpr: float = 0.01
    memtable_row_limit: int = 10_000
    memtable_size_limit: int = 1 << 20
    min_group_rows: int = 50
    low_confidence_threshold: int = 100
    verify_crc: bool = True
    compaction_strategy: str = "stcs"
    compaction_interval_secs: int = 30
    min_compaction_files: int = 4
    lcs_l1_max_bytes: int = 10 << 20
    lcs_l2_max_bytes: int = 100 << 20
    row_group_size: int = 1024
    max_segment_rows: int = 1_000_000
    primary_key: str = ""

    @classmethod
    def load(cls, path: str | Path) -> Config:
        found = tomllib.loads(Path(path).read_text())
        known = {f.name for f in fields(cls)}
        if unknown := set(found) - known - {"schema", "columns"}:
            raise ParseError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **{k: v for k, v in found.items() if k in known})
