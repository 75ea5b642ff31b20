"""Typed configuration from YAML, with write-back, backups and revert. Files are small and read on the driver.

Defined cases: a missing file, section or key gives the default; keys that no section knows are an error, not silently
accepted. Write-back sets only keys that the file has already and returns those that it skipped. Revert takes the
backup whose name sorts last, and does nothing without one.
"""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field, fields
from datetime import datetime


@dataclass(frozen=True)
class RuleSection:
    min_length: int = 10
    max_length: int = 10000
    max_non_script: float = 0.55
    max_repeat: float = 0.40
    max_urls: int = 20
    min_effective: float = 0.50


@dataclass(frozen=True)
class NgramSection:
    n: int = 3
    ppl_threshold: float = 30.0


@dataclass(frozen=True)
class DedupSection:
    shingle: int = 3
    permutations: int = 128
    jaccard_threshold: float = 0.60


@dataclass(frozen=True)
class SynthesisSection:
    max_seeds: int = 80
    seed_max_ppl: float = 15.0
    per_seed: int = 5
    max_evolve: int = 150
    jaccard_threshold: float = 0.70
    consistency_threshold: float = 0.95


@dataclass(frozen=True)
class CurriculumSection:
    bands: int = 3
    max_ppl: float = 5.0
    invalid: str = "drop"
    beta_start: float = 1.0
    beta_end: float = 0.1
    beta_steps: int = 5
    temperature: float = 0.5


@dataclass(frozen=True)
class FeedbackSection:
    trigger: float = 0.05
    max_change: float = 0.30
    min_change: float = 0.02


@dataclass(frozen=True)
class Config:
    rules: RuleSection = field(default_factory=RuleSection)
    ngram_ppl: NgramSection = field(default_factory=NgramSection)
    dedup: DedupSection = field(default_factory=DedupSection)
    synthesis: SynthesisSection = field(default_factory=SynthesisSection)
    curriculum: CurriculumSection = field(default_factory=CurriculumSection)
    feedback: FeedbackSection = field(default_factory=FeedbackSection)


def _yaml():
    import yaml

    return yaml


def load(path: str) -> Config:
    raw = (_yaml().safe_load(open(path, encoding="utf-8")) or {}) if os.path.exists(path) else {}
    sections = {}
    for f in fields(Config):
        kind = f.default_factory
        given = raw.pop(f.name, None) or {}
        if unknown := given.keys() - {x.name for x in fields(kind)}:
            raise ValueError(f"{f.name} has no keys {sorted(unknown)}")
        sections[f.name] = kind(**given)
    if raw:
        raise ValueError(f"no sections {sorted(raw)}")
    return Config(**sections)


def backup(path: str, now: datetime | None = None) -> str:
    to = f"{path}.bak.{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    shutil.copyfile(path, to)
    return to


def write_back(path: str, values: dict[str, object], now: datetime | None = None) -> list[str]:
    """Sets ``section.key`` (or ``key``) values in the file after a backup; returns the names that the file does not have."""
    raw = _yaml().safe_load(open(path, encoding="utf-8")) or {}
    skipped = []
    for name, value in values.items():
        *at, key = name.split(".")
        place = raw
        for x in at:
            place = place.get(x) if isinstance(place, dict) else None
        if isinstance(place, dict) and key in place:
            place[key] = value
        else:
            skipped.append(name)
    backup(path, now)
    with open(path, "w", encoding="utf-8") as f:
        _yaml().safe_dump(raw, f, allow_unicode=True, sort_keys=False)
    return skipped


def revert(path: str) -> str | None:
    """Puts the last backup's contents back and returns its name."""
    folder, name = os.path.split(os.path.abspath(path))
    found = sorted(x for x in os.listdir(folder) if x.startswith(f"{name}.bak."))
    if not found:
        return None
    shutil.copyfile(os.path.join(folder, found[-1]), path)
    return found[-1]
