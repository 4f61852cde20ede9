"""Pattern files: YAML lists of named regular expressions with a type and a severity."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions.dialect import Unsupported, to_java

log = logging.getLogger(__name__)

TYPES = ("pii", "credential", "financial", "business_intelligence")
SEVERITIES = ("BLOCK", "WARN", "LOG")
DEFAULT_FILE = Path(__file__).with_name("default_patterns.yaml")


class PatternError(ValueError):
    """A pattern file that can't be used."""


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    type: str
    severity: str
    description: str = ""

    @property
    def java(self) -> str:
        return to_java(self.regex)


def check(entry: dict) -> Pattern:
    """A pattern of four fields that aren't empty, with a known type and severity; the description is optional."""
    for field in ("name", "regex", "type", "severity"):
        if not str(entry.get(field) or "").strip():
            raise PatternError(f"pattern {entry.get('name')!r} has no {field}")
    if entry["type"] not in TYPES:
        raise PatternError(f"pattern {entry['name']!r}: unknown type {entry['type']!r}")
    if entry["severity"] not in SEVERITIES:
        raise PatternError(f"pattern {entry['name']!r}: unknown severity {entry['severity']!r}")
    return Pattern(*(str(entry[f]) for f in ("name", "regex", "type", "severity")), str(entry.get("description") or ""))


def read_file(path: str | Path) -> list[Pattern]:
    with open(path, encoding="utf-8") as f:
        content = yaml.safe_load(f) or {}
    if not isinstance(content, dict):
        raise PatternError(f"{path}: no list of patterns")
    return [check(p) for p in content.get("patterns") or []]


def read_directory(path: str | Path) -> list[Pattern]:
    """Patterns of all YAML files below a directory, in lexical order, or of one file. A file that fails is left out with a warning."""
    path = Path(path)
    if not path.exists():
        raise PatternError(f"{path} is missing")
    if path.is_file():
        return read_file(path)
    found = []
    for top, dirs, names in os.walk(path):
        dirs.sort()
        for name in sorted(names):
            if name.lower().endswith((".yaml", ".yml")):
                try:
                    found += read_file(os.path.join(top, name))
                except (PatternError, yaml.YAMLError, OSError) as e:
                    log.warning("%s is left out: %s", name, e)
    return found


def compiled(patterns: list[Pattern]) -> list[Pattern]:
    """The first pattern of each name, without those that don't compile."""
    kept: dict[str, Pattern] = {}
    for p in patterns:
        if p.name in kept:
            continue
        try:
            to_java(p.regex)
            re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", re.sub(r"\\z", r"\\Z", re.sub(r"\\x\{[0-9A-Fa-f]+\}", "x", p.regex))))
        except (Unsupported, re.error) as e:
            log.warning("pattern %s is left out: %s", p.name, e)
            continue
        kept[p.name] = p
    return list(kept.values())


def load(default: str | Path = DEFAULT_FILE, custom: str | Path | None = None) -> list[Pattern]:
    """The default patterns, then custom ones; a custom pattern can't replace a default of its name."""
    found = compiled(read_directory(default) + (read_directory(custom) if custom else []))
    if not found:
        raise PatternError("no patterns")
    return found


def patterns_frame(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = [(i, p.name, p.regex, p.type, p.severity, p.description) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "load_order int, name string, regex string, type string, severity string, description string")
