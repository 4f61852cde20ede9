"""Settings of a deployment from a YAML file: defaults for what is missing, checks, and overrides from the environment.

A file has the sections below ``proxy`` (behavior, slm, model_routing and one for each provider) and ``patterns``. What concerns
serving HTTP is read over. The settings are a driver's few values; the operators get them as plain arguments.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import contextual, requests, rewrite, routing
from palimpsest.operators.providers import PROVIDERS

from .patterns import DEFAULT_FILE, SEVERITIES, Pattern, load

#: Environment variables that override single values: the prefix, the section and the field (PALIMPSEST_SLM_ENDPOINT).
ENVIRONMENT = "PALIMPSEST_"
#: Another name that routes may use.
ALIASES = {"google": "gemini"}


class SettingsError(ValueError):
    """Every fault of a file, one in a line."""


@dataclass(frozen=True)
class Behaviour:
    """The defaults here and below."""

    sanitization_mode: str = "redact"
    token_ttl_ms: int = 30_000
    max_vaults: int = 10_000
    max_tokens_per_vault: int = 100_000
    max_batch_items: int = 100
    max_prompt_bytes: int = 65_536
    max_batch_bytes: int = 1_048_576


@dataclass(frozen=True)
class Model:
    enabled: bool = False
    endpoint: str = ""
    timeout_ms: int = 800
    max_input_bytes: int = 16_384
    failure_threshold: int = 5
    cooldown_ms: int = 30_000


@dataclass(frozen=True)
class Provider:
    enabled: bool = False
    base_url: str = ""
    timeout: int = 30


@dataclass(frozen=True)
class Settings:
    behaviour: Behaviour = Behaviour()
    slm: Model = Model()
    labels: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    providers: Mapping[str, Provider] = field(default_factory=dict)
    default_provider: str = "openai"
    models: Mapping[str, str] = field(default_factory=dict)
    prefixes: Mapping[str, str] = field(default_factory=lambda: dict(routing.PREFIXES))
    pattern_file: str = ""
    custom_patterns: str = ""

    def limits(self) -> requests.Limits:
        b = self.behaviour
        return requests.Limits(b.max_batch_items, b.max_prompt_bytes, b.max_batch_bytes)

    def patterns(self) -> list[Pattern]:
        return load(self.pattern_file or DEFAULT_FILE, self.custom_patterns or None)

    def ttl_s(self) -> int:
        """The time to live in whole seconds, one at least."""
        return max(1, self.behaviour.token_ttl_ms // 1000)

    def breaker(self) -> contextual.Breaker:
        return contextual.Breaker(self.slm.failure_threshold, self.slm.cooldown_ms / 1000)

    def route(self, df: DataFrame, model: str = "model") -> DataFrame:
        """df with the provider of each model."""
        exact, prefixes = routing.routes(df.sparkSession, dict(self.models), tuple(self.prefixes.items()))
        return routing.route(df, exact, prefixes, self.default_provider, model)

    def run_batch(self, items: DataFrame) -> DataFrame:
        return requests.run_batch(items, self.behaviour.sanitization_mode, self.limits())


def _section(of: Any, name: str, faults: list[str]) -> dict:
    found = (of or {}).get(name)
    if found is None:
        return {}
    if not isinstance(found, dict):
        faults.append(f"{name} is no section")
        return {}
    return found


def _typed(kind: type, given: Mapping[str, Any], section: str, faults: list[str]) -> Any:
    """A section's values over its defaults; an empty text and a zero count as missing."""
    out = {}
    for f in fields(kind):
        value = given.get(f.name)
        usual = f.default
        if value is None or (value in ("", 0) and not isinstance(value, bool)):
            continue
        if type(value) is not type(usual):
            faults.append(f"{section}.{f.name} is not {type(usual).__name__}")
        elif type(usual) is int and value <= 0:
            faults.append(f"{section}.{f.name} must be positive")
        else:
            out[f.name] = value
    return kind(**out)


def _overridden(section: str, kind: type, given: dict, env: Mapping[str, str], faults: list[str]) -> dict:
    out = dict(given)
    for f in fields(kind):
        name = f"{ENVIRONMENT}{section}_{f.name}".upper()
        text = env.get(name, "")
        if text == "":
            continue
        try:
            out[f.name] = int(text) if type(f.default) is int else {"true": True, "false": False}[text.lower()] if type(f.default) is bool else text
        except (ValueError, KeyError):
            faults.append(f"{name} is not {type(f.default).__name__}")
    return out


def _names(of: dict, name: str, faults: list[str]) -> dict[str, str]:
    found = _section(of, name, faults)
    if wrong := [k for k, v in found.items() if not isinstance(k, str) or not k.strip() or not isinstance(v, str)]:
        faults.append(f"model_routing.{name} has entries that are empty or no texts: {wrong}")
    return {k: ALIASES.get(v, v) for k, v in found.items() if k not in wrong}


def _labels(slm: dict, faults: list[str]) -> dict[str, tuple[str, str, str]]:
    out = {}
    for label, new in _section(slm, "labels", faults).items():
        new = new if isinstance(new, dict) else {}
        severity = new.get("severity") or ""
        if severity not in ("", *SEVERITIES):
            faults.append(f"slm.labels.{label}.severity is none of {', '.join(SEVERITIES)}")
        out[label] = (str(new.get("type") or ""), severity, str(new.get("pattern") or ""))
    return out


def parsed(text: str, env: Mapping[str, str] | None = None) -> Settings:
    """The settings of a YAML text; SettingsError names every fault at once."""
    faults: list[str] = []
    try:
        tree = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise SettingsError(f"no YAML: {e}") from e
    if not isinstance(tree, dict):
        raise SettingsError("no sections")
    env = os.environ if env is None else env
    proxy, files = _section(tree, "proxy", faults), _section(tree, "patterns", faults)
    slm = _section(proxy, "slm", faults)
    behaviour = _typed(Behaviour, _overridden("behavior", Behaviour, _section(proxy, "behavior", faults), env, faults), "behavior", faults)
    if behaviour.sanitization_mode not in rewrite.MODES:
        faults.append(f"behavior.sanitization_mode is none of {', '.join(rewrite.MODES)}")
    model = _typed(Model, _overridden("slm", Model, slm | _section(slm, "breaker", faults), env, faults), "slm", faults)
    if model.enabled and not model.endpoint:
        faults.append("slm.endpoint is missing")
    given = {p: _section(proxy, p, faults) or _section(proxy, next((a for a, n in ALIASES.items() if n == p), p), faults) for p in PROVIDERS}
    providers = {p: _typed(Provider, _overridden(p, Provider, g, env, faults), p, faults) for p, g in given.items()}
    faults += [f"{n}.base_url is missing" for n, p in providers.items() if p.enabled and not p.base_url.strip()]
    ready = {n for n, p in providers.items() if p.enabled}
    if not ready:
        faults.append("no provider is enabled")
    rules = _section(proxy, "model_routing", faults)
    models = _names(rules, "models", faults)
    # Default prefixes go to enabled providers only; a file's own prefixes replace them all.
    prefixes = _names(rules, "prefixes", faults) or {k: v for k, v in routing.PREFIXES if v in ready}
    default = ALIASES.get(rules.get("default_provider"), rules.get("default_provider")) or "openai"
    for what, p in [("default_provider", default), *((f"models.{k}", v) for k, v in models.items()), *((f"prefixes.{k}", v) for k, v in prefixes.items())]:
        if p not in providers:
            faults.append(f"model_routing.{what} names an unknown provider: {p}")
        elif p not in ready:
            faults.append(f"model_routing.{what} names a provider that is not enabled: {p}")
    labels = _labels(slm, faults)
    if faults:
        raise SettingsError("\n".join(faults))
    return Settings(behaviour, model, labels, providers, default, models, prefixes, str(files.get("config_file") or ""), str(files.get("custom_patterns_dir") or ""))


def read(path: str | Path, env: Mapping[str, str] | None = None) -> Settings:
    """The settings of a file that the driver can read; relative pattern paths start at its folder."""
    found = parsed(Path(path).read_text(encoding="utf-8"), env)
    here = Path(path).parent
    return replace(found, **{n: str(here / getattr(found, n)) for n in ("pattern_file", "custom_patterns") if getattr(found, n)})


def read_stored(spark: SparkSession, path: str, env: Mapping[str, str] | None = None) -> Settings:
    """The settings of a file in a store that only Spark reads."""
    return parsed(spark.read.text(path, wholetext=True).first()[0], env)
