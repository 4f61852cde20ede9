"""Settings: defaults, every fault at once, overrides, and what the operators get."""

import pytest

from palimpsest.plans.sessions import SETTINGS
from palimpsest.sources import settings

GOOD = """
server: {port: "1"}
proxy:
  behavior: {sanitization_mode: tokenize, max_batch_items: 7, token_ttl_ms: 0}
  slm: {enabled: true, endpoint: "http://m", breaker: {failure_threshold: 2}, labels: {secret: {severity: WARN}}}
  openai: {enabled: true, base_url: "http://o"}
  google: {enabled: true, base_url: "http://g", timeout: 5}
  model_routing: {models: {special: google}}
"""


def test_defaults_and_values():
    s = settings.parsed(GOOD, {})
    assert s.behaviour == settings.Behaviour("tokenize", max_batch_items=7) and s.ttl_s() == 30
    assert s.limits().max_items == 7 and s.limits().max_prompt_bytes == 65536
    assert s.slm.failure_threshold == 2 and s.slm.cooldown_ms == 30000 and s.breaker().failures == 2
    assert s.labels == {"secret": ("", "WARN", "")} and s.models == {"special": "gemini"} and s.providers["gemini"].timeout == 5
    assert s.prefixes == {"gpt-": "openai", "o": "openai", "gemini-": "gemini"} and len(s.patterns()) == 24


def test_overrides():
    env = {"PALIMPSEST_SLM_ENDPOINT": "http://n", "PALIMPSEST_BEHAVIOR_MAX_PROMPT_BYTES": "9", "PALIMPSEST_DEEPSEEK_ENABLED": "true", "PALIMPSEST_DEEPSEEK_BASE_URL": "http://d"}
    s = settings.parsed(GOOD, env)
    assert s.slm.endpoint == "http://n" and s.limits().max_prompt_bytes == 9 and s.prefixes["deepseek-"] == "deepseek"
    with pytest.raises(settings.SettingsError, match="MAX_VAULTS is not int"):
        settings.parsed(GOOD, {"PALIMPSEST_BEHAVIOR_MAX_VAULTS": "many"})


def test_every_fault_is_named():
    bad = """
proxy:
  behavior: {sanitization_mode: mask, max_vaults: -1, max_prompt_bytes: "9"}
  slm: {enabled: true, labels: {a: {severity: LOUD}}}
  openai: {enabled: true}
  anthropic: nothing
  model_routing: {default_provider: gemini, models: {" ": openai}, prefixes: {x: nobody}}
"""
    with pytest.raises(settings.SettingsError) as e:
        settings.parsed(bad, {})
    for part in ("sanitization_mode", "max_vaults must be positive", "max_prompt_bytes is not int", "slm.endpoint", "severity", "openai.base_url", "anthropic is no section", "not enabled: gemini", "entries that are empty", "unknown provider: nobody"):
        assert part in str(e.value)


@pytest.mark.parametrize("text", ["", "- a", "a: [", "proxy: {openai: {enabled: false}}"])
def test_refused(text):
    with pytest.raises(settings.SettingsError):
        settings.parsed(text, {})


def test_files(spark, tmp_path):
    (tmp_path / "more").mkdir()
    (tmp_path / "s.yaml").write_text(GOOD + "patterns: {custom_patterns_dir: more}\n")
    assert settings.read(tmp_path / "s.yaml", {}).custom_patterns == str(tmp_path / "more")
    assert settings.read_stored(spark, str(tmp_path / "s.yaml"), {}).behaviour.max_batch_items == 7
    s = settings.parsed(SETTINGS, {})
    got = {r.model: r.provider for r in s.route(spark.createDataFrame([("claude-x",), ("special",), ("else",), ("",)], "model string")).collect()}
    assert got == {"claude-x": "anthropic", "special": "gemini", "else": "anthropic", "": None}
