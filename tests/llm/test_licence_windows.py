"""Licences of several lines and paragraphs inside other text."""

import re
import textwrap

import pytest

from palimpsest.llm import licences

OTHER = " ".join(f"other{k} word{k}" for k in range(45))
LONG = [n for n, t in licences.TEMPLATES.items() if len(licences.words_of(t)) > 60]


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize("gap", ("\n", "\n\n"))
def test_licence_between_other_text(name, gap):
    body = gap.join(textwrap.fill(p, 70) for p in re.split(r"(?<=[.:]) (?=[A-Z])", licences.TEMPLATES[name]))
    text = f"{OTHER}\n{OTHER}{gap}{body}{gap}{OTHER}\n{OTHER}"
    templates = licences.Templates(licences.TEMPLATES, licences.LEAST)
    assert ("window", name) in {(m["unit"], m["licence"]) for m in licences.unit_matches(text, templates)}
