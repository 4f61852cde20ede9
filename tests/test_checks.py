"""Checks on strings against plain versions."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.checks import entropy


def test_entropy_of_odd_texts(spark):
    rng = random.Random(5)
    texts = ["", "a", "aab", "é😀é\n\r\x00", "(.*[\\$1", "x" * 20000, "".join(chr(rng.choice([10, 65, 0x4E00, 0x1F600]) + rng.randrange(30)) for _ in range(3000)), None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(entropy(F.col("t"))).collect()]
    for text, value in zip(texts, got, strict=True):
        want = None if text is None else -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
        assert value == (want if want is None else pytest.approx(want, abs=1e-9))


def test_entropy_does_not_grow_with_the_different_characters(spark):
    text = "".join(chr(0x4E00 + i % 10000) for i in range(40000))
    began = time.monotonic()
    assert spark.createDataFrame([(text,)], "t string").select(entropy(F.col("t"))).first()[0] == pytest.approx(math.log2(10000))
    assert time.monotonic() - began < 20
