"""Counters that are taken along with the write."""

import pytest

from palimpsest.operators import report, rewrite


@pytest.mark.parametrize("texts", [["a@b.co", "nothing", None, "", "a@b.co and c@d.co " * 3], []])
def test_counters_of_a_write_equal_the_aggregate(spark, tmp_path, texts):
    sanitized = rewrite.sanitize(spark.createDataFrame([(t,) for t in texts], "text string"))
    out, counts = report.observed(sanitized)
    out.write.parquet(str(tmp_path / "out"))
    want = report.metrics_text(spark.read.parquet(str(tmp_path / "out"))).first().text
    assert report.observed_text(counts) == want == report.metrics_text(sanitized).first().text
    assert f"sanitizer_requests_total {len(texts)}\n" in want
