"""Refusal catalogue (H19): total, and only the model-provider codes are retryable."""

from factsheet.errors import REFUSAL_CODES, ProfileRefused, refusal_catalogue


def test_catalogue(spark):
    assert len(REFUSAL_CODES) == 18
    retry = {k for k, (_, r) in REFUSAL_CODES.items() if r}
    assert retry == {"LLM_UNAVAILABLE", "LLM_RATE_LIMITED", "LLM_TIMEOUT", "LLM_INVALID_OUTPUT"}
    assert refusal_catalogue(spark).count() == 18
    e = ProfileRefused("TARGET_ALL_NULL", "x")
    assert e.status == 422 and not e.retryable
