"""Refusals (H19): every code the profiler or the admission checks can raise.

FIXED VALUES: the refusal codes, their HTTP-style status and whether a retry
can help. Only the four model-provider codes are retryable; they are kept in
the catalogue for completeness of the vocabulary although no model is called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# code: (status, retryable)
REFUSAL_CODES: dict[str, tuple[int, bool]] = {
    "FILE_TOO_LARGE": (413, False),
    "UNPARSEABLE_CSV": (422, False),
    "DATASET_TOO_LARGE_IN_MEMORY": (413, False),
    "EMPTY_DATASET": (422, False),
    "HEADER_ONLY": (422, False),
    "SINGLE_COLUMN": (422, False),
    "TOO_MANY_COLUMNS": (422, False),
    "DUPLICATE_COLUMNS": (422, False),
    "TARGET_NOT_FOUND": (422, False),
    "TARGET_ALL_NULL": (422, False),
    "TARGET_SINGLE_VALUE": (422, False),
    "TARGET_TYPE_UNSUPPORTED": (422, False),
    "DATASET_EXPIRED": (410, False),
    "LLM_UNAVAILABLE": (503, True),
    "LLM_RATE_LIMITED": (429, True),
    "LLM_TIMEOUT": (504, True),
    "LLM_INVALID_OUTPUT": (502, True),
    "VALIDATION_FAILED": (422, False),
}


@dataclass
class ProfileRefused(Exception):
    code: str
    message: str
    details: dict = field(default_factory=dict)

    def __post_init__(self):
        super().__init__(f"{self.code}: {self.message}")

    @property
    def retryable(self) -> bool:
        return REFUSAL_CODES.get(self.code, (500, False))[1]

    @property
    def status(self) -> int:
        return REFUSAL_CODES.get(self.code, (500, False))[0]


def refusal_catalogue(spark):
    """The catalogue as a tiny DataFrame (code, status, retryable)."""
    rows = [(k, v[0], v[1]) for k, v in REFUSAL_CODES.items()]
    return spark.createDataFrame(rows, "code string, status int, retryable boolean")
