"""Limits that decisions depend on: one frozen object, whose values a session overrides by ``foliospark.<name>``.

    spark.conf.set("foliospark.chunk_size", 800)

Frames take the settings of their session when a query is declared; a change later does not reach it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from foliospark.functions import dims

PREFIX = "foliospark."


@dataclass(frozen=True)
class Settings:
    fields_for_success: int = dims.FIELDS_FOR_SUCCESS
    fields_for_partial: int = dims.FIELDS_FOR_PARTIAL
    fields_for_no_fallback: int = dims.FIELDS_FOR_NO_FALLBACK
    low_confidence: float = dims.LOW_CONFIDENCE
    ocr_sure: float = dims.OCR_SURE
    ocr_sure_after_cleaning: float = dims.OCR_SURE_AFTER_CLEANING
    ocr_regions: int = dims.OCR_REGIONS
    chunk_size: int = dims.CHUNK
    chunk_overlap: int = dims.OVERLAP
    nearest: int = dims.NEAREST
    archive_limit: int = dims.ARCHIVE_LIMIT

    def __post_init__(self) -> None:
        for x in fields(self):
            if getattr(self, x.name) < 0:
                raise ValueError(f"{x.name} is negative")
        if not self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap is not less than chunk_size")
        if not self.nearest:
            raise ValueError("nearest is 0")


def settings(spark: SparkSession) -> Settings:
    """The defaults with what the session sets; a name that is none and a value that does not parse are errors."""
    kinds = {x.name: type(x.default) for x in fields(Settings)}
    given = {}
    for key, value in spark.conf.getAll.items():
        if key.startswith(PREFIX):
            name = key.removeprefix(PREFIX)
            if name not in kinds:
                raise ValueError(f"{key} is no setting; there are {', '.join(sorted(kinds))}")
            try:
                given[name] = kinds[name](value)
            except ValueError:
                raise ValueError(f"{key} is {value!r}, which is no {kinds[name].__name__}") from None
    return Settings(**given)
