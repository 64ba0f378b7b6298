"""Settings from spark.doclens.* of the session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


def _number(text: str | None, kind: type, default):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Settings:
    model: str = "rules"
    temperature: float = 0.0
    rules_path: str | None = None
    dictionary_path: str | None = None
    concurrency: int = 6
    timeout_s: float | None = 60.0
    map_reduce_chars: int = 16_000
    max_chars: int = 3_000
    #: Folder of the model's stored answers; one below the shared folder if there is none.
    store_path: str | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        get = lambda name: spark.conf.get(f"spark.doclens.{name}", None)
        timeout = _number(get("timeoutSec"), float, 60.0)
        return cls(
            get("model") or cls.model,
            _number(get("temperature"), float, 0.0),
            get("rulesPath"),
            get("dictionaryPath"),
            max(1, _number(get("concurrency"), int, 6)),
            timeout if timeout > 0 else None,
            max(1, _number(get("mapReduceChars"), int, 16_000)),
            max(1, _number(get("maxChars"), int, 3_000)),
            get("storePath"),
        )
