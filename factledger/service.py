"""What stands around the operations: settings, a token bucket, and a time limit for a call."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from factledger import schema as S
from factledger.errors import InvalidInput, LedgerError, RateLimited

#: Fixed limits of the service.
PER_MINUTE, BURST, SECONDS = 120.0, 20.0, 45.0


class TimedOut(LedgerError):
    reason = "timeout"
    retryable = True


class TokenBucket:
    """So many calls a minute, and a burst to begin with."""

    def __init__(self, per_minute: float = PER_MINUTE, burst: float = BURST, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.burst, self.clock = per_minute / 60, burst, clock
        self.tokens, self.last, self.lock = burst, clock(), threading.Lock()

    def take(self) -> None:
        """One token, or RateLimited with the milliseconds until there is one."""
        with self.lock:
            now = self.clock()
            self.tokens, self.last = min(self.burst, self.tokens + max(0.0, now - self.last) * self.rate), now
            if self.tokens < 1:
                raise RateLimited(max(1, math.ceil((1 - self.tokens) / self.rate * 1000)))
            self.tokens -= 1


def within(spark: SparkSession, work: Callable[[], object], seconds: float = SECONDS) -> object:
    """The result of `work`, whose Spark jobs are cancelled once the time is over."""
    tag = f"call-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise TimedOut(f"{seconds} s are over") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


@dataclass(frozen=True)
class Semantic:
    """Settings of semantic recall, with their bounds."""

    ttl_days: int = S.TTL_DAYS
    neighbor_limit: int = S.NEIGHBORS
    recall_similarity_threshold: float = S.RECALL_FLOOR
    convergence_similarity_threshold: float = S.CONVERGE_FLOOR
    convergence_result_overlap_threshold: float = S.CONVERGE_OVERLAP
    rrf_k: float = S.RRF_K
    direct_weight: float = S.DIRECT_WEIGHT
    keyword_weight: float = S.FALLBACK_WEIGHT

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise InvalidInput(f"semantic: {what}")

        numbers = (self.recall_similarity_threshold, self.convergence_similarity_threshold, self.convergence_result_overlap_threshold, self.rrf_k, self.direct_weight, self.keyword_weight)
        need(all(math.isfinite(x) for x in numbers), "numbers are finite")
        need(0 < self.ttl_days <= S.LONG_MAX // 86_400_000, "ttl_days is positive and its milliseconds fit a long")
        need(1 <= self.neighbor_limit <= 100, "neighbor_limit is 1 to 100")
        need(0 <= self.recall_similarity_threshold < 1, "recall_similarity_threshold is 0 or more and below 1")
        need(0 <= self.convergence_similarity_threshold <= 1 and 0 <= self.convergence_result_overlap_threshold <= 1, "convergence thresholds are 0 to 1")
        need(self.rrf_k > 0 and self.keyword_weight > 0 and self.direct_weight > self.keyword_weight, "rrf_k and keyword_weight are positive, direct_weight is greater than keyword_weight")


@dataclass(frozen=True)
class Config:
    """Where the ledger is and how it recalls; read from a TOML file, over which the environment given wins."""

    path: str = ""
    semantic: Semantic = field(default_factory=Semantic)

    @classmethod
    def load(cls, file: str | Path, environment: dict[str, str] | None = None) -> Config:
        import tomllib

        given = tomllib.loads(Path(file).read_text(encoding="utf-8")) if Path(file).exists() else {}
        known = {"path", "semantic"}
        if set(given) - known or set(given.get("semantic", {})) - set(Semantic.__dataclass_fields__):
            raise InvalidInput("settings that are not known")
        path = (environment or {}).get("FACTLEDGER_PATH") or given.get("path", "")
        return cls(path, Semantic(**given.get("semantic", {})))
