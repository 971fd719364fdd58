"""Errors of the ledger, each with a machine-readable reason."""

from __future__ import annotations


class LedgerError(Exception):
    reason = "operation"
    retryable = False


class InvalidInput(LedgerError):
    reason = "invalid_input"


class PreconditionFailed(LedgerError):
    reason = "precondition_failed"


class ConcurrentMutation(LedgerError):
    reason = "concurrent_mutation"
    retryable = True


class MissingEmbedding(LedgerError):
    reason = "missing_embedding"


class EmbeddingSpaceMismatch(LedgerError):
    reason = "embedding_space"


class RateLimited(LedgerError):
    reason = "rate_limited"
    retryable = True
