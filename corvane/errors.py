"""Error classes, and which failures are worth a retry."""

from __future__ import annotations


class EngineError(ValueError):
    """Any failure that a repetition would not mend."""


class ConfigError(EngineError):
    pass


class UnknownComponent(EngineError):
    def __init__(self, kind: str, name: str, available: list[str]):
        super().__init__(f"no {kind} named {name!r}; available: {', '.join(sorted(available)) or 'none'}")


class DuplicateComponent(EngineError):
    pass


class UnalignedSpan(EngineError):
    pass


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} dimensions, got {got}")


class ProviderError(EngineError):
    def __init__(self, fault: str, message: str, status: int | None = None):
        super().__init__(f"{fault}: {message}")
        self.fault, self.status = fault, status


class RetryableError(ProviderError):
    """Rate limits, timeouts and server faults."""


def classify(status: int | None) -> str:
    """Fault of an HTTP status; no status at all counts as invalid."""
    if status is None:
        return "invalid"
    if status == 429:
        return "rate_limited"
    if status in (401, 403):
        return "auth"
    if status in (408, 504):
        return "timeout"
    return "server" if 500 <= status < 600 else "invalid"


def is_retryable(fault: str) -> bool:
    return fault in ("rate_limited", "timeout", "server")


def provider_error(status: int | None, message: str) -> ProviderError:
    fault = classify(status)
    return (RetryableError if is_retryable(fault) else ProviderError)(fault, message, status)
