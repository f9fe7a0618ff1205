"""Model providers behind one HTTP seam: mock, cache, rate limit, retry, chat and typed judging.

All of it runs inside executors' Python functions, so everything here pickles. Keys come only
from the environment variable that a configuration names.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from .errors import ConfigError, ProviderError, RetryableError, provider_error


class HttpPost(Protocol):
    def post(self, url: str, headers: dict[str, str], body: str) -> tuple[int, str]: ...


@dataclass
class HttpClient:
    timeout_secs: float = 60.0

    def post(self, url: str, headers: dict[str, str], body: str) -> tuple[int, str]:
        """One blocking request; a status is returned, not raised."""
        req = urllib.request.Request(url, body.encode(), headers)
        try:
            with urllib.request.urlopen(req, timeout=self.timeout_secs) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")
        except TimeoutError as e:
            raise RetryableError("timeout", str(e)) from None
        except OSError as e:
            raise ProviderError("invalid", str(e)) from None


@dataclass
class MockHttp:
    """Canned responses in order; the last one repeats. Calls are recorded."""

    responses: list[tuple[int, str]]
    calls: list[tuple[str, str]] = field(default_factory=list)

    def post(self, url: str, headers: dict[str, str], body: str) -> tuple[int, str]:
        self.calls.append((url, body))
        return self.responses[min(len(self.calls), len(self.responses)) - 1]


@dataclass
class CachedHttp:
    """Responses by content: the key covers url and body, never headers; only 2xx are kept."""

    inner: HttpPost
    root: str
    keep_empty: bool = True
    hits: int = 0
    misses: int = 0
    writes: int = 0
    bytes_served: int = 0

    def _path(self, url: str, body: str) -> Path:
        key = hashlib.blake2b(url.encode() + b"\0" + body.encode(), digest_size=32).hexdigest()
        return Path(self.root, key[:2], key)

    def post(self, url: str, headers: dict[str, str], body: str) -> tuple[int, str]:
        p = self._path(url, body)
        if p.exists():
            text = p.read_text()
            self.hits += 1
            self.bytes_served += len(text)
            return 200, text
        self.misses += 1
        status, text = self.inner.post(url, headers, body)
        if 200 <= status < 300 and (text or self.keep_empty):
            p.parent.mkdir(parents=True, exist_ok=True)
            part = p.with_name(f"{p.name}.{uuid.uuid4().hex}")
            part.write_text(text)
            os.replace(part, p)
            self.writes += 1
        return status, text

    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    def size_bytes(self) -> int:
        return sum(p.stat().st_size for p in Path(self.root).rglob("*") if p.is_file())

    def clear(self) -> int:
        files = [p for p in Path(self.root).rglob("*") if p.is_file()]
        for p in files:
            p.unlink()
        return len(files)


class RateLimiter:
    """Reserves slots 60 / rpm seconds apart; a rate of 0 or less is no limit."""

    def __init__(self, rpm: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap = 60.0 / rpm if rpm > 0 else 0.0
        self.clock, self.sleep, self.next, self.lock = clock, sleep, 0.0, threading.Lock()

    def wait(self) -> float:
        if not self.gap:
            return 0.0
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)
        return at - now


@dataclass
class RateLimited:
    """Below the cache, so that a cached response takes no slot."""

    inner: HttpPost
    limiter: RateLimiter

    def post(self, url: str, headers: dict[str, str], body: str) -> tuple[int, str]:
        self.limiter.wait()
        return self.inner.post(url, headers, body)


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 5
    base_delay_ms: int = 500
    max_delay_ms: int = 30_000

    def delay(self, attempt: int, rng: random.Random) -> float:
        """Full jitter below an exponential bound, in seconds."""
        return rng.random() * min(self.max_delay_ms, self.base_delay_ms * 2**attempt) / 1000

    def run(self, call: Callable[[int], Any], sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Any:
        rng = rng or random.Random()
        for attempt in range(max(1, self.max_attempts)):
            try:
                return call(attempt)
            except RetryableError:
                if attempt + 1 >= self.max_attempts:
                    raise
                sleep(self.delay(attempt, rng))


def transport(cache_dir: str | None = None, rpm: float = 0.0, http: HttpPost | None = None) -> HttpPost:
    """Cache above rate limit above network."""
    http = http or HttpClient()
    if rpm > 0:
        http = RateLimited(http, RateLimiter(rpm))
    return CachedHttp(http, cache_dir) if cache_dir else http


_TRANSPORTS: dict[tuple, tuple[HttpPost | None, HttpPost]] = {}
_TRANSPORTS_LOCK = threading.Lock()


def shared_transport(cache_dir: str | None, rpm: float, timeout_secs: float, http: HttpPost | None = None) -> HttpPost:
    """The ``transport`` of these settings, built once in each worker, so that its limiter and counters last.

    A given ``http`` stands for the network; what it answers is not cached.
    """
    key = (cache_dir or None, rpm, timeout_secs, id(http) if http is not None else None)
    with _TRANSPORTS_LOCK:
        if key not in _TRANSPORTS:
            # the given http is kept with its transport, so that its id stays its own
            _TRANSPORTS[key] = http, transport(None if http is not None else cache_dir or None, rpm, http or HttpClient(timeout_secs))
        return _TRANSPORTS[key][1]


def api_key(variable: str) -> str:
    if not (key := os.environ.get(variable)):
        raise ConfigError(f"the environment variable {variable} is not set")
    return key


def ask(http: HttpPost, url: str, key: str, payload: dict, retry: RetryPolicy, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One JSON request with retries; failures carry the provider's own message."""
    headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
    body = json.dumps(payload)

    def once(_: int) -> str:
        status, text = http.post(url, headers, body)
        if 200 <= status < 300:
            return text
        try:
            message = json.loads(text)["error"]["message"]
        except (ValueError, KeyError, TypeError):
            message = text[:200]
        raise provider_error(status, message)

    try:
        return json.loads(retry.run(once, sleep))
    except json.JSONDecodeError as e:
        raise ProviderError("invalid", f"malformed JSON: {e}") from None


@dataclass(frozen=True)
class ChatConfig:
    models: tuple[str, ...] = ("small-chat", "large-chat")
    endpoint: str = "https://localhost/v1/chat/completions"
    api_key_env: str = "CHAT_API_KEY"
    max_tokens: int = 400
    temperature: float = 0.0
    disable_reasoning: bool = True
    requests_per_minute: float = 0.0
    timeout_secs: float = 90.0
    cache: str = "chat"
    retry: RetryPolicy = RetryPolicy()

    def __post_init__(self) -> None:
        if not self.models:
            raise ConfigError("no models")


@dataclass
class Chat:
    """Completion with a chain of models: each failure, an empty answer too, tries the next one."""

    config: ChatConfig
    http: HttpPost | None = None
    key: str | None = None
    sleep: Callable[[float], None] = time.sleep

    def complete(self, system: str, user: str) -> str:
        c = self.config
        key = self.key or api_key(c.api_key_env)
        http = shared_transport(c.cache, c.requests_per_minute, c.timeout_secs, self.http)
        last: ProviderError = ProviderError("invalid", "no models")
        for model in c.models:
            turns = [dict(zip(("role", "content"), t, strict=True)) for t in (("system", system), ("user", user))]
            payload = {"model": model, "messages": turns} | {k: getattr(c, k) for k in ("max_tokens", "temperature")}
            if c.disable_reasoning:
                payload["reasoning"] = {"enabled": False}
            try:
                reply = ask(http, c.endpoint, key, payload, c.retry, self.sleep)
                text = ((reply.get("choices") or [{}])[0].get("message", {}).get("content") or "").strip()
                if text:
                    return text
                last = ProviderError("invalid", f"{model}: empty completion")
            except ProviderError as e:
                last = e
        raise last


_NUMBER = re.compile(r"^([0-9]{1,2})[.)]")


def parse_lines(text: str, limit: int) -> list[str]:
    """The items of a list as chat models write them: bullets, numbers and quotes removed."""
    out: list[str] = []
    for line in text.splitlines():
        t = line.strip().lstrip("-*•").strip()
        t = _NUMBER.sub("", t, count=1).strip()
        t = t.strip("\"'`").strip()
        if len(t.encode()) >= 3 and not t.endswith(":"):
            out.append(t)
        if len(out) >= limit:
            break
    return out
