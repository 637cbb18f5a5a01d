"""Fetching of pages: rate limit, cached files, retries; ``pagecache`` does so from tasks."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable
from pathlib import Path


class FetchError(RuntimeError):
    """A page that cannot be had; ``status`` where there was an answer."""

    def __init__(self, url: str, reason: str, status: int | None = None):
        super().__init__(f"{url}: {reason}")
        self.url, self.reason, self.status = url, reason, status


def page_name(url: str) -> str:
    """The file name of a page: 20 hexadecimal digits of its address."""
    return f"{hashlib.sha256(url.encode()).hexdigest()[:20]}.html"


class RateLimiter:
    """At least ``gap`` seconds between calls and at most ``per_minute`` in any minute."""

    def __init__(self, gap: float = 3.5, per_minute: int = 16, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.per_minute, self.clock, self.sleep = gap, per_minute, clock, sleep
        self.calls: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and self.calls[0] <= now - 60:
            self.calls.popleft()
        due = self.calls[-1] + self.gap if self.calls else now
        if len(self.calls) >= self.per_minute:
            due = max(due, self.calls[-self.per_minute] + 60)
        if due > now:
            self.sleep(due - now)
        self.calls.append(max(now, due))


class PageCache:
    """Pages in files named by their address, in folders by its first two digits; ``get`` downloads what is absent, unless offline.

    ``download(url)`` returns (status, text). 429 waits 60 s times the attempt, 5xx 2 to the attempt; any other 4xx fails.
    """

    def __init__(self, folder: str, download: Callable[[str], tuple[int, str]] | None = None, limiter: RateLimiter | None = None, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.folder, self.download, self.limiter, self.retries, self.sleep = Path(folder), download, limiter or RateLimiter(), retries, sleep

    def file(self, url: str) -> Path:
        name = page_name(url)
        return self.folder / name[:2] / name

    def get(self, url: str, force: bool = False) -> str:
        file = self.file(url)
        if file.exists() and not force:
            return file.read_text(encoding="utf-8")
        if self.download is None:
            raise FetchError(url, "not in the cache, and offline")
        status = None
        for attempt in range(1, self.retries + 1):
            self.limiter.wait()
            status, text = self.download(url)
            if status < 400:
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(text, encoding="utf-8")
                return text
            if status != 429 and status < 500:
                break
            self.sleep(60 * attempt if status == 429 else 2**attempt)
        raise FetchError(url, f"status {status}", status)
