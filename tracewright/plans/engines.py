"""Engines that reach a model elsewhere: calls with back-off, and a hand-off by files. Neither knows a provider.

Both are plain objects that can be sent to executors; what they call or where they write is the caller's.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


class EngineError(RuntimeError):
    """An engine gave no text."""


class CallFailed(Exception):
    """What a transport raises: status (none for a lost connection or a timeout) and the wait the other side asks for, in seconds."""

    def __init__(self, status: int | None = None, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after

    @property
    def passing(self) -> bool:
        return self.status is None or self.status == 429 or self.status >= 500


class Refused(Exception):
    """What a transport raises where the model declines; never retried."""


@dataclass
class CallingEngine:
    """send(system, prompt) with retries. Five retries, from one second, doubled, at most a minute.

    A wait the other side asks for is kept up to the greatest delay; others are drawn uniformly from zero to the full
    delay, so that many workers don't return at once.
    """

    send: Callable[[str, str], str]
    max_retries: int = 5
    base_delay: float = 1.0
    max_delay: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[float, float], float] = random.uniform

    def delay(self, attempt: int, retry_after: float | None = None) -> float:
        if retry_after is not None:
            return min(retry_after, self.max_delay)
        return self.draw(0.0, min(self.base_delay * 2**attempt, self.max_delay))

    def complete(self, system: str, prompt: str) -> str:
        for attempt in range(self.max_retries + 1):
            try:
                text = self.send(system, prompt).strip()
            except Refused as e:
                raise EngineError("refused") from e
            except CallFailed as e:
                if not e.passing:
                    raise EngineError(f"not to be retried: {e}") from e
                if attempt == self.max_retries:
                    raise EngineError(f"failed after {self.max_retries} retries: {e}") from e
                self.sleep(self.delay(attempt, e.retry_after if e.status == 429 else None))
                continue
            if not text:
                raise EngineError("empty answer")
            return text
        raise EngineError("no attempt was allowed")


@dataclass
class HandOffEngine:
    """K6: writes a request file and waits for the answer's. Each request has files of its own, so that several tasks may wait at once."""

    folder: str
    poll: float = 2.0
    ceiling: float = 1800.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, system: str, prompt: str) -> str:
        base = Path(self.folder)
        base.mkdir(parents=True, exist_ok=True)
        name = uuid.uuid4().hex
        asked, answer = base / f"{name}.request.txt", base / f"{name}.response.txt"
        part = base / f"{name}.part"
        part.write_text(f"{system}\n{prompt}", encoding="utf-8")
        part.rename(asked)  # never seen half-written
        waited = 0.0
        try:
            while waited < self.ceiling:
                text = answer.read_text(encoding="utf-8").strip() if answer.exists() else ""
                if text:
                    answer.unlink()
                    return text
                self.sleep(self.poll)
                waited += self.poll
        finally:
            asked.unlink(missing_ok=True)
        raise EngineError(f"no answer within {self.ceiling} s")
