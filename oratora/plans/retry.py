"""Repeated attempts for what may fail for a while."""

from __future__ import annotations

import functools
import time


def retry(attempts: int = 3, delay: float = 1.0, backoff: float = 2.0, errors: tuple[type[Exception], ...] = (Exception,), sleep=time.sleep):
    """Decorator: up to so many attempts, each wait longer by ``backoff``; the last error is raised."""

    def wrap(f):
        @functools.wraps(f)
        def run(*a, **k):
            wait = delay
            for left in range(attempts - 1, -1, -1):
                try:
                    return f(*a, **k)
                except errors:
                    if not left:
                        raise
                    sleep(wait)
                    wait *= backoff

        return run

    return wrap
