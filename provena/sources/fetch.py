"""Ingest from remote services, on the driver and outside of queries: paced requests with bounded attempts.

The engine itself reads stored tables; these helpers only fill them.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable

PACE, ATTEMPTS, BACKOFF = 0.3, 6, 5.0
#: Seconds between requests to the advisory service that limits them most, and attempts at any.
ADVISORY_PACE, ADVISORY_ATTEMPTS = 6.5, 3


def fetch(url: str, body: bytes | None = None, attempts: int = ATTEMPTS, pace: float = PACE, backoff: float = BACKOFF, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes | None:
    """The response, null for 404; after 429 the n-th wait is n times ``backoff``; other faults are raised."""
    for n in range(1, attempts + 1):
        sleep(pace)
        try:
            with opener(urllib.request.Request(url, data=body)) as response:
                return response.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code != 429 or n == attempts:
                raise
            sleep(backoff * n)
    return None


def fetch_first(urls: Iterable[str], **how) -> tuple[str, bytes] | None:
    """The first address that exists and its content."""
    for url in urls:
        if (content := fetch(url, **how)) is not None:
            return url, content
    return None


def probe(label: str, url: str, body: dict | None = None, **how) -> dict:
    """label with the raw answer or the error, as it is stored in a snapshot."""
    try:
        content = fetch(url, json.dumps(body).encode() if body is not None else None, **({"attempts": ADVISORY_ATTEMPTS, "pace": ADVISORY_PACE} | how))
        return {"label": label, "json": None if content is None else content.decode("utf-8", "replace"), "error": None if content is not None else "not found"}
    except OSError as e:
        return {"label": label, "json": None, "error": str(e)}


def package_query(name: str | None = None, purl: str | None = None, ecosystem: str | None = None, version: str | None = None) -> dict:
    """The body of a package question, without empty fields."""
    package = {k: v for k, v in (("name", name), ("purl", purl), ("ecosystem", ecosystem)) if v}
    return {"package": package} | ({"version": version} if version else {})
