"""Fetches that leave a note of every call, for readers that run in other processes."""

import os
import tempfile
import time
import uuid
from pathlib import Path

from tidepanel.sources.rest import SourceError, TransientError


#: Names the folder of the notes; workers that run already would not see a new environment variable.
POINTER = Path(tempfile.gettempdir()) / f"fake-fetch-{os.getuid()}"


def _note(what: str) -> int:
    """Leave a note and say how many there are of this kind."""
    folder = POINTER.read_text()
    with open(f"{folder}/{what}.{time.time():.6f}.{uuid.uuid4().hex}", "w"):
        pass
    return sum(n.startswith(f"{what}.") for n in os.listdir(folder))


def release(day: str):
    """Releases on Thursdays and Fridays; one in May fails once for good, one in June needs a second try, one week has none."""
    from datetime import date

    calls = _note(f"release {day}")
    if day == "2024-05-10" and calls == 1:
        raise SourceError("cut off")
    if day == "2024-06-07" and calls == 1:
        raise TransientError("busy")
    if date.fromisoformat(day).weekday() != 4 or day == "2024-04-12":
        return [{"ticker": "T", "n": 2}, {"ticker": "T", "n": 1}] if day == "2024-04-10" else None
    return [{"ticker": t, "day": day} for t in ("A", "B")]


def rows(endpoint: str, symbol: str):
    _note(f"{endpoint} {symbol}")
    if symbol == "BAD":
        raise SourceError("no such symbol")
    return [{"symbol": symbol, "n": i} for i in range(2)]
