"""Continuation cursors and the check of option names."""

from __future__ import annotations

import base64
import hashlib
import json


def fingerprint(**request) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()[:16]


def encode_cursor(kind: str, snapshot_id: str, request: str, position: list) -> str:
    return base64.urlsafe_b64encode(json.dumps({"k": kind, "s": snapshot_id, "f": request, "p": position}).encode()).decode()


def decode_cursor(cursor: str, kind: str, snapshot_id: str, request: str) -> list | None:
    """The position; null for what isn't a cursor, an error for one of another kind, snapshot or request."""
    try:
        c = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        got = (c["k"], c["s"], c["f"])
    except (ValueError, KeyError, TypeError):
        return None
    for what, a, b in zip(("kind", "snapshot", "request"), got, (kind, snapshot_id, request)):
        if a != b:
            raise ValueError(f"the cursor belongs to another {what}")
    return c["p"]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def check_options(given: list[str], known: list[str]) -> None:
    """Rejects an unknown option, with the known one that is an edit away, if there is one."""
    for name in given:
        if name not in known:
            near = [k for k in sorted(known) if distance(name, k) <= 1]
            raise ValueError(f"unknown option {name}" + (f"; did you mean {near[0]}?" if near else ""))
