"""The opaque cursor of a paged read: base64url JSON of a bucket, a time and an event id."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime


def encode(bucket: str, occurred_at: datetime, event_id: str) -> str:
    text = json.dumps({"b": bucket, "p": [occurred_at.isoformat(), event_id]}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode(cursor: str) -> tuple[str, datetime, str]:
    """The parts of a cursor; ValueError if it is malformed."""
    try:
        found = json.loads(base64.b64decode(cursor.encode() + b"=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        bucket, (at, event_id) = found["b"], found["p"]
        if not isinstance(bucket, str) or not isinstance(event_id, str):
            raise TypeError("parts are texts")
        return bucket, datetime.fromisoformat(at), event_id
    except (binascii.Error, UnicodeDecodeError, KeyError, TypeError, ValueError) as e:
        raise ValueError("malformed cursor") from e
