"""Signed tokens that say which process may use the service, and until when."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import secrets
import struct
import time
from collections.abc import Callable
from typing import NamedTuple

#: Fixed values of the format.
PREFIX = "ogl_live_"
LAYOUT = struct.Struct(">iqq")  # process, minted, expires
TAG_BYTES = 32
MAX_TTL = 30 * 24 * 3600
OK, MALFORMED, BAD_SIGNATURE, EXPIRED, WRONG_PROCESS = "ok", "malformed", "bad_signature", "expired", "wrong_process"


class Claims(NamedTuple):
    status: str
    pid: int | None = None
    minted_at: int | None = None
    expires_at: int | None = None


class Minter:
    def __init__(self, ttl: int, secret: bytes | None = None, clock: Callable[[], float] = time.time) -> None:
        if ttl <= 0:
            raise ValueError("the time to live must be positive")
        self.ttl, self.secret, self.clock = min(ttl, MAX_TTL), secret or secrets.token_bytes(32), clock

    def mint(self, pid: int) -> str:
        now = int(self.clock())
        payload = LAYOUT.pack(pid, now, now + self.ttl)
        tag = hmac.new(self.secret, payload, hashlib.sha256).digest()
        return PREFIX + base64.b32encode(payload + tag).decode().rstrip("=")


def verify(token: str | None, secret: bytes, now: float, pid: int | None = None) -> Claims:
    """Claims of a token with the first check it fails, if any; without ``pid`` any process will do."""
    if token is None or not token.startswith(PREFIX):
        return Claims(MALFORMED)
    body = token[len(PREFIX) :]
    try:
        raw = base64.b32decode(body + "=" * (-len(body) % 8))
    except (binascii.Error, ValueError):
        return Claims(MALFORMED)
    if len(raw) != LAYOUT.size + TAG_BYTES:
        return Claims(MALFORMED)
    payload, tag = raw[: LAYOUT.size], raw[LAYOUT.size :]
    if not hmac.compare_digest(tag, hmac.new(secret, payload, hashlib.sha256).digest()):
        return Claims(BAD_SIGNATURE)
    owner, minted, expires = LAYOUT.unpack(payload)
    status = EXPIRED if int(now) >= expires else WRONG_PROCESS if pid is not None and pid != owner else OK
    return Claims(status, owner, minted, expires)
