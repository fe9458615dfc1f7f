"""Minting and verifying tokens, as columns."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.kernels import captoken
from cloakwork.operators.requests import key_path

CLAIMS = "status string, pid int, minted_at long, expires_at long"


def mint(pid: Column, secret: bytes, ttl: int, now: int | None = None) -> Column:
    """A token for each process; ``now`` is taken on the driver, so that retried tasks mint equal ones."""
    minter = captoken.Minter(ttl, secret, lambda at=int(time.time()) if now is None else now: at)

    @F.pandas_udf("string")
    def run(pids: pd.Series) -> pd.Series:
        return pids.map(lambda p: None if pd.isna(p) else minter.mint(int(p)))

    return run(pid)


def verify(token: Column, secret: bytes, now: int | None = None, pid: int | None = None) -> Column:
    """struct of status and claims; a missing token is malformed. Without ``pid`` any process will do."""
    at = int(time.time()) if now is None else now

    @F.pandas_udf(CLAIMS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for tokens in parts:
            claims = [captoken.verify(t, secret, at, pid) for t in tokens]
            yield pd.DataFrame(claims, columns=["status", "pid", "minted_at", "expires_at"]).astype({"pid": "Int32", "minted_at": "Int64", "expires_at": "Int64"})

    return run(token)


def authorise(path: Column, secret: bytes, now: int | None = None) -> Column:
    """struct(rest, ok) of a path that must begin with a valid token; the process is not looked at."""
    split = key_path(path)
    fine = verify(F.when(split["ok"], split["token"]), secret, now)["status"] == captoken.OK
    return F.struct(F.when(fine, split["rest"]).alias("rest"), fine.alias("ok"))
