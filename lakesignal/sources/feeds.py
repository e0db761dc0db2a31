"""Feeds over HTTP: the newest slot of an index, files by slot, and an encoder
of titles; callables that Spark's tasks run, with their own retries."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RETRIES, BACKOFF, AGAIN = 4, 2.0, (500, 502, 503, 504)
# Fixed value: a file's name in an index or an address; the second feed is a translation.
NAME = r"(\d{14})\.(translation\.)?gkg\.csv\.zip"


def file_url(base: str, feed: str, slot: str) -> str:
    return f"{base}{slot}.{'translation.' if feed == 'tr' else ''}gkg.csv.zip"


def url_of(base: str, feed: Column, slot: Column) -> Column:
    """``file_url`` as a column."""
    return F.concat(F.lit(base), slot, F.when(feed == "tr", ".translation").otherwise(""), F.lit(".gkg.csv.zip"))


def slot_of_name(c: Column) -> Column:
    """The slot in a file's name or address, null without one."""
    return F.nullif(F.regexp_extract(c, NAME, 1), F.lit(""))


def feed_of_name(c: Column) -> Column:
    return F.when(slot_of_name(c).isNotNull(), F.when(F.regexp_extract(c, NAME, 2) != "", "tr").otherwise("en"))


def newest_slot(index: str) -> str:
    """The slot of the first file that an index names."""
    found = re.search(NAME, index)
    if not found:
        raise ValueError("the index names no file")
    return found[1]


def fetched(url: str, timeout: float = 120, headers: dict[str, str] | None = None, data: bytes | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """A body; None for 404.  Connection errors and the codes in ``AGAIN`` are
    tried again; whatever is left is raised, and Spark repeats the task."""
    for n in range(RETRIES + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers or {}), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code not in AGAIN or n == RETRIES:
                raise
        except (urllib.error.URLError, TimeoutError):
            if n == RETRIES:
                raise
        sleep(BACKOFF * 2**n)
    raise AssertionError("unreachable")


def download(base: str) -> Callable[[str, str], bytes | None]:
    """``fetch`` for ``archive.mirror``."""
    return lambda feed, slot: fetched(file_url(base, feed, slot))


def newest(index: str) -> str:
    body = fetched(index, 30)
    if body is None:
        raise ValueError(f"no index at {index}")
    return newest_slot(body.decode())


def remote_encoder(url: str, token: Callable[[], str] | None = None, batch: int = 256) -> Callable[[Column], Column]:
    """Vectors of texts from a service: POST {"texts": [...]} to url/embed gives
    {"vectors": [[...]]}; ``token`` gives a fresh bearer token for each request."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token()}"} if token else {})
            body = fetched(f"{url.rstrip('/')}/embed", 300, head, json.dumps({"texts": texts.iloc[at : at + batch].tolist()}).encode())
            out += json.loads(body or b"{}")["vectors"]
        return pd.Series(out)

    return F.pandas_udf(embed, "array<double>")


def hashed_encoder(dim: int = 64) -> Callable[[Column], Column]:
    """Vectors of texts without a service: counts of their hashed words by sign."""

    def encode(text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
        marks = F.array(F.transform(words, lambda w: F.xxhash64(w)))  # bound below, so made once
        sign = lambda h: F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        place = lambda m, i: F.aggregate(m, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dim)) == i, sign(h)).otherwise(0.0))
        return F.flatten(F.transform(marks, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: place(m, i))))

    return encode
