"""Embedding texts by a provider that works in batches and may fail.

The provider runs inside the tasks, one batch a call; a failure costs its batch only, which comes back as rows with the
reason instead of vectors.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import spread

BATCH, RETRIES = 32, 3


class Retryable(Exception):
    """A failure that may pass: too many requests, a server's error, a time-out."""


def http_provider(url: str, model: str, token: str | None = None, timeout: float = 30.0) -> Callable[[Sequence[str]], list[list[float]]]:
    """A provider that posts {"model", "input"} and reads {"data": [{"index", "embedding"}]}. 429 and 5xx can be retried."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        request = urllib.request.Request(url, json.dumps({"model": model, "input": list(texts)}).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                rows = json.load(r)["data"]
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Retryable(f"status {e.code}") from e
            raise
        except (urllib.error.URLError, TimeoutError) as e:
            raise Retryable(str(e)) from e
        return [row["embedding"] for row in sorted(rows, key=lambda row: row["index"])]

    return embed


def embed(chunks: DataFrame, provider: Callable[[Sequence[str]], list[list[float]]], dimension: int, batch: int = BATCH, retries: int = RETRIES, wait: float = 0.5) -> DataFrame:
    """(chunk_id, vector, error, attempts) from (chunk_id, text), one row a chunk.

    A batch is tried up to 1 + retries times while its failure is Retryable, with growing waits. A batch of another
    length, or a vector of another dimension, fails. Null texts are embedded as empty ones. Chunk ids must be unique
    (records.require_unique). A batch or dimension below 1 is an error.
    """
    if batch < 1 or dimension < 1 or retries < 0:
        raise ValueError("batch and dimension must be positive")

    def tried(texts: list[str]) -> tuple[list | None, str | None, int]:
        for n in range(1, retries + 2):
            try:
                got = provider(texts)
                if len(got) != len(texts):
                    return None, f"{len(got)} vectors for {len(texts)} texts", n
                if any(len(v) != dimension for v in got):
                    return None, "vectors of another dimension", n
                return got, None, n
            except Retryable as e:
                if n > retries:
                    return None, str(e) or "Retryable", n
                time.sleep(wait * 2 ** (n - 1))
            except Exception as e:  # noqa: BLE001  (a provider's failure is a result)
                return None, f"{type(e).__name__}: {e}", n
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                got, error, n = tried([t or "" for t in part["text"]])
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "vector": got if got is not None else [None] * len(part), "error": error, "attempts": n})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", F.col("text").cast("string").alias("text"))
    return spread(rows).mapInPandas(run, f"chunk_id {kind}, vector array<double>, error string, attempts int")
