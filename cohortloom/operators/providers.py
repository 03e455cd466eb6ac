"""Text providers: what a language model or an embedding service is to the operators.

A provider is a function from a prompt to a text. Offline there is a deterministic stub; it says nothing about quality.
"""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def stub(prompt: str) -> str:
    """A fixed answer made from the prompt's digest."""
    return f"answer {hashlib.md5(prompt.encode()).hexdigest()[:8]} to {len(prompt)} characters"


def call(provider, prompt: str, tries: int = 5, wait: float = 0.0, fallback=None) -> str:
    """A provider's answer; read timeouts are tried again, then the fallback is asked; the last error is raised."""
    for k in range(tries):
        try:
            return provider(prompt)
        except TimeoutError:
            if k == tries - 1:
                if fallback is None:
                    raise
                return fallback(prompt)
            time.sleep(wait)


def complete(rows: DataFrame, prompt_col: str, provider=stub, out: str = "answer", keep_prompt: bool = True, **how) -> DataFrame:
    """rows with the provider's answers, batch by batch; a null prompt has a null answer. Prompts are read one at a time from a batch's
    buffers and go back only if they are kept."""
    kept = [f for f in rows.schema.fields if keep_prompt or f.name != prompt_col]

    def ask(batches):
        for b in batches:
            prompts = (p.as_py() for p in b.column(prompt_col))
            told = pa.array([None if p is None else call(provider, p, **how) for p in prompts], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], told], names=[*[f.name for f in kept], out])

    return rows.mapInArrow(ask, T.StructType([*kept, T.StructField(out, T.StringType())]))


def embed_stub(text: str, dim: int = 16) -> list[float]:
    """A unit vector made from the digests of a text's words."""
    v = np.zeros(dim)
    for w in text.replace("\n", " ").lower().split():
        h = hashlib.md5(w.encode()).digest()
        v[h[0] % dim] += 1 if h[1] % 2 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embed(rows: DataFrame, text_col: str, provider=embed_stub, out: str = "embedding", prefix: str = "") -> DataFrame:
    """rows with embeddings; line ends are spaces; texts that the provider fails on are dropped."""

    def work(batches):
        for pdf in batches:
            got = []
            for t in pdf[text_col]:
                try:
                    got.append(None if t is None else provider(prefix + t.replace("\n", " ")))
                except Exception:  # noqa: BLE001  a provider's failure drops the row, as documented
                    got.append(None)
            yield pdf.assign(**{out: got})

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(work, schema).filter(f"{out} IS NOT NULL")
