"""External models behind one interface: a provider turns a batch of inputs into outputs; what fails is tried again, then null.

Recognition, language models and embeddings are services; a session passes its own providers.  The ones here need no
network and give the same answer every time.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list]
#: Size of the vector that stands in where no service answers.
DIMS = 1536


def constant_vector(texts: list[str]) -> list[list[float]]:
    return [[0.1] * DIMS for _ in texts]


def hashed_vector(dims: int = 32) -> Provider:
    """Vectors from digests: equal texts get equal ones, and none has the length 0."""

    def run(texts: list[str]) -> list[list[float]]:
        return [[(b + 1) / 256 for b in hashlib.shake_128(t.encode()).digest(dims)] for t in texts]

    return run


def provided(df: DataFrame, column: str, out: str, kind: str, provider: Provider, *, batch: int = 25, tries: int = 3, pause: float = 0.2) -> DataFrame:
    """Adds provider(values) in batches.  A batch that fails is tried again, then its rows are null; others aren't touched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list = []
            for at in range(0, len(pdf), batch):
                part = pdf[column].iloc[at : at + batch].fillna("").tolist()
                for n in range(tries):
                    try:
                        made += provider(part)
                        break
                    except Exception:  # a service's failure is data here: the rows stay, without an answer
                        time.sleep(pause * 2**n)
                else:
                    made += [None] * len(part)
            yield pdf.assign(**{out: pd.Series(made, index=pdf.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {out} {kind}")
