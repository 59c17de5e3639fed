"""What replaces model, encoder and tokenizer: plug-ins with deterministic defaults.

A plug-in is a function over a batch (pandas Series in and out), so that it runs as an Arrow UDF and is set
up once in each Python worker.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Recorded:
    """Answers by the hash of the prompt; what was not recorded gets `default`."""

    answers: dict[str, str] = field(default_factory=dict)
    default: str = ""

    @staticmethod
    def key(prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()

    def complete(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: self.answers.get(self.key(p), self.default))


@dataclass
class Retrying:
    """Tries a completion again, with a wait that doubles; what fails for good gets `failed`."""

    inner: Callable[[pd.Series], pd.Series]
    tries: int = 3
    wait: float = 0.5
    failed: str = "ERROR"

    def complete(self, prompts: pd.Series) -> pd.Series:
        for i in range(self.tries):
            try:
                return self.inner(prompts)
            except Exception:  # noqa: BLE001  a remote model may fail in any way
                if i + 1 < self.tries:
                    time.sleep(self.wait * 2**i)
        return pd.Series([self.failed] * len(prompts), index=prompts.index)


def completion(plugin) -> Callable[[Column], Column]:
    """A column function from a plug-in with complete()."""

    def run(prompts: pd.Series) -> pd.Series:
        return plugin.complete(prompts)

    run.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")
