"""Models given as plain callables, applied batch by batch on the executors. Answers usually come as tables instead."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed(text: Column, model: Callable[[list[str]], list[list[float]]], size: int) -> Column:
    """Vectors of a fixed size, one per text; a wrong number or size of vectors fails the job."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = model(texts.fillna("").tolist())
            if len(made) != len(texts) or any(len(v) != size for v in made):
                raise ValueError("the model must return one vector of the agreed size per text")
            yield pd.Series(made)

    return vectors(text)


def generate(prompts: DataFrame, key: str, model: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """key, response, error: one model call per prompt; a failing call becomes an error, not a failed job."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    out.append((row[0], model(row[1]), None))
                except Exception as error:  # noqa: BLE001
                    out.append((row[0], None, str(error)))
            yield pd.DataFrame(out, columns=[key, "response", "error"], dtype=object)

    return prompts.select(F.col(key).cast("string").alias(key), prompt).mapInPandas(
        answer, f"{key} string, response string, error string"
    )
