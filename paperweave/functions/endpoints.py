"""Requests to and answers from text-generation endpoints, and when to ask again."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def request(prompt: Column, parameters: dict[str, float]) -> Column:
    """The JSON body of a call: inputs and parameters."""
    return F.to_json(F.struct(prompt.alias("inputs"), F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()]).alias("parameters")))


def generated(response: Column) -> Column:
    """The text of a JSON response, a list of one object or the object itself; null where it is neither."""
    many = F.from_json(response, "array<struct<generated_text: string>>")
    one = F.from_json(response, "struct<generated_text: string>")
    return F.when(F.startswith(F.ltrim(response), F.lit("[")), F.get(many, F.lit(0))["generated_text"]).otherwise(one["generated_text"])


def temperature(attempt: Column, base: float = 0.7, patience: int = 5, step: float = 0.01) -> Column:
    """The temperature of an attempt, from 1: ``step`` more for each one after the first ``patience``."""
    return F.round(F.lit(base) + F.lit(step) * F.greatest(attempt - patience, F.lit(0)), 6)


def insistent(model: Callable[[str, float], str], labels: tuple[str, ...], base: float = 0.7, patience: int = 5, tries: int = 10, step: float = 0.01) -> Callable[[Column], Column]:
    """A column function: the first answer of the model (text, temperature) that is a label; after ``tries`` the label that the text's
    checksum draws."""
    def one(text: str) -> str:
        for attempt in range(1, tries + 1):
            answer = model(text, base + step * max(0, attempt - patience))
            if answer in labels:
                return answer
        return labels[zlib.crc32(text.encode()) % len(labels)]

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.fillna("").map(one)

    return run


def stub_hesitant(text: str, heat: float) -> str:
    """No answer below a temperature that the text's length gives, then 'positive' or 'negative'; none at all for some."""
    if len(text) % 7 == 0:
        return "?"
    return ("positive", "negative")[len(text) % 2] if heat >= 0.7 + len(text) % 5 / 100 - 1e-9 else "?"
