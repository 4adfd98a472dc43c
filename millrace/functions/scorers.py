"""Scorers that a model can take the place of: a loaded model scores Arrow batches, the rules are what there is without.

`load` runs once a task and gives a function from a pandas Series (ranking: a DataFrame of features) to scores. Rows that
the model gives no answer for (null) fall back to the rules, so a model that fails costs quality and no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import features as X
from . import text as T

LABEL = "struct<label: string, confidence: double>"
Load = Callable[[], Callable[[pd.Series], pd.DataFrame]]


def _labelled(load: Load):
    @F.pandas_udf(LABEL)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield model(texts)[["label", "confidence"]].reset_index(drop=True)

    return run


def _label(text: Column, rules: Column, load: Load | None) -> Column:
    rules = F.struct(rules["label"].alias("label"), rules["confidence"].cast("double").alias("confidence"))
    if load is None:
        return rules
    found = _labelled(load)(text)
    return F.when(found["label"].isNotNull(), found).otherwise(rules)


def complexity(text: Column, load: Load | None = None) -> Column:
    """label, confidence: of the model's, else of the rules by length and terms."""
    return _label(text, T.complexity(text), load)


def sentiment(text: Column, load: Load | None = None) -> Column:
    """label, confidence; blank text is neutral with confidence 0 whatever the scorer."""
    blank = F.trim(T.text_of(text)) == ""
    return F.when(blank, F.struct(F.lit("neutral").alias("label"), F.lit(0.0).alias("confidence"))).otherwise(_label(text, T.sentiment(text), load))


def rank_score(row: Mapping[str, Column] | None = None, load: Callable[[], Callable[[pd.DataFrame], pd.Series]] | None = None) -> Column:
    """Score of the eight features: of the model's, else the blend."""
    blend = X.blend(row)
    if load is None:
        return blend

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            yield pd.Series(model(pd.concat(columns, axis=1, keys=X.FEATURES))).reset_index(drop=True)

    return F.coalesce(run(*[(row or {}).get(c, F.col(c)) for c in X.FEATURES]), blend)
