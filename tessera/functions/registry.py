"""The scalar functions under SQL names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.container import encode
from ..sources.jsonio import dumps, loads
from ..sources.text import parse, write_value
from .canonical import float_text, value_hash, value_text
from .model import StateError, at_path


def _safe(f):
    def run(x):
        try:
            return None if x is None else f(x)
        except StateError:
            return None

    return run


def register(spark: SparkSession, prefix: str = "state_") -> None:
    """Null where the argument is null or cannot be read."""
    texts = {"parse_text": lambda x: dumps(parse(x)), "format_text": lambda x: write_value(loads(x)), "canonical": lambda x: value_text(loads(x)), "logical_hash": lambda x: value_hash(loads(x))}
    for name, f in texts.items():
        spark.udf.register(prefix + name, _series(_safe(f), "string"))
    spark.udf.register(prefix + "encode", _series(_safe(lambda x: encode(loads(x))), "binary"))
    spark.udf.register(prefix + "float_text", float_text)

    @F.pandas_udf("string")
    def field(docs: pd.Series, paths: pd.Series) -> pd.Series:
        def one(d, p):
            there, v = at_path(loads(d), p) if d is not None else (False, None)
            return json.dumps(v) if there and not isinstance(v, tuple) else dumps(v) if there else None

        return pd.Series([one(d, p) for d, p in zip(docs, paths, strict=True)], dtype=object)

    spark.udf.register(prefix + "field", field)


def _series(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in s], dtype=object)

    return run
