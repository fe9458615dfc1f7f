"""The engine's functions for ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloakwork.kernels import text
from cloakwork.operators.redaction import PAIRS, EngineConf, find_spans


def register(spark: SparkSession, conf: EngineConf) -> None:
    """Registers cloak_placeholder(class, value), cloak_redact(text), cloak_restore(text, mapping) and the table function cloak_spans(text)."""

    @F.pandas_udf("string")
    def cloak_placeholder(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or v is None else text.placeholder(k, v, conf.nonce, conf.hex_digits) for k, v in zip(kinds, values)])

    @F.pandas_udf(f"struct<text:string,mapping:{PAIRS}>")
    def cloak_redact(said: pd.Series) -> pd.DataFrame:
        out = [(None, []) if t is None else text.redact(t, find_spans(t, conf, conf.nested), conf.nonce, conf.guard, conf.hex_digits) for t in said]
        return pd.DataFrame({"text": [o[0] for o in out], "mapping": [[{"from": a, "to": b} for a, b in o[1]] for o in out]})

    @F.pandas_udf("string")
    def cloak_restore(said: pd.Series, mapping: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else text.restore(t, [(p["from"], p["to"]) for p in m], conf.guard) for t, m in zip(said, mapping)])

    @F.udtf(returnType="start int, end int, class string, score float")
    class CloakSpans:
        def eval(self, said: str):  # noqa: ANN202
            yield from find_spans(said, conf) if said is not None else ()

    for function in (cloak_placeholder, cloak_redact, cloak_restore):
        spark.udf.register(function.__name__, function)
    spark.udtf.register("cloak_spans", CloakSpans)
