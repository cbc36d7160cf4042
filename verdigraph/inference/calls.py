"""Model calls over a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.inference.engines import Engine
from verdigraph.inference.repair import parse_with_repair

ADDED = "response string, object string, error string, repairs int"


def ask(df: DataFrame, prompt: str, engine: Callable[[], Engine], model: str, repair_model: str, attempts: int) -> DataFrame:
    """``df`` with each prompt's response, its JSON object as text (null if there is none), the error and repairs.

    An engine is made once per task. A prompt is answered and repaired in one go, so a task tried again asks again;
    write the result before using it twice (``recorded``). As many prompts are under way as there are partitions.
    """
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(ADDED).fields])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for batch in batches:
            rows = []
            for text in batch[prompt]:
                said = own.generate(model, text, think=False).response
                found, error, repairs = parse_with_repair(said, own, repair_model, attempts)
                rows.append((said, None if found is None else json.dumps(found, ensure_ascii=False), error, repairs))
            yield batch.assign(**dict(zip(("response", "object", "error", "repairs"), zip(*rows)))) if rows else batch.reindex(columns=schema.names)

    return df.mapInPandas(run, schema)


def recorded(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to a folder and read again: calls are made once, and can be replayed."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def parsed(calls: DataFrame) -> DataFrame:
    """With the object as a variant, v."""
    return calls.withColumn("v", F.try_parse_json("object"))
