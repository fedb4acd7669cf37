"""Results out of the engine: JSON records, CSV, events, chart choice, table replacement."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(df: DataFrame) -> DataFrame:
    """One column ``record``: each row as a JSON object, nulls kept, dates in ISO form."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_events(events: DataFrame, path: str) -> None:
    """Append to JSON lines, one folder per day of ``timestamp``."""
    events.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def should_chart(df: DataFrame) -> bool:
    """More than one row and a numeric column."""
    return bool(numeric_columns(df)) and df.limit(2).count() > 1


def chart_choice(df: DataFrame) -> dict:
    """A chart's kind and columns from the result's shape."""
    numeric = numeric_columns(df)
    other = [c for c in df.columns if c not in numeric]
    if len(numeric) >= 2:
        return {"kind": "scatter", "x": numeric[0], "y": numeric[1]}
    if len(numeric) == 1 and other:
        return {"kind": "bar", "x": other[0], "y": numeric[0]}
    if other and df.select(F.countDistinct(other[0])).first()[0] < 10:
        return {"kind": "pie", "names": other[0]}
    return {"kind": "line"}


def replace_rows(new: DataFrame, path: str, key: str, partitioned: bool = True) -> None:
    """Replace all rows of the key values in ``new`` (whole-dataset replacement) in a table partitioned by ``key``."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with other keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def delete_rows(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_draft_catalog(catalog: dict, directory: str) -> str:
    """Pretty JSON into a folder of drafts, apart from the catalogs in use."""
    path = Path(directory) / f"{catalog['dataset_id']}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(catalog, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return str(path)


def new_id() -> str:
    return str(uuid.uuid4())
