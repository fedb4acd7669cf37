"""Catalog files: load, list, summarise."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.model import Catalog, SemanticError, catalog_from

CATALOG_DIR = Path(__file__).resolve().parent.parent / "catalogs"
#: Keys of the flat catalog layout that is no longer read.
LEGACY_KEYS = ("table", "table_name", "columns")


def load_catalog(dataset_id: str, directory: str | Path = CATALOG_DIR) -> Catalog:
    path = Path(directory) / f"{dataset_id}.json"
    if not path.is_file():
        raise SemanticError(f"no catalog for dataset {dataset_id}")
    data = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict) or "tables" not in data or any(k in data for k in LEGACY_KEYS):
        raise SemanticError(f"{path.name} has the old flat layout; tables, metrics and dimensions are needed")
    if data.get("dataset_id") != dataset_id:
        raise SemanticError(f"{path.name} is for dataset {data.get('dataset_id')}")
    return catalog_from(data)


def list_catalogs(directory: str | Path = CATALOG_DIR) -> list[str]:
    return sorted(p.stem for p in Path(directory).glob("*.json"))


def summarize(catalog: Catalog) -> dict:
    names = ("tables", "entities", "relationships", "metrics", "dimensions", "metric_versions", "aliases")
    return {"dataset_id": catalog.dataset_id, "catalog_version": catalog.catalog_version} | {
        f"n_{n}": len(getattr(catalog, n)) for n in names
    }


def dataset_overview(spark: SparkSession, directory: str | Path = CATALOG_DIR) -> DataFrame:
    """One row per catalog file: valid or not, counts, up to 4 metric and 6 dimension labels."""
    rows = []
    for name in list_catalogs(directory):
        try:
            c = load_catalog(name, directory)
            rows.append((name, True, None, len(c.metrics), len(c.dimensions), [m.label for m in c.metrics[:4]], [d.label for d in c.dimensions[:6]]))
        except (SemanticError, json.JSONDecodeError) as error:
            rows.append((name, False, str(error), 0, 0, [], []))
    return spark.createDataFrame(
        rows,
        "dataset_id string, valid boolean, error string, n_metrics int, n_dimensions int, sample_metrics array<string>, sample_dimensions array<string>",
    )
