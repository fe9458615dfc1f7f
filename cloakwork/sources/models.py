"""The model catalog as a table, and where models are kept."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, repo string, revision string, files array<struct<path:string,size:bigint,sha256:string>>"
#: The public models that a detector can load, with their files' sizes; the first is the default.
CATALOG = (
    ("openai/privacy-filter", "7ffa9a043d54d1be65afb281eddf0ffbe629385b", (("onnx/model_q4f16.onnx", 165744), ("onnx/model_q4f16.onnx_data", 809061992), ("tokenizer.json", 27868174), ("tokenizer_config.json", 234), ("config.json", 3039), ("viterbi_calibration.json", 372))),
    ("knowledgator/gliner-pii-small-v1.0", "d21aad5b4a7ec82b3d0970fd1ac74a12c087d85e", (("onnx/model.onnx", 326820148), ("tokenizer.json", 3583593), ("tokenizer_config.json", 21214), ("special_tokens_map.json", 694), ("gliner_config.json", 4316))),
)


def catalog_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, name, revision, [(p, n, "") for p, n in files]) for name, revision, files in CATALOG], SCHEMA)


def cache_root(env: Mapping[str, str] = os.environ) -> Path:
    """The named folder, else one in the user's cache folder."""
    if env.get("CLOAKWORK_CACHE_DIR"):
        return Path(env["CLOAKWORK_CACHE_DIR"])
    return Path(env.get("XDG_CACHE_HOME") or Path(env.get("HOME", "~")).expanduser() / ".cache") / "cloakwork"


def write_manifest(name: str, root: Path) -> Path:
    """Notes that the catalog's revision of a model is in its folder; whole or not at all."""
    revision = next(r for n, r, _ in CATALOG if n == name)
    folder = root / "models" / name
    folder.mkdir(parents=True, exist_ok=True)
    fresh = folder / "manifest.json.new"
    fresh.write_text(json.dumps({"revision": revision}))
    return fresh.replace(folder / "manifest.json")


def delete_model(name: str, root: Path) -> bool:
    """Removes a catalog model's folder; whether there was one."""
    if name not in {n for n, *_ in CATALOG}:
        raise KeyError(name)
    folder = root / "models" / name
    here = folder.exists()
    shutil.rmtree(folder, ignore_errors=True)
    return here


def list_models(spark: SparkSession, root: Path) -> DataFrame:
    """The catalog with each model's total size, and whether this machine has it."""
    here = spark.createDataFrame([(name, is_cached(name, root)) for name, *_ in CATALOG], "name string, cached boolean")
    sizes = catalog_table(spark).select("name", F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"]).alias("bytes"))
    return sizes.join(F.broadcast(here), "name")


def is_cached(name: str, root: Path) -> bool:
    """Whether a manifest of the catalog's revision is there and every file has its size."""
    revision, files = next((r, f) for n, r, f in CATALOG if n == name)
    folder = root / "models" / name
    try:
        if json.loads((folder / "manifest.json").read_text())["revision"] != revision:
            return False
        return all((folder / path).stat().st_size == size for path, size in files)
    except (OSError, ValueError, KeyError):
        return False
