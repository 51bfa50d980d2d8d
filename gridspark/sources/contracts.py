"""Data contracts: YAML (or a dict) to Spark schemas."""

from __future__ import annotations

import pathlib

from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


class ContractError(ValueError):
    pass


def load(path: str) -> dict:
    import yaml

    return checked(yaml.safe_load(pathlib.Path(path).read_text(encoding="utf-8")))


def checked(contract: dict) -> dict:
    """The contract, or ContractError: it needs dataset, schema_version, format, primary_key and typed fields without repeats."""
    for name in ("dataset", "schema_version", "format", "primary_key", "fields"):
        if not contract.get(name):
            raise ContractError(f"{name} is missing")
    names = [f["name"] for f in contract["fields"]]
    if len(set(names)) != len(names):
        raise ContractError("a field occurs twice")
    if unknown := {f["type"] for f in contract["fields"]} - set(TYPES):
        raise ContractError(f"unknown types {sorted(unknown)}")
    key = contract["primary_key"]
    contract["primary_key"] = [key] if isinstance(key, str) else list(key)
    if missing := set(contract["primary_key"]) - set(names):
        raise ContractError(f"key fields {sorted(missing)} aren't fields")
    return contract


def schema(contract: dict) -> T.StructType:
    return T.StructType([T.StructField(f["name"], TYPES[f["type"]], True) for f in contract["fields"]])


def fields(contract: dict) -> list[str]:
    return [f["name"] for f in contract["fields"]]
