"""Declarations for functions that pages call: documented types as declaration types, and a text for each project."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import facts as fs

def declared_type(doc: str | None) -> str:
    """The declaration type of a documented one: nothing, any and * are unknown; objects of any kind, lists and shapes are written as declarations do; other names stay."""
    t = (doc or "").strip()
    if t.lower() in ("", "any", "*"):
        return "unknown"
    if t.lower() == "object":
        return "object"
    if t.startswith("Array<") and t.endswith(">") and len(t) > len("Array<>"):
        return declared_type(t[len("Array<") : -1]) + "[]"
    if t.startswith("{") and t.endswith("}"):
        return "{ " + "; ".join(f.strip() for f in t[1:-1].strip().split(",")) + " }"
    return t


def exposed(store: DataFrame) -> DataFrame:
    """Public functions that pages call, with parameters and documented types."""
    at = ["project", "owner"]
    called = fs.exposures(store).where("type = 'client_call'").select("project", F.col("symbol").alias("owner")).distinct()
    types = fs.view(store, "doc_param").groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("param", "type"))).alias("_types"))
    f = fs.functions(store)[0].where("visibility = 'public'").join(called, at, "left_semi").join(types, at, "left").join(fs.view(store, "doc").select(*at, "returns_type"), at, "left")
    return f.select("project", F.col("owner").alias("symbol"), "params", F.transform("params", lambda p: F.try_element_at("_types", p)).alias("types"), "returns_type")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        text = []
        for symbol, params, types, returns in zip(b["symbol"], b["params"], b["types"], b["returns_type"]):
            said = ", ".join(f"{p}: {declared_type(t)}" for p, t in zip(params, types))
            text.append(f"{symbol}({said}): Promise<{declared_type(returns)}>;")
        yield pd.DataFrame({"project": b["project"], "symbol": b["symbol"], "line": text})


def declarations(store: DataFrame) -> DataFrame:
    """(project, symbol, line): a declaration for each function that pages call."""
    return exposed(store).mapInPandas(_lines, "project string, symbol string, line string")


def declaration_files(store: DataFrame) -> DataFrame:
    """(project, text): the declarations of a project in order of their names."""
    rows = declarations(store).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("symbol", "line"))).alias("l"))
    return rows.select("project", F.concat(F.lit("interface Server {\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("  "), x["line"], F.lit("\n"))), ""), F.lit("}\n")).alias("text"))


def contract_tests(store: DataFrame) -> DataFrame:
    """(project, symbol, field): what a test of the contract asks for: each field that handlers read of a function's value."""
    return fs.field_reads(store).select("project", "symbol", "field").distinct()
