"""Readers of measurement files: XML traces with references, text reports, JSON evidence; CSV sink."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = "file string, schema string, row int, column string, tag string, raw string, shown string"


def xml_trace(spark: SparkSession, path: str) -> DataFrame:
    """Cells of trace exports. A cell may give its value under an id or refer to one seen in the file; a
    reference to nothing or to itself is an error. One file is read by one task."""

    def parse(batches):
        import pandas as pd

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                yield pd.DataFrame(list(_cells(name, ET.fromstring(bytes(content)))), columns=[c.split()[0] for c in CELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS)


def _cells(name: str, root: ET.Element):
    known = {e.get("id"): e for e in root.iter() if e.get("id")}

    def value(e: ET.Element) -> ET.Element:
        met = set()
        while e.get("ref"):
            if e.get("ref") in met:
                raise ValueError(f"{name}: reference cycle at {e.get('ref')}")
            met.add(e.get("ref"))
            if e.get("ref") not in known:
                raise ValueError(f"{name}: unknown reference {e.get('ref')}")
            e = known[e.get("ref")]
        return e

    for node in root.iter("node"):
        schema = node.find("schema")
        columns = [c.findtext("mnemonic") for c in schema.findall("col")]
        for k, row in enumerate(node.findall("row")):
            for column, cell in zip(columns, row, strict=False):
                v = value(cell)
                yield name, schema.get("name"), k, column, v.tag, v.text, v.get("fmt")


def resolve(cells: DataFrame, key: str, ident: str, ref: str, value: str) -> DataFrame:
    """The relational form: rows with the value of the row that `ref` names in the same key."""
    named = cells.where(F.col(ident).isNotNull()).select(F.col(key).alias("__k"), F.col(ident).alias("__i"), F.col(value).alias("__v"))
    joined = cells.join(named, (F.col(key) == F.col("__k")) & (F.col(ref) == F.col("__i")), "left")
    bad = F.col(ref).isNotNull() & F.col("__i").isNull()
    return joined.where(F.assert_true(~bad, F.lit("unknown reference")).isNull()).withColumn(value, F.coalesce("__v", value)).drop("__k", "__i", "__v")


def runner_timing(lines: DataFrame, text: str) -> DataFrame:
    """Frames, seconds and rate from a runner's last line."""
    pattern = r"Output (\d+) frames in ([0-9.]+) seconds \(([0-9.]+) fps\)"
    part = lambda k, t: F.regexp_extract(text, pattern, k).cast(t)
    return lines.where(F.col(text).rlike(pattern)).select(part(1, "long").alias("frames"), part(2, "double").alias("seconds"), part(3, "double").alias("fps"))


def filter_times(lines: DataFrame, text: str) -> DataFrame:
    """name, mode, percent, seconds from a table of filter times; the name may hold blanks."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    at = lambda k: F.element_at(parts, k)
    named = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), " ")
    return lines.where(F.size(parts) >= 4).where(at(-1).rlike(r"^[0-9.]+$") & at(-2).rlike(r"^[0-9.]+$")).select(named.alias("name"), at(-3).alias("mode"), at(-2).cast("double").alias("percent"), at(-1).cast("double").alias("seconds"))


def evidence(spark: SparkSession, path: str, schema: T.StructType | str, version: str) -> DataFrame:
    """Whole-document JSON whose schema field must say the version."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.where(F.assert_true(F.col("schema") == version, F.lit("unexpected evidence schema")).isNull())


def flat(rows: DataFrame) -> DataFrame:
    """Nested structs as columns parent_child, for CSV."""
    out, todo = [], [(F.col(f"`{f.name}`"), f.name, f.dataType) for f in rows.schema.fields]
    while todo:
        column, name, kind = todo.pop(0)
        if isinstance(kind, T.StructType):
            todo = [(column[f.name], f"{name}_{f.name}", f.dataType) for f in kind.fields] + todo
        else:
            out.append(column.alias(name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.csv(path, header=True)


def tree_digest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One SHA-256 over, by the paths' parts, each path's length (8 bytes, little-endian), the path and its
    content's digest in bytes. Only paths and digests are gathered."""
    p = F.encode(F.col(path), "utf-8")
    size = F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.octet_length(p)), 16, "0"), F.lit("(..)"), 1)), "")
    each = files.select(F.struct(F.split(F.col(path), "/").alias("parts"), F.concat(size, F.hex(p), F.sha2(F.col(content), 256)).alias("part")).alias("x"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]), "")
    return each.agg(F.sha2(F.unhex(whole), 256).alias("digest"))
