"""Fixture files: rows {model, pk, fields} as JSON, JSON lines or XML."""

from __future__ import annotations

import io
import json
import lzma
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "model string, pk string, fields string"
#: Control characters stand in JSON only escaped, so no file is ended by them.
NO_LINE = "\u0001\u0003\u0002\u0001"
FILE_ROWS = 10_000  # rows of a file that has to be read as a whole
XML_ROW = "_model string, _pk string, field array<struct<_VALUE:string,_name:string,_type:string,None:string>>"


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """(model, pk, fields as JSON text) of files that hold one array each.

    A file is read as one line: the multi-line reader goes back to the file for the
    text of every single pk and fields.
    """
    return spark.read.schema(ROW).json(path, lineSep=NO_LINE)


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; splittable, also gz and bz2."""
    return spark.read.schema(ROW).json(path)


def load_xml(spark: SparkSession, path: str) -> DataFrame:
    """<object model pk><field name>..</field></object>; <None/> is NULL."""
    raw = spark.read.format("xml").option("rowTag", "object").schema(XML_ROW).load(path)
    entry = lambda f: F.struct(f["_name"].alias("key"), F.when(f["None"].isNull(), f["_VALUE"]).alias("value"))
    fields = F.to_json(F.map_from_entries(F.transform("field", entry)), {"ignoreNullFields": "false"})
    return raw.select(F.col("_model").alias("model"), F.col("_pk").alias("pk"), fields.alias("fields"))


def load_packed(files: DataFrame) -> DataFrame:
    """Fixtures in zip, xz or lzma files given as (path, content)."""
    def rows_of(stream) -> Iterator[tuple]:
        text = io.TextIOWrapper(stream, encoding="utf-8")
        head = text.read(1)
        items = json.loads(head + text.read()) if head == "[" else (
            json.loads(line) for line in (head + text.readline(), *text) if line.strip())
        for o in items:
            yield o["model"], None if o.get("pk") is None else str(o["pk"]), json.dumps(o["fields"])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"]):
                if path.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        found = [r for m in z.namelist() for r in rows_of(z.open(m))]
                else:
                    found = list(rows_of(lzma.open(io.BytesIO(blob))))
                yield pd.DataFrame(found, columns=["model", "pk", "fields"])

    return files.select("path", "content").mapInPandas(unpack, ROW)


def model_rows(fixture: DataFrame, model: str, schema: str, pk: str, pk_type: str = "bigint") -> DataFrame:
    """Typed table of one model; unknown fields are ignored."""
    wanted = T.StructType.fromDDL(schema)
    texts = ", ".join(f"`{f.name}` string" for f in wanted)
    rows = fixture.where(F.col("model") == model).select(F.col("pk").cast(pk_type).alias(pk), F.from_json("fields", texts).alias("f"))

    def typed(field: T.StructField) -> Column:
        value = F.col(f"f.{field.name}")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        return (F.from_json(value, field.dataType) if nested else value.try_cast(field.dataType)).alias(field.name)

    return rows.select(pk, *[typed(f) for f in wanted])


def resolve_natural(rows: DataFrame, names: list[str], target: DataFrame, natural: list[str], pk: str, column: str) -> DataFrame:
    """Natural keys (``names``) replaced by the target's primary key in
    ``column``. All tables are read first, so forward references need no second
    pass; ``unresolved`` marks keys not found."""
    keys = target.select(*[F.col(n).alias(f"__{n}") for n in natural], F.col(pk).alias(column))
    cond = None
    for a, b in zip(names, natural):
        test = F.col(a) == F.col(f"__{b}")
        cond = test if cond is None else cond & test
    given = None
    for a in names:
        given = F.col(a).isNotNull() if given is None else given & F.col(a).isNotNull()
    out = rows.join(keys, cond, "left")
    return out.withColumn("unresolved", given & F.col(column).isNull()).drop(*names, *[f"__{n}" for n in natural])


def with_natural(rows: DataFrame, column: str, target: DataFrame, pk: str, natural: list[str]) -> DataFrame:
    """``column``, a foreign key, replaced by the list of the target's natural key, as a
    dump holds it. NULL stays; a key without a target row fails the job, since the dump
    could not be loaded again."""
    key = F.array(*[F.col(n).cast("string") for n in natural])
    keys = target.select(F.col(pk).alias("__pk"), key.alias("__key"))
    lost = F.raise_error(F.concat(F.lit(f"{column} points at no row: "), F.col(column).cast("string"))).cast("array<string>")
    value = F.when(F.col(column).isNotNull(), F.coalesce("__key", lost))
    return rows.join(keys, F.col(column) == F.col("__pk"), "left").select(*[value.alias(c) if c == column else F.col(c) for c in rows.columns])


def fixture_rows(df: DataFrame, model: str, pk: Column | None, fields: list[str]) -> DataFrame:
    """(model, pk, fields struct); ``pk`` None leaves it out (natural keys)."""
    cols = [F.lit(model).alias("model")]
    if pk is not None:
        cols.append(pk.alias("pk"))
    return df.select(*cols, F.struct(*fields).alias("fields"))


def with_links(df: DataFrame, key: str, pairs: DataFrame, owner: str, other: str, name: str) -> DataFrame:
    """Many-to-many keys of each row as a sorted list (a fixture holds them so)."""
    lists = pairs.groupBy(F.col(owner).alias(key)).agg(F.array_sort(F.collect_set(other)).alias(name))
    return df.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def dump_jsonl(rows: DataFrame, path: str, compression: str | None = None) -> None:
    rows.write.option("ignoreNullFields", "false").json(path, compression=compression)


def dump_json(rows: DataFrame, path: str) -> None:
    """One JSON array per part file, written row by row; about FILE_ROWS rows a file."""
    rows = rows.repartition(max(1, -(-rows.count() // FILE_ROWS)))
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))

    def bracket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for batch in batches:
            lines = []
            for v in batch["value"]:
                lines.append(lead + v)
                lead = ","
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    text.mapInPandas(bracket, "value string").write.text(path)


def dump_xml(rows: DataFrame, path: str) -> None:
    """<objects><object model pk><field name type>..</field></object></objects>."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["fields"].dataType.fields}
    fields = F.array(*[
        F.struct(F.col(f"fields.{n}").cast("string").alias("_VALUE"), F.lit(n).alias("_name"), F.lit(k).alias("_type"),
                 F.when(F.col(f"fields.{n}").isNull(), F.lit("")).alias("None"))
        for n, k in kinds.items()
    ])
    out = rows.select(F.col("model").alias("_model"), F.col("pk").cast("string").alias("_pk"), fields.alias("field"))
    out.write.format("xml").option("rowTag", "object").option("rootTag", "objects").save(path)


def table_load_order(spark: SparkSession, needs: list[tuple[str, str]], tables: list[str], allow_cycles: bool = False) -> DataFrame:
    """(name, level): tables after the ones they refer to by natural key.

    A cycle is an error, or with ``allow_cycles`` its tables come last.
    """
    from relweave.operators.graph import peel

    members = spark.createDataFrame([("load", t) for t in tables], "start string, name string")
    edges = spark.createDataFrame([("load", a, b) for a, b in needs], "start string, name string, needs string")
    levels = peel(members, edges)
    if not allow_cycles and not levels.where("level is null").isEmpty():
        raise ValueError("tables refer to each other in a cycle")
    top = levels.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
    return levels.select("name", F.coalesce("level", F.lit(top + 1)).alias("level"))
