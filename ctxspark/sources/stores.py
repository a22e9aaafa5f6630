"""Keyed tables that are written and read again: versions of Parquet behind a pointer, so a reader sees one whole version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import upsert


class TableStore:
    """Rows by key, one folder a version; a write makes a new version and moves the pointer to it last.

    Used alike for items, vectors, documents and memory entries: what differs is the schema and the key. With vaults, the
    vault is part of the key and every call names its own; rows of other vaults are never read or touched.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, keys: list[str], vault: str | None = None):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if vault is not None:
            from ..operators.predicates import validate_vault

            self.folder += "/vault=" + validate_vault(vault)

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def version(self) -> str | None:
        fs, p = self._fs(f"{self.folder}/CURRENT")
        return self.spark.read.text(f"{self.folder}/CURRENT").first()[0] if fs.exists(p) else None

    def rows(self) -> DataFrame:
        """All rows, in the store's schema; columns that an older version lacks are null."""
        now = self.version()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return migrate(self.spark.read.parquet(f"{self.folder}/{now}"), self.schema)

    def _write(self, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        replace_text(self.spark, f"{self.folder}/CURRENT", name)

    def put(self, rows: DataFrame) -> None:
        """Adds rows; those of a key that is there replace it. Of rows of one key in `rows` any one stays."""
        self._write(upsert(self.rows(), migrate(rows, self.schema).dropDuplicates(self.keys), self.keys))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.rows().join(keys.select(self.keys).distinct(), self.keys, "left_semi")

    def delete(self, keys: DataFrame) -> None:
        """Keys that aren't there are no error."""
        self._write(self.rows().join(keys.select(self.keys).distinct(), self.keys, "left_anti"))

    def clear(self) -> None:
        self._write(self.rows().limit(0))

    def vacuum(self) -> int:
        """Deletes the versions that the pointer left behind; how many."""
        now, n = self.version(), 0
        fs, p = self._fs(self.folder)
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().getName()
            if name.startswith("v-") and name != now:
                fs.delete(status.getPath(), True)
                n += 1
        return n


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed into it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    target, beside = path_of(path), path_of(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} could not be replaced")


def migrate(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df in another schema: columns cast, missing ones null, others dropped."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields))


def read_golden(spark: SparkSession, path: str, schema: str, kinds: dict[str, str] | None = None, kind_field: str = "type") -> DataFrame:
    """One JSON object a line in `schema`; with `kinds`, a column `value` for each kind's own schema instead, null where a
    line is of another kind. A line that is no object, or of no known kind, fails with its file and text."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    if kinds is None:
        parsed = lines.select("file", "line", F.from_json("line", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("v"))
        bad = F.col("v").isNull() | F.col("v._bad").isNotNull()
        names = T.StructType.fromDDL(schema).fieldNames()
        checked = parsed.withColumn("ok", F.when(bad, F.raise_error(F.concat(F.lit("bad line in "), "file", F.lit(": "), "line"))).otherwise(F.lit(True)))
        return checked.where("ok").select(*(F.col(f"v.{n}").alias(n) for n in names))
    kind = F.get_json_object("line", f"$.{kind_field}")
    fail = F.raise_error(F.concat(F.lit("line of no known kind in "), "file", F.lit(": "), "line"))
    checked = lines.withColumn("kind", F.when(F.coalesce(kind.isin(list(kinds)), F.lit(False)), kind).otherwise(fail))
    return checked.select("kind", *(F.when(F.col("kind") == k, F.from_json("line", s)).alias(k) for k, s in kinds.items()))


def like_pattern(text: str) -> str:
    """A LIKE pattern that holds for exactly the texts that contain `text`: %, _ and the escape sign stand for themselves."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def spans_json(spans: DataFrame) -> DataFrame:
    """(trace_id, line) of spans(trace_id, span_id, parent_id, name, start, end): OTLP/JSON spans, times in nanoseconds as
    text. Write with .text(); the console sink is show()."""
    nanos = lambda c: (F.unix_micros(c) * 1000).cast("string")
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), "name", nanos("start").alias("startTimeUnixNano"), nanos("end").alias("endTimeUnixNano"))
    return spans.select("trace_id", F.to_json(span).alias("line"))


def save_json(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A bounded list as one JSON file, replaced as a whole."""
    replace_text(spark, path, json.dumps(rows, ensure_ascii=False, sort_keys=True))
