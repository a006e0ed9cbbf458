"""Files by suffix, in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _format(path: str, fmt: str | None) -> str:
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in ("csv", "tsv", "json", "jsonl", "parquet"):
        raise ValueError(f"no reader or writer for {fmt!r}: convert it first")
    return fmt


def load(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A table from csv, tsv, json, jsonl or parquet, by fmt or suffix. Without a schema, types of text formats are inferred."""
    fmt = _format(path, fmt)
    read = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        return read.options(**_QUOTED, sep="\t" if fmt == "tsv" else ",", inferSchema=str(schema is None).lower()).csv(path)
    if fmt == "parquet":
        return read.parquet(path)
    return read.json(path, multiLine=fmt == "json")


def dump(df: DataFrame, path: str, fmt: str | None = None, per_file: int | None = None) -> None:
    """df as a folder of csv, tsv (all values quoted), jsonl or parquet files, of per_file rows at most each."""
    fmt = _format(path, fmt)
    write = df.write.option("maxRecordsPerFile", per_file) if per_file else df.write
    if fmt in ("csv", "tsv"):
        write.options(header="true", quoteAll="true", escape='"', sep="\t" if fmt == "tsv" else ",").csv(path)
    elif fmt == "parquet":
        write.parquet(path)
    else:
        write.option("ignoreNullFields", "false").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the rows that parse, and file and text of the lines that don't. Blank lines are neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.filter(~broken).select("row.*").drop("_bad"), parsed.filter(broken).select("file", "value")


def from_json_table(spark: SparkSession, path: str, key: str = "key", value: str = "string") -> DataFrame:
    """A JSON file that holds one object of many, a row per entry: its key and its fields (value: a DDL type)."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "_v"))
    return whole.select(key, "_v.*") if value.startswith("struct") else whole.withColumnRenamed("_v", "value")


def dataset(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """`path@split`: a folder's files of that split (in their names, or a folder of that name), read as what the first of
    them is by its suffix."""
    path, _, split = name.partition("@")
    files = listing(spark, path).filter(F.col("path").rlike("[.](parquet|jsonl?|csv|tsv)$"))
    if split:
        files = files.filter(F.lower("path").rlike(f"(^|[/._-]){split.lower()}([/._-]|$)"))
    found = sorted(r.path for r in files.select("path").toLocalIterator())
    if not found:
        raise ValueError(f"no files for {name!r}")
    fmt = found[0].rsplit(".", 1)[-1].lower()
    found = [f for f in found if f.lower().endswith(f".{fmt}")]
    read = spark.read.schema(schema) if schema else spark.read
    if fmt == "parquet":
        return read.parquet(*found)
    if fmt in ("csv", "tsv"):
        return read.options(**_QUOTED, sep="\t" if fmt == "tsv" else ",", inferSchema=str(schema is None).lower()).csv(found)
    return read.json(found, multiLine=fmt == "json")


def listing(spark: SparkSession, folder: str, match: Sequence[str] = (), mode: str = "all", level: int | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder whose paths hold all (or any) of the strings, `!x` standing for
    paths without x; level: files so many folders down. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    tests = [~F.col("path").contains(m[1:]) if m.startswith("!") else F.col("path").contains(m) for m in match]
    if tests:
        keep = F.lit(mode == "all")
        for t in tests:
            keep = (keep & t) if mode == "all" else (keep | t)
        files = files.filter(keep)
    if level is not None:
        root = folder.split(":", 1)[-1].rstrip("/")
        below = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), root + "/", -1)
        files = files.filter(F.size(F.split(below, "/")) == level)
    return files


def checked(spark: SparkSession, path: str, md5: str) -> DataFrame:
    """(path, md5, ok): whether files are what they should be."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5")).withColumn("ok", F.col("md5") == md5)


def samples(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON files, one sample each, with the file's name without its suffix; files that don't parse are left out."""
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("name"), "value")
    parsed = text.select("name", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return parsed.filter(F.col("row").isNotNull() & F.col("row._bad").isNull()).select("name", "row.*").drop("_bad")


def record(records: DataFrame, key: str, value, schema: str, payload: str = "value") -> DataFrame:
    """The record of a key, parsed; a record that doesn't parse is null."""
    return records.filter(F.col(key) == value).select(key, F.from_json(payload, schema, {"mode": "PERMISSIVE"}).alias("record"))


def mapped(parts: Sequence[tuple[DataFrame, dict[str, Column | str]]], columns: Sequence[str], index: str = "index") -> DataFrame:
    """Many tables as one of the given columns: each comes with its own expressions (a Column, or a constant text), what it
    lacks is null; rows are numbered from 0 in the order of tables and of their own first column."""
    from ..operators.arrange import numbered

    u = None
    for k, (df, made) in enumerate(parts):
        expr = lambda c, df=df, made=made: (made[c] if isinstance(made[c], Column) else F.lit(made[c])) if c in made else F.col(c) if c in df.columns else F.lit(None)
        x = df.select(F.lit(k).alias("_part"), *(expr(c).cast("string").alias(c) for c in columns))
        u = x if u is None else u.unionByName(x)
    return numbered(u, ["_part", *columns], index).drop("_part")


def pairs(spark: SparkSession, folder: str, left: str = "json", right: str = "jpg", first: int | None = None) -> DataFrame:
    """(stem, left, right): files of one folder and its sub-folders that differ in their suffix alone; the first few by name."""
    files = listing(spark, folder).select(F.regexp_extract("path", r"^(.*)\.([^.]*)$", 1).alias("stem"), F.regexp_extract("path", r"^(.*)\.([^.]*)$", 2).alias("suffix"), "path")
    side = lambda s, n: files.filter(F.col("suffix") == s).select("stem", F.col("path").alias(n))
    out = side(left, "left").join(side(right, "right"), "stem")
    return out if first is None else out.orderBy("stem").limit(first)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files in UTF-8, or, where they aren't, in the Windows code page 1252: Latin-1, whose control characters
    from 0x80 on are letters and marks there."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    marks = {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
    marks = {chr(b): x for b, x in marks.items() if x != "\ufffd"}
    page = F.translate(F.decode("content", "ISO-8859-1"), "".join(marks), "".join(marks.values()))
    return raw.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(page).alias("text"))


class FrameCache:
    """The last frames that were read, at most so many: the oldest goes first."""

    def __init__(self, read, most: int = 256):
        self.read, self.most, self.held = read, most, {}

    def __call__(self, key):
        if key not in self.held:
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            self.held[key] = self.read(key)
        return self.held[key]
