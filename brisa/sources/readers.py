"""Reading files, tables and nested records as DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brisa.functions.text import to_date_time, to_number


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One file or every `*.parquet` of a folder; leftovers of broken writes are skipped."""
    try:
        return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no parquet under {path}") from error


FORMATS = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "jsonl": "json",
           "parquet": "parquet", "xml": "xml", "orc": "orc"}


def read_any(spark: SparkSession, path: str, kind: str | None = None, *, schema: T.StructType | str | None = None,
             separator: str = ",", encoding: str = "UTF-8", header: bool = True, row_tag: str = "row",
             multi_line: bool = False, brazilian_numbers: Sequence[str] = (), dates: Sequence[str] = (),
             day_first: bool = True) -> DataFrame:
    """Read by format. Separator and encoding are explicit, columns with Brazilian
    decimals and dates are named; without a schema delimited text stays text."""
    kind = FORMATS[(kind or path.rstrip("/").rsplit(".", 1)[-1]).lower()]
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        df = reader.options(header=header, sep=separator, encoding=encoding, multiLine=multi_line).csv(path)
    elif kind == "json":
        df = reader.options(multiLine=multi_line, encoding=encoding).json(path)
    elif kind == "xml":
        df = reader.format("xml").options(rowTag=row_tag, charset=encoding).load(path)
    else:
        df = reader.format(kind).load(path)
    changes = {c: to_number(F.col(c)) for c in brazilian_numbers}
    changes |= {c: to_date_time(F.col(c), day_first=day_first) for c in dates}
    return df.withColumns(changes) if changes else df


def matched_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files of a glob, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(where) or []
    return sorted(s.getPath().toString() for s in found if s.isFile())


def _header(spark: SparkSession, file: str, options: Mapping[str, str]) -> tuple[str, ...] | None:
    """Column names in the first line of a delimited file; null if it has none."""
    try:
        names = spark.read.options(**{**options, "header": "true", "inferSchema": "false"}).csv(file).columns
    except (AnalysisException, PySparkException):
        return None
    return tuple(names) or None


def read_many(spark: SparkSession, path: str, kind: str, *, origin: str | None = "arquivo_origem",
              skip_bad: bool = False, **options) -> DataFrame:
    """Every file of a glob, united by column name, with the file of each row.

    Delimited files are read in one go for each distinct header, each under its own names, and then
    united; columns that a file lacks are null there. A file that cannot be read is an error, or
    with `skip_bad` is left out and named in a warning."""
    kind = FORMATS[kind]
    if kind == "csv":
        groups: dict[tuple[str, ...] | None, list[str]] = {}
        for file in matched_files(spark, path):
            groups.setdefault(_header(spark, file, options), []).append(file)
        _report_bad(groups.pop(None, []), skip_bad)
        if not groups:
            raise FileNotFoundError(f"no readable file under {path}")
        reader = spark.read.options(**{**options, "header": "true", "enforceSchema": "false"})
        frames = [reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(files) for names, files in groups.items()]
    elif skip_bad:
        good, bad = [], []
        for file in matched_files(spark, path):
            try:
                spark.read.options(**options).format(kind).load(file)
                good.append(file)
            except (AnalysisException, PySparkException):
                bad.append(file)
        _report_bad(bad, True)
        if not good:
            raise FileNotFoundError(f"no readable file under {path}")
        frames = [spark.read.options(**{"mergeSchema": "true", **options}).format(kind).load(good)]
    else:
        frames = [spark.read.options(**{"mergeSchema": "true", **options}).format(kind).load(path)]
    if origin:
        frames = [f.select("*", F.col("_metadata.file_name").alias(origin)) for f in frames]
    return unite(frames)


def _report_bad(files: Sequence[str], skip: bool) -> None:
    if files and not skip:
        raise ValueError(f"unreadable files: {', '.join(files)}")
    if files:
        warnings.warn(f"left out, unreadable: {', '.join(files)}", stacklevel=3)


#: Columns of `with_position`.
POSITION = ("__arquivo", "__bloco", "__linha")


def with_position(df: DataFrame) -> DataFrame:
    """`df` with the place of each row: file, block of the file and a number that rises inside a
    block. Taken straight from a file source this is the order of the files by name and of the rows
    in each; rows that come from elsewhere keep the order they are in now."""
    try:
        file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        placed = df.select("*", file.alias(POSITION[0]), block.alias(POSITION[1]))
    except AnalysisException:
        placed = df.withColumns({POSITION[0]: F.lit(""), POSITION[1]: F.lit(0).cast("long")})
    return placed.withColumn(POSITION[2], F.monotonically_increasing_id())


def unite(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column absent in one frame is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_query(spark: SparkSession, sql: str, *, dates: Sequence[str] = (), url: str | None = None,
               properties: Mapping[str, str] | None = None, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 32) -> DataFrame:
    """Result of a SQL query: on the session, or over JDBC in ranges of a column."""
    if url is None:
        df = spark.sql(sql)
    else:
        options = {"url": url, "dbtable": f"({sql}) q", **(properties or {})}
        if partition_column and bounds:
            options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                        "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
        df = spark.read.format("jdbc").options(**options).load()
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates}) if dates else df


def flatten(df: DataFrame, path: str | None = None, separator: str = "_") -> DataFrame:
    """Records under a dotted path, one row each, nested fields as flat columns."""
    if path:
        kind = df.select(F.col(path).alias("r")).schema["r"].dataType
        picked = df.select(F.explode(path).alias("r") if isinstance(kind, T.ArrayType) else F.col(path).alias("r"))
        df = picked.select("r.*") if isinstance(picked.schema["r"].dataType, T.StructType) else picked
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{separator}{g.name}")
                            for g in f.dataType.fields]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


def parse_records(df: DataFrame, column: str, schema: T.DataType | str, path: str | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """JSON text to rows: parse with a given schema, go down the path, flatten."""
    parsed = df.select(*keep, F.from_json(column, schema).alias("j"))
    place = f"j.{path}" if path else "j"
    kind = parsed.select(F.col(place).alias("x")).schema["x"].dataType
    rows = parsed.select(*keep, (F.explode(place) if isinstance(kind, T.ArrayType) else F.col(place)).alias("r"))
    flat = rows.select(*keep, "r.*") if isinstance(rows.schema["r"].dataType, T.StructType) else rows
    return flatten(flat)


def parameter_maps(df: DataFrame, column: str, parameters: Sequence[str], time: str,
                   keep: Sequence[str] = ()) -> DataFrame:
    """JSON `{parameter: {time: value}}` to one row per time and site, one column
    per named parameter."""
    maps = df.select(*keep, F.from_json(column, "map<string,map<string,double>>").alias("m"))
    cells = (maps.select(*keep, F.explode("m").alias("parametro", "serie"))
             .select(*keep, "parametro", F.explode("serie").alias(time, "valor")))
    return (cells.groupBy(*keep, time).pivot("parametro", list(parameters)).agg(F.first("valor"))
            if parameters else cells)


def require_inputs(spark: SparkSession, inputs: Mapping[str, str], step: str) -> None:
    """Stop before any plan, naming every missing input and the step that makes it."""
    missing = [name for name, path in inputs.items() if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"missing inputs {sorted(missing)}; run {step} first")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
