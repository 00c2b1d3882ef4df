"""Loading the base tables from CSV or Parquet, and saving derived tables between stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.sources.schemas import CONTRACTS, TableContract

Tables = Mapping[str, DataFrame]


class LoadedTables(dict[str, DataFrame]):
    """Tables by name, and for those that came from text files the rows that were rejected."""

    def __init__(self, tables: Mapping[str, DataFrame], rejects: Mapping[str, DataFrame]):
        super().__init__(tables)
        self.rejects = dict(rejects)


def rejects_of(tables: Tables) -> dict[str, DataFrame]:
    """Rejected rows by table; nothing for tables that are not read from text."""
    found = getattr(tables, "rejects", {})
    return {name: df for name, df in found.items() if name in tables}


#: Column of a CSV row's whole text where the row does not fit the header.
CORRUPT = "_corrupt_row"
#: Metadata key of a column that the source lacks and ``conform`` filled with NULL.
ABSENT = "absent"
#: Partition column of staged CSV tables.
_REJECTED = "rejected"


def conform(df: DataFrame, contract: TableContract) -> DataFrame:
    """Contract columns by name, in contract order and type; absent columns become NULL.

    An absent column is marked in its metadata, so that checks can tell it from a column of NULLs.
    """
    present = set(df.columns)
    return df.select(
        *[
            F.col(name).cast(kind).alias(name)
            if name in present
            else F.lit(None).cast(kind).alias(name, metadata={ABSENT: True})
            for name, kind in contract.columns
        ]
    )


def absent_columns(df: DataFrame, contract: TableContract) -> list[str]:
    """Contract columns that the source of ``df`` lacks."""
    fields = {field.name: field for field in df.schema.fields}
    return [
        name
        for name, _ in contract.columns
        if name not in fields or fields[name].metadata.get(ABSENT)
    ]


def csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file's cells as text, by the names in its header, and ``CORRUPT``.

    A byte-order mark is dropped. Line breaks inside quotes are kept; reading them makes a file one
    task, so large exports should come as many files, or be read with ``multi_line=False``.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    names = reader.option("enforceSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(n.lstrip("\ufeff"), T.StringType()) for n in names])
    schema = schema.add(CORRUPT, T.StringType())
    return (
        reader.schema(schema)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def _bad_cells(text: DataFrame, contract: TableContract) -> list[Column]:
    """The name of each contract column whose cell has text that its type cannot hold, else NULL."""
    return [
        F.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(name))
        for name, kind in contract.columns
        if name in text.columns
    ]


def judged_csv_table(
    spark: SparkSession, path: str, contract: TableContract, multi_line: bool = True
) -> DataFrame:
    """A CSV file's cells as text with ``CORRUPT`` and ``bad_columns``, the columns that do not fit."""
    text = csv_text(spark, path, multi_line)
    bad = F.array_compact(F.array(*_bad_cells(text, contract)).cast("array<string>"))
    return text.withColumn("bad_columns", bad)


def _accepted() -> Column:
    return F.col(CORRUPT).isNull() & (F.size("bad_columns") == 0)


def split_csv_table(
    spark: SparkSession, path: str, contract: TableContract, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows of the contract, and rejects: cells as text, ``bad_columns`` and ``CORRUPT``.

    A row is rejected if it does not fit the header or a cell does not fit its column's type. Each of
    the two reads the file; ``stage_csv_table`` reads it once.
    """
    judged = judged_csv_table(spark, path, contract, multi_line)
    return conform(judged.where(_accepted()), contract), judged.where(~_accepted())


def stage_csv_table(
    spark: SparkSession, path: str, contract: TableContract, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``split_csv_table`` from one pass over the file, through the shared checkpoint folder.

    Good rows with their types, and rejects with their cells as text, are two partitions of one written
    table: what reads the good rows afterwards prunes columns and does not parse text again.
    """
    judged = judged_csv_table(spark, path, contract, multi_line)
    rejected = ~_accepted()
    cells = [name for name in judged.columns if name != "bad_columns"]
    kinds = dict(contract.columns)
    written = write_between_stages(
        judged.select(
            rejected.alias(_REJECTED),
            F.struct(
                *[
                    F.when(~rejected, F.col(n).try_cast(kinds[n])).alias(n)
                    for n in kinds
                    if n in judged.columns
                ]
            ).alias("good"),
            F.when(rejected, F.struct(*cells, "bad_columns")).alias("reject"),
        ),
        contract.name,
        partition_by=[_REJECTED],
    )
    present = written.where(~F.col(_REJECTED)).select("good.*")
    return conform(present, contract), written.where(_REJECTED).select("reject.*")


def read_csv_table(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    """The good rows of a CSV file, columns by name; ``split_csv_table`` also gives the others."""
    return split_csv_table(spark, path, contract)[0]


def read_parquet_table(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    return conform(spark.read.parquet(path), contract)


#: By format: the rows of a table, and those that were rejected where the format allows for some.
_READERS: dict[str, Callable[..., tuple[DataFrame, DataFrame | None]]] = {
    "csv": split_csv_table,
    "csv-staged": stage_csv_table,
    "parquet": lambda spark, path, contract: (read_parquet_table(spark, path, contract), None),
}


def read_tables(
    spark: SparkSession,
    folder: str,
    file_format: str = "parquet",
    suffix: str = "",
    names: Iterable[str] = tuple(CONTRACTS),
) -> LoadedTables:
    """``{folder}/{name}{suffix}.{file_format}`` for each table; a missing file is an error.

    Formats are ``parquet``, ``csv``, and ``csv-staged``, which parses each CSV file once into the shared
    checkpoint folder. Rows of CSV files that do not fit are in ``rejects`` of the result, and a failure in
    the quality report.
    """
    read, ending = _READERS[file_format], file_format.removesuffix("-staged")
    both = {name: read(spark, f"{folder}/{name}{suffix}.{ending}", CONTRACTS[name]) for name in names}
    return LoadedTables(
        {name: rows for name, (rows, _) in both.items()},
        {name: rejects for name, (_, rejects) in both.items() if rejects is not None},
    )


def read_available_tables(
    spark: SparkSession, folder: str, file_format: str = "csv", suffix: str = ""
) -> LoadedTables:
    """Like ``read_tables`` but leaves out the tables whose path does not exist."""
    found = LoadedTables({}, {})
    for name in CONTRACTS:
        try:
            one = read_tables(spark, folder, file_format, suffix, [name])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            found.update(one)
            found.rejects |= one.rejects
    return found


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Expose relations by name to ``spark.sql``."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def write_between_stages(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the cluster's shared checkpoint folder.

    Unlike ``checkpoint()`` the written table keeps column pruning and filter pushdown for the
    reports that read it, and it outlives lost executors. Nothing here removes it: the folder is
    scratch space, and whoever runs the job empties it when the job is over.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = f"{shared.rstrip('/')}/{name}-{uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
