"""CSV files: header detection, clean column names, rows of the wrong length skipped, everything as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that a column name can't keep.
SPECIALS = "\n\r -()[].,:;'\"/\\|@#$%^&*+=<>?`~"
_CLEAN = str.maketrans({c: "_" for c in SPECIALS})


def clean_name(name: str) -> str:
    """Lower case, specials as _, none at the ends; col for nothing left, col_ before a digit."""
    name = name.lower().translate(_CLEAN).strip("_") or "col"
    return f"col_{name}" if name[0].isdigit() else name


def _numeric(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def column_names(first: list[str]) -> tuple[list[str], bool]:
    """Names of the columns and whether the first line is a header: it isn't if any cell in it is a number.

    Names that come out equal get a number.
    """
    if any(_numeric(cell) for cell in first if cell):
        return [f"col_{i + 1}" for i in range(len(first))], False
    names: list[str] = []
    for name in map(clean_name, first):
        own, n = name, 2
        while own in names:
            own, n = f"{name}_{n}", n + 1
        names.append(own)
    return names, True


def _records(spark: SparkSession, path: str, delimiter: str, multiline: bool) -> tuple[DataFrame | None, list[str], list[str]]:
    """All records below the header with _bad beside (null for those of the right length), their columns, and their names."""
    # where a record may go over several lines, a file isn't cut: one task reads it, as a stream
    options = {"sep": delimiter, "multiLine": multiline, "mode": "PERMISSIVE", "columnPruning": False, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "nullValue": "\u0000", "emptyValue": ""}
    first = spark.read.options(**options).option("header", False).csv(path).first()
    if first is None:
        return None, [], []
    names, header = column_names([(c or "").strip() for c in first])
    inner = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*inner, "_bad"]])
    # without pruning, as a pruned parser would not see that a row is ragged
    rows = spark.read.schema(schema).options(**options).option("header", header).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").csv(path)
    # Spark refuses to read the column of bad lines alone, so another one is touched as well
    return rows.where(F.coalesce(F.length("_c0"), F.lit(0)) >= 0), inner, names


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = True) -> DataFrame:
    """All columns as text. Only the first record is looked at on the driver; a data record there stays data.

    Rows with more or fewer cells than the first record are left out. A cell may hold quoted delimiters, quotes and
    line breaks (\\r\\n comes as \\n); blanks before a cell are cut. As line breaks don't show where a record begins,
    each file is read by one task; many files are read side by side. With multiline=False every line is a record, and
    many tasks read a large file.
    """
    rows, inner, names = _records(spark, path, delimiter, multiline)
    if rows is None:
        return spark.createDataFrame([], T.StructType([]))
    # in a row of the right length a null cell is an empty one
    cells = [F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")) for c in inner]
    # what a line that ends in \r\n leaves where the first one ends in \n
    cells[-1] = F.regexp_replace(cells[-1], r"\r\z", "")
    return rows.where("_bad is null").select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])


def skipped(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = True) -> int:
    """Number of rows that read_csv leaves out."""
    rows, _, _ = _records(spark, path, delimiter, multiline)
    return 0 if rows is None else rows.where("_bad is not null").count()
