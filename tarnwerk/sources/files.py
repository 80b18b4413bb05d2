"""Readers: CSV of three kinds, JSON, YAML, literal tables, hashes, Excel and PDF where libraries exist."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.checks import CheckFailed


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header. With a schema it is enforced against the header and bad cells fail; without,
    all columns are text. ``columns`` prunes."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with doubled quotes, line ends inside cells, and any mix of line ends, as text columns.
    Short rows are filled with empty text, cells beyond the header and blank rows dropped; blank or repeated
    headers, stray and unterminated quotes fail. Each file is parsed as a whole by the task that reads it, so
    one must fit in a task's memory; larger data belong in files that can be split."""
    import csv as parser
    import io
    import re

    quoted = re.compile(r'(^|,|\n)"(?:[^"]|"")*"(?=,|\n|$)')

    def parsed(text: str) -> Iterator[list[str]]:
        plain = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        if '"' in quoted.sub(r"\1", plain):
            raise CheckFailed("a stray or unterminated quote")
        return parser.reader(io.StringIO(plain, newline=""), strict=True)

    files = spark.read.text(path, wholetext=True)
    first = files.first()
    names = next(parsed(first["value"]), []) if first else []
    if any(not c.strip() for c in names) or len(set(names)) != len(names) or not names:
        raise CheckFailed(f"blank or repeated headers: {names}")

    def rows(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for text in frame["value"]:
                lines = parsed(text)
                if next(lines, None) != names:
                    raise CheckFailed("files differ in their headers")
                full = [(r + [""] * len(names))[: len(names)] for r in lines if any(c.strip() for c in r)]
                yield pd.DataFrame(full, columns=names, dtype=str)

    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in names))


def preamble_csv(spark: SparkSession, path: str, columns: Sequence[str], row_pattern: str = r"^\d{8}:\d{4},", header_start: str = "time,") -> tuple[DataFrame, DataFrame]:
    """A text file with a preamble, a header line, rows and a footer: (rows, metadata lines). Rows are the
    lines that match; every measure is a double, null where the text is none."""
    lines = spark.read.text(path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = lines.where(F.col("value").rlike(row_pattern)).select(F.from_csv("value", schema).alias("r")).select("r.*")
    typed = rows.select(F.col(f"`{columns[0]}`"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in columns[1:]))
    meta = lines.where(~F.col("value").rlike(row_pattern) & ~F.ltrim("value").startswith(header_start) & F.col("value").contains(":"))
    key = F.trim(F.substring_index("value", ":", 1))
    text = F.trim(F.expr("substring(value, instr(value, ':') + 1)"))
    number = F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0)
    return typed, meta.select(key.alias("key"), text.alias("text"), F.when(number != "", number.cast("double")).alias("number"))


def json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Whole JSON documents, one a file or an array of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def yaml(path: str, sections: Sequence[str] = ()) -> dict:
    """A YAML mapping with required sections; needs the yaml library."""
    import yaml as library

    found = library.safe_load(Path(path).read_text())
    if missing := [s for s in sections if s not in (found or {})]:
        raise CheckFailed(f"missing sections: {', '.join(missing)}")
    return found


def beside(config: str, path: str) -> str:
    """A path relative to the folder of a config file."""
    p = Path(path)
    return str(p if p.is_absolute() else (Path(config).parent / p).resolve())


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, length and sha256 of files, read where they are."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def require_hash(path: str, expected: str) -> str:
    """``path`` if its content is the expected one."""
    if (got := sha256(path)) != expected:
        raise CheckFailed(f"{path}: sha256 is {got}, not {expected}")
    return path


def verified_copy(source: str, target: str, expected: str, overwrite: bool = False) -> bool:
    """Copy a file whose hash is known; False if the target already is that file."""
    require_hash(source, expected)
    to = Path(target)
    if to.exists():
        if sha256(target) == expected:
            return False
        if not overwrite:
            raise CheckFailed(f"{target} exists with other content")
    part = to.with_name(to.name + ".part")
    to.parent.mkdir(parents=True, exist_ok=True)
    part.write_bytes(Path(source).read_bytes())
    require_hash(str(part), expected)
    part.replace(to)
    return True


def literal(spark: SparkSession, schema: str, rows: Sequence[Sequence[object]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def mapping(spark: SparkSession, table: Mapping[object, object], key: str, value: str, schema: str) -> DataFrame:
    return literal(spark, schema, list(table.items())).toDF(key, value)


def grid(spark: SparkSession, n: int, out: str = "x") -> DataFrame:
    """n evenly spaced points from 0 to 1."""
    return spark.range(n).select((F.col("id") / F.lit(max(n - 1, 1))).alias(out))


def excel(spark: SparkSession, path: str, sheet: str | int = 0, header_row: int = 0, rename: Mapping[int, str] | None = None) -> DataFrame:
    """A sheet as text columns, columns renamed by position. Needs an Excel library for pandas."""
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet, header=header_row, dtype=str)
    frame.columns = [(rename or {}).get(i, str(c)) for i, c in enumerate(frame.columns)]
    return spark.createDataFrame(frame.where(frame.notna(), None).values.tolist(), ", ".join(f"`{c}` string" for c in frame.columns))


def pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """path, page and text of PDF files. Needs pdfplumber on the executors."""

    def run(batches):
        import io

        import pandas as pd
        import pdfplumber

        for frame in batches:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as book:
                    yield pd.DataFrame([(p, i + 1, page.extract_text() or "") for i, page in enumerate(book.pages)], columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")
