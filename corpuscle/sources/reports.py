"""Readers of linter reports: a column of whole report texts to findings (file, line, message).

Every reader takes a table of reports and the columns to carry along, and returns
one row a finding. A null, empty or malformed report has none; entries without a
file, a message or a whole line number are left out, and a missing number is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GNU = r"^(.+?):(\d+)(?::\d+)?:\s*(.+)$"


def _found(rows: DataFrame, carry: tuple[str, ...], file: Column, line: Column, message: Column) -> DataFrame:
    number = F.coalesce(line, F.lit("0")).try_cast("int")
    out = rows.select(*carry, F.trim(file).alias("file"), number.alias("line"), F.trim(message).alias("message"))
    return out.where("file != '' and message != '' and line is not null")


def gnu(reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Lines `file:line: message` or `file:line:column: message`; other lines are left out."""
    rows = reports.select(*carry, F.explode(F.split(text, r"\r?\n")).alias("found_line")).where(F.col("found_line").rlike(GNU))
    part = [F.regexp_extract("found_line", GNU, k) for k in (1, 2, 3)]
    return _found(rows, carry, *part)


def golangci(reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """An object with Issues, each with Pos.Filename, Pos.Line and Text."""
    data = F.from_json(text, "Issues array<struct<Pos struct<Filename string, Line string>, Text string>>")
    rows = reports.select(*carry, F.explode(data["Issues"]).alias("it"))
    return _found(rows, carry, F.col("it.Pos.Filename"), F.col("it.Pos.Line"), F.col("it.Text"))


def flat_json(reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """An array of objects; each field has three names, of which the first with a value counts."""
    names = (("file", "filename", "path"), ("line", "line_no", "row"), ("message", "text", "reason"))
    data = F.from_json(text, "array<struct<" + ", ".join(f"{n} string" for group in names for n in group) + ">>")
    rows = reports.select(*carry, F.explode(data).alias("it"))
    return _found(rows, carry, *[F.coalesce(*[F.nullif(F.col(f"it.{n}"), F.lit("")) for n in group]) for group in names])


def rubocop(reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """An object with files, each with path and offenses."""
    data = F.from_json(text, "files array<struct<path string, offenses array<struct<location struct<line string>, message string>>>>")
    rows = reports.select(*carry, F.explode(data["files"]).alias("f")).select(*carry, "f.path", F.explode("f.offenses").alias("it"))
    return _found(rows, carry, F.col("path"), F.col("it.location.line"), F.col("it.message"))


def cargo(reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; compiler messages count, with their first span and the first line of what is rendered."""
    schema = "reason string, message struct<rendered string, message string, spans array<struct<file_name string, line_start string>>>"
    rows = reports.select(*carry, F.explode(F.split(text, r"\r?\n")).alias("found_line")).select(*carry, F.from_json("found_line", schema).alias("it")).where("it.reason = 'compiler-message'")
    span = F.get("it.message.spans", F.lit(0))
    said = F.coalesce(F.nullif(F.col("it.message.rendered"), F.lit("")), F.col("it.message.message"))
    return _found(rows, carry, span["file_name"], span["line_start"], F.substring_index(said, "\n", 1))


def eslint(reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """An array of objects with filePath and messages."""
    data = F.from_json(text, "array<struct<filePath string, messages array<struct<line string, message string>>>>")
    rows = reports.select(*carry, F.explode(data).alias("f")).select(*carry, "f.filePath", F.explode("f.messages").alias("it"))
    return _found(rows, carry, F.col("filePath"), F.col("it.line"), F.col("it.message"))


#: Readers by the name of a tool's output format; register() adds to them.
FORMATS: dict[str, Callable[..., DataFrame]] = {"gnu": gnu, "golangci": golangci, "json": flat_json, "rubocop": rubocop, "cargo": cargo, "eslint": eslint}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """Add a reader of a further format; a name that is taken is refused."""
    if name in FORMATS:
        raise ValueError(f"format {name} is there already")
    FORMATS[name] = reader


def read(kind: str, reports: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The findings of reports in the format of that name."""
    return FORMATS[kind](reports, text, carry)
