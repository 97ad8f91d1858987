"""Notebooks: code cells as one source, with the way back from a line to its cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a notebook that are read.
MOST_CELLS = 2000


def read(files: DataFrame) -> DataFrame:
    """(notebook, at, code, source): cells of notebook files (path, text); a file that isn't one has none."""
    kind = "struct<cells:array<struct<cell_type:string,source:string>>>"
    parsed = files.select(F.col("path").alias("notebook"), F.from_json("text", kind).alias("n"))
    rows = parsed.select("notebook", F.posexplode(F.slice("n.cells", 1, MOST_CELLS)).alias("at", "c"))
    # a source is a string, or an array of lines kept as its JSON text
    lines = F.from_json("c.source", "array<string>")
    source = F.when(F.startswith(F.ltrim("c.source"), F.lit("[")) & lines.isNotNull(), F.array_join(lines, "")).otherwise(F.col("c.source"))
    return rows.select("notebook", "at", (F.col("c.cell_type") == "code").alias("code"), source.alias("source"))


def cells(rows: DataFrame) -> DataFrame:
    """Code cells with their running number, first line in the joined source and number of lines; a blank line follows each cell."""
    n = F.when(F.col("code"), F.size(F.split("source", "\n"))).otherwise(0).cast("long")
    order = Window.partitionBy("notebook").orderBy("at")
    numbered = rows.withColumn("n_lines", n).withColumn("cell", F.sum(F.col("code").cast("long")).over(order))
    before = F.sum(F.when(F.col("code"), F.col("n_lines") + 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("first_line", F.coalesce(before, F.lit(0)) + 1).where("code").select("notebook", "at", "cell", "first_line", "n_lines", "source")


def joined(rows: DataFrame) -> DataFrame:
    """(notebook, source): code cells joined; lines for the shell or the notebook are blanked."""
    plain = F.regexp_replace("source", "(?m)^[ \\t]*[!%].*$", "")
    made = rows.where("code").groupBy("notebook").agg(F.array_sort(F.collect_list(F.struct("at", plain.alias("source")))).alias("cells"))
    return made.select("notebook", F.array_join(F.transform("cells", lambda c: F.concat(c["source"], F.lit("\n"))), "\n").alias("source"))


def cell_of_line(numbered: DataFrame, lines: DataFrame) -> DataFrame:
    """lines (notebook, line) with the cell that each lies in, null for the blank lines between cells.

    Each line of a cell becomes a row with the cell's number, so lines meet theirs in an
    equi-join and the rows grow with the notebooks' lines only.
    """
    every = numbered.select("notebook", "cell", F.explode(F.sequence("first_line", F.col("first_line") + F.col("n_lines") - 1)).alias("line"))
    return lines.join(every, ["notebook", "line"], "left").select("notebook", "line", "cell")
