"""Names as a file's imports make them: the longest imported prefix put in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments that an imported prefix has at most, a fixed value.
LONGEST = 4


def canonical(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (file, name, ...) with `canonical`: the name whose longest prefix that its file knows as an alias is put in full.

    aliases has file, alias, full and at; of a file's aliases of one name the last counts. A
    name's prefixes, four at most, meet the aliases in an equi-join, once for each
    distinct name of a file. Names without an alias stay as they are; a null name or file stays null or as it is.
    """
    full = aliases.groupBy("file", "alias").agg(F.max_by("full", "at").alias("full"))
    cut = names.select("file", "name").distinct().withColumn("parts", F.split("name", "[.]"))
    take = F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(LONGEST))))
    cut = cut.where("name is not null").select("file", "name", "parts", take.alias("take"))
    cut = cut.select("file", "name", "take", F.array_join(F.slice("parts", 1, F.col("take")), ".").alias("alias"), F.slice("parts", F.col("take") + 1, F.size("parts")).alias("rest"))
    met = cut.join(full, ["file", "alias"]).groupBy("file", "name").agg(F.max_by(F.concat_ws(".", "full", "rest"), "take").alias("canonical"))
    return names.join(met, ["file", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
