"""Operators on the cells of tables: doc_id, table, row, col and cell; rows and columns count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.predicates import bare, looks_numeric
from corpuskiln.functions.text import label_key

TABLE = ["doc_id", "table"]


def cells(rows: DataFrame, separator: str = "|") -> DataFrame:
    """The cells of lines (doc_id, pos, line) with a separator; each run of such lines is a table, named by its first line's pos."""
    held = rows.filter(F.contains("line", F.lit(separator)))
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    held = held.withColumn("island", island)
    held = held.withColumn("table", F.min("pos").over(W.partitionBy("doc_id", "island"))).withColumn("row", F.col("pos") - F.col("table"))
    return held.select(*TABLE, "row", F.posexplode(F.transform(F.split("line", f"[{separator}]"), bare)).alias("col", "cell"))


def matrix_headers(found: DataFrame) -> DataFrame:
    """doc_id, table and row of the rows that head a matrix: three or more cells that are not blank, none numeric, above a row of two or more of which half are."""
    filled = bare(F.col("cell")) != ""
    by_row = found.groupBy(*TABLE, "row").agg(F.sum(filled.cast("int")).alias("n"), F.sum((filled & looks_numeric(F.col("cell"))).cast("int")).alias("numeric"))
    below = W.partitionBy(*TABLE).orderBy("row")
    rows = by_row.withColumns({"next_row": F.lead("row").over(below), "next_n": F.lead("n").over(below), "next_numeric": F.lead("numeric").over(below)})
    data = (F.col("next_row") == F.col("row") + 1) & (F.col("next_n") >= 2) & (F.col("next_numeric") * 2 >= F.col("next_n"))
    return rows.filter((F.col("n") >= 3) & (F.col("numeric") == 0) & data).select(*TABLE, "row")


def label_keys(found: DataFrame) -> DataFrame:
    """doc_id and key of the cells that are labels: in an even column, in a matrix header, or the same and not numeric in one column of two or more rows of the document."""
    keyed = found.withColumn("key", label_key(F.col("cell"))).filter("key <> ''")
    headed = keyed.join(matrix_headers(found).withColumn("head", F.lit(True)), [*TABLE, "row"], "left")
    placed = headed.filter((F.col("col") % 2 == 0) | F.col("head")).select("doc_id", "key")
    repeated = keyed.filter(~looks_numeric(F.col("cell"))).groupBy("doc_id", "col", "key").agg(F.count("*").alias("n")).filter("n >= 2").select("doc_id", "key")
    return placed.unionByName(repeated).distinct()


def with_headers(found: DataFrame, is_noise: Column | None = None) -> DataFrame:
    """The cells with row_header and col_header: the nearest cells to the left and above that are neither blank nor noise (an expression of cell); empty without one."""
    value = bare(F.col("cell"))
    named = F.when((value != "") & ~(F.lit(False) if is_noise is None else is_noise), value)

    def nearest(by: str, order: str) -> Column:
        return F.coalesce(F.last(named, ignorenulls=True).over(W.partitionBy(*TABLE, by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(""))

    return found.withColumns({"row_header": nearest("row", "col"), "col_header": nearest("col", "row")})


def blank_cells(found: DataFrame) -> DataFrame:
    """The blank cells with their headers and a label of both, or of either, or their place."""
    held = with_headers(found).filter(bare(F.col("cell")) == "")
    both = F.concat_ws(" / ", F.nullif(F.col("row_header"), F.lit("")), F.nullif(F.col("col_header"), F.lit("")))
    return held.withColumn("label", F.when(both != "", both).otherwise(F.concat_ws(":", "row", "col")))


def empty_rows(found: DataFrame) -> DataFrame:
    """doc_id, table and row of the rows without any cell that is not blank."""
    return found.groupBy(*TABLE, "row").agg(F.max(bare(F.col("cell")) != "").alias("some")).filter("not some").drop("some")


def without_guide_rows(found: DataFrame, is_guide: Column) -> DataFrame:
    """The cells without rows of guides; a table whose rows that are not blank are all guides goes whole.

    A row is a guide if its cells, joined by spaces, are (an expression of line).
    """
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), " ")
    by_row = found.groupBy(*TABLE, "row").agg(line.alias("line")).withColumn("blank", bare(F.col("line")) == "").withColumn("guide", is_guide & (bare(F.col("line")) != ""))
    in_table = W.partitionBy(*TABLE)
    whole = F.min(F.col("guide") | F.col("blank")).over(in_table) & F.max("guide").over(in_table)
    gone = by_row.withColumn("whole", whole).filter(F.col("guide") | F.col("whole")).select(*TABLE, "row")
    return found.join(gone, [*TABLE, "row"], "left_anti")


def vertical_cards(found: DataFrame, synonyms: DataFrame) -> DataFrame:
    """doc_id, table, row, col, key, label and value of the cards whose labels stand above their values.

    synonyms: alias and cluster, as label keys. A row is a card's header if two or more of its cells are not blank and all of
    those are labels of clusters of their own. The row below has its values: it must have as many cells, and none of its cells
    below a label may be a label itself. If the row after that, with as many cells, has any cell below a label that is neither
    blank nor a label, the table is a roster of several records and gives nothing. Blank values are left out.
    """
    aliases = synonyms.select(F.col("alias").alias("key"), "cluster").dropDuplicates(["key"])
    # The synonyms are a table of words of forms; joined by key, all cells would travel, most of them to the tasks of a few labels.
    keyed = found.withColumn("cell", bare(F.col("cell"))).withColumn("key", label_key(F.col("cell"))).join(F.broadcast(aliases), "key", "left")
    one = F.struct("col", "cell", "cluster")
    rows = keyed.groupBy(*TABLE, "row").agg(F.array_sort(F.collect_list(one)).alias("cells"))
    order = W.partitionBy(*TABLE).orderBy("row")
    rows = rows.withColumns({"below": F.lead("cells", 1).over(order), "after": F.lead("cells", 2).over(order)})
    filled = F.transform(F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"]["cell"] != ""), lambda x: x)
    # Most rows hold a cell that is no label; they are told by one look at their cells.
    only_labels = F.forall("cells", lambda c: (c["cell"] == "") | c["cluster"].isNotNull())
    rows = rows.filter(only_labels & (F.size("below") == F.size("cells"))).withColumn("labels", filled)
    clusters = F.transform("labels", lambda x: x["c"]["cluster"])
    is_header = (F.size("labels") >= 2) & (F.size(F.array_distinct(clusters)) == F.size("labels"))
    under = lambda cells, x: F.get(F.col(cells), x["i"])
    labelled = F.exists("labels", lambda x: (under("below", x)["cell"] != "") & under("below", x)["cluster"].isNotNull())
    roster = (F.size("after") == F.size("cells")) & F.exists("labels", lambda x: (under("after", x)["cell"] != "") & under("after", x)["cluster"].isNull())
    cards = rows.filter(is_header & ~labelled & ~F.coalesce(roster, F.lit(False)))
    pairs = F.transform("labels", lambda x: F.struct(x["c"]["col"].alias("col"), x["c"]["cell"].alias("label"), under("below", x)["cell"].alias("value")))
    out = cards.select(*TABLE, "row", F.explode(pairs).alias("x")).select(*TABLE, "row", "x.col", label_key(F.col("x.label")).alias("key"), "x.label", "x.value")
    return out.filter("value <> '' and key <> ''")
