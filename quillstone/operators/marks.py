"""Citation marks of slides: numbers behind the words of table cells and at the ends of text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cases, has, rx, s

# The columns of a table that carry marks, and their names.
COLUMNS = ((1, "方案名称"), (2, "药物"))
# Terms that end in figures, names of studies, statistics and journals whose figures are no marks.
TERMS = (
    "PD-?L1 PD-?1 CTLA-?4 mOS mPFS mTTP mTTR ORR DCR PFS TTP TTR HCC uHCC HBV HCV AFP ALT AST TBIL ALBI ECOG BOR CR PR SD PD AE TRAE AESI HR CI OS STRIDE T\\+A T\\+D O\\+Y LEN SOR NIVO IPI Cabo Regor"
    " Atezo Bev Camrelizumab Atezolizumab Durvalumab Tremelimumab Tislelizumab Lenvatinib Sorafenib Cabozantinib Apatinib Sintilimab NATREC CAR TACE HIFU RFA MWA"
).split()
STUDIES = "ORIENT CARES CHECKMATE IMBRAVE HIMALAYA IMFINZI KEYNOTE JUPITER COSMIC SHARP RESORCE REFLECT CELESTIAL BRYTON TACTICS STRIDE APASL ASCO ESMO NCCN AHCC BMS MRK".split()
STATISTICS = ("N=", "N≥", "N≤", "OR=", "AND=", "CR=", "p=", "HR=", "95%\\s*CI", "CR:", "p:", "HR:", "95%:", "CI:")
JOURNALS = (
    "N\\s+Engl", "N\\s+Engl\\s+J\\s+Med", "Lancet", "JAMA", "Nat", "J\\s+Hepatol", "J\\s+Clin", "JAMA\\s+Oncol", "Lancet\\s+Oncol", "Nat\\s+Med", "Nat\\s+Commun", "Nat\\s+Rev", "Cancer\\s+Cell", "Cancer\\s+Discov",
    "Cancer\\s+Res", "Clin\\s+Cancer\\s+Res", "Gastroenterology", "Hepatology", "J\\s+Immunother", "Front\\s+Oncol", "Med", "Br\\s+J\\s+Cancer", "Ann\\s+Oncol", "Eur\\s+J\\s+Cancer",
)
LIGAND, LYMPHOCYTE = "程序性死亡配体", "细胞毒性T淋巴细胞"
LARGEST, WIDEST = 24, 5  #: fixed values: the largest mark of a text line, the widest range
SHAPES, ROWS = 1_000, 10_000  #: fixed values: shapes of a slide, and rows of a table, that are dealt out together

CELL_MARKS = (r"[\x{4E00}-\x{9FFF}]+([0-9,]+)", r"[A-Z]+\+Y?\s*([0-9,]+)")
NUMBER_LINE = r"^[0-9]+\.?[0-9]*$"
TERM_LINE = rf"(?is)(?:{'|'.join(TERMS)}).*?[0-9]+$"
TERM_END = r"(?i)(?:PD-?L1|PD-?1|CTLA-?4)$"
STUDY_END = rf"(?i)(?:{'|'.join(STUDIES)})\s*-?\s*[0-9]+$"
STATISTIC_END = rf"(?i)(?:{'|'.join(STATISTICS)})\s*[0-9.]+$"
VOLUME_END = r"[0-9]+\([0-9]+\)\s*[:：]\s*[0-9]+$"
JOURNAL_END = rf"(?i)(?:{'|'.join(JOURNALS)})\s*\.?\s*[0-9]{{4}}$"
AUTHOR_END = r"(?s)(?:[A-Z][a-z]+,\s*[A-Z][a-z]+|et al\.?)[^.]*\b(?:20|19)[0-9]{2}$"
RANGE_END = r"([1-9][0-9]?)\s*-\s*([1-9][0-9]?)$"
LIST_END = r"([1-9][0-9]?(?:,\s*[1-9][0-9]?)*)$"
EXCLUDED = (STUDY_END, STATISTIC_END, VOLUME_END, JOURNAL_END, AUTHOR_END)


def stripped(c: Column) -> Column:
    """``c`` without the white space around it, of whatever kind."""
    return F.regexp_replace(s(c), r"(?U)^\s+|\s+$", "")


def cell_marks(cell: Column) -> Column:
    """Numbers behind Chinese words ("索拉非尼3,4") or a plus sign behind capitals ("O+Y15,16"); longer ones than 18 figures are none."""
    runs = F.concat(*[F.regexp_extract_all(s(cell), F.lit(p), F.lit(1)) for p in CELL_MARKS])
    numbers = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("[0-9]+"), F.lit(0))))
    return F.array_distinct(F.filter(F.transform(numbers, lambda n: F.when(F.length(n) <= 18, n.cast("long"))), lambda n: n.isNotNull()))


def line_marks(line: Column) -> Column:
    """(marks, kind) of a line without white space around it.

    No marks: a line that is a number; one that ends in a figure behind a medical term, if it
    explains such terms or ends with one ("PD-L1"); ends of studies' names, of statistics, of volume and
    page, of journal and year, of authors and year. Else the line's end: a range of marks up to LARGEST that
    spans WIDEST at most, or numbers with commas, of which those up to LARGEST are marks.
    """
    explains = (F.size(F.split(line, "PD-L1")) >= 3) | (has(line, "PD-L1") & has(line, "CTLA-4")) | has(line, LIGAND, LYMPHOCYTE)
    none = ~rx(line, "[0-9]$") | rx(line, NUMBER_LINE) | ((explains | rx(line, TERM_END)) & rx(line, TERM_LINE))  # the long patterns last
    for pattern in EXCLUDED:
        none = none | rx(line, pattern)
    first, last = (F.when(end != "", end).cast("long") for end in (F.regexp_extract(line, RANGE_END, i) for i in (1, 2)))  # a cast that fails costs more than the rest
    span = (first <= last) & (last <= LARGEST) & (last - first <= WIDEST)
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(line, LIST_END, 1), F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("long"))
    empty = F.array().cast("array<long>")
    both = lambda marks, kind: F.struct(marks.alias("marks"), F.lit(kind).alias("kind"))
    return cases([(none, both(empty, "text")), (F.coalesce(span, F.lit(False)), both(F.sequence(first, F.when(span, last).otherwise(first)), "text_range"))], both(F.filter(listed, lambda n: n <= LARGEST), "text"))


def citation_marks(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(slide, mark, kind, shape, name, row, column, context, row_context): where each slide's marks stand first.

    ``texts`` (slide, shape, name, text) are text shapes, ``rows`` (slide, shape, name, row, cells)
    table rows with row 0 as header. Tables come before texts; of several tables the last that
    has a mark gives its place, within a table the first cell; among texts the first
    line. Null texts and cells have no marks; ties of repeated rows go to the smaller name, context and row.
    """
    # Rows and texts go whole to where their slide's others are, so that a mark's places are compared there before its first goes on; a hot slide is dealt out in parts.
    part = F.floor(F.col("shape") / SHAPES)
    marked = reduce(lambda a, b: a | b, [rx(s(F.get("cells", F.lit(c))), p) for c, _ in COLUMNS for p in CELL_MARKS])
    rows = rows.where(F.col("row") > 0).where(marked).select("slide", "shape", "name", "row", "cells").repartition("slide", part, F.floor(F.col("row") / ROWS))
    texts = texts.where(rx(F.col("text"), "[0-9]")).select("slide", "shape", "name", "text").repartition("slide", part)
    # Outer explosions, as before others Spark works the marks out once more, to see whether there are any.
    spread = [F.struct(F.lit(c).alias("col"), stripped(F.get("cells", F.lit(c))).alias("context")) for c, _ in COLUMNS]
    line = F.array_join(F.transform("cells", stripped), " | ")
    cells = rows.select("slide", "shape", "name", "row", line.alias("row_context"), F.explode(F.array(*spread)).alias("cell"))
    in_cells = cells.select("slide", "shape", "name", "row", "row_context", "cell.*", F.explode_outer(cell_marks(F.col("cell.context"))).alias("mark")).where("mark IS NOT NULL")
    in_cells = in_cells.select("slide", "mark", F.struct(F.lit(0).alias("o"), (-F.col("shape")).alias("shape"), F.col("row").alias("place"), "col", "name", "context", "row_context", F.lit("table").alias("kind")).alias("at"))
    lines = texts.select("slide", "shape", "name", F.posexplode(F.split(F.col("text"), "\n")).alias("place", "line")).withColumn("line", stripped(F.col("line")))
    in_lines = lines.select("slide", "shape", "name", "place", "line", line_marks(F.col("line")).alias("m")).select("slide", "shape", "name", "place", "line", F.col("m.kind").alias("kind"), F.explode_outer("m.marks").alias("mark")).where("mark IS NOT NULL")
    in_lines = in_lines.select("slide", "mark", F.struct(F.lit(1).alias("o"), "shape", "place", F.lit(0).alias("col"), "name", F.col("line").alias("context"), F.lit("").alias("row_context"), "kind").alias("at"))
    first = in_cells.union(in_lines).groupBy("slide", "mark").agg(F.min("at").alias("at"))
    table = F.col("at.o") == 0
    column = cases([(F.col("at.col") == c, name) for c, name in COLUMNS], None)
    return first.select(
        "slide", "mark", "at.kind", F.when(table, -F.col("at.shape")).otherwise(F.col("at.shape")).alias("shape"), "at.name", F.when(table, F.col("at.place").cast("int")).alias("row"),
        F.when(table, column).alias("column"), "at.context", F.when(table, F.col("at.row_context")).alias("row_context"),
    )
