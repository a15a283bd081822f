"""Documents taken apart into placed cells and texts, and the data points found in them.

Points are looked up through n-gram postings of each document: of every way to write a
point, the rarest of its n-grams leads to the places that may hold it, and only these are
compared. No document's points meet all of its places. Of a place's n-grams only those are posted that a
mask of fixed size, of the bits of what the document's points are made of, lets through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import s
from ..functions.text import number_variants

BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
PROV = f"array<struct<page_no:int,bbox:{BOX}>>"
#: What is read of a document's JSON; other fields are left alone.
DOCUMENT = f"struct<tables:array<struct<prov:{PROV},data:struct<table_cells:array<struct<text:string,bbox:{BOX},start_row_offset_idx:int,start_col_offset_idx:int>>>>>,texts:array<struct<text:string,prov:{PROV}>>>"
GRAM = 3  #: letters of an n-gram; shorter writings are looked up whole
WORDS = 16  #: words of 64 bits in the mask of a document's n-grams
HEAD = 30  #: fixed value: letters by which two places of a page count as one


def places(docs: DataFrame, key: str = "doc", json: str = "json") -> DataFrame:
    """(key, place, kind, table, page, box, row, col, text) of the table cells and texts of documents written as JSON.

    ``place`` orders a document: cells by table, then texts. A place without a page has a null one, a
    document that is no JSON, or null, has no places.
    """
    d = docs.select(key, F.from_json(json, DOCUMENT).alias("d"))
    tables = d.select(key, F.posexplode("d.tables").alias("table", "t"))
    cells = tables.select(key, "table", F.get("t.prov", F.lit(0))["page_no"].alias("page"), F.posexplode("t.data.table_cells").alias("i", "c"))
    cells = cells.select(key, F.struct(F.lit(0).alias("rank"), "table", "i").alias("place"), F.lit("table_cell").alias("kind"), "table", "page", F.col("c.bbox").alias("box"), F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), s(F.col("c.text")).alias("text"))
    texts = d.select(key, F.posexplode("d.texts").alias("i", "t")).withColumn("p", F.get("t.prov", F.lit(0)))
    none = F.lit(None).cast("int")
    texts = texts.select(key, F.struct(F.lit(1).alias("rank"), F.lit(0).alias("table"), "i").alias("place"), F.lit("text").alias("kind"), none.alias("table"), F.col("p.page_no").alias("page"), F.col("p.bbox").alias("box"), none.alias("row"), none.alias("col"), s(F.col("t.text")).alias("text"))
    return cells.union(texts)


def _grams(text: Column, sizes: Column) -> Column:
    """The distinct pieces of ``text`` of each of the sizes, in one pass a size."""
    of = lambda k: F.when(F.array_contains(sizes, k), F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def find_points(found: DataFrame, points: DataFrame, key: str = "doc") -> DataFrame:
    """(key, point, variant, equivalent, page, kind, table, row, col, box, text): where the ``points`` (key, point) of documents stand in their ``places``.

    A point is searched as it is and in all equal writings of its number, whatever the case, as part of a text.
    Of places of a page and kind whose texts begin alike, the first is given, by writing, then by place;
    ``equivalent`` tells that it holds another writing. Blank and null points find nothing; a point named twice counts once.
    """
    asked = points.where(F.trim(s(F.col("point"))) != "").select(key, "point").distinct()
    written = asked.select(key, "point", F.posexplode(number_variants(F.col("point"))).alias("v", "variant")).withColumn("low", F.lower("variant"))
    size = F.least(F.length("low"), F.lit(GRAM))
    written = written.withColumn("grams", _grams(F.col("low"), F.array(size)))
    place_of = lambda g: F.pmod(F.xxhash64(g), F.lit(64 * WORDS)).cast("int")
    pieces = written.select(key, size.alias("size"), F.explode("grams").alias("gram")).withColumn("bit", place_of(F.col("gram")))
    marks = [F.bit_or(F.when(F.shiftright("bit", 6) == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]
    masks = pieces.groupBy(key).agg(F.array(*marks).alias("mask"), F.sort_array(F.collect_set("size")).alias("sizes"))  # at most GRAM numbers
    let_through = lambda p: F.call_function("shiftrightunsigned", F.get("mask", F.shiftright(p, 6)), p % 64).bitwiseAND(F.lit(1)) == 1
    grams = F.filter(_grams(F.lower("text"), F.col("sizes")), lambda g: let_through(place_of(g)))
    posted = found.join(masks, key).select(key, "place", F.explode(grams).alias("gram"))
    often = posted.groupBy(key, "gram").agg(F.count("*").alias("n"))
    wanted = written.withColumn("gram", F.explode("grams")).drop("grams").join(often, [key, "gram"], "left")
    rarest = wanted.groupBy(key, "point", "v", "variant", "low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing"))
    near = rarest.where("missing = 0").join(posted, [key, "gram"]).drop("gram", "missing")
    hits = near.join(found, [key, "place"]).where(F.contains(F.lower("text"), F.col("low")))
    shown = F.struct("variant", (F.col("v") > 0).alias("equivalent"), "table", "row", "col", "box", "text")
    first = hits.groupBy(key, "point", "page", "kind", F.substring("text", 1, HEAD).alias("head")).agg(F.min_by(shown, F.struct("v", "place")).alias("x"))
    return first.select(key, "point", "page", "kind", "x.*")
