"""Lines of files that speak of what a slide speaks of, and main files that are not the work cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cases, s
from .planning import first_rows

# Words by which slides and lines are compared, the first ones first.
KEYWORDS = (
    "TMA", "thrombotic microangiopathy", "血栓性微血管病", "微血管病", "aHUS", "atypical HUS", "TTP", "HSCT-TMA", "TA-TMA", "MAHA", "STEC-HUS", "HUS", "溶血尿毒综合征", "血栓性血小板减少性紫癜", "非典型溶血尿毒综合征", "微血管病性溶血性贫血",
    "complement", "补体", "C3", "C5", "eculizumab", "依库珠单抗", "ravulizumab", "alternative pathway", "替代途径", "classical pathway", "经典途径", "lectin pathway", "凝集素途径", "MAC", "C5b-9", "C3b", "endothelial", "内皮", "platelet", "血小板",
    "schistocyte", "裂红细胞", "头盔细胞", "microvascular", "微血管", "thrombosis", "血栓", "fibrin", "纤维蛋白", "AKI", "renal", "肾", "neurologic", "神经", "cardiac", "心脏", "proteinuria", "尿蛋白", "hypertension", "高血压", "plasma exchange",
    "血浆置换", "rituximab", "利妥昔", "corticosteroid", "激素", "caplacizumab", "anaphylatoxin", "narsoplimab", "ADAMTS13", "vWF", "CFH", "CFI", "CFB", "THBD", "MCP", "DI", "biomarker", "生物标志物", "diagnosis", "诊断", "prognosis", "预后",
    "造血干细胞移植", "器官", "感染", "多学科", "共识", "指南", "鉴别", "分类", "病因", "病理", "机制",
)
WORDS, ANCHORS, LEAST, HEAD = 20, 3, 5, 50  #: fixed values: words of a slide, lines it gets, their least score, letters by which lines are one


def length_score(text: Column) -> Column:
    n = F.length(text)
    return F.when(n.between(5, 100), 5).when(n.between(101, 200), 3).when(n > 300, -5).otherwise(0)


def words_in(text: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(s(text), w))


def anchors(slides: DataFrame, lines: DataFrame, words: tuple[str, ...] = KEYWORDS, n: int = ANCHORS, least: int = LEAST) -> DataFrame:
    """(slide, rank, i, score, text): the n best lines (file, i, text) of the file of each slide (slide, file, text).

    A line scores the length of each of the slide's first WORDS words that it holds, and for its own length. Lines that begin
    alike count once, with the best of them; of equal scores the earlier line goes first.

    Lines of a file that hold the same words and score the same for their length score the same for any slide, so
    the first n beginnings of each such kind stand in for all of it: whatever else of the kind a slide could take has n
    better lines before it. Slides of a file that ask for the same words get the same lines, which are sought once. Kinds are posted under
    their words, and what is asked meets the postings of its words only; as every line of a file may also be taken without a
    word of the slide, the best n beginnings of each file by length alone join them.
    """
    own = lines.select("file", "i", F.lower(F.substring(s(F.col("text")), 1, HEAD)).alias("head"), length_score(s(F.col("text"))).alias("base"), words_in(F.col("text"), words).alias("words"))
    heads = own.groupBy("file", "words", "base", "head").agg(F.min("i").alias("i"))
    kinds = first_rows(heads, "file,words,base", [F.col("i")], n)
    slides = slides.select("slide", "file", F.slice(words_in(F.col("text"), words), 1, WORDS).alias("asked"))
    asked = slides.select("file", "asked").distinct()
    postings = kinds.select("file", "i", "head", "base", F.explode("words").alias("word"))
    hits = asked.select("file", "asked", F.explode("asked").alias("word")).join(postings, ["file", "word"])
    hits = hits.groupBy("file", "asked", "i").agg((F.first("base") + F.sum(F.length("word"))).cast("int").alias("score"), F.first("head").alias("head"))
    longest = kinds.groupBy("file", "head").agg(F.min(F.struct((-F.col("base")).alias("less"), "i")).alias("best")).select("file", "head", (-F.col("best.less")).alias("base"), F.col("best.i").alias("i"))
    plain = first_rows(longest, "file", [F.desc("base"), F.col("i")], n)
    rest = asked.join(plain, "file").select("file", "asked", "i", F.col("base").alias("score"), "head")
    # a line may come both ways: its higher score is the true one
    every = hits.select("file", "asked", "i", "score", "head").union(rest).where(F.col("score") >= least)
    best = every.groupBy("file", "asked", "head").agg(F.min(F.struct((-F.col("score")).alias("less"), "i")).alias("best"))
    best = best.select("file", "asked", (-F.col("best.less")).alias("score"), F.col("best.i").alias("i"))
    top = first_rows(best, "file,asked", [F.desc("score"), F.col("i")], n, rank="rank")
    texts = top.select("file", "i").distinct().join(lines.select("file", "i", "text"), ["file", "i"])
    return slides.join(top.join(texts, ["file", "i"]), ["file", "asked"]).select("slide", "rank", "i", "score", "text")


# Short names of journals in file names.
SHORT_NAMES = {
    "j hepatol": ("jhepatol", "j_hepatol"), "j clin oncol": ("jco", "jclinoncol"), "jama oncol": ("jamaoncol",), "front oncol": ("frontoncol",), "front immunol": ("frontimmunol",), "front pharmacol": ("frontpharmacol",), "br j cancer": ("bjc", "brjcancer"),
    "nat commun": ("natcommun",), "nat rev cancer": ("natrevcancer",), "nat rev immunol": ("natrevimmunol",), "lancet": ("lancet",), "lancet oncol": ("lancetoncol",), "liver cancer": ("livercancer",), "liver int": ("liverint",), "clin cancer res": ("clincancerres",),
    "hepatology": ("hepatology",), "immunity": ("immunity",), "n engl j med": ("nejm",), "j am med assoc": ("jama",), "nccn": ("nccn",), "csco": ("csco",), "esmo": ("esmo",), "asco": ("asco",), "apasl": ("apasl",), "easl": ("easl",), "aasld": ("aasld",),
    "j natl cancer cent": ("jncc", "jnatlcancercent"), "gastroenterology": ("gastro", "gastroenterology"), "jama": ("jama",), "ann oncol": ("annoncol",), "oncotarget": ("oncotarget",), "acta crystallogr": ("actacrystallogr",), "anticancer res": ("anticancerres",),
    "nat rev": ("natrev",), "med": ("med",),
}
FIELDS = ("authors", "journal", "title", "year", "volume", "issue", "pages", "abstract_id")  #: fixed values: fields of a reference whose words count
#: The row whose work is a database, its names in file names, and what is said of rows at fault.
DATABASE_ROW, DATABASE, DATABASE_KIND, DATABASE_FILE, NO_WORD = "P3-1", ("globocan", "gco.iarc"), "GLOBOCAN 错位", "GLOBOCAN/IARC PDF", "无任何关键词匹配"


def reference_words(raw: Column, fields: list[Column], conference: Column, abstract_id: Column, year: Column) -> Column:
    """Words of a reference that its file's name may hold: Latin ones of three letters, Chinese ones of two, journals' short names, conference, abstract, year; each once, as they come."""
    text = F.concat(s(raw), *[F.when(s(f) != "", F.concat(F.lit(" "), f)).otherwise("") for f in fields])
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(r"[a-z]{3,}"), F.lit(0))
    chinese = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    short = F.flatten(F.array(*[F.when(F.contains(low, F.lit(name)), F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>")) for name, xs in SHORT_NAMES.items()]))
    single = F.array(F.lower(s(conference)), F.lower(s(abstract_id)), s(year))
    return F.array_distinct(F.filter(F.concat(latin, chinese, short, single), lambda w: w != ""))


def file_mismatch(row: Column, shared: Column, raw: Column, fields: dict[str, Column], main: Column, conference: Column) -> Column:
    """(kind, expected, actual) where the name of a row's main file holds no word of its reference; null where it does.

    Nothing is said of rows of several slides (an underscore in the name), of shared references and of
    rows without a file. The row of the database is judged by the database's names alone. Hyphens in file names don't count.
    """
    name = F.lower(main)
    texts = {k: v.cast("string") for k, v in fields.items()}
    empty = F.lit(None).cast("string")
    words = reference_words(raw, [texts.get(f, empty) for f in FIELDS], conference, texts.get("abstract_id", empty), texts.get("year", empty))
    held = F.exists(words, lambda w: F.contains(name, w) | F.contains(F.replace(name, F.lit("-")), w))
    silent = F.contains(F.substring(row, 3, 1 << 30), F.lit("_")) | F.coalesce(shared, F.lit(False)) | (s(main) == "")
    said = lambda kind, expected: F.struct(F.lit(kind).alias("kind"), expected.alias("expected"), main.alias("actual"))
    nothing = F.lit(None).cast("struct<kind:string,expected:string,actual:string>")
    database = F.contains(name, F.lit(DATABASE[0])) | F.contains(name, F.lit(DATABASE[1]))
    return cases([(F.coalesce(silent, F.lit(True)), nothing), ((row == DATABASE_ROW) & database, nothing), (row == DATABASE_ROW, said(DATABASE_KIND, F.lit(DATABASE_FILE))), (held, nothing)], said(NO_WORD, F.array_join(F.slice(words, 1, 5), ", ")))
