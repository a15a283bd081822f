"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base matches of the four kinds always stay. Beside them, high-recall generators
propose overlapping spans: numbers that the greedy base patterns swallow together
with a neighbour, national phone numbers, grouped card numbers, disguised mail
addresses, colon addresses. Boosted trees score each proposal from its format
(digits, groups, check sum, separators) and its context (what stands before and
after); a threshold for each kind, set on held-out examples so that the share of
false ones stays under ``FALSE_SHARE``, selects what is added. Of overlapping
proposals the better one stays, and none that touches a base match is added.

The trees are trained on examples that ``examples`` writes out; they become one
nested CASE expression. Everything about a text happens within its row: there is
no shuffle, and a text of any length or number of matches is handled whole.

Defined cases: a null text is the empty text and has no spans; repeated rows stay
repeated; proposals of equal score go to the earlier start, then the longer; an
empty table gives an empty table; extra columns travel along in ``redact``.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

KINDS = ("email", "ip", "card", "phone")
CHUNK = 512  #: matches whose lengths are added up at once
CONTEXT = 24  #: characters before a proposal that its features see
FALSE_SHARE = 0.01

# Fixed values of the contract: the base patterns. The possessive quantifiers and
# the guard in front (not inside a run, unless a match has just ended) find the
# same matches without trying every place within a long run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": ".", "card": None, "phone": "+"}

GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9A-Za-z])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)

SPAN = "struct<kind:int,start:int,stop:int,base:boolean,val:string>"


def _sum(array: Column, of=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0), lambda s, x: s + of(x))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the lambdas in it use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _positions(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """All matches as spans. What lies between them gives the places: lengths are added up by chunks, then within a chunk."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("val"), F.length(gap).alias("gap"), F.length(m).alias("len")))
    step = lambda x: x["gap"] + x["len"]

    def placed(found: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))

        def place(sums: Column):
            def one(x: Column, i: Column) -> Column:
                chunk = F.floor(i / CHUNK).cast("int")
                start = _sum(F.slice(sums, F.lit(1), chunk)) + _sum(F.slice(found, chunk * CHUNK + 1, i % CHUNK), step) + x["gap"]
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["len"]).alias("stop"), F.lit(base).alias("base"), x["val"].alias("val"))

            return F.transform(found, one)

        places = let(F.transform(chunks, lambda k: _sum(F.slice(found, k * CHUNK + 1, F.lit(CHUNK)), step)), place)
        return F.when(F.size(found) > 0, places).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.filter(pairs, lambda x: x["val"].isNotNull()), placed)


def _digits(val: Column) -> Column:
    return F.regexp_replace(val, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def passes(ds: Column) -> Column:
        n = F.length(ds)

        def add(s: Column, i: Column) -> Column:
            d = F.substring(ds, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
            return s + d - F.when(d > 9, 9).otherwise(0)

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)

    return let(digits, passes)


def _octet(part: Column) -> Column:
    """A part of a dotted address is at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= F.lit("255"))


def _valid(kind: str, val: Column) -> Column:
    digits = _digits(val)
    if kind == "ip":
        return F.forall(F.split(val, r"\.", -1), _octet)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda s: _valid(kind, s["val"])


def base_spans(text: Column, any_digit: Column) -> Column:
    """Base matches of all kinds, failing ones dropped."""
    none = F.array().cast(f"array<{SPAN}>")
    out = []
    for k, kind in enumerate(KINDS):
        guard = any_digit if GUARD[kind] is None else F.contains(text, F.lit(GUARD[kind])) & (any_digit | F.lit(kind == "email"))
        out.append(F.when(guard, F.filter(_positions(text, BASE[kind], k, True), _passes(kind))).otherwise(none))
    return F.concat(*out)


def proposals(text: Column, any_digit: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    some = F.when
    out = []
    for kind, pattern in GENERATORS:
        guard = F.contains(text, F.lit("@")) | F.rlike(text, F.lit(r"[\[({]at[\])}]| at [A-Za-z0-9-]++ dot ")) if kind == "email" else any_digit
        if "+" == pattern[1:2]:
            guard = guard & F.contains(text, F.lit("+"))
        out.append(some(guard, _positions(text, pattern, KINDS.index(kind), False)).otherwise(none))
    return F.array_distinct(F.concat(*out))


def features(text: Column, s: Column) -> dict[str, Column]:
    """Format and context of a span, all numbers."""
    val, n = s["val"], F.length(s["val"])
    digits = _digits(val)
    before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    after = F.substring(text, s["stop"] + 1, F.lit(2))
    flag = lambda c: c.cast("int")
    said = lambda p: flag(F.rlike(before, F.lit(p)))
    return {
        "kind": s["kind"],
        "length": n,
        "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(val, "[^A-Za-z]", "")),
        "groups": F.size(F.split(val, "[^0-9]+")),
        "spaces": F.length(F.regexp_replace(val, "[^ ]", "")),
        "plus": flag(F.startswith(val, F.lit("+"))),
        "luhn": flag(luhn(digits)),
        "same": flag(F.rlike(digits, F.lit(r"^(.)\1*$"))),
        "issuer": flag(F.rlike(digits, F.lit("^(4|5[1-5]|2[2-7]|3[47]|6)"))),
        "zero": flag(F.startswith(digits, F.lit("0"))),
        "at": flag(F.contains(val, F.lit("@"))),
        "marked": flag(F.rlike(val, F.lit(r"[\[({](?:at|dot)[\])}]"))),
        "dots": F.length(F.regexp_replace(val, "[^.]", "")),
        "domain": flag(F.rlike(val, F.lit(r"(?i)(?:\.|dot[\])} ] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it)$"))),
        "blank at": flag(F.rlike(val, F.lit(" at | dot "))),
        "octets": flag(F.forall(F.split(val, r"[.:]", -1), lambda p: F.rlike(p, F.lit("^[0-9]+$")) & _octet(p))),
        "joined before": said(r"[0-9a-z_]$"),
        "stuck before": said(r"[.:/@=#-]$"),
        "joined after": flag(F.rlike(after, F.lit(r"^[0-9A-Za-z_]|^[.:/@=-][0-9A-Za-z]"))),
        "says phone": said(r"phone|tel|call|mobil|fax|whatsapp|contact"),
        "says card": said(r"card|visa|credit|master|amex|payment|pan\b"),
        "says mail": said(r"mail|contact|write|address"),
        "says net": said(r"\bip\b|host|server|addr|client|from"),
        "says other": said(r"version|v\.? ?$|order|invoice|isbn|serial|build|release|section|ticket|model|item|part no|sku|ref"),
    }


# Training: labelled examples, regression trees on the logistic loss, thresholds.


def examples(n: int = 3000, seed: int = 5) -> list[dict]:
    """Labelled spans in their texts: written-out personal data, and numbers and phrases that only look like it."""
    rng = random.Random(seed)
    word = lambda lo=2, hi=9: "".join(rng.choice("aeiourstlnmdbé") for _ in range(rng.randint(lo, hi)))
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def checked(body: str) -> str:
        total = sum((d := int(c) * (1 + (i + 1) % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def broken(number: str) -> str:
        return number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)

    def grouped(number: str) -> str:
        return rng.choice([number, number, " ".join(number[i : i + 4] for i in range(0, 16, 4)), "-".join(number[i : i + 4] for i in range(0, 16, 4))]) if len(number) == 16 else number

    def case() -> tuple[int, str, str, str, int]:
        kind, good = rng.randrange(4), rng.random() < 0.5
        before, after = " ".join(word() for _ in range(rng.randint(0, 4))) + " ", rng.choice([" ", ". ", ", ", "", ".\n"]) + word()
        if after[:1].isalpha():
            after = " " + after
        if kind == 0:
            user, host = word() + rng.choice(["", "." + word(), digit(2)]), word() + rng.choice(["", digit(1)])
            if good:
                at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("@", "."), (" [at] ", ".")])
                return 0, before + rng.choice(["", "mail ", "contact "]), user + at + host + dot + rng.choice(["com", "org", "net", "de", "fr", "es"]), after, 1
            return 0, before, rng.choice([f"{user} at {host}.{word(2, 6)}", f"{user} at {host} . {word(3, 7)}", f"{user} at {host} dot {word()}", f"{user} @ {word()}. {word()}"]), after, 0
        if kind == 1:
            if rng.random() < 0.3:
                v = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4))) for _ in range(8))
                return 1, before, v, after, 1
            v = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            if good:
                return 1, before + rng.choice(["", "ip ", "server "]), v, after, 1
            if rng.random() < 0.5:
                return 1, before + rng.choice(["version ", "section ", "build ", "release "]), v, after, 0
            wild = [str(rng.randint(0, 255)) for _ in range(4)]
            wild[rng.randrange(4)] = str(rng.randint(256, 999))
            return 1, before + rng.choice(["", "ip "]), ".".join(wild), after, 0
        if kind == 2:
            number = checked(rng.choice("43562") + digit(rng.choice([14, 14, 14, 13, 17])))
            if good and len(number) in (15, 16):
                number = checked(rng.choice(["4" + digit(14), "5" + rng.choice("12345") + digit(13), "6" + digit(14), "37" + digit(12)]))
                return 2, before + rng.choice(["", "", "card ", "visa ", f"{rng.randint(1, 255)} ", f"+1 ({digit(3)}) 555-{digit(4)} "]), grouped(number), after, 1
            return 2, before + rng.choice(["order ", "", "invoice ", "serial "]), grouped(rng.choice([broken(number), broken(number), broken(checked("4" + digit(14))), broken(checked("5" + digit(14))), digit(13), digit(14), digit(19), "0" * 16, checked("0" + digit(12)), "1" + digit(12)])), after, 0
        if good:
            v = rng.choice(["+1 ({0}) {1}-{2}", "+1 ({0}) {1}-{2}", "+1 {0} {1} {2}", "+1-{0}-{1}-{2}", "({0}) {1}-{2}", "+49 {0} {1} {2}", "+33 {0} {1} {2}", "{0}-{1}-{2}"]).format(digit(3), digit(3), digit(4))
            return 3, before + ("" if v[0] in "+(" else rng.choice(["tel ", "call ", "phone: "])), v, rng.choice([after, " " + digit(16), f" {digit(2)}.{digit(2)}.{digit(2)}.{digit(2)}"]), 1
        v = rng.choice([f"+{digit(2)} {digit(1)} {digit(2)} {digit(2)}", f"{digit(3)} {digit(3)} {digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}"])
        return 3, before + rng.choice(["order ", "isbn ", "", "ref ", "serial ", "part no "]), v, after if v[0] != "+" else rng.choice(["%", "/" + digit(1)]) + after, 0

    out = []
    for _ in range(n):
        kind, before, val, after, label = case()
        out.append({"text": before + val + after, "s": {"kind": kind, "start": len(before), "stop": len(before) + len(val), "base": False, "val": val}, "label": label})
    return out


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int = 8):
    """A regression tree as nested (feature, threshold, left, right); a leaf is its Newton step."""
    leaf = float(grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-3
    whole = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            score = g[cut] ** 2 / (h[cut] + 1.0) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1.0) - whole
            k = int(score.argmax())
            if score[k] > gain:
                best, gain = (f, float(v[cut[k]] + v[cut[k] + 1]) / 2), score[k]
    if best is None:
        return leaf
    left = x[:, best[0]] <= best[1]
    return (*best, grow(x[left], grad[left], hess[left], depth - 1, least), grow(x[~left], grad[~left], hess[~left], depth - 1, least))


def walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = walk(tree[2], x[left]), walk(tree[3], x[~left])
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 4, rate: float = 0.3) -> list:
    out, z = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        out.append(grow(x, y - p, p * (1 - p), depth))
        z += rate * walk(out[-1], x)
    return out


class Scorer:
    def __init__(self, names: list[str], trees: list, thresholds: list[float], rate: float = 0.3):
        self.names, self.trees, self.thresholds, self.rate = names, trees, thresholds, rate

    def logit(self, values: dict[str, Column]) -> Column:
        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(values[self.names[tree[0]]] <= F.lit(tree[1]), case(tree[2])).otherwise(case(tree[3]))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + case(t) * F.lit(self.rate)
        return total

    def threshold(self, kind: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(t)) for t in self.thresholds]), kind + 1)


_scorers: dict[str, Scorer] = {}


def fit(spark: SparkSession, n: int = 3000) -> Scorer:
    """Train on the written-out examples; their features come from the same expressions as those of real texts."""
    key = str(n)
    if key in _scorers:
        return _scorers[key]
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(n))), f"array<struct<text:string,s:{SPAN},label:int>>")).alias("e"))
    made = rows.select(F.col("e.label").alias("label"), *[c.cast("double").alias(k) for k, c in features(F.col("e.text"), F.col("e.s")).items()])
    names = made.columns[1:]
    table = np.array([list(r) for r in made.collect()], float)  # bounded: n rows
    y, x = table[:, 0], table[:, 1:]
    held = np.arange(len(y)) % 4 == 0
    trees = boost(x[~held], y[~held])
    z = sum(0.3 * walk(t, x[held]) for t in trees)
    thresholds = []
    for k in range(len(KINDS)):
        mine = x[held][:, names.index("kind")] == k
        order = np.argsort(-z[mine])
        good, score = y[held][mine][order], z[mine][order]
        false = np.cumsum(1 - good) / np.arange(1, len(good) + 1)
        last = np.flatnonzero(false <= FALSE_SHARE)
        # midway between the last that is let in and the first that is not
        thresholds.append(max(0.5, float(score[last[-1] : last[-1] + 2].mean())) if len(last) else 1e9)
    _scorers[key] = Scorer(names, trees, thresholds)
    return _scorers[key]


def select(spans: Column) -> Column:
    """Of scored proposals the best one, then the best that does not overlap it, and so on.

    Better is a higher score, then the earlier start, the longer span, the kind
    listed first. In order of start, overlapping proposals follow one another, so
    the choice is made within each unbroken chain of them.
    """
    kind = "array<struct<start:int,stop:int,kind:int,base:boolean,val:string,score:double>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in ("start", "stop", "kind", "base", "val", "score")])))
    none = F.array().cast(kind)
    clash = lambda s, o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])

    def greedy(chain: Column) -> Column:
        ranked = F.array_sort(F.transform(chain, lambda s: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), (-s["stop"]).alias("c"), s["kind"].alias("d"), s.alias("s"))))
        return F.aggregate(F.transform(ranked, lambda r: r["s"]), none, lambda kept, s: F.when(F.exists(kept, lambda o: clash(s, o)), kept).otherwise(F.concat(kept, F.array(s))))

    def step(state: Column, s: Column) -> Column:
        joins = s["start"] < state["reach"]
        return F.struct(
            F.when(joins, state["kept"]).otherwise(F.concat(state["kept"], greedy(state["chain"]))).alias("kept"),
            F.when(joins, F.concat(state["chain"], F.array(s))).otherwise(F.array(s)).alias("chain"),
            F.when(joins, F.greatest(state["reach"], s["stop"])).otherwise(s["stop"]).alias("reach"),
        )

    start = F.struct(none.alias("kept"), none.alias("chain"), F.lit(0).alias("reach"))
    return F.aggregate(ordered, start, step, lambda state: F.concat(state["kept"], greedy(state["chain"])))


def find_pii(df: DataFrame, text_col: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (kind number, start, stop, val), by kind, then start; columns of these names are replaced."""
    scorer = scorer or fit(df.sparkSession)
    rows = df.withColumn("_pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col("_pii_text")
    rows = rows.withColumn("_pii_digit", F.rlike(text, F.lit("[0-9]")))
    rows = rows.withColumn("base", base_spans(text, F.col("_pii_digit"))).withColumn("_pii_new", proposals(text, F.col("_pii_digit")))
    # a proposal equal to a base match, or within one of its kind, has nothing to add
    fresh = F.filter("_pii_new", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    rows = rows.withColumn("_pii_new", F.when(F.size("_pii_new") > 0, fresh).otherwise(F.col("_pii_new")))
    described = F.transform("_pii_new", lambda s: F.struct(s.alias("s"), *[c.cast("double").alias(f"f{k}") for k, c in enumerate(features(text, s).values())]))
    rows = rows.withColumn("_pii_new", F.when(F.size("_pii_new") > 0, described))
    fields = ("kind", "start", "stop", "base", "val")
    named = lambda s: F.struct(*[s[k].alias(k) for k in fields])
    scored = F.transform("_pii_new", lambda d: F.struct(*[d["s"][k].alias(k) for k in fields], scorer.logit({n: d[f"f{k}"] for k, n in enumerate(scorer.names)}).alias("score")))
    rows = rows.withColumn("_pii_new", F.filter(scored, lambda s: s["score"] >= scorer.threshold(s["kind"])))
    flat = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["val"].alias("val"))))
    # none of them touches a base match, so the choice is among themselves
    every = F.when(F.size("_pii_new") > 0, F.concat("base", F.transform(select(F.col("_pii_new")), named))).otherwise(F.col("base"))
    return rows.withColumn("spans", flat(every)).withColumn("base", flat("base")).drop("_pii_text", "_pii_digit", "_pii_new")


def joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each span of its text replaced by the kind in brackets; overlapping spans become one. Null stays null."""
    given = df.columns
    x = find_pii(df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(given)]), f"_c{given.index(text_col)}")
    text = F.col(f"_c{given.index(text_col)}")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,stop:int,kind:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joint = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))
        return F.when(F.coalesce(last["stop"] > s["start"], F.lit(False)), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joint))).otherwise(F.concat(done, F.array(s)))

    x = x.withColumn("spans", F.when(F.size("spans") > 0, F.aggregate(order, none, merge)).otherwise(none))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        at = F.when(i > 0, F.try_element_at(F.col("spans"), i)["stop"]).otherwise(0)
        return F.concat(F.substring(text, at + 1, s["start"] - at), F.element_at(names, s["kind"] + 1))

    tail = F.substring(text, F.element_at("spans", -1)["stop"] + 1, F.length(text))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), tail)).otherwise(text)
    return x.select(*[(clean if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(given)])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    x = find_pii(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return x.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
