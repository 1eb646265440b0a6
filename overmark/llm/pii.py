"""Personal data by rules and by boosted candidates, in native expressions.

*Base* spans are the matches of four fixed formats (email, ip, card, phone)
that pass a check.  *Candidates* come from generators of high recall whose
spans may overlap: number-like runs, the parts of runs that are whole groups
of digits with 7 to 19 digits together, and spelled-out addresses.  Boosted trees
over small discrete features (format: digits, separators, dots, brackets;
context: neighbouring characters, cue words before) score them.  The trees
learn to tell candidates that a rule confirms from the others, without
seeing what the rules check (checksum, ranges, plus sign), so a candidate
that looks and stands like personal data is selected though no rule confirms
it.  They learn from whole runs and addresses; parts are only scored, so that
of two numbers side by side, or of one beside a base span, each can be found.
Selected candidates do not overlap base spans or each other.

Fitting needs counts per feature cell only.  These come from one aggregation
over all documents; there are at most ``CELLS`` cells, so the driver's part is
bounded.  Cells are counted in two folds: one fits the trees, the other the
calibration; a candidate counts from a calibrated probability of
``PiiParams.threshold``.  The trees are then plain CASE expressions.

Matches are marked in the text by two noncharacters and read off with their
code point offsets.  The formats are written without repeated groups, which
the regex engine would recurse on: a dot that ends no label is masked first
for email, and card runs are marked at their ends by look-around.

Defined cases: NULL text is empty and has no spans; noncharacters U+FDD0 to
U+FDD2 in a text count as U+FDD3; repeated rows give equal results; other
columns are not read; with no candidates, or none confirmed, nothing is added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
BEGIN, END, MASK, OTHER = "﷐", "﷑", "﷒", "﷓"
CUES = "mail|contact|phone|tel|call|mobile|fax|card|visa|account|ip|host|address"
#: feature -> number of values
FEATURES = {"shape": 2, "digits": 8, "seps": 4, "dots": 4, "brackets": 2, "before": 3, "after": 3, "cue": 2}
CELLS = 2 * int(np.prod(list(FEATURES.values())))
SPAN = "array<struct<kind:int,start:int,stop:int>>"
CANDIDATE = f"array<struct<start:int,stop:int,{','.join(f'{f}:int' for f in FEATURES)}>>"
RUN = r"\+?[0-9(][0-9\x20().-]{5,}[0-9]"


@dataclass(frozen=True)
class PiiParams:
    rounds: int = 20
    rate: float = 0.5
    threshold: float = 0.95


@dataclass(frozen=True)
class Boosted:
    """Trees of depth two, as (feature, cut, (feature, cut, low, high) twice);
    a value goes high from the cut on.  slope and shift calibrate the sum."""
    trees: tuple
    slope: float
    shift: float


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BEGIN + END + MASK, OTHER * 3)


def _mark(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"({pattern})", f"{BEGIN}$1{END}")


def _cut(marked: Column) -> Column:
    """array<struct<start, stop, match>> of the marked matches."""
    parts = F.split(marked, BEGIN)
    bare = lambda x: F.length(F.replace(x, F.lit(END), F.lit("")))
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(acc, x):
        match = F.substring_index(x, END, 1)
        one = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(match)).alias("stop"), match.alias("match"))
        return F.struct((acc["at"] + bare(x)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    first = F.struct(bare(F.element_at(parts, 1)).alias("at"), none.alias("out"))
    return F.aggregate(F.filter(parts, lambda _, i: i > 0), first, step, lambda acc: acc["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    def step(acc, i):
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) > 3, False).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _small_part)
    if kind == "card":
        n = _digits(match)
        return F.length(n).between(16, 19) & _luhn(n)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _marked(kind: str, text: Column) -> Column:
    if kind == "email":
        masked = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", MASK)
        return _mark(masked, f"[A-Za-z0-9._%+{MASK}-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+")
    if kind == "ip":
        return _mark(text, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    if kind == "card":
        begun = F.regexp_replace(text, r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){15})", BEGIN)
        return F.regexp_replace(begun, r"([0-9])(?![\x20-]?[0-9])", f"$1{END}")
    return _mark(text, r"\+[0-9][\x20().0-9-]+[0-9]")


#: what a text must hold for a kind to occur
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind's format, of a cleaned text."""
    k = KINDS.index(kind)
    good = F.filter(_cut(_marked(kind, text)), lambda x: _valid(kind, x["match"]))
    spans = F.transform(good, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return F.when(text.rlike(HINT[kind]), spans).otherwise(F.array().cast(SPAN))


def _side(c: Column) -> Column:
    return F.when(c.rlike(r"^[\x20\x09-\x0D]?$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def _cell(n: Column) -> Column:
    """Value of the feature digits for ``n`` digits."""
    return F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7)


def _around(text: Column, x: Column) -> tuple[Column, Column, Column]:
    """The features before, after and cue of the span ``x``."""
    near = F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
    return (_side(F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0))).alias("before"),
            _side(F.substring(text, x["stop"] + 1, F.lit(1))).alias("after"), near.rlike(f"(?i)(?:{CUES})").cast("int").alias("cue"))


def _count(x: Column, chars: str) -> Column:
    return F.length(x) - F.length(F.translate(x, chars, ""))


def parts(text: Column) -> Column:
    """Proposed spans inside the number runs of a cleaned text: neighbouring
    groups of digits, with the cue of their run."""
    runs = F.filter(_cut(_mark(text, RUN)), lambda x: x["match"].rlike("[0-9][^0-9]+[0-9]"))
    runs = F.transform(runs, lambda x: F.struct(            # gaps[i] stands before groups[i]
        x["start"].alias("start"), F.split(x["match"], "[0-9]+").alias("gaps"),
        F.filter(F.split(x["match"], "[^0-9]+"), lambda g: g != "").alias("groups"), *_around(text, x)))

    def place(acc, i, x):
        at = acc["at"] + F.length(x["gaps"][i])
        return F.struct((at + F.length(x["groups"][i])).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    runs = F.transform(runs, lambda x: F.struct(x["gaps"].alias("gaps"), x["groups"].alias("groups"), *(
        x[c].alias(c) for c in ("before", "after", "cue")), F.aggregate(
            F.sequence(F.lit(0), F.size(x["groups"]) - 1),
            F.struct(x["start"].alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, i: place(acc, i, x), lambda acc: acc["out"]).alias("at")))

    def grow(acc, j, i, x):
        """The span from group i, up to group j."""
        last = F.size(x["groups"]) - 1
        n = acc["n"] + F.length(x["groups"][j])
        gap = F.when(j > i, x["gaps"][j]).otherwise("")
        seps, dots, brackets = (acc[c] + _count(gap, chars) for c, chars in (("seps", " -"), ("dots", "."), ("brackets", "()")))
        outer = lambda end, own, inner: F.when(end, x[own]).when(inner, 0).otherwise(2).alias(own)
        one = F.struct(
            x["at"][i].alias("start"), (x["at"][j] + F.length(x["groups"][j])).alias("stop"), F.lit(0).alias("shape"),
            _cell(n).alias("digits"), F.least(seps, F.lit(3)).alias("seps"), F.least(dots, F.lit(3)).alias("dots"),
            F.least(brackets, F.lit(1)).alias("brackets"),
            outer((i == 0) & (x["gaps"][0] == ""), "before", x["gaps"][i].endswith(" ")),
            outer(j == last, "after", x["gaps"][j + 1].startswith(" ")), x["cue"].alias("cue"))
        fits = n.between(7, 19) & ~((i == 0) & (j == last))
        return F.struct(n.alias("n"), seps.alias("seps"), dots.alias("dots"), brackets.alias("brackets"),
                        F.when(fits, F.concat(acc["out"], F.array(one).cast(CANDIDATE))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(*(F.lit(0).alias(c) for c in ("n", "seps", "dots", "brackets")), F.array().cast(CANDIDATE).alias("out"))
    each = F.transform(runs, lambda x: F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(x["groups"]) - 1),
        lambda i: F.aggregate(F.sequence(i, F.least(i + 18, F.size(x["groups"]) - 1)), zero,
                              lambda acc, j: grow(acc, j, i, x), lambda acc: acc["out"]))))
    return F.when(text.rlike(r"[0-9][0-9\x20().-]{5}"), F.flatten(each)).otherwise(F.array().cast(CANDIDATE))


def candidates(text: Column) -> Column:
    """Proposed whole runs and addresses of a cleaned text with their features."""
    said = r"(?i)[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}(?:\.|\(dot\)|\[dot\])[A-Za-z]{2,}"

    def describe(x, shape):
        m = x["match"]
        return F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), F.lit(shape).alias("shape"),
            _cell(F.length(_digits(m))).alias("digits"),
            F.least(_count(m, " -"), F.lit(3)).alias("seps"), F.least(_count(m, "."), F.lit(3)).alias("dots"),
            F.least(_count(m, "()"), F.lit(1)).alias("brackets"), *_around(text, x))

    # a leading bracket or plus belongs to the span; the mark is the whole match
    number = F.transform(_cut(_mark(text, RUN)), lambda x: describe(x, 0))
    spelled = F.transform(_cut(_mark(text, said)), lambda x: describe(x, 1))
    return F.concat(F.when(text.rlike(r"[0-9][0-9\x20().-]{5}"), number).otherwise(F.array()).cast(CANDIDATE),
                    F.when(text.rlike(r"(?i)@|[(\[]at[)\]]"), spelled).otherwise(F.array()).cast(CANDIDATE))


def _overlaps(a, b):
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds __text (cleaned), __base and __cands."""
    out = docs.withColumn("__text", clean(F.col("text")))
    out = out.withColumn("__base", F.concat(*(base_spans(F.col("__text"), k) for k in KINDS)))
    return out.withColumn("__cands", candidates(F.col("__text")))


def fit(docs: DataFrame, p: PiiParams = PiiParams()) -> Boosted:
    """Trees from the counts per cell over all documents."""
    rows = with_spans(docs.select("text")).select(
        F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "__base",
        F.explode("__cands").alias("c")).select(
        "fold", "c.*", F.exists("__base", lambda b: _overlaps(b, F.col("c"))).cast("long").alias("yes"))
    cells = rows.groupBy("fold", *FEATURES).agg(F.count("*").alias("n"), F.sum("yes").alias("yes")).collect()
    table = np.array([[c[f] for f in ("fold", *FEATURES, "n", "yes")] for c in cells], float).reshape(-1, len(FEATURES) + 3)
    return boost(table[:, 0], table[:, 1:-2], table[:, -2], table[:, -1], p)


def boost(fold, x, n, yes, p: PiiParams) -> Boosted:
    """Gradient boosting of depth-two trees on weighted cells."""
    if not len(x) or not yes.sum():
        return Boosted((), 1.0, -30.0)
    fit_on, check = (fold == 0), (fold == 1)
    if not yes[fit_on].sum() or not yes[check].sum():
        fit_on = check = np.ones(len(x), bool)
    cuts = [(f, c) for f, size in enumerate(FEATURES.values()) for c in range(1, size)]
    high = np.stack([x[:, f] >= c for f, c in cuts])
    score, trees = np.zeros(len(x)), []

    def best(rows, g, h):
        """(gain, cut, low value, high value) of the best split of rows."""
        up = high[:, rows]
        gu, hu = up @ g[rows], up @ h[rows]
        gt, ht = g[rows].sum(), h[rows].sum()
        gain = gu ** 2 / (hu + 1) + (gt - gu) ** 2 / (ht - hu + 1)
        i = int(gain.argmax())
        return gain[i], i, (gt - gu[i]) / (ht - hu[i] + 1), gu[i] / (hu[i] + 1)

    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = np.where(fit_on, yes - n * q, 0.0), np.where(fit_on, n * q * (1 - q), 0.0)
        top = max(range(len(cuts)), key=lambda i: sum(best(np.flatnonzero(m), g, h)[0] for m in (high[i], ~high[i])))
        sides, add = [], np.zeros(len(x))
        for m in (~high[top], high[top]):
            _, i, low, up = best(np.flatnonzero(m), g, h)
            sides.append((*cuts[i], float(p.rate * low), float(p.rate * up)))
            add += m * np.where(high[i], p.rate * up, p.rate * low)
        trees.append((*cuts[top], *sides))
        score += add
    # calibration on the other fold
    a, b = 1.0, 0.0
    s, m, y = score[check], n[check], yes[check]
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        ga, gb = ((m * q - y) * s).sum() + 1e-2 * (a - 1), (m * q - y).sum() + 1e-2 * b
        w = m * q * (1 - q) + 1e-9
        haa, hab, hbb = (w * s * s).sum() + 1e-2, (w * s).sum(), w.sum() + 1e-2
        det = haa * hbb - hab * hab
        a -= float(np.clip((hbb * ga - hab * gb) / det, -1, 1))
        b -= float(np.clip((haa * gb - hab * ga) / det, -1, 1))
    return Boosted(tuple(trees), max(a, 1e-3), b)


def probability(c: Column, m: Boosted) -> Column:
    """Calibrated probability of a candidate, as an expression."""
    names = list(FEATURES)
    total = F.lit(0.0)
    for f, cut, low, high in m.trees:
        leaf = [F.when(c[names[g]] >= at, F.lit(up)).otherwise(F.lit(down)) for g, at, down, up in (low, high)]
        total = total + F.when(c[names[f]] >= cut, leaf[1]).otherwise(leaf[0])
    return 1 / (1 + F.exp(-(F.lit(m.slope) * total + F.lit(m.shift))))


def find(docs: DataFrame, m: Boosted, p: PiiParams = PiiParams()) -> DataFrame:
    """Adds to ``docs`` the arrays ``base_spans`` and ``all_spans`` of
    struct<kind, start, stop>, each by kind, then start; kinds count in the
    order of ``KINDS``."""
    out = with_spans(docs)
    # in the order of choice: what can be one number, the most probable, the first, the longest
    scored = F.transform(F.concat("__cands", parts(F.col("__text"))), lambda c: F.struct(
        ((c["shape"] == 0) & (c["digits"] == 7)).alias("over"), (-probability(c, m)).alias("p"), c["start"].alias("start"),
        (-c["stop"]).alias("last"), c["stop"].alias("stop"),
        F.when(c["shape"] == 1, 0).when(c["dots"] == 3, 1).when(c["digits"] >= 5, 2).otherwise(3).alias("kind")))
    free = F.filter(scored, lambda c: (c["p"] <= -p.threshold) & ~F.exists("__base", lambda b: _overlaps(b, c)))
    added = F.aggregate(F.array_sort(free), F.array().cast(SPAN), lambda acc, c: F.when(
        F.exists(acc, lambda d: _overlaps(c, d)), acc).otherwise(F.concat(acc, F.array(F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))).cast(SPAN))))
    return (out.withColumn("all_spans", F.array_sort(F.concat("__base", added)))
            .withColumn("base_spans", F.col("__base")).drop("__text", "__base", "__cands"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", names[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, m: Boosted, p: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its
    kind in square brackets; overlapping spans become one, named after the
    first.  Columns unchanged; NULL stays NULL."""
    found = find(docs.select(F.struct("*").alias("__row"), F.col("text").alias("text")), m, p)
    names = F.array(*map(F.lit, KINDS))
    by_start = F.array_sort(F.transform("all_spans", lambda x: F.struct(
        x["start"].alias("start"), (-x["stop"]).alias("neg"), x["kind"].alias("kind"))))

    def step(acc, x):
        stop = -x["neg"]
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), names[x["kind"]], F.lit("]"))
        return F.struct(F.greatest(acc["at"], stop).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(by_start, first, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("all_spans") > 0, done).otherwise(F.col("text"))
    return found.select(*(text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))
