"""Personal data: fixed patterns, and candidate spans selected by gradient boosting. DataFrame functions and Spark's own trees only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed patterns, leftmost matches. They match what the plain forms match ([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on) but
#: never try again within a run that has failed, so long runs take linear time and no deep recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_WHOLE = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
#: High-recall generators of further candidates: kind, pattern, a sign without which a text has none.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++", r"@|\[at\]|\(at\)"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])", "[0-9]"),
    ("card", r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])", "[0-9]"),
    ("phone", r"(?<![0-9])(?:\+|00)?\(?[0-9]{2,4}\)?[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9])", "[0-9]"),
    ("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", None),
)
#: Documents (about so many) whose text trees learn from, planted spans and decoys (about so many) of each kind in it, and candidates (at
#: most) of either sort that trees are fitted and thresholds set on: those with the least hash.
FIT_DOCS, PLANTS, FIT_ROWS = 4_000, 1_000, 10_000
TREES, TREE_DEPTH = 8, 3
#: Share of right labels among the selected of each kind, in the half of the sample that the trees haven't seen.
PRECISION = 0.97
FEATURES = ("generator", "length", "digits", "letters", "upper", "runs", "marks", "hex", "before", "after", "first", "assigned", "named", "spelled", "luhn", "range", "whole")
_SPAN = "array<struct<text:string,start:int,end:int>>"
_BLOCK = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use).getItem(0)


def _running(lengths: Column) -> Column:
    """Sums of what stands before each element; in blocks, so that appending to arrays stays cheap for texts with many matches."""

    def short(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(x, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")))

    def whole(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda k: short(F.slice(x, k * _BLOCK + 1, F.lit(_BLOCK))))
        return _once(blocks, lambda b: F.flatten(F.zip_with(b, short(F.transform(b, lambda t: t["s"]))["a"], lambda t, at: F.transform(t["a"], lambda v: v + at))))

    return _once(lengths, whole)


def spans_of(text: Column, pattern: str, there: Column) -> Column:
    """array<struct<text, start, end>>: all leftmost matches with their code points, end exclusive; none unless ``there``.

    Spark gives matches without their places, but also what stands between them, and so the places.
    """
    none = F.array().cast(_SPAN)
    hits = F.when(there, F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)).otherwise(F.array().cast("array<string>"))

    def place(h: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)), lambda g: F.length(g))
        both = F.zip_with(gaps, h, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("len")))
        sums = lambda b: _running(F.transform(b, lambda x: x["gap"] + x["len"]))
        return _once(both, lambda b: _once(sums(b), lambda s: F.transform(h, lambda m, i: F.struct(m.alias("text"), (s[i] + b[i]["gap"]).alias("start"), (s[i] + b[i]["gap"] + b[i]["len"]).alias("end")))))

    return _once(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(place(h)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))


def luhn(digits: Column) -> Column:
    return luhn_sum(digits) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns' spans by kind; a match that fails its check is dropped, without another try in its place."""
    number = text.rlike("[0-9]")

    def card(s: Column) -> Column:
        return _once(_digits(s["text"]), lambda d: F.length(d).between(13, 19) & luhn(d))

    return {
        "email": spans_of(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans_of(text, IP, number & F.contains(text, F.lit("."))), lambda s: s["text"].rlike(PARTS)),
        "card": F.filter(spans_of(text, CARD, number), card),
        "phone": F.filter(spans_of(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["text"])).between(9, 15)),
    }


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _class(ch: Column) -> Column:
    return F.when(F.length(ch) == 0, 0).when(ch.rlike(r"[\s]"), 1).when(ch.rlike("[0-9]"), 2).when(ch.rlike(r"\p{L}"), 3).when(ch.rlike("[.,;:!?]"), 4).otherwise(5)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<kind, start, end, known, doubtful, features...>>: what the generators propose. ``known``: it overlaps a fixed span (``base``:
    array<struct<kind, start, end>>). ``doubtful``: it may well be of its kind, so it is no example of what is not."""
    parts = []
    for kind, pattern, sign in GENERATORS:
        there = F.lit(True) if sign is None else text.rlike(sign)
        parts.append(F.transform(spans_of(text, pattern, there), _describe(text, base, kind)))
    return F.concat(*parts)


def _plain_email(m: Column, cue: Column) -> Column:
    """An address with its spelled-out signs as signs; spaces around a plain @ go where a cue stands before."""
    signs = F.regexp_replace(F.regexp_replace(m, r" ?(?:\[at\]|\(at\)) ?", "@"), r" ?(?:\[dot\]|\(dot\)) ?", ".")
    return F.when(cue, F.regexp_replace(signs, " ?@ ?", "@")).otherwise(signs)


def doubtful(kind: str, m: Column, named: Column, checked: Column, whole: Column, hexa: Column) -> Column:
    """Whether a candidate that stands in a text by itself may be personal data: its digits pass the check of their kind, it is an address once
    its signs are plain, or it is hexadecimal."""
    if kind == "email":
        return whole
    if kind in ("ip", "card"):
        return checked
    if kind == "phone":
        return checked & ((named == 2) | m.rlike(r"^(?:\+|00)|^\([0-9]{3}\)|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"))
    return hexa


def _checked(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.translate(m, ",", ".").rlike(PARTS)
    if kind == "card":
        return _once(_digits(m), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(False)


def _describe(text: Column, base: Column, kind: str) -> Callable[[Column], Column]:
    def features(s: Column, x: Column) -> Column:
        m, b = s["text"], F.lower(x["b"])
        count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
        named = F.when(b.rlike("mail"), 1).when(b.rlike("tel|phone|call|fon"), 2).when(b.rlike("card|visa|iban"), 3).when(b.rlike(r"\bip\b|host|addr"), 4).when(b.rlike("token|key|secret|passw"), 5).otherwise(0)
        assigned = b.rlike("[=:] ?[\"']?$")
        overlaps = F.exists(base, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
        hexa = m.rlike("^[0-9a-fA-F]{32,}$")
        spelled, checked = m.rlike(r"\[(?:at|dot)\]|\((?:at|dot)\)"), _checked(kind, m)
        whole = _once(_plain_email(m, named == 1), lambda n: n.rlike(f"^{EMAIL_WHOLE}$") & n.rlike(r"\.[A-Za-z]{2,}$")) if kind == "email" else F.lit(False)
        values = (F.lit(KINDS.index(kind)), F.length(m), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[0-9]+"), count("[^A-Za-z0-9]"), hexa.cast("int"), _class(F.substring(x["b"], -1, 1)), _class(x["a"]), _class(F.substring(m, 1, 1)), assigned.cast("int"), named, spelled.cast("int"), (F.lit(kind == "card") & checked).cast("int"), (F.lit(kind in ("ip", "phone")) & checked).cast("int"), whole.cast("int"))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), overlaps.alias("known"), doubtful(kind, m, named, checked, whole, hexa).alias("doubtful"), *[v.cast("double").alias(n) for n, v in zip(FEATURES, values)])

    def describe(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
        return _once(F.struct(before.alias("b"), F.substring(text, s["end"] + 1, F.lit(1)).alias("a")), lambda x: features(s, x))

    return describe


class Booster:
    """Boosted trees of each kind as an expression, with the least probability that selects its candidates; kinds without trees are never
    selected."""

    def __init__(self, kinds: dict[str, tuple[Callable[[Column], Column], float]]):
        self.kinds = kinds

    def selects(self, c: Column) -> Column:
        chosen = F.lit(False)
        for kind, (margin, threshold) in self.kinds.items():
            chosen = F.when(c["generator"] == KINDS.index(kind), probability(margin(c)) >= threshold).otherwise(chosen)
        return chosen


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))


def _tree(lines: list[str]) -> Callable[[Column], Column]:
    """A fitted tree's printed form as an expression on a struct of features."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        value = float(m[1])
        return lambda c: F.lit(value)
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    name, cut = FEATURES[int(m[1])], float(m[2])
    low = _tree(lines)
    lines.pop(0)  # Else
    high = _tree(lines)
    return lambda c: F.when(c[name] <= cut, low(c)).otherwise(high(c))


def _pick(h: Column, at: int, choices: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.xxhash64(h, F.lit(at)), F.lit(len(choices))) + 1).cast("int"))


def _some(h: Column, at: int, digits: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(h, F.lit(at)), F.lit(10**digits)).cast("string"), digits, "0")


_WORDS = ("meet", "noon", "then", "prices", "row", "page", "stand", "five", "once", "gate", "anna", "mail", "info", "peter", "shop", "north")
_CUES = {
    "email": ("email: ", "mail ", "write to ", "contact ", "e-mail me at "), "ip": ("ip ", "host ", "address ", "ip: ", "server at "), "card": ("card ", "visa ", "credit card: ", "paid with ", "card no. "),
    "phone": ("call ", "tel. ", "phone: ", "my number is ", "fon "), "secret": ("token=", "api_key: ", "password = ", "secret:", 'the key = "'),
}
_OTHER_CUES = ("row ", "order ", "see ", "page ", "about ", "path=", "", "no. ", "id: ", "version ")


def _form(h: Column, at: int, *forms: Column) -> Column:
    return F.element_at(F.array(*forms), (F.pmod(F.xxhash64(h, F.lit(at)), F.lit(len(forms))) + 1).cast("int"))


def _planted(h: Column) -> dict[tuple[str, bool], Column]:
    """Made-up spans of each kind in forms that the fixed patterns miss, and decoys in the same forms that fail the kind's own check: a wrong
    check digit or number of digits, parts out of range, no domain, no hexadecimal digits."""
    word, some = lambda at: _pick(h, at, _WORDS), lambda at, n: _some(h, at, n)
    part = lambda at: F.pmod(F.xxhash64(h, F.lit(at)), F.lit(256)).cast("string")
    large = lambda at: (F.pmod(F.xxhash64(h, F.lit(at)), F.lit(744)) + 256).cast("string")
    at, dot = _pick(h, 1, (" [at] ", " (at) ", "[at]", "(at)")), _pick(h, 5, (" [dot] ", "(dot)", " (dot) ", "[dot]", "."))
    domain = _pick(h, 6, ("com", "org", "net", "de", "example", "info"))
    host = _form(h, 65, word(4), word(4), F.concat(word(4), some(66, 1)), F.concat(word(4), F.lit("-"), word(67)), F.concat(word(4), dot, word(67)))
    address = F.concat(word(2), _form(h, 36, F.lit(""), some(3, 1), some(3, 2), some(3, 3), some(3, 4), F.concat(F.lit("."), word(37)), F.concat(F.lit("_"), word(37))), at, host, dot, domain)
    # What stands around an at-sign in running text: no domain, one of digits or of a letter, or the next sentence.
    spoken = _form(h, 38, F.concat(word(14), at, word(16), F.lit(". "), F.initcap(word(17))), F.concat(word(14), at, word(16), F.lit("."), some(39, 2)), F.concat(word(14), at, some(40, 1), dot, some(41, 2)), F.concat(word(14), F.lit(" @ "), word(16), F.lit(" . "), F.initcap(word(17))))
    number = F.concat(_pick(h, 7, ("4", "5", "3", "6")), some(8, 14))

    def grouped(d: Column) -> Column:
        return F.concat_ws(".", *[F.substring(d, 4 * i + 1, 4) for i in range(4)])

    def card(wrong: Column) -> Column:
        check = F.pmod(F.lit(10) - luhn_sum(F.concat(number, F.lit("0"))) % 10 + wrong, F.lit(10)).cast("string")
        return F.concat(number, check)

    other = F.pmod(F.xxhash64(h, F.lit(26)), F.lit(9)) + 1
    a, b, c, d = F.concat(F.lit("2"), some(10, 2)), some(11, 3), some(12, 4), some(13, 2)
    phone = _form(h, 43, F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat(a, F.lit("-"), b, F.lit("-"), c), F.concat(F.lit("00"), d, F.lit(" "), b, F.lit(" "), c), F.concat(a, F.lit("."), b, F.lit("."), c), F.concat(a, F.lit(" "), b, F.lit(" "), c))
    few = _form(h, 44, F.concat(d, F.lit("-"), b, F.lit(" "), b), F.concat(d, F.lit(" "), b, F.lit("."), b), F.concat(F.lit("("), d, F.lit(") "), b, F.lit("-"), some(45, 3)), F.concat(d, F.lit("."), b, F.lit("-"), b), F.concat(some(46, 4), F.lit(" "), b, F.lit(" "), c, F.lit(" "), some(47, 4), F.lit(" ")))
    hexa = F.substring(F.sha2(h.cast("string"), 256), 1, _form(h, 48, F.lit(32), F.lit(40), F.lit(64)))
    letters = lambda n: F.substring(F.translate(F.sha2(h.cast("string"), 256), "0123456789", "ghijklmnop"), 1, n)
    return {
        ("email", True): address, ("email", False): spoken,
        ("ip", True): F.concat_ws(",", part(18), part(19), part(20), part(21)), ("ip", False): _form(h, 22, F.concat_ws(",", some(23, 1), some(24, 3), some(25, 3), large(49)), F.concat_ws(",", part(50), large(51), part(52), part(53)), F.concat_ws(".", part(50), part(52), large(51), part(53)), F.concat_ws(",", large(54), large(55), large(56), large(57))),
        ("card", True): grouped(card(F.lit(0))), ("card", False): _form(h, 58, grouped(card(other)), grouped(card(other)), F.concat_ws(".", some(59, 4), some(60, 4), some(61, 4)), card(other), some(62, 12)),
        ("phone", True): phone, ("phone", False): few,
        ("secret", True): hexa, ("secret", False): _form(h, 63, letters(26), F.concat_ws("/", letters(9), word(29), letters(7), word(30)), F.translate(hexa, "abc", "xyz"), F.substring(hexa, 1, 24)),
    }


def plants(docs: DataFrame, repeats: int) -> DataFrame:
    """(luck, label, features...) of candidates where made-up spans and decoys (``_planted``) stand between pieces of the texts of ``docs``
    (doc_id, _text). Labels come from the planting alone; the words before a span are drawn alike for both, those of its kind three times in
    five, so that they tell nothing about the label, while a secret's label is also false without an assignment before it."""
    h = F.xxhash64("doc_id", "_text", "kind", "truth", "again")
    sorts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("truth")) for k in KINDS for t in (True, False)])).alias("s")
    rows = docs.select("doc_id", "_text", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("again"), sorts).select("doc_id", "_text", "again", "s.*").withColumn("h", h)
    made, hc = F, F.col("h")
    for (kind, truth), value in _planted(hc).items():
        made = made.when((F.col("kind") == kind) & (F.col("truth") == F.lit(truth)), value)
    cue = F
    for kind, cues in _CUES.items():
        cue = cue.when((F.col("kind") == kind) & (F.pmod(F.xxhash64(hc, F.lit(64)), F.lit(5)) < 3), _pick(hc, 31, cues))
    slice_ = lambda at, n: F.substring(F.col("_text"), (F.pmod(F.xxhash64(hc, F.lit(at)), F.greatest(F.length("_text"), F.lit(1))) + 1).cast("int"), F.lit(n))
    parts = rows.select("h", "kind", "truth", F.concat(slice_(32, 40), F.lit(" "), cue.otherwise(_pick(hc, 33, _OTHER_CUES))).alias("before"), made.alias("made"), F.concat(_pick(hc, 34, (" ", ".", ", ", "\n", '" ')), slice_(35, 20)).alias("after"))
    text = parts.select("h", "kind", "truth", F.length("before").alias("start"), (F.length("before") + F.length("made")).alias("end"), F.concat("before", "made", "after").alias("_text"))
    spans = base_spans(F.col("_text"))
    flat = F.concat(*[F.transform(spans[k], _of_kind(k)) for k in KINDS if k in spans])
    each = text.select("h", "kind", "truth", "start", "end", F.explode(_once(flat, lambda b: candidates(F.col("_text"), b))).alias("c"))
    hit = each.filter((F.col("c.kind") == F.col("kind")) & (F.col("c.start") < F.col("end")) & (F.col("start") < F.col("c.end")) & ~F.col("c.known"))
    # A piece of a planted span is no right find.
    right = F.col("truth") & (F.col("c.start") <= F.col("start")) & (F.col("c.end") >= F.col("end"))
    return hit.select(F.col("h").alias("luck"), right.cast("double").alias("label"), *[f"c.{n}" for n in FEATURES])


def fit(rows: DataFrame, trees: int = TREES, depth: int = TREE_DEPTH, precision: float = PRECISION) -> Booster:
    """Fit each kind's trees on half of its rows (luck, a hash; label; FEATURES), and set its threshold on the other: the least one above which
    ``precision`` of the candidates have their label, and half of the way to the next candidate below. A kind with rows of one label
    only selects nothing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = stored(rows.select("luck", "label", *FEATURES).repartition(1).sortWithinPartitions("luck", *FEATURES))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    kinds = {}
    for kind in KINDS:
        of_kind = ready.filter(F.col("generator") == KINDS.index(kind)).coalesce(1)
        half = of_kind.filter(F.col("luck") % 2 == 0).cache()
        if half.select("label").distinct().count() == 2:
            model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=5).fit(half)
            parts = [(_tree([x for x in tree.toDebugString.splitlines()[1:] if x.strip()]), float(weight)) for tree, weight in zip(model.trees, model.treeWeights)]
            margin = lambda c, parts=parts: sum((t(c) * w for t, w in parts), F.lit(0.0))
            seen = of_kind.filter(F.col("luck") % 2 != 0).select("label", F.round(probability(margin(F.struct(*FEATURES))), 6).alias("p"))
            points = sorted(map(tuple, seen.groupBy("p").agg(F.count("*"), F.sum("label")).collect()), reverse=True)  # at most 2 * FIT_ROWS rows
            n = right = 0.0
            for k, (p, count, good) in enumerate(points):
                n, right = n + count, right + good
                if right and right / n >= precision:
                    kinds[kind] = margin, (p + (points[k + 1][0] if k + 1 < len(points) else 0.0)) / 2
        half.unpersist()
    return Booster(kinds)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _found(rows: DataFrame) -> DataFrame:
    """``doc_id``, base (array<struct<kind, start, end>>, by kind as in KINDS, then start) and found (array of candidates) of (doc_id, _text)."""
    spans = base_spans(F.col("_text"))
    flat = F.concat(*[F.transform(spans[k], _of_kind(k)) for k in KINDS if k in spans])
    return rows.select("doc_id", _once(flat, lambda b: F.struct(b.alias("base"), candidates(F.col("_text"), b).alias("found"))).alias("p")).select("doc_id", "p.*")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, planted: int = PLANTS, fit_rows: int = FIT_ROWS, **how) -> Booster:
    """A ``Booster`` from about ``fit_docs`` documents: planted spans and decoys in their text, and candidates that stand in them by themselves,
    are not doubtful and overlap no fixed span, as further examples of what is not personal data."""
    luck = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 32))
    sample = stored(_texts(docs, id_col, text_col).filter(luck.cast("double") * float(max(1, docs.count())) < float(fit_docs << 32)))
    n = sample.count()
    if not n:
        return Booster({})
    some = sample.orderBy(luck).limit(planted)
    made = plants(some, max(1, round(planted / min(n, planted))))
    each = _found(sample).select("doc_id", F.explode("found").alias("c")).filter(~F.col("c.known") & ~F.col("c.doubtful"))
    own = each.select(F.xxhash64("doc_id", "c.kind", "c.start").alias("luck"), F.lit(0.0).alias("label"), *[f"c.{n}" for n in FEATURES])
    least = lambda rows: rows.orderBy("luck", *FEATURES).limit(fit_rows)
    return fit(least(made).unionByName(least(own)), **how)


def all_spans(base: Column, found: Column, booster: Booster) -> Column:
    """array<struct<kind, start, end>>: the fixed spans, and the selected candidates that overlap none of them; by kind, then start."""
    chosen = F.transform(F.filter(found, lambda c: ~c["known"] & booster.selects(c)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat(base, chosen), lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", booster: Booster | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, spans (both array<struct<kind, start, end>>, code points, end exclusive).

    Whole texts; a null text is an empty one. Fixed spans always stay; the trees add candidates that no fixed span
    overlaps. Repeated rows stay; an empty table gives no rows; other columns play no part. No shuffle once the trees are learned.
    """
    model = booster or learn(docs, id_col, text_col)
    return _found(_texts(docs, id_col, text_col)).select("doc_id", "base", all_spans(F.col("base"), F.col("found"), model).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap become one, of the kind that begins first."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] >= acc["at"], F.struct((-s["e"]).alias("at"), F.concat(acc["out"], fresh).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], -s["e"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(by_start, state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", booster: Booster | None = None) -> DataFrame:
    """``docs`` with its texts masked, all other columns as they were, in one pass; null texts stay null, texts of any length are masked whole,
    repeated rows stay, and an empty table stays empty. The trees are learned from a bounded sample of the same rows."""
    model = booster or learn(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = base_spans(text)
    flat = F.concat(*[F.transform(spans[k], _of_kind(k)) for k in KINDS if k in spans])
    mask = _once(flat, lambda b: _once(all_spans(b, candidates(text, b), model), lambda s: masked(text, s)))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), mask))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
