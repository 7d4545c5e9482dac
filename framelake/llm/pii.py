"""Personal data: exact base patterns, and candidates that gradient-boosted trees select.  DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

#: Kinds with base patterns, and one that only the trees select.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The base patterns, with quantifiers that never go back (where going back can't help) so that Java's
#: matcher doesn't recurse, and with a start only where a run starts or the last match ended, so that a long run is read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match at all.
NEEDS = {"email": "@", "phone": "+"}
#: A run of digits that no generator of numbers can do without.
DENSE = r"[0-9](?:[\x20()\[\]./-]{0,3}[0-9]){6}"
AT, DOT = r"(?:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)", r"(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)"
#: High-recall generators; their spans may overlap one another and the base ones.  With each, what a text must have.
GENERATORS = (
    (r"[+(]?[0-9](?:[\x20()\[\]./-]{0,3}[0-9])++", DENSE),
    (r"[+(]?[0-9](?:[()\[\]./-]{0,3}[0-9])++", DENSE),
    (r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20./-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{4}(?![0-9])", DENSE),
    (rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:@|{AT})[A-Za-z0-9-]{{1,64}}(?:(?:\.|{DOT})[A-Za-z0-9-]{{1,24}}){{1,4}}", rf"@|{AT}|{DOT}"),
    (r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,512}+(?![A-Za-z0-9_+/-])", r"[A-Za-z0-9_+/-]{20}"),
)
SHORTEST = 7  # characters of a candidate
EMAIL_FORM = rf"@|{AT}"
IP_FORM = r"^[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}$"
SECRET_FORM = r"^(?=.*[A-Za-z])[A-Za-z0-9_+/-]{20,}$"
#: Words before a candidate, one feature each.
CUES = {
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|whatsapp|ring)", "card": r"(?i)(?:card|visa|credit|debit|amex|cc\b)", "mail": r"(?i)(?:mail|contact|write|reach)", "host": r"(?i)(?:host|addr|\bip\b|server|client)",
    "secret": r"(?i)(?:token|key|secret|passw|pwd|auth|bearer|credential)", "other": r"(?i)(?:order|isbn|invoice|commit|sha|md5|hash|uuid|\bid\b|version|price|total|date|ref|build|#|[$€]|x\[)",
}
FEATURES = (
    "kind", "digits", "length", "separators", "groups", "parens", "before", "after", "distinct", "longest", "shortest", "check", "letters", "spaces", "slashes", "assigned", "first", *CUES,
)
#: Documents whose passages the made-up examples stand in, about, and examples in each; all documents are searched.
MAX_TRAIN, EACH, TRAIN_TASKS = 2_000, 3, 16
PRECISION = 0.98
FALLBACK = 0.95
TREES, DEPTH = 12, 4
#: Forms of examples, (kind or None, words before, form): 9 a digit, ~ a letter, ^ a hexadecimal digit, ? a letter or digit;
#: forms that end in L get the check digit that passes, in X another.  None but forms that no base pattern has.
FORMS = [
    ("phone", "call", "(999) 555-9999"), ("phone", "", "(999) 999-9999"), ("phone", "tel.", "999-999-9999"), ("phone", "", "999-999-9999"), ("phone", "phone", "999.999.9999"), ("phone", "fax:", "1 999 999 9999"),
    ("phone", "mobile", "099 9999 9999"), ("phone", "tel", "0999/999 9999"), ("phone", "", "1-999-999-9999"), ("email", "", "~~~~~ [at] ~~~~~~ [dot] com"), ("email", "mail", "~~~.~~~~(at)~~~~~~.org"), ("email", "", "~~~~~~~@~~~~~ [dot] net"),
    ("email", "write to", "~~~~ at ~~~~~~~ dot com"), ("email", "", "~~~.~~ (at) ~~~~~ (dot) ~~~"), ("card", "card", "9999.9999.9999.999L"), ("card", "", "9999/9999/9999/999L"), ("card", "visa", "9999  9999  9999  999L"), ("card", "", "9999.9999.9999.999L"),
    ("ip", "host", "99[.]99[.]99[.]99"), ("ip", "", "999[.]9[.]99[.]9"), ("secret", "token =", '"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"'), ("secret", "api_key:", "????????????????????????????????"), ("secret", "secret =", "'????????????????????????'"),
    ("secret", "password=", "??????????????????????"), ("secret", "Authorization: Bearer", "????????????????????????????????????????"),
    (None, "", "2099-09-09 09:09"), (None, "date", "09/09/2099"), (None, "", "09.09.2099 - 09.09.2099"), (None, "total $", "9,999,999.99"), (None, "price", "99 999 999"), (None, "order", "9999999999"), (None, "#", "99999999"), (None, "", "9999999"),
    (None, "ref", "999-9999-999"), (None, "ISBN", "978-9-999999-99-X"), (None, "", "99.9999, 99.9999"), (None, "", "0.9999999999999"), (None, "commit", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"), (None, "", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"),
    (None, "sha1", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"), (None, "id", "^^^^^^^^-^^^^-^^^^-^^^^-^^^^^^^^^^^^"), (None, "", "999999999999999X"), (None, "card", "999999999999999X"), (None, "", "9999 9999 9999 999X"), (None, "", "9999.9999.9999.999X"),
    (None, "version", "9.99.9999.9"), (None, "", "at ~~~~~ dot ~~~~"), (None, "", "@~~~~~.~~~~"), (None, "", "~~~~~_~~~~~~~_~~~~~_~~~~~~~"), (None, "", "~~~~~~~~/~~~~~~~~/~~~~~~~~/~~~~~"), (None, "", "9999 - 9999"), (None, "", "1999, 2009, 2019"), (None, "x[", "999999999999]"),
]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, v: s + v)


def largest(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(0))


def let(value: Column, of) -> Column:
    """of(value), with ``value`` computed once and not for each element of an array that ``of`` walks."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def running(x: Column, step: int = 64, fold=total, join=add) -> Column:
    """Running sums (or, with ``largest`` and ``greatest``, maxima) of an array of ints of at least 0.

    Short arrays are summed up to each place; of longer ones, blocks of ``step`` and then places within a block.
    """
    def inside(x: Column, i: Column) -> Column:
        return fold(F.slice(x, (i - i % step) + 1, i % step + 1))

    def in_blocks(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda b: fold(F.slice(x, b * step + 1, F.lit(step))))
        before = let(sums, lambda s: F.transform(s, lambda _, i: fold(F.slice(s, F.lit(1), i))))
        return let(before, lambda p: F.transform(x, lambda _, i: join(F.get(p, F.floor(i / step).cast("int")), inside(x, i))))

    return let(x, lambda x: F.when(F.size(x) <= step, F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i + 1)))).otherwise(in_blocks(x)))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column, shift: int) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when((i + shift) % 2 == 0, doubled(value(i))).otherwise(value(i)))


def luhn(digits: Column) -> Column:
    return luhn_sum(digits, 0) % 10 == 0


def check_digit(digits: Column) -> Column:
    return (10 - luhn_sum(digits, 1) % 10) % 10


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        d = digits_of(m)
        return F.when(F.length(m) > 64, F.lit(False)).otherwise(F.length(d).between(12, 19) & luhn(F.when(F.length(d).between(12, 19), d).otherwise("0")))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


def add_matches(df: DataFrame, text: str, pattern: str, when: Column, out: str, context: int = 0) -> DataFrame:
    """Adds ``out``: array of struct(text, start, end[, before, after]) of a pattern's matches, positions in code points, end exclusive.

    The matches and the stretches between them come from one pattern each; their lengths' running sums are the positions.
    """
    m, g = f"__m_{out}", f"__g_{out}"
    df = df.withColumn(m, F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__len", F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i))))
    df = df.withColumn("__end", running(F.col("__len")))
    around = [lambda x, i: F.substring(F.get(g, i), -context, context).alias("before"), lambda x, i: F.substring(F.get(g, i + 1), 1, 1).alias("after")] if context else []
    spans = F.transform(m, lambda x, i: F.struct(x.alias("text"), (F.get("__end", i) - F.length(x)).alias("start"), F.get("__end", i).alias("end"), *[f(x, i) for f in around]))
    return df.withColumn(out, spans).drop(m, g, "__len", "__end")


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds __base: array of struct(start, order, end, kind) sorted by start, then kind as listed."""
    digit = F.col(text).rlike("[0-9]")
    for kind in KINDS:
        when = F.contains(F.col(text), F.lit(NEEDS[kind])) if kind in NEEDS else digit
        df = add_matches(df, text, PATTERNS[kind], when, f"__{kind}")
    def named(order: int, kind: str) -> Column:
        passed = F.filter(f"__{kind}", lambda s: valid(kind, s.text))
        return F.transform(passed, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), s.end.alias("end"), F.lit(kind).alias("kind")))

    return df.withColumn("__base", F.array_sort(F.concat(*[named(o, k) for o, k in enumerate(KINDS)]))).drop(*[f"__{k}" for k in KINDS])


def char_class(c: Column) -> Column:
    """0 edge or space, 1 letter, 2 digit, 3 quote or bracket, 4 other."""
    return F.when((F.length(c) == 0) | c.rlike(r"\s$"), 0).when(c.rlike(r"\p{L}$"), 1).when(c.rlike("[0-9]$"), 2).when(c.rlike(r"[\"'()\[\]]$"), 3).otherwise(4)


def candidate(s: Column) -> Column:
    """struct(start, end, order, x): kind by form and FEATURES as doubles.

    The plus sign, which makes a base phone number, is not a feature; a card number's check digit is.
    """
    t = s.text
    sizes = F.transform(F.filter(F.split(t, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    order = F.when(t.rlike(EMAIL_FORM), 0).when(t.rlike(IP_FORM), 1).when(t.rlike(SECRET_FORM), 4).when(F.length(digits_of(t)).between(12, 19), 2).otherwise(3)
    count = lambda c: F.length(F.regexp_replace(t, f"[^{c}]", ""))
    def of(known: Column) -> Column:
        d, sizes, order = known["d"], known["sizes"], known["order"]
        features = [
            order, F.length(d), F.length(t), F.length(F.regexp_replace(t, r"[A-Za-z0-9+]", "")), F.size(sizes), t.rlike(r"[()]").cast("int"), char_class(s.before), char_class(s.after),
            F.size(F.array_distinct(F.split(d, ""))), F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)), F.when(order == 2, luhn(d).cast("int")).otherwise(0),
            count("A-Za-z"), count(r"\x20"), count("/"), s.before.rlike(r"[=:]\s?[\"']?$").cast("int"), F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), *[s.before.rlike(c).cast("int") for c in CUES.values()],
        ]
        return F.struct(s.start.alias("start"), s.end.alias("end"), order.alias("order"), F.array(*[f.cast("double") for f in features]).alias("x"))

    return F.get(F.transform(F.array(F.struct(digits_of(t).alias("d"), sizes.alias("sizes"), order.alias("order"))), of), F.lit(0))


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds __candidates: distinct spans of all generators: of 7 to 19 digits, with an at sign in some form, or long tokens of letters and digits."""
    needs = {n: f"__n{i}" for i, n in enumerate(dict.fromkeys(n for _, n in GENERATORS))}
    for n, name in needs.items():
        df = df.withColumn(name, F.col(text).rlike(n))
    for i, (pattern, n) in enumerate(GENERATORS):
        df = add_matches(df, text, pattern, F.col(needs[n]), f"__c{i}", context=24)
    numbers = lambda s: (F.length(s.text) <= 64) & F.length(digits_of(s.text)).between(7, 19)
    secret = lambda s: s.text.rlike(SECRET_FORM) & s.text.rlike("[0-9]")
    likely = lambda s: (F.length(s.text) >= SHORTEST) & (s.text.rlike(EMAIL_FORM) | s.text.rlike(IP_FORM) | numbers(s) | secret(s))
    both = F.concat(*[F.filter(f"__c{i}", likely) for i in range(len(GENERATORS))])
    df = df.withColumn("__likely", F.array_distinct(both))
    return df.withColumn("__candidates", F.transform("__likely", candidate)).drop("__likely", *needs.values(), *[f"__c{i}" for i in range(len(GENERATORS))])


def overlaps(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def tree_column(lines: list[str], x) -> Column:
    """A tree of the model's printed form as nested conditions."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return F.lit(float(m[1]))
    m = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line)
    feature = x[int(m[1])]
    test = feature <= float(m[3]) if m[2] == "<=" else feature > float(m[3])
    yes = tree_column(lines, x)
    lines.pop(0)  # Else
    return F.when(test, yes).otherwise(tree_column(lines, x))


class Selector:
    """Boosted trees and a threshold per kind."""

    def __init__(self, printed: str, thresholds: list[float]):
        self.trees = [(float(w), body.strip("\n").split("\n")) for w, body in re.findall(r"Tree \d+ \(weight (\S+)\):\n(.*?)(?=\n\s*Tree \d+ \(weight|\Z)", printed, re.S)]
        self.thresholds = thresholds

    def probability(self, x: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(w) * tree_column([line for line in lines if line.strip()], x) for w, lines in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, c: Column) -> Column:
        return self.probability(c.x) >= F.element_at(F.array(*[F.lit(t) for t in self.thresholds]), c.order + 1)


NOTHING = Selector("", [2.0] * len(ALL_KINDS))


def filled_in(form: Column, seed: Column) -> Column:
    """A form with its places taken by pseudo-random characters."""
    pick = lambda of, i: F.substring(F.lit(of), (F.pmod(F.xxhash64(seed, i), F.lit(len(of))) + 1).cast("int"), F.lit(1))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    of = {"9": digits, "~": letters, "^": "0123456789abcdef", "?": letters + letters.upper() + digits}
    def one(c: Column, i: Column) -> Column:
        out = c
        for mark, chars in of.items():
            out = F.when(c == mark, pick(chars, i)).otherwise(out)
        return out

    made = F.array_join(F.transform(F.split(form, ""), one), "")
    checked = F.struct(F.regexp_replace(made, "[LX]$", "").alias("body"), F.right(form, F.lit(1)).alias("end"))
    return F.get(F.transform(F.array(checked), lambda x: F.concat(x["body"], F.when(x["end"] == "L", check_digit(digits_of(x["body"])).cast("string")).when(x["end"] == "X", ((check_digit(digits_of(x["body"])) + 3) % 10).cast("string")).otherwise(""))), F.lit(0))


def made_examples(docs: DataFrame, text_col: str = "text", most: int = MAX_TRAIN, seed: int = 7) -> DataFrame:
    """(key, text, start, end, kind): FORMS within passages of about ``most`` documents, drawn by row.

    Kinds are orders in ALL_KINDS, null for what is no personal data.
    """
    rows = docs.select(text_or_empty(text_col).alias("t"))
    n = rows.count()
    part = rows.where(F.rand(seed) < most / n) if n > most else rows
    keyed = part.select("t", F.monotonically_increasing_id().alias("row")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(EACH - 1)))).withColumn("key", F.xxhash64(F.lit(seed), "row", "k"))
    at = (F.pmod(F.xxhash64("key", F.lit("at")), F.greatest(F.char_length("t"), F.lit(1))) + 1).cast("int")
    forms = F.array(*[F.struct(F.lit(ALL_KINDS.index(k) if k else None).cast("int").alias("kind"), F.lit(cue + " " if cue else "").alias("cue"), F.lit(form).alias("form")) for k, cue, form in FORMS])
    some = keyed.select("key", F.substring("t", at, F.lit(24)).alias("a"), F.substring("t", at + 24, F.lit(24)).alias("b")).repartition(TRAIN_TASKS, "key")
    some = some.select("key", "a", "b", F.get(forms, F.pmod(F.xxhash64("key", F.lit("form")), F.lit(len(FORMS))).cast("int")).alias("f"))
    made = some.select("key", "b", "f.kind", F.concat("a", F.lit(" "), "f.cue").alias("before"), filled_in(F.col("f.form"), F.col("key")).alias("value"))
    return made.select("key", F.concat("before", "value", F.lit(" "), "b").alias("text"), F.char_length("before").alias("start"), (F.char_length("before") + F.char_length("value")).alias("end"), "kind")


def train_selector(docs: DataFrame, text_col: str = "text", most: int = MAX_TRAIN) -> Selector:
    """Trees fitted on made examples, half of them for the thresholds.

    The tables have no labels of personal data, and the base patterns' own spans would teach nothing but these patterns.
    So examples are made: forms of personal data that no base pattern has, and numbers, hashes and addresses of other
    kinds, within passages drawn from about ``most`` of the corpus's documents.  A candidate is positive if it is a form of its kind (but
    for up to two characters), negative if it overlaps one of no kind; others aren't used.  A kind's threshold is
    the least probability from which PRECISION of the calibration half are positive; a kind with few
    examples gets FALLBACK.  An empty table gives a selector that selects nothing.
    """
    made = materialise(made_examples(docs, text_col, most), "examples")  # else every pattern would make the texts anew
    found = with_candidates(made, "text").select("key", "start", "end", "kind", F.explode("__candidates").alias("c"))
    close = (F.abs(F.col("c.start") - F.col("start")) <= 2) & (F.abs(F.col("c.end") - F.col("end")) <= 2)
    label = F.when(F.col("kind").isNull() & (F.col("c.start") < F.col("end")) & (F.col("start") < F.col("c.end")), 0.0).when(close & (F.col("kind") == F.col("c.order")), 1.0)
    examples = materialise(found.select(F.pmod("key", F.lit(2)).alias("half"), F.col("c.order").alias("order"), F.col("c.x").alias("x"), label.alias("label")).where("label is not null"), "candidates")
    counts = {(r["half"], r["label"]): r["count"] for r in examples.groupBy("half", "label").count().collect()}
    if not (counts.get((0, 0.0)) and counts.get((0, 1.0))):
        return NOTHING
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(examples.where("half = 0").select(array_to_vector("x").alias("features"), "label"))
    scored = fitted.transform(examples.where("half = 1").select("order", "label", array_to_vector("x").alias("features"))).select("order", "label", F.round(vector_to_array("probability")[1], 3).alias("p"))
    by: dict[int, list] = {}
    for r in scored.groupBy("order", "p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("p")).collect():  # at most 1,001 rows a kind
        by.setdefault(r["order"], []).append(r)
    thresholds = []
    for order in range(len(ALL_KINDS)):
        good, seen, best = 0, 0, None
        for r in by.get(order, []):
            good, seen = good + r["good"], seen + r["n"]
            if good / seen >= PRECISION and r["p"] >= 0.5:
                best = r["p"]
        thresholds.append(best - 0.0005 if best is not None and good >= 20 else FALLBACK)
    return Selector(fitted.toDebugString, thresholds)


def with_spans(df: DataFrame, text: str, selector: Selector) -> DataFrame:
    """Adds __base and __spans to a table without columns of such names."""
    df = with_candidates(with_base(df, text), text)
    free = lambda c: selector.selects(c) & ~F.exists("__base", lambda b: overlaps(b, c))
    chosen = F.array_sort(F.transform(F.filter("__candidates", free), lambda c: F.struct(c.start.alias("start"), (-c.end).alias("last"), c.order.alias("order"))))
    df = df.withColumn("__chosen", chosen).withColumn("__last", F.transform("__chosen", lambda c: -c["last"]))
    first = let(running(F.col("__last"), fold=largest, join=F.greatest), lambda reach: F.filter("__chosen", lambda c, i: (i == 0) | (c.start >= F.get(reach, i - 1))))
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    added = F.transform(first, lambda c: F.struct(c.start.alias("start"), c.order.alias("order"), (-c["last"]).alias("end"), F.element_at(kinds, c.order + 1).alias("kind")))
    return df.withColumn("__spans", F.array_sort(F.concat("__base", added))).drop("__candidates", "__chosen", "__last")


def find_spans(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of struct(start, order, end, kind) sorted by start and kind.

    All base spans are in ``spans``; a selected candidate joins them unless it overlaps one, or a
    selected candidate that starts earlier or is longer.  Columns ``base`` and ``spans`` of ``docs`` are replaced;
    null texts count as empty.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    df = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), text_or_empty(f"`{text_col}`").alias("__text")), "__text", selector)
    return df.select("__row.*", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def span_list(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", selector: Selector | None = None) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    No shuffle: patterns, candidates and trees all run within the row.  Null texts count as empty; null
    ids and repeated rows keep their rows; an empty table gives none; other columns are ignored.
    """
    selector = selector or train_selector(docs, text_col)
    df = with_spans(docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")), "__text", selector)
    def count(kind: str) -> Column:
        return F.size(F.filter("__base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return df.select(id_col, *[count(k) for k in KINDS], F.sha2(span_list("__base"), 256).alias("base_sha256"), span_list("__spans").alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans become one.

    A null text stays null; repeated rows and null ids keep their rows, all other columns their values, whatever
    their names; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    df = with_spans(docs.select(row, text_or_empty(f"`{text_col}`").alias("__text")), "__text", selector).drop("__base")
    spans = F.col("__spans")
    n = F.size(spans)
    # Where all spans up to each one reach: equal within a merged stretch, which begins where a span starts at or after it.
    df = df.withColumn("__ends", F.transform(spans, lambda s: s.end)).withColumn("__reach", running(F.col("__ends"), fold=largest, join=F.greatest))
    opens = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s.start >= F.get("__reach", i - 1)), i)), lambda i: i.isNotNull())
    df = df.withColumn("__open", opens)
    merged = F.transform("__open", lambda i, k: F.struct(F.get(spans, i).start.alias("start"), F.get("__reach", F.coalesce(F.get("__open", k + 1), n) - 1).alias("end"), F.get(spans, i).kind.alias("kind")))
    df = df.withColumn("__merged", merged)
    text, chars = F.col("__text"), F.split(F.col("__text"), "")
    def cut(by_char: bool) -> Column:
        def part(a: Column, b: Column) -> Column:
            return F.array_join(F.slice("__chars", a + 1, b - a), "") if by_char else F.substring(text, a + 1, b - a)
        pieces = F.transform("__merged", lambda s, k: F.concat(part(F.coalesce(F.get("__merged", k - 1).end, F.lit(0)), s.start), F.lit("["), F.upper(s.kind), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(F.element_at("__merged", -1).end, F.char_length(text)))
    df = df.withColumn("__chars", F.when(F.size("__merged") > 64, chars))
    new = F.when(F.size("__merged") == 0, text).when(F.size("__merged") <= 64, cut(False)).otherwise(cut(True))
    new = F.when(F.col(f"__row.`{text_col}`").isNotNull(), new)
    return df.select(*[new.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
