"""Personal data by candidate generation and gradient boosting, on built-in functions only.

Base rules find addresses, IP numbers, card and phone numbers; their spans always
stay. Beside them four generators propose spans with high recall, overlapping each other
and the base spans: anything like an address (also spelt out), any longer run of digits,
anything like a bank account, and any named long value. Boosted trees score format and
context of a candidate. They are trained here on what the base rules can't tell: personal data and
near misses of many forms, planted at known places among the words of the texts themselves;
every distinct text of the table carries some for each generator. A threshold per generator, calibrated on texts held out from training,
selects the spans that are added. The trees are turned into a Spark expression, so that all
candidates are scored where they are found.
"""

from __future__ import annotations

import warnings
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import bound, running, settle, slices, total

#: Fixed patterns. Possessive quantifiers match the same text as greedy ones here and keep
#: very long runs linear; the look-behind starts a match only where a run begins.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Generators of candidates.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "number": r"[+(]?[0-9](?:[\x20().,/-]{0,2}[0-9]){6,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+",
    "secret": r"(?<![A-Za-z_])[A-Za-z_]{2,24}+\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_-]{12,}+",
}
KINDS = ["email", "ip", "card", "phone", "number", "account", "secret"]
CONTEXT = 24
_WORDS = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|ssn|social|addr|token|key|secret|passw|pwd)"
_NAMES = r"(?i)^[a-z_]*(?:token|key|secret|passw|pwd|auth)[a-z_]*\x20?[=:]"
#: Distinct texts up to which every text carries all forms. In larger tables each text carries its
#: share, so that every form stands in about so many texts, and at least one form of each generator.
TRAIN_DOCS = 2_000
#: The precision asked of a threshold.
PRECISION = 0.99
TREES, DEPTH = 20, 4
#: Training rows of a task.
TASK_ROWS = 20_000
FEATURES = 22
#: Words of a text within which a string is planted.
HEAD_WORDS = 60
#: Words that may stand before a planted string, personal data or near miss alike.
LEADS = ("", "", "Tel: ", "phone ", "call ", "contact: ", "order ", "page ", "ref. ")


def _greatest(*arrays: Column) -> Column:
    return F.greatest(F.lit(0), *[F.aggregate(x, F.lit(0), lambda acc, v: F.greatest(acc, v)) for x in arrays])


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, s, before, after): all matches from the left, in code points.

    Matches and the gaps between them alternate, so their lengths add up to places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")

    def spans(x: Column) -> Column:
        gaps, found = x["gaps"], x["hits"]
        sizes = F.transform(found, lambda s, i: F.length(F.get(gaps, i)) + F.length(s))

        def span(s: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(
                start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"),
                F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
            )

        return bound(running(sizes, total), lambda before: F.transform(found, lambda s, i: span(s, i, before)))

    some = bound(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), spans)
    return F.when(text.rlike(pattern), some).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether a string of 13 to 19 digits, among other characters, passes the Luhn check."""
    turned = F.reverse(_digits(s))
    places = F.sequence(F.lit(1), F.least(F.length(turned), F.lit(19)))
    digit = lambda i: F.ascii(F.substring(turned, i, F.lit(1))) - 48
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + worth(i))
    return F.length(turned).between(13, 19) & (total % 10 == 0)


def octets(s: Column) -> Column:
    """Whether a string is four numbers of at most 255, with dots between."""
    parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    return (F.size(parts) == 4) & small


def phone_digits(s: Column) -> Column:
    return F.length(_digits(s)).between(9, 15)


VALID = {"email": lambda s: F.lit(True), "ip": octets, "card": luhn, "phone": phone_digits}


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``base_<kind>``: arrays of the spans that the base rules accept."""

    def accepted(kind: str) -> Column:
        return F.filter(located(F.col(text), BASE[kind]), lambda x: VALID[kind](x["s"])).alias(f"base_{kind}")

    return rows.select("*", *map(accepted, BASE))


def _features(c: Column, generator: int) -> list[Column]:
    """What a candidate looks like and stands in; no verdict of a base rule among it."""
    s = c["s"]
    count = lambda pattern: F.length(F.regexp_replace(s, pattern, ""))
    digits, letters = count("[^0-9]"), count("[^A-Za-z]")
    groups = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))
    at = lambda i: F.coalesce(F.try_element_at(groups, F.lit(i)), F.lit(0))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    found = [
        F.lit(generator), F.length(s), digits, letters, F.length(s) - digits - letters, digits / F.length(s),
        flag(s.startswith("+")), flag(s.startswith("(")), count("[^.]"), count("[^@]"), count("[^-]"), count("[^\\x20]"), count("[^/,]"), count("[^A-Z]"),
        F.size(groups), at(1), at(2), at(-1), F.size(F.split(s, r"[\[(]dot[\])]|\.")),
        F.size(F.array_distinct(F.split(s, ""))) / F.length(s),
        flag(F.concat(c["before"], s).rlike(_WORDS)) + 2 * flag(s.rlike(_NAMES)),
        flag(c["before"].rlike("[A-Za-z0-9]$")) + 2 * flag(F.coalesce(c["after"], F.lit("")).rlike("[A-Za-z0-9]")),
    ]
    return [x.cast("double").alias(f"f{i}") for i, x in enumerate(found)]


def candidates(text: Column) -> Column:
    """Array of (generator, start, end, s, f0, f1, ...): all proposals, overlapping or not."""

    def proposals(k: int, name: str) -> Column:
        spans = located(text, GENERATORS[name])
        return F.transform(spans, lambda c: F.struct(F.lit(name).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), *_features(c, k)))

    return F.concat(*[proposals(k, name) for k, name in enumerate(GENERATORS)])


def _base_spans() -> Column:
    def named(kind: str) -> Column:
        return F.transform(f"base_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*map(named, BASE))


def planted_forms() -> list[tuple[str, int, Column]]:
    """(generator, label, string): personal data (1) and near misses (0), from columns of drawn characters."""
    salt = F.col("mixed")
    d, w, x = (lambda i, n, of=of: F.substring(of, i, n) for of in ("numbers", "words", "mixed"))
    glue = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one_of = lambda *options: F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(salt, F.lit(len(options))), F.lit(len(options))).cast("int") + 1)
    sign, names, plain = one_of("=", " = ", ": ", ':"'), one_of("token", "api_key", "secret", "password", "auth_token", "PWD"), one_of("path", "title", "class", "sha", "commit", "etag", "state")
    capital = lambda i, n: F.upper(w(i, n))
    some = lambda k, low, high: (F.pmod(F.xxhash64(salt, F.lit(k)), F.lit(high - low + 1)) + low).cast("int")
    name, host, more, ends = w(1, some(101, 1, 8)), w(9, some(102, 1, 8)), d(9, some(103, 1, 5)), one_of("com", "org", "net", "de", "co", "fr", "es", "info")
    return [
        ("email", 1, glue(name, " [at] ", host, " [dot] ", ends)),
        ("email", 1, glue(name, more, " [at] ", host, " [dot] ", ends)),
        ("email", 1, glue(name, ".", w(20, 4), "(at)", host, ".", ends)),
        ("email", 1, glue(name, "_", w(20, 3), more, "(at)", w(24, 4), ".", host, ".", ends)),
        ("email", 1, glue(name, more, " (at) ", host, "(dot)", ends)),
        ("email", 0, glue(name, " (at) ", host)),
        ("email", 0, glue(name, more, "@", host)),
        ("email", 0, glue(name, "@", host, more)),
        ("email", 0, glue(name, " [at] ", host, " ", w(20, 3))),
        ("number", 1, glue("(", d(1, 3), ") ", d(4, 3), "-", d(7, 4))),
        ("number", 1, glue(d(1, 3), one_of("-", "."), d(4, 3), one_of("-", "."), d(7, 4))),
        ("number", 1, glue(d(1, 3), " ", d(4, 3), " ", d(7, 4))),
        ("number", 1, glue("0", d(1, 2), one_of(" ", "/"), d(4, 4), " ", d(8, 4))),
        ("number", 1, glue(d(1, 3), "-", d(4, 2), "-", d(7, 4))),
        ("number", 0, glue(one_of("19", "20"), d(1, 2), "-0", d(3, 1), "-1", d(4, 1))),
        ("number", 0, glue("1", d(4, 1), "/0", d(3, 1), "/20", d(1, 2), " - 2", d(5, 1), "/0", d(6, 1), "/20", d(1, 2))),
        ("number", 0, glue("19", d(1, 2), "-19", d(3, 2))),
        ("number", 0, d(1, 7)),
        ("number", 0, d(1, 10)),
        ("number", 0, d(1, 14)),
        ("number", 0, d(1, 16)),
        ("number", 0, glue(d(1, 4), " ", d(5, 4), " ", d(9, 4), " ", d(13, 4))),
        ("number", 0, glue(d(1, 1), ",", d(2, 3), ",", d(5, 3), ".", d(8, 2))),
        ("number", 0, glue("978-", d(1, 1), "-", d(2, 2), "-", d(4, 6), "-", d(10, 1))),
        ("number", 0, glue(d(1, 1), ".", d(2, 2), ".", d(4, 1), ".", d(5, 1), "-", d(6, 4))),
        ("account", 1, glue(capital(1, 2), d(1, 2), " ", d(3, 4), " ", d(7, 4), " ", d(11, 4), " ", d(15, 4), " ", d(19, 2))),
        ("account", 1, glue(capital(1, 2), d(1, 2), " ", capital(3, 4), " ", d(7, 4), " ", d(11, 4), " ", d(15, 4), " ", d(19, 2))),
        ("account", 1, glue(capital(1, 2), d(1, 20))),
        ("account", 0, glue(capital(1, 2), d(1, 2), " ", capital(3, 4), " ", capital(9, 4))),
        ("account", 0, glue(capital(1, 2), d(1, 2), capital(3, 8))),
        ("secret", 1, glue(names, sign, x(1, 32))),
        ("secret", 1, glue(names, sign, w(1, 6), x(1, 8), capital(9, 5), d(1, 3))),
        ("secret", 1, glue(names, sign, capital(1, 4), x(1, some(104, 14, 40)))),
        ("secret", 1, glue(names, sign, w(1, 3), one_of("_", "-"), x(5, some(105, 16, 40)))),
        ("secret", 0, glue(plain, sign, x(1, 40))),
        ("secret", 0, glue(plain, sign, w(1, 9), "-", w(11, 8))),
        ("secret", 0, glue(names, sign, w(1, 14))),
    ]


def planted(docs: DataFrame, text_col: str, salt: str = "", without: tuple[int, ...] = (), train_docs: int | None = None) -> DataFrame:
    """(text, start, end, kind, label, form, fold): forms, but those ``without``, among words of every distinct text.

    A text carries every form, or with ``train_docs`` the share of each kind's forms, one at least, that its
    hash deals to it. The words around a planted string, up to ``4 * CONTEXT`` characters at either side, are
    the text's own.
    """
    rows = docs.select(F.col(text_col).alias("whole")).where("length(whole) > 0")
    share = 1.0 if train_docs is None else train_docs / max(train_docs, rows.agg(F.count_distinct(F.md5("whole"))).first()[0])
    front = F.left("whole", F.length(F.call_function("substring_index", F.col("whole"), F.lit(" "), F.lit(HEAD_WORDS))) + 4 * CONTEXT + 1)
    mixed = F.concat(*[F.md5(F.concat("whole", F.lit(salt + x))) for x in "ab"])
    # copies of a text meet without the rest of it
    rows = rows.select(mixed.alias("mixed"), F.pmod(F.xxhash64("whole"), F.lit(5)).alias("fold"), front.alias("front")).dropDuplicates(["mixed"])
    forms = planted_forms()

    def dealt(kind: str) -> Column:
        own = [n for n, (of, _, _) in enumerate(forms) if of == kind and n not in without]
        first = F.pmod(F.xxhash64("mixed", F.lit(kind)), F.lit(len(own))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(ceil(share * len(own)) - 1)), lambda k: F.get(F.array(*map(F.lit, own)), (first + k) % len(own)))

    rows = rows.select("*", F.explode(F.concat(*[dealt(k) for k in GENERATORS if any(of == k and n not in without for n, (of, _, _) in enumerate(forms))])).alias("form"))
    rows = rows.withColumns({"numbers": F.translate("mixed", "abcdef", "123456"), "words": F.translate("mixed", "0123456789", "ghijklmnop")})
    of_form = lambda values: reduce(lambda found, x: found.when(F.col("form") == x[0], x[1]), list(enumerate(values))[1:], F.when(F.col("form") == 0, values[0]))
    draw = lambda n: F.pmod(F.xxhash64("mixed", "form", F.lit(n)), F.lit(n)).cast("int")
    head = F.call_function("substring_index", F.col("front"), F.lit(" "), draw(HEAD_WORDS) + 1)
    lead = F.element_at(F.array(*map(F.lit, LEADS)), draw(len(LEADS)) + 1)
    names, labels = (F.array(*[F.lit(form[k]) for form in forms]) for k in (0, 1))
    rows = rows.select(
        "fold", "form", F.get(names, F.col("form")).alias("kind"), F.get(labels, F.col("form")).alias("label"), of_form([x for _, _, x in forms]).alias("s"),
        F.right(head, F.lit(4 * CONTEXT)).alias("head"), lead.alias("lead"), F.substring("front", F.length(head) + 2, F.lit(4 * CONTEXT)).alias("tail"),
    )
    before = F.concat("head", F.lit(" "), "lead")
    text = F.concat(before, F.col("s"), F.lit(" "), "tail")
    return rows.select(text.alias("text"), F.length(before).alias("start"), (F.length(before) + F.length("s")).alias("end"), "kind", "label", "form", "fold")


def training_rows(docs: DataFrame, text_col: str, train_docs: int, without: tuple[int, ...] = ()) -> DataFrame:
    """Distinct (kind, fold, f0, ..., label), with their number, of the candidates at planted places in all texts.

    A candidate is right if it is of the planted kind, from four fifths of the planted string on.
    """
    rows = planted(docs, text_col, without=without, train_docs=train_docs).select("start", "end", "kind", "label", "fold", F.explode(candidates(F.col("text"))).alias("c"))
    met = rows.where("c.start < end and start < c.end")
    same = (F.col("c.kind") == F.col("kind")) & (F.least("c.end", "end") - F.greatest("c.start", "start") >= 0.8 * (F.col("end") - F.col("start")))
    names = [f"f{i}" for i in range(FEATURES)]
    labelled = met.select("c.kind", "fold", *[f"c.{x}" for x in names], F.when(same, F.col("label")).otherwise(0).alias("label"))
    return labelled.groupBy("kind", "fold", *names, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _as_column(node, c: Column) -> Column:
    """A fitted tree as nested conditions on a candidate's features."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(c[f"f{split.featureIndex()}"] <= float(split.threshold()), _as_column(node.leftChild(), c)).otherwise(_as_column(node.rightChild(), c))


class Boosted:
    """Fitted trees and a threshold for each generator."""

    def __init__(self, model, thresholds: dict[str, float]):
        self.model = model
        self.trees = [] if model is None else [(float(w), t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        self.thresholds = thresholds

    def probability(self, c: Column) -> Column:
        raw = reduce(lambda a, b: a + b, [F.lit(w) * _as_column(t, c) for w, t in self.trees])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(raw * -2.0))

    def chosen(self, found: Column) -> Column:
        """The candidates at or over their generator's threshold, with their probability."""
        if not self.trees or not self.thresholds:
            return F.filter(found, lambda c: F.lit(False))
        scored = F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), self.probability(c).alias("p")))
        rule = lambda c: reduce(lambda a, b: a | b, [(c["kind"] == k) & (c["p"] >= t) for k, t in self.thresholds.items()])
        return F.filter(scored, rule)


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS, precision: float = PRECISION, without: tuple[int, ...] = ()) -> Boosted:
    """Fit the trees on four fifths of the distinct texts and set the thresholds on the rest.

    Forms of the numbers ``without`` are left out, to see how far the others carry.

    A generator's threshold is the least score, by hundredths, from which on the held-out
    candidates are right at the asked precision. Without both labels there are no trees,
    and without a fit threshold a generator adds nothing.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = settle(training_rows(docs, text_col, train_docs, without))
    fit = rows.where("fold < 4").coalesce(4 + rows.count() // TASK_ROWS)
    if fit.select("label").distinct().count() < 2:
        return Boosted(None, {})
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(FEATURES)], outputCol="features")
    boosting = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="weight")
    own = Boosted(boosting.fit(assembler.transform(fit).select("features", "label", "weight")), {})
    names = [F.col("kind"), *[F.col(f"f{i}") for i in range(FEATURES)]]
    held = rows.where("fold = 4").select("kind", "label", "weight", F.struct(*names).alias("c"))
    scored = held.select("kind", "label", "weight", F.floor(own.probability(F.col("c")) * 100).alias("score"))
    counts = scored.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("n")).collect()  # at most 404 rows
    for kind in GENERATORS:
        right = n = 0
        for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["score"]):
            right, n = right + r["right"], n + r["n"]
            if right >= precision * n and r["score"] >= 50:
                own.thresholds[kind] = r["score"] / 100
    if missing := [k for k in GENERATORS if k not in own.thresholds]:
        warnings.warn(f"no threshold reaches a precision of {precision} for {', '.join(missing)}: no such spans are added", stacklevel=2)
    return own


def find(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans) of every row.

    ``base`` holds the base rules' spans, ``spans`` these and the added ones, as arrays of
    (kind, start, end) by kind and place. A null text is an empty one. Null ids and
    repeated rows stay as they are. An added span overlaps no base span and no better one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_base(rows, "text").withColumn("base", _base_spans())
    spans = F.col("base")
    if model.trees and model.thresholds:
        spans = selected(F.col("base"), model.chosen(candidates(F.col("text"))))
    found = found.withColumn("all", spans)
    by_kind = [F.array_sort(_of_kind("all", k)) for k in KINDS]
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("id", *counts, "base", F.concat(*by_kind).alias("spans"))


def clusters(spans: Column) -> Column:
    """Arrays of spans sorted by place, each a run of spans that hang together by overlaps."""

    def cut(x: Column) -> Column:
        ordered, reach = x["ordered"], x["reach"]
        n = F.size(ordered)
        heads = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(ordered, i)["start"] >= F.get(reach, i)))
        part = lambda heads: F.transform(
            F.sequence(F.lit(0), F.size(heads) - 2), lambda k: F.transform(F.sequence(F.get(heads, k), F.get(heads, k + 1) - 1), lambda i: F.get(ordered, i))
        )
        return bound(heads, part)

    reach = lambda ordered: running(F.transform(ordered, lambda s: s["end"]), _greatest)
    some = bound(F.array_sort(spans), lambda ordered: bound(F.struct(ordered.alias("ordered"), reach(ordered).alias("reach")), cut))
    return F.when(F.size(spans) > 0, some)


def selected(base: Column, added: Column) -> Column:
    """The base spans, and the added spans that overlap none of these and no better one."""
    span = lambda c, p: F.struct(c["start"].alias("start"), c["end"].alias("end"), p.alias("p"), c["kind"].alias("kind"))
    spans = F.concat(F.transform(base, lambda c: span(c, F.lit(2.0))), F.transform(added, lambda c: span(c, c["p"])))
    rank = lambda c: F.struct(c["p"].alias("p"), (c["end"] - c["start"]).alias("n"), (-c["start"]).alias("s"), c["kind"].alias("k"))
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    stay = lambda own: F.filter(own, lambda c: (c["p"] == 2.0) | ~F.exists(own, lambda d: over(c, d) & (rank(d) > rank(c))))
    best = F.flatten(F.transform(clusters(spans), stay))
    named = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.when(F.size(added) > 0, named).otherwise(base)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def span_text(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with personal data replaced by its kind in angle brackets.

    Spans of (kind, start, end) may overlap; what hangs together goes as one, under the kind
    of the span that starts first.
    """
    ordered = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    ends = lambda own: F.aggregate(own, F.lit(0), lambda acc, x: F.greatest(acc, x["end"]))
    whole = lambda groups: F.transform(groups, lambda own: F.struct(F.get(own, 0)["start"].alias("start"), ends(own).alias("end"), F.get(own, 0)["kind"].alias("kind")))

    def pieces(groups: Column) -> Column:
        at = lambda k: F.when(k == 0, 0).otherwise(F.get(groups, k - 1)["end"])
        shown = F.transform(groups, lambda g, k: F.struct(at(k).alias("start"), g["start"].alias("end")))
        rest = F.array(F.struct(at(F.size(groups)).alias("start"), F.length(text).alias("end")))
        between = slices(text, F.concat(shown, rest))
        return F.array_join(F.zip_with(between, groups, lambda s, g: F.concat(s, F.coalesce(F.concat(F.lit("<"), g["kind"], F.lit(">")), F.lit("")))), "")

    return F.when(F.size(spans) > 0, bound(whole(clusters(ordered)), pieces)).otherwise(text)
