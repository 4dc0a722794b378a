"""Personal data by candidate spans and boosted trees, in DataFrame functions only.

Base spans follow fixed patterns with checks and always stay. Beside them,
loose generators propose spans that may overlap: bracketed addresses, numbers
without a plus sign, card-like and address-like digit groups. A gradient-boosted tree
ensemble scores each proposal by its format and the text around it. It is
trained on the corpus itself: proposals that a base span confirms against
those that something speaks against (a failed check, another shape, a letter
or digit at the edge, the word before, a base span of another kind), with the
marks that define the base patterns (plus sign, at sign) left out of the
features, so that the same shapes written otherwise score alike. A proposal
that no base span touches and nothing speaks against has no label: it is what
the trees are to find, and takes no part in fit or calibration. Per kind, the
threshold is the lowest score at which, in all documents that the trees were
not fitted on, at least ``PRECISION`` of the labelled proposals are confirmed; proposals beyond it
that touch no base span are added, the best of those that overlap each other. The trees are compiled to column expressions:
scoring is one pass without shuffle.

The trees are fitted on half of ``FIT_DOCS`` documents (those with a digit or an
at sign, by hash of doc_id) at most. With fewer than ``LEAST`` examples of either class
nothing is added to the base. Null texts are empty. Repeated rows get equal
spans; extra columns are kept by ``redact``; an empty table gives an empty one.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import documents, set_apart
from shelfmark.session import materialize

FIT_DOCS = 4000
FIT_ROWS = 40_000
LEAST = 30
PRECISION = 0.98
TREES = 12
DEPTH = 4

#: Base patterns (fixed values); groups are possessive, which changes no match and needs no stack.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base match that can pass its check.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Proposals per kind: wider than the base, with the base's own forms among them. The phone pattern finds the digit
#: groups where a number of 7 to 15 digits may begin, with what follows (group 1, then 2 behind it).
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,3}+(?:(?:\.|\x20?[\[(]\.[\])]\x20?)[0-9]{1,3}+){3}",
    "card": r"[0-9]{4}+(?:[\x20./-]?[0-9]{2,7}+){2,5}",
    "phone": r"(?<![0-9])\+?\(?[0-9](?=((?:[\x20()./-]{0,3}[0-9]){6,14})(?![0-9])([\s\S]{0,8}))[0-9]*+",
}
LOOSE_NEEDED = {
    "email": r"@|[\[({](?:at|AT)[\])}]", "ip": r"[0-9][\x20\[(]*\.[\])\x20]*[0-9]", "card": r"[0-9]{4}(?:[\x20./-]?[0-9]{2}){2}",
    "phone": r"[0-9](?:[\x20()./-]{0,3}[0-9]){6}",
}
#: Words near a kind, in the corpus' languages.
CONTEXT = {
    "email": "mail|contact|write|schreib|escrib",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|master|carte|karte|tarjeta|credit",
    "phone": r"phone|\btel|call|fon|mobil|m[oó]vil|fax",
}
#: What stands right before or after a number that is no personal one: amounts, orders, versions, keys.
AGAINST_BEFORE = (
    r"(?i)(?:\b(?:pay|pays|paid|price|cost|costs|total|sum|amount|order|invoice|version|release|token|key|id|ref|isbn"
    r"|preis|betrag|summe|rechnung|bestellung|prix|montant|facture|commande|precio|importe|factura|pedido)\b|[$€£¥#=/_])[\s:.#\"']*$"
)
AGAINST_AFTER = r"(?i)^\x20?(?:[%€$£¥]|eur\b|usd\b)"
#: Shapes of other numbers that the phone generator proposes: addresses, dates, amounts.
OTHER_SHAPES = (
    r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:19|20)[0-9]{2}[./\x20-][01]?[0-9][./\x20-][0-3]?[0-9]"
    r"|[0-3]?[0-9][./\x20-][01]?[0-9][./\x20-](?:19|20)[0-9]{2}|[0-9]+\.[0-9]{1,2})$"
)
KINDS = list(BASE)
FEATURES = ["kind", "n_chars", "n_digits", "n_letters", "n_groups", "longest", "first_digit", "brackets", "dots", "blanks", "luhn", "octets", "hint", "joined_before", "joined_after"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is right: every second digit from the right doubled, nines cast out."""
    backward = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(backward.substr(i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": lambda v: F.length(_digits(v)).between(16, 19) & luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def matches(text: Column, pattern: str, needed: str) -> Column:
    """(start, end, value, before, after) of the leftmost non-overlapping matches, in order.

    Texts between matches come from a split by the same pattern; positions
    are running sums of the lengths of both.
    """
    there = text.contains(needed) if needed == "@" else text.rlike(needed)
    shape = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # zipped once: a lambda that looked into the gaps would split the text again for every match
    zipped = F.filter(F.arrays_zip(values, gaps, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0)))), lambda z: z["0"].isNotNull())
    indexed = F.transform(zipped, lambda z: F.struct(z["0"].alias("v"), z["1"].alias("a"), z["2"].alias("b")))

    def step(done: Column, m: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        begin = F.coalesce(last["end"], F.lit(0))
        before = F.concat(F.coalesce(last["before"], F.lit("")), F.coalesce(last["value"], F.lit("")), m["a"])
        start = begin + F.length(m["a"])
        row = F.struct(start.alias("start"), (start + F.length(m["v"])).alias("end"), m["v"].alias("value"), F.right(before, F.lit(24)).alias("before"), F.left(m["b"], F.lit(8)).alias("after"))
        return F.concat(done, F.array(row)).cast(shape)

    return F.when(there, F.aggregate(indexed, F.array().cast(shape), step)).otherwise(F.array().cast(shape))


def _numbers(text: Column, begun: Column) -> Column:
    """From every digit group that begins a number (as ``matches`` has it), the spans to each later end of a group with 7 to 15 digits."""
    behind = (F.regexp_extract_all(text, F.lit(LOOSE["phone"]), F.lit(n)) for n in (1, 2))
    whole = F.transform(
        F.filter(F.arrays_zip(begun, *behind), lambda z: z["0"].isNotNull()),
        lambda z: F.struct(z["0"]["start"].alias("start"), z["0"]["before"].alias("before"), F.concat(F.regexp_extract(z["0"]["value"], r"^\+?\(?[0-9]", 0), z["1"]).alias("full"), z["2"].alias("rest")),
    )

    def spans(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(7), F.length(w["full"])), lambda i: w["full"].substr(i, F.lit(2)).rlike("^[0-9](?![0-9])") & (F.length(_digits(w["full"].substr(F.lit(1), i))) >= 7))

        def span(i: Column) -> Column:
            after = F.left(F.concat(w["full"].substr(i + 1, F.length(w["full"])), w["rest"]), F.lit(8))
            return F.struct(w["start"].alias("start"), (w["start"] + i).alias("end"), w["full"].substr(F.lit(1), i).alias("value"), w["before"].alias("before"), after.alias("after"))

        return F.transform(ends, span)

    return F.flatten(F.transform(whole, spans))


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the matches of the base pattern that pass its check."""
    def kept(kind: str) -> Column:
        return F.filter(matches(text, BASE[kind], NEEDED[kind]), lambda m: CHECKS[kind](m["value"]))

    return {kind: kept(kind) for kind in KINDS}


def _against(kind: str, m: Column) -> Column:
    """Whether format or context speak against a proposal."""
    if kind == "email":
        return ~m["value"].rlike("[A-Za-z]{2}$")
    digits = _digits(m["value"])
    joined = m["before"].rlike(r"[\p{L}\p{N}]$") | m["after"].rlike(r"^[\p{L}\p{N}]")
    context = m["before"].rlike(AGAINST_BEFORE) | m["after"].rlike(AGAINST_AFTER)
    own = {
        "ip": lambda: ~_octets(m["value"]) | m["before"].rlike(r"[0-9]\.$") | m["after"].rlike(r"^\.[0-9]"),
        "card": lambda: ~F.length(digits).between(12, 19) | ~luhn(digits),
        "phone": lambda: ~F.length(digits).between(7, 15) | m["value"].rlike(OTHER_SHAPES),
    }
    return joined | context | own[kind]()


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def proposals(text: Column) -> Column:
    """All proposed spans of all kinds with their features."""
    def of_kind(number: int, kind: str) -> Column:
        def described(m: Column) -> Column:
            value = F.regexp_replace(m["value"], r"^\+", "")
            digits, groups = _digits(value), F.split(value, "[^A-Za-z0-9]+")
            features = {
                "kind": F.lit(float(number)),
                # an at sign counts as much as its written form
                "n_chars": F.length(F.regexp_replace(value, r"(?i)\x20?[\[({](at|dot|\.)[\])}]\x20?", ".")).cast("double"),
                "n_digits": F.length(digits).cast("double"),
                "n_letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"),
                "n_groups": F.size(groups).cast("double"),
                "longest": F.array_max(F.transform(groups, F.length)).cast("double"),
                "first_digit": F.coalesce(F.left(digits, F.lit(1)).try_cast("double"), F.lit(-1.0)),
                "brackets": _flag(value.contains("(")) if kind == "phone" else F.lit(0.0),
                "dots": F.length(F.regexp_replace(value, r"[^.]", "")).cast("double") if kind != "email" else F.lit(0.0),
                "blanks": F.length(F.regexp_replace(value, r"[^\x20]", "")).cast("double") if kind != "email" else F.lit(0.0),
                "luhn": _flag(luhn(digits)) if kind == "card" else F.lit(0.0),
                "octets": _flag(_octets(value)) if kind == "ip" else F.lit(0.0),
                "hint": _flag(m["before"].rlike(f"(?i){CONTEXT[kind]}")),
                "joined_before": _flag(m["before"].rlike(r"[\p{L}\p{N}.,-]$")),
                "joined_after": _flag(m["after"].rlike(r"^(?:[\p{L}\p{N}]|[.,-][0-9])")),
            }
            return F.struct(F.lit(kind).alias("what"), m["start"].alias("start"), m["end"].alias("end"), *(features[f].alias(f) for f in FEATURES), _against(kind, m).alias("against"))

        found = matches(text, LOOSE[kind], LOOSE_NEEDED[kind])
        return F.transform(_numbers(text, found) if kind == "phone" else found, described)

    return F.concat(*(of_kind(i, kind) for i, kind in enumerate(KINDS)))


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _label(p: Column) -> Column:
    """1 for a proposal that holds a base span of its kind, 0 for one that something speaks against, else null."""
    holds = F.exists("_base", lambda b: (b["what"] == p["what"]) & (p["start"] <= b["start"]) & (b["end"] <= p["end"]))
    own = F.exists("_base", lambda b: (b["what"] == p["what"]) & _touches(b, p))
    return F.when(holds, 1.0).when(~own & (p["against"] | F.exists("_base", lambda b: _touches(b, p))), 0.0)


def _tree(node) -> tuple:
    """A fitted tree as nested (feature, threshold, left, right) or a number."""
    if node.subtreeDepth() == 0:
        return (node.prediction(),)
    split = node.split()
    return (FEATURES[split.featureIndex()], split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def _score(tree: tuple, row: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    name, threshold, left, right = tree
    return F.when(row[name] <= threshold, _score(left, row)).otherwise(_score(right, row))


class Model:
    """Weighted trees and a threshold per kind."""

    def __init__(self, trees: list[tuple[float, tuple]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, row: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * _score(tree, row)
        return total


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (spans of all kinds) and ``_loose`` (proposals)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = base_spans(text)

    def named(kind: str) -> Column:
        return F.transform(spans[kind], lambda m: F.struct(F.lit(kind).alias("what"), m["start"].alias("start"), m["end"].alias("end")))

    return docs.withColumn("_base", F.concat(*map(named, KINDS))).withColumn("_loose", proposals(text))


def fit(docs: DataFrame) -> Model | None:
    """Trees from a bounded sample of the documents, thresholds from all others; None if there is too little to learn from."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    some = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id").distinct()
    ids = [r["doc_id"] for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).collect()]
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    fitted_on = F.coalesce(F.col("doc_id").isin(ids) & (half == 0), F.lit(False))

    def labelled(some: DataFrame) -> DataFrame:
        # outer: a plain explode gets a filter on the size of the array below it, which builds the proposals again
        each = with_candidates(some.select("doc_id", "text")).select("doc_id", "_base", F.explode_outer("_loose").alias("p"))
        rows = each.select("doc_id", F.col("p.what").alias("what"), F.col("p.start").alias("start"), *(F.col(f"p.{f}").alias(f) for f in FEATURES), _label(F.col("p")).alias("label"))
        return rows.filter("label is not null")

    rows = labelled(docs.filter(fitted_on)).orderBy(F.xxhash64("doc_id", "start", "what")).limit(FIT_ROWS)
    rows = materialize(rows, "proposals")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(y, 0) for y in (0.0, 1.0)) < LEAST:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3).fit(assembled.select("features", "label"))
    trees = [(w, _tree(t._java_obj.rootNode())) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)]
    model = Model(trees, {})
    # calibration: per kind and score, how many labelled proposals at least as high are confirmed, in all documents the trees have not seen
    row = F.struct(*FEATURES)
    scored = labelled(docs.filter(F.col("text").rlike(r"[0-9@]|[\[({](?:at|AT)[\])}]") & ~fitted_on)).select("what", "label", F.round(model.score(row), 2).alias("score"))
    levels = scored.groupBy("what", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    for kind in KINDS:
        good = total = 0
        for r in sorted((r for r in levels if r["what"] == kind), key=lambda r: -r["score"]):
            good, total = good + r["good"], total + r["n"]
            if total >= LEAST and good >= PRECISION * total and r["score"] > 0:
                model.thresholds[kind] = r["score"] - 0.005
    return model


def with_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (what, start, end) by kind, then start."""
    found = with_candidates(docs)
    plain = lambda p: F.struct(p["what"].alias("what"), p["start"].alias("start"), p["end"].alias("end"))
    added = F.slice("_base", 1, 0)
    if model is not None and model.thresholds:
        high = F.lit(False)

        def passes(p: Column) -> Column:
            good = high
            for kind, t in model.thresholds.items():
                good = good | ((p["what"] == kind) & (p["score"] >= t))
            return good

        free = F.filter("_loose", lambda p: ~F.exists("_base", lambda b: _touches(p, b)))
        scored = F.transform(free, lambda p: F.struct(p["what"].alias("what"), p["start"].alias("start"), p["end"].alias("end"), model.score(p).alias("score")))
        best_first = F.transform(F.filter(scored, passes), lambda p: F.struct((-p["score"]).alias("order"), p["start"].alias("start"), (-p["end"]).alias("back"), p["what"].alias("what"), p["end"].alias("end")))
        ordered = F.array_sort(best_first)
        # greedily: a span stays if it touches none that stays before it
        added = F.transform(F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, p: F.when(F.exists(kept, lambda q: _touches(p, q)), kept).otherwise(F.concat(kept, F.array(p)))), plain)
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(F.concat("_base", added), lambda p: F.struct(rank[p["what"]].alias("rank"), p["start"].alias("start"), p["end"].alias("end"), p["what"].alias("what")))
    ordered = F.transform(F.array_sort(keyed), plain)
    return found.withColumn("base_spans", F.col("_base")).withColumn("spans", ordered).drop("_base", "_loose")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["what"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    inside, back = set_apart(docs, "doc_id", "text")
    found = with_spans(inside, fit(inside))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["what"].alias("what"))))
    blank = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        mark = F.when(s["start"] >= done["at"], F.concat(gap, F.lit("["), F.upper(s["what"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["text"], mark).alias("text"))

    clean = F.aggregate(by_start, blank, step, lambda d: F.concat(d["text"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    some = (F.size("spans") > 0) & F.col("text").isNotNull()
    return back(found.withColumn("text", F.when(some, clean).otherwise(F.col("text"))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_spans(docs, fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["what"] == kind)).cast("long").alias(f"n_{kind}")

    n = map(count, KINDS)
    return found.select("doc_id", *n, F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
