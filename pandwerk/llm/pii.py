"""Personal data in texts: wide generators propose spans, boosted trees judge them, calibrated thresholds select.

Spans that pass the strict rules (the base) always stay, and they are what the trees learn from: a candidate of the wide
generators is told from a base span by its format and surroundings alone, never by what makes the strict rule pass (the
plus sign, the check digit, the size of an address part). A candidate that looks and stands like base spans is then
selected although the strict rule misses it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandwerk.llm.common import checkpointed, let
from pandwerk.llm.secrets import redact

KINDS = ("email", "ip", "card", "phone")

# Strict rules. Runs are taken whole and entered at their start only, so a search never goes back over a long run.
LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

# Wide generators: obfuscated addresses, numbers with other separators, without plus sign or check digit.
AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20|@)"
DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++{AT}{LABEL}++(?:{DOT}{LABEL}++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,4}}+(?:{DOT}[0-9]{{1,4}}+){{3}}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}+(?![\x20./-]{0,2}[0-9])",
    "phone": r"(?<![0-9+])(?:\+|\()?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}+(?![0-9])",
}
#: Words before a value that name it; they weigh in one feature only.
CUES = {"email": "mail|contact|write", "ip": "ip|address|host|server|node", "card": "card|visa|credit|iban|account|konto|carte|tarjeta",
        "phone": "phone|tel|call|fax|mobile|handy|cell"}
#: Characters before and after a span that the context features see.
AROUND = 24
TREES, DEPTH = 20, 4
#: Examples a leaf holds at least: proposals that stand alone among base spans are not carved out as counterexamples.
LEAF = 20
#: Share of base spans among all that a kind's threshold lets through, at least, and base spans needed to tell.
PRECISION, EVIDENCE = 0.95, 20
#: Steps of the probability at which thresholds are sought.
STEPS = 200

#: Matches whose places are added up one after the other; longer lists are placed block by block.
BLOCK = 256

HIT = "struct<start:int,end:int,text:string,before:string,after:string>"
SPAN = "struct<kind:string,place:int,start:int,end:int,base:boolean,x:array<double>>"


def _none(entry: str) -> Column:
    return F.expr(f"cast(array() as array<{entry}>)")


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text, before, after>> of the leftmost non-overlapping matches, in code points, end exclusive;
    before and after: up to AROUND characters beside a match, not reaching into the matches next to it.

    Gaps and matches alternate, so running lengths over both give every place. They are summed block by block, which keeps
    texts with very many matches from copying a growing list for each.
    """
    def placed(gaps, hits):
        blocks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))
        lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        add = lambda values: F.aggregate(values, F.lit(0), lambda a, v: a + v)
        totals = F.transform(blocks, lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

        def one_block(b, sums):
            parts = F.transform(F.slice(hits, b * BLOCK + 1, F.lit(BLOCK)), lambda h, i: F.struct(
                h.alias("h"), F.element_at(gaps, b * BLOCK + i + 1).alias("g"), F.element_at(gaps, b * BLOCK + i + 2).alias("n")))
            state = F.struct(add(F.slice(sums, F.lit(1), b)).alias("at"), _none(HIT).alias("out"))

            def step(s, part):
                begin = s["at"] + F.length(part["g"])
                end = begin + F.length(part["h"])
                return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(
                    begin.alias("start"), end.alias("end"), part["h"].alias("text"),
                    F.substring(part["g"], -AROUND, AROUND).alias("before"), F.substring(part["n"], 1, AROUND).alias("after")))).alias("out"))

            return F.aggregate(parts, state, step)["out"]

        return let(totals, lambda sums: F.flatten(F.transform(blocks, lambda b: one_block(b, sums))))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(~text.rlike(pattern), _none(HIT)).otherwise(
        let(whole, lambda hits: let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits))))


def _luhn(value: Column) -> Column:
    """Whether the digits' alternate doubling adds up to a multiple of ten."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def weigh(d, i):
        digit = d.cast("int")
        return F.when(i % 2 == 0, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    ones = F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(ones, weigh), F.lit(0), lambda a, d: a + d) % 10 == 0


def _n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _found(text: Column, kind: str, pattern: str, base: bool, keep=None) -> Column:
    hits = located(text, pattern)
    if keep is not None:
        hits = F.filter(hits, lambda m: keep(m["text"]))
    return F.transform(hits, lambda m: F.struct(
        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("place"), m["start"].alias("start"), m["end"].alias("end"),
        F.lit(base).alias("base"), features(kind, m["text"], m["before"], m["after"]).alias("x")))


def base_spans(text: Column) -> Column:
    """The strict rules' spans by kind, then start."""
    return F.concat(
        _found(text, "email", EMAIL, True), _found(text, "ip", IP, True, lambda v: v.rlike(OCTETS)),
        _found(text, "card", CARD, True, _luhn), _found(text, "phone", PHONE, True, lambda v: _n_digits(v).between(8, 15)))


def candidates(text: Column) -> Column:
    """array<struct<kind, place, start, end, base, x>>: base spans, then all wide proposals. Proposals overlap freely."""
    return F.concat(base_spans(text), *[_found(text, k, p, False) for k, p in WIDE.items()])


def _class_of(char: Column) -> Column:
    return (F.when(char == "", 0).when(char.rlike(r"[\x20\x09-\x0D]"), 1).when(char.rlike(r"\p{L}"), 2).when(char.rlike("[0-9]"), 3)
            .when(char.isin('"', "'", "`"), 4).when(char.rlike(r"[.,;:!?()\[\]{}<>]"), 5).otherwise(6))


def features(kind: str, value: Column, before: Column, after: Column) -> Column:
    """array<double> of one candidate: its kind, the format of the value without its joiners and prefix, and context."""
    plain = {"email": F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, "."), "ip": F.regexp_replace(value, DOT, "."),
             "card": value, "phone": F.regexp_replace(value, r"^(?:\+|00)", "")}[kind]
    count = lambda s, chars: F.length(F.regexp_replace(s, f"[^{chars}]", ""))

    def listed(p):
        groups = F.filter(F.split(p, "[^A-Za-z0-9]+"), lambda g: g != "")
        return let(groups, lambda g: F.array(*[v.cast("double") for v in (
            F.lit(KINDS.index(kind)), F.length(p), count(p, "0-9"), count(p, "A-Za-z"), F.size(g), F.array_max(F.transform(g, F.length)),
            F.length(F.try_element_at(g, F.lit(1))), F.length(F.try_element_at(g, F.lit(-1))),
            F.size(F.array_distinct(F.regexp_extract_all(p, F.lit("[0-9]"), F.lit(0)))), p.startswith("0"), p.contains("("),
            _class_of(F.substring(before, -1, 1)), _class_of(F.substring(after, 1, 1)),
            count(before, r"\p{L}"), count(before, "0-9"), count(before, r"\p{Lu}"), count(before, r"\x20"),
            count(after, r"\p{L}"), count(after, "0-9"), count(after, r"\p{Lu}"), count(after, r"\x20"),
            before.rlike(f"(?i)(?:{CUES[kind]})"))]))

    return let(plain, listed)


def _beside_base(spans: DataFrame) -> DataFrame:
    """Add `covered` (overlaps a base span) and `same` (one of its own kind) to every span of a text, from running ends
    and starts in the order of place: no pair of spans is compared."""
    forward = Window.partitionBy("_rid").orderBy("start", F.desc("base"), "end", "place")
    backward = Window.partitionBy("_rid").orderBy(F.desc("start"), "base", F.desc("end"), F.desc("place"))

    def seen(over, reach, value, kind=None):
        which = F.col("base") if kind is None else F.col("base") & (F.col("kind") == kind)
        return reach(F.when(which, F.col(value))).over(over.rowsBetween(Window.unboundedPreceding, -1))

    ends = {k: seen(forward, F.max, "end", k).alias(f"_end_{k}") for k in (None, *KINDS)}
    starts = {k: seen(backward, F.min, "start", k).alias(f"_start_{k}") for k in (None, *KINDS)}
    marked = spans.select("*", *ends.values()).select("*", *starts.values())

    def meets(k):
        return F.coalesce((F.col(f"_end_{k}") > F.col("start")) | (F.col(f"_start_{k}") < F.col("end")),
                          F.col(f"_end_{k}") > F.col("start"), F.col(f"_start_{k}") < F.col("end"), F.lit(False))

    same = F.lit(False)
    for k in KINDS:
        same = F.when(F.col("kind") == k, meets(k)).otherwise(same)
    return marked.select(*spans.columns, meets(None).alias("covered"), same.alias("same"))


@dataclass(frozen=True)
class Judge:
    """Fitted trees as (weight, nested tuples) and the least probability per kind. A kind without a threshold, or without
    anything to learn from, gets no spans beyond the base."""

    trees: tuple
    thresholds: dict[str, float]

    def probability(self, x: Column) -> Column:
        def value(node):
            if len(node) == 1:
                return F.lit(node[0])
            at, threshold, left, right = node
            return F.when(x[at] <= threshold, value(left)).otherwise(value(right))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * value(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> tuple:
    """A fitted tree as (prediction,) or (feature, threshold, left, right)."""
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(examples: DataFrame, precision: float = PRECISION, evidence: int = EVIDENCE) -> Judge:
    """`examples`: (kind, base, x, h) of every candidate, h a hash of its text and place. Every candidate takes part, copies
    of one text once: two thirds fit the trees, one third sets the thresholds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    distinct = checkpointed(examples.dropDuplicates(["h"]).withColumn("part", F.pmod(F.xxhash64("h", F.lit("part")), F.lit(3))).orderBy("h"))
    rows = distinct.where("part > 0").select(F.col("base").cast("double").alias("label"), array_to_vector("x").alias("features"))
    if rows.select("label").distinct().count() < 2:
        return Judge((), {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=LEAF, seed=0).fit(rows)
    judge = Judge(tuple(zip(map(float, model.treeWeights), (_tree(t._call_java("rootNode")) for t in model.trees))), {})
    step = F.floor(judge.probability(F.col("x")) * STEPS).cast("int")
    bins = distinct.where("part = 0").groupBy("kind", step.alias("step")).agg(
        F.count("*").alias("all"), F.count_if("base").alias("base")).collect()
    thresholds = {}
    for kind in KINDS:
        total = base = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["step"]):
            total, base = total + r["all"], base + r["base"]
            if base >= precision * total and base >= evidence:
                thresholds[kind] = r["step"] / STEPS
    return Judge(judge.trees, thresholds)


def pii_spans(docs: DataFrame, text: str = "text", *, carry: tuple[str, ...] | None = None,
              precision: float = PRECISION, evidence: int = EVIDENCE) -> tuple[DataFrame, Judge]:
    """(rows, judge). Rows: the `carry` columns (default: all but the text) as _c0, _c1, ... and `spans`: array<struct<kind,
    start, end, base, probability>> by kind as in KINDS, then start; places in code points, end exclusive.

    Base spans of one text are those of the four strict rules, leftmost and without overlap per kind; all stay. Proposals
    that overlap no base span are added where `fit`'s trees put them at or above their kind's threshold. Null and empty
    texts have none; repeated rows stay; an empty table, or one without examples of both sorts, gives base spans only. Texts
    are searched whole, once, and their candidates written without the texts; only rows with candidates are shuffled.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else list(carry)
    body = F.col(f"`{text}`")
    names = [f"_c{i}" for i in range(len(carry))]
    staged = checkpointed(docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.xxhash64(body).alias("_h"),
        candidates(F.coalesce(body, F.lit(""))).cast(f"array<{SPAN}>").alias("_found")).withColumn("_rid", F.monotonically_increasing_id()))
    spans = checkpointed(_beside_base(staged.where("size(_found) > 0").select("_rid", "_h", F.inline("_found"))))
    judge = fit(spans.where("base or not same").select("kind", "base", "x", F.xxhash64("_h", "kind", "start", "end").alias("h")),
                precision, evidence)
    probability = judge.probability(F.col("x")) if judge.trees else F.lit(None).cast("double")
    least = F.lit(2.0)
    for kind, value in judge.thresholds.items():
        least = F.when(F.col("kind") == kind, value).otherwise(least)
    kept = spans.withColumn("probability", probability).where(F.col("base") | (~F.col("covered") & (F.col("probability") >= least)))
    fields = ("kind", "start", "end", "base", "probability")
    per_row = kept.groupBy("_rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", *fields[1:], "kind"))), lambda s: F.struct(
        *[s[f].alias(f) for f in fields])).alias("spans"))
    none = _none("struct<kind:string,start:int,end:int,base:boolean,probability:double>")
    quiet = staged.where("size(_found) = 0").select(*names, none.alias("spans"))
    loud = staged.where("size(_found) > 0").select(*names, "_rid").join(per_row, "_rid", "left").select(
        *names, F.coalesce("spans", none).alias("spans"))
    return quiet.unionByName(loud), judge


def span_text(spans: Column) -> Column:
    """`kind:start:end`, joined by commas, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by a mark, overlapping ones by one."""
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(0))
    return redact(F.coalesce(text, F.lit("")), by_start, "[private]")
