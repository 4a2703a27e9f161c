"""Secret scan: pattern candidates in every text, told apart by how many owners share their value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import checkpointed, let

#: Base kinds in the order that breaks ties; pattern, least length, what has that length and is the secret value.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Bare tokens: what the corpus-wide step may add. Any long base64 or base64url run with a digit and a letter is a
#: candidate and is counted; its owners and its disorder decide whether it is added.
BARE_CHARS = "[A-Za-z0-9+/_-]"
BARE_END = "={0,2}"
KINDS = ("assign", "access", "hex", "bare")
LEAST = {"assign": 8, "access": 16, "hex": 32, "bare": 20}
#: A value is disordered if two characters drawn from it are equal with a chance of at most 1 / COLLISIONS (3 bits of
#: collision entropy) and it changes between digits, capitals and small letters once in RUN characters or more. A
#: capital before small letters starts a word and is no change of its own.
COLLISIONS, RUN = 8, 4
RUNS = r"[0-9]+|[A-Z]?[a-z]+|[A-Z]+"

#: A value seen with this many distinct owners is a widely copied example; below it is taken as live.
EXAMPLE_OWNERS = 3

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Gaps and matches alternate, so a running length over both gives every place; nothing is searched twice.
    """
    def place(gaps, hits):
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

        def step(state, s):
            begin = state["at"] + F.length(s["g"])
            end = begin + F.length(s["h"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
                begin.alias("start"), end.alias("end"), s["h"].alias("text")))).alias("out"))

        return F.aggregate(steps, start, step)["out"]

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(whole, lambda hits: F.when(F.size(hits) == 0, F.expr(
        "cast(array() as array<struct<start:int,end:int,text:string>>)")).otherwise(
            let(F.split(text, pattern, -1), lambda gaps: place(gaps, hits))))


def _spans(kind: str, found: Column, value, keep) -> Column:
    return F.transform(F.filter(found, lambda m: keep(value(m["text"]))), lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), value(m["text"]).alias("value")))


def disordered(value: Column) -> Column:
    """Does a value look drawn at random? In whole numbers, so that borders are exact."""
    letters = F.split(value, "")
    squares = F.aggregate(F.array_distinct(letters), F.lit(0).cast("long"), lambda s, c: s + F.pow(
        F.length(value) - F.length(F.replace(value, c, F.lit(""))), 2).cast("long"))
    size = F.length(value).cast("long")
    runs = F.size(F.regexp_extract_all(F.regexp_replace(value, "[^A-Za-z0-9]", ""), F.lit(RUNS), F.lit(0)))
    return (COLLISIONS * squares <= size * size) & (RUN * runs >= size)


def candidate_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of every candidate in a text; null and empty texts have none.

    The long-run searches start only in texts that hold such a run.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    same = lambda t: t
    assigned = lambda t: F.regexp_extract(t, ASSIGN, 1)
    long_run = {"hex": rf"[0-9a-f]{{{LEAST['hex']}}}", "bare": rf"{BARE_CHARS}{{{LEAST['bare']}}}"}
    parts = [
        _spans("assign", _matches(text, ASSIGN), assigned, lambda v: F.length(v) >= LEAST["assign"]),
        _spans("access", _matches(text, ACCESS), same, lambda v: F.length(v) >= LEAST["access"]),
        # a failing match of a plain run is a shorter run, so the least length can be part of the pattern
        F.when(text.rlike(long_run["hex"]), _spans(
            "hex", _matches(text, rf"[0-9a-f]{{{LEAST['hex']},}}"), same, lambda v: F.lit(True))).otherwise(none),
        F.when(text.rlike(long_run["bare"]), _spans(
            "bare", _matches(text, rf"{BARE_CHARS}{{{LEAST['bare']},}}{BARE_END}"), same,
            lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))).otherwise(none),
    ]
    return F.concat(*parts)


def _without_covered(spans: Column) -> Column:
    """Drop bare candidates that overlap a base span."""
    def body(all_spans):
        base = F.filter(all_spans, lambda s: s["kind"] != "bare")
        return let(base, lambda b: F.filter(all_spans, lambda s: (s["kind"] != "bare") | ~F.exists(
            b, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))))
    return let(spans, body)


def secret_spans(docs: DataFrame, text: str = "text", *, owner: list[Column], repo: list[Column],
                 example_owners: int = EXAMPLE_OWNERS, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add `secrets`: array<struct<kind, start, end, value_hash, owners, repos, verdict>> in order of place.

    Every base match stays, with verdict `live` or `example`; bare tokens are added only when live and disordered. A value's
    hash is counted over all texts: distinct owners, and distinct repositories within owners, by two partial
    aggregates, so that a value in a third of all rows is reduced before each shuffle. `example_owners` or more
    owners make it an example. Owners and repositories may be null; nulls count as one owner or repository.
    `carry` names the columns that go along (default: all but the text). Null and empty texts get an empty
    array; repeated rows are kept and count as one owner; an empty table gives an empty result.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else list(carry)
    own = F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in owner])
    rep = F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in repo])
    staged = checkpointed(docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]).alias("_row"), own.alias("_owner"), rep.alias("_repo"),
        F.transform(_without_covered(candidate_spans(F.col(text))), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("value_hash"),
            ((s["kind"] != "bare") | disordered(s["value"])).alias("fits"))).alias("_spans"),
    ).withColumn("_rid", F.monotonically_increasing_id()))

    found = staged.select("_rid", "_owner", "_repo", F.explode("_spans").alias("s"))
    stats = (found.groupBy(F.col("s.value_hash").alias("value_hash"), "_owner", "_repo").agg(F.lit(1).alias("one"))
             .groupBy("value_hash", "_owner").agg(F.count("*").alias("repos"))
             .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))
    judged = (found.select("_rid", "s.*").join(stats, "value_hash")
              .withColumn("verdict", F.when(F.col("owners") >= example_owners, "example").otherwise("live"))
              .where("kind <> 'bare' or (fits and verdict = 'live')"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    entry = F.struct("start", order.alias("place"), "end", "kind", "value_hash", "owners", "repos", "verdict")
    per_row = judged.groupBy("_rid").agg(F.sort_array(F.collect_list(entry)).alias("_judged"))
    secrets = F.transform(F.coalesce("_judged", F.array()), lambda s: F.struct(
        *[s[c].alias(c) for c in ("kind", "start", "end", "value_hash", "owners", "repos", "verdict")]))
    # only rows with a candidate are joined; the rest pass by
    quiet = staged.where("size(_spans) = 0").select("_row", F.lit(None).cast(per_row.schema["_judged"].dataType).alias("_judged"))
    loud = staged.where("size(_spans) > 0").select("_row", "_rid").join(per_row, "_rid", "left").select("_row", "_judged")
    return quiet.union(loud).select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(carry)], secrets.alias("secrets"))


def span_text(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """Replace every span of a text by `mark`; overlapping spans by one. Spans are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        covered = s["end"] <= state["at"]
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        marked = F.when(s["start"] < state["at"], F.lit("")).otherwise(F.lit(mark))
        return F.when(covered, state).otherwise(F.struct(
            s["end"].alias("at"), F.concat(state["out"], between, marked).alias("out")))

    return let(F.aggregate(spans, start, step), lambda done: F.concat(
        done["out"], F.substring(text, done["at"] + 1, F.length(text))))
