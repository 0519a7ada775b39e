r"""Personal data: four base patterns, and contexts bootstrapped from what they find.

Base spans come from regular expressions. Java finds matches but not their places, so a text is
split at the same expression: the lengths of gaps and matches are the places. Every expression can
only start where a run starts or where the last match ended, and repeats possessively, which finds
the same spans in linear time.

Bootstrapping: words with a digit or an @ are instances, those under a base span are seeds (the later
words of a span, only where they stand). The word before an instance is its pattern, also if it is an
instance itself; then "label #k" is a second one, for the last other word and the k instances since.
Without a word before it, an instance has no pattern. A pattern's confidence is the summed score of its instances over
all occurrences of that word, or of that label with k instances, in the corpus; an instance's score is the noisy or of its patterns'
confidence, and 1 for a seed. Both are computed in turn over the aggregated graph of (pattern,
instance) pairs; they only rise, and rounds go on until no score does, so a pattern without seeds
counts once others have its instances accepted. Instances with a score over the threshold that follow a confident pattern (enough
different values, mostly identifiers) are spans of kind ``context``.

Only SQL functions run. Defined cases: a null text is empty; an empty table gives no rows; repeated
rows have the same spans and count as occurrences each; rows that share a doc_id are told apart by
their text; input columns that clash with the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import WORD, doc_key, once, stored, text_version
from vintager.operators.sizing import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
_USER, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_USER})){_USER}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = INSTANCE + r"(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"

LEAST_VALUES = 3
CONFIDENT = 0.5
ACCEPTED = 0.7
# Scores that rise by less in a round have settled.
SETTLED = 1e-9
# Context spans of all documents that are broadcast; a span is some 60 bytes.
BROADCAST_SPANS = 100_000
# Matches of a text that are listed one by one before the lists are put together.
STRETCH = 256
SPAN = "array<struct<start:long,end:long,place:int,kind:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False)


def located(docs: DataFrame, text: Column, expression: str, name: str, when: Column) -> DataFrame:
    """``docs`` with ``name``: (start, end, match, gap before it) of every match, in code points."""
    pattern = F.lit(expression)
    pieces = docs.withColumns(
        {
            "__found": once(F.when(when, F.regexp_extract_all(text, pattern, F.lit(0)))),
            "__gaps": once(F.when(when, F.split(text, expression, -1))),
        }
    )
    empty = F.array().cast("array<struct<start:long,end:long,match:string,gap:string>>")

    def step(acc: Column, i: Column) -> Column:
        gap, match = F.get("__gaps", i), F.get("__found", i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(match)
        one = F.struct(
            start.alias("start"), end.alias("end"), match.alias("match"), gap.alias("gap")
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # Appending copies the list, so matches are gathered in stretches that are put together once.
    def stretch(acc: Column, low: Column) -> Column:
        numbers = F.sequence(low, F.least(low + STRETCH, F.size("__found")) - 1)
        begun = F.struct(F.element_at(acc, -1)["at"].alias("at"), empty.alias("out"))
        return F.concat(acc, F.array(F.aggregate(numbers, begun, step)))

    begun = F.array(F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")))
    starts = F.expr(f"sequence(0, size(__found) - 1, {STRETCH})")
    spans = F.flatten(F.aggregate(starts, begun, stretch)["out"])
    some = F.coalesce(F.size("__found") > 0, F.lit(False))
    return pieces.withColumn(name, once(F.when(some, spans).otherwise(empty))).drop("__found", "__gaps")


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: valid base spans by (start, end, place of kind, kind)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    digit = body.rlike("[0-9]")
    for kind in KINDS:
        needed = NEEDS[kind]
        when = digit if needed is None else F.instr(body, needed) > 0
        if kind == "ip":
            when = when & digit
        docs = located(docs, body, EXPRESSIONS[kind], f"__{kind}", when)

    def spans(place: int, kind: str) -> Column:
        kept = F.filter(f"__{kind}", lambda m: _valid(kind, m["match"]))
        return F.transform(
            kept,
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                F.lit(place).alias("place"), F.lit(kind).alias("kind"),
            ),
        ).cast(SPAN)

    kinds = [spans(place, kind) for place, kind in enumerate(KINDS)]
    order = "(a, b) -> CASE WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1)" \
        " ELSE a.place - b.place END"
    with_all = docs.withColumn("__all", F.concat(*kinds)).drop(*[f"__{k}" for k in KINDS])
    return with_all.withColumn("base", once(F.expr(f"array_sort(__all, {order})"))).drop("__all")


def _instances(docs: DataFrame) -> DataFrame:
    """(doc, ver, covered, begins, start, end, value, label, place, previous) of every instance.

    A run is a sequence of instances with nothing else between; label is the word before it, place
    counts the run's earlier instances, and previous is the one just before.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        doc_key().alias("doc"), text_version().alias("ver"), "text", "base"
    )
    runs = located(slim, body, RUN, "__runs", body.rlike("[0-9@]")).select(
        "doc", "ver", "base", F.explode("__runs").alias("run")
    )
    label = F.regexp_extract(F.col("run.gap"), rf"({WORD})[\x20\x09-\x0D]+$", 1)
    listed = located(runs, F.col("run.match"), WORD, "__words", F.lit(True)).select(
        "doc", "ver", "base", F.col("run.start").alias("from"), label.alias("label"),
        F.transform(
            "__words",
            lambda w, i: w.withField("previous", F.get("__words", i - 1)["match"]),
        ).alias("__words"),
    )
    rows = listed.select(
        "doc", "ver", "base", "from", "label", F.posexplode("__words").alias("place", "w")
    ).withColumns({"begin": F.col("from") + F.col("w.start"), "stop": F.col("from") + F.col("w.end")})
    under = F.expr("filter(base, s -> s.start < stop AND s.end > begin)")
    value = F.regexp_replace(F.lower("w.match"), EDGES, "")
    return rows.select(
        "doc", "ver",
        (F.col("begin") + F.length(F.regexp_extract("w.match", r"^[^\p{L}\p{N}]*", 0))).alias("start"),
        value.alias("value"), _pattern(F.col("label")).alias("label"), "place",
        _pattern(F.col("w.previous")).alias("previous"),
        (F.size(under) > 0).alias("covered"),
        F.exists(under, lambda s: s["start"] >= F.col("begin")).alias("begins"),
    ).withColumn("end", F.col("start") + F.length("value"))


def _pattern(word: Column) -> Column:
    """The word in lower case without leading marks, unless it has nothing else."""
    bare = F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+", "")
    return F.when(bare == "", F.lower(word)).otherwise(bare)


def _after(label: Column, place: Column) -> Column:
    """The pattern of a label and ``place`` instances after it; no word has a blank."""
    return F.concat(label, F.lit(" #"), place)


def context_spans(docs: DataFrame) -> DataFrame:
    """(doc, ver, extra): spans that confident contexts add; ``docs`` has base spans."""
    spots = stored(_instances(docs))
    labelled = F.when(F.col("label") != "", F.when(F.col("place") == 0, F.col("label")).otherwise(
        _after(F.col("label"), F.col("place"))
    ))
    found = (
        spots.filter(F.col("value") != "")
        .withColumn("left", F.explode(F.array(labelled, F.col("previous"))))
        .filter(F.col("left").isNotNull())
    )
    graph = stored(
        found.groupBy("left", "value").agg(
            F.count("*").alias("n"),
            # The later words of a base span, which may be few digits, are seeds of their pattern only.
            F.max((F.col("covered") & ~F.col("begins")).cast("int")).alias("inner"),
            F.min(F.col("covered").cast("int")).alias("all_covered"),
        )
    )
    # Patterns with enough different values, accepted or not; the others can't become confident.
    wide = stored(
        graph.groupBy("left").agg(F.count("*").alias("values"), F.sum("n").alias("most"))
        .filter(F.col("values") >= LEAST_VALUES).select("left", "most")
    )
    body = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.explode(F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    ends = spots.filter(F.col("label") != "").select(
        _after(F.col("label"), F.col("place") + 1).alias("left")
    )
    total = stored(
        words.select(_pattern(F.col("w")).alias("left")).union(ends)
        .join(broadcast_if_small(wide), "left", "left_semi")
        .groupBy("left").agg(F.count("*").alias("total"))
    )
    # Nor can those that would lack confidence if all their instances were accepted.
    able = total.join(wide, "left").filter(F.col("most") / F.col("total") >= CONFIDENT)
    # Seeds are so wherever they stand, also after words that are no pattern.
    seeds = spots.filter("begins AND value <> ''").select("value", F.lit(1).alias("seed")).distinct()
    pairs = stored(
        graph.join(able.drop("most"), "left").join(seeds, "value", "left")
        .fillna(0, ["seed"])
        .withColumn("score", F.greatest("seed", "inner").cast("double"))
    )
    sure = F.col("score") >= ACCEPTED
    moved = True
    while moved:
        confidence = pairs.groupBy("left").agg(
            # What is not accepted yet counts as no identifier, so that doubt can't feed itself.
            (F.sum(F.when(sure, F.col("n") * F.col("score")).otherwise(0.0)) / F.max("total")).alias(
                "confidence"
            ),
            F.sum(F.when(sure, 1).otherwise(0)).alias("values"),
        )
        held = F.when(
            (F.col("values") >= LEAST_VALUES) & (F.col("confidence") >= CONFIDENT),
            F.least(F.col("confidence"), F.lit(1 - 1e-9)),
        ).otherwise(0.0)
        rated = pairs.withColumnRenamed("score", "was").join(
            confidence.select("left", held.alias("confidence")), "left"
        )
        scores = rated.groupBy("value").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("or"),
        )
        score = F.when((F.col("seed") == 1) | (F.col("inner") == 1), 1.0).otherwise(F.col("or"))
        pairs = stored(rated.join(scores, "value").withColumn("score", score).drop("or"))
        accepted = pairs.filter(
            (F.col("all_covered") == 0) & (F.col("confidence") > 0) & (F.col("score") >= ACCEPTED)
        ).select("left", "value")
        more = F.col("score") - F.col("was") > SETTLED
        moved = not pairs.filter(more | (sure & (F.col("was") < ACCEPTED))).isEmpty()
        pairs = pairs.drop("confidence", "was")
    chosen = broadcast_if_small(stored(accepted))
    span = F.struct(
        "start", "end", F.lit(len(KINDS)).alias("place"), F.lit("context").alias("kind")
    )
    return (
        found.filter(~F.col("covered")).join(chosen, ["left", "value"], "left_semi")
        .groupBy("doc", "ver").agg(F.collect_set(span).cast(SPAN).alias("extra"))
    )


def _checked(extra: DataFrame) -> DataFrame:
    """Broadcast ``extra`` if its spans, not only its rows, are few; else AQE joins by a shuffle."""
    total = extra.agg(F.sum(F.size("extra"))).first()[0] or 0
    return F.broadcast(extra) if total <= BROADCAST_SPANS else extra


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, end, place, kind) in order."""
    based = with_base(docs.drop("base", "spans"))
    extra = _checked(stored(context_spans(based)))
    side = extra.withColumnsRenamed({"doc": "__doc", "ver": "__ver"})
    on = (doc_key() == F.col("__doc")) & (text_version() == F.col("__ver"))
    joined = based.join(side, on, "left").drop("__doc", "__ver")
    both = F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))
    order = "(a, b) -> CASE WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1)" \
        " ELSE a.place - b.place END"
    return joined.withColumn("__both", both).withColumn(
        "spans", F.expr(f"array_sort(__both, {order})")
    ).drop("__both", "extra")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def reported(docs: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans, and all spans, per row of ``docs``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and n_chars to match."""
    columns = docs.columns
    # Columns of the input that have the names of columns made here stay as they are.
    own = {c: f"__own_{c}" for c in ("base", "spans", "extra") if c in columns}
    begun = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, more).otherwise(acc["out"]).alias("out"),
        )

    rows = found(docs.withColumnsRenamed(own)).withColumn(
        "__done", F.when(F.size("spans") > 0, F.aggregate("spans", begun, step))
    )
    rest = F.expr("substring(text, cast(__done.at as int) + 1)")
    text = F.when(F.col("__done").isNotNull(), F.concat(F.col("__done.out"), rest)).otherwise(
        F.col("text")
    )
    rows = rows.withColumn("__text", text)
    out = {"text": F.col("__text")}
    if "n_chars" in columns:
        changed = F.length("__text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("__done").isNotNull(), changed).otherwise(F.col("n_chars"))
    return rows.withColumns(out).select(*[F.col(own.get(c, c)).alias(c) for c in columns])
