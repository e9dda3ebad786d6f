"""Personal data: base patterns as seeds, then bootstrapped contextual extraction. DataFrame operations only.

Base spans of four kinds are found by regular expressions that give exactly the matches of the stated ones but run in
linear time on any text: possessive, and tried only where a match can begin. Positions are running sums of the lengths of
matches and of what lies between them, taken in stretches of ``STRETCH`` matches, so a text with very many of them costs
in proportion. The base spans seed the extraction: each mention, a base span or another identifier-like word, is an
instance, the words around it make two lexical patterns, and patterns and instances form a graph. A pattern's confidence
for a kind is the mean confidence of its instances, an instance's that of not being missed by all of its patterns;
rounds spread confidence from the seeds to instances of the kind's shape until no score grows by ``SETTLED``. Patterns with
at least ``SUPPORT`` different seeds or confident instances of a kind and a confidence of ``CONFIDENT`` name the kind of further
mentions that have its shape.

Beside the four base kinds the method has a fifth, ``secret``: its seeds are long words of letters and digits that a
credential's name and a sign of assignment stand before. Its spans are among those that the method adds, last in order.

Defined cases: a null text is empty, and an empty text has no spans; equal rows get equal results, and rows that share
only a doc_id are judged apart; a null doc_id is kept; an empty table gives no rows; texts of any length are read whole;
other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.keys import join_keys
from weftline.storage import materialise

SETTLED, SUPPORT, CONFIDENT = 0.001, 3, 0.6
KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)  # the number of the method's own kind
NAMES = (*KINDS, "secret")
#: Matches that a running sum takes at a time: work grows with this many, and with the square of the stretches' number.
STRETCH = 256

# The stated patterns; \G lets a match begin where the one before ended, else it begins at the start of a run.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?:[0-9][0-9]++(?:[ -][0-9]++)*+|[0-9](?:[ -][0-9]++)++)",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# A word that holds a digit or an at sign.
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Several words of digits and the base patterns' separators with single spaces between them.
_RUN = r"(?<!\S)[+(]*+[0-9][0-9().-]*+(?: [(]?[0-9][0-9().-]*+)++"
SHORTEST = 7  # characters that a mention of any kind's shape has
# What stands before a secret that seeds its kind, and a secret's shape without the punctuation around it.
_NAMED = r"(?:token|secret|password|passwd|pwd|credential|(?:api|access|private|auth)[_-]?key)s?[\"']?"
_CREDENTIAL = rf"(?i){_NAMED}\s*[:=]\s*[^\w\s]*$"
_SECRET = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=.-]{20,}$"


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _holds(kind: str, token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(token, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255")),
        "card": F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(F.lit(False)),
        "phone": (n >= 10) & (n <= 15),
    }[kind]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stretches(n: Column) -> Column:
    """The numbers of the stretches of ``n`` entries."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def _stretch(values: Column, k: Column) -> Column:
    return F.slice(values, k * STRETCH + 1, F.lit(STRETCH))


def _before(values: Column, op) -> Column:
    """For each of ``values`` (ints) what ``op`` makes of 0 and all that stand before it, and one more for all of them."""
    none = F.expr("cast(array() as array<int>)")
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    running = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step)

    def of(held: Column) -> Column:
        totals = F.transform(_stretches(F.size(held)), lambda k: F.aggregate(_stretch(held, k), F.lit(0), op))
        return _let(running(totals, F.lit(0)), lambda base: F.concat(F.flatten(F.transform(base["out"], lambda at, k: running(_stretch(held, k), at)["out"])), F.array(base["at"])))

    return _let(values, of)


def _matches(text: Column, pattern: str) -> Column:
    """Every match as (start, end, token, before, after): before and after are the text that touches it."""

    def of(held: Column) -> Column:
        # One gap more than tokens; the last has no token after it.
        lengths = F.zip_with(held["gaps"], held["tokens"], lambda gap, token: F.length(gap) + F.coalesce(F.length(token), F.lit(0)))
        zipped = F.arrays_zip(held["tokens"].alias("token"), F.slice(held["gaps"], 1, F.size(held["tokens"])).alias("gap"), F.slice(held["gaps"], 2, F.size(held["tokens"])).alias("next"), F.slice(_before(lengths, lambda a, b: a + b), 1, F.size(held["tokens"])).alias("at"))
        start = lambda x: x["at"] + F.length(x["gap"])
        return F.transform(zipped, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["token"])).alias("end"), x["token"].alias("token"), F.right(x["gap"], F.lit(80)).alias("before"), F.left(x["next"], F.lit(60)).alias("after")))

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tokens")), of)


def _overlaps(x: Column, spans: Column) -> Column:
    """Whether ``x`` meets one of ``spans``, which are in order and apart: a binary search for the last that begins before its end."""
    steps = F.filter(F.array(*(F.lit(1 << i) for i in reversed(range(30)))), lambda step: step <= F.size(spans))
    upto = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(spans, at + step - 1)["start"] < x["end"], step).otherwise(0))
    return F.coalesce(F.get(spans, upto - 1)["end"] > x["start"], F.lit(False))


def _mention(x: Column, kind: Column) -> Column:
    return F.struct(x["start"].alias("start"), kind.cast("int").alias("kind"), x["end"].alias("end"), x["token"].alias("token"), x["before"].alias("before"), x["after"].alias("after"))


_MENTIONS = "array<struct<start: int, kind: int, end: int, token: string, before: string, after: string>>"


def mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, other``: base spans in order (kind 0 to 3) and further identifier-like words (kind null)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.expr(f"cast(array() as {_MENTIONS})")
    digit = F.col("text").rlike("[0-9]")

    def of_kind(i: int, kind: str) -> Column:
        may = F.col("text").contains(_NEEDS[kind]) if _NEEDS[kind] else F.lit(True)
        may = may & (F.lit(True) if kind == "email" else F.col("digit"))
        kept = F.filter(_matches(F.col("text"), _PATTERN[kind]), lambda x: _holds(kind, x["token"]))
        return F.when(may, F.transform(kept, lambda x: _mention(x, F.lit(i)))).otherwise(none)

    found = [of_kind(i, kind).cast(_MENTIONS).alias(f"k{i}") for i, kind in enumerate(KINDS)]
    words = F.transform(_matches(F.col("text"), _CANDIDATE), lambda x: _mention(x, F.lit(None)))
    runs = F.transform(_matches(F.col("text"), _RUN), lambda x: _mention(x, F.lit(None)))
    rows = rows.withColumn("digit", digit).select("doc_id", "text_hash", *found, F.when(F.col("digit") | F.col("text").contains("@"), words).otherwise(none).alias("words"), F.when(F.col("digit"), runs).otherwise(none).alias("runs"))
    # A run's words are mentions too where they are long enough for any shape.
    apart = F.filter("words", lambda x: (F.length(x["token"]) >= SHORTEST) | ~_overlaps(x, F.col("runs")))
    kinds = [f"k{i}" for i in range(len(KINDS))]
    rows = rows.select("doc_id", "text_hash", *kinds, F.concat(apart, F.col("runs")).alias("other"))
    free = F.filter("other", lambda x: ~(_overlaps(x, F.col("k0")) | _overlaps(x, F.col("k1")) | _overlaps(x, F.col("k2")) | _overlaps(x, F.col("k3"))))
    return rows.select("doc_id", "text_hash", F.array_sort(F.concat(*kinds)).cast(_MENTIONS).alias("base"), free.cast(_MENTIONS).alias("other"))


def _lexical(x: DataFrame) -> DataFrame:
    """One row per mention and pattern: doc_id, text_hash, start, end, kind, instance, pattern, and the kind that it seeds.

    A mention without words around it has one row without a pattern.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[0-9]", "#")
    two = F.regexp_extract(norm(F.col("m.before")), r"(\S+\s+\S+)\s*$", 1)
    one, after = F.regexp_extract(norm(F.col("m.before")), r"(\S+)\s*$", 1), F.regexp_extract(norm(F.col("m.after")), r"^\S*\s+(\S+)", 1)
    patterns = F.array(F.when(two != "", F.concat(F.lit("L "), F.regexp_replace(two, r"\s+", " "))), F.when((one != "") & (after != ""), F.concat(F.lit("S "), one, F.lit(" _ "), after)))
    rows = x.select("doc_id", "text_hash", "m.start", "m.end", "m.kind", F.regexp_replace(F.lower("m.token"), r"^\p{Punct}+|\p{Punct}+$", "").alias("instance"), F.col("m.token").alias("token"), _seed(F.col("m")).alias("seed"), F.explode_outer(F.array_compact(patterns)).alias("pattern"))
    return rows.filter("instance <> ''")


#: What a mention's core stands behind in its word: a credential's name with a sign of assignment, and punctuation.
_LEAD = rf"(?i)^(?:[\w-]*?{_NAMED}[:=])?[^\w+(]*"


def _core(token: Column) -> Column:
    """A mention without what leads to it and the punctuation behind it."""
    return F.regexp_replace(F.regexp_replace(token, _LEAD, ""), r"\W+$", "")


def _seed(m: Column) -> Column:
    """The kind that a mention seeds: its own, or secret where a credential's name stands before its shape."""
    led = F.concat(m["before"], F.regexp_extract(m["token"], _LEAD, 0))
    return F.coalesce(m["kind"], F.when(_core(m["token"]).rlike(_SECRET) & led.rlike(_CREDENTIAL), F.lit(SECRET)))


def _shaped(kind: Column, token: Column) -> Column:
    """Whether a mention looks like its kind at all."""
    n = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return (
        F.when(kind == 0, token.rlike(r"^\S+@\S+$"))
        .when(kind == 1, token.rlike(r"^[0-9a-fA-F]+([.:][0-9a-fA-F]*){3,}$"))
        .when(kind == 2, (n >= 12) & (n <= 19) & token.rlike(r"^[0-9 -]+$"))
        .when(kind == 3, (n >= 7) & (n <= 15) & token.rlike(r"^[+(]*[0-9][ ().0-9-]+[0-9]$"))
        .when(kind == SECRET, token.rlike(_SECRET))
        .otherwise(False)
    )


def scores(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pattern, kind, score)`` and ``(instance, kind, score)`` once no score grows any more; ``edges`` has
    ``pattern, instance`` and ``seed``, the kind that the instance seeds, or null.

    A pattern's score is the sum of its instances' scores over their number and one; it has one only with ``SUPPORT``
    seeds or instances of at least ``CONFIDENT``. An instance that is no seed and has the kind's shape has the score of
    not being missed by all of its patterns.
    """
    degree = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("seed is not null").select("instance", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    now, sums = seeds, None
    while True:
        side = now.select(F.col("instance").alias("i"), "kind", "score")
        confident = F.sum(F.when(F.col("score") >= CONFIDENT, 1).otherwise(0)).alias("support")
        total = edges.join(side, F.col("instance") == F.col("i")).groupBy("pattern", "kind").agg(F.sum("score").alias("total"), confident)
        scored = total.filter(F.col("support") >= SUPPORT).join(degree.withColumnRenamed("pattern", "p"), F.col("pattern") == F.col("p"))
        patterns = scored.select("pattern", "kind", F.least(F.lit(1.0), F.col("total") / (F.col("n") + 1)).alias("score"))
        patterns = materialise(patterns, "pii-patterns")
        # Scores only grow from round to round, so their sum and number say whether any still does.
        r = patterns.agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()
        if sums is not None and r["n"] == sums[0] and r["s"] - sums[1] < SETTLED or not r["n"]:
            return patterns, now
        sums = (r["n"], r["s"])
        missed = edges.filter("seed is null").join(patterns.select(F.col("pattern").alias("p"), "kind", "score"), F.col("pattern") == F.col("p")).filter(_shaped(F.col("kind"), F.col("instance")))
        missed = missed.groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))).alias("log"))
        now = seeds.union(missed.select("instance", "kind", 1 - F.exp("log")))


def discovered(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, extra``: spans that seeds of no base kind and confident patterns add, for documents that have any."""
    explode = lambda c: found.select("doc_id", "text_hash", F.explode(c).alias("m"))
    lexical = materialise(_lexical(explode(F.concat("base", "other"))), "pii-mentions")
    edges = materialise(lexical.filter("pattern is not null").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    patterns, _ = scores(edges)
    sure = patterns.filter(F.col("score") >= CONFIDENT).select(F.col("pattern").alias("p"), F.col("kind").alias("k"), "score")
    open_rows = lexical.filter("kind is null")
    columns = ["doc_id", "text_hash", "start", "token"]
    named = open_rows.join(sure, F.col("pattern") == F.col("p")).select(*columns, "k", "score")
    named = named.union(open_rows.filter("seed is not null").select(*columns, "seed", F.lit(2.0)))
    named = named.withColumn("core", _core(F.col("token"))).filter(_shaped(F.col("k"), F.col("core")) & (F.col("core") != ""))
    # The span is the word without the punctuation around it.
    lead = F.length(F.regexp_extract("token", _LEAD, 0))
    named = named.select("doc_id", "text_hash", (F.col("start") + lead).alias("start"), "k", "core", "score")
    one = named.groupBy("doc_id", "text_hash", "start", "core").agg(F.max(F.struct("score", (-F.col("k")).alias("k")))["k"].alias("k"))
    spans = one.select("doc_id", "text_hash", F.struct("start", (-F.col("k")).cast("int").alias("kind"), (F.col("start") + F.length("core")).alias("end")).alias("span"))
    return spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("extra"))


def _written(spans) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, spans``: base spans and all spans of every row, as ordered (start, kind, end)."""
    found = materialise(mentions(docs), "pii-found")
    extra = discovered(found).select(F.col("doc_id").alias("x_id"), F.col("text_hash").alias("x_hash"), "extra")
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = found.select("doc_id", "text_hash", plain.alias("base"))
    met = rows.join(extra, (F.col("text_hash") == F.col("x_hash")) & F.col("doc_id").eqNullSafe(F.col("x_id")), "left")
    return met.select("doc_id", "text_hash", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with ``[KIND]`` for every run of spans that overlap, named after the first; ``spans`` are in order."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in NAMES))
    ends = _before(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

    def of(at: Column) -> Column:
        # Runs: where the text before one begins, where the run itself does, and its kind.
        runs = F.filter(F.transform(spans, lambda x, i: F.struct(F.get(at, i).alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])

        def joined(held: Column) -> Column:
            # A stretch of runs is cut out of the text once, and its pieces out of that.
            stretch = lambda part: _let(
                F.struct(F.substring(text, F.get(part, F.lit(0))["from"] + 1, F.element_at(part, -1)["start"] - F.get(part, F.lit(0))["from"]).alias("text"), F.get(part, F.lit(0))["from"].alias("at")),
                lambda c: F.transform(part, lambda x: F.concat(F.substring(c["text"], x["from"] - c["at"] + 1, x["start"] - x["from"]), F.get(names, x["kind"]))),
            )
            pieces = F.flatten(F.transform(_stretches(F.size(held)), lambda k: _let(_stretch(held, k), stretch)))
            return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))

        return _let(runs, joined)

    return _let(ends, of)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; rows, columns and column order stay, whatever the columns' names."""
    found = find_pii(docs).filter(F.size("spans") > 0)
    spans = materialise(found.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "spans").distinct(), "pii-spans")
    held = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first()["n"]
    met = join_keys(docs, spans, "left", held)
    masked = F.when(spans["spans"].isNotNull(), _masked(docs["text"], spans["spans"])).otherwise(docs["text"])
    return met.select(*(masked.alias(c) if c == "text" else docs[c] for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counted = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counted, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
