"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

What the base patterns find are the seeds. An identifier-like token (one with a digit, an @ or another form that LIKE lists)
makes an edge with each lexical pattern around it: one to three words to its left, one to three to its right, and one on
either side. A pattern of a kind scores by what it leads to: known instances of the kind for it, known ones of other kinds
against it, and those that are unknown but look like the kind against it in part. An instance scores by the best pattern
that leads to it, in turns; tokens that patterns of high confidence lead to, and that look like the pattern's kind, are new
spans. The graph is made of distinct tokens and patterns, aggregated before every shuffle. A text is read once, in time that
grows in proportion to it: places are sums in three levels of blocks, spans at a place are found by halving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

KINDS = ("email", "ip", "card", "phone")
#: What the base looks for, written so that no start inside a run is tried again; leftmost matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of these hold none of the kind; they are cheaper to try.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: What LIKE takes without a digit or an at sign: spelt-out at signs, and hexadecimal groups of letters.
SPELT = r"\(at\)|\[at\]|\{at\}"
GROUPS = r"(?:[A-Fa-f]{0,4}:){2,7}[A-Fa-f]{0,4}"
#: Identifier-like tokens: words with a digit or an at sign, or of such a form.
TOKEN = (
    r"(?:\G|(?<![^\x20\x09-\x0D]))(?:[^\x20\x09-\x0D0-9@]*+[0-9@]|[^\x20\x09-\x0D]+?(?:" + SPELT + r")"
    r"|[(\[{<\"']*+" + GROUPS + r"""(?=[)\]}>"'.,;:!?*%$&#]*+(?:[\x20\x09-\x0D]|\z)))[^\x20\x09-\x0D]*+"""
)
#: Texts without a match of this hold no such token.
ANY_TOKEN = "[0-9@]|" + SPELT + "|(?:[A-Fa-f]{0,4}:){2}"
EDGE = r"""^[(\[{<"']+|[)\]}>"'.,;:!?*%$&#]+$"""
#: What a token must look like, without its edge, to be a new span of the kind.
LIKE = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\]|\{at\})[A-Za-z0-9.()\[\]{}-]*[A-Za-z0-9]$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?::[0-9]+)?$",
    "card": r"^[0-9](?:[._/-]?[0-9]){12,18}$",
    "phone": r"^\(?[0-9](?:[()./-]*[0-9]){7,14}$",
}
ROUNDS = 3
CONFIDENCE = 0.8
#: A pattern needs so many distinct known instances of its kind.
SUPPORT = 5.0
#: What an unknown token that looks like the kind counts against a pattern; a known one of another kind counts 1.
DOUBT = 0.25
#: Words of context are read in so many characters beside a token, and back or forth to the next token.
BESIDE = 100
WORDS = 3
_BITS = 6  # of a place in a block
_PART = 256  # code points of a part of a text


def let(value: Column, body) -> Column:
    """body of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _blocks(values: Column) -> Column:
    """Sums of blocks of 64."""
    numbers = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(values) - 1, F.lit(0)), _BITS))
    return F.transform(numbers, lambda b: _total(F.slice(values, F.shiftleft(b, _BITS) + 1, F.lit(1 << _BITS))))


def _before(values: Column, blocks: Column) -> Column:
    """The sum of all values before each, from the sums before each block."""

    def one(_: Column, i: Column) -> Column:
        within = i.bitwiseAND((1 << _BITS) - 1)
        return F.get(blocks, F.shiftright(i, _BITS)) + _total(F.slice(values, i - within + 1, within))

    return F.transform(values, one)


def running(values: Column) -> Column:
    """The sum of all values (int) before each."""

    def nested(v: Column) -> Column:
        return let(_blocks(v), lambda b: let(_blocks(b), lambda c: let(F.transform(c, lambda _, i: _total(F.slice(c, F.lit(1), i))), lambda cs: let(_before(b, cs), lambda bs: _before(v, bs)))))

    return let(values, nested)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int") <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str, body) -> Column:
    """body of each leftmost non-overlapping match: its place among them, value and start in code points, the texts between
    matches and the matches; as an array."""

    def spans(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        return let(running(sizes), lambda at: F.transform(found, lambda m, i: body(i, m, F.get(at, i) + F.length(F.get(gaps, i)), gaps, found)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps)))


def base_spans(text: Column, kind: str) -> Column:
    """The valid base spans of a kind as structs of kind, start, end and value."""
    def span(_i, value: Column, start: Column, _gaps, _found) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    spans = F.filter(located(text, BASE[kind], span), lambda s: _valid(kind, s["value"]))
    hint = text.contains("@") if kind == "email" else text.rlike(HINT[kind])
    return F.when(hint, spans).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"))


def _of(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind as listed and start, joined by commas."""
    ordered = F.concat(*[F.sort_array(_of(spans, kind)) for kind in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _like(kind: Column, token: Column) -> Column:
    like = F.lit(False)
    for k in KINDS:
        like = F.when(kind == k, token.rlike(LIKE[k])).otherwise(like)
    return like


def _first_after(spans: Column, place: Column) -> Column:
    """The first of some spans, which are sorted and apart, that ends after a place; null if there is none."""
    powers = F.transform(F.sequence(F.floor(F.log2(F.size(spans))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    past = F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= F.size(spans)) & (F.get(spans, n + p - 1)["end"] <= place), n + p).otherwise(n))
    return F.when(F.size(spans) > 0, F.get(spans, past))


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of the texts on either side of a token."""
    blank = r"[\x20\x09-\x0D]+"
    before = F.reverse(F.filter(F.split(F.lower(left), blank), lambda w: w != ""))
    after = F.filter(F.split(F.lower(right), blank), lambda w: w != "")

    def made(b: Column, a: Column) -> Column:
        sides = [F.when(F.size(b) >= n, F.concat(F.lit("< "), F.array_join(F.reverse(F.slice(b, 1, n)), " "))) for n in range(1, WORDS + 1)]
        sides += [F.when(F.size(a) >= n, F.concat(F.lit("> "), F.array_join(F.slice(a, 1, n), " "))) for n in range(1, WORDS + 1)]
        both = F.when((F.size(b) > 0) & (F.size(a) > 0), F.concat(F.get(b, F.lit(0)), F.lit(" <> "), F.get(a, F.lit(0))))
        return F.filter(F.array(*sides, both), lambda p: p.isNotNull())

    return let(before, lambda b: let(after, lambda a: made(b, a)))


def identifiers(text: Column, base: Column) -> Column:
    """The identifier-like tokens of a text as structs of start, end, contexts, token, known and taken.

    Where a base span starts in such a token, the identifier is the span, and its kind is known; tokens that a span goes on into
    are left out; all others are identifiers without a kind.
    """

    def of(spans: list[Column]) -> Column:
        def one(i: Column, value: Column, start: Column, gaps: Column, found: Column) -> Column:
            def over(k: int) -> Column:
                return let(_first_after(spans[k], start), lambda s: F.when(s["start"] < start + F.length(value), s))

            met = F.coalesce(*[over(k) for k in range(len(KINDS))])
            edge = F.length(F.regexp_extract(value, r"""^[(\[{<"']+""", 0))
            bare = F.regexp_replace(value, EDGE, "")
            left = F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.right(F.get(gaps, i), F.lit(BESIDE)))
            right = F.concat(F.left(F.get(gaps, i + 1), F.lit(BESIDE)), F.coalesce(F.get(found, i + 1), F.lit("")))

            def whole(m: Column) -> Column:
                return F.struct(
                    start.alias("from"), (start + edge).alias("start"), (start + edge + F.length(bare)).alias("end"), _contexts(left, right).alias("contexts"),
                    F.coalesce(m["value"], bare).alias("token"), m["kind"].alias("known"), m.isNotNull().alias("taken"), m["start"].alias("met"),
                )

            return let(met, whole)

        return F.filter(located(text, TOKEN, one), lambda t: (t["end"] > t["start"]) & (t["met"].isNull() | (t["met"] >= t["from"])))

    def nested(spans: list[Column]) -> Column:
        return of(spans) if len(spans) == len(KINDS) else let(_of(base, KINDS[len(spans)]), lambda s: nested([*spans, s]))

    kind = "array<struct<from:int,start:int,end:int,contexts:array<string>,token:string,known:string,taken:boolean,met:int>>"
    return F.when(text.rlike(ANY_TOKEN), nested([])).otherwise(F.expr(f"cast(array() as {kind})"))


def patterns(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT, doubt: float = DOUBT) -> DataFrame:
    """(context, kind, share): the patterns that lead to identifiers of a kind with high confidence; from (contexts, token, known)."""
    edges = scratch.write(found.select(F.explode("contexts").alias("context"), "token", "known").groupBy("context", "token").agg(F.max("known").alias("known")), "edges")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.count(F.when(F.col("known") == k, 1)).alias("own"), F.count(F.when(F.col("known").isNull() & F.col("token").rlike(LIKE[k]), 1)).alias("like")) for k in KINDS])
    sizes = edges.groupBy("context").agg(F.count("known").alias("all"), kinds.alias("kinds"))
    sizes = scratch.write(sizes.select("context", "all", F.explode(F.filter("kinds", lambda k: k["own"] + k["like"] >= support)).alias("k")).select("context", "all", "k.*"), "sizes")
    led = None
    for k in range(rounds):
        new = F.lit(0.0) if led is None else F.coalesce("new", F.lit(0.0))
        held = sizes if led is None else sizes.join(edges.where("known is null").select("context", "token").join(led, "token").groupBy("context", "kind").agg(F.sum("score").alias("new")), ["context", "kind"], "left")
        weight = F.col("own") + new
        share = weight / (weight + F.col("all") - F.col("own") + doubt * (F.col("like") - new))
        scored = held.select("context", "kind", weight.alias("weight"), share.alias("share")).where((F.col("weight") >= support) & (F.col("share") >= confidence))
        scored = scratch.write(scored.select("context", "kind", "share"), f"patterns-{k}")
        if k + 1 < rounds:
            led = edges.where("known is null").select("context", "token").join(scored, "context").where(_like(F.col("kind"), F.col("token"))).groupBy("token", "kind").agg(F.max("share").alias("score"))
            led = scratch.write(led, f"led-{k}")
    return scored


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT, doubt: float = DOUBT) -> DataFrame:
    """id, th (a hash of the text), base and spans, arrays of structs of kind, start and end (code points, end exclusive).

    Base spans are always among spans; the method adds those tokens that overlap no base span, that a pattern of a kind
    leads to and that look like the kind. A null or empty text has none. Rows that repeat id and text get the same spans
    each; a null id is kept; an empty table gives no rows; extra columns are not carried on. Texts do not travel.
    """
    scratch = Scratch(df.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th")).withColumn("base", F.concat(*[base_spans(F.col("text"), kind) for kind in KINDS]))
    read = scratch.write(docs.select("id", "th", "base", identifiers(F.col("text"), F.col("base")).alias("found")), "read")
    read = read.withColumn("base", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    found = read.where(F.size("found") > 0).select("id", "th", F.explode("found").alias("t")).select("id", "th", "t.*")
    good = patterns(found, scratch, rounds, confidence, support, doubt).select("context", "kind").distinct()
    open_ = found.where("not taken").select("id", "th", "start", "end", "token", F.explode("contexts").alias("context"))
    led = open_.join(good, "context").where(_like(F.col("kind"), F.col("token")))
    new = scratch.write(led.groupBy("id", "th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")), "new")
    scratch.drop_all_but("read", "new")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    same = read["id"].eqNullSafe(new["id"]) & (read["th"] == new["th"])
    return read.join(new, same, "left").select(read["id"], read["th"], "base", F.concat("base", F.coalesce("more", none)).alias("spans"))


def _cut(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to end of a text in parts of _PART code points."""
    first = F.shiftright(start, 8)
    joined = F.array_join(F.slice(parts, first + 1, F.shiftright(end - 1, 8) - first + 1), "")
    return F.when(end > start, F.substring(joined, start.bitwiseAND(_PART - 1) + 1, end - start)).otherwise("")


def _masked(text: Column, ordered: Column) -> Column:
    """The text with spans (start, last = -end, kind), sorted, replaced; a span that starts in one before it is left out."""

    def put(parts: Column):
        def one(state: Column, s: Column) -> Column:
            piece = F.concat(state["out"], _cut(parts, state["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] < state["at"], state).otherwise(F.struct((-s["last"]).alias("at"), piece.alias("out")))

        def block(state: Column, b: Column) -> Column:
            own = F.aggregate(F.slice(ordered, F.shiftleft(b, _BITS) + 1, F.lit(1 << _BITS)), F.struct(state["at"].alias("at"), F.lit("").alias("out")), one)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(state["out"], o["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(ordered) - 1, F.lit(0)), _BITS))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        return F.aggregate(blocks, start, block, lambda s: F.concat(F.array_join(s["out"], ""), _cut(parts, s["at"], F.length(text))))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), put)


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets; of spans that overlap the first goes, of those the longest.

    Every row comes back with its other columns: a null or empty text as it is, a null id too, repeated rows each. An empty
    table gives no rows.
    """
    key, digest, found = fresh(df, "_id", "_th", "_spans")
    spans = find(df, id_col, text_col).where(F.size("spans") > 0).select(F.col("id").alias(key), F.col("th").alias(digest), F.col("spans").alias(found)).dropDuplicates([key, digest])
    joined = df.join(spans, df[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(digest)), "left")
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    text = F.col(text_col)
    masked = let(ordered, lambda o: _masked(text, o))
    return joined.select(*[F.when(F.col(found).isNull(), text).otherwise(masked).alias(text_col) if c == text_col else df[c] for c in df.columns])


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of every document's base spans, and all its spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {f"n_{k}": F.size(_of("base", k)).cast("long") for k in KINDS}
    return found.select(F.col("id").alias("doc_id"), *[c.alias(n) for n, c in count.items()], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
