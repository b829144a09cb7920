"""Personal data by fixed formats, extended by bootstrapped contexts; DataFrame functions only.

Base entities are the matches of four formats. They are the seeds. The words
around them are lexical patterns: one or two words before, one after. Other tokens
with a digit or an @ are candidates, taken together by shape (alphabet and length).
Patterns and shapes are the two sides of a graph that is scored in rounds:

* A pattern is trusted as far as the different candidates met in it are seeds or
  of accepted shapes. It needs several of these, so one name alone teaches nothing.
* A shape is accepted when the patterns before or after its candidates are trusted
  on average. From the next round on its candidates are instances as seeds are, so
  the patterns that they alone occur in are induced too, and lead to further shapes.

Only shapes of identifiers can be accepted: of several signs, and nearly as many
different bodies as different surroundings. Years, prices and versions recur in
ever new surroundings and fail this. What looks like a base format but fails its
check (a card number's last digit) counts against a pattern and is never accepted.
Candidates of accepted shapes in a trusted pattern are the added spans. So is a
candidate of any shape, met even once, next to words that hardly ever occur without
a known instance.

Texts are never shuffled: each row becomes spans with their context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_key, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
LEAST_INSTANCES = 3   # different known instances that a pattern needs, and bodies that a shape needs
PATTERN_SCORE = 0.5   # share of the candidates in a pattern that must be known
SHAPE_SCORE = 0.5     # mean trust of the patterns on one side of a shape's candidates, of those met with as many candidates
STRICT_SCORE = 0.6    # share of all uses of a word that a pattern needs to tell by itself
INSTANCE_SCORE = 0.8  # what such patterns of a candidate must give together
LEAST_SIGNS = 8       # letters and digits of an identifier
UNLIKE = 0.5          # different bodies of an identifier's shape to its different surroundings

#: The formats, with possessive quantifiers and run starts so that no text takes
#: more than linear time or deep recursion. \\G lets a match start where one ended.
LOCAL = "[A-Za-z0-9._%+-]"
FORMATS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Signs that part tokens and words as blanks do.
APART = "\t\n\x0b\f\r\"'`=<>(){}[],;|"
_IN = r"[^\s\"'`=<>(){}\[\],;|]"
TOKEN = rf"(?<!{_IN})(?:(?![0-9@]){_IN})*+[0-9@]{_IN}*+"

SPAN = "array<struct<start:int,end:int,body:string,left:string,left2:string,right:string>>"


def found(text: Column, pattern: str, hint: str) -> Column:
    """Matches with their places in code points, and the words around them."""
    bodies, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    step = F.arrays_zip(bodies.alias("body"), F.slice(gaps, 1, F.size(bodies)).alias("gap"), F.slice(gaps, 2, F.size(bodies)).alias("after"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["body"])
        before = blanks(x["gap"])
        left = last_word(before)
        left2 = last_word(F.substring(F.rtrim(before), F.lit(1), F.length(F.rtrim(before)) - F.length(left)))
        right = F.substring_index(F.ltrim(blanks(x["after"])), " ", 1)
        span = F.struct(start.alias("start"), end.alias("end"), x["body"].alias("body"), name_of(left).alias("left"),
                        name_of(F.when((left != "") & (left2 != ""), F.concat_ws(" ", left2, left)).otherwise("")).alias("left2"), name_of(right).alias("right"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    spans = F.aggregate(step, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), add, lambda s: s["out"])
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPAN))


def blanks(gap: Column) -> Column:
    return F.translate(gap, APART, " " * len(APART))


def last_word(gap: Column) -> Column:
    return F.substring_index(F.rtrim(gap), " ", -1)


def name_of(words: Column) -> Column:
    """Lowered; long ones by their digest."""
    return F.when(F.length(words) <= 64, F.lower(words)).otherwise(F.sha2(F.lower(words), 256))


def shape_of(body: Column) -> Column:
    """Digits only, letters and digits, or these between other signs; and the length."""
    low = F.lower(body)
    kind = F.when(low.rlike("^[0-9]++$"), "0").otherwise(F.regexp_replace(low, "[a-z0-9]++", "a"))
    return F.concat_ws(":", name_of(kind), F.length(body).cast("string"))


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Every second digit from the right counts double, its digits summed; the sum ends in 0."""
    backwards = F.split(F.reverse(number), "")
    value = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind: str, body: Column) -> Column:
    n = F.length(digits(body))
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(16, 19) & passes_luhn(digits(body))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def checked(kind: str, text: Column) -> Column:
    """All matches of a format, with `ok` where they pass its check."""
    return F.transform(found(text, FORMATS[kind], HINTS[kind]), lambda s: s.withField("ok", holds(kind, s["body"])))


def tokens(text: Column) -> Column:
    """Candidates without the signs around them, with their shape."""
    def bare(s: Column) -> Column:
        tail = F.regexp_replace(s["body"], r"^[^\p{L}\p{N}@]++", "")
        core = F.regexp_replace(tail, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        start = s["start"] + F.length(s["body"]) - F.length(tail)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), F.xxhash64(F.lower(core)).alias("body"), shape_of(core).alias("shape"),
                        F.length(F.regexp_replace(core, r"[^\p{L}\p{N}]++", "")).alias("signs"), s["left"].alias("left"), s["left2"].alias("left2"), s["right"].alias("right"))
    return F.transform(found(text, TOKEN, "[0-9@]"), bare)


def listed(*parts: tuple[str, str]) -> Column:
    """kind:start:end of all spans, comma-joined, in the order of the parts, then of start."""
    def of(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*(of(*p) for p in parts)), ",")


SIDES = {"left": "<", "left2": "<<", "right": ">"}


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least_instances: int = LEAST_INSTANCES,
                  pattern_score: float = PATTERN_SCORE, shape_score: float = SHAPE_SCORE) -> DataFrame:
    """doc_id, key and arrays email, ip, card, phone, context of spans for every row.

    Null texts count as empty, empty ones have no spans. `context` holds what
    the patterns added; base spans always stay, and an added span overlaps none.
    Repeated rows are each returned with the same spans, and count once as evidence,
    as all copies of a candidate in the same words do. Other columns are not read.
    An empty table gives no rows.
    """
    rows, known, _ = bootstrapped(docs, id_col, text_col, rounds, least_instances, pattern_score, shape_score)
    lists = known.groupBy(F.col("doc_id").alias("in_doc"), F.col("key").alias("in_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context"))
    match = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("key") == F.col("in_key"))
    out = rows.join(written(docs.sparkSession, lists, "personal-added"), match, "left")
    return out.select("doc_id", "key", *KINDS, F.coalesce("context", F.array().cast("array<struct<start:int,end:int>>")).alias("context"))


def bootstrapped(docs: DataFrame, id_col: str, text_col: str, rounds: int, least_instances: int, pattern_score: float, shape_score: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their base spans; the added spans with their shape; the scores of shapes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("key"), *(checked(k, text).alias(f"all_{k}") for k in KINDS), tokens(text).alias("token"))
    rows = written(spark, rows, "personal-spans")
    passed = {k: F.filter(f"all_{k}", lambda s: s["ok"]) for k in KINDS}
    places = {k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"))) for k, c in passed.items()}
    # A number that fails a check is no instance of an unknown format. Short or long digit runs are none of cards.
    def counted(kind: str) -> Column:
        spans = F.filter(f"all_{kind}", lambda s: s["ok"] | F.length(digits(s["body"])).between(16, 19)) if kind == "card" else F.col(f"all_{kind}")
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["ok"].alias("ok")))

    looks = F.concat(*map(counted, KINDS))

    def overlaps(t: Column, spans: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    some = rows.where(F.size("token") > 0)
    marked = F.transform(F.filter("token", lambda t: ~overlaps(t, F.filter(looks, lambda b: b["ok"]))), lambda t: t.withField("failed", overlaps(t, looks)))
    free = some.select("doc_id", "key", F.explode(marked).alias("s")).select("doc_id", "key", "s.*")
    seeds = None
    for kind, spans in passed.items():
        one = some.select(F.explode(spans).alias("s")).select(F.lit(kind).alias("shape"), F.xxhash64(F.lower("s.body")).alias("body"), "s.left", "s.left2", "s.right", F.lit(True).alias("seed"))
        seeds = one if seeds is None else seeds.unionByName(one)
    # Failed ones have a shape of their own, which nothing accepts.
    others = free.select(F.when(F.col("failed"), F.concat(F.lit("failed "), "shape")).otherwise(F.col("shape")).alias("shape"), "body", "left", "left2", "right",
                         F.lit(False).alias("seed"), F.when(F.col("failed"), 0).otherwise(F.col("signs")).alias("signs"))
    seen = seeds.withColumn("signs", F.lit(0)).unionByName(others)
    seen = written(spark, seen.groupBy("shape", "body", "left", "left2", "right").agg(F.max("seed").alias("seed"), F.min("signs").alias("signs"), F.count(F.lit(1)).alias("times")), "personal-candidates")

    bodies = seen.groupBy("shape", "body").agg(F.count(F.lit(1)).alias("n"), F.min("signs").alias("signs"))
    shapes = bodies.groupBy("shape").agg(F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("surroundings"), F.min("signs").alias("signs"))
    able = shapes.where((F.col("bodies") >= least_instances) & (F.col("signs") >= LEAST_SIGNS) & (F.col("bodies") >= UNLIKE * F.col("surroundings"))).select("shape")
    edges = seen.select("shape", "body", "seed", "times", F.explode(F.array(*(F.struct(F.lit(mark).alias("side"), F.col(c).alias("words")) for c, mark in SIDES.items()))).alias("p"))
    edges = edges.where(F.col("p.words") != "").groupBy("p.side", "p.words", "shape", "body").agg(F.max("seed").alias("seed"), F.sum("times").alias("times"))
    graph = written(spark, edges.groupBy("side", "words", "shape").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.sum("times").alias("times"))
                    .join(able.withColumn("able", F.lit(True)), "shape", "left").withColumn("able", F.coalesce("able", F.lit(False))), "personal-graph")

    scores = able.withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        instance = F.col("seed") | (F.coalesce("score", F.lit(0.0)) >= shape_score)
        met = graph.join(scores, "shape", "left").groupBy("side", "words").agg(F.sum("n").alias("all"), F.sum(F.when(instance, F.col("n")).otherwise(0)).alias("instances"),
                                                                                             F.sum("times").alias("times"), F.sum(F.when(instance, F.col("times")).otherwise(0)).alias("known"))
        share = F.col("instances") / F.col("all")
        met = written(spark, met.where(F.col("all") >= least_instances).select("side", "words", "times", "known", share.alias("trust"), ((F.col("instances") >= least_instances) & (share >= pattern_score)).alias("good")), "personal-patterns")
        sides = graph.where("able").join(met, ["side", "words"]).groupBy("shape", "side").agg((F.sum(F.col("trust") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))
        scores = written(spark, sides.where(F.col("n") >= least_instances).groupBy("shape").agg(F.max("score").alias("score")), "personal-scores")
    trusted = met.where("good")
    accepted = scores.where(F.col("score") >= shape_score).select("shape")
    # How often the words of a pattern occur at all. Only these words are counted.
    alone = trusted.where("side != '<<'")
    said = docs.select(F.explode(F.split(blanks(text), " +")).alias("word")).select(name_of(F.col("word")).alias("words")).join(alone.select("words").distinct(), "words", "left_semi")
    strict = F.col("known") / F.greatest("times", "uses")
    telling = alone.join(said.groupBy("words").agg(F.count(F.lit(1)).alias("uses")), "words").select("side", "words", strict.alias("strict")).where(F.col("strict") >= STRICT_SCORE)
    rules = written(spark, trusted.select("side", "words").join(telling, ["side", "words"], "left"), "personal-rules")

    sides = F.explode(F.array(*(F.struct(F.lit(mark).alias("side"), F.col(c).alias("words")) for c, mark in SIDES.items())))
    met_by = free.where("not failed").select("doc_id", "key", "start", "end", "shape", sides.alias("p")).select("doc_id", "key", "start", "end", "shape", "p.side", "p.words")
    doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("strict", F.lit(0.0)))))
    hits = met_by.join(rules, ["side", "words"]).groupBy("doc_id", "key", "start", "end", "shape").agg((1 - F.exp(doubt)).alias("score"))
    kept = hits.join(accepted.withColumn("accepted", F.lit(True)), "shape", "left").where(F.col("accepted") | (F.col("score") >= INSTANCE_SCORE))
    return rows.select("doc_id", "key", *(c.alias(k) for k, c in places.items())), kept.select("doc_id", "key", "start", "end", "shape"), scores
