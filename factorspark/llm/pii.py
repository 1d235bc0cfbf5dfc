"""Personal data and what gives it away (operator 4), in DataFrame functions only.

Emails, addresses, card and phone numbers are found by pattern. Each distinct value is a protected entity. How strongly a term
reveals an entity is estimated from the whole corpus: with p the share of documents, PMI(c; t) = log p(c, t) / (p(c) p(t)),
against the information IC(c) = -log p(c) of the entity. A ratio of 1 means that the term never occurs without it. In texts
with the entity, terms above `remove` are taken out and those above `generalise` are replaced by their kind. Copies of a text
count in all shares; how many different texts an entity and a pair need before they count at all does not rise with copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")

# The same matches as the plain patterns, leftmost first, but in time linear in the text: a run of characters that can begin a
# match is tried once, at its start or where the last match ended, and repeats give nothing back that could not match anyway.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[^\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the ratio PMI / IC, and how many distinct texts an entity and a pair must occur in to count as evidence."""

    generalise: float = 0.9
    remove: float = 0.97
    support: int = 3
    least_length: int = 3


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> of all matches. Starts follow from the lengths of matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s, x):
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        # Only valid matches are kept, so lists that grow step by step stay short; the others take no part in the copying.
        one = F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("value")))
        return F.struct(b.alias("at"), F.when(_valid(x["hit"], kind), F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def _valid(hit: Column, kind: str) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("999").cast("int") <= 255))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    places = F.sequence(F.lit(1), F.when(n.between(12, 19), n).otherwise(F.lit(1)))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return n.between(12, 19) & (total % 10 == 0)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """`docs` with the valid matches of each kind in columns _email, _ip, _card and _phone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    hints = {"email": "@[A-Za-z0-9-]", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": "[+][0-9]"}
    possible = {k: text.rlike(hint) for k, hint in hints.items()}
    return docs.withColumns({f"_{k}": F.when(possible[k], _spans(text, k)).otherwise(none) for k in KINDS})


def _entities() -> Column:
    """Distinct protected values of a row as `kind:value`, without case and separators."""

    def named(kind: str) -> Column:
        value = (lambda x: F.lower(x["value"])) if kind == "email" else (lambda x: F.regexp_replace(x["value"], "[^0-9.]", ""))
        return F.transform(f"_{kind}", lambda x: F.concat(F.lit(f"{kind}:"), value(x)))

    return F.array_distinct(F.concat(*map(named, KINDS)))


def _as_spans(rank: int, kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit("remove").alias("action")))


def _terms(least: int) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower("text"), TERM), lambda t: F.length(t) >= least))


def disclosing_terms(docs: DataFrame, protected: DataFrame, rule: Disclosure) -> DataFrame:
    """(entity, term, ratio) of all terms that reveal an entity by at least `rule.generalise`.

    `protected` has a row for each distinct text with protected values: text, mark, copies, entities.
    """
    enough = F.col("texts") >= rule.support
    values = protected.select("mark", "copies", F.explode("entities").alias("entity"))
    known = values.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_entity")).where(enough)
    words = protected.select("mark", "copies", F.explode(_terms(rule.least_length)).alias("term"))
    common = words.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(enough).drop("texts")
    met = values.join(known.drop("texts"), "entity").drop("copies").join(words.join(common, "term"), "mark")
    pairs = met.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_pair"))
    pairs = written(pairs.where(enough), "pairs")
    # Every document of the corpus counts, copies included, as they do in the numbers of entities and pairs.
    total = docs.count()
    everywhere = docs.select(F.explode(_terms(rule.least_length)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    information = -F.log(F.col("n_entity") / F.lit(total))
    mutual = F.log(F.col("n_pair") * F.lit(float(total)) / F.col("n_entity") / F.col("n_term"))
    ratio = F.when(information > 0, mutual / information).otherwise(0.0)
    return pairs.join(everywhere, "term").select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= rule.generalise)


def find_spans(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """`docs` with `spans array<struct<start, rank, end, kind, action>>` by start and then kind: base spans and terms.

    Positions are code points, the end exclusive. A base span has the action `remove`; a term `remove` or `generalise`. Terms
    are taken only in texts that hold the entity, and not where they touch a base span. Null text is empty. Equal rows get equal
    spans. Columns of `docs` stay, unless they begin with an underscore.
    """
    kept = [c for c in docs.columns if not c.startswith("_")]
    docs = docs.select(*kept)
    based = written(with_base_spans(docs), "based")
    any_base = F.greatest(*[F.size(f"_{k}") for k in KINDS]) > 0
    base = F.concat(*[_as_spans(i, k) for i, k in enumerate(KINDS)])
    texts = based.where(any_base).groupBy("text").agg(F.count(F.lit(1)).alias("copies"), *[F.first(f"_{k}").alias(f"_{k}") for k in KINDS])
    texts = written(
        texts.select("text", F.md5("text").alias("mark"), "copies", _entities().alias("entities"), base.alias("base")), "protected"
    )
    found = disclosing_terms(based.select("text"), texts, rule)
    flagged = texts.select("mark", F.explode("entities").alias("entity")).join(found, "entity")
    flagged = written(flagged.groupBy("mark", "term").agg(F.max("ratio").alias("ratio")), "flagged")
    # Words with their places, in texts with a flagged term: the place is the sum of all lengths before.
    inside = texts.join(flagged.select("mark").distinct(), "mark", "left_semi")
    word = r"[\p{L}\p{M}\p{N}]+"
    cells = F.arrays_zip(F.split("text", word, -1).alias("gap"), F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("word"))
    words = inside.select("mark", F.posexplode(cells).alias("i", "x")).select("mark", "i", "x.gap", "x.word").where("word IS NOT NULL")
    before = Window.partitionBy("mark").orderBy("i")
    words = words.withColumn("end", F.sum(F.length("gap") + F.length("word")).over(before).cast("int"))
    hits = words.withColumn("term", F.lower("word")).join(flagged, ["mark", "term"])
    action = F.when(F.col("ratio") >= rule.remove, "remove").otherwise("generalise")
    span = F.struct(
        (F.col("end") - F.length("word")).alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit("term").alias("kind"), action.alias("action")
    )
    by_text = hits.groupBy("mark").agg(F.collect_list(span).alias("terms"))
    by_text = by_text.join(texts.select("mark", "base"), "mark").select(
        "mark", F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))).alias("_terms")
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,action:string>>")
    plain = based.where(~any_base).withColumn("_terms", none)
    rich = based.where(any_base).withColumn("_mark", F.md5("text")).join(by_text.withColumnRenamed("mark", "_mark"), "_mark", "left")
    rich = rich.withColumn("_terms", F.coalesce("_terms", none)).drop("_mark")
    ordered = F.array_sort(F.concat(base, "_terms"))
    return plain.unionByName(rich).select(*kept, ordered.alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of `find_spans`, by row."""
    of = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(F.transform(base, of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", of), ",").alias("spans"),
    )


def sanitise(found: DataFrame) -> DataFrame:
    """`find_spans` with `text` rewritten and `spans` dropped: base spans become [EMAIL] and the like, removed terms vanish,
    generalised ones become [NUMBER], [NAME] (capital first) or [WORD]. Overlapping spans are replaced once, by the first.
    Text without spans, null included, stays as it is."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,action:string>>")

    def merge(out, s):
        last = F.element_at(out, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"), last["action"].alias("action"))
        joins = (F.size(out) > 0) & (F.coalesce(last["end"], F.lit(0)) > s["start"])
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(out, F.array(own)))

    def token(s):
        first = F.substring("text", s["start"] + 1, F.lit(1))
        kind = F.when(first.rlike("[0-9]"), "[NUMBER]").when(first.rlike(r"\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["action"] == "remove", "").otherwise(kind)

    rest = found.withColumn("_merged", F.aggregate("spans", empty, merge))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_merged", i - 1)["end"])
    pieces = F.transform("_merged", lambda s, i: F.concat(F.substring("text", before(i) + 1, s["start"] - before(i)), token(s)))
    tail = F.substring("text", F.element_at("_merged", -1)["end"] + 1, F.length("text"))
    text = F.when(F.size("_merged") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return rest.withColumn("text", text).drop("_merged", "spans")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in all `documents`."""
    return report(find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))
