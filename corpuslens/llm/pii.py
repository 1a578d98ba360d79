"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected entities away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# The kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
#: A match begins where a run of its first characters does, or where the match before it ended; what it takes is
#: never given back, so that neither long runs nor long domains cost more than their length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: A match always begins where a run of digits does, and takes runs whole.
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Over text whose blanks and hyphens are blotted out unless they stand between digits: there runs of these
#: characters are the pattern's matches, without a loop that could exhaust the stack on long numbers.
CARD = r"[0-9 -]{2,}"
_LOOSE = r"(?<![0-9])[ -]|[ -](?![0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Texts that may hold a kind: one of these is part of every valid match.
_MAY = {"ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9][ ().0-9-]"}

#: A term: a run of letters (with their marks) and digits.
TERM, GAP = r"[\p{L}\p{M}\p{N}]+", r"[^\p{L}\p{M}\p{N}]+"
#: Shares of the entity's information content that a term may disclose: beyond the first it is generalised, beyond the second removed.
GENERALISE, REMOVE = 0.8, 0.95


def _matches(docs: DataFrame) -> DataFrame:
    """row, h, kind, k, match, start, end, before, after: every base match, valid or not, with the text around it."""
    text = F.col("text")
    blotted = F.regexp_replace(text, _LOOSE, "\x01")
    found = [
        (F.contains(text, F.lit("@")), text, EMAIL),
        (text.rlike(_MAY["ip"]), text, IP),
        (text.rlike(_MAY["card"]), blotted, CARD),
        (text.rlike(_MAY["phone"]), text, PHONE),
    ]
    parts = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.when(may, F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("hits"),
                F.when(may, F.split(source, pattern, -1)).otherwise(F.array(F.lit(""))).alias("gaps"),
            )
            for k, (may, source, pattern) in enumerate(found)
        ]
    )
    rows = docs.select("row", "h", F.explode(parts).alias("p")).where("size(p.hits) > 0")
    rows = rows.select("row", "h", "p.kind", F.posexplode(F.arrays_zip(F.col("p.hits").alias("match"), F.slice("p.gaps", F.lit(1), F.size("p.hits")).alias("before"), F.slice("p.gaps", F.lit(2), F.size("p.hits")).alias("after"))).alias("k", "m"))
    rows = rows.select("row", "h", "kind", "k", "m.match", F.col("m.before").alias("gap"), "m.after")
    end = F.sum(F.length("gap") + F.length("match")).over(Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end.cast("long")).withColumn("start", (F.col("end") - F.length("match")).cast("long"))


def _valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
    part = lambda s: F.ltrim(s, F.lit("0"))
    small = F.forall(F.split("match", r"\."), lambda s: F.when(F.length(part(s)) <= 3, F.concat(F.lit("0"), part(s)).cast("int")).otherwise(999) <= 255)
    return F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, small).when(F.col("kind") == 2, n.between(16, 19) & (F.when(n.between(16, 19), luhn).otherwise(1) % 10 == 0)).otherwise(n.between(8, 15))


def _terms(texts: DataFrame) -> DataFrame:
    """row, h, term, start, end: every term of texts(row, h, text). Places are running sums of lengths, so that a text's work grows in proportion to its length."""
    words = F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))
    found = texts.select("row", "h", words.alias("words"), F.split("text", TERM, -1).alias("gaps"))
    found = found.select("row", "h", F.posexplode(F.arrays_zip("words", F.transform("gaps", F.length).alias("gap"))).alias("k", "t")).where("t.words is not null")
    found = found.select("row", "h", "k", F.lower("t.words").alias("term"), F.length("t.words").cast("long").alias("n"), "t.gap")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("end", end).select("row", "h", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def _outside(marked: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of marked(row, start, end, kind) that share no place with a base match of their row."""
    rows = base.select("row", "start", "end", F.lit(-1).alias("kind")).union(marked.select("row", "start", "end", "kind"))
    place = lambda c: F.when(F.col("kind") < 0, F.col(c))
    by = Window.partitionBy("row")
    # The furthest end of matches that begin no later, and the next match that begins later.
    rows = rows.withColumn("reach", F.max(place("end")).over(by.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.min(place("start")).over(by.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("kind >= 0 and coalesce(reach <= start, true) and coalesce(next >= end, true)").select("row", "kind", "start", "end")


def _judged(base: DataFrame, terms: DataFrame, once: DataFrame, total: int) -> DataFrame:
    """h, term, kind: the terms of each text that disclose an entity it holds, of terms(h, term) and the corpus's texts.

    Entities that the same texts hold get the same scores and go as one. A term can only disclose an entity
    if no more texts have it than its threshold allows when all that hold the entity have it; others are not counted.
    """
    entity = F.concat_ws(":", F.col("kind"), F.lower("match"))
    of_entity = base.select("h", entity.alias("entity")).distinct()
    signs = [F.sum(F.xxhash64("h", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    held = of_entity.groupBy("entity").agg(F.count("*").alias("n_entity"), F.concat_ws(":", *[s.cast("string") for s in signs]).alias("held_by"))
    held = common.keep(of_entity.join(held, "entity").select("h", "held_by", "n_entity").distinct(), "pii-held")
    asked = common.bitmap(terms.select(F.xxhash64("term").alias("th")), "th")
    words = once.select(F.explode(F.array_distinct(F.transform(F.split("text", GAP), F.lower))).alias("term")).withColumn("th", F.xxhash64("term"))
    of_term = words.where((F.col("term") != "") & common.may_hold(asked, "th")).groupBy("term").agg(F.count("*").alias("n_term"))
    whole = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    told = lambda n_both: F.log(n_both * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    # An entity that every text holds has no information content to protect.
    may = told(F.least("n_term", "n_entity")) >= whole * GENERALISE
    most = held.where(whole > 0).agg(F.max("n_entity")).first()[0] or 1
    rare = common.keep(of_term.withColumn("n_entity", F.lit(most)).where(may | (F.col("n_term") <= most)).drop("n_entity"), "pii-rare")
    some = common.bitmap(rare.select(F.xxhash64("term").alias("th")), "th")
    terms = terms.withColumn("th", F.xxhash64("term")).where(common.may_hold(some, "th")).drop("th")
    pairs = common.keep(terms.join(rare, "term").join(held.where(whole > 0), "h").where(may), "pii-pairs")
    scores = pairs.groupBy("held_by", "n_entity", "term", "n_term").agg(F.count("*").alias("n_both")).withColumn("told", told(F.col("n_both"))).where(F.col("told") >= whole * GENERALISE)
    scores = scores.select("held_by", "term", F.when(F.col("told") >= whole * REMOVE, len(KINDS) + 1).otherwise(len(KINDS)).alias("kind"))
    return pairs.join(scores, ["held_by", "term"]).groupBy("h", "term").agg(F.max("kind").alias("kind"))


def _one_of_each_text(docs: DataFrame) -> tuple[DataFrame, int]:
    """text, once for all its exact copies, and the number of such texts. Only texts that may have copies are moved."""
    docs = docs.select(F.xxhash64("text").alias("h"), "text")
    texts = common.keep(docs.groupBy("h").agg(F.count("*").alias("copies")), "pii-hashes")
    has_copies = common.may_hold(common.bitmap(texts.where("copies > 1"), "h"), "h")
    return docs.where(~has_copies).union(docs.where(has_copies).dropDuplicates(["h"])).select("text"), texts.count()


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, base and extra (arrays of struct<kind, start, end>, code points, end exclusive) of every row.

    base: the patterns' valid matches. extra: terms (kind generalise or remove) of a text with an entity that
    they disclose, at every place outside base matches. How much a term tells of an entity is their pointwise
    mutual information over the corpus: the texts that hold both, against those that have the term and those
    that hold the entity; the entity's own information content is the measure. There is no least number of
    texts: of an entity that one text holds, the terms that few texts have are its mark. Copies of one text
    count once, in every one of these numbers. Null and empty texts: no spans. Equal rows give equal results; no rows give none.
    Rows are told apart by their place in their file.
    """
    docs = common.numbered(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).select("row", "doc_id", "text")
    may = F.contains("text", F.lit("@"))
    for pattern in _MAY.values():
        may = may | F.col("text").rlike(pattern)
    hits = common.keep(docs.where(may).select("row", F.xxhash64("text").alias("h"), "text"), "pii-texts")
    base = common.keep(_matches(hits).where(_valid()), "pii-base")
    holders = base.select("row").distinct()
    # A few long texts hold most terms: they are dealt out before they are cut.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = _terms(hits.join(holders, "row", "left_semi").repartition(width, "row"))
    once, total = _one_of_each_text(docs)
    judged = common.keep(_judged(base, common.keep(terms.select("h", "term").distinct(), "pii-terms"), once, total), "pii-judged")
    told = common.bitmap(judged.select(F.xxhash64("h", "term").alias("ht")), "ht")
    marked = terms.withColumn("ht", F.xxhash64("h", "term")).where(common.may_hold(told, "ht")).join(judged, ["h", "term"])
    every = base.select("row", "kind", "start", "end").union(_outside(marked, base))
    by_row = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("s"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    rows = docs.select("row", "doc_id").join(by_row, "row", "left").withColumn("s", F.coalesce("s", none))
    return rows.select("row", "doc_id", F.filter("s", lambda x: x["kind"] < len(KINDS)).alias("base"), F.filter("s", lambda x: x["kind"] >= len(KINDS)).alias("extra"))


def written(s: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, [*KINDS, "generalise", "remove"]))
    return F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts by kind, base_sha256 and spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(len(KINDS))], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "extra")).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every span replaced: base ones by [KIND], generalised terms by [TERM], removed ones by nothing. Of spans that overlap the first one counts."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit(""))
    order = F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    columns, df = df.columns, common.numbered(df, "__row")
    found = common.keep(spans(df.select(*columns), id_col, text_col).where("size(base) > 0").select(F.col("row").alias("__row"), order.alias("__spans")), "pii-spans")
    rows = df.join(found, "__row", "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.element_at(labels, x["kind"] + 1)).alias("out"), x["end"].alias("at")))
    done = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return rows.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(done)).select(*columns)
