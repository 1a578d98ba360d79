"""Entity resolution: names of one type that mean the same, as a fixpoint of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles that are left out of persons' names, and endings that are left out of organizations'; the first that fits goes.
TITLES = [
    "president ", "vice president ", "attorney general ", "general ", "senator ", "representative ", "secretary ", "minister ", "prime minister ",
    "prince ", "princess ", "king ", "queen ", "lord ", "lady ", "sir ", "dame ", "dr. ", "dr ", "prof. ", "prof ", "mr. ", "mr ", "mrs. ", "mrs ",
    "ms. ", "ms ", "miss ", "ceo ", "cfo ", "coo ", "cto ", "judge ", "justice ", "chief justice ", "director ", "commissioner ", "captain ", "colonel ",
    "major ", "lieutenant ", "sergeant ", "officer ", "agent ",
]
SUFFIXES = [
    ", inc.", ", inc", " inc.", " inc", ", corp.", ", corp", " corp.", " corp", ", llc", " llc", ", ltd.", ", ltd", " ltd.", " ltd", ", co.", ", co", " co.", " co",
    " corporation", " incorporated", " company", " group", " holdings",
]


def _plain(name: Column, kind: Column) -> Column:
    """The name in lower case, without a person's title or an organization's ending."""
    escape = lambda s: s.replace(".", r"\.")
    low = F.lower(name)
    person = F.regexp_replace(low, "^(?:" + "|".join(map(escape, TITLES)) + ")", "")
    organization = F.regexp_replace(low, "(?:" + "|".join(map(escape, SUFFIXES)) + ")$", "")
    return F.trim(F.when(kind == "person", person).when(kind == "organization", organization).otherwise(low))


def _matches(kind: Column, a: Column, b: Column) -> Column:
    """Whether the longer name a takes in the shorter b, both plain and in lower case."""
    pa, pb = F.split(a, r"\s+"), F.split(b, r"\s+")
    last = F.element_at(pa, -1) == F.element_at(pb, -1)
    initial = last & F.get(pb, F.lit(0)).rlike(r"^\p{L}\.?$") & F.startswith(F.get(pa, F.lit(0)), F.substring(b, 1, 1)) & (F.size(pa) > 1) & (F.size(pb) > 1)
    held = F.contains(a, b) & (F.length(b) >= 4)
    person = (last & (F.size(pb) == 1) & (F.size(pa) > 1)) | initial | (held & (F.size(pb) >= 2))
    return (a == b) | F.when(kind == "person", person).when(kind.isin("organization", "location"), held).otherwise(False)


def resolve(entities: DataFrame) -> DataFrame:
    """alias_id, canonical_id of entities(id, name, entity_type), whose ids are unique within a type.

    In the order of length (longest first), then name, then id, each name not taken yet takes all later ones
    that match it. What matches follows from type and name alone, so equal names are one name here, under their
    least id, and are told apart at the end. Candidates meet on their last word (persons of whom one is a last
    name or has an initial) or (names that another one may take in as a part of its
    words) where the longer one holds the rarest four characters of the shorter. Rounds settle the order: a name none of whose earlier matches can still
    stay is kept; one whose earliest match not taken is kept is taken.
    """
    spark = entities.sparkSession
    rows = entities.select("id", "entity_type", _plain(F.col("name"), F.col("entity_type")).alias("name")).where("name <> '' and entity_type is not null").distinct()
    names = rows.groupBy("entity_type", "name").agg(F.min("id").alias("first")).persist()
    match = _matches(F.col("entity_type"), F.col("x_name"), F.col("y_name"))
    before = F.struct(-F.length("x_name"), "x_name") < F.struct(-F.length("y_name"), "y_name")
    named = lambda df, s: df.select("entity_type", "word", F.col("name").alias(f"{s}_name"))
    words = F.split("name", r"\s+")
    people = names.where("entity_type = 'person'").select("entity_type", "name", F.element_at(words, -1).alias("word"), F.size(words).alias("n"), F.get(words, F.lit(0)).alias("begin"))
    whole, short = people.where("n > 1"), people.where((F.col("n") == 1) | F.col("begin").rlike(r"^\p{L}\.?$"))
    parts = F.transform(F.sequence(F.lit(1), F.length("name") - 3), lambda i: F.substring("name", i, F.lit(4)))
    grams = names.where("length(name) >= 4 and entity_type in ('organization', 'location', 'person')").select("entity_type", "name", F.explode(F.array_distinct(parts)).alias("word"))
    inner = grams.where((F.col("entity_type") != "person") | F.col("name").rlike(r"\s"))
    seen = grams.groupBy("entity_type", "word").agg(F.count("*").alias("n"))
    rarest = inner.join(seen, ["entity_type", "word"]).groupBy("entity_type", "name").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    on = ["entity_type", "word"]
    pairs = named(whole, "x").join(named(short, "y"), on).union(named(grams, "x").join(named(rarest, "y"), on)).where(before).where(match)
    key = lambda s: F.struct("entity_type", F.col(f"{s}_name").alias("name"))
    pairs = pairs.select(key("x").alias("canonical"), key("y").alias("alias"), F.struct(-F.length("x_name"), "x_name").alias("at")).distinct().persist()
    kind = "struct<entity_type: string, name: string>"
    state = spark.createDataFrame([], f"alias {kind}, canonical {kind}")
    nodes = pairs.select(F.col("alias").alias("id")).union(pairs.select("canonical")).distinct().persist()
    kept = nodes.join(pairs.select(F.col("alias").alias("id")), "id", "left_anti")
    while True:
        taken = pairs.join(state.select("alias"), "alias", "left_anti").join(state.select(F.col("alias").alias("canonical")), "canonical", "left_anti")
        first = taken.groupBy("alias").agg(F.min_by("canonical", "at").alias("canonical"))
        new = first.join(kept.select(F.col("id").alias("canonical")), "canonical").join(kept.select(F.col("id").alias("alias")), "alias", "left_anti").select("alias", "canonical").persist()
        if new.isEmpty():
            break
        state = state.union(new).persist()
        left = pairs.join(state.select(F.col("alias").alias("canonical")), "canonical", "left_anti")
        kept = nodes.join(left.select(F.col("alias").alias("id")), "id", "left_anti").join(state.select(F.col("alias").alias("id")), "id", "left_anti").persist()
    ids = names.select(F.struct("entity_type", "name").alias("name"), F.col("first").alias("canonical_id"))
    others = state.join(ids.withColumnRenamed("name", "canonical"), "canonical").select(F.col("alias").alias("name"), "canonical_id")
    ends = ids.join(others.select("name"), "name", "left_anti").union(others)
    aliases = rows.select("id", F.struct("entity_type", "name").alias("name")).join(ends, "name").where("id <> canonical_id")
    return aliases.select(F.col("id").alias("alias_id"), "canonical_id")
