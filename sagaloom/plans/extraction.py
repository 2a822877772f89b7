"""Segment extraction by rules: roles, places, relations and one event of each chunk, with their sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.functions.rules import EVENT_RULES, first_best
from sagaloom.functions.text import strip
from sagaloom.operators.dictionary import match_names
from sagaloom.plans.text_rules import ACTION_RULES
from sagaloom.session import cut
from sagaloom.sources.model import roles
from sagaloom.sources.tables import table

#: Actions that go both ways, and the class of an event that nothing names.
SYMMETRIC = ("对话", "同行", "会见", "冲突")
PLAIN_EVENT = "剧情推进"


def _clean(c: str) -> Column:
    """Stripped, non-empty sentences in their order."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """book_id, alias, entity, kind: names of roles and places of at least two characters; the entity is the canonical name."""
    r = roles(spark, d).select("book_id", F.col("canonical_name").alias("entity"), F.explode(F.array_append(F.coalesce("all_names", F.array().cast("array<string>")), F.col("canonical_name"))).alias("alias"), F.lit("role").alias("kind"))
    t = table(spark, d, "unified_locations").dropDuplicates(["id"])
    p = t.select("book_id", F.col("canonical_name").alias("entity"), F.explode(F.array_append(F.coalesce("all_names", F.array().cast("array<string>")), F.col("canonical_name"))).alias("alias"), F.lit("place").alias("kind"))
    return r.unionByName(p).where("length(alias) >= 2 and entity <> ''")


def extract(chunks: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """roles, places, relations, events of chunks (chunk_id, book_id, juan_index, source_sentences) by names (dictionary).

    Texts stay where they are: mentions carry their sentence, and of each chunk only its first sentences, the classes its whole
    text names and its keys are exchanged besides. All lists are those of one chunk.
    Defined cases: null and empty sentences are none and take no number; a chunk without mentions gives nothing; chunks delivered
    twice give their rows once.
    """
    own = chunks.where("chunk_id is not null").select("chunk_id", "book_id", "juan_index", _clean("source_sentences").alias("s"))
    each = own.select("chunk_id", "book_id", F.posexplode("s").alias("pos", "text")).withColumn("sentence", F.col("text"))
    m = cut(match_names(each, names, "book_id", "chunk_id", ("pos", "sentence")))
    whole = F.array_join("s", " ")
    about = own.select("chunk_id", "book_id", "juan_index", F.slice("s", 1, 5).alias("head"), first_best(whole, ACTION_RULES).alias("action"), first_best(whole, EVENT_RULES).alias("type")).distinct()
    seen = m.groupBy("chunk_id", "book_id", "kind", "entity", "pos", "sentence").agg(F.min("start").alias("start"))

    first = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    per = seen.groupBy("chunk_id", "book_id", "kind", "entity").agg(first.alias("f"), F.min(F.struct("pos", "start")).alias("first"))
    told = per.select(
        "chunk_id", "book_id", "kind", F.col("entity").alias("name"), F.array_join(F.transform("f", lambda x: x["pos"].cast("string")), ",").alias("sentences"),
        F.array_join(F.transform(F.slice("f", 1, 2), lambda x: x["sentence"]), " ").alias("description"), F.size("f").alias("n_sentences"), "first",
    )

    # mentions of a sentence in their order
    lists = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "entity")))), lambda x: x["entity"])
    line = seen.groupBy("chunk_id", "book_id", "pos", "sentence").agg(lists("role").alias("people"), lists("place").alias("places"))
    with_people = line.select("chunk_id", "people", F.explode("places").alias("name")).select("chunk_id", "name", F.explode("people").alias("person"))
    beside = with_people.groupBy("chunk_id", "name").agg(F.array_join(F.array_sort(F.collect_set("person")), "|").alias("people"))
    found_places = told.where("kind = 'place'").drop("kind").join(beside, ["chunk_id", "name"], "left").fillna("", ["people"])

    def directed(people: Column, action: Column) -> Column:
        """Pairs of the first four people: every one with every later one, or the first with the others."""
        four = F.slice(people, 1, 4)
        pairs = F.flatten(F.transform(four, lambda x, i: F.transform(F.slice(four, i + 2, F.lit(4)), lambda y: F.struct(i.alias("i"), x.alias("src"), y.alias("dst")))))
        return F.filter(pairs, lambda p: action.isin(*SYMMETRIC) | (p["i"] == 0))

    place_of = per.where("kind = 'place'").groupBy("chunk_id").agg(F.min(F.struct("first", "entity"))["entity"].alias("chunk_place"), F.count(F.lit(1)).alias("n_places"))
    acts = line.where("size(people) >= 2").withColumn("action", first_best(F.col("sentence"), ACTION_RULES)).where("action is not null")
    inside = acts.select("chunk_id", "book_id", "pos", "sentence", "action", F.get("places", F.lit(0)).alias("place"), F.posexplode(directed(F.col("people"), F.col("action"))).alias("n", "p"))
    inside = inside.groupBy("chunk_id", "book_id", "p.src", "p.dst", "action", "sentence").agg(F.min(F.struct("pos", "n", "place")).alias("at"))
    people_of = per.where("kind = 'role'").groupBy("chunk_id", "book_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "entity"))), lambda x: x["entity"]).alias("people"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.size("f")).alias("n"), "first", "entity"))), lambda x: x["entity"]).alias("ranked"),
    )
    lone = people_of.where("size(people) = 2").join(inside.select("chunk_id").distinct(), "chunk_id", "left_anti").join(about.select("chunk_id", "action"), "chunk_id").where("action is not null")
    lone = lone.select("chunk_id", "book_id", F.col("people")[0].alias("src"), F.col("people")[1].alias("dst"), "action", F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("place"))
    rel = inside.select("chunk_id", "book_id", "src", "dst", "action", "at.pos", "at.n", "at.place").unionByName(lone)
    rel = rel.join(place_of, "chunk_id", "left").select("chunk_id", "book_id", "src", "dst", "action", "pos", "n", F.coalesce("place", "chunk_place").alias("place"))

    joined = F.array_sort(F.collect_list(F.struct("pos", "n", "src", "dst", "action")))
    by_chunk = rel.groupBy("chunk_id").agg(joined.alias("r")).select("chunk_id", F.size("r").alias("n_relations"), F.col("r")[0]["action"].alias("first_action"), F.array_distinct(F.flatten(F.transform("r", lambda x: F.array(x["src"], x["dst"])))).alias("actors"))
    spoken = line.groupBy("chunk_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), 1, 3).alias("said"))
    chunk = about.join(spoken, "chunk_id").join(people_of.drop("book_id"), "chunk_id", "left").join(place_of, "chunk_id", "left").join(by_chunk, "chunk_id", "left")
    none = F.array().cast("array<string>")
    who = F.slice(F.coalesce(F.when(F.size("actors") > 0, F.col("actors")), "ranked", none), 1, 4)
    kind = F.coalesce("type", "first_action", F.lit(PLAIN_EVENT))
    # sentences with mentions come first, then the others; three with mentions at most leave two of the first five to fill up
    said = F.transform("said", lambda x: x["sentence"])
    rest = F.filter(F.transform("head", lambda x, i: F.when(~F.exists("said", lambda y: y["pos"] == i), x)), lambda x: x.isNotNull())
    summary = F.slice(F.concat(said, rest), 1, 3)
    base = (
        F.when(F.size("_who") >= 2, F.concat(F.get("_who", F.lit(0)), F.lit("与"), F.get("_who", F.lit(1)))).when(F.size("_who") == 1, F.get("_who", F.lit(0))).otherwise(F.lit(""))
    )
    somewhere = F.when(F.col("chunk_place").isNull(), "").when(F.size("_who") >= 1, F.concat(F.lit("在"), "chunk_place")).otherwise(F.col("chunk_place"))
    ev = chunk.withColumn("_who", who).withColumn("event_type", kind)
    ev = ev.select(
        "chunk_id", "book_id", F.concat(F.lit("第"), F.col("juan_index").cast("string"), F.lit("回 · "), base, somewhere, "event_type").alias("name"), "event_type", F.array_join("_who", "|").alias("participants"),
        F.col("chunk_place").alias("place"), F.array_join(summary, " ").alias("description"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"),
        F.substring(F.array_join(F.slice(F.concat(said, rest), 1, 2), " "), 1, 80).alias("evidence"),
    )
    return {"roles": told.where("kind = 'role'").drop("kind", "first"), "places": found_places.drop("first"), "relations": rel.drop("n"), "events": ev}


def _extract(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return extract(table(spark, d, "chunk_extractions"), dictionary(spark, d))


def extracted_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of each chunk: the sentences that name them, the first two as description."""
    return _extract(spark, d)["roles"]


def extracted_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places of each chunk, with the people named beside them."""
    return _extract(spark, d)["places"]


def extracted_relations(spark: SparkSession, d: str) -> DataFrame:
    """Directed relations with their action and place; position -1 for one that only the whole chunk gives."""
    return _extract(spark, d)["relations"]


def extracted_events(spark: SparkSession, d: str) -> DataFrame:
    """The event of each chunk with mentions: class, name, participants, place, summary, evidence."""
    return _extract(spark, d)["events"]


def action_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Actions of each directed pair by number, then by name."""
    return extracted_relations(spark, d).groupBy("book_id", "src", "dst", "action").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (extracted_roles, extracted_locations, extracted_relations, extracted_events, action_type_counts)}
SQL: dict[str, str] = {}
