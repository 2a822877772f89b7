"""Queries over the whole registry: decisions on names, the shared graph of names, re-keyed relations, validators, gates, overviews."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.operators.components import connected_components
from sagaloom.operators.ranking import best_per, ranked, top_n
from sagaloom.plans.audits import _DM, dossier_events
from sagaloom.plans.graph import _E, edges
from sagaloom.plans.resolution import NAME_RULES, typed_names
from sagaloom.plans.seasons import _CW, _S, _SP, conflict_beats, phases, scored, season_role_density
from sagaloom.plans.timeline import GENERIC_POWERS, SQL as TIMELINE_SQL, power_distribution
from sagaloom.sources.model import SQL_EVENTS, SQL_LOCATIONS, SQL_PEOPLE, SQL_ROLES, events, in_people, locations, pairs_of, roles
from sagaloom.sources.tables import table

#: Allow-list of designators that are names although they look like none (a parameter of the domain): a name as it
#: is, or with a resolution and a target; and endings and names of states.
ALLOWED: list[str | dict[str, str]] = ["守夜人", {"name": "老船夫", "resolution": "merge_to_canonical", "canonical_target": "船夫"}, {"name": "上人", "resolution": "other"}, {"resolution": "keep_as_canonical"}, " "]
RESOLUTIONS = ("keep_as_canonical", "merge_to_canonical")
STATES = ("秦", "楚", "齐", "燕", "赵", "魏", "韩", "汉", "唐", "大骊")


def _listed(c: str) -> Column:
    """An array, empty for null."""
    return F.coalesce(c, F.array().cast("array<string>"))


def allow_list(entries: Collection[str | Mapping[str, str]]) -> dict[str, str | None]:
    """name -> target to merge with, or null to keep; entries without a name are none, an unknown resolution keeps."""
    out: dict[str, str | None] = {}
    for e in entries:
        e = {"name": e} if isinstance(e, str) else e
        name, target = e.get("name", "").strip(), e.get("canonical_target", "").strip()
        if name:
            merge = e.get("resolution", "").strip() == RESOLUTIONS[1] and target and target != name
            out[name] = target if merge else None
    return out


def decisions(names: DataFrame, known: DataFrame, allowed: Mapping[str, str | None]) -> DataFrame:
    """book_id, name, decision (keep, merge, block), target for names (book_id, name) against roles (book_id, canonical_name, all_names).

    In this order: an allowed name keeps or merges as it says; an alias of a canonical name merges (the least one, for several);
    a canonical name is kept; a name that looks like no name is blocked; others are kept.
    """
    canon = known.where("canonical_name <> ''").select("book_id", F.col("canonical_name").alias("name")).distinct().withColumn("canonical", F.lit(True))
    alias = known.select("book_id", F.explode("all_names").alias("name"), F.col("canonical_name").alias("to")).where("name <> '' and to <> '' and name <> to").groupBy("book_id", "name").agg(F.min("to").alias("to"))
    j = names.join(canon, ["book_id", "name"], "left").join(alias, ["book_id", "name"], "left")
    by = F.create_map(*[F.lit(x) for k, v in allowed.items() for x in (k, v if v is not None else "")]) if allowed else F.create_map().cast("map<string,string>")
    said = F.element_at(by, F.col("name"))
    bad = reduce(lambda a, b: a | b, [F.col("name").rlike(p) for _, p in NAME_RULES])
    decision = F.when(said != "", "merge").when(said.isNotNull(), "keep").when(F.col("canonical"), "keep").when(F.col("to").isNotNull(), "merge").when(bad | (F.trim("name") == ""), "block").otherwise("keep")
    return j.select("book_id", "name", decision.alias("decision"), F.when(decision == "merge", F.coalesce(F.nullif(said, F.lit("")), "to")).alias("target"))


def name_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Keep, merge or block for every name of people in books."""
    return decisions(typed_names(spark, d), roles(spark, d), allow_list(ALLOWED))


def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of names that mean the same, by space: people and places share one, polities, schools and organizations have their own.

    People: a name to the target of its decision, and to its aliases unless an alias is blocked or a state's name beside a name
    that is none. Places: a name to its aliases that are not blocked. Polities and schools: X国 to X, X家 to X. Organizations: a
    name to its aliases.
    """
    people = roles(spark, d).where("canonical_name <> ''").select("book_id", F.col("canonical_name").alias("x"), F.explode(_listed("all_names")).alias("y"))
    places = locations(spark, d).where("canonical_name <> ''").select("book_id", F.col("canonical_name").alias("x"), F.explode(_listed("all_names")).alias("y"))
    bad = reduce(lambda a, b: a | b, [F.col("y").rlike(p) for _, p in NAME_RULES])
    free = ~bad | F.col("y").isin(*allow_list(ALLOWED))
    state = F.col("y").isin(*STATES) & ~(F.col("x").isin(*STATES) | F.col("x").endswith("国")) | (F.length("y") == 1) & F.col("y").isin(*STATES)
    chosen = name_decisions(spark, d).where("decision = 'merge'").select("book_id", F.col("name").alias("x"), F.col("target").alias("y"))
    shared = people.where(free & ~state).unionByName(places.where(free)).unionByName(chosen).withColumn("space", F.lit("name"))
    org = table(spark, d, "organizations").where("name <> ''")
    listed = org.select("book_id", F.col("name").alias("x"), F.explode(_listed("alias")).alias("y"), F.lit("organization").alias("space"))
    short = lambda end, space: org.where(F.col("name").endswith(end) & (F.length("name").between(2, 4))).select("book_id", F.col("name").alias("x"), F.expr("substring(name, 1, length(name) - 1)").alias("y"), F.lit(space).alias("space"))
    every = shared.unionByName(listed).unionByName(short("国", "polity")).unionByName(short("家", "school"))
    return every.where("book_id is not null and x <> '' and y <> '' and x <> y").select("book_id", "space", "x", "y").distinct()


def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name of these edges with the least name it hangs together with, by book and space."""
    node = lambda c: F.struct("book_id", "space", F.col(c).alias("name"))
    found = connected_components(merge_edges(spark, d).select(node("x").alias("u"), node("y").alias("v")))
    return found.select("node.book_id", "node.space", "node.name", F.col("label.name").alias("root"))


def relations_rekeyed(spark: SparkSession, d: str) -> DataFrame:
    """Relations between roles keyed by resolved names: collisions add their counts and join their units; a relation whose two
    ends became one name is kept; the first progress is that of the first of the relations, not merged."""
    root = resolved_names(spark, d).where("space = 'name'").select("book_id", F.col("name").alias("canonical_name"), "root")
    r = roles(spark, d).select("book_id", "id", "canonical_name").join(root, ["book_id", "canonical_name"], "left").select("book_id", "id", F.coalesce("root", "canonical_name").alias("root")).where("root is not null")
    e = pairs_of(events(spark, d)).groupBy("book_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.collect_set("unit").alias("units"), F.min("p0").alias("p0"))
    j = e.join(r.select("book_id", F.col("id").alias("a"), F.col("root").alias("ra")), ["book_id", "a"]).join(r.select("book_id", F.col("id").alias("b"), F.col("root").alias("rb")), ["book_id", "b"])
    return (
        j.groupBy("book_id", F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
        .agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("n_units"), F.min(F.struct("a", "b", "p0"))["p0"].alias("first_progress"), F.count(F.lit(1)).alias("merged"))
    )


def spotlight(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """book_id, role of the n most mentioned roles of each book."""
    return top_n(roles(spark, d), ["book_id"], [F.desc_nulls_last("total_mentions"), "id"], n).select("book_id", F.col("id").alias("role"))


def season_density_full(spark: SparkSession, d: str) -> DataFrame:
    """Density of roles in seasons with three more for a spotlight role."""
    star = spotlight(spark, d).withColumn("star", F.lit(3))
    j = season_role_density(spark, d).join(star, ["book_id", "role"], "left")
    return j.select("book_id", "season", "role", (F.col("density") + F.coalesce("star", F.lit(0))).cast("long").alias("density"))


def tension_full(spark: SparkSession, d: str) -> DataFrame:
    """Tension of each pair: 2 per conflict beat, up to 4 for actions, up to 3 for shared events, 2 with a spotlight role; 1 to 10."""
    p = phases(spark, d)
    beats = conflict_beats(p).groupBy("book_id", "a", "b").agg(F.count(F.when(F.col("label").isin("冲突", "对立"), 1)).alias("beats"))
    acts = p.groupBy("book_id", "a", "b").agg(F.sum(F.coalesce("action_count", F.lit(0))).alias("actions"), F.count(F.lit(1)).alias("n"))
    star = spotlight(spark, d, 1)
    j = beats.join(acts, ["book_id", "a", "b"]).join(star.select("book_id", F.col("role").alias("a"), F.lit(1).alias("sa")), ["book_id", "a"], "left").join(star.select("book_id", F.col("role").alias("b"), F.lit(1).alias("sb")), ["book_id", "b"], "left")
    points = 2 * F.col("beats") + F.least("actions", F.lit(4)) + F.least("n", F.lit(3)) + F.when(F.coalesce("sa", "sb").isNotNull(), 2).otherwise(0)
    return j.select("book_id", "a", "b", F.greatest(F.lit(1), F.least(F.lit(10), points)).cast("long").alias("tension"))


def kb_overview(spark: SparkSession, d: str) -> DataFrame:
    """Each book's totals, its ten largest powers and its ten most mentioned roles."""
    count = lambda df, k: df.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).select("book_id", F.lit("total").alias("kind"), F.lit(k).alias("label"), F.col("n").cast("long"))
    totals = [count(roles(spark, d), "roles"), count(events(spark, d), "events"), count(locations(spark, d), "locations"), count(edges(spark, d), "pairs")]
    powers = top_n(power_distribution(spark, d), ["book_id"], [F.desc("n"), "power"], 10).select("book_id", F.lit("power").alias("kind"), F.col("power").alias("label"), F.col("n").cast("long"))
    most = top_n(roles(spark, d), ["book_id"], [F.desc_nulls_last("total_mentions"), "id"], 10).select("book_id", F.lit("role").alias("kind"), F.col("id").alias("label"), F.col("total_mentions").cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [*totals, powers, most])


def shared_openings(spark: SparkSession, d: str, chars: int = 20, least: int = 5) -> DataFrame:
    """Openings of descriptions of roles and events, white space left out, that several records share."""
    opening = lambda df, k: df.where("description <> ''").select(F.lit(k).alias("kind"), F.substring(F.regexp_replace("description", r"[\t-\r \x{85}\p{Z}]+", ""), 1, chars).alias("opening"))
    both = opening(roles(spark, d), "role").unionByName(opening(events(spark, d), "event"))
    return both.groupBy("kind", "opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def mainline_links(spark: SparkSession, d: str, own: int = 8, most: int = 16) -> DataFrame:
    """Per book: the strongest edges of its spotlight role, of the graph among the roles on them the strongest links."""
    star = spotlight(spark, d, 1)
    e = edges(spark, d).select("book_id", "a", "b", "edge_score")
    near = top_n(e.join(star, "book_id").where("a = role or b = role"), ["book_id"], [F.desc("edge_score"), "a", "b"], own)
    nodes = near.select("book_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    inner = e.join(nodes.toDF("book_id", "a"), ["book_id", "a"], "left_semi").join(nodes.toDF("book_id", "b"), ["book_id", "b"], "left_semi")
    return top_n(inner, ["book_id"], [F.desc("edge_score"), "a", "b"], most).select("book_id", "a", "b", "edge_score", "rank_no")


def flatten_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of all entities of all chunks as rows."""
    e = table(spark, d, "chunk_extractions").select("chunk_id", F.posexplode("entities").alias("pos", "e")).select("chunk_id", "pos", F.posexplode("e.alias").alias("alias_no", "alias"))
    return e.distinct()


def flatten_sentence_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that all entities of all chunks point to, as rows, and whether the chunk has such a sentence."""
    c = table(spark, d, "chunk_extractions").select("chunk_id", F.size(_listed("source_sentences")).alias("n"), F.posexplode("entities").alias("pos", "e"))
    x = c.select("chunk_id", "pos", F.explode("e.sentence_indexes_in_segment").alias("sentence_index"), "n")
    return x.select("chunk_id", "pos", "sentence_index", F.col("sentence_index").between(0, F.col("n") - 1).alias("inside")).distinct()


def unit_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places of each unit by events, with their distinct roles."""
    s = events(spark, d).where("unit is not null and location is not null")
    n = s.groupBy("book_id", "unit", "location").agg(F.count(F.lit(1)).alias("n_events"))
    who = in_people(s).groupBy("book_id", "unit", "location").agg(F.countDistinct("role").alias("n_roles"))
    return n.join(who, ["book_id", "unit", "location"], "left").fillna(0, ["n_roles"])


def segment_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the progress, label and end of their unit; a unit without events leaves them null."""
    unit = events(spark, d).where("unit is not null").groupBy("book_id", F.col("unit").alias("juan_index")).agg(F.min("p0").alias("progress"), F.min(F.struct("p0", "id", "name"))["name"].alias("label"), F.max("p1").alias("last_progress"))
    return table(spark, d, "chunk_extractions").select("chunk_id", "book_id", "juan_index", "segment_index").distinct().join(unit, ["book_id", "juan_index"], "left")


def featured_events(spark: SparkSession, d: str) -> DataFrame:
    """Of each book's events with a dossier, the eight with most people, then by progress."""
    return top_n(dossier_events(spark, d), ["book_id"], [F.desc(F.size("people")), F.asc_nulls_last("p0"), "id"], 8).select("book_id", "id", F.size("people").alias("n_people"), "p0", "rank_no")


def spotlight_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that involve a spotlight role."""
    star = spotlight(spark, d).select("book_id", F.col("role").alias("star"))
    e = edges(spark, d).select("book_id", "a", "b", "weight")
    return e.join(star, (e["book_id"] == star["book_id"]) & ((star["star"] == e["a"]) | (star["star"] == e["b"])), "left_semi")


def role_unit_series(spark: SparkSession, d: str) -> DataFrame:
    """Units in which a role or a pair first acts in a season, with the number of events there."""
    s = scored(spark, d).where("unit is not null")
    r = in_people(s).select("book_id", "season", "unit", F.lit("role").alias("kind"), F.col("role").alias("label"))
    p = pairs_of(s).select("book_id", "season", "unit", F.lit("pair").alias("kind"), F.concat_ws("|", "a", "b").alias("label"))
    n = r.unionByName(p).groupBy("book_id", "kind", "label", "season", "unit").agg(F.count(F.lit(1)).alias("n"))
    return best_per(n, ["book_id", "kind", "label", "season"], ["unit"])


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Review verdicts by reviewer."""
    return table(spark, d, "review_labels").select("label_id", F.lower(F.trim("verdict")).alias("verdict"), "reviewer").distinct().groupBy("reviewer", "verdict").agg(F.count(F.lit(1)).alias("n"))


def relation_validation(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of relations: an end that is no role of the book, no progress, a first after the last, more units than events."""
    e = edges(spark, d)
    r = roles(spark, d).select("book_id", "id").distinct()
    j = e.join(r.select("book_id", F.col("id").alias("a"), F.lit(True).alias("ka")), ["book_id", "a"], "left").join(r.select("book_id", F.col("id").alias("b"), F.lit(True).alias("kb")), ["book_id", "b"], "left")
    rules = [("unknown end", F.col("ka").isNull() | F.col("kb").isNull()), ("no progress", F.col("first_progress").isNull()), ("span", F.col("first_progress") > F.col("last_progress")), ("units", F.col("n_units") > F.col("weight"))]
    return j.select("book_id", "a", "b", F.explode(F.array_compact(F.array(*(F.when(ok, n) for n, ok in rules)))).alias("issue"))


def unit_validation(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of documents as units: length, title missing, used twice in a book or a mere list, placeholders in the text."""
    t = table(spark, d, "documents").where("book_id is not null").select("doc_id", "book_id", "title", F.length("text").alias("n"), F.col("text").rlike("[?？]{3}|待补|TODO").alias("open")).distinct()
    twice = t.where("title <> ''").groupBy("book_id", "title").agg(F.count(F.lit(1)).alias("uses"))
    j = t.join(twice, ["book_id", "title"], "left")
    rules = [
        ("too short", F.coalesce("n", F.lit(0)) < 60), ("no title", F.coalesce("title", F.lit("")) == ""), ("title used twice", F.col("uses") > 1),
        ("title is a list", F.length("title") - F.length(F.replace("title", F.lit("、"), F.lit(""))) >= 3), ("placeholder", F.col("open")),
    ]
    return j.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(ok, n) for n, ok in rules)))).alias("issue"))


def near_repeats(texts: DataFrame, ratio: float = 0.92, prefix: int = 60) -> DataFrame:
    """group, id, other, likeness of texts (group, place, id, text) that nearly repeat the one before them in their group: a shared
    beginning of prefix characters (likeness null), or matching blocks in at least ratio of both.

    The beginning is compared in the JVM; lengths and the letters both have bound the ratio from above, so blocks are matched in
    Python only where they can reach it.
    """
    t = texts.where("text <> ''")
    before = t.select("group", (F.col("place") + 1).alias("place"), F.col("id").alias("other"), F.col("text").alias("last"))
    p = t.join(before, ["group", "place"])
    same = (F.length("text") >= prefix) & (F.substring("text", 1, prefix) == F.substring("last", 1, prefix))
    bound = 2 * F.least(F.length("text"), F.length("last")) / (F.length("text") + F.length("last"))

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            m = SequenceMatcher(None, x, y, autojunk=False)
            out.append(round(m.ratio(), 6) if m.quick_ratio() >= ratio else 0.0)
        return pd.Series(out)

    first = p.where(same).select("group", "id", "other", F.lit(None).cast("double").alias("likeness"))
    rest = p.where(~same & (bound >= ratio)).withColumn("likeness", likeness("text", "last")).where(F.col("likeness") >= ratio)
    return first.unionByName(rest.select("group", "id", "other", "likeness"))


def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a book that nearly repeat the one before them in their chapter, by key."""
    t = table(spark, d, "documents").where("book_id is not null and text is not null").select("doc_id", "book_id", "unit_index", "text").dropDuplicates(["doc_id"])
    t = t.select(F.concat_ws("/", "book_id", "unit_index").alias("group"), F.col("doc_id").alias("id"), "text", F.struct("book_id", "unit_index").alias("g"))
    return near_repeats(ranked(t, ["g"], ["id"], "place").drop("g"))


def build_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of a build: how many records fail each, and whether it is passed; raise_on_closed turns them into an error."""
    n = lambda df, gate: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(gate).alias("gate"), "n_bad", (F.col("n_bad") == 0).alias("ok"))
    ev = events(spark, d)
    known = roles(spark, d).select(F.col("id").alias("role"))
    gates = [
        n(ev.where("coalesce(name, '') = ''"), "events have names"),
        n(in_people(ev).join(known, "role", "left_anti"), "participants are roles"),
        n(roles(spark, d).where(F.col("canonical_name").rlike("[?？]")), "no placeholders in names"),
        n(ev.where("p0 > p1"), "progress runs forward"),
        n(roles(spark, d).groupBy("book_id", "canonical_name").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "canonical names are unique"),
    ]
    return reduce(DataFrame.unionByName, gates)


def raise_on_closed(gates: DataFrame) -> None:
    """An error that names the gates that are not passed (a handful of rows)."""
    closed = [f"{r.gate}: {r.n_bad}" for r in gates.where("not ok").orderBy("gate").collect()]
    if closed:
        raise ValueError("; ".join(closed))


def dossier_top_500(spark: SparkSession, d: str, most: int = 500, per_name: int = 3) -> DataFrame:
    """The best events of each book in the order of score, first unit and id: a display name once, a name at most three times; an
    event refused for its display name does not use up its name's share.

    Of the events of one name and display name only the first can be taken, so all others are dropped before the fold.
    """
    shown = F.concat_ws("：", F.get("people", F.lit(0)), "name").alias("shown")
    m = dossier_events(spark, d).select("id", "book_id", "name", "unit", "dossier_score", shown)
    order = [F.desc("dossier_score"), F.asc_nulls_last("unit"), "id"]
    one = best_per(m, ["book_id", "name", "shown"], order).select("book_id", "id", "name", "shown", "unit", "dossier_score")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dossier_score", "unit", "id"], ascending=[False, True, True], na_position="last")
        seen: set[str] = set()
        used: dict[str | None, int] = {}
        kept = []
        for i, name, display in zip(pdf.index, pdf.name, pdf.shown):
            if len(kept) < most and display not in seen and used.get(name, 0) < per_name:
                kept.append(i)
                seen.add(display)
                used[name] = used.get(name, 0) + 1
        out = pdf.loc[kept]
        return out.assign(rank_no=range(1, len(out) + 1))[["book_id", "id", "dossier_score", "rank_no"]]

    return one.groupBy("book_id").applyInPandas(fold, "book_id long, id string, dossier_score long, rank_no int")


def _bad(c: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({c}, '{p}'), false)" for _, p in NAME_RULES) + ")"


_ALLOW = allow_list(ALLOWED)
_ALLOWED_SQL = "allow AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', " + (f"'{v}'" if v else "CAST(NULL AS VARCHAR)") + ")" for k, v in _ALLOW.items()) + ") t(name, target))"
_DECIDED = f"""{SQL_ROLES}, {_ALLOWED_SQL}, typed_names AS (
  SELECT DISTINCT book_id, name FROM (SELECT book_id, canonical_name AS name FROM unified_roles UNION ALL SELECT book_id, unnest(all_names) FROM unified_roles
    UNION ALL SELECT book_id, unnest(list_transform(entities, lambda e: e.name)) FROM chunk_extractions) WHERE name IS NOT NULL AND book_id IS NOT NULL),
  canon AS (SELECT DISTINCT book_id, canonical_name AS name FROM role WHERE canonical_name <> ''),
  al AS (SELECT book_id, name, min(c) AS c FROM (SELECT book_id, unnest(all_names) AS name, canonical_name AS c FROM role) WHERE name <> '' AND c <> '' AND name <> c GROUP BY ALL),
  dec AS (SELECT t.book_id, t.name, CASE WHEN a.target IS NOT NULL THEN 'merge' WHEN a.name IS NOT NULL THEN 'keep' WHEN k.name IS NOT NULL THEN 'keep' WHEN al.c IS NOT NULL THEN 'merge'
      WHEN {_bad('t.name')} OR trim(t.name) = '' THEN 'block' ELSE 'keep' END AS decision, coalesce(a.target, al.c) AS maybe
    FROM typed_names t LEFT JOIN allow a ON a.name = t.name LEFT JOIN canon k ON k.book_id = t.book_id AND k.name = t.name LEFT JOIN al ON al.book_id = t.book_id AND al.name = t.name),
  decided AS (SELECT book_id, name, decision, CASE WHEN decision = 'merge' THEN maybe END AS target FROM dec)"""
_IN_STATES = lambda c: f"{c} IN (" + ", ".join(f"'{s}'" for s in STATES) + ")"
_FREE = f"(NOT {_bad('y')} OR y IN (SELECT name FROM allow))"
_MERGES = f"""{_DECIDED}, {SQL_LOCATIONS}, me AS (
  SELECT DISTINCT book_id, space, x, y FROM (
    SELECT book_id, 'name' AS space, canonical_name AS x, y FROM (SELECT book_id, canonical_name, unnest(all_names) AS y FROM role WHERE canonical_name <> '')
      WHERE {_FREE} AND NOT ({_IN_STATES('y')} AND NOT ({_IN_STATES('canonical_name')} OR canonical_name LIKE '%国') OR (length(y) = 1 AND {_IN_STATES('y')}))
    UNION ALL SELECT book_id, 'name', canonical_name, y FROM (SELECT book_id, canonical_name, unnest(all_names) AS y FROM loc WHERE canonical_name <> '') WHERE {_FREE}
    UNION ALL SELECT book_id, 'name', name, target FROM decided WHERE decision = 'merge'
    UNION ALL SELECT book_id, 'organization', name, unnest(alias) FROM organizations WHERE name <> ''
    UNION ALL SELECT book_id, 'polity', name, left(name, length(name) - 1) FROM organizations WHERE name LIKE '%国' AND length(name) BETWEEN 2 AND 4
    UNION ALL SELECT book_id, 'school', name, left(name, length(name) - 1) FROM organizations WHERE name LIKE '%家' AND length(name) BETWEEN 2 AND 4)
  WHERE book_id IS NOT NULL AND x <> '' AND y <> '' AND x <> y)"""
_RESOLVED = f"""{_MERGES}, sy AS (SELECT book_id, space, x, y FROM me UNION SELECT book_id, space, y, x FROM me),
  reach AS (SELECT book_id, space, x AS name, x AS seen FROM sy UNION SELECT r.book_id, r.space, r.name, s.y FROM reach r JOIN sy s ON s.book_id = r.book_id AND s.space = r.space AND s.x = r.seen),
  resolved AS (SELECT book_id, space, name, min(seen) AS root FROM reach GROUP BY ALL)"""
_STAR = lambda n: f"star AS (SELECT book_id, id AS role FROM role QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) <= {n})"
_ISSUES = lambda key, rules, src: " UNION ALL ".join(f"SELECT {key}, '{n}' AS issue FROM {src} WHERE {c}" for n, c in rules)
_POWER_SQL = TIMELINE_SQL["power_distribution"]

QUERIES = {
    f.__name__: f
    for f in (
        name_decisions, merge_edges, resolved_names, relations_rekeyed, season_density_full, tension_full, kb_overview, shared_openings, mainline_links, flatten_aliases, flatten_sentence_indexes, unit_locations,
        segment_metadata, featured_events, spotlight_pairs, role_unit_series, verdict_counts, relation_validation, unit_validation, build_gates, dossier_top_500, repeated_texts,
    )
}
SQL = {
    "name_decisions": f"WITH {_DECIDED} SELECT * FROM decided",
    "merge_edges": f"WITH {_MERGES} SELECT * FROM me",
    "resolved_names": f"WITH RECURSIVE {_RESOLVED} SELECT * FROM resolved",
    "relations_rekeyed": f"""WITH RECURSIVE {_RESOLVED}, {SQL_EVENTS}, {SQL_PEOPLE}, q AS (SELECT role.book_id, id, coalesce(root, canonical_name) AS root FROM role LEFT JOIN resolved s ON s.book_id = role.book_id AND s.space = 'name' AND s.name = canonical_name),
        p AS (SELECT x.book_id, x.role AS a, y.role AS b, x.unit, x.p0 FROM ep x JOIN ep y ON x.id = y.id AND x.role < y.role),
        m AS (SELECT p.*, least(qa.root, qb.root) AS x, greatest(qa.root, qb.root) AS y FROM p JOIN q qa ON qa.book_id = p.book_id AND qa.id = a JOIN q qb ON qb.book_id = p.book_id AND qb.id = b WHERE qa.root IS NOT NULL AND qb.root IS NOT NULL),
        f AS (SELECT book_id, x, y, a, b, min(p0) AS p0 FROM m GROUP BY ALL)
        SELECT m.book_id, m.x, m.y, count(*) AS n, count(DISTINCT unit) AS n_units, (SELECT p0 FROM f WHERE f.book_id = m.book_id AND f.x = m.x AND f.y = m.y ORDER BY a, b LIMIT 1) AS first_progress, count(DISTINCT (a, b)) AS merged FROM m GROUP BY m.book_id, m.x, m.y""",
    "season_density_full": f"""WITH {_SP}, {SQL_ROLES}, {_STAR(3)}, own AS (SELECT book_id, season, role, count(DISTINCT unit) AS units, count(*) AS n FROM sp WHERE season IS NOT NULL GROUP BY ALL),
        rel AS (SELECT x.book_id, x.season, x.role, count(DISTINCT y.role) AS k FROM sp x JOIN sp y ON x.id = y.id AND x.role <> y.role GROUP BY ALL)
        SELECT own.book_id, own.season, own.role, CAST(3 * units + 2 * n + 2 * coalesce(k, 0) + CASE WHEN star.role IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS density
        FROM own LEFT JOIN rel USING (book_id, season, role) LEFT JOIN star ON star.book_id = own.book_id AND star.role = own.role""",
    "tension_full": f"""WITH {_CW}, {SQL_ROLES}, {_STAR(1)}, bt AS (SELECT book_id, a, b, count(*) FILTER (label IN ('冲突', '对立')) AS beats FROM cw GROUP BY ALL),
        ac AS (SELECT book_id, a, b, sum(coalesce(action_count, 0)) AS actions, count(*) AS n FROM ph GROUP BY ALL)
        SELECT bt.book_id, bt.a, bt.b, CAST(greatest(1, least(10, 2 * beats + least(actions, 4) + least(n, 3) + CASE WHEN EXISTS (SELECT 1 FROM star WHERE star.book_id = bt.book_id AND star.role IN (bt.a, bt.b)) THEN 2 ELSE 0 END)) AS BIGINT) AS tension
        FROM bt JOIN ac USING (book_id, a, b)""",
    "kb_overview": f"""WITH {_E}, {SQL_ROLES}, {SQL_LOCATIONS}, pd AS ({_POWER_SQL})
        SELECT book_id, 'total' AS kind, 'roles' AS label, count(*) AS n FROM role GROUP BY book_id UNION ALL SELECT book_id, 'total', 'events', count(*) FROM ev GROUP BY book_id
        UNION ALL SELECT book_id, 'total', 'locations', count(*) FROM loc GROUP BY book_id UNION ALL SELECT book_id, 'total', 'pairs', count(*) FROM edges GROUP BY book_id
        UNION ALL (SELECT book_id, 'power', power, n FROM pd QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC, power) <= 10)
        UNION ALL (SELECT book_id, 'role', id, total_mentions FROM role QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) <= 10)""",
    "shared_openings": f"""WITH {SQL_EVENTS}, {SQL_ROLES}, o AS (SELECT 'role' AS kind, description FROM role UNION ALL SELECT 'event', description FROM ev)
        SELECT kind, substring(regexp_replace(description, '[\\t-\\r \\x{{85}}\\p{{Z}}]+', '', 'g'), 1, 20) AS opening, count(*) AS n FROM o WHERE description <> '' GROUP BY ALL HAVING count(*) >= 5""",
    "mainline_links": f"""WITH {_E}, {SQL_ROLES}, {_STAR(1)}, own AS (SELECT e.* FROM edges e JOIN star s ON s.book_id = e.book_id AND s.role IN (a, b) QUALIFY row_number() OVER (PARTITION BY e.book_id ORDER BY edge_score DESC, a, b) <= 8),
        nodes AS (SELECT book_id, a AS id FROM own UNION SELECT book_id, b FROM own), i AS (SELECT e.book_id, a, b, edge_score FROM edges e WHERE (e.book_id, a) IN (SELECT (book_id, id) FROM nodes) AND (e.book_id, b) IN (SELECT (book_id, id) FROM nodes))
        SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY edge_score DESC, a, b) AS rank_no FROM i QUALIFY rank_no <= 16""",
    "flatten_aliases": """WITH c AS (SELECT DISTINCT chunk_id, entities FROM chunk_extractions), e AS (SELECT chunk_id, CAST(i - 1 AS INT) AS pos, entities[i].alias AS l FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM c))
        SELECT chunk_id, pos, CAST(j - 1 AS INT) AS alias_no, l[j] AS alias FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM e)""",
    "flatten_sentence_indexes": """WITH c AS (SELECT DISTINCT chunk_id, entities, len(coalesce(source_sentences, [])) AS n FROM chunk_extractions), e AS (SELECT chunk_id, n, CAST(i - 1 AS INT) AS pos, entities[i].sentence_indexes_in_segment AS l FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM c))
        SELECT DISTINCT chunk_id, pos, s AS sentence_index, s BETWEEN 0 AND n - 1 AS inside FROM (SELECT *, unnest(l) AS s FROM e)""",
    "unit_locations": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, n AS (SELECT book_id, unit, location, count(*) AS n_events FROM ev WHERE unit IS NOT NULL AND location IS NOT NULL GROUP BY ALL), w AS (SELECT book_id, unit, location, count(DISTINCT role) AS n_roles FROM ep GROUP BY ALL)
        SELECT n.*, coalesce(n_roles, 0) AS n_roles FROM n LEFT JOIN w ON w.book_id = n.book_id AND w.unit = n.unit AND w.location = n.location""",
    "segment_metadata": f"""WITH {SQL_EVENTS}, u AS (SELECT book_id, unit AS juan_index, min(p0) AS progress, max(p1) AS last_progress FROM ev WHERE unit IS NOT NULL GROUP BY ALL),
        l AS (SELECT book_id, unit AS juan_index, name AS label FROM ev WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, unit ORDER BY p0 NULLS FIRST, id) = 1),
        c AS (SELECT DISTINCT chunk_id, book_id, juan_index, segment_index FROM chunk_extractions) SELECT c.*, progress, label, last_progress FROM c LEFT JOIN u USING (book_id, juan_index) LEFT JOIN l USING (book_id, juan_index)""",
    "featured_events": f"""WITH {_DM} SELECT k.book_id, k.id, len(people) AS n_people, p0, row_number() OVER (PARTITION BY k.book_id ORDER BY len(people) DESC, p0 NULLS LAST, k.id) AS rank_no FROM k JOIN m ON m.id = k.id QUALIFY rank_no <= 8""",
    "spotlight_pairs": f"WITH {_E}, {SQL_ROLES}, {_STAR(3)} SELECT book_id, a, b, weight FROM edges e WHERE EXISTS (SELECT 1 FROM star s WHERE s.book_id = e.book_id AND s.role IN (a, b))",
    "role_unit_series": f"""WITH {_SP}, x AS (SELECT book_id, season, unit, 'role' AS kind, role AS label FROM sp WHERE unit IS NOT NULL UNION ALL SELECT a.book_id, a.season, a.unit, 'pair', a.role || '|' || b.role FROM sp a JOIN sp b ON a.id = b.id AND a.role < b.role WHERE a.unit IS NOT NULL)
        , g AS (SELECT book_id, kind, label, season, unit, count(*) AS n FROM x GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY book_id, kind, label, season ORDER BY unit) = 1""",
    "verdict_counts": "SELECT reviewer, verdict, count(*) AS n FROM (SELECT DISTINCT label_id, lower(trim(verdict)) AS verdict, reviewer FROM review_labels) GROUP BY ALL",
    "relation_validation": f"WITH {_E}, {SQL_ROLES} " + _ISSUES("book_id, a, b", [("unknown end", "NOT EXISTS (SELECT 1 FROM role r WHERE r.book_id = edges.book_id AND r.id = a) OR NOT EXISTS (SELECT 1 FROM role r WHERE r.book_id = edges.book_id AND r.id = b)"), ("no progress", "first_progress IS NULL"), ("span", "first_progress > last_progress"), ("units", "n_units > weight")], "edges"),
    "unit_validation": "WITH t AS (SELECT DISTINCT doc_id, book_id, title, length(text) AS n, regexp_matches(text, '[?？]{3}|待补|TODO') AS open FROM documents WHERE book_id IS NOT NULL), u AS (SELECT book_id, title, count(*) AS uses FROM t WHERE title <> '' GROUP BY ALL), j AS (SELECT t.*, uses FROM t LEFT JOIN u USING (book_id, title)) "
    + _ISSUES("doc_id", [("too short", "coalesce(n, 0) < 60"), ("no title", "coalesce(title, '') = ''"), ("title used twice", "uses > 1"), ("title is a list", "length(title) - length(replace(title, '、', '')) >= 3"), ("placeholder", "open")], "j"),
    "build_gates": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES}, g AS (SELECT 'events have names' AS gate, count(*) AS n_bad FROM ev WHERE coalesce(name, '') = '' UNION ALL SELECT 'participants are roles', count(*) FROM ep WHERE ep.role NOT IN (SELECT id FROM role)
        UNION ALL SELECT 'no placeholders in names', count(*) FROM role WHERE regexp_matches(canonical_name, '[?？]') UNION ALL SELECT 'progress runs forward', count(*) FROM ev WHERE p0 > p1
        UNION ALL SELECT 'canonical names are unique', count(*) FROM (SELECT 1 FROM role GROUP BY book_id, canonical_name HAVING count(*) > 1)) SELECT gate, n_bad, n_bad = 0 AS ok FROM g""",
}
