"""Composite queries: shared events, arcs, beats and anchors of seasons, overviews, packets, extraction from segments, validators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.functions.ranges import overlaps, sql_overlaps
from sagaloom.functions.rules import TYPE_WEIGHTS, first_best, lookup, sql_lookup
from sagaloom.functions.text import prose_sentences
from sagaloom.operators.merging import content_hash
from sagaloom.operators.ranking import best_per, numbered, ranked, top_n, with_previous
from sagaloom.plans.graph import edges
from sagaloom.plans.seasons import _KEY, _S, _SP, _SX, arc_top8, boundary_units, first_phases, key_events_per_unit, key_scored, phases, roster_top24, scored, tensions, unit_synopsis
from sagaloom.plans.text_rules import ACTION_RULES, dictionary_mentions
from sagaloom.plans.timeline import PROGRESS, UNITS
from sagaloom.sources.model import SQL_EVENTS, SQL_ROLES, events, in_people, pairs_of, roles, season_of
from sagaloom.sources.tables import table

#: Extra weight of a class when a spotlight role is in focus.
TYPE_BONUS = {"冲突": 4, "揭示": 4, "立势": 4, "师承": 3, "迁移": 3, "遭遇": 3, "护持": 3, "指点": 2, "会见": 1, "对话": 1}
SYMMETRIC = ["对话", "会见", "冲突", "同行"]


def prose_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of role descriptions by the prose splitter, which keeps inner spaces."""
    return roles(spark, d).where("description is not null").select("id", F.posexplode(prose_sentences(F.col("description"))).alias("pos", "sentence"))


def focused_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each event in its book's focus: class bonus, frequency penalty, bands of company, the spotlight role, the place."""
    star = best_per(roles(spark, d), ["book_id"], [F.desc_nulls_last("total_mentions"), "id"]).select("book_id", F.col("id").alias("star"))
    k = key_scored(spark, d).join(star, "book_id", "left")
    n = F.size("people")
    band = F.when(n == 0, -2).when(n <= 2, 4).when(n <= 4, 2).when(n <= 6, -4).when(n <= 9, -14).otherwise(-28)
    penalty = F.when(F.col("freq") > 5, -2 * F.least(F.col("freq") - 5, F.lit(15))).otherwise(0)
    spot = F.when(F.coalesce(F.array_contains("people", F.col("star")), F.lit(False)), 3).otherwise(-3)
    placed = F.when(F.coalesce(F.col("location") != "", F.lit(False)), 1).otherwise(0)
    return k.select("id", (F.col("score") + penalty + band + lookup(F.col("event_type"), TYPE_BONUS, 0) + spot + placed).cast("long").alias("focus"))


def shared_events(spark: SparkSession, d: str) -> DataFrame:
    """The six best shared events of each pair by class, place, text and company, numbered by time again."""
    p = pairs_of(scored(spark, d))
    s = 3 * lookup(F.col("event_type"), TYPE_WEIGHTS, 1) + F.when(F.coalesce(F.col("significance") != "", F.lit(False)), 2).otherwise(0) + F.when(F.col("location").isNotNull(), 1).otherwise(0) + F.least(F.coalesce("action_count", F.lit(0)), F.lit(3))
    best = top_n(p.withColumn("s", s), ["book_id", "a", "b"], [F.desc("s"), F.asc_nulls_last("unit"), "id"], 6)
    return ranked(best, ["book_id", "a", "b"], [F.asc_nulls_last("unit"), "id"], "by_time").select("book_id", "a", "b", "id", "s", "by_time")


def shared_events_spread(spark: SparkSession, d: str) -> DataFrame:
    """Six shared events of each pair, at most two of a third while another third has fewer, each name once.

    The choice depends on those before it; only the best twelve of each third and name can matter, so a pair's fold is bounded.
    """
    p = numbered(pairs_of(scored(spark, d)), ["book_id", "a", "b"], F.col("p0"), ["id"], "pos")
    n = p.groupBy("book_id", "a", "b").agg(F.count(F.lit(1)).alias("total"))
    p = p.join(n, ["book_id", "a", "b"]).where("total > 1")
    p = p.withColumn("third", F.least(F.lit(2), F.floor(3 * (F.col("pos") - 1) / (F.col("total") - 1))).cast("int"))
    few = top_n(best_per(p, ["book_id", "a", "b", "third", "name"], [F.desc("score"), "pos"]), ["book_id", "a", "b", "third"], [F.desc("score"), "pos"], 12)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "pos"], ascending=[False, True])
        taken, names, held = [], set(), {0: 0, 1: 0, 2: 0}
        for r in pdf.itertuples():
            if len(taken) >= 6 or r.name in names or (held[r.third] >= 2 and min(held.values()) < 2):
                continue
            taken.append(r.Index)
            names.add(r.name)
            held[r.third] += 1
        for r in pdf.itertuples():
            if len(taken) >= 6:
                break
            if r.Index not in taken and r.name not in names:
                taken.append(r.Index)
                names.add(r.name)
        return pdf.loc[taken].sort_values("pos")[["book_id", "a", "b", "id", "third"]]

    return few.select("book_id", "a", "b", "id", "name", "score", "pos", "third").groupBy("book_id", "a", "b").applyInPandas(fold, "book_id long, a string, b string, id string, third int")


def role_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Places of each role in the order of progress, a place named again only after another."""
    p = in_people(events(spark, d)).where("location is not null").select("book_id", "role", "location", "p0", "id")
    p = with_previous(numbered(p, ["book_id", "role"], F.col("p0"), ["id"], "pos"), ["book_id", "role"], "pos", "location")
    return p.where("_last is null or _last <> location").select("book_id", "role", "id", "location", "p0")


def season_beats(spark: SparkSession, d: str) -> DataFrame:
    """Opening, midpoint and payoff of each season: the best event of the first pool that has one.

    The pools: names not used in the book, names not used in the season, any event, all in the window; names not used in the
    season, any event, of the whole season; then a beat without an event. Events without progress stand at their unit. Names
    used before change later choices, so a book's seasons are folded in order. At most three events are taken a season: the
    best three of a name suffice, and per window as many names as the book has beats.
    """
    s = scored(spark, d).where("season is not null").withColumn("name", F.coalesce("name", F.lit("")))
    span = s.groupBy("book_id", "season").agg(
        F.coalesce(F.min("p0"), F.min("unit")).alias("lo"), F.coalesce(F.max("p0"), F.max("unit")).alias("hi")
    )
    s = s.join(span, ["book_id", "season"]).withColumn("at", F.coalesce("p0", "unit", "lo").cast("double"))
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    s = s.withColumn("beat", F.when(F.col("at") <= F.col("lo") + length * F.lit(0.3), 1).when(F.col("at") >= F.col("lo") + length * F.lit(0.7), 3).otherwise(2))
    order = [F.desc("score"), F.asc_nulls_last("p0"), F.asc_nulls_last("unit"), "name", "id"]
    window = ["book_id", "season", "beat"]
    three = top_n(s, [*window, "name"], order, 3, "nth").select(*window, "id", "name", "score", "p0", "unit", "nth")
    beats = span.groupBy("book_id").agg((3 * F.count(F.lit(1))).alias("beats"))
    names = ranked(three.where("nth = 1"), window, order, "place").join(beats, "book_id").where("place <= beats").select(*window, "name")
    few = three.join(names, [*window, "name"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        pdf = pdf.sort_values(["score", "p0", "unit", "name", "id"], ascending=[False, True, True, True, True], na_position="last")
        for season, g in pdf.groupby("season", sort=True):
            rows, ids, names = list(g.itertuples()), set(), set()
            for beat in (1, 2, 3):
                left = [r for r in rows if r.id not in ids]
                here = [r for r in left if r.beat == beat]
                pools = (
                    (r for r in here if r.name not in names and r.name not in used), (r for r in here if r.name not in names), iter(here),
                    (r for r in left if r.name not in names), iter(left),
                )
                r = next((x for x in (next(p, None) for p in pools) if x is not None), None)
                if r is not None:
                    ids.add(r.id)
                    names.add(r.name)
                out.append((int(pdf.book_id.iloc[0]), int(season), beat, None if r is None else r.id, None if r is None else int(r.score)))
            used |= names - {""}
        return pd.DataFrame({c: pd.Series([o[i] for o in out], dtype=t) for i, (c, t) in enumerate((("book_id", "int64"), ("season", "int32"), ("beat", "int32"), ("id", "object"), ("score", "Int64")))})

    return few.groupBy("book_id").applyInPandas(fold, "book_id long, season int, beat int, id string, score long")


def season_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Four events of each season by score with different names."""
    s = scored(spark, d).where("season is not null")
    one = best_per(s, ["book_id", "season", "name"], [F.desc("score"), F.asc_nulls_last("p0"), "id"])
    return top_n(one, ["book_id", "season"], [F.desc("score"), F.asc_nulls_last("p0"), "id"], 4).select("book_id", "season", "id", "name", "rank_no")


def season_overview(spark: SparkSession, d: str) -> DataFrame:
    """Per season: events, roles, places, the names of its anchors, conflicts among its events."""
    s = scored(spark, d).where("season is not null")
    base = s.groupBy("book_id", "season").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("location").alias("n_places"), F.count(F.when(F.col("event_type") == "冲突", 1)).alias("conflicts"))
    who = in_people(s).groupBy("book_id", "season").agg(F.countDistinct("role").alias("n_roles"))
    a = season_anchors(spark, d).groupBy("book_id", "season").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "name"))), lambda x: x["name"]), ",").alias("anchors"))
    return base.join(who, ["book_id", "season"], "left").join(a, ["book_id", "season"], "left").fillna(0, ["n_roles"])


def character_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arc of each roster role: its best events in time, the counterparts it shares most with."""
    r = roster_top24(spark, d).select("book_id", "role", "points")
    ev = arc_top8(spark, d).join(r, ["book_id", "role"]).groupBy("book_id", "role", "points").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("by_time", "id"))), lambda x: x["id"]), ",").alias("events"))
    e = edges(spark, d)
    side = e.select("book_id", F.explode(F.array(F.struct(F.col("a").alias("role"), F.col("b").alias("other")), F.struct(F.col("b").alias("role"), F.col("a").alias("other")))).alias("s"), "weight").select("book_id", "s.*", "weight")
    four = top_n(side, ["book_id", "role"], [F.desc("weight"), "other"], 4).groupBy("book_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "other"))), lambda x: x["other"]), ",").alias("counterparts"))
    return ev.join(four, ["book_id", "role"], "left")


def conflict_chains(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a tension of five or more, with their phases in order."""
    every = phases(spark, d)
    p = first_phases(every).groupBy("book_id", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "label"))), lambda x: x["label"]), "→").alias("phases"))
    return tensions(every).where("tension >= 5").join(p, ["book_id", "a", "b"])


def relation_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Packets of pairs whose ends are both roles of the registry: names, weight, hash of the content."""
    r = roles(spark, d).select("book_id", "id", F.coalesce("canonical_name", "id").alias("name"))
    e = edges(spark, d).join(r.toDF("book_id", "a", "name_a"), ["book_id", "a"]).join(r.toDF("book_id", "b", "name_b"), ["book_id", "b"])
    return e.select("book_id", "a", "b", "name_a", "name_b", "weight", content_hash("name_a", "name_b", "weight").alias("hash"))


def entity_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets of roles: span, appearances, three best events, hash."""
    p = in_people(scored(spark, d))
    base = p.groupBy("book_id", "role").agg(F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.count(F.lit(1)).alias("n"))
    one = best_per(p, ["book_id", "role", "name"], [F.desc("score"), "id"])
    best = top_n(one, ["book_id", "role"], [F.desc("score"), "id"], 3).groupBy("book_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "id"))), lambda x: x["id"]), ",").alias("best"))
    return base.join(best, ["book_id", "role"]).withColumn("hash", content_hash("role", "first_unit", "last_unit", "best"))


def union_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Names of people from the registry, from typed records and from chunks; the first source that has a name wins."""
    a = roles(spark, d).select("book_id", F.col("canonical_name").alias("name"), F.lit(1).alias("priority"))
    b = table(spark, d, "unified_roles").where("id is null").select("book_id", F.col("canonical_name").alias("name"), F.lit(2).alias("priority"))
    c = table(spark, d, "chunk_extractions").select("book_id", F.explode("entities.name").alias("name"), F.lit(3).alias("priority"))
    return a.union(b).union(c).where("name <> '' and book_id is not null").groupBy("book_id", "name").agg(F.min("priority").alias("priority"))


def insight_filter(spark: SparkSession, d: str) -> DataFrame:
    """Arcs' events within the unit and progress ranges; arcs without any are left out."""
    inside = events(spark, d).where(overlaps(F.array_min("source_units"), F.array_max("source_units"), UNITS) & overlaps(F.col("p0"), F.col("p1"), PROGRESS)).select("id")
    return arc_top8(spark, d).join(inside, "id", "left_semi").groupBy("book_id", "role").agg(F.count(F.lit(1)).alias("n"))


def roster_gallery(spark: SparkSession, d: str) -> DataFrame:
    """The roster in its order with the registry's facts; roles without a description keep their row."""
    r = roles(spark, d).select("book_id", F.col("id").alias("role"), "canonical_name", "primary_power", F.length("description").alias("chars"))
    return roster_top24(spark, d).join(r, ["book_id", "role"]).select("book_id", "rank_no", "role", "canonical_name", "primary_power", "chars")


def writer_references(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and roster arcs that touch a block of chapters: by an event in it, or by a span that overlaps it."""
    block = (6, 8)
    ids = events(spark, d).where(overlaps(F.array_min("source_units"), F.array_max("source_units"), block)).select("id")
    by_event = arc_top8(spark, d).join(ids, "id", "left_semi").select("book_id", F.lit("arc").alias("kind"), F.col("role").alias("label"))
    spans = in_people(events(spark, d)).groupBy("book_id", "role").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    by_span = spans.where(overlaps(F.col("lo"), F.col("hi"), block)).select("book_id", F.lit("arc").alias("kind"), F.col("role").alias("label"))
    return by_event.union(by_span).distinct()


def oriented_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of roles named in one chunk, by first mention: all pairs of the first four for symmetric actions, else the first with the next three."""
    m = dictionary_mentions(spark, d).groupBy("book_id", "chunk_id", "entity").agg(F.min("start").alias("start"))
    text = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"]).select("chunk_id", F.array_join("source_sentences", "").alias("text"))
    act = text.select("chunk_id", first_best(F.col("text"), ACTION_RULES).alias("action")).where("action is not null")
    four = top_n(m, ["book_id", "chunk_id"], ["start", "entity"], 4).join(act, "chunk_id")
    x, y = four.select("book_id", "chunk_id", "action", F.col("entity").alias("src"), F.col("rank_no").alias("i")), four.select("chunk_id", F.col("entity").alias("dst"), F.col("rank_no").alias("j"))
    return x.join(y, "chunk_id").where((F.col("i") < F.col("j")) & (F.col("action").isin(*SYMMETRIC) | (F.col("i") == 1))).select("book_id", "chunk_id", "action", "src", "dst")


def segment_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Per unit of each book what the rules find in its chunks: mentions, distinct roles, oriented pairs."""
    m = dictionary_mentions(spark, d)
    where_ = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"]).select("chunk_id", "juan_index")
    a = m.join(where_, "chunk_id").groupBy("book_id", "juan_index").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("entity").alias("n_roles"))
    p = oriented_pairs(spark, d).join(where_, "chunk_id").groupBy("book_id", "juan_index").agg(F.count(F.lit(1)).alias("pairs"))
    return a.join(p, ["book_id", "juan_index"], "left").fillna(0, ["pairs"])


def dossier_validation(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of events as dossiers: lengths, repeated text, missing evidence, wrong spans."""
    ev = events(spark, d)
    rules = [
        ("no description", F.coalesce(F.col("description"), F.lit("")) == ""), ("short description", F.length("description").between(1, 11)), ("significance repeats description", F.col("significance") == F.col("description")),
        ("span", F.col("p0") > F.col("p1")), ("no people", F.size("people") == 0), ("unit outside", F.col("unit") < 1), ("no actions", F.col("action_count") <= 0),
    ]
    return ev.select("id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))).alias("issue"))


def regeneration_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The twenty events of each book with most issues, worst first."""
    n = dossier_validation(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("issues")).join(events(spark, d).select("id", "book_id"), "id")
    return top_n(n, ["book_id"], [F.desc("issues"), "id"], 20).select("book_id", "id", "issues", "rank_no")


def season_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events per season and unit with subtotals."""
    s = events(spark, d).select("book_id", season_of(F.col("unit")).alias("season"), "unit").where("unit is not null")
    return s.rollup("book_id", "season", "unit").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def curated_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Beats of configured relationships (here each book's three heaviest pairs): per season the shared event that fits best,
    two for a place, three for a word in the name, one for a word in the text."""
    pairs = top_n(edges(spark, d), ["book_id"], [F.desc("weight"), "a", "b"], 3).select("book_id", "a", "b")
    words = ["相逢", "夜谈", "论剑"]
    p = pairs_of(scored(spark, d)).where("season is not null").join(pairs, ["book_id", "a", "b"], "left_semi")
    named = F.coalesce(F.col("name").rlike("|".join(words)), F.lit(False))
    told = F.coalesce(F.col("description").rlike("|".join(words)), F.lit(False))
    fit = F.when(F.col("location").isNotNull(), 2).otherwise(0) + F.when(named, 3).when(told, 1).otherwise(0)
    best = best_per(p.withColumn("fit", fit), ["book_id", "a", "b", "season"], [F.desc("fit"), F.desc("score"), "id"])
    return best.select("book_id", "a", "b", "season", "id", "fit", "score")


def narrative_unit_dossiers(spark: SparkSession, d: str) -> DataFrame:
    """Packets of narrative units: synopses of their chapters in order, their key events, a hash."""
    b = boundary_units(spark, d).select("book_id", "first_unit", "last_unit", "reason", F.explode(F.sequence("first_unit", "last_unit")).alias("unit"))
    told = b.join(unit_synopsis(spark, d).select("book_id", "unit", "synopsis", "n_events"), ["book_id", "unit"])
    keys = key_events_per_unit(spark, d).where("rank_no <= 3").groupBy("book_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "id"))), lambda x: x["id"]), ",").alias("keys"))
    g = told.join(keys, ["book_id", "unit"], "left").groupBy("book_id", "first_unit", "last_unit", "reason")
    row = F.array_sort(F.collect_list(F.struct("unit", "synopsis", "keys")))
    out = g.agg(F.sum("n_events").alias("n_events"), row.alias("r"))
    out = out.select("book_id", "first_unit", "last_unit", "reason", "n_events", F.array_join(F.transform("r", lambda x: x["synopsis"]), "\n").alias("synopses"), F.array_join(F.transform("r", lambda x: x["keys"]), ",").alias("key_events"))
    return out.withColumn("hash", content_hash("book_id", "first_unit", "last_unit", "synopses", "key_events"))


def merge_in_input_order(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of roles in the order of ids: a new one (of the editors) over an existing one; those of no role are dropped."""
    t = table(spark, d, "unified_roles").where("id is not null").dropDuplicates(["record_id"])
    source = F.lower(F.trim("record_source"))
    text = F.max(F.struct("updated_at", "record_id", "description"))["description"]
    new = t.where(source == "editor_desk").groupBy("id").agg(text.alias("new"))
    old = t.where(F.coalesce(source != "editor_desk", F.lit(True))).groupBy("id").agg(text.alias("old"))
    j = roles(spark, d).select("book_id", "id").join(new, "id", "left").join(old, "id", "left")
    return numbered(j, ["book_id"], F.length("id"), ["id"], "place").select("book_id", "place", "id", F.coalesce("new", "old").alias("description"))


QUERIES = {
    f.__name__: f
    for f in (
        prose_split, focused_score, shared_events, shared_events_spread, role_trajectory, season_beats, season_anchors, season_overview, character_arcs, conflict_chains, relation_profiles, entity_packets,
        union_candidates, insight_filter, roster_gallery, writer_references, oriented_pairs, segment_extraction, dossier_validation, regeneration_candidates, season_rollup, curated_relationships, narrative_unit_dossiers, merge_in_input_order,
    )
}
from sagaloom.plans.graph import _E  # noqa: E402
from sagaloom.plans.graph import SQL as _GRAPH  # noqa: E402
from sagaloom.plans.seasons import SQL as _SEASONS  # noqa: E402

_B = r"[\t-\r \x{85}\p{Z}]"
_HASH = lambda *c: "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '\\N')" for x in c) + "))"
_ISSUES = [
    ("no description", "coalesce(description, '') = ''"), ("short description", "length(description) BETWEEN 1 AND 11"), ("significance repeats description", "significance = description"),
    ("span", "p0 > p1"), ("no people", "len(people) = 0"), ("unit outside", "unit < 1"), ("no actions", "action_count <= 0"),
]
_IS = f"{SQL_EVENTS}, iss AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS issue FROM ev WHERE {c}" for n, c in _ISSUES) + ")"
_ANCHORS = f"""{_S}, an0 AS (SELECT * FROM s WHERE season IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, season, name ORDER BY score DESC, p0 NULLS LAST, id) = 1),
  an AS (SELECT book_id, season, id, name, row_number() OVER (PARTITION BY book_id, season ORDER BY score DESC, p0 NULLS LAST, id) AS rank_no FROM an0)"""
SQL = {
    "prose_split": f"""WITH {SQL_ROLES}, p AS (SELECT id, list_filter(list_transform(regexp_extract_all(description, '[^。！？；]*[。！？；]|[^。！？；]+'), lambda x: regexp_replace(x, '^{_B}+|{_B}+$', '', 'g')), lambda x: x <> '') AS l FROM role WHERE description IS NOT NULL)
        SELECT id, CAST(i - 1 AS INT) AS pos, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p)""",
    "focused_score": f"""WITH {_KEY}, {SQL_ROLES}, star AS (SELECT book_id, id AS star FROM role QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) = 1)
        SELECT k.id, CAST(score + CASE WHEN freq > 5 THEN -2 * least(freq - 5, 15) ELSE 0 END + CASE WHEN len(people) = 0 THEN -2 WHEN len(people) <= 2 THEN 4 WHEN len(people) <= 4 THEN 2 WHEN len(people) <= 6 THEN -4 WHEN len(people) <= 9 THEN -14 ELSE -28 END
          + {sql_lookup('event_type', TYPE_BONUS, 0)} + CASE WHEN list_contains(people, star) THEN 3 ELSE -3 END + CASE WHEN location <> '' THEN 1 ELSE 0 END AS BIGINT) AS focus FROM k LEFT JOIN star ON star.book_id = k.book_id""",
    "shared_events": f"""WITH {_SX}, p AS (SELECT *, 3 * {sql_lookup('event_type', TYPE_WEIGHTS, 1)} + CASE WHEN significance <> '' THEN 2 ELSE 0 END + CASE WHEN location IS NOT NULL THEN 1 ELSE 0 END + least(coalesce(action_count, 0), 3) AS sc FROM sx),
        t AS (SELECT *, row_number() OVER (PARTITION BY book_id, a, b ORDER BY sc DESC, unit NULLS LAST, id) AS r FROM p) SELECT book_id, a, b, id, sc AS s, row_number() OVER (PARTITION BY book_id, a, b ORDER BY unit NULLS LAST, id) AS by_time FROM t WHERE r <= 6""",
    "role_trajectory": f"""WITH {_SP}, l AS (SELECT book_id, role, id, location, p0, lag(location) OVER (PARTITION BY book_id, role ORDER BY p0 NULLS LAST, id) AS last FROM sp WHERE location IS NOT NULL) SELECT book_id, role, id, location, p0 FROM l WHERE last IS NULL OR last <> location""",
    "season_anchors": f"WITH {_ANCHORS} SELECT * FROM an WHERE rank_no <= 4",
    "season_overview": f"""WITH {_ANCHORS}, sp AS (SELECT s.*, unnest(people) AS role FROM s), b AS (SELECT book_id, season, count(*) AS n_events, count(DISTINCT location) AS n_places, count(*) FILTER (event_type = '冲突') AS conflicts FROM s WHERE season IS NOT NULL GROUP BY ALL),
        w AS (SELECT book_id, season, count(DISTINCT role) AS n_roles FROM sp GROUP BY ALL), g AS (SELECT book_id, season, string_agg(name, ',' ORDER BY rank_no) AS anchors FROM an WHERE rank_no <= 4 GROUP BY ALL)
        SELECT b.*, coalesce(n_roles, 0) AS n_roles, anchors FROM b LEFT JOIN w USING (book_id, season) LEFT JOIN g USING (book_id, season)""",
    "character_arcs": f"""WITH ro AS ({_SEASONS['roster_top24']}), ar AS ({_SEASONS['arc_top8']}), ed AS ({_GRAPH['pair_edges']}),
        e AS (SELECT book_id, role, points, string_agg(id, ',' ORDER BY by_time) AS events FROM ar JOIN ro USING (book_id, role) GROUP BY book_id, role, points), sd AS (SELECT book_id, a AS role, b AS other, weight FROM ed UNION ALL SELECT book_id, b, a, weight FROM ed),
        f AS (SELECT *, row_number() OVER (PARTITION BY book_id, role ORDER BY weight DESC, other) AS r FROM sd), c AS (SELECT book_id, role, string_agg(other, ',' ORDER BY r) AS counterparts FROM f WHERE r <= 4 GROUP BY ALL)
        SELECT e.*, counterparts FROM e LEFT JOIN c USING (book_id, role)""",
    "conflict_chains": f"""WITH te AS ({_SEASONS['tension_score']}), pc AS ({_SEASONS['phase_cap4']}), g AS (SELECT book_id, a, b, string_agg(label, '→' ORDER BY rank_no) AS phases FROM pc GROUP BY ALL) SELECT te.*, phases FROM te JOIN g USING (book_id, a, b) WHERE tension >= 5""",
    "relation_profiles": f"""WITH {_E}, {SQL_ROLES}, j AS (SELECT e.book_id, a, b, coalesce(x.canonical_name, x.id) AS name_a, coalesce(y.canonical_name, y.id) AS name_b, weight FROM edges e JOIN role x ON x.id = a AND x.book_id = e.book_id JOIN role y ON y.id = b AND y.book_id = e.book_id)
        SELECT *, {_HASH('name_a', 'name_b', 'weight')} AS hash FROM j""",
    "entity_packets": f"""WITH {_SP}, b AS (SELECT book_id, role, min(unit) AS first_unit, max(unit) AS last_unit, count(*) AS n FROM sp GROUP BY ALL), o AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY book_id, role, name ORDER BY score DESC, id) = 1),
        t AS (SELECT book_id, role, id, row_number() OVER (PARTITION BY book_id, role ORDER BY score DESC, id) AS r FROM o), g AS (SELECT book_id, role, string_agg(id, ',' ORDER BY r) AS best FROM t WHERE r <= 3 GROUP BY ALL), j AS (SELECT b.*, best FROM b JOIN g USING (book_id, role))
        SELECT *, {_HASH('role', 'first_unit', 'last_unit', 'best')} AS hash FROM j""",
    "union_candidates": f"""WITH {SQL_ROLES}, u AS (SELECT book_id, canonical_name AS name, 1 AS priority FROM role UNION ALL SELECT book_id, canonical_name, 2 FROM unified_roles WHERE id IS NULL UNION ALL SELECT book_id, unnest(list_transform(entities, lambda e: e.name)), 3 FROM chunk_extractions)
        SELECT book_id, name, min(priority) AS priority FROM u WHERE name <> '' AND book_id IS NOT NULL GROUP BY ALL""",
    "insight_filter": f"""WITH ar AS ({_SEASONS['arc_top8']}), {SQL_EVENTS}, i AS (SELECT id FROM ev WHERE {sql_overlaps('list_min(source_units)', 'list_max(source_units)', UNITS)} AND {sql_overlaps('p0', 'p1', PROGRESS)}) SELECT book_id, role, count(*) AS n FROM ar WHERE id IN (SELECT id FROM i) GROUP BY ALL""",
    "roster_gallery": f"WITH ro AS ({_SEASONS['roster_top24']}), {SQL_ROLES} SELECT ro.book_id, rank_no, ro.role, r.canonical_name, r.primary_power, length(r.description) AS chars FROM ro JOIN role r ON r.id = ro.role AND r.book_id = ro.book_id",
    "writer_references": f"""WITH ar AS ({_SEASONS['arc_top8']}), {_SP}, i AS (SELECT id FROM ev WHERE {sql_overlaps('list_min(source_units)', 'list_max(source_units)', (6, 8))}), q AS (SELECT book_id, role, min(unit) AS lo, max(unit) AS hi FROM sp GROUP BY ALL)
        SELECT book_id, 'arc' AS kind, role AS label FROM ar WHERE id IN (SELECT id FROM i) UNION SELECT book_id, 'arc', role FROM q WHERE {sql_overlaps('lo', 'hi', (6, 8))}""",
    "dossier_validation": f"WITH {_IS} SELECT * FROM iss",
    "regeneration_candidates": f"""WITH {_IS}, n AS (SELECT id, count(*) AS issues FROM iss GROUP BY id), t AS (SELECT book_id, n.id, issues, row_number() OVER (PARTITION BY book_id ORDER BY issues DESC, n.id) AS rank_no FROM n JOIN ev ON ev.id = n.id) SELECT * FROM t WHERE rank_no <= 20""",
    "curated_relationships": f"""WITH ed AS ({_GRAPH['pair_edges']}), {_SX}, cp AS (SELECT book_id, a, b FROM ed QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY weight DESC, a, b) <= 3),
        q AS (SELECT sx.*, CASE WHEN location IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN regexp_matches(name, '相逢|夜谈|论剑') THEN 3 WHEN regexp_matches(description, '相逢|夜谈|论剑') THEN 1 ELSE 0 END AS fit FROM sx JOIN cp USING (book_id, a, b) WHERE season IS NOT NULL)
        SELECT book_id, a, b, season, id, fit, score FROM q QUALIFY row_number() OVER (PARTITION BY book_id, a, b, season ORDER BY fit DESC, score DESC, id) = 1""",
    "merge_in_input_order": f"""WITH {SQL_ROLES}, t AS (SELECT DISTINCT id, record_id, updated_at, description, coalesce(lower(trim(record_source)) = 'editor_desk', false) AS fresh FROM unified_roles WHERE id IS NOT NULL),
        b AS (SELECT id, fresh, description FROM t QUALIFY row_number() OVER (PARTITION BY id, fresh ORDER BY updated_at DESC NULLS LAST, record_id DESC) = 1)
        SELECT r.book_id, row_number() OVER (PARTITION BY r.book_id ORDER BY r.id) AS place, r.id, coalesce(n.description, o.description) AS description FROM role r LEFT JOIN b n ON n.id = r.id AND n.fresh LEFT JOIN b o ON o.id = r.id AND NOT o.fresh""",
    "season_rollup": f"WITH {_S} SELECT book_id, season, unit, count(*) AS n, grouping_id(book_id, season, unit) AS level FROM s WHERE unit IS NOT NULL GROUP BY ROLLUP (book_id, season, unit)",
}
