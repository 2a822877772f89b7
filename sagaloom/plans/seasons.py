"""Queries per season and unit: ranges, densities, scores, key events, synopses, phases, boundaries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagaloom.functions.rules import FUNCTION_WORDS, PHASE_RULES, SQL_TEXT, SQL_TYPED, TYPE_WEIGHTS, event_text, event_type, first_best, hits, light_score, lookup, sql_first_best, sql_hits, sql_lookup
from sagaloom.operators.ranking import best_per, numbered, ranked, top_n, with_count, with_previous, with_stats
from sagaloom.session import cut
from sagaloom.sources.model import SEASON_UNITS, SQL_EVENTS, SQL_PAIRS, SQL_PEOPLE, SQL_ROLES, SQL_SEASON, events, in_people, locations, pairs_of, roles, season_of

#: Threads by name, words of the clues, words of the payoffs.
FORESHADOWING = [("失钥旧账", ["失钥", "钥匙"], ["旧账", "账册"])]


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Events with class, light score and season."""
    return events(spark, d).withColumn("event_type", event_type()).withColumn("score", light_score()).withColumn("season", season_of(F.col("unit")))


def season_ranges(spark: SparkSession, d: str) -> DataFrame:
    """First and last unit and progress of each season."""
    return scored(spark, d).where("season is not null").groupBy("book_id", "season").agg(F.min("unit").alias("unit_lo"), F.max("unit").alias("unit_hi"), F.min("p0").alias("p_lo"), F.max("p1").alias("p_hi"))


def season_role_density(spark: SparkSession, d: str) -> DataFrame:
    """3 per unit, 2 per event and 2 per counterpart of a role in a season."""
    s = scored(spark, d).where("season is not null")
    own = in_people(s).groupBy("book_id", "season", "role").agg(F.countDistinct("unit").alias("units"), F.count(F.lit(1)).alias("n_events"))
    both = F.explode(F.array(F.struct(F.col("a").alias("role"), F.col("b").alias("other")), F.struct(F.col("b").alias("role"), F.col("a").alias("other"))))
    rel = pairs_of(s).select("book_id", "season", both.alias("s")).groupBy("book_id", "season", F.col("s.role").alias("role")).agg(F.countDistinct("s.other").alias("relations"))
    j = own.join(rel, ["book_id", "season", "role"], "left").fillna(0, ["relations"])
    return j.withColumn("density", 3 * F.col("units") + 2 * F.col("n_events") + 2 * F.col("relations"))


def season_top_locations(spark: SparkSession, d: str) -> DataFrame:
    """The four places with most events of each season, with their distinct roles."""
    s = scored(spark, d).where("season is not null and location is not null")
    n = s.groupBy("book_id", "season", "location").agg(F.count(F.lit(1)).alias("n_events"))
    p = in_people(s).groupBy("book_id", "season", "location").agg(F.countDistinct("role").alias("n_roles"))
    j = n.join(p, ["book_id", "season", "location"], "left").fillna(0, ["n_roles"])
    return top_n(j, ["book_id", "season"], [F.desc("n_events"), "location"], 4)


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Configured roles (the book's ten most mentioned) per season: kept with an event there, dropped without."""
    wanted = top_n(roles(spark, d), ["book_id"], [F.desc_nulls_last("total_mentions"), "id"], 10).select("book_id", F.col("id").alias("role"))
    seasons = scored(spark, d).where("season is not null").select("book_id", "season").distinct()
    seen = in_people(scored(spark, d)).select("book_id", "season", "role").distinct().withColumn("kept", F.lit(True))
    return wanted.join(seasons, "book_id").join(seen, ["book_id", "season", "role"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def cross_season_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Names of events shared by two seasons of a book, and whether neighbours share more than one."""
    s = scored(spark, d).where("season is not null and name is not null").select("book_id", "season", "name").distinct()
    a, b = s.withColumnRenamed("season", "s1"), s.withColumnRenamed("season", "s2")
    j = a.join(b, ["book_id", "name"]).where("s1 < s2").groupBy("book_id", "s1", "s2").agg(F.count(F.lit(1)).alias("shared"))
    return j.withColumn("too_close", (F.col("s2") - F.col("s1") == 1) & (F.col("shared") > 1))


def role_spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last unit, appearances and seasons of each role."""
    p = in_people(scored(spark, d)).where("unit is not null")
    return p.groupBy("book_id", "role").agg(
        F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.countDistinct("unit").alias("n_units"), F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons")
    )


def event_light_score(spark: SparkSession, d: str) -> DataFrame:
    """Class and light score of every event."""
    return scored(spark, d).select("id", "event_type", "score")


def name_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Whole-book frequency of each event's name, its first unit, and whether the event is in it."""
    ev = with_stats(events(spark, d).select("book_id", "name", "id", "unit"), ["book_id", "name"], [F.count(F.lit(1)).alias("freq"), F.min("unit").alias("first_unit")], "id")
    return ev.select("id", "freq", "first_unit", (F.col("unit") == F.col("first_unit")).alias("is_first"))


def recurring_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Names of several events of a book."""
    return events(spark, d).groupBy("book_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("first_unit")).where("n > 1")


def key_scored(spark: SparkSession, d: str) -> DataFrame:
    """Light score, +1 for evidence, +2 for a rare name, less for a very frequent one; with tiers."""
    return with_tiers(scored(spark, d), events(spark, d))


def with_tiers(s: DataFrame, ev: DataFrame) -> DataFrame:
    """Scored events with freq, key_score and tier; ev: the same events, from which names are counted."""
    s = s.withColumn("_evidence", F.coalesce(F.col("description") != "", F.lit(False)).cast("int"))
    s = with_count(s, ["book_id", "name"], "id", "freq", ev)
    rare = F.when(F.col("freq") <= 1, 2).otherwise(0) - F.when(F.col("freq") > 8, F.least(F.col("freq") - 8, F.lit(10))).otherwise(0)
    s = s.withColumn("key_score", (F.col("score") + F.col("_evidence") + rare).cast("long")).drop("_evidence")
    return s.withColumn("tier", F.when(F.col("key_score") >= 10, "critical").when(F.col("key_score") >= 7, "major").otherwise("notable"))


def key_events_per_unit(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight key events per unit, one per name, with at least four points."""
    k = key_scored(spark, d).where("unit is not null and key_score >= 4")
    one = best_per(k, ["book_id", "unit", "name"], [F.desc("key_score"), "id"])
    return top_n(one, ["book_id", "unit"], [F.desc("key_score"), "id"], 8).select("book_id", "unit", "id", "key_score", "tier", "rank_no")


def unit_synopsis(spark: SparkSession, d: str) -> DataFrame:
    """Per unit: events, active roles by count, places, and a synopsis of the two best developments of 80 characters."""
    s = scored(spark, d).where("unit is not null")
    base = s.groupBy("book_id", "unit").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg(lookup(F.col("event_type"), TYPE_WEIGHTS, 1).cast("double")), 4).alias("tension"))
    active = top_n(in_people(s).groupBy("book_id", "unit", "role").agg(F.count(F.lit(1)).alias("n")), ["book_id", "unit"], [F.desc("n"), "role"], 5)
    active = active.groupBy("book_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "role"))), lambda x: x["role"]), ",").alias("active"))
    text = F.substring(F.coalesce(F.nullif("description", F.lit("")), F.nullif("significance", F.lit("")), F.col("name")), 1, 80)
    best = top_n(best_per(s, ["book_id", "unit", "name"], [F.desc("score"), "id"]), ["book_id", "unit"], [F.desc("score"), "id"], 2).withColumn("_t", text)
    told = best.groupBy("book_id", "unit").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "_t"))), lambda x: x["_t"]), "；"), 1, 220).alias("synopsis"))
    return base.join(active, ["book_id", "unit"], "left").join(told, ["book_id", "unit"], "left")


def narrative_function(spark: SparkSession, d: str) -> DataFrame:
    """Function of each unit by its place in the season, tension, and words of its events."""
    s = scored(spark, d).where("unit is not null")
    text = F.concat_ws(" ", "name", "description", "significance")
    per = s.withColumn("_x", text).groupBy("book_id", "unit", "season").agg(
        F.avg(lookup(F.col("event_type"), TYPE_WEIGHTS, 1).cast("double")).alias("tension"),
        *(F.max(F.coalesce(F.col("_x").contains(w), F.lit(False)).cast("int")).alias(f"_{g}_{n}") for g, (_, words) in enumerate(FUNCTION_WORDS) for n, w in enumerate(words)),
    )
    votes = [sum((F.col(f"_{g}_{n}") for n in range(1, len(words))), F.col(f"_{g}_0")) for g, (_, words) in enumerate(FUNCTION_WORDS)]
    place = (F.col("unit") - ((F.col("season") - 1) * SEASON_UNITS + 1)) / F.lit(float(SEASON_UNITS))
    default = F.when(place < 0.10, "开篇").when(place > 0.90, "收束").when((F.col("tension") >= 5.0) | (votes[1] >= 2), "高潮").otherwise("过渡")
    top = F.greatest(*votes)
    label = F.when(top >= 2, F.when(votes[0] == top, FUNCTION_WORDS[0][0]).when(votes[1] == top, FUNCTION_WORDS[1][0]).otherwise(FUNCTION_WORDS[2][0])).otherwise(default)
    return per.select("book_id", "unit", label.alias("function"))


def phases(spark: SparkSession, d: str) -> DataFrame:
    """Shared events of each pair in order, with the label of the phase; the first without keywords is 初识.

    Written to the shared folder once, as the queries below read it several times.
    """
    p = pairs_of(scored(spark, d))
    p = numbered(p, ["book_id", "a", "b"], F.col("p0"), [F.asc_nulls_last("unit"), "id"], "pos")
    found = first_best(event_text(), PHASE_RULES)
    return cut(p.withColumn("label", F.coalesce(found, F.when(F.col("pos") == 1, "初识"), F.col("event_type"))).select("book_id", "a", "b", "pos", "label", "id", "action_count"))


def first_phases(p: DataFrame) -> DataFrame:
    """Of phases, those that differ from the one before, the first four of each pair."""
    p = with_previous(p, ["book_id", "a", "b"], "pos", "label").where("_last is null or _last <> label")
    return top_n(p, ["book_id", "a", "b"], ["pos"], 4).select("book_id", "a", "b", "pos", "label", "rank_no")


def conflict_beats(p: DataFrame) -> DataFrame:
    """Of phases, those from one before the pair's first conflict to one after its last, else the first six; at most eight."""
    bad = F.when(F.col("label").isin("冲突", "对立"), F.col("pos"))
    p = with_stats(p, ["book_id", "a", "b"], [F.min(bad).alias("lo"), F.max(bad).alias("hi")], "id")
    seen = p.where(F.when(F.col("lo").isNotNull(), F.col("pos").between(F.col("lo") - 1, F.col("hi") + 1)).otherwise(F.col("pos") <= 6))
    return top_n(seen, ["book_id", "a", "b"], ["pos"], 8).select("book_id", "a", "b", "pos", "label", "rank_no")


def tensions(p: DataFrame) -> DataFrame:
    """Tension of each pair between 1 and 10 from its conflict beats and actions."""
    beats = conflict_beats(p).groupBy("book_id", "a", "b").agg(F.count(F.when(F.col("label").isin("冲突", "对立"), 1)).alias("beats"))
    acts = p.groupBy("book_id", "a", "b").agg(F.sum(F.coalesce("action_count", F.lit(0))).alias("actions"))
    return beats.join(acts, ["book_id", "a", "b"]).select("book_id", "a", "b", F.greatest(F.lit(1), F.least(F.lit(10), 2 * F.col("beats") + F.least("actions", F.lit(4)))).cast("long").alias("tension"))


def phase_cap4(spark: SparkSession, d: str) -> DataFrame:
    """Phases of each pair without repeats in a row, the first four."""
    return first_phases(phases(spark, d))


def conflict_window(spark: SparkSession, d: str) -> DataFrame:
    """Beats around the conflicts of each pair."""
    return conflict_beats(phases(spark, d))


def tension_score(spark: SparkSession, d: str) -> DataFrame:
    """Tension of each pair."""
    return tensions(phases(spark, d))


def arc_top8(spark: SparkSession, d: str) -> DataFrame:
    """The eight best events of each role, numbered by time again."""
    p = in_people(scored(spark, d)).select("book_id", "role", "id", "score", "p0")
    best = top_n(p, ["book_id", "role"], [F.desc("score"), F.coalesce(F.nullif("p0", F.lit(0)), F.lit(10**12)), "id"], 8)
    return ranked(best, ["book_id", "role"], [F.asc_nulls_last("p0"), "id"], "by_time").select("book_id", "role", "id", "rank_no", "by_time")


def excerpt_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Up to three texts of each third of a role's events; the third is counted over all events, not only those with text."""
    p = numbered(in_people(events(spark, d)), ["book_id", "role"], F.col("p0"), ["id"], "pos")
    p = with_stats(p, ["book_id", "role"], [F.count(F.lit(1)).alias("total")], "id")
    ratio = (F.col("pos") - 1) / (F.col("total") - 1.0)
    p = p.withColumn("bucket", F.when(F.col("total") <= 1, "early").when(ratio < 1 / 3, "early").when(ratio < 2 / 3, "middle").otherwise("late"))
    return top_n(p.where("description <> ''"), ["book_id", "role", "bucket"], ["pos"], 3).select("book_id", "role", "bucket", "id", "rank_no")


def near_best_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Per season: of the first five events within five points of the best, the one with the rarest name, then the best score."""
    k = with_stats(key_scored(spark, d).where("season is not null"), ["book_id", "season"], [F.max("score").alias("_best")], "id").where("score >= _best - 5")
    short = top_n(k, ["book_id", "season"], [F.desc("score"), F.asc_nulls_last("p0"), "id"], 5)
    return best_per(short, ["book_id", "season"], [F.desc((F.col("freq") <= 1).cast("int")), F.desc("score"), "rank_no"]).select("book_id", "season", "id", "score", "freq")


def spread_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One event per name and unit, then one per unit, then every second of a book's units."""
    one = best_per(scored(spark, d).where("unit is not null"), ["book_id", "name", "unit"], [F.desc("score"), "id"])
    one = best_per(one, ["book_id", "unit"], [F.desc("score"), "id"])
    return ranked(one, ["book_id"], ["unit"], "pos").where((F.col("pos") - 1) % 2 == 0).select("book_id", "unit", "id", "pos")


def foreshadow_match(spark: SparkSession, d: str) -> DataFrame:
    """Clues (失钥) and payoffs (旧账): relevance by where the words stand and how many take part; names only, one clue a
    book, and payoffs from that clue's unit on, as its SQL has it. The whole threads are in foreshadow_threads."""

    def relevance(words: list[str]):
        by = 5 * hits(F.col("name"), words) + 3 * hits(F.col("significance"), words) + hits(F.col("description"), words)
        return by + F.when(F.col("event_type").isin("揭示", "立势", "冲突", "会见"), 2).otherwise(0) + F.when(F.size("people").between(2, 4), 2).when(F.size("people") > 6, -3).otherwise(0)

    s = scored(spark, d).where("unit is not null")
    clue = s.where(hits(F.col("name"), ["失钥", "钥匙"]) > 0).select("book_id", F.col("id").alias("clue_id"), F.col("unit").alias("clue_unit"), relevance(["失钥", "钥匙"]).alias("clue_score"))
    pay = s.where(hits(F.col("name"), ["旧账", "账册"]) > 0).select("book_id", F.col("id").alias("payoff_id"), F.col("unit").alias("payoff_unit"), relevance(["旧账", "账册"]).alias("payoff_score"))
    first = best_per(clue, ["book_id"], [F.desc("clue_score"), "clue_unit", "clue_id"])
    return top_n(pay.join(first, "book_id").where("payoff_unit >= clue_unit"), ["book_id"], [F.desc("payoff_score"), "payoff_unit", "payoff_id"], 3)


def foreshadow_threads(spark: SparkSession, d: str, patterns: list[tuple[str, list[str], list[str]]] = FORESHADOWING, most: int = 5) -> DataFrame:
    """Clues and payoffs of each pattern in a book, up to five of each spread over the units, in the order of time.

    The words may stand in name, description, significance or place. A payoff's unit is not before the first clue's; events
    without a unit pass. A thread needs both sides.
    """
    place = locations(spark, d).select(F.col("id").alias("location"), F.col("canonical_name").alias("place"))
    s = scored(spark, d).join(place, "location", "left").withColumn("place", F.coalesce("place", "location"))
    types = reduce(lambda a, b: a + b, [F.coalesce(F.col("event_type").contains(t).cast("int"), F.lit(0)) for t in ["揭示", "立势", "转折", "冲突", "会见", "别离"]])
    company = F.when(F.size("people").between(1, 4), 2).when(F.size("people") > 10, -3).otherwise(0)

    def side(thread: str, kind: str, words: list[str]) -> Column:
        here = hits(F.col("name"), words) + hits(F.col("description"), words) + hits(F.col("significance"), words) + hits(F.col("place"), words)
        by = 5 * hits(F.col("name"), words) + 3 * hits(F.col("significance"), words) + hits(F.col("description"), words)
        return F.when(here > 0, F.struct(F.lit(thread).alias("thread"), F.lit(kind).alias("side"), (by + 2 * types + company).alias("relevance")))

    sides = F.array(*(side(t, kind, words) for t, clue, payoff in patterns for kind, words in (("clue", clue), ("payoff", payoff))))
    e = s.select("book_id", "id", "name", "unit", "p0", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x")).select("book_id", "id", "name", "unit", "p0", "x.*")
    thread, each = ["book_id", "thread"], ["book_id", "thread", "side"]
    late = F.coalesce(F.nullif("p0", F.lit(0)), F.lit(10**12)), F.coalesce(F.nullif("unit", F.lit(0)), F.lit(10**12))
    order = [F.desc("relevance"), *late, "id"]
    one = best_per(e, [*each, "name", "unit"], order)
    # which units are taken is found on one row per unit
    in_thread, in_side = Window.partitionBy(*thread), Window.partitionBy(*each)
    u = one.groupBy(*each, "unit").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.min(F.when(F.col("side") == "clue", F.col("unit"))).over(in_thread))
    u = u.where("side = 'clue' or unit is null or _first is null or unit >= _first").withColumn("_unit", F.coalesce("unit", F.lit(0)))
    u = u.withColumn("_sides", F.size(F.collect_set("side").over(in_thread))).withColumn("_all", F.sum("_n").over(in_side))
    u = u.withColumn("_pos", F.dense_rank().over(in_side.orderBy("_unit"))).withColumn("_units", F.max("_pos").over(in_side))
    step = F.greatest(F.lit(1), F.when(F.col("_units") > most, F.floor(F.col("_units") / most)))
    u = u.where("_sides = 2").where((F.col("_all") <= most) | ((F.col("_pos") - 1) % step == 0) & (F.floor((F.col("_pos") - 1) / step) < most))
    u = u.select(F.struct(*each, "unit").alias("_k"), "_unit", "_all")
    kept = ranked(one.withColumn("_k", F.struct(*each, "unit")).join(u, "_k"), [*each, "_unit"], order, "_best").where((F.col("_all") <= most) | (F.col("_best") == 1))
    return ranked(kept.select(*each, "id", "unit", "p0", "relevance"), each, [*late, "id"], "pos")


def jaccard_adjacent_units(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each unit's roles and places to those of the next; two empty sets are alike."""
    s = scored(spark, d).where("unit is not null")
    none = F.array().cast("array<string>")
    u = s.groupBy("book_id", "unit").agg(F.array_sort(F.collect_set("location")).alias("where_"))
    u = u.join(in_people(s).groupBy("book_id", "unit").agg(F.array_sort(F.collect_set("role")).alias("who")), ["book_id", "unit"], "left").withColumn("who", F.coalesce("who", none))
    w = Window.partitionBy("book_id").orderBy("unit")
    u = u.withColumn("next_unit", F.lead("unit").over(w)).withColumn("next_who", F.coalesce(F.lead("who").over(w), none)).withColumn("next_where", F.coalesce(F.lead("where_").over(w), none))

    def alike(a: str, b: str):
        both = F.size(F.array_union(a, b))
        return F.when(both == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / both, 6))

    return u.where("next_unit is not null").select("book_id", "unit", "next_unit", alike("who", "next_who").alias("role_likeness"), alike("where_", "next_where").alias("place_likeness"))


def boundary_units(spark: SparkSession, d: str) -> DataFrame:
    """Narrative units: chapters of a season merged forward while at least two of four signals hold, up to four chapters.

    Each step depends on the group so far, so a season's chapters, bounded by its length, are folded in order.
    """
    s = scored(spark, d).where("unit is not null")
    u = s.groupBy("book_id", "season", "unit").agg(
        F.array_sort(F.collect_set("location")).alias("places"),
        F.array_sort(F.collect_set("name")).alias("names"), F.min("p0").alias("p0"), F.max("p1").alias("p1"),
    )
    who = in_people(s).groupBy("book_id", "season", "unit").agg(F.array_sort(F.collect_set("role")).alias("who"))
    u = u.join(who, ["book_id", "season", "unit"], "left").withColumn("who", F.coalesce("who", F.array().cast("array<string>")))

    def like(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a | b else 1.0

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group, reason = [], None, "season_start"
        rows = pdf.sort_values("unit").itertuples()

        def close(g):
            out.append((int(pdf.book_id.iloc[0]), int(pdf.season.iloc[0]), g["units"][0], g["units"][-1], len(g["units"]), g["reason"]))

        for r in rows:
            who, places, names = set(r.who), set(r.places), set(r.names)
            if group is not None:
                gap = 0 if pd.isna(group["p1"]) or pd.isna(r.p0) or not group["p1"] or not r.p0 else r.p0 - group["p1"]
                signs = [like(group["who"], who) >= 0.3, like(group["places"], places) >= 0.2, bool(group["names"] & names), gap <= 1]
                if sum(signs) >= 2 and len(group["units"]) < 4:
                    group["units"].append(int(r.unit))
                    group["who"] |= who
                    group["places"] |= places
                    group["names"] |= names
                    group["p1"] = max(x for x in (group["p1"], r.p1, 0) if not pd.isna(x))
                    continue
                close(group)
                reason = "span_limit" if len(group["units"]) >= 4 else "signals:" + str(sum(signs))
            group = {"units": [int(r.unit)], "who": who, "places": places, "names": names, "p1": r.p1, "reason": reason}
        if group is not None:
            close(group)
        return pd.DataFrame(out, columns=["book_id", "season", "first_unit", "last_unit", "span", "reason"])

    return u.groupBy("book_id", "season").applyInPandas(fold, "book_id long, season int, first_unit int, last_unit int, span int, reason string")


def boundary_validate(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the boundaries: spans over four, overlaps, and gaps within a season (none are expected)."""
    w = Window.partitionBy("book_id", "season").orderBy("first_unit")
    b = boundary_units(spark, d).withColumn("_end", F.lag("last_unit").over(w))
    known = scored(spark, d).where("unit is not null").select("book_id", F.col("unit")).distinct()
    skipped = b.where("_end is not null").join(known, "book_id").where("unit > _end and unit < first_unit").groupBy("book_id", "season", "first_unit").agg(F.count(F.lit(1)).alias("n"))
    bad = b.select("book_id", "season", "first_unit", F.when(F.col("span") > 4, "span").when(F.col("_end") >= F.col("first_unit"), "overlap").alias("problem")).where("problem is not null")
    return bad.union(skipped.select("book_id", "season", "first_unit", F.lit("gap")))


def turning_points(spark: SparkSession, d: str) -> DataFrame:
    """Five events of each role: the best of each third, then the best left, each name once, numbered by time.

    A name taken blocks later choices, so a role's candidates, cut to the best forty beforehand by name, are folded in order.
    """
    p = numbered(in_people(scored(spark, d)), ["book_id", "role"], F.col("p0"), ["id"], "pos")
    p = with_stats(p, ["book_id", "role"], [F.count(F.lit(1)).alias("total")], "id")
    third = F.least(F.lit(2), F.floor(3 * (F.col("pos") - 1) / F.greatest(F.col("total") - 1, F.lit(1)))).cast("int")
    p = p.withColumn("third", F.when(F.col("total") <= 1, 0).otherwise(third))
    one = best_per(p, ["book_id", "role", "third", "name"], [F.desc("score"), "pos"])
    few = top_n(one, ["book_id", "role", "third"], [F.desc("score"), "pos"], 13).select("book_id", "role", "id", "name", "score", "pos", "third")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "pos"], ascending=[False, True])
        picked, names = [], set()
        for k in (0, 1, 2):
            for r in pdf[pdf.third == k].itertuples():
                if r.name not in names:
                    picked.append(r.Index)
                    names.add(r.name)
                    break
        for r in pdf.itertuples():
            if len(picked) >= 5:
                break
            if r.Index not in picked and r.name not in names:
                picked.append(r.Index)
                names.add(r.name)
        out = pdf.loc[picked].sort_values("pos")
        return out.assign(by_time=range(1, len(out) + 1))[["book_id", "role", "id", "third", "by_time"]]

    return few.groupBy("book_id", "role").applyInPandas(fold, "book_id long, role string, id string, third int, by_time int")


def roster_top24(spark: SparkSession, d: str) -> DataFrame:
    """The 24 roles of each book with most points: participations, key events, distinct counterparts, mentions."""
    base = in_people(key_scored(spark, d)).groupBy("book_id", "role").agg(
        (F.count(F.lit(1)) * 3).alias("x"), (F.count(F.when(F.col("tier") == "critical", 1)) * 10 + F.count(F.when(F.col("tier") == "major", 1)) * 5).alias("y")
    )
    pts = base.select("book_id", "role", (F.col("x") + F.col("y")).cast("double").alias("p"))
    both = F.explode(F.array(F.struct(F.col("a").alias("role"), F.col("b").alias("other")), F.struct(F.col("b").alias("role"), F.col("a").alias("other"))))
    rel = pairs_of(events(spark, d)).select("book_id", both.alias("s")).groupBy("book_id", F.col("s.role").alias("role")).agg(F.countDistinct("s.other").cast("double").alias("p"))
    r = roles(spark, d)
    told = r.select("book_id", F.col("id").alias("role"), (0.1 * F.coalesce("total_mentions", F.lit(0))).alias("p"))
    total = pts.union(rel).union(told).groupBy("book_id", "role").agg(F.round(F.sum("p"), 4).alias("points"))
    return top_n(total.join(r.select("book_id", F.col("id").alias("role")), ["book_id", "role"], "left_semi"), ["book_id"], [F.desc("points"), "role"], 24)


_S = f"{SQL_EVENTS}, {SQL_TYPED}, s AS (SELECT *, {SQL_SEASON.format('unit')} AS season FROM scored)"
_SP = f"{_S}, sp AS (SELECT s.*, unnest(people) AS role FROM s)"
_SX = f"{_SP}, sx AS (SELECT x.*, x.role AS a, y.role AS b FROM sp x JOIN sp y ON x.id = y.id AND x.role < y.role)"
_KEY = f"""{_S}, k0 AS (SELECT *, count(*) OVER (PARTITION BY book_id, name) AS freq FROM s), k1 AS (SELECT *, score + CASE WHEN description <> '' THEN 1 ELSE 0 END + CASE WHEN freq <= 1 THEN 2 ELSE 0 END
  - CASE WHEN freq > 8 THEN least(freq - 8, 10) ELSE 0 END AS key_score FROM k0), k AS (SELECT *, CASE WHEN key_score >= 10 THEN 'critical' WHEN key_score >= 7 THEN 'major' ELSE 'notable' END AS tier FROM k1)"""
_PH = f"""{_SX}, ph AS (SELECT book_id, a, b, id, p0, event_type, action_count, score, row_number() OVER w AS pos,
  coalesce({sql_first_best(SQL_TEXT, PHASE_RULES)}, CASE WHEN row_number() OVER w = 1 THEN '初识' END, event_type) AS label FROM sx WINDOW w AS (PARTITION BY book_id, a, b ORDER BY p0 NULLS LAST, unit NULLS LAST, id))"""
_CW = f"""{_PH}, c0 AS (SELECT *, min(pos) FILTER (label IN ('冲突', '对立')) OVER (PARTITION BY book_id, a, b) AS lo, max(pos) FILTER (label IN ('冲突', '对立')) OVER (PARTITION BY book_id, a, b) AS hi FROM ph),
  c1 AS (SELECT book_id, a, b, pos, label, row_number() OVER (PARTITION BY book_id, a, b ORDER BY pos) AS rank_no FROM c0 WHERE CASE WHEN lo IS NOT NULL THEN pos BETWEEN lo - 1 AND hi + 1 ELSE pos <= 6 END), cw AS (SELECT * FROM c1 WHERE rank_no <= 8)"""
_WEIGHT = sql_lookup("event_type", TYPE_WEIGHTS, 1)
_VOTES = ["(" + " + ".join(f"max(CAST(contains(x, '{w}') AS INT))" for w in words) + ")" for _, words in FUNCTION_WORDS]
_REL = lambda words: f"(5 * {sql_hits('name', words)} + 3 * {sql_hits('significance', words)} + {sql_hits('description', words)} + CASE WHEN event_type IN ('揭示', '立势', '冲突', '会见') THEN 2 ELSE 0 END + CASE WHEN len(people) BETWEEN 2 AND 4 THEN 2 WHEN len(people) > 6 THEN -3 ELSE 0 END)"
_ALIKE = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 6) END"
QUERIES = {
    f.__name__: f
    for f in (
        season_ranges, season_role_density, season_top_locations, evidence_gate, cross_season_overlap, role_spans, event_light_score, name_frequency, recurring_patterns, key_events_per_unit,
        unit_synopsis, narrative_function, phase_cap4, conflict_window, tension_score, arc_top8, excerpt_buckets, near_best_shortlist, spread_dedup, foreshadow_match, foreshadow_threads, jaccard_adjacent_units,
        boundary_units, boundary_validate, turning_points, roster_top24,
    )
}
SQL = {
    "season_ranges": f"WITH {_S} SELECT book_id, season, min(unit) AS unit_lo, max(unit) AS unit_hi, min(p0) AS p_lo, max(p1) AS p_hi FROM s WHERE season IS NOT NULL GROUP BY ALL",
    "season_role_density": f"""WITH {_SP}, own AS (SELECT book_id, season, role, count(DISTINCT unit) AS units, count(*) AS n_events FROM sp WHERE season IS NOT NULL GROUP BY ALL),
        rel AS (SELECT x.book_id, x.season, x.role, count(DISTINCT y.role) AS relations FROM sp x JOIN sp y ON x.id = y.id AND x.role <> y.role GROUP BY ALL)
        SELECT own.*, coalesce(relations, 0) AS relations, 3 * units + 2 * n_events + 2 * coalesce(relations, 0) AS density FROM own LEFT JOIN rel USING (book_id, season, role)""",
    "season_top_locations": f"""WITH {_SP}, n AS (SELECT book_id, season, location, count(*) AS n_events FROM s WHERE season IS NOT NULL AND location IS NOT NULL GROUP BY ALL),
        p AS (SELECT book_id, season, location, count(DISTINCT role) AS n_roles FROM sp GROUP BY ALL),
        t AS (SELECT n.*, coalesce(n_roles, 0) AS n_roles, row_number() OVER (PARTITION BY n.book_id, n.season ORDER BY n_events DESC, n.location) AS rank_no FROM n LEFT JOIN p USING (book_id, season, location)) SELECT * FROM t WHERE rank_no <= 4""",
    "evidence_gate": f"""WITH {_SP}, {SQL_ROLES}, w AS (SELECT book_id, id FROM role QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) <= 10),
        q AS (SELECT DISTINCT book_id, season FROM s WHERE season IS NOT NULL) SELECT w.book_id, q.season, w.id AS role, EXISTS (SELECT 1 FROM sp WHERE sp.book_id = w.book_id AND sp.season = q.season AND sp.role = w.id) AS kept FROM w JOIN q ON q.book_id = w.book_id""",
    "cross_season_overlap": f"""WITH {_S}, n AS (SELECT DISTINCT book_id, season, name FROM s WHERE season IS NOT NULL AND name IS NOT NULL)
        SELECT x.book_id, x.season AS s1, y.season AS s2, count(*) AS shared, (y.season - x.season = 1 AND count(*) > 1) AS too_close FROM n x JOIN n y ON x.book_id = y.book_id AND x.name = y.name AND x.season < y.season GROUP BY x.book_id, x.season, y.season""",
    "role_spans": f"WITH {_SP} SELECT book_id, role, min(unit) AS first_unit, max(unit) AS last_unit, count(DISTINCT unit) AS n_units, array_to_string(list_sort(list_distinct(list(season))), ',') AS seasons FROM sp WHERE unit IS NOT NULL GROUP BY ALL",
    "event_light_score": f"WITH {_S} SELECT id, event_type, score FROM s",
    "name_frequency": f"WITH {SQL_EVENTS} SELECT id, count(*) OVER w AS freq, min(unit) OVER w AS first_unit, unit = min(unit) OVER w AS is_first FROM ev WINDOW w AS (PARTITION BY book_id, name)",
    "recurring_patterns": f"WITH {SQL_EVENTS} SELECT book_id, name, count(*) AS n, min(unit) AS first_unit FROM ev GROUP BY ALL HAVING count(*) > 1",
    "key_events_per_unit": f"""WITH {_KEY}, o AS (SELECT * FROM k WHERE unit IS NOT NULL AND key_score >= 4 QUALIFY row_number() OVER (PARTITION BY book_id, unit, name ORDER BY key_score DESC, id) = 1),
        t AS (SELECT book_id, unit, id, key_score, tier, row_number() OVER (PARTITION BY book_id, unit ORDER BY key_score DESC, id) AS rank_no FROM o) SELECT * FROM t WHERE rank_no <= 8""",
    "unit_synopsis": f"""WITH {_SP}, base AS (SELECT book_id, unit, count(*) AS n_events, round(avg({_WEIGHT}), 4) AS tension FROM s WHERE unit IS NOT NULL GROUP BY ALL),
        a0 AS (SELECT book_id, unit, role, count(*) AS n FROM sp WHERE unit IS NOT NULL GROUP BY ALL), a1 AS (SELECT *, row_number() OVER (PARTITION BY book_id, unit ORDER BY n DESC, role) AS r FROM a0),
        act AS (SELECT book_id, unit, string_agg(role, ',' ORDER BY r) AS active FROM a1 WHERE r <= 5 GROUP BY ALL),
        b0 AS (SELECT *, substring(coalesce(nullif(description, ''), nullif(significance, ''), name), 1, 80) AS t FROM s WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, unit, name ORDER BY score DESC, id) = 1),
        b1 AS (SELECT *, row_number() OVER (PARTITION BY book_id, unit ORDER BY score DESC, id) AS r FROM b0), told AS (SELECT book_id, unit, substring(string_agg(t, '；' ORDER BY r), 1, 220) AS synopsis FROM b1 WHERE r <= 2 GROUP BY ALL)
        SELECT base.*, active, synopsis FROM base LEFT JOIN act USING (book_id, unit) LEFT JOIN told USING (book_id, unit)""",
    "narrative_function": f"""WITH {_S}, x AS (SELECT *, concat_ws(' ', name, description, significance) AS x FROM s WHERE unit IS NOT NULL),
        v AS (SELECT book_id, unit, season, avg({_WEIGHT}) AS tension, {_VOTES[0]} AS v0, {_VOTES[1]} AS v1, {_VOTES[2]} AS v2, (unit - ((season - 1) * {SEASON_UNITS} + 1)) / {SEASON_UNITS}.0 AS place FROM x GROUP BY book_id, unit, season)
        SELECT book_id, unit, CASE WHEN greatest(v0, v1, v2) >= 2 THEN CASE greatest(v0, v1, v2) WHEN v0 THEN '开篇' WHEN v1 THEN '高潮' ELSE '收束' END WHEN place < 0.10 THEN '开篇' WHEN place > 0.90 THEN '收束' WHEN tension >= 5 OR v1 >= 2 THEN '高潮' ELSE '过渡' END AS function FROM v""",
    "phase_cap4": f"""WITH {_PH}, l AS (SELECT *, lag(label) OVER (PARTITION BY book_id, a, b ORDER BY pos) AS last FROM ph),
        t AS (SELECT book_id, a, b, pos, label, row_number() OVER (PARTITION BY book_id, a, b ORDER BY pos) AS rank_no FROM l WHERE last IS NULL OR last <> label) SELECT * FROM t WHERE rank_no <= 4""",
    "conflict_window": f"WITH {_CW} SELECT * FROM cw",
    "tension_score": f"""WITH {_CW}, bt AS (SELECT book_id, a, b, count(*) FILTER (label IN ('冲突', '对立')) AS beats FROM cw GROUP BY ALL), ac AS (SELECT book_id, a, b, sum(coalesce(action_count, 0)) AS actions FROM ph GROUP BY ALL)
        SELECT book_id, a, b, CAST(greatest(1, least(10, 2 * beats + least(actions, 4))) AS BIGINT) AS tension FROM bt JOIN ac USING (book_id, a, b)""",
    "arc_top8": f"""WITH {_SP}, t AS (SELECT book_id, role, id, p0, row_number() OVER (PARTITION BY book_id, role ORDER BY score DESC, coalesce(nullif(p0, 0), 1000000000000), id) AS rank_no FROM sp)
        SELECT book_id, role, id, rank_no, row_number() OVER (PARTITION BY book_id, role ORDER BY p0 NULLS LAST, id) AS by_time FROM t WHERE rank_no <= 8""",
    "excerpt_buckets": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, p AS (SELECT *, row_number() OVER (PARTITION BY book_id, role ORDER BY p0 NULLS LAST, id) AS pos, count(*) OVER (PARTITION BY book_id, role) AS total FROM ep),
        q AS (SELECT *, CASE WHEN total <= 1 OR (pos - 1) / (total - 1.0) < 1 / 3 THEN 'early' WHEN (pos - 1) / (total - 1.0) < 2 / 3 THEN 'middle' ELSE 'late' END AS bucket FROM p),
        t AS (SELECT book_id, role, bucket, id, row_number() OVER (PARTITION BY book_id, role, bucket ORDER BY pos) AS rank_no FROM q WHERE description <> '') SELECT * FROM t WHERE rank_no <= 3""",
    "near_best_shortlist": f"""WITH {_KEY}, b AS (SELECT *, max(score) OVER (PARTITION BY book_id, season) AS best FROM k WHERE season IS NOT NULL),
        t AS (SELECT *, row_number() OVER (PARTITION BY book_id, season ORDER BY score DESC, p0 NULLS LAST, id) AS r FROM b WHERE score >= best - 5)
        SELECT book_id, season, id, score, freq FROM t WHERE r <= 5 QUALIFY row_number() OVER (PARTITION BY book_id, season ORDER BY CAST(freq <= 1 AS INT) DESC, score DESC, r) = 1""",
    "spread_dedup": f"""WITH {_S}, o AS (SELECT * FROM s WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, name, unit ORDER BY score DESC, id) = 1),
        p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY book_id, unit ORDER BY score DESC, id) = 1), t AS (SELECT book_id, unit, id, row_number() OVER (PARTITION BY book_id ORDER BY unit) AS pos FROM p) SELECT * FROM t WHERE (pos - 1) % 2 = 0""",
    "foreshadow_match": f"""WITH {_S}, c AS (SELECT book_id, id AS clue_id, unit AS clue_unit, {_REL(['失钥', '钥匙'])} AS clue_score FROM s WHERE unit IS NOT NULL AND {sql_hits('name', ['失钥', '钥匙'])} > 0),
        p AS (SELECT book_id, id AS payoff_id, unit AS payoff_unit, {_REL(['旧账', '账册'])} AS payoff_score FROM s WHERE unit IS NOT NULL AND {sql_hits('name', ['旧账', '账册'])} > 0),
        f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY clue_score DESC, clue_unit, clue_id) = 1),
        t AS (SELECT p.*, clue_id, clue_unit, clue_score, row_number() OVER (PARTITION BY p.book_id ORDER BY payoff_score DESC, payoff_unit, payoff_id) AS rank_no FROM p JOIN f ON f.book_id = p.book_id WHERE payoff_unit >= clue_unit) SELECT * FROM t WHERE rank_no <= 3""",
    "jaccard_adjacent_units": f"""WITH {_S}, u AS (SELECT book_id, unit, list_distinct(flatten(list(people))) AS w, coalesce(list_distinct(list(location) FILTER (location IS NOT NULL)), []) AS l FROM s WHERE unit IS NOT NULL GROUP BY ALL),
        n AS (SELECT *, lead(unit) OVER o AS next_unit, lead(w) OVER o AS w2, lead(l) OVER o AS l2 FROM u WINDOW o AS (PARTITION BY book_id ORDER BY unit))
        SELECT book_id, unit, next_unit, {_ALIKE.format('w', 'w2')} AS role_likeness, {_ALIKE.format('l', 'l2')} AS place_likeness FROM n WHERE next_unit IS NOT NULL""",
    "roster_top24": f"""WITH {_KEY}, kp AS (SELECT k.*, unnest(people) AS role FROM k), {SQL_ROLES}, x AS (
          SELECT book_id, role, CAST(count(*) * 3 + count(*) FILTER (tier = 'critical') * 10 + count(*) FILTER (tier = 'major') * 5 AS DOUBLE) AS p FROM kp GROUP BY ALL
          UNION ALL SELECT x.book_id, x.role, count(DISTINCT y.role) FROM kp x JOIN kp y ON x.id = y.id AND x.role <> y.role GROUP BY ALL
          UNION ALL SELECT book_id, id, 0.1 * coalesce(total_mentions, 0) FROM role),
        y AS (SELECT book_id, role, round(sum(p), 4) AS points FROM x WHERE (book_id, role) IN (SELECT (book_id, id) FROM role) GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY points DESC, role) AS rank_no FROM y) SELECT * FROM t WHERE rank_no <= 24""",
}
