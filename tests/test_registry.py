"""Folds and checks on made-up rows that reach the branches the test tables leave out."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagaloom.operators.dictionary import match_names
from sagaloom.plans import audits, graph, registry, seasons
from tests import brute

EVENT = "book_id long, id string, name string, description string, location string, unit int, people array<string>"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 6)), min_size=1, max_size=60), st.integers(2, 4))
def test_capped_links_like_the_fold(spark, pairs, cap):
    found = {(min(a, b), max(a, b)): s for a, b, s in pairs if a != b}
    rows = [dict(book_id=k % 2, a=f"n{a}", b=f"n{b}", edge_score=float(s)) for k in (0, 1) for (a, b), s in found.items()]
    if not rows:
        return
    got = graph.capped_links(spark.createDataFrame([(r["book_id"], r["a"], r["b"], r["edge_score"]) for r in rows], "book_id long, a string, b string, edge_score double"), 0.6, cap)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r.values()) for r in brute.capped(rows, 0.6, cap))


def test_dictionary_beyond_the_broadcast(spark):
    names = spark.createDataFrame([(1, "阿良", "r1", "role"), (1, "良城", "p1", "place"), (2, "甲乙", "r3", "role"), (None, "x", "r4", "role")], "b long, alias string, entity string, kind string")
    texts = spark.createDataFrame([(1, 10, 0, "阿良城里。"), (1, 10, 0, "阿良城里。"), (2, 11, 3, "阿良甲乙"), (3, 12, 0, "阿良"), (1, 13, 0, None), (1, 14, 0, "")], "b long, k long, pos int, text string")
    want = {(1, 10, 0, 0, "阿良", "r1", "role"), (1, 10, 0, 1, "良城", "p1", "place"), (2, 11, 3, 2, "甲乙", "r3", "role")}
    for most in (1 << 20, 0):
        got = match_names(texts, names, "b", "k", ("pos",), most_bytes=most)
        assert {tuple(r) for r in got.collect()} == want and got.count() == 3
    assert match_names(texts, names.limit(0), "b", "k").count() == 0 and match_names(texts.limit(0), names, "b", "k", most_bytes=0).count() == 0


def test_broken_boundaries(spark, monkeypatch):
    rows = [(1, 1, 1, 3, 3), (1, 1, 3, 8, 6), (1, 1, 10, 11, 2), (1, 2, 12, 12, 1)]
    monkeypatch.setattr(seasons, "boundary_units", lambda *_: spark.createDataFrame(rows, "book_id long, season int, first_unit int, last_unit int, span int"))
    monkeypatch.setattr(seasons, "scored", lambda *_: spark.createDataFrame([(1, u) for u in range(1, 13)], "book_id long, unit int"))
    assert {tuple(r) for r in seasons.boundary_validate(spark, "").collect()} == {(1, 1, 3, "span"), (1, 1, 10, "gap")}


def test_checks_that_the_tables_pass(spark, monkeypatch):
    long = "城里的灯早就被人换过，没有人知道是谁换的，也没有人去问。"
    ev = spark.createDataFrame([(1, "a", "灯", long, "p", 1, ["r1"]), (1, "b", "灯", long[:-1] + "！", "p", 2, ["r1", "r2"]), (1, "c", "灯", "另一回事。", None, 3, []), (2, "d", "灯", long, None, 1, [])], EVENT)
    loc = spark.createDataFrame([("p", ["a", "gone", ""])], "id string, associated_events array<string>")
    for module in (audits, graph):
        monkeypatch.setattr(module, "events", lambda *_: ev)
    monkeypatch.setattr(audits, "locations", lambda *_: loc)
    monkeypatch.setattr(graph, "roles", lambda *_: spark.createDataFrame([("r1", 1), ("r3", 1)], "id string, book_id long"))
    assert {(r.id, r.event_id) for r in audits.missing_event_ids(spark, "").collect()} == {("p", "gone")}
    assert [r.id for r in audits.sequence_likeness(spark, "").collect()] == ["b"]
    assert [r.id for r in graph.graph_isolated_roles(spark, "").collect()] == ["r3"]


def test_allow_list_and_decisions(spark):
    allowed = registry.allow_list([" 守夜人 ", {"name": "老船夫", "resolution": "merge_to_canonical", "canonical_target": "船夫"}, {"name": "上人", "resolution": "odd", "canonical_target": "x"}, {"resolution": "keep_as_canonical"}, ""])
    assert allowed == {"守夜人": None, "老船夫": "船夫", "上人": None}
    known = spark.createDataFrame([(1, "甲一", ["阿甲", "少年"]), (1, "阿甲", None), (2, "乙", ["阿甲"])], "book_id long, canonical_name string, all_names array<string>")
    names = spark.createDataFrame([(1, n) for n in ("守夜人", "老船夫", "甲一", "阿甲", "少年", "那个少年", "丙", " ")] + [(2, "阿甲")], "book_id long, name string")
    got = {(r.book_id, r.name): (r.decision, r.target) for r in registry.decisions(names, known, allowed).collect()}
    assert got == {
        (1, "守夜人"): ("keep", None), (1, "老船夫"): ("merge", "船夫"), (1, "甲一"): ("keep", None), (1, "阿甲"): ("keep", None), (1, "少年"): ("merge", "甲一"), (1, "那个少年"): ("block", None), (1, "丙"): ("keep", None),
        (1, " "): ("block", None), (2, "阿甲"): ("merge", "乙"),
    }


def test_gates(spark):
    g = spark.createDataFrame([("x", 0, True), ("y", 2, False)], "gate string, n_bad long, ok boolean")
    registry.raise_on_closed(g.where("ok"))
    with pytest.raises(ValueError, match="y: 2"):
        registry.raise_on_closed(g)


def test_near_repeats(spark):
    head = "一" * 60
    rows = [("g", 1, 1, head + "甲"), ("g", 2, 2, head + "乙" * 90), ("g", 3, 3, "城里的灯早就被人换过了，没有人知道"), ("g", 4, 4, "城里的灯早就被人换过了，没有人知晓"), ("h", 1, 5, "短"), ("h", 2, 6, "长" * 50), ("h", 3, 7, "")]
    t = spark.createDataFrame(rows, "group string, place int, id long, text string")
    assert {(r.id, r.other) for r in registry.near_repeats(t).collect()} == {(2, 1), (4, 3)}
    assert registry.near_repeats(t.limit(0)).count() == 0


#: Events whose names are rare, repeated and frequent; ids null, empty and given by several lists.
DOSSIERS = [(i, 1 + n % 2, f"{name}{n % k}", f"loc{n % 4}" if n % 3 else None, "灯" if n % 5 else "", "钟" if n % 2 else None, n % 9, [None if n % 7 == 0 else n % 3], [f"role{(n + k) % 11}" for k in range(n % 6)]) for n, (i, name, k) in enumerate(
    [(f"e{x}", "论剑", 90) for x in range(120)] + [(f"f{x}", "夜谈", 2) for x in range(60)] + [(None, "论剑", 1), ("", "论剑", 2), ("g1", "论剑", 1), ("g2", "夜谈", 1)])]


@pytest.fixture(scope="module")
def dossier_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("dossiers"))
    ev = "id string, book_id long, name string, location string, description string, significance string, progress_start int, source_units array<int>, participants array<string>"
    rows = spark.createDataFrame(DOSSIERS, ev).selectExpr("*", "progress_start + 1 AS progress_end", "1 AS action_count", "current_timestamp() AS created_at", "current_timestamp() AS updated_at")
    rows.coalesce(1).write.parquet(f"{d}/unified_events.parquet")
    places = [("p1", ["e1", "e1", "e2", "f3", "gone", None]), ("p2", ["e2", "", "f4", "e7"]), ("p3", None), ("p4", [])]
    spark.createDataFrame(places, "id string, associated_events array<string>").selectExpr("*", "array('role1') AS associated_entities").coalesce(1).write.parquet(f"{d}/unified_locations.parquet")
    return d


def held_to_sql(spark, d, name, scans):
    """The rows are those of the SQL, or without SQL of the plain fold; the events are read only so often, and nothing of the events' size is broadcast, even where the folder looks small."""
    import duckdb

    import __spark_entry__ as e
    from verify_local import norm

    df = e.queries()[name](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("unified_events.parquet") == scans and plan.count("BroadcastExchange") <= 1 and "_salt" not in plan
    con = duckdb.connect()
    for t in ("unified_events", "unified_locations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    if sql := e.oracle_sql().get(name):
        rel = con.execute(sql)
        rows = [dict(zip([c[0] for c in rel.description], r)) for r in rel.fetchall()]
    else:
        rows = getattr(brute, name)(con)
    want = sorted(tuple(norm(r[c]) for c in df.columns) for r in rows)
    assert want and sorted(tuple(norm(x) for x in r) for r in df.collect()) == want


def test_dossier_membership_without_tables_of_names(spark, dossier_dir):
    held_to_sql(spark, dossier_dir, "dossier_membership", 2)


def test_dossier_top_n_without_tables_of_names(spark, dossier_dir):
    held_to_sql(spark, dossier_dir, "dossier_top_n", 2)


def test_dossier_top_500_without_tables_of_names(spark, dossier_dir):
    held_to_sql(spark, dossier_dir, "dossier_top_500", 2)


def test_featured_events_without_tables_of_names(spark, dossier_dir):
    held_to_sql(spark, dossier_dir, "featured_events", 2)


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_counts_in_place(spark, most):
    from collections import Counter

    from sagaloom.operators.ranking import with_count

    rows = [(g, n, i) for i, (g, n) in enumerate([(1, "a")] * 7 + [(1, None)] * 5 + [(None, None)] * 4 + [(2, "a"), (2, "b"), (2, "b")])]
    df = spark.createDataFrame(rows, "g long, name string, id long")
    n = Counter(r[:2] for r in rows)
    for lean in (None, df.select("g", "name")):
        assert sorted(((r.id, r.freq) for r in with_count(df, ["g", "name"], "id", "freq", lean, most).collect())) == [(i, n[g, x]) for g, x, i in rows]
