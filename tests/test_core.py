"""Behaviour of core operators on small frames."""

from __future__ import annotations

import datetime as dt
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sagaloom.functions.ranges import overlap_size, overlaps
from sagaloom.functions.text import chinese_number, low_signal, pack_sentences, parse_year, plain_sentences, summary, trim_candidate
from sagaloom.operators.components import connected_components
from sagaloom.operators.dictionary import greedy, match_names
from sagaloom.operators.merging import best_of, freshness, missing_keys, upsert
from sagaloom.operators.ranking import numbered, with_stats
from sagaloom.operators.references import OrphanState, existence_deltas, key_counts, key_versions, merge_versions, orphan_keys, orphan_references, reference_deltas, reference_rows
from sagaloom.operators.unions import capped_unions, name_components
from sagaloom.sources.books import build_book, read_paragraphs
from sagaloom.sources.stores import json_in_text, markdown_chapters, read_json, read_units, write_json, write_store
from sagaloom.streaming.upserts import upsert_stream

T = lambda m, d: dt.datetime(2025, m, d)


def test_references(spark):
    roles = spark.createDataFrame(
        [(1, "r1", T(1, 1), T(1, 2), None), (2, "r1", T(1, 1), T(3, 1), None), (3, "r2", T(1, 1), T(2, 1), None), (4, "r2", T(1, 1), T(2, 5), T(2, 5)), (5, "r3", T(6, 1), T(6, 2), None), (5, "r3", T(6, 1), T(6, 2), None), (6, None, T(1, 1), None, None)],
        "record_id long, id string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    )
    ev = spark.createDataFrame([("e1", [" R1", "r2", "r9", None, "", " "], T(5, 1), "x"), ("e1", [" R1", "r2", "r9", None, "", " "], T(5, 1), "x"), ("e2", ["r3", "r3"], T(5, 1), "x"), ("e3", ["r3"], T(7, 1), "x"), ("e4", None, T(7, 1), "x"), ("e5", ["r9"], None, "x")], "id string, participants array<string>, created_at timestamp, ref_id string")
    state = key_versions(roles, "id", "record_id", "updated_at", "created_at", "deleted_at")
    got = {tuple(r) for r in orphan_references(reference_rows(ev, "unified_events", "id", "participants"), state).collect()}
    assert got == {("unified_events", "e1", "r2", "deleted", "2025-05"), ("unified_events", "e1", "r9", "missing", "2025-05"), ("unified_events", "e2", "r3", "late", "2025-05"), ("unified_events", "e5", "r9", "missing", None)}
    none = orphan_references(reference_rows(ev.limit(0), "t", "id", "participants"), state)
    assert none.count() == 0
    # the same keys from deltas in two batches: a reference is taken back, a key comes back to life
    one = key_versions(roles.where("record_id <> 4"), "id", "record_id", "updated_at", "created_at", "deleted_at")
    two = merge_versions(one.unionByName(key_versions(roles.where("record_id = 4"), "id", "record_id", "updated_at", "created_at", "deleted_at")))
    refs = reference_rows(ev, "t", "id", "participants").distinct()
    first = reference_deltas(refs).unionByName(existence_deltas(one))
    assert {(r.ref_id, r.kind) for r in orphan_keys(key_counts(first)).collect()} == {("r9", "missing")}
    second = first.unionByName(existence_deltas(two, one)).unionByName(reference_deltas(refs.where("ref_id = 'r9'"), -1))
    assert {(r.ref_id, r.kind) for r in orphan_keys(key_counts(second)).collect()} == {("r2", "deleted")}


def test_orphan_state(spark, tmp_path):
    """References to a key created in June, from May and July: the May one is taken back, the key turns out to be older, dies."""
    roles = lambda rows: key_versions(spark.createDataFrame(rows, "record_id long, id string, created_at timestamp, updated_at timestamp, deleted_at timestamp"), "id", "record_id", "updated_at", "created_at", "deleted_at")
    refs = lambda rows: reference_rows(spark.createDataFrame(rows, "id string, participants array<string>, created_at timestamp"), "t", "id", "participants")
    report = lambda s: {tuple(r) for r in s.report().collect()}
    one = OrphanState.empty(spark).apply(refs([("e1", ["k"], T(5, 1)), ("e2", ["k", "x"], T(7, 1)), ("e3", ["k"], T(5, 9)), ("e1", ["k"], T(5, 1))]), None, roles([(1, "k", T(6, 1), T(6, 1), None)]))
    assert report(one) == {("t", "2025-05", "late", 2, 1), ("t", "2025-07", "missing", 1, 1)}
    one.write(str(tmp_path / "s"))
    kept = OrphanState.read(spark, str(tmp_path / "s"))
    assert report(kept.apply(gone=refs([("e1", ["k"], T(5, 1)), ("e3", ["k"], T(5, 9))]))) == {("t", "2025-07", "missing", 1, 1)}
    two = kept.apply(gone=refs([("e1", ["k"], T(5, 1))]))
    assert report(two) == {("t", "2025-05", "late", 1, 1), ("t", "2025-07", "missing", 1, 1)}
    older = two.apply(versions=roles([(2, "k", T(5, 2), T(6, 5), None), (3, "x", T(6, 1), None, None)]))
    assert report(older) == set()
    assert report(older.apply(gone=refs([("e3", ["k"], T(5, 9))]), versions=roles([(2, "k", T(5, 2), T(8, 1), T(8, 1))]))) == {("t", "2025-07", "deleted", 1, 1)}


def test_text_functions(spark):
    df = spark.createDataFrame([("甲。乙！！ 丙；丁",)], "t string")
    assert df.select(plain_sentences(F.col("t"))).first()[0] == ["甲。", "乙！", "！", "丙；", "丁"]
    s = ["一" * 5, "二" * 5, "三" * 700, "四"]
    got = spark.createDataFrame([(s,)], "s array<string>").select(pack_sentences(F.col("s"), 2, 600)).first()[0]
    assert got == [s[:2], s[2:3], s[3:]]
    n = spark.createDataFrame([("十二",), ("二百零五",), ("37",), ("三千",)], "n string").select(chinese_number(F.col("n"))).collect()
    assert [r[0] for r in n] == [12, 205, 37, 3000]
    y = spark.createDataFrame([("公元前403年",), ("前 7年",), ("公元655年",), ("（周、116）",), ("无",), (None,)], "y string").select(parse_year(F.col("y"))).collect()
    assert [r[0] for r in y] == [-403, -7, 655, 116, None, None]
    t = spark.createDataFrame([("“这少年的”",), ("在家",), (" 阿良了着",)], "n string").select(trim_candidate(F.col("n"))).collect()
    assert [r[0] for r in t] == ["少年", "在家", "阿良"]
    x = spark.createDataFrame([("短句。",), ("“他说了很多很多的话。",), ("他转头看着远处的山。",), ("这座城里住着一位年老的铸钟匠，没人知道他从哪里来。",), (None,)], "t string").select(low_signal(F.col("t"))).collect()
    assert [r[0] for r in x] == [True, True, True, False, True]
    q = spark.createDataFrame([("甲笑道：好。他是城主。住在山上。", "他"), ("很长" * 40 + "，完", "x"), ("", "x")], "t string, n string").select(summary(F.col("t"), F.col("n"), 12)).collect()
    assert [r[0] for r in q] == ["他是城主。住在山上。", "很长" * 6 + "…", ""]


def test_ranges(spark):
    df = spark.createDataFrame([(1, 5), (None, 7), (None, None), (9, 3)], "a int, b int")
    assert [r[0] for r in df.select(overlaps(F.col("a"), F.col("b"), (6, 8))).collect()] == [False, True, False, True]
    assert [r[0] for r in df.select(overlap_size(F.col("a"), F.col("b"), (4, 8))).collect()] == [2, 1, 0, 5]
    assert df.select(overlaps(F.col("a"), F.col("b"), None)).distinct().count() == 1


def test_numbering_and_stats(spark):
    rows = [(None if i % 5 == 0 else i % 2, i % 7 if i % 3 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, v int, k int")
    got = {r.k: r.n for r in numbered(df, ["g"], F.col("v"), ["k"], "n").collect()}
    for g in (None, 0, 1):
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in part] == list(range(1, len(part) + 1))
    assert {(r.g, r.n) for r in with_stats(df, ["g"], [F.count(F.lit(1)).alias("n")], "k").collect()} == {(g, sum(r[0] == g for r in rows)) for g in (None, 0, 1)}


def test_dictionary(spark):
    assert greedy("阿良良", [(0, "阿良"), (1, "良"), (2, "良")]) == [(0, "阿良"), (2, "良")]
    names = spark.createDataFrame([(1, "阿良", "r1"), (1, "良", "r2"), (2, "甲乙", "r3"), (None, "x", "r4"), (1, "", "r5")], "b long, alias string, entity string")
    texts = spark.createDataFrame([(1, 10, "阿良与良。"), (2, 11, "阿良甲乙"), (3, 12, "阿良"), (1, 13, None), (1, 14, "")], "b long, k long, text string")
    got = {(r.k, r.start, r.entity) for r in match_names(texts, names, "b", "k").collect()}
    assert got == {(10, 0, "r1"), (10, 3, "r2"), (11, 2, "r3")}


def test_unions(spark):
    e = spark.createDataFrame([(1, "甲一", "乙", 1), (1, "乙", "丙三四", 2), (2, "乙", "丁", 1), (1, None, "x", 3)], "b long, x string, y string, ord long")
    assert {tuple(r) for r in name_components(e, "b").collect()} == {(1, n, min("甲一", "乙", "丙三四")) for n in ("甲一", "乙", "丙三四")} | {(2, n, "丁") for n in ("乙", "丁")}
    assert {(r.name, r.root) for r in capped_unions(e.where("b = 1"), "b").collect()} == {("甲一", "乙"), ("乙", "乙"), ("丙三四", "乙")}
    assert {(r.name, r.root) for r in capped_unions(e.where("b = 1"), "b", cap=2).collect()} == {("甲一", "乙"), ("乙", "乙"), ("丙三四", "丙三四")}


def test_components_like_brute_force(spark):
    """A long path numbered in a row, a star, random edges, loops, repeats and nulls, with keys of two types."""
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (7, 6), (None, 3), (9000, 9000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {n: find(n) for n in list(root)}
    edges = spark.createDataFrame(pairs, "u long, v long")
    assert {r.node: r.label for r in connected_components(edges).collect()} == want
    text = edges.select(*(F.when(F.col(c).isNotNull(), F.format_string("%05d", c)).alias(c) for c in ("u", "v")))
    assert {int(r.node): int(r.label) for r in connected_components(text).collect()} == want
    assert connected_components(edges.limit(0)).count() == 0


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert {tuple(r) for r in upsert(old, new, ["k"], [F.desc("t")]).collect()} == {(1, "a", 1), (2, "d", 3), (3, "e", 1)}
    want = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "k int, hash string")
    made = spark.createDataFrame([(1, "h1"), (2, "old")], "k int, hash string")
    assert {tuple(r) for r in freshness(want, made, "k").collect()} == {(1, "applied"), (2, "stale"), (3, "missing")}
    c = spark.createDataFrame([(1, "h1", 1, 1, "x"), (1, "old", 9, 0, "y"), (2, "old", 1, 0, "z"), (2, "older", 1, 1, "w")], "k int, hash string, made_at int, priority int, v string")
    assert {r.v for r in best_of(c, want, "k").collect()} == {"x", "z"}
    assert {r.n for r in missing_keys(spark.createDataFrame([(1, 2), (1, 5)], "g int, n int"), ["g"], "n").collect()} == {3, 4}


def test_json_in_text():
    assert json_in_text('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert json_in_text('well {"a": {"b": 2}} end') == {"a": {"b": 2}}
    assert json_in_text("[1, 2]") == [1, 2]
    for bad in ("", "  ", "none at all"):
        with pytest.raises(ValueError):
            json_in_text(bad)


def test_book(spark, tmp_path):
    def docx(path, paragraphs):
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        xml = f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("word/document.xml", xml)

    (tmp_path / "in").mkdir()
    docx(tmp_path / "in/书 第二季.docx", ["第三章 归", "再见。"])
    docx(tmp_path / "in/书 第一季.docx", ["序言不算", "第一章 起", "甲。乙！", "　丙。", "", "第二章 空", "第二章 承", "丁。"])
    book = build_book(read_paragraphs(spark, str(tmp_path / "in")), most=2)
    got = [(r.unit_index, r.unit_title, r.season_index, r.segment_index, r.progress_index, r.sentences) for r in book.orderBy("progress_index").collect()]
    assert got == [(1, "第一章 起", 1, 1, 1, ["甲。", "乙！"]), (1, "第一章 起", 1, 2, 2, ["丙。"]), (2, "第二章 承", 1, 1, 3, ["丁。"]), (3, "第三章 归", 2, 1, 4, ["再见。"])]
    md = {r.file_name: r.markdown for r in markdown_chapters(book).collect()}
    assert '<a id="seg-002"></a>\n\n丙。' in md["001-第一章 起.md"]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, ["b", "a", "a"]), (2, 3, [])], "k int, juan_index int, s array<string>")
    write_store(df, str(tmp_path / "store"))
    assert [r.k for r in read_units(spark, str(tmp_path / "store"), [3]).collect()] == [2]
    write_json(df, str(tmp_path / "json"), ["s"])
    assert sorted(r.s for r in read_json(spark, str(tmp_path / "json"), "k int, s array<string>").collect()) == [[], ["a", "b"]]


def test_stream(spark, tmp_path):
    schema = "k int, part int, v string, t int"
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    run = lambda: upsert_stream(spark, src, spark.createDataFrame([], schema).schema, store, ck, ["k"], "t", "part").awaitTermination()
    spark.createDataFrame([(1, 1, "a", 1), (2, 2, "b", 5)], schema).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(1, 1, "c", 3), (2, 2, "late", 4), (3, 1, "d", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {(r.k, r.v) for r in spark.read.parquet(store).collect()} == {(1, "c"), (2, "b"), (3, "d")}
