"""Queries without SQL, on made-up events."""

from __future__ import annotations

from sagaloom.plans import seasons, stories

EVENT = "book_id long, season int, id string, name string, description string, significance string, location string, unit int, p0 int, people array<string>, event_type string, score int"


def test_foreshadow_threads(spark, monkeypatch):
    def ev(id, unit, name="x", sig=None, desc=None, place=None, book=1, kind="对话", p0=None):
        return (book, 1, id, name, desc, sig, place, unit, unit if p0 is None else p0, ["a", "b"], kind, 0)

    rows = [
        ev("early", 1, "旧账一"), ev("weak", 2, desc="钥匙"), ev("pay3", 3, "账册"), ev("pay4", 4, place="shop"), ev("strong", 15, "失钥", "钥匙", "失钥", kind="冲突"), ev("pay20", 20, sig="旧账"),
        ev("none", None, "旧账散页"), ev("half", 3, "失钥", book=2), *(ev(f"c{n:02}", n, f"钥匙{n}", book=3) for n in range(1, 13)), ev("p", 1, "旧账", book=3), ev("q", 1, "旧账", book=3, desc="账册"),
    ]
    monkeypatch.setattr(seasons, "scored", lambda *_: spark.createDataFrame(rows, EVENT))
    monkeypatch.setattr(seasons, "locations", lambda *_: spark.createDataFrame([("shop", "账册铺")], "id string, canonical_name string"))
    got: dict = {}
    for r in sorted(seasons.foreshadow_threads(spark, "").collect(), key=lambda r: r.pos):
        got.setdefault((r.book_id, r.side), []).append(r.id)
    assert got == {(1, "clue"): ["weak", "strong"], (1, "payoff"): ["pay3", "pay4", "pay20", "none"], (3, "clue"): ["c01", "c03", "c05", "c07", "c09"], (3, "payoff"): ["q"]}


def test_season_beats(spark, monkeypatch):
    def ev(season, id, name, score, p0, unit=None, book=1):
        return (book, season, id, name, None, None, None, season if unit is None else unit, p0, [], "", score)

    rows = [
        ev(1, "a", "A", 9, 0), ev(1, "b", "B", 8, 10), ev(1, "c", "C", 7, 100),  # nothing in the middle: any event left
        ev(2, "a2", "A", 9, 0), ev(2, "d", "D", 1, 5), ev(2, "a3", "A", 5, 50), ev(2, "d2", "D", 3, 100), ev(2, "d3", "D", 4, 99),  # names of season 1; same name in the last window
        ev(3, "e", "E", 1, None, 15), ev(3, "f", "F", 1, None, 21),  # by unit; two events for three beats
        *(ev(n, f"{n:02}-{i:03}-{p}", f"N{i:03}", 200 - i, p, book=2) for n in range(1, 31) for i in range(95) for p in (0, 50, 100)),
    ]
    monkeypatch.setattr(stories, "scored", lambda *_: spark.createDataFrame(rows, EVENT))
    got = {(r.book_id, r.season, r.beat): r.id for r in stories.season_beats(spark, "").collect()}
    assert [got[1, 1, n] for n in (1, 2, 3)] == ["a", "b", "c"]
    assert [got[1, 2, n] for n in (1, 2, 3)] == ["d", "a3", "d3"]
    assert [got[1, 3, n] for n in (1, 2, 3)] == ["e", "f", None]
    assert len(got) == 99 and [got[2, 30, n] for n in (1, 2, 3)] == ["30-087-0", "30-088-50", "30-089-100"]
