"""Plain Python versions of the queries that have no SQL, over rows that DuckDB reads: independent of Spark's plans."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from sagaloom.functions.rules import EVENT_RULES, SQL_TYPED
from sagaloom.functions.text import IDENTITY, LEADING, QUOTES, TRAILING
from sagaloom.plans.extraction import PLAIN_EVENT, SYMMETRIC
from sagaloom.plans.text_rules import ACTION_RULES, EDITORIAL
from sagaloom.sources.model import SQL_EVENTS, SQL_ROLES, SQL_SEASON

_SPACE = "[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"


def rows(con, sql: str) -> list[dict]:
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    return [dict(zip(names, x)) for x in r.fetchall()]


def scored(con) -> list[dict]:
    return rows(con, f"WITH {SQL_EVENTS}, {SQL_TYPED} SELECT *, {SQL_SEASON.format('unit')} AS season FROM scored")


def late(x):
    """Nulls last."""
    return (x is None, x or 0)


def strip(x: str | None) -> str | None:
    return None if x is None else re.sub(f"^{_SPACE}+|{_SPACE}+$", "", x)


def plain(text: str) -> list[str]:
    return re.findall("[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+", re.sub(_SPACE + "+", "", text))


def prose(text: str) -> list[str]:
    parts = re.split(f"(?<=[。！？；]){_SPACE}*", text)
    return [x for x in map(strip, parts) if x]


def best_rule(text: str, rules) -> str | None:
    found, most = None, 0
    for name, words in rules:
        n = sum(w in text for w in words)
        if n > most:
            found, most = name, n
    return found


def summary(text: str, name: str | None, chars: int) -> str:
    s = prose(text)
    if not s:
        return ""

    def score(x: str) -> int:
        speech = re.search(r'^["「『“]|["」』”]$|^\S{0,4}道[：:]', x)
        return (-10 if speech else 0) + (5 if name and name in x else 0) + (3 if re.search(IDENTITY, x) else 0)

    i = max(range(len(s)), key=lambda k: (score(s[k]), -k))
    t = s[i]
    if len(t) <= chars:
        for x in s[i + 1 :]:
            if len(t) + len(x) > chars:
                break
            t += x
        return t
    head = t[:chars]
    for m in "。；，、":
        p = head.rfind(m)
        if p >= 0 and p > chars // 3:
            return head[: p + 1]
    return head + "…"


def sentence_chunks(con):
    for r in rows(con, "SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL"):
        chunks: list[list[str]] = []
        for x in plain(r["text"]):
            if chunks and len(chunks[-1]) < 6 and sum(map(len, chunks[-1])) + len(x) <= 600:
                chunks[-1].append(x)
            else:
                chunks.append([x])
        for n, c in enumerate(chunks):
            yield dict(doc_id=r["doc_id"], segment_no=n, n=len(c), chars=sum(map(len, c)))


def candidate_trim(con):
    for r in rows(con, "SELECT DISTINCT name FROM (SELECT unnest(list_transform(entities, lambda e: e.name)) AS name FROM chunk_extractions)"):
        t = strip(r["name"])
        if t is not None:
            t = t.strip(QUOTES)
            if t[:1] in LEADING and len(t) >= 3 and "\n" not in t[1:]:
                t = t[1:]
            t = re.sub(f"[{TRAILING}]+$", "", t)
        yield dict(name=r["name"], trimmed=t)


def role_summaries(con):
    for r in rows(con, f"WITH {SQL_ROLES} SELECT * FROM role"):
        yield dict(id=r["id"], summary=summary(r["description"] or "", r["canonical_name"], 30))


def role_descriptions(con):
    by = defaultdict(dict)
    for r in rows(con, "SELECT * FROM unified_roles WHERE id IS NOT NULL"):
        by[r["id"]][r["record_id"]] = r
    for i, recs in by.items():
        recs = [recs[k] for k in sorted(recs)]
        texts = [strip(r["description"]) or "" for r in recs]
        notes = [[x for x in map(strip, r["original_descriptions"] or []) if x] for r in recs]
        ok = [t for t in texts if t and not any(e in t for e in EDITORIAL)]
        longest = lambda l: max(l, key=len) if l else None
        first = next((n[0] for n in notes if n), None)
        name = recs[0]["canonical_name"]
        pick = longest([t for t in ok if len(t) <= 40])
        for t in (first, longest([x for n in notes for x in n]), longest(ok), longest([t for t in texts if t])):
            pick = pick or (summary(t, name, 40) if t else None)
        yield dict(id=i, chosen=pick or "")


def greedy(text: str, names: dict[str, str]) -> list[tuple[int, str, str]]:
    """Longest aliases first, then by text; occurrences of an alias from the left without overlap."""
    taken, out = set(), []
    for alias in sorted(names, key=lambda a: (-len(a), a)):
        at = text.find(alias)
        while at >= 0:
            span = set(range(at, at + len(alias)))
            if not span & taken:
                taken |= span
                out.append((at, alias, names[alias]))
            at = text.find(alias, at + len(alias))
    return sorted(out)


def dictionary_mentions(con):
    names = defaultdict(dict)
    for r in rows(con, f"WITH {SQL_ROLES} SELECT book_id, id, unnest(all_names) AS a FROM role"):
        if r["a"] and len(r["a"]) >= 2 and r["book_id"] is not None:
            names[r["book_id"]][r["a"]] = min(r["id"], names[r["book_id"]].get(r["a"], r["id"]))
    for r in rows(con, "SELECT DISTINCT book_id, chunk_id, array_to_string(list_transform(source_sentences, lambda x: coalesce(x, '')), '') AS t FROM chunk_extractions"):
        for start, alias, entity in greedy(r["t"] or "", names.get(r["book_id"], {})):
            yield dict(book_id=r["book_id"], chunk_id=r["chunk_id"], start=start, alias=alias, entity=entity)


def oriented_pairs(con):
    first = defaultdict(dict)
    for m in dictionary_mentions(con):
        d = first[m["book_id"], m["chunk_id"]]
        d[m["entity"]] = min(m["start"], d.get(m["entity"], m["start"]))
    text = {r["chunk_id"]: r["t"] or "" for r in rows(con, "SELECT chunk_id, array_to_string(list_transform(source_sentences, lambda x: coalesce(x, '')), '') AS t FROM chunk_extractions")}
    for (book, chunk), d in first.items():
        action = best_rule(text[chunk], ACTION_RULES)
        four = sorted(d, key=lambda e: (d[e], e))[:4]
        for i, x in enumerate(four):
            for y in four[i + 1 :]:
                if action and (action in ("对话", "同行", "冲突", "会见") or i == 0):
                    yield dict(book_id=book, chunk_id=chunk, action=action, src=x, dst=y)


def segment_extraction(con):
    juan = {r["chunk_id"]: r["juan_index"] for r in rows(con, "SELECT chunk_id, juan_index FROM chunk_extractions")}
    n, who, pairs = Counter(), defaultdict(set), Counter()
    for m in dictionary_mentions(con):
        k = (m["book_id"], juan[m["chunk_id"]])
        n[k] += 1
        who[k].add(m["entity"])
    for p in oriented_pairs(con):
        pairs[p["book_id"], juan[p["chunk_id"]]] += 1
    for k in n:
        yield dict(book_id=k[0], juan_index=k[1], mentions=n[k], n_roles=len(who[k]), pairs=pairs[k])


def union_capped(con):
    first = {}
    for r in rows(con, "SELECT book_id, canonical_name AS x, record_id, unnest(all_names) AS y FROM unified_roles WHERE id IS NOT NULL AND book_id IS NOT NULL"):
        if r["x"] and r["y"] and r["x"] != r["y"]:
            k = (r["book_id"], r["x"], r["y"])
            first[k] = min(r["record_id"], first.get(k, r["record_id"]))
    up, size = {}, {}

    def find(n):
        up.setdefault(n, n)
        size.setdefault(n, 1)
        return n if up[n] == n else find(up[n])

    for (book, x, y), _ in sorted(first.items(), key=lambda kv: (kv[1], kv[0])):
        a, b = find((book, x)), find((book, y))
        if a != b and size[a] + size[b] <= 15:
            top, low = (a, b) if len(a[1]) <= len(b[1]) else (b, a)
            up[low] = top
            size[top] += size[low]
    for n in list(up):
        yield dict(book_id=n[0], name=n[1], root=find(n)[1])


def edges(con) -> list[dict]:
    from sagaloom.plans.graph import SQL

    return rows(con, SQL["pair_edges"])


def capped(found: list[dict], share: float, cap: int) -> list[dict]:
    out = []
    books = defaultdict(list)
    for e in found:
        books[e["book_id"]].append(e)
    for es in books.values():
        es.sort(key=lambda e: (-e["edge_score"], e["a"], e["b"]))
        nodes = {x for e in es for x in (e["a"], e["b"])}
        most, kept, served, degree = max(len(nodes) - 1, round(len(es) * share)), [], set(), Counter()
        for e in es:
            if {e["a"], e["b"]} - served:
                kept.append(e)
                degree.update((e["a"], e["b"]))
            served |= {e["a"], e["b"]}
        for e in es:
            if len(kept) >= most:
                break
            if e not in kept and degree[e["a"]] < cap and degree[e["b"]] < cap:
                kept.append(e)
                degree.update((e["a"], e["b"]))
        out += kept
    return out


def graph_capped_links(con):
    for e in capped(edges(con), 0.16 + 50 / 300, 4):
        yield {k: e[k] for k in ("book_id", "a", "b", "edge_score")}


def boundary_units(con):
    seasons = defaultdict(lambda: defaultdict(list))
    for e in scored(con):
        if e["unit"] is not None:
            seasons[e["book_id"], e["season"]][e["unit"]].append(e)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (book, season), units in seasons.items():
        group, reason = None, "season_start"
        for u in sorted(units):
            ev = units[u]
            cur = dict(who={p for e in ev for p in e["people"]}, where={e["location"] for e in ev if e["location"] is not None}, names={e["name"] for e in ev if e["name"] is not None})
            lo = min((e["p0"] for e in ev if e["p0"] is not None), default=None)
            hi = max((e["p1"] for e in ev if e["p1"] is not None), default=None)
            if group:
                gap = lo - group["hi"] if lo and group["hi"] else 0
                n = (like(group["who"], cur["who"]) >= 0.3) + (like(group["where"], cur["where"]) >= 0.2) + bool(group["names"] & cur["names"]) + (gap <= 1)
                if n >= 2 and len(group["units"]) < 4:
                    group["units"].append(u)
                    for k in cur:
                        group[k] |= cur[k]
                    group["hi"] = max(group["hi"] or 0, hi or 0)
                    continue
                yield dict(book_id=book, season=season, first_unit=group["units"][0], last_unit=group["units"][-1], span=len(group["units"]), reason=group["reason"])
                reason = "span_limit" if len(group["units"]) >= 4 else f"signals:{n}"
            group = dict(units=[u], hi=hi, reason=reason, **cur)
        yield dict(book_id=book, season=season, first_unit=group["units"][0], last_unit=group["units"][-1], span=len(group["units"]), reason=group["reason"])


def boundary_validate(con):
    return iter(())  # boundaries that are built by the rules break none; see test_broken_boundaries


def sequence_likeness(con):
    by = defaultdict(list)
    for e in scored(con):
        if e["description"]:
            by[e["book_id"], e["name"]].append((e["id"], e["description"]))
    for es in by.values():
        es.sort()
        for (_, a), (i, b) in zip(es, es[1:]):
            r = round(SequenceMatcher(None, b, a, autojunk=False).ratio(), 6)
            if r >= 0.8:
                yield dict(id=i, likeness=r)


def turning_points(con):
    by = defaultdict(list)
    for e in scored(con):
        for p in e["people"]:
            by[e["book_id"], p].append(e)
    for (book, role), es in by.items():
        es.sort(key=lambda e: (late(e["p0"]), e["id"]))
        n = len(es)
        third = {e["id"]: 0 if n == 1 else min(2, 3 * i // max(n - 1, 1)) for i, e in enumerate(es)}
        place = {e["id"]: i for i, e in enumerate(es)}
        ranked = sorted(es, key=lambda e: (-e["score"], place[e["id"]]))
        picked, names = [], set()
        for k in (0, 1, 2):
            e = next((e for e in ranked if third[e["id"]] == k and e["name"] not in names), None)
            if e:
                picked.append(e)
                names.add(e["name"])
        for e in ranked:
            if len(picked) < 5 and e not in picked and e["name"] not in names:
                picked.append(e)
                names.add(e["name"])
        for t, e in enumerate(sorted(picked, key=lambda e: place[e["id"]]), 1):
            yield dict(book_id=book, role=role, id=e["id"], third=third[e["id"]], by_time=t)


def shared_events_spread(con):
    by = defaultdict(list)
    for e in scored(con):
        for i, a in enumerate(e["people"]):
            for b in e["people"][i + 1 :]:
                by[e["book_id"], a, b].append(e)
    for (book, a, b), es in by.items():
        if len(es) < 2:
            continue
        es.sort(key=lambda e: (late(e["p0"]), e["id"]))
        third = {e["id"]: min(2, 3 * i // (len(es) - 1)) for i, e in enumerate(es)}
        place = {e["id"]: i for i, e in enumerate(es)}
        ranked = sorted(es, key=lambda e: (-e["score"], place[e["id"]]))
        taken, names, held = [], set(), Counter()
        for e in ranked:
            k = third[e["id"]]
            if len(taken) < 6 and e["name"] not in names and not (held[k] >= 2 and min(held[x] for x in (0, 1, 2)) < 2):
                taken.append(e)
                names.add(e["name"])
                held[k] += 1
        for e in ranked:
            if len(taken) < 6 and e not in taken and e["name"] not in names:
                taken.append(e)
                names.add(e["name"])
        for e in taken:
            yield dict(book_id=book, a=a, b=b, id=e["id"], third=third[e["id"]])


def extraction(con) -> dict[str, list[dict]]:
    """All records of the segment extraction."""
    names = defaultdict(lambda: {"role": {}, "place": {}})
    for kind, sql in (("role", f"WITH {SQL_ROLES} SELECT * FROM role"), ("place", "SELECT * FROM unified_locations")):
        for r in rows(con, sql):
            for a in [*(r["all_names"] or []), r["canonical_name"]]:
                if a and len(a) >= 2 and r["canonical_name"] and r["book_id"] is not None:
                    d = names[r["book_id"]][kind]
                    d[a] = min(r["canonical_name"], d.get(a, r["canonical_name"]))
    out = {k: [] for k in ("roles", "places", "relations", "events")}
    seen = set()
    for c in rows(con, "SELECT chunk_id, book_id, juan_index, source_sentences FROM chunk_extractions"):
        if c["chunk_id"] in seen or c["chunk_id"] is None or c["book_id"] is None:
            continue
        seen.add(c["chunk_id"])
        s = [x for x in map(strip, c["source_sentences"] or []) if x]
        of = {k: [list(dict.fromkeys(e for _, _, e in greedy(x, names[c["book_id"]][k]))) for x in s] for k in ("role", "place")}
        people = list(dict.fromkeys(e for x in of["role"] for e in x))
        places = list(dict.fromkeys(e for x in of["place"] for e in x))
        key = dict(chunk_id=c["chunk_id"], book_id=c["book_id"])
        for kind, found, to in (("role", people, "roles"), ("place", places, "places")):
            for n in found:
                at = [i for i, x in enumerate(of[kind]) if n in x]
                r = dict(**key, name=n, sentences=",".join(map(str, at)), description=" ".join(s[i] for i in at[:2]), n_sentences=len(at))
                if kind == "place":
                    r["people"] = "|".join(sorted({p for i in at for p in of["role"][i]}))
                out[to].append(r)
        rel, known = [], set()

        def add(who, action, pos, place, sentence):
            for i, x in enumerate(who[:4]):
                for y in who[i + 1 : 4]:
                    if (action in SYMMETRIC or i == 0) and (x, y, action, sentence) not in known:
                        known.add((x, y, action, sentence))
                        rel.append(dict(**key, src=x, dst=y, action=action, pos=pos, place=place))

        for i, x in enumerate(s):
            action = best_rule(x, ACTION_RULES)
            if len(of["role"][i]) >= 2 and action:
                add(of["role"][i], action, i, of["place"][i][0] if of["place"][i] else places[0] if places else None, x)
        whole = " ".join(s)
        if not rel and len(people) == 2 and best_rule(whole, ACTION_RULES):
            rel.append(dict(**key, src=people[0], dst=people[1], action=best_rule(whole, ACTION_RULES), pos=-1, place=places[0] if places else None))
        out["relations"] += rel
        if not people and not places:
            continue
        count = Counter(n for x in of["role"] for n in x)
        actors = list(dict.fromkeys(n for r in rel for n in (r["src"], r["dst"])))
        who = (actors or sorted(people, key=lambda n: (-count[n], people.index(n))))[:4]
        kind = best_rule(whole, EVENT_RULES) or (rel[0]["action"] if rel else PLAIN_EVENT)
        place = places[0] if places else None
        base = "与".join(who[:2]) + ("在" if who and place else "") + (place or "")
        told = [x for i, x in enumerate(s) if of["role"][i] or of["place"][i]]
        rest = [x for i, x in enumerate(s) if not (of["role"][i] or of["place"][i])]
        out["events"].append(
            dict(
                **key, name=f"第{c['juan_index']}回 · {base}{kind}", event_type=kind, participants="|".join(who), place=place, description=" ".join((told[:3] + rest)[:3]), n_relations=len(rel),
                evidence=" ".join((told[:2] + rest)[:2])[:80],
            )
        )
    return out


def extracted_roles(con):
    return extraction(con)["roles"]


def extracted_locations(con):
    return extraction(con)["places"]


def extracted_relations(con):
    return extraction(con)["relations"]


def extracted_events(con):
    return extraction(con)["events"]


def action_type_counts(con):
    n = Counter((r["book_id"], r["src"], r["dst"], r["action"]) for r in extraction(con)["relations"])
    return [dict(book_id=k[0], src=k[1], dst=k[2], action=k[3], n=v) for k, v in n.items()]


def dossier_top_500(con):
    from sagaloom.plans.audits import _DM

    by = defaultdict(list)
    for r in rows(con, f"WITH {_DM} SELECT k.book_id, k.id, dm.dossier_score, k.unit, k.name, concat_ws('：', k.people[1], k.name) AS shown FROM dm JOIN k ON k.id = dm.id"):
        by[r["book_id"]].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (-r["dossier_score"], late(r["unit"]), r["id"]))
        seen, used, n = set(), Counter(), 0
        for r in rs:
            if n < 500 and r["shown"] not in seen and used[r["name"]] < 3:
                n += 1
                seen.add(r["shown"])
                used[r["name"]] += 1
                yield dict(book_id=r["book_id"], id=r["id"], dossier_score=r["dossier_score"], rank_no=n)


def narrative_unit_dossiers(con):
    import hashlib

    from sagaloom.plans.seasons import SQL

    told = {(r["book_id"], r["unit"]): r for r in rows(con, SQL["unit_synopsis"])}
    keys = defaultdict(list)
    for r in rows(con, SQL["key_events_per_unit"]):
        if r["rank_no"] <= 3:
            keys[r["book_id"], r["unit"]].append((r["rank_no"], r["id"]))
    for b in boundary_units(con):
        units = [u for u in range(b["first_unit"], b["last_unit"] + 1) if (b["book_id"], u) in told]
        text = "\n".join(told[b["book_id"], u]["synopsis"] for u in units if told[b["book_id"], u]["synopsis"] is not None)
        ids = ",".join(",".join(i for _, i in sorted(keys[b["book_id"], u])) for u in units if keys[b["book_id"], u])
        n = sum(told[b["book_id"], u]["n_events"] for u in units)
        packet = "\x1f".join(map(str, (b["book_id"], b["first_unit"], b["last_unit"], text, ids)))
        yield dict(book_id=b["book_id"], first_unit=b["first_unit"], last_unit=b["last_unit"], reason=b["reason"], n_events=n, synopses=text, key_events=ids, hash=hashlib.sha256(packet.encode()).hexdigest())


def repeated_texts(con):
    by = defaultdict(list)
    for r in rows(con, "SELECT DISTINCT doc_id, book_id, unit_index, text FROM documents WHERE book_id IS NOT NULL AND text IS NOT NULL"):
        by[r["book_id"], r["unit_index"]].append((r["doc_id"], r["text"]))
    for (book, unit), ts in by.items():
        ts.sort()
        for (other, a), (i, b) in zip(ts, ts[1:]):
            if a and b:
                r = None if len(b) >= 60 and a[:60] == b[:60] else round(SequenceMatcher(None, b, a, autojunk=False).ratio(), 6)
                if r is None or r >= 0.92:
                    yield dict(group=f"{book}" + ("" if unit is None else f"/{unit}"), id=i, other=other, likeness=r)
