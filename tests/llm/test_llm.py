"""Training-text operators: defined cases on small frames, brute force and round trips."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagaloom.llm import abuse, bpe, lookalikes
from sagaloom.llm.abuse import flag_documents, rates_by_source
from sagaloom.llm.components import connected_components, star_edges
from sagaloom.llm.fusion import fuse_values
from sagaloom.llm.record_queries import field_claims
from sagaloom.llm.leakage import ItemIndex, find_leaks, fingerprints, leaks, letters_of
from sagaloom.llm.lookalikes import one_form, same_look_pairs, same_shapes
from sagaloom.llm.names import NameForms, errors, link_names, nearby, shards
from sagaloom.llm.sentences import Tagger, decode, marginals, split_sentences, train_tagger
from sagaloom.llm.splitting import SEPARATORS, boundary_levels, pack, split_oversized
from sagaloom.llm.survivors import surviving_records
from tests.llm.unseen_sentences import FOUND, HARMLESS

VOCAB = bpe.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file here")


# --- problem 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("“守塔的数过船上有几个人？”账房低声问，掂了掂木匣。他走了。", ["“守塔的数过船上有几个人？”账房低声问，掂了掂木匣。", "他走了。"]),
        ("他回头道：『那艘船早就被人换过。剑不能相信。』天亮了！！", ["他回头道：『那艘船早就被人换过。", "剑不能相信。』", "天亮了！！"]),
        ("先看《琉璃亭志？》，再看船桨；额头冷……过了57.63个时辰。", ["先看《琉璃亭志？》，再看船桨；额头冷……过了57.63个时辰。"]),
        ("石碑上刻着“山门今夜就要开！”四行小字，远处有鹭。", ["石碑上刻着“山门今夜就要开！”四行小字，远处有鹭。"]),
        ('"Did you hear the bell?" asked Mr. Holt, and K. T. Brand paid 70.25 marks. At 7:36 p.m. Osrik left!', ['"Did you hear the bell?" asked Mr. Holt, and K. T. Brand paid 70.25 marks.', "At 7:36 p.m. Osrik left!"]),
        ("Rope, oil, etc. The dog ran. It waited... and slept.", ["Rope, oil, etc.", "The dog ran.", "It waited... and slept."]),
        ("Am 15. Januar kam er. „Wo ist er?“, fragte sie.", ["Am 15. Januar kam er.", "„Wo ist er?“, fragte sie."]),
        ("Title 1\n\nOne line\nbreak is no end. Two.", ["Title 1", "One line\nbreak is no end.", "Two."]),
        ("คนแจวเรือเฒ่าซ่อนขวด เรือออกจากท่า", ["คนแจวเรือเฒ่าซ่อนขวด", "เรือออกจากท่า"]),
        ("डॉ. तरशिम ने 4.60 रुपये में चाबी ख़रीदा। क्या हुआ?", ["डॉ. तरशिम ने 4.60 रुपये में चाबी ख़रीदा।", "क्या हुआ?"]),
        ("", []),
        (" \n ", []),
        ("no mark at all", ["no mark at all"]),
    ],
)
def test_sentences(text, want):
    assert [text[a:z] for a, z in Tagger().sentences(text)] == want


def test_sentences_on_chunks(spark):
    rows = [(1, ["A b", "c. D."], 5), (1, ["A b", "c. D."], 5), (2, None, 5), (3, [], 5), (4, [None, "", "甲。乙。"], 5), (5, ["长" * 50_000 + "。"], 5)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_sentences array<string>, start_char int")
    tagger = train_tagger(chunks)
    got = sorted(tuple(r) for r in split_sentences(chunks, tagger).collect())
    assert got == [(1, 0, 0, 5), (1, 1, 6, 8), (4, 0, 0, 2), (4, 1, 2, 4), (5, 0, 0, 50_001)]
    assert split_sentences(chunks.limit(0), train_tagger(chunks.limit(0))).count() == 0


def test_tagger_learns_from_the_corpus():
    """Held-out accuracy: an abbreviation that the prior does not know is learned from well-cut chunks."""
    rng = random.Random(1)
    words = ["lamp", "bell", "rope", "tide", "ferry"]
    make = lambda: [f"The {rng.choice(words)} of Qqz. {rng.choice(['Holt', 'Brand'])} was {rng.choice(words)}. " for _ in range(5)]
    tagger = Tagger().fit([make() for _ in range(200)])
    text = "".join(make())
    assert len(tagger.sentences(text)) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-4, 4), min_size=1, max_size=6), min_size=1, max_size=4), st.floats(-2, 2), st.floats(-2, 2))
def test_field_like_brute_force(chains, a0, a1):
    """Marginals, pair counts and the best labelling against all labellings of short chains."""
    most = max(map(len, chains))
    score = np.array([c + [9.0] * (most - len(c)) for c in chains])
    p, pairs = marginals(score, np.array([len(c) for c in chains]), (a0, a1))
    want = np.zeros(2)
    for k, c in enumerate(chains):
        weigh = {}
        for y in itertools.product((0, 1), repeat=len(c)):
            before = (1, *y[:-1])
            weigh[y] = sum(s + (a0, a1)[b] for s, b, v in zip(c, before, y) if v)
        total = np.logaddexp.reduce(list(weigh.values()))
        for t in range(len(c)):
            assert abs(p[k, t] - sum(np.exp(w - total) for y, w in weigh.items() if y[t])) < 1e-6
        for y, w in weigh.items():
            for b, v in zip((1, *y[:-1]), y):
                want[b] += v * np.exp(w - total)
        best = decode(c, (a0, a1))
        assert abs(weigh[tuple(int(t in best) for t in range(len(c)))] - max(weigh.values())) < 1e-9
    assert np.allclose(pairs, want, atol=1e-6)


def test_unmarked_stretches():
    """Trained on text with its marks stripped, the second field cuts held-out text without marks; a short stretch stays whole."""
    rng = random.Random(6)
    who, did, what = ["老船夫", "守塔人", "小账房", "邻家女"], ["昨夜放下了", "清晨找到了", "忽然丢掉了"], ["那只木桨", "一封旧信", "两枚铜钱"]
    make = lambda: "".join(rng.choice(x) for x in (who, did, what))
    tagger = Tagger().fit_bare(["。".join(make() for _ in range(8)) + "。" for _ in range(60)])
    parts = [make() for _ in range(9)]
    text = "".join(parts)
    assert [text[a:z] for a, z in tagger.sentences(text)] == parts
    assert len(tagger.sentences(parts[0])) == 1 and len(Tagger().sentences(text)) == 1


# --- problem 2


def brute_pieces(elements: list[str], limit: int, overlap: int) -> list[tuple[int, int]]:
    text, out, start = "".join(elements), [], 0
    ends, at = set(), 0
    for e in elements:
        at += len(e)
        if e:
            ends.add(at)
    while len(text) - start > limit:
        window = range(start + limit, start + overlap, -1)
        end = next((p for p in window if p in ends), None) or next((p for p in window if text[p - 1] in SEPARATORS), None) or start + limit
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text("ab。, \n", max_size=30), max_size=12), st.integers(5, 40), st.integers(0, 4))
def test_pack_like_brute_force(elements, limit, overlap):
    text = "".join(elements)
    got = pack(len(text), boundary_levels(elements, SEPARATORS), limit, overlap)
    assert got == brute_pieces(elements, limit, overlap)
    assert text == text[got[0][0] : got[0][1]] + "".join(text[a + overlap : z] for a, z in got[1:])


def test_split_on_chunks(spark):
    long = ["甲" * 400 + "。", "", None, "乙" * 500]
    rows = [(1, 10, long), (1, 10, long), (2, None, long), (3, 0, ["短"]), (4, 0, None), (5, 0, [])]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_start_index int, source_sentences array<string>")
    got = sorted(tuple(r) for r in split_oversized(chunks).collect())
    assert got == [(1, 0, 0, 401, 10, 11), (1, 1, 341, 901, 10, 14), (2, 0, 0, 401, None, None), (2, 1, 341, 901, None, None)]
    with pytest.raises(ValueError):
        split_oversized(chunks, 10, 10)


# --- problem 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cf", "Zs", "Cn", "Co")), max_size=12), max_size=6))
def test_composition_is_canonical(texts):
    kept = [t for t in texts if all(unicodedata.normalize("NFKC", c) == unicodedata.normalize("NFC", c) and c not in lookalikes.HYPHENS + lookalikes.INVISIBLE + "\t" and not 0xFE00 <= ord(c) <= 0xFE0F and not 0xE0100 <= ord(c) <= 0xE01EF for c in t)]
    got = one_form(pa.array(kept, pa.string()), ()).to_pylist()
    assert [unicodedata.normalize("NFC", g) for g in got] == [unicodedata.normalize("NFC", t) for t in kept]


def test_one_form_cases(spark):
    shapes = tuple(sorted(same_shapes(spark).items()))
    texts = ["Ｍａｒｔｈａ", "été", "a​b­c", "x y　z", "Соrа", "⽩", "well‑known", "ｶﾞ", None, "", "①", "a\nb", "İ"]
    want = ["Martha", "été", "abc", "x y z", "Cora", "白", "well-known", "ガ", None, "", "①", "a\nb", "İ"]
    got = one_form(pa.array(texts, pa.string()), shapes).to_pylist()
    assert got[:5] + got[5:7] + got[8:] == want[:5] + want[5:7] + want[8:]
    assert one_form(pa.array(["ｶﾞ", "ガ"]), shapes).to_pylist()[0] == one_form(pa.array(["ガ"]), shapes).to_pylist()[0]


def test_unstable_class_covers_the_tables(spark):
    shapes = tuple(sorted(same_shapes(spark).items()))
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    changed = [c for c, f in zip(every, one_form(pa.array(every), shapes).to_pylist()) if c != f]
    assert changed and lookalikes._unstable(shapes)[[ord(c) for c in changed]].all()
    spaces = spark.createDataFrame([(c,) for c in every], "c string").where(F.regexp_replace("c", r"(?U)^\s+", "") == "").collect()
    assert {r.c for r in spaces} == set(lookalikes.WHITE)


def test_same_look_pairs(spark):
    rows = [("f", 1, "Cora"), ("f", 1, "Соra"), ("f", 1, "Co​ra"), ("f", 1, "cora"), ("f", 2, "Соra"), ("f", 1, None), ("f", 1, ""), ("f", 1, "Cora"), ("g", 1, "Co​ra")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "field_name string, book_id long, text string, form string")
    got = {(r.text_a, r.text_b) for r in same_look_pairs(df.select("field_name", "book_id", "text"), ["field_name", "book_id"]).collect()}
    assert got == {("Cora", "Co\u200bra"), ("Cora", "Соra"), ("Co\u200bra", "Соra")}


# --- problem 5


def brute_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out: dict[int, int] = {}
    for n in sorted(near):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


def test_components(spark):
    rng = random.Random(3)
    order = list(range(60))
    rng.shuffle(order)
    chain = list(zip(order, order[1:]))
    other = [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    star = [(200, 200 + k) for k in range(1, 50)]
    edges = [e for e in chain + other + star if e[0] != e[1]]
    df = spark.createDataFrame([*edges, *edges[:9], *[(b, a) for a, b in edges[:9]], (7, 7), (None, 3), (5, None)], "u long, v long")
    assert {r.node: r.label for r in connected_components(df).collect()} == brute_components(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_star_edges_tie_all_members(spark):
    rows = [(1, "hot", n) for n in range(300)] + [(1, "a", 500), (1, "a", 501), (1, "b", 600), (2, "a", 700)]
    edges = star_edges(spark.createDataFrame(rows, "g long, s string, n long"), ["g", "s"], "n")
    found = brute_components([(r.u, r.v) for r in edges.collect()])
    assert {n for n, c in found.items() if c == 0} == set(range(300)) and found[501] == 500 and len(found) == 302
    most = max(r["count"] for r in edges.groupBy("v").count().collect())
    assert most < 60


# --- problem 6


def brute_osa(a: str, b: str) -> int:
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=10), min_size=1, max_size=8, unique=True), st.lists(st.text("abc", min_size=1, max_size=10), min_size=1, max_size=4, unique=True))
def test_trie_join_like_brute_force(known, typed):
    """Names within the known one's errors meet in a shard, and the automata find just them there."""
    number: dict = {}
    have = [(number.setdefault(x, len(number)), w) for w in known for x in sorted(shards(w, errors(w)))]
    asked = [(number.setdefault(x, len(number)), w) for w in typed for x in sorted(shards(w, 2))]
    got: dict = {}
    for i, j, e in zip(*nearby(have, asked)):
        pair = (asked[i][1], have[j][1])
        got[pair] = min(int(e), got.get(pair, 9))
    want = {(t, k): brute_osa(t, k) for t in typed for k in known if brute_osa(t, k) <= errors(k)}
    assert got == want


def test_link_probes(spark):
    """Short names, two errors, five tokens in another order, ideographs with one character wrong."""
    known = [(1, "Odell", "a"), (1, "Bram", "b"), (1, "Katherine Blackwood", "c"), (1, "Maria de la Cruz Lopez", "d"), (1, "欧阳明远山", "e"), (1, "Li", "f"), (2, "Odell", "z")]
    links = {"Odel": "a", "Odelll": "a", "Brmm": "b", "Braam": "b", "Kathrine Blackwod": "c", "Blackwod Kathrine": "c", "Lopez Cruz la de Maria": "d", "Lopez Cruz la de Marya": "d", "欧阳明元山": "e", "欧阳远明山": "e"}
    none = ["Lu", "Kathrin Blackwd", "Brrmm", "欧明远"]
    k = spark.createDataFrame(known, "book_id long, name string, role_id string")
    t = spark.createDataFrame([(1, n) for n in [*links, *none]], "book_id long, name string")
    assert {r.name: r.role_id for r in link_names(k, t).collect()} == links
    assert {r.name: r.role_id for r in link_names(k, t, batch=3).collect()} == links


def test_recall_by_errors(spark):
    """Random names with one and two errors anywhere come back to their role, all of them."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(rng.choice(letters) for _ in range(n)).capitalize() + " " + "".join(rng.choice(letters) for _ in range(n)).capitalize() for n in range(4, 10) for _ in range(20)]

    def wrong(name: str) -> str:
        i = rng.randrange(len(name))
        while name[i] == " ":
            i = rng.randrange(len(name))
        return rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice(letters) + name[i + 1 :], name[:i] + rng.choice(letters) + name[i:]])

    k = spark.createDataFrame([(1, n, str(i)) for i, n in enumerate(names)], "book_id long, name string, role_id string")
    one = [(wrong(n), str(i)) for i, n in enumerate(names)]
    two = [(wrong(wrong(n)), str(i)) for i, n in enumerate(names)]
    got = {r.name: r.role_id for r in link_names(k, spark.createDataFrame([(1, n) for n, _ in one + two], "book_id long, name string")).collect()}
    assert all(n in names or got.get(n) == i for n, i in one + two)


def test_link_names(spark):
    known = [(1, "Yorrick Mossbridger", "r1"), (1, "Ambrosel Holt", "r2"), (1, "晏雁岚", "r3"), (1, "笪洲白", "r4"), (1, "昝荻卿", "r5"), (1, "昝维铃", "r6"), (2, "Yorrick Mossbridger", "r9"), (1, None, "r7"), (None, "Xx Yy", "r8"), (1, "Twin Same", "t1"), (1, "Twim Same", "t2")]
    links = {
        "Yorrik Mossbridger": "r1", "YORRICK MOSSBRIDGER": "r1", "Mossbridger, Yorrick": "r1", "Yorric kMossbridger": "r1", "Y. Mossbridger": "r1", "Capt. Mossbridger": "r1", "Yorｒick Mossbridger": "r1", "Brose Holt": "r2",
        "晏砚岚": "r3", "晏岚雁": "r3", "晏雁岚岚": "r3", "晏·雁岚": "r3", "老晏": "r3", "Yan Yanlan": "r3", "笪洲": "r4", "洲白兄": "r4", "昝荻卿道友": "r5",
    }
    others = ["Yorrick Mossbridger", "Yorrick Mossstowe", "昝公子", "郗溪淮", "Twi Same", "", " ", None]
    k = spark.createDataFrame([(*r, 1) for r in known], "book_id long, name string, role_id string, rank int")
    t = spark.createDataFrame([(1, n, "x") for n in [*links, *others, "晏砚岚"]] + [(None, "Yorrik Mossbridger", "x")], "book_id long, name string, way string")
    got = {r.name: r.role_id for r in link_names(k.select("book_id", "name", "role_id"), t.select("book_id", "name")).collect()}
    if not NameForms({}).sound:  # without sounds in the JVM those ways are not offered
        pass
    assert got == links
    assert link_names(k.select("book_id", "name", "role_id").limit(0), t.select("book_id", "name")).count() == 0


# --- problem 7


def test_survivors(spark):
    D = lambda n: dt.datetime(2025, 1, n)
    rows = [
        ("a", 1, "甲", "短", ["x", "x ", " x"], " Editor_Desk ", D(1)),
        ("a", 2, "未知", "更长的 　 描述", ["x", "y"], "wiki", D(2)),
        ("a", 3, "乙", "n/a", None, None, D(3)),
        ("a", 3, "乙", "n/a", None, None, D(3)),
        ("b", 4, "丙", "一", [], "wiki", D(1)),
        ("b", 4, "丙", "一", [], "wiki", D(1)),
        ("c", 5, "？？？", None, ["—", None, ""], "wiki", D(1)),
        ("c", 6, " ", "TBD", [], "wiki", D(2)),
        ("d", 7, "丁", "同长", ["p"], "other", None),
        ("d", 8, "丁二", "长同", ["q"], None, None),
        (None, 9, "戊", "x", [], "wiki", D(1)),
    ]
    roles = spark.createDataFrame([(*r, 5) for r in rows], "id string, record_id long, canonical_name string, description string, original_descriptions array<string>, record_source string, updated_at timestamp, trust_rank int")
    trust = spark.createDataFrame([("editor_desk", 1), ("wiki", 2)], "record_source string, trust_rank int")
    got = {(r.id, r.field_name): r.record_id for r in surviving_records(roles, trust).collect()}
    assert got == {("a", "canonical_name"): 1, ("a", "description"): 2, ("a", "original_descriptions"): 2, ("d", "canonical_name"): 7, ("d", "description"): 7, ("d", "original_descriptions"): 7}
    assert surviving_records(roles.limit(0), trust).count() == 0


def test_fusion_of_lists_and_unknown_sources(spark):
    rows = [
        (1, "r1", "Ann", "d", ["first note", "second  note"], None, "2024-01-01"), (2, "r1", "Ann", None, ["second note"], " ", "2024-01-02"), (3, "r1", "Bob", None, None, None, "2024-01-03"),
        (4, "r1", None, None, ["second note", "", None], "Desk", "2024-01-03"), (5, None, "x", "y", ["z"], None, "2024-01-01"),
    ]
    d = spark.createDataFrame(rows, "record_id long, id string, canonical_name string, description string, original_descriptions array<string>, record_source string, updated_at string")
    claims = field_claims(d)
    assert {r.source for r in claims.collect()} == {"record:1", "record:2", "record:3", "s:desk"}
    got = {(r.field_name.split("\x1f")[0], r.value): r.posterior for r in fuse_values(claims).collect()}
    assert set(got) == {("canonical_name", "Ann"), ("description", "d"), ("original_descriptions", "first note"), ("original_descriptions", "second note")}
    assert got["original_descriptions", "second note"] > got["original_descriptions", "first note"]


def test_fusion_discounts_copies(spark):
    """Three sources copy each other's mistakes; two independent good ones are fewer and still win."""
    rng = random.Random(11)
    rows = []
    for n in range(120):
        right = f"right{n}"
        for s, p in (("good1", 0.9), ("good2", 0.85)):
            rows.append((n, "f", s, right if rng.random() < p else f"slip{rng.randrange(10)}", 1))
        lie = right if rng.random() < 0.35 else f"lie{rng.randrange(10)}"
        rows += [(n, "f", s, lie, 1) for s in ("copy1", "copy2", "copy3")]
    rows += [(0, "f", "good1", "older", 0), (500, "f", "good1", None, 1), (501, "f", None, "x", 1), (502, "f", "copy1", "only", 1)]
    claims = spark.createDataFrame(rows, "object_id long, field_name string, source string, value string, claim_order int")
    got = {r.object_id: r.value for r in fuse_values(claims).collect()}
    both_right = [n for n in range(120) if sum(r[0] == n and r[2].startswith("good") and r[3] == f"right{n}" for r in rows if r[2]) == 2]
    assert np.mean([got[n] == f"right{n}" for n in both_right]) > 0.95
    assert got[502] == "only" and 500 not in got and 501 not in got
    assert fuse_values(claims.limit(0)).count() == 0


# --- problem 8


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.sampled_from(" '\n\tstrevmld1中文ё"), st.characters(exclude_categories=("Cs",))), max_size=40)), max_size=6))
def test_bpe_like_the_library(texts):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = bpe.vocabulary(VOCAB)
    t = tokenizers.Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    got = bpe.encode_texts(pa.array(texts, pa.string()), vocab).to_pylist()
    for text, ids in zip(texts, got):
        if text is None:
            assert ids is None
        else:
            if all(unicodedata.category(c) != "Cn" for c in text):
                assert ids == t.encode(text, add_special_tokens=False).ids
            assert vocab.decode(np.array(ids, np.int64)).decode() == text


@needs_vocabulary
def test_bpe_frames(spark):
    docs = spark.createDataFrame([(1, "a lamp", 0), (2, "", 0), (3, None, 0), (4, "中" * 40_000 + " <|endoftext|>", 0), (1, "a lamp", 0)], "doc_id long, text string, ids int")
    got = bpe.encode_corpus(docs, slice_bytes=64).collect()
    by = {r.doc_id: r.ids for r in got}
    assert len(got) == 5 and by[2] == [] and by[3] is None and 50256 not in by[4] and bpe.decode_ids(by[4]) == "中" * 40_000 + " <|endoftext|>"
    assert bpe.encode_corpus(docs.limit(0)).count() == 0


# --- problem 9


def test_winnowing_guarantee():
    """Every shared span of window + k - 1 letters has a common fingerprint."""
    rng = random.Random(5)
    alphabet = "甲乙丙丁戊己庚辛壬癸子丑寅卯"
    for _ in range(60):
        shared = "".join(rng.choice(alphabet) for _ in range(13))
        sides = ["".join(rng.choice(alphabet) for _ in range(20)) + shared + "".join(rng.choice(alphabet) for _ in range(20)) for _ in range(2)]
        marks = [set(fingerprints(*letters_of(pa.array([s])), 8, 22, 6)[1].tolist()) for s in sides]
        assert marks[0] & marks[1]


def test_leaks(spark):
    rng = random.Random(7)
    zh = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(150))
    en = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    noise = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    changed = zh[:40] + "某" + zh[41:75] + "，" + zh[75:110]
    docs = [
        (1, noise + zh + noise), (2, noise[:50] + changed), (3, zh[:25] + noise), (4, en.upper().replace(" ", ", ")), (5, None), (6, ""), (7, noise), (8, zh[:40] + noise + zh[100:145]),
        (1, noise + zh + noise), (9, zh + en),
    ]
    items = [(1, zh), (2, en), (3, None), (4, ""), (5, "短"), (1, zh)]
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, share int")
    want = {(1, 1), (2, 1), (4, 2), (8, 1), (9, 1), (9, 2)}
    assert {(r.doc_id, r.item_id) for r in find_leaks(d.select("doc_id", "text"), i).collect()} == want
    assert {(r.doc_id, r.item_id) for r in find_leaks(d.select("doc_id", "text"), i, block_chars=100, slice_bytes=500).collect()} == want
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_leaks_with_replaced_words():
    """Recall at one word in five and one ideograph in eight replaced, at random; shared phrases alone are no leak."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    zh = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(90, 300))) for _ in range(60)]
    en = [[rng.choice(vocabulary) for _ in range(rng.randrange(40, 120))] for _ in range(60)]
    index = ItemIndex(list(range(120)), zh + [" ".join(w) for w in en], 5, 14, 3)
    docs = ["前言" + "".join(c if rng.random() > 1 / 8 else chr(0x4E00 + rng.randrange(3000)) for c in t) + "后记" for t in zh]
    docs += ["so " + " ".join(w if rng.random() > 1 / 5 else rng.choice(vocabulary) for w in ws) + " end" for ws in en]
    row, item, _ = leaks(pa.array(docs), index, 5, 14, 3, 0.2, 0.5)
    got = set(zip(row.tolist(), item.tolist()))
    assert got <= {(n, n) for n in range(120)}
    assert sum(n < 60 for n, _ in got) >= 54 and sum(n >= 60 for n, _ in got) >= 54
    pieces = ["".join(w[i : i + 12] + "某某某某某某某某某某某某某某某某某某某某" for i in range(0, len(w), 40)) for w in zh]
    assert not len(leaks(pa.array(pieces), index, 5, 14, 3, 0.2, 0.5)[0])


def test_leak_behind_a_refrain():
    """A passage is found among many repetitions of a phrase of the item, in any order."""
    rng = random.Random(4)
    refrain = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9))
    rest = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(14)) for _ in range(9)]
    item = refrain.join(rest)
    changed = "".join(c if n % 11 else "某" for n, c in enumerate(item))
    index = ItemIndex([7], [item], 5, 14, 3)
    assert leaks(pa.array([refrain * 40 + changed + refrain * 40, refrain * 60]), index, 5, 14, 3, 0.2, 0.5)[0].tolist() == [0]


# --- problem 10


def test_flags(spark):
    rows = [
        (1, "天亮了。什么甲乙丙脑子进了水，滚远点。", "s"), (2, "他*一*肚*子*坏水！", "s"), (3, "外乡人生来丨就丨低丨人一等。", "t"), (4, "$hut y0ur f1lthy m0uth, T1ll, n0b0dy w@nt$ y0ur g@rb@g3 h3r3.", "t"),
        (5, "The c*****n paid two courtesans and licked the sweat from bare t****s.", None), (6, "Dooo us aaall a favour, Ed, and stoop breathing!", "s"), (7, "评论里骂人废物的一律删除，请大家好好说话。", "s"),
        (8, "斗棋时他说了句去死吧，便吃掉了对方的马。", "s"), (9, "Der Arzt untersuchte die nackte Brust.", "s"), (10, None, "s"), (11, "", "s"), (12, "  ", "s"), (13, "平安无事。" * 3000, "s"),
        (14, "掌柜与寡妇脱光了衣服，在床上交欢到天亮。你这个废物，活着就是浪费粮食。", "t"), (1, "天亮了。什么甲乙丙脑子进了水，滚远点。", "s"), (15, "亖んでしまえ、お前なんか誰も必要としていない！", "t"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, category string")
    found = flag_documents(docs, slice_bytes=200)
    got = {(r.doc_id, r.category) for r in found.collect()}
    assert got == {(1, "abuse"), (2, "abuse"), (3, "hate"), (4, "abuse"), (5, "sexual"), (6, "abuse"), (14, "sexual"), (14, "abuse"), (15, "abuse")}
    rates = {(r.source, r.category): (r.n_docs, r.n_found) for r in rates_by_source(docs, found).collect()}
    assert rates[("t", "abuse")] == (4, 3) and rates[(None, "sexual")] == (1, 1) and rates[("s", "hate")][1] == 0
    assert flag_documents(docs.limit(0)).count() == 0


def test_masked_and_misspelled_short_terms(spark):
    hit = [
        "f**k you, he said.", "So fu** you.", "f*ck you", "fcuk you", "fuk you", "You fuck yuo", "他满嘴喷糞。", "你这王*蛋", "这个傻比", "他满**粪。", "一群王八旦", "r*t in a d**ch, y**r f*lthy m**th: n**ody w**ts y**r ga**age h**e",
        "傻*逼",
    ]
    clean = [
        "good luck you two", "the truck you drove", "不要连累他。", "又脏又乱", "我**了", "见人就笑", "王**你", "a****************************************b", "这是**重点**内容，一*二*三", "大人*你来了",
    ]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(hit + clean)], "doc_id long, text string")
    assert {r.doc_id for r in flag_documents(docs).collect()} == set(range(len(hit)))


def osa(a: str, b: str) -> int:
    """Edits and exchanges of neighbours from a to b."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


TERMS = ("abcdab", "acbdabcdabcd", "bcad", "cadbca*", "dcbadcbadcb*")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=16), min_size=1, max_size=5))
def test_words_like_brute_force(words):
    """The automata of all words at once, walked over the trie, against edit distances; the first letter stays."""
    m = abuse.Matcher({"INS": " ".join(TERMS)})
    stream = np.array([ord(c) for w in words for c in w], np.uint32)
    end = np.cumsum([len(w) for w in words])
    who, _, term, _ = m.words.walk(stream, end - [len(w) for w in words], end, m.word_stem)
    want = set()
    for n, w in enumerate(words):
        for k, t in enumerate(TERMS):
            bare = t.rstrip("*")
            most = (len(bare) >= 6) + (len(bare) >= 11)
            heads = [w[:i] for i in range(1, len(w) + 1)] if t.endswith("*") else [w]
            near = min(osa(bare[1:], h[1:]) if h[0] == bare[0] else 99 for h in heads)
            if near <= most:
                want.add((n, k))
    # an exchange with the first letter is none, and neither is one that begins after it
    assert set(zip(who.tolist(), term.tolist())) == want


def test_fit_moves_and_holds():
    """The weights follow the labels; a wrong verdict does not turn them; no labels leave the prior."""
    bit = {c: 1 << i for i, c in enumerate(abuse.CLASSES)}
    doc, bits, verdicts = [], [], {}
    for n in range(200):
        verdicts[n] = {"abuse"} if n % 4 == 0 else {"clean"}
        doc += [n, n]
        bits += [bit["SHUT"] | bit["QUO"] if n % 4 == 0 else bit["SHUT"], bit["GRP"]]
    verdicts[1] = {"hate"}
    w = abuse.fit(np.array(doc), np.array(bits, np.int64), verdicts)
    score = abuse.design(np.array([bit["SHUT"] | bit["QUO"], bit["SHUT"]], np.int64)) @ w.T
    assert score[0, 0] > score[1, 0] and (abuse.design(np.array([bit["SHUT"] | bit["QUO"]], np.int64)) @ abuse.prior().T)[0, 0] < score[0, 0]
    assert np.array_equal(abuse.fit(np.array(doc), np.array(bits, np.int64), {}), abuse.prior())


def test_fit_reviewed(spark):
    docs = spark.createDataFrame([(1, "You worthless idiot, shut up."), (2, "The sun rose."), (3, None), (2, "The sun rose."), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, " Abuse "), (2, 2, "clean"), (3, 3, "clean"), (4, None, "clean"), (5, 9, None)], "label_id long, doc_id long, verdict string")
    model = abuse.fit_reviewed(docs, labels)
    assert model.weights.shape == abuse.prior().shape
    assert {(r.doc_id, r.category) for r in flag_documents(docs, model).collect()} == {(1, "abuse")}
    assert np.array_equal(abuse.fit_reviewed(docs, labels.limit(0)).weights, abuse.prior())
    assert abuse.fit_reviewed(docs, labels, sample=1).weights.shape == abuse.prior().shape


def test_unseen_sentences(spark):
    """Sentences in seven languages written apart from the lexicon, with harmless ones that look alike."""
    found = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(FOUND)], "doc_id long, text string")
    got = {(r.doc_id, r.category) for r in flag_documents(found).collect()}
    assert sum((n, c) in got for n, (c, _) in enumerate(FOUND)) >= 0.9 * len(FOUND)
    calm = spark.createDataFrame(list(enumerate(HARMLESS)), "doc_id long, text string")
    assert flag_documents(calm).select("doc_id").distinct().count() <= 0.1 * len(HARMLESS)
