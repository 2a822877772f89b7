"""Linking variant spellings of names to the role they mean (problem 6).

Known and typed names are folded (case, width, accents, look-alikes, invisible characters, separators) and joined by tries. A
word gives the spellings of its first five letters with up to as many left out as it may have errors; two words within that
many errors have one of these in common, so they are its shards, small ones, and a name of any length meets its variants. In
each shard the Levenshtein automata of the typed names are walked over the trie of the known ones, all shards of a batch at
once, with an exchange of neighbours as one error: two errors from eight letters on, one from four. Known names stand in every
order of their tokens, from five tokens on both sides in sorted order. Names in ideographs go the same way; of up to three, an
error counts only if both characters sound alike or neighbours are exchanged.

What is no small edit has keys that both sides give: abbreviated first names, titles with a last name, parts of Chinese names,
forms of address, names of one sound, and names written by sound. Each way has a rank; a name is linked if its best rank leads
to one role only.

Defined cases: null, blank and stand-in names are none; a name equal to a known one of its book is none; a name that fits two
roles equally well is left out; null books match nothing; rows delivered twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.llm.letters import letter_table
from sagaloom.llm.tries import Trie

#: Forms of address, before Latin names and after or before Chinese ones.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "doctor", "prof", "capt", "captain", "sir", "lady", "lord", "dame", "old", "young", "master", "madam", "uncle", "aunt", "father", "mother", "brother", "sister", "little", "good", "sgt", "lt", "col", "major", "gen", "rev", "st", "herr", "frau", "mme", "sr", "sra", "don")
AFTER = ("先生", "夫人", "小姐", "姑娘", "公子", "师兄", "师姐", "师弟", "师妹", "师父", "师傅", "师叔", "师伯", "道友", "道长", "前辈", "大人", "大哥", "大姐", "大叔", "大爷", "老爷", "少爷", "少侠", "掌柜", "长老", "宗主", "掌门", "兄弟", "兄台", "娘子", "婆婆", "爷爷", "兄", "哥", "姐", "弟", "妹", "爷", "叔", "伯", "姨", "婶", "公", "君", "氏", "总", "老", "儿")
BEFORE = ("老", "小", "大")
#: Family names that are read otherwise than the character alone.
FAMILY_SOUNDS = {
    "郗": "chi", "钭": "tou", "缪": "miao", "单": "shan", "解": "xie", "仇": "qiu", "区": "ou", "查": "zha", "曾": "zeng", "任": "ren", "朴": "piao", "盖": "ge", "翟": "zhai",
    "覃": "qin", "乐": "yue", "员": "yun", "黑": "he", "秘": "bi", "折": "she", "召": "shao", "祭": "zhai", "隗": "wei", "种": "chong", "洗": "xian", "繁": "po", "逄": "pang", "佴": "nai",
}


def sounds(spark: SparkSession) -> dict[str, str]:
    """The sound of each common ideograph without tone, by the transliterator of Spark's ICU; without it this fails."""
    every = [chr(c) for c in range(0x4E00, 0xA000)]
    to_latin = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")
    heard = to_latin.transliterate("\n".join(every)).split("\n")
    if len(heard) != len(every):
        raise RuntimeError("the transliterator of this ICU changes the number of lines")
    return {c: h for c, h in zip(every, heard) if h.isascii() and h.isalpha()}


class NameForms:
    """Keys of names. A key is (rank, key, extra): sides meet on the key, and the typed side's extra begins the known side's."""

    def __init__(self, sound: dict[str, str]):
        self.sound = sound
        self.fold = letter_table(keep="L", latin=True)
        self.breaks = {ord(c) for c in " ,.·・;/\t\n　     "}

    def tokens(self, name: str) -> list[str]:
        """Folded tokens; everything that is neither letter nor break is dropped."""
        out, now = [], []
        for c in name:
            f = int(self.fold[ord(c)])
            if f:
                now.append(chr(f))
            elif ord(c) in self.breaks and now:
                out.append("".join(now))
                now = []
        return out + ["".join(now)] if now else out

    def heard(self, name: str) -> str | None:
        got = [self.sound.get(c) for c in name]
        return "-".join(got) if all(got) else None

    def spellings(self, tokens: list[str]) -> list[tuple[int, str]]:
        """(rank, letters): the tokens in their order and in any other; of five and more, in their order and in sorted order."""
        orders = permutations(tokens) if len(tokens) <= 4 else (tokens, sorted(tokens))
        return list({s: (r, s) for r, s in reversed([(int(n > 0), "".join(o)) for n, o in enumerate(orders)])}.values())

    def known(self, name: str) -> Iterator[tuple[str, int, str, str]]:
        """(way, rank, key, extra) of a known name."""
        t = self.tokens(name)
        joined = "".join(t)
        if not joined:
            return
        if all("㐀" <= c < "ꀀ" for c in joined):
            yield "trie", 0, joined, ""
            if h := self.heard(joined):
                yield "key", 20, "p:" + h, ""
            if 2 <= len(joined) <= 4:
                cut = 2 if len(joined) == 4 else 1
                family, given = joined[:cut], joined[cut:]
                if len(given) == 2:
                    yield "key", 40, "c:" + family + given[0], ""
                    yield "key", 40, "c:" + family + given[1], ""
                    yield "key", 40, "c:" + given, ""
                yield "key", 50, "o:" + family, ""
                yield "key", 50, "a:" + given[-1], ""
                g = (self.heard(given) or "").replace("-", "")
                for f in {(self.heard(family) or "").replace("-", ""), FAMILY_SOUNDS.get(family, "")} - {""} if g else ():
                    yield "key", 30, "j:" + f + g, ""
                    yield "key", 30, "j:" + g + f, ""
            return
        for r, s in self.spellings(t):
            yield "trie", 5 * r, s, ""
        if len(t) >= 2 and t[0] not in TITLES:
            yield "key", 30, "l:" + t[-1], "".join(t[:-1])
            yield "key", 50, "s:" + t[0], ""

    def typed(self, name: str) -> Iterator[tuple[str, int, str, str]]:
        """(way, rank, key, extra) of a typed name."""
        t = self.tokens(name)
        joined = "".join(t)
        if not joined:
            return
        if all("㐀" <= c < "ꀀ" for c in joined):
            stems = {joined: 0}
            for a in AFTER:
                if joined.endswith(a) and len(joined) > len(a):
                    stems.setdefault(joined[: -len(a)], 1)
            if len(joined) > 2 and joined[-1] == joined[-2]:
                stems.setdefault(joined[:-1], 1)
            for stem, r in stems.items():
                if len(stem) >= 2:
                    yield "trie", r, stem, ""
                    yield "key", r, "c:" + stem, ""
                    if h := self.heard(stem):
                        yield "key", r, "p:" + h, ""
                elif r:
                    yield "key", r, "o:" + stem, ""
            if len(joined) == 2 and joined[0] in BEFORE:
                yield "key", 0, "o:" + joined[1], ""
            if joined[0] in "阿小" and len(joined) == 2:
                yield "key", 0, "a:" + joined[1], ""
            if joined[0] == "小" and len(joined) == 3:
                yield "key", 1, "c:" + joined[1:], ""
            return
        yield "trie", 0, joined, ""
        if len(t) > 4:
            yield "trie", 1, "".join(sorted(t)), ""
        yield "key", 0, "j:" + joined, ""
        if len(t) >= 2 and t[0] in TITLES:
            yield "key", 20, "l:" + t[-1], ""
            yield "trie", 1, "".join(t[1:]), ""
        elif len(t) >= 2:
            yield "key", 0, "l:" + t[-1], "".join(t[:-1])
            yield "key", 1, "l:" + t[0], "".join(t[1:])
        elif len(t) == 1 and len(joined) >= 4:
            yield "key", 25, "l:" + joined, ""
            yield "key", 5, "s:" + joined, ""


def errors(word: str) -> int:
    """How many errors a name of these letters may have."""
    return (len(word) >= (2 if _ideographs(word) else 4)) + (len(word) >= 8)


def _ideographs(word: str) -> bool:
    return all("㐀" <= c < "ꀀ" for c in word)


def shards(word: str, most: int, head: int = 5) -> set[str]:
    """Its first letters with up to most of them left out: words within most errors of each other share one."""
    first = word[:head]
    return {"".join(c for i, c in enumerate(first) if i not in out) for k in range(most + 1) for out in combinations(range(len(first)), k)}


def nearby(known: list[tuple[int, str]], typed: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of typed and known (shard, word) that share a shard and are within the known word's errors, and the errors."""
    listed: dict[tuple[int, ...], int] = {}
    which = np.array([listed.setdefault((shard + 3, *map(ord, word)), len(listed)) for shard, word in known], np.int64)
    trie = Trie([(w, errors("".join(map(chr, w[1:]))), 0) for w in listed])
    stream = np.array([c for shard, word in typed for c in (shard + 3, *map(ord, word))], np.uint32)
    end = np.cumsum([len(word) + 1 for _, word in typed])
    who, _, word, err = trie.walk(stream, end - [len(w) + 1 for _, w in typed], end, np.zeros(len(listed), bool))
    order = np.argsort(which, kind="stable")
    lo, hi = np.searchsorted(which[order], word, "left"), np.searchsorted(which[order], word, "right")
    many = hi - lo
    pick = order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    return np.repeat(who, many), pick, np.repeat(err, many)


def pet_name(short: Column, full: Column) -> Column:
    """Whether short may be a pet name of the first name full: a part of it, a new end on its beginning, or an N before it."""
    n = F.length(short)
    inside = (n >= 3) & full.contains(short)
    new_end = n.between(3, 6) & (F.length(full) > n) & (F.substring(short, 1, 2) == F.substring(full, 1, 2))
    with_n = (n >= 3) & short.startswith("n") & full.startswith(short.substr(F.lit(2), n))
    return inside | new_end | with_n


def link_names(known: DataFrame, typed: DataFrame, batch: int = 100_000) -> DataFrame:
    """book_id, name, role_id: typed (book_id, name) linked to the one role of known (book_id, name, role_id) it means."""
    spark = known.sparkSession
    known = known.where("book_id is not null and role_id is not null and trim(name) <> ''").distinct()
    typed = typed.where("book_id is not null and trim(name) <> ''").distinct().join(known.select("book_id", "name"), ["book_id", "name"], "left_anti")
    sound = sounds(spark)  # one entry per ideograph of one block: bounded
    schema = "book_id long, name string, role_id string, way string, rank int, key string, extra string, word string"

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = NameForms(sound)
        for b in batches:
            rows: list[tuple] = []
            for book, name, role in zip(b["book_id"].to_pylist(), b["name"].to_pylist(), b["role_id"].to_pylist()):
                for way, rank, key, extra in make.typed(name) if role is None else make.known(name):
                    if way == "trie":
                        most = (1 if _ideographs(key) else 2) if role is None else errors(key)
                        rows += [(book, name, role, way, rank, s, "", key) for s in shards(key, most)]
                        if role is not None and not _ideographs(key):
                            rows.append((book, name, role, "key", rank + 5, "j:" + key, "", ""))
                    else:
                        rows.append((book, name, role, way, rank, key, extra, ""))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["book_id", "name", "role_id", "way", "rank", "key", "extra", "word"])

    k = known.select("book_id", "name", "role_id").mapInArrow(forms, schema)
    t = typed.select("book_id", "name", F.lit(None).cast("string").alias("role_id")).mapInArrow(forms, schema)
    met = (
        t.where("way = 'key'")
        .select("book_id", "key", "name", F.col("rank").alias("_r"), F.col("extra").alias("_begins"))
        .join(k.where("way = 'key'").select("book_id", "key", "role_id", "rank", "extra"), ["book_id", "key"])
        .withColumn("_way", F.when(F.col("extra").startswith(F.col("_begins")), 0).when(pet_name(F.col("_begins"), F.col("extra")), 15))
        .where("_way is not null")
        .select("book_id", "name", "role_id", (F.col("rank") + F.col("_r") + F.col("_way")).alias("rank"))
    )

    def alike(a: str, b: str) -> int | None:
        """The rank of two names in up to three ideographs that differ; none if neither an exchange nor the sound explains it."""
        if sorted(a) == sorted(b):
            return 10
        return 20 if len(a) == len(b) and all(x == y or sound.get(x, x) == sound.get(y, y) for x, y in zip(a, b)) else None

    def join(have: list[tuple], asked: list[tuple]) -> pa.RecordBatch:
        who, which, err = nearby([r[:2] for r in have], [r[:2] for r in asked]) if have and asked else ((), (), ())
        out: set[tuple] = set()
        for i, j, e in zip(who, which, err):
            (_, word, book, name, r), (_, other, role, rank) = asked[i], have[j]
            cost = 12 * int(e)
            if e and len(other) <= 3 and _ideographs(other):
                cost = alike(word, other)
            elif e and _ideographs(other):
                cost = alike(word, other) or 30
            if cost is not None:
                out.add((book, name, role, rank + r + cost))
        return _candidates(list(out))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple] = []
        asked: list[tuple] = []
        now, begun, shard = None, (0, 0), 0
        for b in batches:
            for book, key, role, name, rank, word in zip(*(b[c].to_pylist() for c in ("book_id", "key", "role_id", "name", "rank", "word"))):
                if (book, key) != now:
                    if begun[0] == len(have) or begun[1] == len(asked):  # a shard without one of the sides
                        del have[begun[0] :], asked[begun[1] :]
                    if len(have) + len(asked) >= batch:
                        yield join(have, asked)
                        have, asked, shard = [], [], 0
                    now, begun, shard = (book, key), (len(have), len(asked)), shard + 1
                if role is not None:
                    have.append((shard, word, role, rank))
                else:
                    asked.append((shard, word, book, name, rank))
        yield join(have, asked)

    sides = k.unionByName(t).where("way = 'trie'")
    sharded = sides.repartition("book_id", "key").sortWithinPartitions("book_id", "key")
    near = sharded.mapInArrow(walk, "book_id long, name string, role_id string, rank int")
    ranked = met.unionByName(near).groupBy("book_id", "name", "rank").agg(F.min("role_id").alias("lo"), F.max("role_id").alias("hi"))
    best = ranked.groupBy("book_id", "name").agg(F.min(F.struct("rank", "lo", "hi")).alias("b"))
    return best.where("b.lo = b.hi").select("book_id", "name", F.col("b.lo").alias("role_id"))


def _candidates(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["book_id", "name", "role_id", "rank"])
