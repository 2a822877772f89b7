"""Greedy dictionary matching of names in text: the names go to the texts, which are not shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(text: str, found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(start, alias) of the matches kept: longer aliases first, then by text order of the alias; a match that meets a kept one is
    dropped; occurrences of one alias are taken from left to right without overlap, kept or not."""
    by: dict[str, list[int]] = {}
    for start, alias in found:
        by.setdefault(alias, []).append(start)
    taken = bytearray(len(text))
    out = []
    for alias in sorted(by, key=lambda a: (-len(a), a)):
        n, free = len(alias), 0
        for start in sorted(by[alias]):
            if start < free:
                continue
            free = start + n
            if not any(taken[start : start + n]):
                taken[start : start + n] = b"\x01" * n
                out.append((start, alias))
    return sorted(out)


_TABLES: dict[str, tuple[dict, dict]] = {}


def _machine(token: str, sent: Broadcast, group: object) -> tuple[ahocorasick.Automaton, dict] | None:
    """The automaton of a group's names and their owners by (kind, alias), built once per worker."""
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = (sent.value, {})
    names, made = _TABLES[token]
    if group not in made:
        made[group] = _build(names[group]) if group in names else None
    return made[group]


def _build(names: list[tuple[str, str, str]]) -> tuple[ahocorasick.Automaton, dict]:
    machine, owner = ahocorasick.Automaton(), {}
    for kind, alias, entity in names:
        owner.setdefault(alias, {})[kind] = entity
    for alias in owner:
        machine.add_word(alias, alias)
    machine.make_automaton()
    return machine, owner


def _found(machine: ahocorasick.Automaton, owner: dict, text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, alias, entity, kind) of the matches kept in a text, each kind for itself."""
    by: dict[str, list[tuple[int, str]]] = {}
    for end, alias in machine.iter(text):
        for kind in owner[alias]:
            by.setdefault(kind, []).append((end - len(alias) + 1, alias))
    for kind, hits in by.items():
        for start, alias in greedy(text, hits):
            yield start, alias, owner[alias][kind], kind


def match_names(texts: DataFrame, names: DataFrame, group: str, key: str, carry: tuple[str, ...] = (), most_bytes: int = 64 << 20, salts: int = 64) -> DataFrame:
    """group, key, carry, start, alias, entity, kind for texts (group, key, carry, text) and names (group, alias, entity, kind?).

    Names of different kinds are matched independently. The names are measured first: up to most_bytes they are broadcast and
    the texts stay where they are; beyond, names are sent to each of a group's salts and texts are spread over these, so no group
    is one task. Null and empty texts and aliases match nothing; an alias claimed by several entities of a kind goes to the
    smallest; texts delivered twice give their rows once.
    """
    if "kind" not in names.columns:
        names = names.withColumn("kind", F.lit(""))
    one = names.where((F.length("alias") > 0) & F.col(group).isNotNull()).groupBy(group, "kind", "alias").agg(F.min("entity").alias("entity"))
    texts = texts.where((F.length("text") > 0) & F.col(group).isNotNull()).select(group, key, *carry, "text")
    kept = [f for f in texts.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", start int, alias string, entity string, kind string"
    tail = (("start", pa.int32()), ("alias", pa.string()), ("entity", pa.string()), ("kind", pa.string()))

    def batch(columns: list[pa.Array], rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 4
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in columns), *(pa.array(c, k) for c, (_, k) in zip(cols, tail))], names=[*(f.name for f in kept), *(n for n, _ in tail)])

    size = one.agg(F.sum(F.octet_length("alias") + F.octet_length("entity") + 16)).first()[0] or 0
    if size <= most_bytes:
        table: dict = {}
        for r in one.select(group, "kind", "alias", "entity").collect():  # no more than most_bytes
            table.setdefault(r[0], []).append(tuple(r[1:]))
        sent, token = texts.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[int] = []
                out: list[tuple] = []
                for i, (g, text) in enumerate(zip(b[group].to_pylist(), b["text"].to_pylist())):
                    made = _machine(token, sent, g)
                    if made:
                        for hit in _found(*made, text):
                            rows.append(i)
                            out.append(hit)
                yield batch([b[f.name] for f in kept], rows, out)

        return texts.mapInArrow(look, schema).distinct()

    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept if f.name != group]
    n = one.select(group, *empty, F.lit(None).cast("string").alias("text"), "kind", "alias", "entity", spread)
    t = texts.select(*texts.columns, *(F.lit(None).cast("string").alias(c) for c in ("kind", "alias", "entity")), F.pmod(F.xxhash64(key, *carry), F.lit(salts)).cast("int").alias("_salt"))
    rows_ = n.select(*t.columns).unionByName(t).repartition(group, "_salt").sortWithinPartitions(group, "_salt", F.col("text").isNotNull())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, listed, made = None, [], None
        for b in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for i, (g, salt, text, kind, alias, entity) in enumerate(zip(*(b[c].to_pylist() for c in (group, "_salt", "text", "kind", "alias", "entity")))):
                if (g, salt) != now:
                    now, listed, made = (g, salt), [], None
                if text is None:
                    listed.append((kind, alias, entity))
                elif listed:
                    made = made or _build(listed)
                    for hit in _found(*made, text):
                        rows.append(i)
                        out.append(hit)
            yield batch([b[f.name] for f in kept], rows, out)

    return rows_.mapInArrow(walk, schema).distinct()
