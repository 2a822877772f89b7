"""Rule tables as column expressions: keyword classes with 'first rule wins', weights and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of events by keywords, in order of precedence (parameters of the domain, replaceable by the caller).
EVENT_RULES: list[tuple[str, list[str]]] = [
    ("冲突", ["论剑", "争", "断弦", "摔碎"]),
    ("会见", ["相逢", "夜谈", "渡口"]),
    ("揭示", ["旧账", "真相", "失钥"]),
    ("迁移", ["换船", "船"]),
    ("立势", ["祭典", "钟声"]),
]
#: Weight of each class.
TYPE_WEIGHTS = {"冲突": 6, "揭示": 5, "立势": 5, "师承": 5, "护持": 4, "迁移": 4, "遭遇": 4, "指点": 4, "会见": 3, "等待": 2, "对话": 2, "关系推进": 2, "场景推进": 1, "剧情推进": 1}
#: Labels of phases by keywords.
PHASE_RULES: list[tuple[str, list[str]]] = [("对立", ["论剑", "争", "断"]), ("同行", ["换船", "渡", "船"]), ("交心", ["夜谈", "相逢", "祭"]), ("生疑", ["失钥", "旧账"])]
#: Words for the function of a chapter.
FUNCTION_WORDS: list[tuple[str, list[str]]] = [("开篇", ["初见", "相逢", "抵达"]), ("高潮", ["论剑", "祭典", "大战"]), ("收束", ["离别", "旧账", "归来"])]
#: actions' strengths in the graph.
STRENGTHS = {"冲突": 4, "对峙": 4, "交手": 4, "敌对": 4, "对话": 3, "会见": 3, "同行": 3, "试探": 3, "拜访": 2, "庇护": 2, "归属": 2, "指点": 2, "师承": 2, "等待": 1}


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains; null text contains none."""
    return reduce(lambda a, b: a + b, [F.coalesce(text.contains(w).cast("int"), F.lit(0)) for w in words])


def first_best(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The label of the rule with most hits, the earliest on ties; null without any hit."""
    counts = [hits(text, words) for _, words in rules]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    label = F.lit(None).cast("string")
    for (name, _), n in reversed(list(zip(rules, counts))):
        label = F.when((n == top) & (top > 0), name).otherwise(label)
    return label


def lookup(key: Column, values: dict, default) -> Column:
    """A small map as an expression."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def event_text() -> Column:
    """All texts of an event in a row, parts that are null or empty left out."""
    return F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("name", "description", "significance", "location")))


def event_type() -> Column:
    """The class of an event; without a keyword, by how many take part and whether it has a place."""
    many, placed = F.size("people") >= 2, F.coalesce(F.col("location") != "", F.lit(False))
    return F.coalesce(first_best(event_text(), EVENT_RULES), F.when(many & placed, "会见").when(many, "关系推进").when(placed, "场景推进").otherwise("剧情推进"))


def light_score() -> Column:
    """Weight of the class, up to four participants, a place, a significance."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    return lookup(F.col("event_type"), TYPE_WEIGHTS, 1) + F.least(F.size("people"), F.lit(4)) + has("location") + has("significance")


def sql_hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(CAST(contains({text}, '{w}') AS INT), 0)" for w in words) + ")"


def sql_first_best(text: str, rules: list[tuple[str, list[str]]]) -> str:
    counts = [sql_hits(text, w) for _, w in rules]
    top = "greatest(" + ", ".join(counts) + ")"
    return "CASE WHEN " + top + " = 0 THEN NULL " + " ".join(f"WHEN {n} = {top} THEN '{name}'" for (name, _), n in zip(rules, counts)) + " END"


def sql_lookup(key: str, values: dict, default) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


SQL_TEXT = "concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(significance, ''), nullif(location, ''))"
SQL_TYPE = f"coalesce({sql_first_best(SQL_TEXT, EVENT_RULES)}, CASE WHEN len(people) >= 2 AND location <> '' THEN '会见' WHEN len(people) >= 2 THEN '关系推进' WHEN location <> '' THEN '场景推进' ELSE '剧情推进' END)"
SQL_SCORE = f"({sql_lookup('event_type', TYPE_WEIGHTS, 1)} + least(len(people), 4) + coalesce(CAST(location <> '' AS INT), 0) + coalesce(CAST(significance <> '' AS INT), 0))"
SQL_TYPED = f"typed AS (SELECT *, {SQL_TYPE} AS event_type FROM ev), scored AS (SELECT *, {SQL_SCORE} AS score FROM typed)"
