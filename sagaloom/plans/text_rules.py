"""Queries over texts: splitting, names, keyword rules, windows of sentences, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagaloom.functions.rules import first_best, hits, sql_first_best, sql_hits
from sagaloom.functions.text import BLANK, all_cjk, chinese_number, low_signal, ordered_names, pack_sentences, parse_year, plain_sentences, strip, summary, trim_candidate
from sagaloom.operators.dictionary import match_names
from sagaloom.operators.ranking import best_per
from sagaloom.sources.model import SQL_EVENTS, SQL_LOCATIONS, events, locations, roles
from sagaloom.sources.tables import table

#: Rules of the queries below (parameters of the domain).
ACTION_RULES = [("对话", ["问道", "追问", "低声问", "喊道"]), ("冲突", ["摔碎", "断弦", "当掉"]), ("同行", ["渡船", "船桨", "码头"]), ("等待", ["祭典", "散场", "收网"])]
WINDOW_RULES = [("渡口换物", ["留在了", "换走"], 2), ("夜雾", ["薄雾", "结了一层白霜"], 1), ("账册", ["账册", "欠下", "两银子"], 3)]
EDITORIAL = ["适合补强", "可补足", "群像线"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a text, each once."""
    return table(spark, d, "documents").where("text is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "title")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Plain sentences of every document."""
    return docs(spark, d).select("doc_id", F.posexplode(plain_sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Segments of at most six sentences and 600 characters of every document."""
    return docs(spark, d).select("doc_id", F.posexplode(pack_sentences(plain_sentences(F.col("text")))).alias("segment_no", "s")).select("doc_id", "segment_no", F.size("s").alias("n"), F.length(F.array_join("s", "")).alias("chars"))


def unit_title_flag(spark: SparkSession, d: str) -> DataFrame:
    """Titles that open a unit, with the number they name."""
    t = table(spark, d, "documents").select("doc_id", "title").distinct()
    flag = F.coalesce(F.col("title").startswith("第") & F.substring("title", 1, 40).rlike("[章回]"), F.lit(False))
    return t.select("doc_id", flag.alias("is_title"), F.regexp_extract(F.coalesce("title", F.lit("")), "第([0-9]+)[章回]", 1).try_cast("int").alias("number"))


def title_parts(spark: SparkSession, d: str) -> DataFrame:
    """Volume and chapter of titles, split at the first white space, and a safe file name."""
    t = table(spark, d, "documents").select("doc_id", "title").where("title is not null").distinct()
    return t.select("doc_id", F.split("title", BLANK + "+", 2)[0].alias("head"), F.regexp_replace("title", '[\\\\/:*?"<>|]', "_").alias("file_name"))


def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Names of each role record in order, each once."""
    return table(spark, d, "unified_roles").dropDuplicates(["record_id"]).select("record_id", F.array_join(ordered_names(F.col("all_names")), "|").alias("names"))


def cjk_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each canonical name is of ideographs only."""
    return table(spark, d, "unified_roles").dropDuplicates(["record_id"]).select("record_id", all_cjk(F.col("canonical_name")).alias("is_cjk"))


def candidate_trim(spark: SparkSession, d: str) -> DataFrame:
    """Entity names without punctuation at their ends, a leading token and trailing particles."""
    n = table(spark, d, "chunk_extractions").select(F.explode("entities.name").alias("name")).distinct()
    return n.select("name", trim_candidate(F.col("name")).alias("trimmed"))


def segment_times(spark: SparkSession, d: str) -> DataFrame:
    """Year and chapter numbers named by segments' times."""
    t = table(spark, d, "chunk_extractions").select(F.col("segment_start_time").alias("t")).distinct().where("t is not null")
    return t.select("t", parse_year(F.concat(F.lit("公元前"), F.regexp_extract("t", "([0-9]+)章", 1), F.lit("年"))).alias("year"), chinese_number(F.regexp_extract("t", "第([0-9]+)卷", 1)).alias("volume"))


def low_signal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of events that say little."""
    return events(spark, d).select("id", low_signal(F.col("description")).alias("low"))


def role_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summary of at most 30 characters of each role's description."""
    return roles(spark, d).select("id", summary(F.coalesce("description", F.lit("")), F.col("canonical_name"), 30).alias("summary"))


def role_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """The description chosen from all records' texts of each role."""
    t = table(spark, d, "unified_roles").where("id is not null").dropDuplicates(["record_id"])
    text, order = strip(F.col("description")), (-F.col("record_id")).alias("o")
    plain = reduce(lambda a, b: a & b, [~text.contains(e) for e in EDITORIAL])
    notes = F.filter(F.transform("original_descriptions", strip), lambda x: x.isNotNull() & (x != ""))
    longest = F.array_max(F.transform(notes, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("t"))))
    pick = lambda ok: F.max(F.when(ok, F.struct(F.length(text).alias("n"), order, text.alias("t"))))["t"]
    g = t.groupBy("id").agg(
        pick((text != "") & plain & (F.length(text) <= 40)).alias("short"), pick((text != "") & plain).alias("plain"), pick(text != "").alias("any"),
        F.min(F.when(F.size(notes) > 0, F.struct("record_id", notes[0].alias("t"))))["t"].alias("first"),
        F.max(F.when(F.size(notes) > 0, F.struct(longest["n"].alias("n"), order, longest["t"].alias("t"))))["t"].alias("longest"),
        F.min(F.struct("record_id", "canonical_name"))["canonical_name"].alias("name"),
    )
    made = lambda c: F.nullif(summary(F.coalesce(c, F.lit("")), F.col("name"), 40), F.lit(""))
    return g.select("id", F.coalesce("short", *(made(F.col(c)) for c in ("first", "longest", "plain", "any")), F.lit("")).alias("chosen"))


def event_display_name(spark: SparkSession, d: str) -> DataFrame:
    """Event names grounded in their people and place: at most 80 characters."""
    first, second = F.get("people", F.lit(0)), F.get("people", F.lit(1))
    who = F.when(second.isNotNull(), F.concat(first, F.lit("与"), second)).otherwise(first)
    place = locations(spark, d).select(F.col("id").alias("location"), F.col("canonical_name").alias("place"))
    ev = events(spark, d).join(place, "location", "left")
    title = F.concat_ws("", who, F.when(F.col("place").isNotNull(), F.concat(F.lit("在"), "place")), F.lit("："), F.col("name"))
    return ev.select("id", F.substring(F.when(who.isNull() & F.col("place").isNull(), F.col("name")).otherwise(title), 1, 80).alias("display_name"))


def dictionary_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each book's role names in the texts of its chunks, greedy from the longest name."""
    r = roles(spark, d).select("book_id", "id", F.explode("all_names").alias("alias")).where(F.length("alias") >= 2).select("book_id", "alias", F.col("id").alias("entity"))
    c = table(spark, d, "chunk_extractions").select("book_id", "chunk_id", F.array_join("source_sentences", "").alias("text"))
    return match_names(c, r, "book_id", "chunk_id").drop("kind")


def keyword_action(spark: SparkSession, d: str) -> DataFrame:
    """Action of each stored sentence by keywords, the first rule on ties."""
    s = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"]).select("chunk_id", F.posexplode("source_sentences").alias("pos", "s"))
    return s.select("chunk_id", "pos", first_best(F.col("s"), ACTION_RULES).alias("action")).where("action is not null")


def window_rule_match(spark: SparkSession, d: str) -> DataFrame:
    """The best rule of each document over single sentences and neighbouring pairs; hits in the title count, but not alone."""
    s = sentence_split(spark, d)
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = s.withColumn("after", F.lead("sentence").over(w)).join(docs(spark, d).select("doc_id", F.coalesce("title", F.lit("")).alias("title")), "doc_id")
    two = F.struct(F.lit(1).alias("kind"), F.concat("sentence", "after").alias("x"))
    x = s.select("doc_id", "pos", "title", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("sentence").alias("x")), two), lambda p: p["x"].isNotNull())).alias("p")).select("doc_id", "pos", "title", "p.*")
    scores = F.explode(
        F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(n).alias("name"), hits(F.col("x"), kw).alias("inside"), (hits(F.col("x"), kw) + hits(F.col("title"), kw)).alias("total"), F.lit(m).alias("least")) for i, (n, kw, m) in enumerate(WINDOW_RULES)))
    )
    y = x.select("doc_id", "pos", "kind", "x", scores.alias("r")).select("doc_id", "pos", "kind", "x", "r.*").where("inside >= 1 and total >= least")
    return best_per(y, ["doc_id"], [F.desc("total"), "rule", "kind", "pos"]).select("doc_id", "name", "total", "kind", "pos", F.substring("x", 1, 120).alias("excerpt"))


def mine_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Names that speak in documents: documents, hits, score; the best 50."""
    pattern = "([一-鿿]{3})(?:问道|追问了一句|低声问|忍不住开口|喊道|冷笑|摇头说道)"
    n = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    g = n.groupBy("name").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_hits"))
    return g.where("n_docs >= 2").withColumn("score", 8 * F.col("n_docs") + 4 * F.col("n_hits")).orderBy(F.desc("score"), "name").limit(50)


_MARKS = "[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+"
_B = r"[\t-\r \x{85}\p{Z}]"
_DOCS = "docs AS (SELECT DISTINCT doc_id, text, title FROM documents WHERE text IS NOT NULL)"
_SENT = f"""{_DOCS}, sent AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(regexp_replace(text, '{_B}+', '', 'g'), '{_MARKS}') AS l FROM docs)))"""
_CHUNK = "ch AS (SELECT DISTINCT chunk_id, source_sentences FROM chunk_extractions)"
QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_chunks, unit_title_flag, title_parts, ordered_dedup, cjk_predicate, candidate_trim, segment_times, low_signal_texts, role_summaries, role_descriptions,
        event_display_name, dictionary_mentions, keyword_action, window_rule_match, mine_candidates,
    )
}
_RULES = " UNION ALL ".join(f"SELECT doc_id, pos, kind, x, {i} AS rule, '{n}' AS name, {sql_hits('x', kw)} AS inside, {sql_hits('x', kw)} + {sql_hits('title', kw)} AS total, {m} AS least FROM x" for i, (n, kw, m) in enumerate(WINDOW_RULES))
SQL = {
    "sentence_split": f"WITH {_SENT} SELECT * FROM sent",
    "unit_title_flag": "SELECT DISTINCT doc_id, coalesce(starts_with(title, '第') AND regexp_matches(substring(title, 1, 40), '[章回]'), false) AS is_title, TRY_CAST(regexp_extract(coalesce(title, ''), '第([0-9]+)[章回]', 1) AS INT) AS number FROM documents",
    "title_parts": f"""SELECT DISTINCT doc_id, regexp_extract(title, '^[^\\t-\\r \\x{{85}}\\p{{Z}}]*') AS head, regexp_replace(title, '[\\\\/:*?"<>|]', '_', 'g') AS file_name FROM documents WHERE title IS NOT NULL""",
    "ordered_dedup": f"""SELECT record_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS names FROM (SELECT DISTINCT record_id,
        list_filter(list_transform(all_names, lambda x: regexp_replace(x, '^{_B}+|{_B}+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS l FROM unified_roles)""",
    "cjk_predicate": "SELECT DISTINCT record_id, coalesce(regexp_matches(canonical_name, '^[一-鿿]+$'), false) AS is_cjk FROM unified_roles",
    "low_signal_texts": f"""WITH {SQL_EVENTS}, t AS (SELECT id, regexp_replace(description, '^{_B}+|{_B}+$', '', 'g') AS t FROM ev)
        SELECT id, coalesce(length(t) < 8 OR regexp_matches(t, '^(“|天气|天色|清晨|凌晨|夜幕|暮色|忽然|突然)') OR (regexp_matches(t, '说道|问道|笑道|答道|转头|点头|摇头|看着') AND length(t) <= 18), true) AS low FROM t""",
    "segment_times": "SELECT DISTINCT segment_start_time AS t, -TRY_CAST(regexp_extract(segment_start_time, '([0-9]+)章', 1) AS INT) AS year, TRY_CAST(regexp_extract(segment_start_time, '第([0-9]+)卷', 1) AS INT) AS volume FROM chunk_extractions WHERE segment_start_time IS NOT NULL",
    "event_display_name": f"""WITH {SQL_EVENTS}, {SQL_LOCATIONS}, j AS (SELECT ev.*, loc.canonical_name AS place, CASE WHEN ev.people[2] IS NOT NULL THEN ev.people[1] || '与' || ev.people[2] ELSE ev.people[1] END AS who FROM ev LEFT JOIN loc ON loc.id = ev.location)
        SELECT id, substring(CASE WHEN who IS NULL AND place IS NULL THEN name ELSE concat_ws('', who, '在' || place, '：', name) END, 1, 80) AS display_name FROM j""",
    "keyword_action": f"""WITH {_CHUNK}, s AS (SELECT chunk_id, CAST(i - 1 AS INT) AS pos, source_sentences[i] AS s FROM (SELECT *, unnest(range(1, len(source_sentences) + 1)) AS i FROM ch)),
        a AS (SELECT chunk_id, pos, {sql_first_best('s', ACTION_RULES)} AS action FROM s) SELECT * FROM a WHERE action IS NOT NULL""",
    "window_rule_match": f"""WITH {_SENT}, l AS (SELECT *, lead(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM sent),
        x AS (SELECT l.doc_id, pos, 0 AS kind, sentence AS x, coalesce(title, '') AS title FROM l JOIN docs USING (doc_id) UNION ALL SELECT l.doc_id, pos, 1, sentence || after, coalesce(title, '') FROM l JOIN docs USING (doc_id) WHERE after IS NOT NULL),
        r AS ({_RULES}) SELECT doc_id, name, total, kind, pos, substring(x, 1, 120) AS excerpt FROM r WHERE inside >= 1 AND total >= least QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, rule, kind, pos) = 1""",
    "mine_candidates": f"""WITH {_DOCS}, n AS (SELECT doc_id, unnest(regexp_extract_all(text, '([一-鿿]{{3}})(?:问道|追问了一句|低声问|忍不住开口|喊道|冷笑|摇头说道)', 1)) AS name FROM docs),
        g AS (SELECT name, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM n GROUP BY 1) SELECT *, 8 * n_docs + 4 * n_hits AS score FROM g WHERE n_docs >= 2 ORDER BY score DESC, name LIMIT 50""",
}
