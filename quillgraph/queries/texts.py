"""Text operators over documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..plans.bindings import Tables, sql
from . import query


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


SPACES = r"\s+"
TOPICS = rf"list_filter(regexp_split_to_array(lower({{0}}), '[^\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{{4,}}}}') AND NOT list_contains([{quoted(C.TOPIC_STOPWORDS)}], w))".replace("{{", "{").replace("}}", "}")


def duck_topics(column: str) -> str:
    return TOPICS.replace("{0}", column)


#: DuckDB has the canonical normal form only, which is the compatibility one where a text holds no compatibility characters,
#: as in the driver's tables; unit tests cover the others
TIDY = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\p{Cf}\p{Co}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), ' +', ' ', 'g'), "
    r"'\n{3,}', chr(10) || chr(10), 'g'), ' *\n *', chr(10), 'g'), ' *\t *', chr(9), 'g')"
)


@query("str01_rich_clean", f"SELECT doc_id, md5(trim({TIDY})) AS digest FROM documents")
def rich_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.rich_clean(F.col("text"))).alias("digest"))


@query("str02_simple_clean", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'))) AS digest, length(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'))) AS size FROM documents")
def simple_clean(t: Tables) -> DataFrame:
    clean = X.simple_clean(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("size"))


def duck_sentences(column: str) -> str:
    for a in sorted(C.ABBREVIATIONS, key=len, reverse=True):
        parts = a.split(".")[:-1]
        pattern, back = "".join(f"({p})\\." for p in parts), " || ".join(f"'\\{k + 1}' || chr(1)" for k in range(len(parts)))
        column = f"regexp_replace({column}, '{pattern}', {back}, 'gi')"
    ended = f"regexp_replace({column}, '([.!?。！？])(\\s+|$)', '\\1' || chr(4), 'g')"
    return f"list_filter(list_transform(string_split({ended}, chr(4)), lambda s: trim(replace(s, chr(1), '.'), chr(32) || chr(10) || chr(9) || chr(13))), lambda s: s <> '')"


@query("str03_sentences", f"WITH s AS (SELECT doc_id, {duck_sentences('text')} AS s FROM documents) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def sentence_split(t: Tables) -> DataFrame:
    s = F.transform(X.sentences(F.col("text")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    s = F.filter(s, lambda x: x != "")
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(
    "str04_tokens",
    r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([^\p{L}\p{N}_\s])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM w",
)
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def duck_stem(w: str) -> str:
    cases = [f"WHEN length({w}) <= 3 THEN {w}", f"WHEN (suffix({w}, 'ies') OR suffix({w}, 'ied')) AND length({w}) > 4 THEN left({w}, -3) || 'y'"]
    cases += [f"WHEN suffix({w}, '{s}') AND length({w}) > {len(s) + 2} THEN left({w}, -{len(s)})" for s in ("ing", "ed", "er", "est", "ly", "s")]
    return "CASE " + " ".join(cases) + f" ELSE {w} END"


def duck_canonical(column: str) -> str:
    plain = rf"regexp_replace(lower(trim({column})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    kept = f"list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: w <> '' AND NOT list_contains([{quoted(C.ENTITY_STOPWORDS)}], w))"
    joined = f"array_to_string(list_transform({kept}, lambda w: {duck_stem('w')}), ' ')"
    return rf"CASE WHEN {joined} <> '' THEN {joined} ELSE trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) END"


@query("str05_canonical_entity", f"SELECT p_partkey, {duck_canonical('p_name')} AS canonical FROM part UNION ALL SELECT -1 - item_id, {duck_canonical('text')} FROM benchmark")
def canonical(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", F.col("p_name").alias("text"))
    items = t.benchmark.select((F.lit(-1) - F.col("item_id")).alias("p_partkey"), "text")
    return parts.unionByName(items).select("p_partkey", X.canonical(F.col("text")).alias("canonical"))


@query("str06_stem", rf"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS w FROM benchmark) SELECT w, {duck_stem('w')} AS stem FROM w WHERE w <> ''")
def stems(t: Tables) -> DataFrame:
    w = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").distinct()
    return w.select("w", X.stem(F.col("w")).alias("stem"))


@query("str07_topics", f"WITH k AS (SELECT doc_id, {duck_topics('text')} AS k FROM documents) SELECT doc_id, len(k) AS n, len(list_distinct(k)) AS n_distinct, md5(array_to_string(k, ' ')) AS digest FROM k")
def topic_words(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", X.topics(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("str08_word_set", r"WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM w")
def word_set(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", F.sort_array(F.array_distinct(X.words(F.col("text")))).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("str09_venue_key", "SELECT o_orderpriority AS venue, translate(lower(o_orderpriority), ' -', '') AS venue_key, count(*) AS n FROM orders GROUP BY 1, 2")
def venue_keys(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("venue")).agg(F.count(F.lit(1)).alias("n")).select("venue", X.venue_key(F.col("venue")).alias("venue_key"), "n")


@query("str10_same_venue", sql("citations graph_papers", "SELECT c.source, c.target, CASE WHEN a.venue <> '' AND lower(a.venue) = lower(b.venue) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS domain FROM citations c JOIN graph_papers a ON a.id = c.source JOIN graph_papers b ON b.id = c.target"))
def same_venue(t: Tables) -> DataFrame:
    p = t.graph_papers.select("id", "venue")
    a, b = p.withColumnsRenamed({"id": "source", "venue": "va"}), p.withColumnsRenamed({"id": "target", "venue": "vb"})
    return t.citations.join(a, "source").join(b, "target").select("source", "target", X.same_venue(F.col("va"), F.col("vb")).alias("domain"))


#: words that occur in the fixture, in place of the default lexicon
FIXTURE_FUNCTIONS = (("use", ("with", "mit")), ("compare", ("than", "que")), ("inspire", ("from", "das")))
FIXTURE_ENTITIES = (("method", ("tion", "ing", "ung")), ("task", ("that", "keit")), ("material", ("ment", "ción")), ("metric", ("able", "eau")))


def duck_function(column: str, lexicon) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {quoted([w])})' for w in some)} THEN '{name}'" for name, some in lexicon)
    return f"CASE {cases} ELSE 'background' END"


@query("str11_citation_function", f"SELECT conv_id, turn, {duck_function('text', FIXTURE_FUNCTIONS)} AS function, {duck_function('text', C.FUNCTION_WORDS)} AS default_function FROM conversations")
def functions(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.citation_function(F.col("text"), FIXTURE_FUNCTIONS).alias("function"), X.citation_function(F.col("text")).alias("default_function"))


ENTITY_ROWS = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, w) in enumerate((k, w) for k, some in FIXTURE_ENTITIES for w in some))


@query(
    "str12_keyword_entities",
    f"SELECT doc_id, n - 1 AS pos, entity_type, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, k AS entity_type, w AS text FROM documents JOIN (VALUES {ENTITY_ROWS}) v(i, k, w) ON contains(lower(text), w)) WHERE n <= 10",
)
def entities(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.keyword_entities(F.col("text"), FIXTURE_ENTITIES)).alias("pos", "e")).select("doc_id", F.col("pos").cast("long").alias("pos"), "e.entity_type", "e.text")


@query(
    "str13_bio_decode",
    sql(
        "",
        """
WITH tags AS (
  SELECT doc_id, pos, w, CASE pos % 7 WHEN 0 THEN 'B' WHEN 1 THEN 'I' WHEN 2 THEN 'I' WHEN 3 THEN 'O' WHEN 4 THEN 'I' WHEN 5 THEN 'I' ELSE 'O' END AS tag,
    CASE WHEN pos % 14 < 2 THEN 'Task' WHEN pos % 14 < 7 THEN 'Method' ELSE 'Metric' END AS kind
  FROM (SELECT item_id AS doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w, unnest(range(len(regexp_split_to_array(text, '\\s+')))) AS pos FROM benchmark)
), marked AS (SELECT *, tag = 'B' OR tag = 'I' AND (lag(tag) OVER p IS NULL OR lag(tag) OVER p = 'O' OR lag(kind) OVER p <> kind) AS begins FROM tags WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
spans AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM marked)
SELECT doc_id, min(pos) AS first_pos, lower(any_value(kind)) AS entity_type, string_agg(w, ' ' ORDER BY pos) AS text FROM spans WHERE tag <> 'O' GROUP BY doc_id, span
""",
    ).replace("WITH , ", "WITH "),
)
def bio(t: Tables) -> DataFrame:
    from ..operators.spans import decode_bio

    words = t.benchmark.select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", SPACES)).alias("pos", "w"))
    m, k = F.col("pos") % 7, F.col("pos") % 14
    kind = F.when(k < 2, "Task").when(k < 7, "Method").otherwise("Metric")
    tag = F.when(m == 0, "B").when(m.isin(1, 2, 4, 5), "I").otherwise("O")
    label = F.when(tag == "O", "O").otherwise(F.concat(tag, F.lit("-"), kind))
    return decode_bio(words.select("doc_id", F.col("pos").cast("long").alias("pos"), "w", label.alias("label")))


@query("str14_bio_labels", "SELECT id, label, CASE WHEN label = 'O' THEN NULL ELSE lower(split_part(label, '-', 2)) END AS entity_type FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{x}')" for i, x in enumerate(C.BIO_LABELS)) + ") v(id, label)")
def labels(t: Tables) -> DataFrame:
    table = F.array(*[F.lit(x) for x in C.BIO_LABELS])
    rows = t.spark.range(len(C.BIO_LABELS)).select("id", F.get(table, F.col("id").cast("int")).alias("label"))
    return rows.select("id", "label", F.when(F.col("label") != "O", F.lower(F.substring_index("label", "-", -1))).alias("entity_type"))


@query("str16_function_text", "SELECT f AS function, coalesce(d, '" + C.DEFAULT_FUNCTION_TEXT + "') AS description FROM (VALUES " + ", ".join(f"('{k}')" for k in (*C.FUNCTIONS, "other")) + ") v(f) LEFT JOIN (VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in C.FUNCTION_TEXTS.items()) + ") w(k, d) ON f = k")
def function_text(t: Tables) -> DataFrame:
    from ..functions.numbers import lookup

    rows = t.spark.createDataFrame([(f,) for f in (*C.FUNCTIONS, "other")], "function string")
    return rows.select("function", lookup(F.lower("function"), C.FUNCTION_TEXTS, C.DEFAULT_FUNCTION_TEXT).alias("description"))


@query("str18_preview", "SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS digest, left(text, 50) AS head FROM documents")
def preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.preview(F.col("text"))).alias("digest"), F.substring("text", 1, 50).alias("head"))


@query("str19_occurrences", "SELECT doc_id, instr(lower(text), 'er') - 1 AS first_pos, (length(text) - length(replace(lower(text), 'er', ''))) // 2 AS n FROM documents")
def occurrences(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", (F.instr(low, "er") - 1).cast("long").alias("first_pos"), X.occurrences(low, F.lit("er")).alias("n"))


SET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"


@query(
    "set02_jaccard",
    rf"WITH w AS (SELECT doc_id, item_id, {SET.format('d.text')} AS a, {SET.format('b.text')} AS b FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id) SELECT doc_id, item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM w",
)
def jaccard(t: Tables) -> DataFrame:
    pairs = t.documents.select("doc_id", F.col("text").alias("x"), (F.col("doc_id") % 40).alias("item_id")).join(t.benchmark, "item_id")
    return pairs.select("doc_id", "item_id", F.round(X.jaccard(F.array_distinct(X.words(F.col("x"))), F.array_distinct(X.words(F.col("text")))), 6).alias("jaccard"))


@query(
    "set04_weighted_jaccard",
    sql(
        "papers",
        rf"""
WITH w AS (SELECT id, venue, lead(id) OVER p AS other, {SET.format('title')} AS t, list_distinct(list_filter(regexp_split_to_array(lower(abstract), '\s+'), lambda x: x <> '')[1:50]) AS a,
  lead(title) OVER p AS title2, lead(abstract) OVER p AS abstract2 FROM papers WINDOW p AS (PARTITION BY venue ORDER BY id)),
v AS (SELECT *, {SET.format('title2')} AS t2, list_distinct(list_filter(regexp_split_to_array(lower(abstract2), '\s+'), lambda x: x <> '')[1:50]) AS a2 FROM w WHERE other IS NOT NULL)
SELECT id, other, round(CASE WHEN len(list_concat(t, t2)) > 0 THEN 0.4 * len(list_intersect(t, t2)) / len(list_distinct(list_concat(t, t2))) ELSE 0 END
  + CASE WHEN len(list_concat(a, a2)) > 0 THEN 0.6 * len(list_intersect(a, a2)) / len(list_distinct(list_concat(a, a2))) ELSE 0 END, 6) AS similarity FROM v
""",
    ),
)
def weighted_jaccard(t: Tables) -> DataFrame:
    from ..operators.similarity import abstract_similarity
    from pyspark.sql import Window

    p = Window.partitionBy("venue").orderBy("id")
    # ids are put in order; the texts meet by join, not in a window
    each = t.papers.select("id", "title", "abstract")
    order = t.papers.select("id", F.lead("id").over(p).alias("other")).where("other IS NOT NULL")
    pairs = order.join(each, "id").join(each.select(F.col("id").alias("other"), F.col("title").alias("title2"), F.col("abstract").alias("abstract2")), "other")
    return pairs.select("id", "other", F.round(abstract_similarity("title", "abstract", "title2", "abstract2"), 6).alias("similarity"))


@query(
    "set05_difference",
    f"WITH k AS (SELECT doc_id, lang, {duck_topics('text')} AS k FROM documents), e AS (SELECT lang, unnest(k) AS w FROM k) SELECT DISTINCT w FROM e WHERE lang = 'en' EXCEPT SELECT w FROM e WHERE lang = 'de'",
)
def difference(t: Tables) -> DataFrame:
    w = t.documents.select("lang", F.explode(X.topics(F.col("text"))).alias("w"))
    return w.where("lang = 'en'").select("w").distinct().join(w.where("lang = 'de'").select("w").distinct(), "w", "left_anti")


@query("set06_union", sql("citations", "SELECT source, target FROM citations WHERE step = 1 UNION SELECT source, target FROM citations WHERE step <= 2"))
def union(t: Tables) -> DataFrame:
    c = t.citations
    return c.where("step = 1").select("source", "target").unionByName(c.where("step <= 2").select("source", "target")).distinct()


@query("set07_distinct_ids", "SELECT DISTINCT 'o' || l_orderkey AS id FROM lineitem")
def distinct_ids(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("id")).distinct()
