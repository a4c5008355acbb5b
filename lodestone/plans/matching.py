"""Glued walls, layered aliases, dictionary words, bound modifiers and model answers over texts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import gathered
from ..functions.segments import glued_tokens, segmented
from ..operators import aliases as A
from ..operators import binding as B
from ..operators import records as R
from ..sources.tables import described, table
from .text import _D


def _pick(by: Column, *values: Column) -> Column:
    return F.get(F.array(*values), by.cast("int"))


def _glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three walls of six forms without a sign between them; some forms can be cut in more than one way."""
    key, n, m = F.col("p_partkey"), F.col("p_size").cast("string"), (F.col("p_partkey") % 97).cast("string")
    forms = lambda a, b: (F.concat(F.lit("SCH"), a), F.concat(F.lit("S"), a), F.concat(a, F.lit("s")), F.concat(F.lit("S-"), a, F.lit("S")), F.concat(a, F.lit("."), b, F.lit("mm")), F.lit("XXS"))
    third = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "STD").otherwise(F.concat(F.lit("S"), m))
    text = F.concat(_pick(key % 6, *forms(n, m)), _pick(F.floor(key / 6) % 6, *forms(m, n)), third)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def glued_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walls that a glued text consists of."""
    return gathered(_glued(spark, sf_dir), "text").select("p_partkey", F.array_join(glued_tokens(F.col("text")), " ").alias("walls"))


#: Materials by layer: (layer, code, alias, place in the dictionary).
MATERIALS = [
    ("combo", "A105/A106", "A105/A106", 1), ("combo", "20/304", "20 / 304", 2), ("combo", "PVC+PE", "PVC + PE", 3),
    ("strong", "06CR19NI10", "06Cr19Ni10", 4), ("strong", "S30408", "S304-08", 5), ("strong", "S30400", "S304", 6), ("strong", "16MN", "16 Mn", 7),
    ("weak", "20#", "20#", 8), ("weak", "A106", "A106", 9), ("weak", "A106B", "A106 Gr.B", 10), ("weak", "SMLS", "SMLS", 11),
    ("fallback", "STEEL", "steel", 12), ("fallback", "BRASS", "brass", 13), ("fallback", "GB", "GB/T", 14),
    ("suffix", "forged", "NB/T47010", 15), ("grade", "II", "II", 16),
]
NOTES = (A.Layer("suffix"), A.Layer("grade", bounded=True))


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's description with its type and, for most, a material in one of eight forms."""
    n = F.col("p_size").cast("string")
    forms = [F.lit("A105 / a106"), F.concat(F.lit("06CR19-NI10 S30408 "), n), F.concat(F.lit("S304 08"), n), F.lit("20/304"), F.concat(F.lit("A106GR.B"), n), F.lit("16mn;20#"), F.concat(F.lit("pvc+ PE"), n), F.lit("")]
    tail = _pick(F.floor(F.col("p_partkey") / 3) % 8, *forms)
    return described(spark, sf_dir).select("p_partkey", F.concat_ws(" ", "description", "p_type", tail).alias("text"))


def layered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description's material by the first layer that has an alias in it."""
    found = A.layered_match(_materials(spark, sf_dir), "text", spark.createDataFrame(MATERIALS, "layer string, code string, alias string, ord int"), notes=NOTES)
    places = F.transform("hits", lambda h: F.concat_ws(":", h["begin"].cast("string"), h["end"].cast("string"), h["code"]))
    return found.select("p_partkey", "layer", F.array_join("codes", ",").alias("codes"), "several", F.array_join("notes", ",").alias("notes"), F.array_join(places, " ").alias("places"))


def keyword_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of the parts' types and names stands in the documents and at which places they begin, on the whole."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")).alias("keyword")).where("length(keyword) > 2").distinct()
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    places = A.keyword_places(texts, "doc_id", "text", words)
    return places.groupBy("keyword").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum(F.col("begin").cast("long")).alias("begins"))


#: Words of a small dictionary, most of which overlap, and fixed spans of numbers.
WORDS = {"the": "A", "then": "B", "hen": "C", "in": "A", "ing": "D", "ation": "E", "tion": "D", "on": "A", "of": "A", "offer": "B", "and": "A", "ran": "C", "er": "F", "here": "B", "there": "B", "re": "F"}
SPANS = [("NUM", "[0-9]+(?:[.,][0-9]+)*"), ("LABEL", "[A-Za-z]+:")]


def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the dictionary's words and fixed spans in conversations, each text cut so that most of it is known."""
    texts = gathered(table(spark, sf_dir, "conversations").select(F.lower("text").alias("text")), "text")
    t = texts.select(F.explode(segmented(F.col("text"), SPANS, WORDS)).alias("s"))
    return t.where("s.tag <> 'O'").groupBy(F.col("s.tag").alias("tag"), F.col("s.word").alias("word")).agg(F.count("*").alias("n"))


def bound_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's other orders bound to the filled ones: by number, else the last filled before, else the only one."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    filled = o.where("o_orderstatus = 'F'").select("o_custkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("index"), F.when(key % 11 > 0, day).alias("pos"))
    other = o.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", F.when(F.startswith("o_orderpriority", F.lit("1")), key % 5 - 1).alias("index"), F.when(key % 7 > 0, day).alias("pos"))
    return B.bind_modifiers(filled, other, "o_custkey").select("o_custkey", "o_orderkey", F.col("bound").cast("int").alias("bound"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of a part as a model may write it: bare, after thoughts, fenced, amid prose, with brackets in strings, broken."""
    quoted = F.concat(F.lit('a "}" in {'), F.col("p_type"), F.lit("\\"))
    record = F.to_json(F.struct(F.col("p_size").alias("size"), F.struct(quoted.alias("note"), F.struct(F.col("p_brand").alias("brand")).alias("maker")).alias("deep")))
    forms = [record, F.concat(F.lit("<think>{1}</think>\n"), record), F.concat(F.lit("```json\n"), record, F.lit("\n```")), F.concat(F.lit('So: "it" is '), record, F.lit(" or {\"size\": 0}")), F.substring(record, F.lit(1), F.length(record) - 2), F.lit("none")]
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", _pick(F.col("p_partkey") % 6, *forms).alias("answer"))


def balanced_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("p_partkey", R.balanced_object(F.col("answer")).alias("object"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a model's answer; null where it holds no record."""
    rows = _answers(spark, sf_dir).withColumn("v", R.model_json(F.col("answer")))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("p_partkey", at("$.size", "int").alias("size"), at("$.deep.maker.brand", "string").alias("brand"))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of five levels completed from a skeleton, emptied of blanks, and as its paths."""
    p = table(spark, sf_dir, "part")
    deep = lambda leaf: F.struct(F.struct(F.struct(F.struct(leaf.alias("e"), F.lit("").alias("blank")).alias("d")).alias("c")).alias("b"))
    own = F.to_json(F.struct(deep(F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("a"), F.array("p_type", F.lit("x")).alias("list")), {"ignoreNullFields": "false"})
    base = F.lit('{"a": {"b": {"c": {"d": {"e": "default", "f": 7}}}}, "z": {"y": true}, "list": ["none"]}')
    rows = p.select("p_partkey", R.flat_paths(R.stripped(R.merged_with(own, base))).alias("paths"))
    return rows.select("p_partkey", F.array_join(F.transform("paths", lambda e: F.concat_ws("=", e["path"], e["value"])), "; ").alias("paths"))


QUERIES = {f.__name__: f for f in (glued_walls, layered_match, keyword_histogram, dictionary_words, bound_modifiers, balanced_objects, model_answers, merged_records)}


def _alias_sql() -> str:
    """Each alias as an expression with what may stand between its parts."""
    rows = []
    for layer, code, alias, order in MATERIALS:
        if layer == "combo":
            shape = alias.replace(" ", "").replace("+", "[+]").replace("/", r"\s*/\s*").replace("[+]", r"\s*[+]\s*")
        else:
            parts = [p.replace(".", "[.]").replace("#", "[#]") for p in alias.replace("-", " ").replace("/", " ").split()]
            shape = r"[\s\-_/;,，；()（）]*".join(parts)
        bounded = layer in ("weak", "fallback", "grade")
        rows.append(f"('{layer}', '{code}', {order}, '^(?i:{shape})', {str(bounded).lower()}, {str(layer == 'strong').lower()})")
    return "al(layer, code, ord, shape, bounded, early) AS (VALUES " + ", ".join(rows) + ")"


_FORMS = ["^SCH(?:XXS|XS|STD)", "^SCH[0-9]+(?:[.][0-9]+)?S", "^SCH[0-9]+(?:[.][0-9]+)?", "^S-(?:XXS|XS|STD)", "^S-[0-9]+[.][0-9]+(?:MM|毫米)?", "^S-[0-9]+S", "^S[0-9]+(?:[.][0-9]+)?S", "^S[0-9]+(?:[.][0-9]+)?", "^[0-9]+(?:[.][0-9]+)?S", "^[0-9]+(?:[.][0-9]+)?MM", "^(?:XXS|XS|STD)"]
_ANSWERS = r"""p AS (SELECT *, CAST(to_json({'size': p_size, 'deep': {'note': concat('a "}" in {', p_type, '\'), 'maker': {'brand': p_brand}}}) AS VARCHAR) AS record FROM part),
a AS (SELECT p_partkey, p_size, p_brand, [record, '<think>{1}</think>' || chr(10) || record, '```json' || chr(10) || record || chr(10) || '```', 'So: "it" is ' || record || ' or {"size": 0}', record[:-3], 'none'][p_partkey % 6 + 1] AS answer FROM p)"""
ORACLES = {
    "glued_walls": f"""WITH RECURSIVE t AS (SELECT p_partkey, upper(concat(
 [concat('SCH', n), concat('S', n), concat(n, 's'), concat('S-', n, 'S'), concat(n, '.', m, 'mm'), 'XXS'][p_partkey % 6 + 1],
 [concat('SCH', m), concat('S', m), concat(m, 's'), concat('S-', m, 'S'), concat(m, '.', n, 'mm'), 'XXS'][p_partkey // 6 % 6 + 1],
 ['', 'STD', concat('S', m)][p_size % 3 + 1])) AS v, concat(
 [concat('SCH', n), concat('S', n), concat(n, 's'), concat('S-', n, 'S'), concat(n, '.', m, 'mm'), 'XXS'][p_partkey % 6 + 1],
 [concat('SCH', m), concat('S', m), concat(m, 's'), concat('S-', m, 'S'), concat(m, '.', n, 'mm'), 'XXS'][p_partkey // 6 % 6 + 1],
 ['', 'STD', concat('S', m)][p_size % 3 + 1]) AS raw FROM (SELECT *, CAST(p_size AS VARCHAR) AS n, CAST(p_partkey % 97 AS VARCHAR) AS m FROM part)),
w(v, k, lens, toks) AS (SELECT DISTINCT v, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM t UNION
 SELECT v, k + len(tok), list_append(lens, len(tok)), list_append(toks, tok) FROM (SELECT w.*, unnest(list_concat(
  list_filter(list_transform({_FORMS}, lambda f: regexp_extract(substr(v, k + 1), f)), lambda x: x <> ''),
  CASE WHEN regexp_matches(substr(v, k + 1), '^S-[0-9]+([^0-9.]|[.][^0-9]|[.]?$)') THEN [regexp_extract(substr(v, k + 1), '^S-[0-9]+')] ELSE [] END)) AS tok FROM w WHERE k < len(v))),
b AS (SELECT v, toks, row_number() OVER (PARTITION BY v ORDER BY lens DESC) AS r FROM w WHERE k = len(v) AND len(toks) > 1)
SELECT p_partkey, coalesce(array_to_string(toks, ' '), raw) AS walls FROM t LEFT JOIN b ON b.v = t.v AND r = 1""",
    "layered_match": _D.replace("WITH d AS", f"WITH RECURSIVE {_alias_sql()}, d AS")
    + r""", x AS (SELECT p_partkey, concat_ws(' ', description, p_type, ['A105 / a106', concat('06CR19-NI10 S30408 ', p_size), concat('S304 08', p_size), '20/304', concat('A106GR.B', p_size), '16mn;20#', concat('pvc+ PE', p_size), ''][p_partkey // 3 % 8 + 1]) AS text FROM d),
s AS (SELECT p_partkey, text, unnest(range(1, len(text) + 1)) AS i FROM x),
h AS (SELECT p_partkey, layer, code, ord, early, i - 1 AS b, i - 1 + len(regexp_extract(substr(text, i), shape)) AS e FROM s, al
 WHERE regexp_matches(substr(text, i), shape) AND (NOT bounded OR (NOT regexp_matches(CASE WHEN i > 1 THEN text[i - 1] ELSE '' END, '[A-Za-z0-9一-鿿]')
  AND NOT regexp_matches(text[i + len(regexp_extract(substr(text, i), shape))], '[A-Za-z0-9一-鿿]')))),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, layer ORDER BY CASE WHEN early THEN b ELSE ord END, CASE WHEN early THEN -e ELSE b END, ord) AS r FROM h WHERE layer NOT IN ('suffix', 'grade')),
g(p_partkey, layer, r, kept) AS (SELECT p_partkey, layer, 1, [{'b': b, 'e': e, 'code': code}] FROM r WHERE r = 1 UNION ALL
 SELECT g.p_partkey, g.layer, g.r + 1, CASE WHEN len(list_filter(kept, lambda k: k.b < r.e AND r.b < k.e)) > 0 THEN kept ELSE list_append(kept, {'b': r.b, 'e': r.e, 'code': r.code}) END
 FROM g JOIN r ON r.p_partkey = g.p_partkey AND r.layer = g.layer AND r.r = g.r + 1),
f AS (SELECT p_partkey, layer, list_sort(arg_max(kept, r)) AS kept FROM g GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY list_position(['combo', 'strong', 'weak', 'fallback'], layer)) AS n FROM f),
u AS (SELECT p_partkey, string_agg(code, ',' ORDER BY o) AS notes FROM (SELECT p_partkey, code, min(ord) AS o FROM h WHERE layer IN ('suffix', 'grade') GROUP BY ALL) GROUP BY p_partkey),
k AS (SELECT p_partkey, string_agg(code, ',' ORDER BY b) AS codes, count(*) AS n FROM (SELECT p_partkey, k.code AS code, min(k.b) AS b FROM (SELECT p_partkey, unnest(kept) AS k FROM c WHERE n = 1) GROUP BY ALL) GROUP BY p_partkey)
SELECT x.p_partkey, c.layer, coalesce(k.codes, '') AS codes, coalesce(k.n > 1, false) AS several, coalesce(u.notes, '') AS notes,
 coalesce(array_to_string(list_transform(c.kept, lambda z: concat(z.b, ':', z.e, ':', z.code)), ' '), '') AS places
FROM x LEFT JOIN c ON c.p_partkey = x.p_partkey AND c.n = 1 LEFT JOIN k ON k.p_partkey = x.p_partkey LEFT JOIN u ON u.p_partkey = x.p_partkey""",
    "keyword_histogram": """WITH k AS (SELECT DISTINCT keyword FROM (SELECT unnest(string_split(lower(concat_ws(' ', p_type, p_name)), ' ')) AS keyword FROM part) WHERE length(keyword) > 2),
d AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, text, i - 1 AS b, substr(text, i, 3) AS seed FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM d))
SELECT keyword, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(b) AS BIGINT) AS begins FROM g JOIN k ON seed = substr(keyword, 1, 3) AND substr(text, CAST(b + 1 AS INTEGER), length(keyword)) = keyword GROUP BY 1""",
    "bound_modifiers": """WITH o AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 11 > 0 THEN day END AS pos FROM o WHERE o_orderstatus = 'F'),
m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey % 5 - 1 END AS i, CASE WHEN o_orderkey % 7 > 0 THEN day END AS pos FROM o WHERE o_orderstatus <> 'F'),
c AS (SELECT o_custkey, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT m.o_custkey, m.o_orderkey, m.i, m.pos, arg_max(s.i, {'p': s.pos, 'i': -s.i}) AS before FROM m LEFT JOIN s ON s.o_custkey = m.o_custkey AND s.pos <= m.pos GROUP BY ALL)
SELECT b.o_custkey, b.o_orderkey, CAST(CASE WHEN b.i >= 0 AND b.i < n THEN b.i WHEN before IS NOT NULL THEN before WHEN n = 1 THEN 0 END AS INTEGER) AS bound FROM b LEFT JOIN c ON c.o_custkey = b.o_custkey""",
    "balanced_objects": f"""WITH RECURSIVE {_ANSWERS}, f AS (SELECT p_partkey, CASE WHEN instr(answer, '{{') > 0 THEN substr(answer, instr(answer, '{{')) ELSE '' END AS t FROM a),
s(t, i, depth, quoted, esc) AS (SELECT DISTINCT t, 0, 0, false, false FROM f WHERE t <> '' UNION ALL
 SELECT t, i + 1, depth + CASE WHEN quoted THEN 0 WHEN t[i + 1] = '{{' THEN 1 WHEN t[i + 1] = '}}' THEN -1 ELSE 0 END,
 CASE WHEN quoted THEN esc OR t[i + 1] <> '"' ELSE t[i + 1] = '"' END, quoted AND NOT esc AND t[i + 1] = '\\' FROM s WHERE i < len(t) AND (i = 0 OR depth > 0)),
e AS (SELECT t, min(i) AS n FROM s WHERE i > 0 AND depth = 0 GROUP BY t)
SELECT p_partkey, coalesce(substr(f.t, 1, n), '') AS object FROM f LEFT JOIN e ON e.t = f.t""",
    "model_answers": """SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN p_size END AS size, CASE WHEN p_partkey % 6 < 4 THEN p_brand END AS brand FROM part""",
    "merged_records": """SELECT p_partkey, concat('a.b.c.d.e=', CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'default' END, '; a.b.c.d.f=7; list=', CASE WHEN p_type < 'x' THEN concat(p_type, '|x') ELSE concat('x|', p_type) END, '; z.y=true') AS paths FROM part""",
}
