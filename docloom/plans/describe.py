"""Queries on charts, tables, equations, images and embedding texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import models
from docloom.functions import describe as dx
from docloom.functions import text as tx
from docloom.operators import multimodal
from docloom.plans.catalog import query
from docloom.schemas import VISUAL_TYPES
from docloom.session import table

CHARTS = ["bar", "Grouped_Bar", "stacked_bar", "LINE", "scatter", "pie", "area", "histogram", "radar", ""]


def _quoted(values) -> str:
    return ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))


@query("chart_type", "SELECT CAST(id AS BIGINT) AS id, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in dx.CHART_KINDS.items())
       + f"}}[lower(raw)], 'unknown') AS chart_type FROM (VALUES {_quoted(CHARTS)}) AS t(id, raw)")
def chart_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(CHARTS)), "id long, raw string")
    return rows.select("id", dx.chart_type(F.col("raw")).alias("chart_type"))


#: Texts as read from a chart: the first lines of documents, some with words of measures.
_READ = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN a || chr(10) || '  Epoch ' || chr(10) || chr(10) || 'Validation loss' || chr(10) || 'F1'
  WHEN 1 THEN a || chr(10) || 'none' || chr(10) || 'Accuracy (%)' WHEN 2 THEN a ELSE '' END AS t FROM (SELECT doc_id, split_part(text, chr(10), 1) AS a FROM documents)"""
_STRIPPED = r"list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, m = F.split("text", "\n")[0], F.col("doc_id") % 4
    made = F.when(m == 0, F.concat(a, F.lit("\n  Epoch \n\nValidation loss\nF1"))).when(m == 1, F.concat(a, F.lit("\nnone\nAccuracy (%)"))).when(m == 2, a).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("t"))


_AXES = f"""SELECT doc_id, coalesce(l[1], '') AS title, coalesce(m[1], '') AS x_axis, coalesce(m[2], '') AS y_axis FROM (SELECT doc_id, l,
  list_filter(l[2:], lambda x: regexp_matches(x, '{dx.AXIS}')) AS m FROM (SELECT doc_id, {_STRIPPED} AS l FROM ({_READ})))"""


@query("chart_axes", _AXES)
def chart_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("doc_id", dx.chart_axes(F.col("t")).alias("a")).select("doc_id", "a.*")


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'bar' ELSE 'line' END"
_LEGEND = "list_transform(range(0, doc_id % 8), lambda i: 's' || i)"


@query("chart_description", f"""SELECT doc_id, CASE WHEN kind <> 'unknown' THEN 'A ' || kind || ' chart' ELSE 'A chart' END
  || CASE WHEN title <> '' THEN ' titled ''' || title || '''' ELSE '' END
  || CASE WHEN x_axis <> '' AND y_axis <> '' THEN ' showing ' || y_axis || ' versus ' || x_axis WHEN x_axis <> '' THEN ' with x-axis: ' || x_axis ELSE '' END
  || CASE WHEN len(legend) > 0 THEN ' with legend entries: ' || array_to_string(legend[1:5], ', ') ELSE '' END
  || CASE WHEN n > 0 THEN ' containing ' || n || ' data points' ELSE '' END || '.' AS description
  FROM (SELECT *, {_KIND} AS kind, {_LEGEND} AS legend, doc_id % 11 AS n FROM ({_AXES}))""")
def chart_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    kind = F.when(m == 0, "unknown").when(m == 1, "bar").otherwise("line")
    n = (F.col("doc_id") % 8).cast("int")
    legend = F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), F.lit(1), n), lambda i: F.concat(F.lit("s"), i.cast("string")))
    rows = chart_axes(spark, sf_dir)
    return rows.select("doc_id", dx.chart_description(kind, F.col("title"), F.col("x_axis"), F.col("y_axis"), legend, F.col("doc_id") % 11).alias("description"))


@query("chart_values", """SELECT event_id, CAST(n AS INTEGER) AS n, x, y FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 ELSE 1 END AS n,
  CASE event_id % 3 WHEN 1 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS x, CASE event_id % 3 WHEN 1 THEN NULL ELSE event_type END AS y FROM events)""")
def chart_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.format_string('["%d","%s"]', F.col("event_id"), F.col("event_type"))
    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.concat(F.lit("["), pair, F.lit(',[1],{"k":"v"}]'))).when(m == 1, F.lit('[{"k":"v"},["a"]]')).otherwise(F.concat(F.lit("["), pair, F.lit("]")))
    rows = table(spark, sf_dir, "events").select("event_id", dx.chart_values(raw).alias("v"))
    return rows.select("event_id", F.size("v").alias("n"), F.try_element_at(F.col("v")[0], F.lit("x")).alias("x"), F.try_element_at(F.col("v")[0], F.lit("y")).alias("y"))


_OCR = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Model | Acc |' || chr(10) || lang || ' | ' || doc_id || chr(10) || ' | ' WHEN 1 THEN ' A  B C ' || chr(10) || lang || ' ' || source
  ELSE '' END AS t FROM documents"""


@query("table_ocr", rf"""WITH l AS (SELECT doc_id, {_STRIPPED} AS l FROM ({_OCR})),
  g AS (SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: contains(x, '|'))) > 0 THEN list_filter(list_transform(l, lambda x: list_filter(list_transform(string_split(x, '|'),
   lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) > 0) ELSE list_transform(l, lambda x: string_split_regex(x, '\s+')) END AS g FROM l)
  SELECT doc_id, coalesce(array_to_string(g[1], '/'), '') AS columns, array_to_string(list_transform(g[2:], lambda r: array_to_string(r, '/')), ';') AS rows FROM g""")
def table_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    text = F.when(m == 0, F.concat(F.lit("Model | Acc |\n"), "lang", F.lit(" | "), F.col("doc_id").cast("string"), F.lit("\n | "))).when(
        m == 1, F.concat(F.lit(" A  B C \n"), "lang", F.lit(" "), "source")).otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", dx.ocr_table(text).alias("t"))
    return rows.select("doc_id", F.array_join("t.columns", "/").alias("columns"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "/")), ";").alias("rows"))


_ORDER_TABLES = """SELECT o_orderkey, list_transform(range(1, o_orderkey % 9 + 1), lambda i: 'c' || i) AS headers,
  coalesce(r, []) AS rows FROM orders LEFT JOIN (SELECT l_orderkey, list([l_returnflag, l_linestatus] ORDER BY l_linenumber, l_returnflag, l_linestatus) AS r FROM lineitem GROUP BY l_orderkey)
  ON l_orderkey = o_orderkey"""


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("r"))
    headers = F.transform(F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), (F.col("o_orderkey") % 9).cast("int")), lambda i: F.concat(F.lit("c"), i.cast("string")))
    rows = F.coalesce(F.transform("r", lambda x: F.array(x["l_returnflag"], x["l_linestatus"])), F.expr("cast(array() as array<array<string>>)"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", headers.alias("headers"), rows.alias("rows"))


@query("table_chunk_text", f"""SELECT o_orderkey, CASE WHEN t <> '' THEN t WHEN o_orderkey % 2 = 0 THEN 'raw' END AS text FROM (SELECT o_orderkey,
  array_to_string(CASE WHEN len(headers) > 0 THEN ['Headers: ' || array_to_string(headers, ' | ')] ELSE [] END || list_transform(rows[1:20], lambda r: array_to_string(r, ' | ')), chr(10)) AS t
  FROM ({_ORDER_TABLES}))""")
def table_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, " raw ").otherwise("")
    return _order_tables(spark, sf_dir).select("o_orderkey", tx.table_text(F.col("headers"), F.col("rows"), raw).alias("text"))


@query("table_description", f"""SELECT o_orderkey, 'Table' || CASE WHEN len(headers) > 0 THEN ' with columns: ' || array_to_string(headers[1:6], ', ')
   || CASE WHEN len(headers) > 6 THEN ' and ' || (len(headers) - 6) || ' more columns' ELSE '' END ELSE '' END
   || CASE WHEN len(rows) > 0 THEN ' containing ' || len(rows) || ' rows of data' ELSE '' END || '.' AS description, 'docling' AS extraction_method FROM ({_ORDER_TABLES})""")
def table_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dx.parsed_table(F.struct("headers", "rows"))
    return _order_tables(spark, sf_dir).select("o_orderkey", made["description"].alias("description"), made["extraction_method"].alias("extraction_method"))


EQUATIONS = [("x = sigma + Alpha (1)", 100, 50), ("E[Loss] = beta lambda", 400, 100), ("mu", 10, 10), ("cross entropy [Eq. 3]", 1, 0), ("", 500, 10), ("  ", 2, 2),
             ("KL-div of probability", 31, 10), ("f(x) = lim sum", 30, 10), ("gradient sigmax", 301, 100), ("a_b^c ( 12 )", 1, 1)]
_EQ = "(VALUES " + ", ".join(f"({i}, '{t}', {w}, {h})" for i, (t, w, h) in enumerate(EQUATIONS)) + ") AS e(id, t, w, h)"
_LATEX = "t"
for _name, _sign in dx.GREEK:
    _LATEX = rf"regexp_replace({_LATEX}, '(?i)\b{_name}\b', '{_sign}', 'g')"
_LATEX = rf"regexp_replace({_LATEX}, '^\s+|\s+$', '', 'g')"
_EQ_TYPE = rf"CASE WHEN regexp_matches(t, '{dx.NUMBERED}') THEN 'numbered' WHEN w / greatest(h, 1) > 3.0 THEN 'display' ELSE 'inline' END"


def _equations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EQUATIONS)], "id long, t string, w int, h int")


@query("equation_type", f"SELECT CAST(id AS BIGINT) AS id, {_EQ_TYPE} AS equation_type FROM {_EQ}")
def equation_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _equations(spark).select("id", dx.equation_type(F.col("t"), F.col("w"), F.col("h")).alias("equation_type"))


@query("equation_latex", f"SELECT CAST(id AS BIGINT) AS id, {_LATEX} AS latex, regexp_matches(t, '{dx.MATHS}') AS has_maths FROM {_EQ}")
def equation_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _equations(spark).select("id", dx.latex(F.col("t")).alias("latex"), dx.has_maths(F.col("t")).alias("has_maths"))


@query("equation_description", f"""SELECT CAST(id AS BIGINT) AS id, 'Mathematical ' || k || ' equation.' || CASE WHEN l <> '' THEN ' Expression: ' || substr(l, 1, 200)
  WHEN t <> '' THEN ' Expression: ' || substr(t, 1, 200) ELSE '' END || CASE WHEN s <> '' THEN ' Related to: ' || s || '.' ELSE '' END AS description
  FROM (SELECT id, t, {_LATEX} AS l, {_EQ_TYPE} AS k, regexp_extract(t, '{dx.SUBJECTS}', 0) AS s FROM {_EQ})""")
def equation_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = dx.equation_type(F.col("t"), F.col("w"), F.col("h"))
    return _equations(spark).select("id", dx.equation_description(F.col("t"), dx.latex(F.col("t")), kind).alias("description"))


_KINDS = "list_value(" + ", ".join(f"'{k}'" for k in VISUAL_TYPES) + ")"


def _kind() -> F.Column:
    return F.element_at(F.array(*[F.lit(k) for k in VISUAL_TYPES]), (F.col("vec_id") % len(VISUAL_TYPES) + 1).cast("int"))


@query("visual_captions", f"""SELECT vec_id, kind, upper(kind[1]) || kind[2:] || ' on page ' || label AS caption, map {{{', '.join(f"'{k}': '{v}'" for k, v in dx.FALLBACK.items())}}}[kind] AS description,
  md5(map {{{', '.join(f"'{k}': '{v}'" for k, v in models.PROMPTS.items())}}}[kind]) AS prompt_md5 FROM (SELECT *, {_KINDS}[vec_id % 9 + 1] AS kind FROM embeddings)""")
def visual_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", _kind().alias("kind"))
    return rows.select("vec_id", "kind", tx.visual_caption(F.col("kind"), F.col("label")).alias("caption"), dx.fallback_description(F.col("kind")).alias("description"),
                       F.md5(models.prompt(F.col("kind"))).alias("prompt_md5"))


@query("embedding_text", f"""SELECT vec_id, CASE WHEN t <> '' THEN t ELSE kind || ' on page ' || label END AS text FROM (SELECT vec_id, kind, label, concat_ws(' ',
   CASE WHEN vec_id % 2 = 0 THEN 'Caption: cap ' || vec_id END, CASE WHEN vec_id % 3 = 0 THEN 'Description: desc' END,
   CASE WHEN kind = 'table' AND vec_id % 5 > 0 THEN 'Table: t' END, CASE WHEN kind = 'chart' AND vec_id % 5 > 0 THEN 'Chart: c' END,
   CASE WHEN kind = 'equation' AND vec_id % 5 > 0 THEN 'Equation: e' END) AS t FROM (SELECT *, {_KINDS}[vec_id % 9 + 1] AS kind FROM embeddings))""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("page"), _kind().alias("kind"))
    caption = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("cap "), F.col("vec_id").cast("string"))).otherwise("")
    data = lambda x: F.when(F.col("vec_id") % 5 > 0, x)
    made = tx.embedding_text(caption, F.when(F.col("vec_id") % 3 == 0, "desc").otherwise(""), F.col("kind"), F.col("page"), data("t"), data("c"), data("e"))
    return rows.select("vec_id", made.alias("text"))


_FEATURES = {"edges": (7, 0.02), "white": (5, 0.2), "aspect": (6, 0.5), "hue": (9, 5.0), "contours": (11, 6.0), "lines": (4, 0.006), "rects": (8, 1.0)}


@query("image_decision", f"""SELECT event_id, CASE WHEN white > 0.75 AND edges < 0.12 AND hue < 15 THEN 'equation' WHEN lines > 0.015 AND contours > 10 THEN 'table'
   WHEN (aspect > 2 OR aspect < 0.4) AND hue < 20 THEN 'screenshot' WHEN hue > 30 AND contours < 50 AND edges < 0.15 THEN 'chart' WHEN rects > 5 AND edges > 0.05 THEN 'flowchart'
   WHEN edges > 0.10 AND contours > 30 AND hue < 40 THEN 'architecture' WHEN contours > 15 AND edges > 0.05 THEN 'diagram' ELSE 'figure' END AS class
   FROM (SELECT event_id, {', '.join(f"((event_id * {m * 7919} + {m}) // 13 % {m} + 0.3) * {s} AS {c}" for c, (m, s) in _FEATURES.items())} FROM events)""")
def image_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [((F.floor((F.col("event_id") * (m * 7919) + m) / 13) % m + 0.3) * s).alias(c) for c, (m, s) in _FEATURES.items()]
    rows = table(spark, sf_dir, "events").select("event_id", *made)
    return rows.select("event_id", dx.image_class(*[F.col(c) for c in _FEATURES])["class"].alias("class"))


@query("image_sizes", """SELECT p_partkey, CAST(CASE WHEN least(w, h) > 1024 THEN floor(w * (1024.0 / least(w, h))) ELSE w END AS INTEGER) AS width,
  CAST(CASE WHEN least(w, h) > 1024 THEN floor(h * (1024.0 / least(w, h))) ELSE h END AS INTEGER) AS height, least(p_size * 50, p_partkey) >= 32 AS processed
  FROM (SELECT p_partkey, p_size, CASE WHEN greatest(a, b) > 2048 THEN floor(a * (2048.0 / greatest(a, b))) ELSE a END AS w,
   CASE WHEN greatest(a, b) > 2048 THEN floor(b * (2048.0 / greatest(a, b))) ELSE b END AS h FROM (SELECT p_partkey, p_size, CAST(p_size * 100 AS DOUBLE) AS a, CAST(p_partkey * 2 + 16 AS DOUBLE) AS b FROM part))""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = dx.fitted_size((F.col("p_size") * 100).cast("double"), (F.col("p_partkey") * 2 + 16).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"),
                                               (F.least(F.col("p_size") * 50, F.col("p_partkey")) >= 32).alias("processed"))


BOXES = [None, {}, {"broken": "data"}, {"x0": "1", "y0": "2.5", "x1": "3", "y1": "4"}, {"x0": "bad"}, {"y1": "7"}]


@query("bounding_boxes", "SELECT CAST(id AS BIGINT) AS id, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1 FROM "
       "(VALUES (0, NULL, NULL), (1, NULL, NULL), (2, 0, 0), (3, 1, 4), (4, NULL, NULL), (5, 0, 7)) AS t(id, x0, y1)")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(BOXES)), "id long, b map<string,string>")
    return rows.select("id", dx.bounding_box(F.col("b")).alias("b")).select("id", "b.x0", "b.y1")


@query("chart_kinds", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'pie' WHEN event_id % 13 > 2 * (event_id % 5) THEN 'bar' ELSE 'line' END AS kind FROM events")
def chart_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", dx.chart_class(F.when(key % 7 == 0, 1).otherwise(0), key % 13, key % 5).alias("kind"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).cast("string").alias("document_id"), F.col("vec_id").alias("n"), _kind().alias("chunk_type"))
    return rows.withColumns({"page": F.col("n").cast("int") % 5 + 1, "image_number": F.col("n").cast("int"), "image_path": F.concat(F.lit("i"), F.col("n").cast("string")),
                             "ocr_text": F.concat(F.lit("Title\nalpha loss\nEpoch "), F.col("n").cast("string")), "width": F.lit(400), "height": F.lit(100),
                             "source_file": F.lit("f.pdf")})


_MM = f"""SELECT CAST(vec_id // 20 AS VARCHAR) AS d, vec_id, vec_id % 5 + 1 AS page, {_KINDS}[vec_id % 9 + 1] AS kind FROM embeddings"""


@query("multimodal_chunks", f"""SELECT 'img_' || d || '_' || page || '_' || vec_id AS chunk_id, kind AS chunk_type, 'Caption: ' || upper(kind[1]) || kind[2:] || ' on page ' || page || ' Description: ' ||
   map {{{', '.join(f"'{k}': '{v}'" for k, v in dx.FALLBACK.items())}}}[kind] || CASE kind WHEN 'chart' THEN ' Chart: A chart titled ''Title'' showing Epoch ' || vec_id || ' versus alpha loss.'
   WHEN 'table' THEN ' Table: Table with columns: Title containing 2 rows of data.' WHEN 'equation' THEN ' Equation: Mathematical display equation. Expression: Title' || chr(10) || 'α loss' || chr(10) || 'Epoch ' || vec_id || ' Related to: loss.'
   ELSE '' END AS embedding_text FROM ({_MM})""")
def multimodal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = multimodal.image_chunks(multimodal.described(_images(spark, sf_dir)))
    return made.select("chunk_id", "chunk_type", multimodal.element_text().alias("embedding_text"))


@query("table_reextraction", """SELECT l_orderkey AS document_id, l_linenumber AS table_number, CASE WHEN f.flag IS NULL THEN 'docling' ELSE 'camelot_' || f.flag END AS method FROM lineitem l
  LEFT JOIN (SELECT o_orderkey, min(o_orderstatus) AS flag FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderkey) f ON f.o_orderkey = l.l_orderkey""")
def table_reextraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("table_number"),
                                                     F.array(F.lit("h")).alias("headers"), F.array(F.array(F.lit("c"))).alias("rows"))
    data = F.struct(F.array(F.lit("h")).alias("columns"), F.array(F.array(F.lit("c"))).alias("rows"), F.lit("").alias("description"),
                    F.concat(F.lit("camelot_"), "o_orderstatus").alias("extraction_method"))
    again = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page"),
                                                                               F.col("o_orderstatus").alias("seq"), data.alias("data"))
    return multimodal.table_chunks(tables, again).select("document_id", "table_number", F.col("table_data.extraction_method").alias("method"))


@query("index_stats", f"""SELECT coalesce(i.d, t.d) AS document_id, coalesce(charts, 0) AS charts, coalesce(equations, 0) AS equations, coalesce(figures, 0) AS figures, coalesce(tables, 0) AS tables FROM
  (SELECT d, count(*) FILTER (WHERE kind = 'chart') AS charts, count(*) FILTER (WHERE kind = 'equation') AS equations, count(*) FILTER (WHERE kind NOT IN ('chart', 'equation')) AS figures FROM ({_MM}) GROUP BY d) i
  FULL JOIN (SELECT CAST(o_orderkey % 40 AS VARCHAR) AS d, count(*) AS tables FROM orders GROUP BY ALL) t ON i.d = t.d""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).cast("string").alias("document_id"))
    return multimodal.element_counts(_images(spark, sf_dir), tables)
