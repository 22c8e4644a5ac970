"""Expressions that classify and describe charts, tables, equations and images."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import let, strip

# Chart kinds by the names an extractor gives them.
CHART_KINDS = {"bar": "bar", "grouped_bar": "bar", "stacked_bar": "bar", "line": "line", "scatter": "scatter",
               "pie": "pie", "area": "line", "histogram": "bar"}
# Words that mark an axis label.
AXIS = "(?i)(accuracy|loss|epoch|iteration|f1|precision|recall|score|value|count|percentage|time|error)"
# Names of Greek letters in equations, their signs, subjects, signs of mathematics.
GREEK = (("sigma", "σ"), ("alpha", "α"), ("beta", "β"), ("lambda", "λ"), ("mu", "μ"))
SUBJECTS = "(?i)(cross.?entropy|loss|accuracy|gradient|derivative|probability|expectation|variance|covariance|KL.?div)"
MATHS = r"[∑∏∫∂∇±×÷≤≥≠∞√α-ωΑ-Ω]|\b(lim|sum|prod|int|frac|sqrt|log|exp|sin|cos|tan|max|min|arg)\b"
NUMBERED = r"(?i)\(\s*\d+\s*\)|\[eq\.?\s*\d+\s*\]"
# Descriptions used without a captioning model, by class.
FALLBACK = {
    "figure": "Scientific figure extracted from research document.",
    "diagram": "Technical diagram showing system components and relationships.",
    "flowchart": "Flowchart depicting a process or algorithm.",
    "architecture": "Neural network or system architecture diagram.",
    "chart": "Data chart or graph visualising experimental results.",
    "table": "Data table with rows and columns.",
    "equation": "Mathematical equation or formula.",
    "screenshot": "Screenshot of an interface or application.",
    "unknown": "Visual element extracted from research document.",
}
# Limits: values of a chart, legend entries and columns named, characters of an expression.
VALUES, LEGEND, COLUMNS, EXPRESSION = 100, 5, 6, 200


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key), F.lit(default))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def chart_type(raw: Column) -> Column:
    return _lookup(CHART_KINDS, F.lower(raw), "unknown")


def chart_axes(text: Column) -> Column:
    """(title, x_axis, y_axis) of text read from a chart: its first line, and the first two later lines
    that name a measure."""
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    later = lambda lines: F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x.rlike(AXIS))
    return let(_lines(text), lambda lines: let(later(lines), lambda named: F.struct(
        at(lines, 1).alias("title"), at(named, 1).alias("x_axis"), at(named, 2).alias("y_axis"))))


def chart_values(raw: Column) -> Column:
    """Points of a chart, from JSON: objects stay, lists of two or more give x and y, at most 100."""
    items = F.from_json(raw, "array<string>")
    objects = F.transform(items, lambda i: F.when(i.startswith("{"), F.from_json(i, "map<string,string>")).when(
        i.startswith("[") & (F.size(F.from_json(i, "array<string>")) >= 2),
        F.create_map(F.lit("x"), F.from_json(i, "array<string>")[0], F.lit("y"), F.from_json(i, "array<string>")[1])))
    return F.slice(F.filter(objects, lambda o: o.isNotNull()), 1, VALUES)


def chart_description(kind: Column, title: Column, x_axis: Column, y_axis: Column, legend: Column, n_values: Column) -> Column:
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat(F.concat_ws(
        " ",
        F.when(full(kind) & (kind != "unknown"), F.concat(F.lit("A "), kind, F.lit(" chart"))).otherwise("A chart"),
        F.when(full(title), F.concat(F.lit("titled '"), title, F.lit("'"))),
        F.when(full(x_axis) & full(y_axis), F.concat(F.lit("showing "), y_axis, F.lit(" versus "), x_axis)).when(
            full(x_axis), F.concat(F.lit("with x-axis: "), x_axis)),
        F.when(F.size(legend) > 0, F.concat(F.lit("with legend entries: "), F.array_join(F.slice(legend, 1, LEGEND), ", "))),
        F.when(n_values > 0, F.concat(F.lit("containing "), n_values.cast("string"), F.lit(" data points"))),
    ), F.lit("."))


def ocr_table(text: Column) -> Column:
    """(columns, rows) of a table read by OCR: cells between bars if any line has one, else words."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")
    grid = let(_lines(text), lambda lines: F.when(
        F.exists(lines, lambda x: x.contains("|")), F.filter(F.transform(lines, cells), lambda r: F.size(r) > 0)).otherwise(
        F.transform(lines, lambda x: F.split(x, r"(?U)\s+"))))
    none = F.expr("cast(array() as array<string>)")
    return let(grid, lambda g: F.struct(F.coalesce(F.try_element_at(g, F.lit(1)), none).alias("columns"),
                                        F.slice(g, 2, F.greatest(F.size(g), F.lit(1))).alias("rows")))


def table_description(columns: Column, n_rows: Column) -> Column:
    more = F.size(columns) - COLUMNS
    return F.concat(F.concat_ws(
        " ",
        F.lit("Table"),
        F.when(F.size(columns) > 0, F.concat(
            F.lit("with columns: "), F.array_join(F.slice(columns, 1, COLUMNS), ", "),
            F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more columns"))).otherwise(""))),
        F.when(n_rows > 0, F.concat(F.lit("containing "), n_rows.cast("string"), F.lit(" rows of data"))),
    ), F.lit("."))


def parsed_table(table: Column) -> Column:
    """Table data of a table found while parsing."""
    cells = F.transform(table["rows"], lambda r: F.transform(r, lambda c: c.cast("string")))
    return F.struct(table["headers"].alias("columns"), cells.alias("rows"),
                    table_description(table["headers"], F.size(table["rows"])).alias("description"),
                    F.lit("docling").alias("extraction_method"))


def latex(text: Column) -> Column:
    """Text of an equation with names of Greek letters replaced by their signs."""
    made = text
    for name, sign in GREEK:
        made = F.regexp_replace(made, rf"(?i)\b{name}\b", sign)
    return strip(made)


def equation_type(text: Column, width: Column, height: Column) -> Column:
    wide = width / F.greatest(height, F.lit(1)) > 3.0
    return F.when(text.rlike(NUMBERED), "numbered").when(wide, "display").otherwise("inline")


def equation_description(text: Column, expression: Column, kind: Column) -> Column:
    shown = F.when(F.coalesce(expression, F.lit("")) != "", expression).otherwise(text)
    some = lambda label, c, end="": let(c, lambda v: F.when(v != "", F.concat(F.lit(label), v, F.lit(end))))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Mathematical "), kind, F.lit(" equation.")),
        some("Expression: ", F.substring(shown, 1, EXPRESSION)),
        some("Related to: ", F.regexp_extract(text, SUBJECTS, 0), "."),
    )


def has_maths(text: Column) -> Column:
    return text.rlike(MATHS)


def fallback_description(kind: Column) -> Column:
    return _lookup(FALLBACK, kind, FALLBACK["unknown"])


def bounding_box(box: Column) -> Column:
    """Box of a map of strings: null if null or empty, missing corners 0, null if one is no number."""
    corner = lambda k: F.coalesce(F.try_element_at(box, F.lit(k)), F.lit("0"))
    corners = [corner(k).try_cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]
    valid = corners[0].isNotNull()
    for k in ("y0", "x1", "y1"):
        valid = valid & corner(k).try_cast("double").isNotNull()
    return F.when(box.isNotNull() & (F.size(box) > 0) & valid, F.struct(*corners))


def image_class(edges: Column, white: Column, aspect: Column, hue: Column, contours: Column, lines: Column, rects: Column) -> Column:
    """(class, confidence) of an image by its pixel features: shares of edge and white pixels, aspect,
    spread of hue, outer contours, share of horizontal lines, rectangles."""
    pick = lambda kind, sure: F.struct(F.lit(kind).alias("class"), F.lit(sure).alias("confidence"))
    return (
        F.when((white > 0.75) & (edges < 0.12) & (hue < 15), pick("equation", 0.72))
        .when((lines > 0.015) & (contours > 10), pick("table", 0.68))
        .when(((aspect > 2.0) | (aspect < 0.4)) & (hue < 20), pick("screenshot", 0.60))
        .when((hue > 30) & (contours < 50) & (edges < 0.15), pick("chart", 0.65))
        .when((rects > 5) & (edges > 0.05), pick("flowchart", 0.62))
        .when((edges > 0.10) & (contours > 30) & (hue < 40), pick("architecture", 0.58))
        .when((contours > 15) & (edges > 0.05), pick("diagram", 0.55))
        .otherwise(pick("figure", 0.50))
    )


def chart_class(circles: Column, vertical: Column, horizontal: Column) -> Column:
    """Chart kind by shapes found in its pixels."""
    return F.when(circles > 0, "pie").when(vertical > 2 * horizontal, "bar").otherwise("line")


def fitted_size(width: Column, height: Column, longest: int = 2048, shortest: int = 1024) -> Column:
    """Size of an image for a vision model: longer side, then shorter side brought to a limit, never enlarged. A side that is
    less than a pixel then is 0."""
    share = lambda limit, side: F.when(side > limit, limit / side).otherwise(1.0)
    one = share(longest, F.greatest(width, height))
    w, h = F.floor(width * one), F.floor(height * one)
    two = share(shortest, F.least(w, h))
    return F.struct(F.floor(w * two).cast("int").alias("width"), F.floor(h * two).cast("int").alias("height"))
