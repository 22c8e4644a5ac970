"""Secret scans: base patterns plus character Markov models, all in Catalyst expressions.

Two first-order Markov models over character classes, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A token whose log-likelihood ratio favours the random
model is reported beside the matches of the base patterns, unless one of these is the very same span. Weights are
whole thousandths of a nat, so sums are exact in any engine.

Null texts count as empty (``redact`` leaves them null). Very long texts with very many matches take time in
proportion: places come from sums in blocks, and masked texts are put together from chunks. Rows are independent:
repeated rows give repeated results, an empty table gives none. Other columns, whatever their names, are ignored by ``scan``
and kept as they are by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 12

#: Character classes: a-z by themselves, then upper case, digits and the rest.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = LETTERS + "ABC"
#: From these thousandths of a nat per transition on, a token counts as random.
THRESHOLD = 350

#: Parts of which the built-in sample of ordinary identifiers is put together.
PARTS = (
    "account action address answer array batch block buffer cache change check child class client code column "
    "common config content context control count create current data date default delete document element "
    "error event field file filter final first format function general group handler header history image "
    "index information input internal interval item language length level line list local location manager "
    "message method model module name national network number object operation option order organization "
    "other output package page parameter parent path pattern person point position process product program "
    "project property public query question range reason record reference region relation report request "
    "resource response result return schedule search section select server service session setting simple "
    "source standard start state status stream string structure system table target template test text "
    "thread time transaction transport type update user value vector version view window work write"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """The built-in labelled sample, by rule: ``n`` random strings and ``n`` identifiers (text, random)."""
    ids = spark.range(n)
    raw = F.unhex(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256))
    random = F.when(F.col("id") % 3 == 0, F.lower(F.hex(raw))).otherwise(
        F.regexp_replace(F.base64(raw), "[\\r\\n=]", "")
    )
    parts = F.array(*[F.lit(p) for p in PARTS])

    def part(i: int) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(i)))), 1, 7), 16, 10).cast("long")
        word = F.element_at(parts, (drawn % len(PARTS) + 1).cast("int"))
        style = F.col("id") % 4
        return F.when(style == 1, F.initcap(word)).when(style == 2, F.upper(word)).otherwise(word)

    joint = F.when(F.col("id") % 4 == 0, "_").when(F.col("id") % 4 == 3, F.element_at(
        F.array(F.lit("-"), F.lit("/"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))).otherwise(
        F.when(F.col("id") % 4 == 2, "_").otherwise(""))
    tail = F.when(F.col("id") % 10 == 0, (F.col("id") % 100).cast("string")).otherwise("")
    words = F.concat(part(1), joint, part(2), joint, part(3), joint, part(4), tail)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(
        ids.select(words.alias("text"), F.lit(False).alias("random")))


def _classes(text: Column) -> Column:
    """The text's character classes, as indices from 0."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        text, "[^A-Za-z0-9]", "~"), "[A-Z]", "A"), "[0-9]", "B")
    plain = F.translate(plain, "~", "C")
    return F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(CLASSES), c) - 1)


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios random : ordinary of all class transitions, in thousandths of a nat.

    ``samples`` has text and random (boolean). Counts are smoothed by one; the result has
    ``len(CLASSES) ** 2`` entries whatever the size of the sample.
    """
    k = len(CLASSES)
    codes = samples.filter("text is not null and random is not null and length(text) > 1").select(
        "random", _classes(F.col("text")).alias("c"))
    pairs = codes.select("random", F.explode(F.zip_with(
        F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda a, b: a * k + b)).alias("t"))
    counts = pairs.groupBy("t").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    grid = samples.sparkSession.range(k * k).select(F.col("id").cast("int").alias("t"))
    full = grid.join(counts, "t", "left").select(
        "t", (F.coalesce("r", F.lit(0)) + 1).alias("r"), (F.coalesce("o", F.lit(0)) + 1).alias("o"),
        F.expr(f"t div {k}").alias("a"))
    sums = full.groupBy("a").agg(F.sum("r").alias("sr"), F.sum("o").alias("so"))
    weight = F.round(1000 * (F.log(F.col("r") / F.col("sr")) - F.log(F.col("o") / F.col("so")))).cast("int")
    return [r.w for r in full.join(sums, "a").select("t", weight.alias("w")).orderBy("t").collect()]


def llr(text: Column, weights: list[int]) -> Column:
    """Sum of the transitions' ratios of one token."""
    k = len(CLASSES)
    table = F.array(*[F.lit(int(w)) for w in weights])
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        more = F.when(acc["last"] < 0, 0).otherwise(F.element_at(table, acc["last"] * k + c + 1))
        return F.struct(c.alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(_classes(text), start, step, lambda acc: acc["sum"])


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is worked out once, also where ``use`` needs it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, combine, block: int = 128) -> Column:
    """``combine`` (a sum, a maximum) of 0 and the entries before each entry, in blocks: its work grows with the entries."""
    fold = lambda a: F.aggregate(a, F.lit(0).cast("int"), combine)

    def of(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, b * block + 1, block)))
        heads = _bound(blocks, lambda t: F.transform(t, lambda _, i: fold(F.slice(t, F.lit(1), i))))
        return _bound(heads, lambda h: F.transform(v, lambda _, i: combine(
            F.element_at(h, (i / block).cast("int") + 1), fold(F.slice(v, (i / block).cast("int") * block + 1, i % block)))))

    return _bound(values, of)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: str, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches, in code points.

    The pieces between the matches come from ``split`` with the same pattern; only texts with a
    match are split. ``keep`` gets the array of matches and returns an array of booleans.
    """
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    pieces = F.split(t, pattern, -1)
    sizes = F.zip_with(F.transform(pieces, F.length), F.transform(found, F.length),
                       lambda p, m: F.struct(p.alias("p"), F.coalesce(m, F.lit(0)).alias("m")))
    before = _before(F.transform(sizes, lambda s: s["p"] + s["m"]), _sum)
    made = F.transform(F.slice(F.zip_with(sizes, before, lambda s, b: F.struct(s["p"].alias("p"), s["m"].alias("m"), b.alias("b"))),
                               F.lit(1), F.size(found)),
                       lambda s: F.struct((s["b"] + s["p"]).cast("int").alias("start"), F.lit(rank).alias("rank"),
                                          F.lit(kind).alias("kind"), (s["b"] + s["p"] + s["m"]).cast("int").alias("end")))
    if keep is not None:
        chosen = F.zip_with(made, keep(found), lambda s, k: F.when(k, s))
        made = F.filter(chosen, lambda s: s.isNotNull())
    return F.when(t.rlike(pattern), made).otherwise(F.expr(f"cast(array() as {SPAN})")).cast(SPAN)


def _text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame, weights: list[int], text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (arrays of start, rank, kind, end by start, rank)."""
    t = "__scanned"
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    group = F.regexp_extract_all(F.col(t), F.lit(ASSIGN), F.lit(2))
    df = df.withColumn("__assign", _spans(t, ASSIGN, "assign", 0, lambda _: F.transform(
        group, lambda g: F.length(g) >= MIN_ASSIGNED)))
    df = df.withColumn("__access", _spans(t, ACCESS, "access", 1)).withColumn("__hex", _spans(t, HEX, "hex", 2))
    ratio = lambda m: llr(m, weights) >= THRESHOLD * (F.length(m) - 1)
    df = df.withColumn("__random", _spans(t, TOKEN, "random", 3, lambda found: F.transform(found, ratio)))
    df = df.withColumn("base_spans", F.array_sort(F.concat("__assign", "__access", "__hex")))
    place = lambda x: x["start"].cast("long") * (1 << 31) + x["end"]
    fresh = F.array_except(F.transform("__random", place), F.transform("base_spans", place))
    added = F.transform(fresh, lambda x: F.struct((x / (1 << 31)).cast("int").alias("start"), F.lit(3).alias("rank"),
                                                  F.lit("random").alias("kind"), (x % (1 << 31)).cast("int").alias("end"))).cast(SPAN)
    return df.withColumn("all_spans", F.when(F.size("__random") == 0, F.col("base_spans")).otherwise(
        F.array_sort(F.concat("base_spans", added)))).drop(t)


def scan(docs: DataFrame, weights: list[int]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts by kind, digest of the base spans and all spans as text."""
    df = find(docs.select("doc_id", "text"), weights)
    return df.select(
        "doc_id",
        F.size("__assign").cast("long").alias("n_assign"),
        F.size("__access").cast("long").alias("n_access"),
        F.size("__hex").cast("long").alias("n_hex"),
        F.sha2(_text_of(F.col("base_spans")), 256).alias("base_sha256"),
        _text_of(F.col("all_spans")).alias("spans"),
    )


#: Code points of a chunk of text in ``redact``.
PART = 4096


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` for each run of overlapping spans, which are in order of their starts."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PART).cast("int")),
                        lambda i: F.substring(text, (i * PART + 1).cast("int"), F.lit(PART)))
    reached = _before(F.transform(spans, lambda s: s["end"]), _most)
    gaps = F.zip_with(spans, reached, lambda s, r: F.struct(r.alias("a"), s["start"].alias("b")))
    end = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("a"), F.length(text).alias("b"))

    def with_parts(chunks: Column) -> Column:
        def piece(g: Column) -> Column:
            first, last = (g["a"] / PART).cast("int"), (g["b"] / PART).cast("int")
            head = F.substring(F.element_at(chunks, first + 1), (g["a"] % PART + 1).cast("int"), F.lit(PART))
            middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.substring(F.element_at(chunks, last + 1), F.lit(1), g["b"] % PART)
            one = F.substring(F.element_at(chunks, first + 1), (g["a"] % PART + 1).cast("int"), g["b"] - g["a"])
            return F.when(first == last, one).otherwise(F.concat(head, middle, tail))

        apart = F.filter(gaps, lambda g: g["a"] <= g["b"])
        return F.concat(F.array_join(F.transform(apart, lambda g: F.concat(piece(g), F.lit(mask))), ""),
                        _bound(end, piece))

    return _bound(parts, with_parts)


def redact(docs: DataFrame, weights: list[int], mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mask``; overlapping spans give one mask."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    df = find(row, weights)
    masked = F.when(F.size("all_spans") > 0, _masked(F.col("text"), F.col("all_spans"), mask)).otherwise(F.col("text"))
    return df.select(*[(masked if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def oracle_sql(samples: int = 4000) -> str:
    """DuckDB SQL for ``scan`` over ``documents``, trained on the built-in sample."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    k = len(CLASSES)

    def classes(x: str) -> str:
        plain = f"regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]', '~', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', 'B', 'g')"
        return f"list_transform(string_split(replace({plain}, '~', 'C'), ''), lambda c: instr('{CLASSES}', c) - 1)"

    def part(i: int) -> str:
        return f"CAST('0x' || substr(md5(id || '-{i}'), 1, 7) AS BIGINT) % {len(PARTS)} + 1"

    words = [f"CASE id % 4 WHEN 1 THEN upper(w{i}[1]) || w{i}[2:] WHEN 2 THEN upper(w{i}) ELSE w{i} END" for i in range(1, 5)]
    joint = "CASE id % 4 WHEN 0 THEN '_' WHEN 3 THEN ['-', '/', ''][id % 3 + 1] WHEN 2 THEN '_' ELSE '' END"
    length = "list_transform({}, lambda x: length(x))"

    def spans(pattern: str, kind: str, rank: int) -> str:
        """All matches' spans as a list of structs, with the match."""
        return (f"(SELECT doc_id, t, list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST(list_sum({length.format('p[1:i]')}) "
                f"+ coalesce(list_sum({length.format('m[1:i - 1]')}), 0) AS BIGINT), 'rank': {rank}, 'kind': '{kind}', "
                f"'end': CAST(list_sum({length.format('p[1:i]')}) + list_sum({length.format('m[1:i]')}) AS BIGINT), 'found': m[i], 'given': g[i]}}) AS s "
                f"FROM (SELECT doc_id, t, regexp_extract_all(t, {quoted(pattern)}, 0) AS m, "
                f"{'regexp_extract_all(t, ' + quoted(pattern) + ', 2)' if kind == 'assign' else '[]::VARCHAR[]'} AS g, "
                f"string_split_regex(t, {quoted(pattern)}) AS p FROM docs))")

    bare = "list_transform({}, lambda x: {{'start': x['start'], 'rank': x['rank'], 'kind': x['kind'], 'end': x['end']}})"
    texts = "array_to_string(list_transform({}, lambda x: x['kind'] || ':' || x['start'] || ':' || x['end']), ',')"
    return f"""WITH ids AS (SELECT id, {', '.join(f"[{', '.join(quoted(p) for p in PARTS)}][{part(i)}] AS w{i}" for i in range(1, 5))} FROM range({samples}) t(id)),
 samples AS (SELECT CASE WHEN id % 3 = 0 THEN sha256('sample-' || id) ELSE replace(base64(unhex(sha256('sample-' || id))), '=', '') END AS x, true AS random FROM ids
   UNION ALL SELECT {(' || ' + joint + ' || ').join(words)} || CASE WHEN id % 10 = 0 THEN CAST(id % 100 AS VARCHAR) ELSE '' END, false FROM ids),
 pairs AS (SELECT random, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {k} + c[i + 1])) AS t FROM (SELECT random, {classes('x')} AS c FROM samples)),
 grid AS (SELECT g.t, g.t // {k} AS a, 1 + count(*) FILTER (WHERE random) AS r, 1 + count(*) FILTER (WHERE NOT random) AS o
   FROM range({k * k}) g(t) LEFT JOIN pairs p ON p.t = g.t GROUP BY ALL),
 weights AS (SELECT list(w ORDER BY t) AS w FROM (SELECT t, CAST(round(1000 * (ln(r / sum(r) OVER (PARTITION BY a)) - ln(o / sum(o) OVER (PARTITION BY a)))) AS BIGINT) AS w FROM grid)),
 docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 named AS (SELECT doc_id, list_filter(s, lambda x: length(x['given']) >= {MIN_ASSIGNED}) AS s FROM {spans(ASSIGN, 'assign', 0)}),
 keys AS {spans(ACCESS, 'access', 1)}, hexes AS {spans(HEX, 'hex', 2)},
 tokens AS (SELECT doc_id, list_filter(s, lambda x: list_sum(list_transform(range(1, length(x['found'])),
   lambda i: w[{classes("x['found']")}[i] * {k} + {classes("x['found']")}[i + 1] + 1])) >= {THRESHOLD} * (length(x['found']) - 1)) AS s FROM {spans(TOKEN, 'random', 3)}, weights),
 base AS (SELECT doc_id, len(a.s) AS n_assign, len(b.s) AS n_access, len(c.s) AS n_hex,
   list_sort({bare.format('a.s')} || {bare.format('b.s')} || {bare.format('c.s')}) AS s FROM named a JOIN keys b USING (doc_id) JOIN hexes c USING (doc_id))
 SELECT doc_id, n_assign, n_access, n_hex, sha256({texts.format('s')}) AS base_sha256, {texts.format('list_sort(s || more)')} AS spans
 FROM (SELECT base.*, {bare.format("list_filter(tokens.s, lambda x: len(list_filter(base.s, lambda y: y['start'] = x['start'] AND x['end'] = y['end'])) = 0)")} AS more
   FROM base JOIN tokens USING (doc_id))"""
