"""Queries over texts, parsers and feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers, text
from ..operators import pages
from ..sources import files as files_source
from ..sources import html
from ..sources.tables import table
from ..streaming import progress
from .fixtures import LINES, lines, values
from .plans import query

SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
STRIP = rf"^[{SPACE}]+|[{SPACE}]+$"
BASE_LINES = rf"""parts AS (SELECT doc_id, regexp_split_to_array(text, '{BREAK}') AS p FROM documents),
kept AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, unnest(range(len(p)))::INT AS line_no, unnest(p) AS line FROM kept)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(text.clean(F.col("text")))).alias("line_no", "line"))


@query(f"WITH {BASE_LINES} SELECT doc_id, line_no, regexp_replace(line, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS line FROM lines")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, S4, SK4: lines of texts without control characters."""
    return document_lines(spark, sf_dir)


ODD = [(1, "a\x01b\tc\x0bd\r\ne"), (2, "﻿start 中文"), (3, " 　 "), (4, "<!-- x\ny --> ![a](b)"), (5, "<!-- x --> word"), (6, ""), (7, "12"), (8, "123"), (9, "• item"), (10, "3) item"), (11, "123. item"), (12, "-item"), (13, "ÉCOLE_1 é中!"), (14, "a\x1cb")]


@query(rf"""
SELECT id, regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS cleaned, regexp_replace(x, '[\x00-\x08\x0B-\x1F]', '', 'g') AS boxed, regexp_replace(x, '^\x{{FEFF}}', '') AS bomless, regexp_replace(x, '{STRIP}', '', 'g') AS stripped,
  regexp_matches(regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '[^{SPACE}]') AS meaningful,
  regexp_matches(x, '[\x{{3400}}-\x{{9FFF}}]') AS cjk, regexp_matches(x, '^[0-9]{{2}}$') AS two_digits, regexp_matches(x, '^[{SPACE}]*(?:[•●▪◆\-–]|\p{{Nd}}{{1,2}}[.)、])[{SPACE}]+') AS list_start,
  lower(regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS comparable, right(x, 4) AS ending
FROM {values(ODD, 'id, x')}
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14, P19, S1, S3, SC2, F3, F20-F22, T9: rules on texts that the tables don't hold."""
    x = F.col("x")
    rows = spark.createDataFrame(ODD, "id int, x string")
    return rows.select("id", text.clean(x).alias("cleaned"), text.clean(x, False).alias("boxed"), text.without_bom(x).alias("bomless"), text.strip(x).alias("stripped"), text.meaningful(x).alias("meaningful"), text.has_cjk(x).alias("cjk"), text.two_digits(x).alias("two_digits"), text.list_start(x).alias("list_start"), text.comparable(x).alias("comparable"), text.tail(x, 4).alias("ending"))


@query(rf"""
SELECT page_id, regexp_matches(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '[^{SPACE}]') AS meaningful, length(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'))::BIGINT AS chars FROM pages
""")
def meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with more than comments and images."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.meaningful(h).alias("meaningful"), F.length(text.bare(h)).cast("long").alias("chars"))


def html_sql() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in html.HIDDEN:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '[\\t-\\r ]+', ' ', 'g')"
    for n in range(1, 7):
        x = f"regexp_replace({x}, '(?i)<h{n}\\b[^>]*>', chr(10) || '{'#' * n} ', 'g')"
    x = f"regexp_replace({x}, '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{html.BLOCKS})\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in html.ENTITIES:
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{name}', '{quoted}')"
    x = f"regexp_replace({x}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '\\n{{2,}}', chr(10), 'g')"
    return f"SELECT page_id, regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '{STRIP}', '', 'g') AS text FROM pages"


@query(html_sql())
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3: text of pages."""
    return table(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("text"))


HEADINGS = [(1, "# One"), (2, "### Three  x"), (3, "###### Six"), (4, "####### Seven"), (5, "#None"), (6, "plain"), (7, "<!-- note --> "), (8, "<!-- note --> tail"), (9, "##\tTab"), (10, " # in")]
HEAD = rf"""CASE WHEN regexp_extract(line, '^(#{{1,6}})[{SPACE}]+', 1) <> '' THEN least(length(regexp_extract(line, '^(#{{1,6}})[{SPACE}]+', 1)), 3) END"""
COMMENT = rf"(starts_with(line, '<!--') AND ends_with(regexp_replace(line, '[{SPACE}]+$', ''), '-->'))"


@query(f"WITH {BASE_LINES}, every AS (SELECT doc_id AS doc, line_no, line FROM lines UNION ALL SELECT -1, id, x FROM {values(HEADINGS, 'id, x')}) SELECT doc, line_no::INT AS line_no, ({HEAD})::INT AS level, regexp_replace(line, '^#{{1,6}}[{SPACE}]+', '') AS text FROM every WHERE NOT {COMMENT}")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, SK7, Q4: levels and texts of lines; comments are left out."""
    own = document_lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), "line_no", "line")
    rows = own.unionByName(spark.createDataFrame([(-1, i, x) for i, x in HEADINGS], "doc long, line_no int, line string"))
    line = F.col("line")
    return rows.where(~text.comment_line(line)).select("doc", "line_no", text.heading_level(line).cast("int").alias("level"), text.without_heading(line).alias("text"))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, piece_no, line: texts as slides take them."""
    line = F.col("line")
    rows = document_lines(spark, sf_dir).where(~text.comment_line(line)).withColumn("line", text.without_heading(line))
    return text.wrap(rows).select("doc_id", "line_no", F.posexplode("pieces").alias("piece_no", "text"))


WRAPPED = rf"""{BASE_LINES}, plain AS (SELECT doc_id, line_no, regexp_replace(line, '^#{{1,6}}[{SPACE}]+', '') AS line FROM lines WHERE NOT {COMMENT}),
cut AS (SELECT doc_id, line_no, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '(?s).{{1,80}}') END AS p FROM plain),
wrapped AS (SELECT doc_id, line_no, unnest(range(len(p)))::INT AS piece_no, unnest(p) AS text FROM cut)"""


@query(f"WITH {WRAPPED} SELECT * FROM wrapped")
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines folded at 80 columns."""
    return wrapped(spark, sf_dir)


@query(f"""WITH {WRAPPED}, placed AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, piece_no) - 1 AS place FROM wrapped)
SELECT doc_id, (place // 13 + 1)::BIGINT AS slide, 'doc-' || doc_id || ' · ' || (place // 13 + 1) AS title, count(*)::BIGINT AS lines, string_agg(text, chr(10) ORDER BY place) AS text FROM placed GROUP BY doc_id, place // 13""")
def slides_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK8, W9, T9, Q10: texts as slides of thirteen lines."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "piece_no")) - 1
    rows = wrapped(spark, sf_dir).withColumn("place", place).withColumn("slide", (F.floor(F.col("place") / text.SLIDE_LINES) + 1).cast("long"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), "\n")
    got = rows.groupBy("doc_id", "slide").agg(F.count(F.lit(1)).alias("lines"), body.alias("text"))
    name = F.substring(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), 1, text.TITLE)
    return got.select("doc_id", "slide", F.concat(name, F.lit(" · "), F.col("slide").cast("string")).alias("title"), "lines", "text")


PAGES_SQL = f"""placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, regexp_replace(coalesce(CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE text END, ''), '{STRIP}', '', 'g') AS body FROM conversations)"""


@query(f"""WITH {PAGES_SQL} SELECT conv_id, CASE WHEN bool_or(body <> '') THEN string_agg('===== 第 ' || place || ' 页 =====' || chr(10) || body, chr(10) || chr(10) ORDER BY place) END AS text, CASE WHEN NOT bool_or(body <> '') THEN 'no text' END AS error FROM placed GROUP BY conv_id""")
def page_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20, A21, SK15, Q5, R19: pages' texts under their headings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("text"))
    return pages.document_text(c, doc="conv_id", page="turn")


@query(f"""
WITH n AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE left(b.text, 40) || chr(10) || d.text END AS native, b.text AS recognised FROM documents d, n JOIN benchmark b ON d.doc_id % n.n = b.item_id),
s AS (SELECT doc_id, recognised, lower(regexp_replace(recognised, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS other, regexp_split_to_array(native, '{BREAK}') AS l FROM p),
f AS (SELECT doc_id, recognised, list_filter(l, lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) <> '' AND NOT contains(other, lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')))) AS l FROM s)
SELECT doc_id, len(l)::BIGINT AS kept, regexp_replace(array_to_string(list_concat([recognised], l), chr(10)), '{STRIP}', '', 'g') AS text FROM f
""")
def native_text_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text and the native lines that it doesn't hold."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    b = items.select(F.col("item_id").alias("k"), F.col("text").alias("recognised"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("k")).join(b, "k")
    native = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.left("recognised", F.lit(40)), F.lit("\n"), "text"))
    d = d.withColumn("native", native)
    return d.select("doc_id", F.size(pages.surviving_lines(F.col("native"), F.col("recognised"))).cast("long").alias("kept"), pages.merged_text(F.col("native"), F.col("recognised")).alias("text"))


RANGES = [(1, None, 3), (2, "", 2), (3, " ALL ", 2), (4, "每页", 2), (5, "   ", 4), (6, "1-3，5,7 - 9", 10), (7, "2,2,1-2", 3), (8, "1,", 5), (9, "0-2", 5), (10, "3-2", 5), (11, "4-6", 5), (12, "a", 5), (13, "1--2", 5), (14, "all", 0), (15, "5", 5)]


@query(rf"""
WITH r AS (SELECT id, expression, pages, expression IS NULL OR expression = '' OR lower(trim(expression)) IN ('all', '每页') AS every, list_transform(string_split(replace(expression, '，', ','), ','), lambda t: regexp_replace(t, '{STRIP}', '', 'g')) AS tokens FROM {values(RANGES, 'id, expression, pages')}),
s AS (SELECT *, NOT every AND len(list_filter(tokens, lambda t: NOT regexp_matches(t, '^[0-9]{{1,18}}(?:\s*-\s*[0-9]{{1,18}})?$'))) > 0 AS bad FROM r),
t AS (SELECT *, CASE WHEN every OR bad THEN [] ELSE list_transform(tokens, lambda t: {{'a': regexp_extract(t, '^([0-9]+)', 1)::BIGINT, 'b': regexp_extract(t, '([0-9]+)$', 1)::BIGINT}}) END AS spans FROM s),
u AS (SELECT *, CASE WHEN bad THEN 'syntax' WHEN len(list_filter(spans, lambda x: NOT (1 <= x.a AND x.a <= x.b AND x.b <= pages))) > 0 THEN 'range' END AS error FROM t),
v AS (SELECT id, pages, error, CASE WHEN error IS NOT NULL THEN [NULL] WHEN every AND pages > 0 THEN list_transform(range(1, pages + 1), lambda p: {{'a': p, 'b': p}}) WHEN every THEN [NULL] ELSE spans END AS spans FROM u),
x AS (SELECT id, error, unnest(range(len(spans))) AS part, unnest(spans) AS s FROM v)
SELECT id, CASE WHEN s IS NULL THEN NULL ELSE part END::INT AS part, s.a AS first, s.b AS last, CASE WHEN s.a = s.b THEN '第' || s.a || '页' WHEN s IS NOT NULL THEN '第' || s.a || '-' || s.b || '页' END AS name, error FROM x
""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a split, or why there are none."""
    rows = spark.createDataFrame(RANGES, "id int, expression string, pages int")
    return parsers.page_groups(rows).select("id", "part", "first", "last", "name", "error")


TIMES = [(1, "12.5"), (2, " 90 "), (3, "1:20"), (4, "01:02:03.25"), (5, "1:60"), (6, "75:30"), (7, "1:2:3:4"), (8, ""), (9, None), (10, "-3"), (11, "8640000"), (12, "8640000.5"), (13, "1:5.5:3"), (14, "2400:00:01"), (15, "1.")]


@query(rf"""
WITH t AS (SELECT id, regexp_replace(x, '{STRIP}', '', 'g') AS v FROM {values(TIMES, 'id, x')}),
u AS (SELECT id, v, regexp_matches(v, '^[0-9]+(?:\.[0-9]+)?$') OR regexp_matches(v, '^[0-9]+:[0-9]{{1,2}}(?::[0-9]{{1,2}})?(?:\.[0-9]+)?$') AS ok FROM t),
w AS (SELECT id, coalesce(ok, false) AS ok, CASE WHEN ok THEN list_transform(string_split(v, ':'), lambda p: p::DOUBLE) ELSE [0.0::DOUBLE] END AS p FROM u),
z AS (SELECT id, ok, len(list_filter(p[2:], lambda q: q >= 60)) > 0 AS over, list_reduce(p, lambda a, b: a * 60 + b, 0.0::DOUBLE) AS s FROM w)
SELECT id, CASE WHEN ok AND NOT over AND s <= 8640000 THEN s END AS seconds, CASE WHEN NOT ok THEN 'syntax' WHEN over THEN 'minutes' WHEN s > 8640000 THEN 'range' END AS error FROM z
""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: seconds of a time, or what is wrong with it."""
    rows = spark.createDataFrame(TIMES, "id int, x string")
    return rows.select("id", parsers.seconds(F.col("x")).alias("seconds"), parsers.seconds_error(F.col("x")).alias("error"))


NAMES = ["ABCDEF+ArialMT", "Arial-BoldMT", "MicrosoftYaHei-Bold", "XYZABC+simsun", "TimesNewRomanPS-ItalicMT", "Calibri,Bold", "Georgia-BoldItalic", "Foo,regular", "abcdef+Foo", "ABCDEF+Bar-Light", "Some-italicx"]
FAMILY = " ".join(f"WHEN contains(lower(b), '{t.lower()}') THEN '{f}'" for t, f in parsers.FONTS)


@query(f"SELECT name, CASE {FAMILY} ELSE regexp_replace(b, '(?is)[-,](bold|italic|regular).*$', '') END AS family FROM (SELECT name, regexp_replace(name, '^[A-Z]{{6}}\\+', '') AS b FROM {values([(n,) for n in NAMES], 'name')})")
def font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """families of fonts."""
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", parsers.font_name(F.col("name")).alias("family"))


FEED = """CASE event_id % 7 WHEN 0 THEN '{"progress": "' || event_type || ' ' || event_id || '"}' WHEN 1 THEN 'not json' WHEN 2 THEN '{"other": 1}' WHEN 3 THEN '{"quit": true}' WHEN 4 THEN '{"show": true, "progress": "x"}' WHEN 5 THEN '{"done": true}' ELSE '{"progress": ' END"""


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = FEED.replace("||", ",")
    for part in ("'{\"progress\": \"' , event_type , ' ' , event_id , '\"}'",):
        sql = sql.replace(part, f"concat({part})")
    return table(spark, sf_dir, "events").select("event_id", F.expr(sql).alias("value"))


@query("SELECT event_id, event_type || ' ' || event_id AS progress FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'x' FROM events WHERE event_id % 7 = 4")
def progress_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1, D18, F25: messages of a feed with malformed lines, by the expression that the stream runs."""
    return progress.parsed(feed_lines(spark, sf_dir))


@query("SELECT CASE event_id % 7 WHEN 0 THEN 'progress' WHEN 3 THEN 'quit' WHEN 4 THEN 'show' WHEN 5 THEN 'done' ELSE 'ignore' END AS route, count(*)::BIGINT AS n FROM events GROUP BY 1")
def message_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-2: what a control message asks for."""
    return progress.routed(feed_lines(spark, sf_dir)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


JOBS = ['{"kind": "ocr_text", "files": ["a", "b"]}', '{"kind": "ocr_layout", "files": ["a"], "output_dir": "/x"}', '{"kind": "other", "files": []}', "nonsense", '{"files": ["a"]}']


@query("""SELECT * FROM (VALUES ('ocr_text', 'a,b', NULL, NULL, '{"items":["a","b"]}'), ('ocr_layout', 'a', '/x', NULL, '{"items":["a"]}'), ('other', '', NULL, 'unknown kind', '{"error":"unknown kind"}'), (NULL, NULL, NULL, 'malformed', '{"error":"malformed"}'), (NULL, 'a', NULL, 'malformed', '{"error":"malformed"}')) v(kind, files, output_dir, error, json)""")
def worker_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15, SK18, D17, I2: requests as read, and what is answered."""
    got = files_source.jobs(spark.createDataFrame([(j,) for j in JOBS], "value string"))
    answer = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct(F.col("files").alias("items"))))
    return got.select("kind", F.array_join("files", ",").alias("files"), "output_dir", "error", answer.alias("json"))


@query(f"WITH {LINES} SELECT doc, count(*)::BIGINT AS lines, sum(length(text))::BIGINT AS chars FROM lines GROUP BY doc")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters of texts."""
    return lines(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("SELECT * FROM (VALUES ('documents.parquet', 'there'), ('.', 'directory'), ('missing.bin', 'missing')) v(name, status)")
def resolved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1: inputs that are there, and those that can't be taken; a table may be a file or a folder of files."""
    got = files_source.resolved(spark, [f"{sf_dir}/{n}" for n in ("documents.parquet", ".", "missing.bin")])
    name = F.when(F.col("path").endswith("/."), ".").otherwise(F.element_at(F.split("path", "/"), -1))
    return got.select(name.alias("name"), F.when(F.col("path").endswith(".parquet") & (F.col("status") != "missing"), "there").otherwise(F.col("status")).alias("status"))


@query("SELECT * FROM (VALUES ('render'), ('media'), ('pdf'), ('picture'), ('recognise')) v(capability)")
def offered_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14: what may be offered, whether or not a program or library for it is here."""
    from ..sources import external

    return external.capabilities(spark).select("capability")
