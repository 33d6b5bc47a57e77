"""Relations derived from the tables by the same rule in both engines: pages, boxes, spans, pixels.

Each fixture is a function of (spark, sf_dir) and DuckDB SQL of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.artwork import handed
from ..sources.tables import table

# Extensions dealt to documents by their number.
EXTENSIONS = ["pdf", "PNG", "jpeg", "docx", "txt", "html", "mp4", "tiff", "csv", "mp3", "pptx", "bin"]


def values(rows: list[tuple], names: str) -> str:
    """A VALUES relation in SQL, of text, whole numbers, decimals, truth values and nulls."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, str):
            body = x.replace("'", "''")
            if any(ord(c) < 32 for c in body):
                return "(" + " || ".join(f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in x) + ")"
            return f"'{body}'"
        return f"{x!r}::DOUBLE" if isinstance(x, float) else f"{x}"

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


def listed(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, n, text: documents' lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "text"))


LINES = "lines AS (SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10)))))::INT AS n, unnest(string_split(text, chr(10))) AS text FROM documents)"


def pieces(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """doc, n, text: documents' lines, long ones wrapped into pieces of ``width`` characters, numbered through."""
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / width).cast("int"))), lambda i: F.substr(t, i * width + 1, F.lit(width)))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.flatten(F.transform(F.split("text", "\n"), cut))).alias("n", "text"))


def pieces_sql(width: int) -> str:
    cut = f"list_transform(range(greatest(1, (length(t) + {width - 1}) // {width})), lambda i: substring(t, (i * {width} + 1)::INT, {width}))"
    return f"pieces AS (SELECT doc, unnest(range(len(p)))::INT AS n, unnest(p) AS text FROM (SELECT doc_id AS doc, flatten(list_transform(string_split(text, chr(10)), lambda t: {cut})) AS p FROM documents))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, n, x0 to y1, height, text, confidence, family, fit, flags, size: two columns of wrapped lines, each fifth one nearly on the one before."""
    near = F.when(F.col("n") % 5 == 4, F.col("n") - 1).otherwise(F.col("n"))
    m = near.cast("double")
    x0 = 40 + 460 * (near % 2) + F.when(F.col("n") % 5 == 4, 3).otherwise(0)
    y0 = 20 + F.floor(m / 2) * 19
    rows = pieces(spark, sf_dir).where("length(trim(text)) > 0")
    wide, high = 30 + 6 * F.length("text"), 12 + F.col("n") % 4
    code = (F.col("doc") * 31 + F.col("n") * 17) % 50
    rows = rows.select("doc", "n", "text", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), wide.alias("w"), high.alias("h"), code.alias("code"))
    family = F.element_at(F.array(*map(F.lit, ("Arial", "Calibri", "SimSun"))), (F.col("code") % 3 + 1).cast("int"))
    return rows.select(F.col("doc").alias("page"), "n", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.col("h").cast("double").alias("height"), "text", (0.5 + F.col("code") / 100).alias("confidence"), family.alias("family"), (F.col("code") / 64).alias("fit"), F.when(F.col("code") % 4 == 0, 16).otherwise(0).alias("flags"), (10 + F.col("code") % 5).cast("double").alias("size"))


BOXES = (
    pieces_sql(60)
    + """, boxes0 AS (
  SELECT doc, n, text, CASE WHEN n % 5 = 4 THEN n - 1 ELSE n END AS m, (doc * 31 + n * 17) % 50 AS code FROM pieces WHERE length(trim(text, ' ')) > 0),
boxes1 AS (SELECT *, (40 + 460 * (m % 2) + CASE WHEN n % 5 = 4 THEN 3 ELSE 0 END)::DOUBLE AS x0, (20 + (m // 2) * 19)::DOUBLE AS y0, 30 + 6 * length(text) AS w, 12 + n % 4 AS h FROM boxes0),
boxes AS (SELECT doc AS page, n, x0, y0, x0 + w AS x1, y0 + h AS y1, h::DOUBLE AS height, text, 0.5::DOUBLE + code / 100::DOUBLE AS confidence, ['Arial', 'Calibri', 'SimSun'][code % 3 + 1] AS family, code / 64::DOUBLE AS fit, CASE WHEN code % 4 = 0 THEN 16 ELSE 0 END AS flags, (10 + code % 5)::DOUBLE AS size FROM boxes1)"""
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, n, block, line, x0 to y1, size, text: the words of each line as spans, some close together."""
    words = lines(spark, sf_dir).select("doc", "n", F.posexplode(F.split("text", " ")).alias("k", "word")).where("word <> ''")
    x0 = F.col("k") * 50 + F.when(F.col("k") % 3 == 0, 0).otherwise(1)
    y0 = F.col("n") * 14
    wide = F.when(F.col("k") % 3 == 1, 49).otherwise(40)
    return words.select(F.col("doc").alias("page"), (F.col("n").cast("long") * 1_000_000 + F.col("k")).alias("n"), F.floor(F.col("n") / 4).cast("int").alias("block"), F.when(F.col("k") % 7 == 6, None).otherwise(F.col("n")).alias("line"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + wide).cast("double").alias("x1"), (y0 + 12).cast("double").alias("y1"), (10 + F.col("k") % 2).cast("double").alias("size"), F.col("word").alias("text"))


SPANS = (
    LINES
    + """, words AS (SELECT doc, n, unnest(range(len(string_split(text, ' '))))::INT AS k, unnest(string_split(text, ' ')) AS word FROM lines),
spans AS (SELECT doc AS page, n::BIGINT * 1000000 + k AS n, (n // 4)::INT AS block, CASE WHEN k % 7 = 6 THEN NULL ELSE n END AS line, (k * 50 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END)::DOUBLE AS x0, (n * 14)::DOUBLE AS y0, (k * 50 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 3 = 1 THEN 49 ELSE 40 END)::DOUBLE AS x1, (n * 14 + 12)::DOUBLE AS y1, (10 + k % 2)::DOUBLE AS size, word AS text FROM words WHERE word <> '')"""
)


def paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped lines of one column with the columns that paragraphs are told by; gaps, colours and weights change by number."""
    rows = pieces(spark, sf_dir, 70).where("length(text) > 0")
    y0 = F.col("n") * 16 + F.floor(F.col("n") / 6) * 20
    high = 11 + F.col("n") % 2
    return rows.select(
        F.col("doc").alias("page"), "n", (40 + F.col("n") % 3).cast("double").alias("x0"), y0.cast("double").alias("y0"), (40 + 5 * F.length("text")).cast("double").alias("x1"), (y0 + high).cast("double").alias("y1"),
        F.lit(12.0).alias("size"), F.when(F.col("n") % 23 == 22, 5.0).otherwise(0.0).alias("angle"), "text", F.when(F.floor(F.col("n") / 9) % 2 == 0, 0x333333).otherwise(0x993333).alias("color"),
        F.when(F.col("doc") % 2 == 0, F.when(F.floor(F.col("n") / 5) % 2 == 0, 0xFFFFFF).otherwise(0x663333)).alias("panel"), F.when(F.col("n") % 8 == 0, 16).otherwise(0).alias("flags"),
        F.when(F.col("doc") % 3 == 0, F.floor(F.col("n") / 4).cast("int")).alias("block"), F.when(F.col("doc") % 3 == 1, 1.0).alias("width_ratio"),
    )


PARAGRAPH_LINES = (
    pieces_sql(70)
    + """, cut AS (SELECT doc, n, text FROM pieces WHERE length(text) > 0),
plines AS (
  SELECT doc AS page, n, (40 + n % 3)::DOUBLE AS x0, (n * 16 + (n // 6) * 20)::DOUBLE AS y0, (40 + 5 * length(text))::DOUBLE AS x1, (n * 16 + (n // 6) * 20 + 11 + n % 2)::DOUBLE AS y1,
         12.0::DOUBLE AS size, CASE WHEN n % 23 = 22 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS angle, text, CASE WHEN (n // 9) % 2 = 0 THEN 3355443 ELSE 10040115 END AS color,
         CASE WHEN doc % 2 = 0 THEN CASE WHEN (n // 5) % 2 = 0 THEN 16777215 ELSE 6697779 END END AS panel, CASE WHEN n % 8 = 0 THEN 16 ELSE 0 END AS flags,
         CASE WHEN doc % 3 = 0 THEN (n // 4)::INT END AS block, CASE WHEN doc % 3 = 1 THEN 1.0::DOUBLE END AS width_ratio
  FROM cut)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec, pos, value: components of embeddings as 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec", "pos", F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("x").cast("double") + 1) * 128))).cast("int").alias("value"))


SAMPLES = "samples AS (SELECT vec_id AS vec, unnest(range(len(embedding)))::INT AS pos, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 1) * 128)))::INT AS value FROM embeddings)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, colour: three neighbouring samples of a vector as a colour, in groups of fifty vectors."""
    s = samples(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 40) * 40)
    third = s.groupBy("vec", F.floor(F.col("pos") / 3).alias("k")).agg(*(F.max(F.when(F.col("pos") % 3 == i, F.col("value"))).alias(c) for i, c in enumerate("rgb"))).where("b is not null")
    return third.select(F.floor(F.col("vec") / 50).alias("grp"), (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int").alias("colour"))


COLOURS = (
    SAMPLES
    + """, thirds AS (SELECT vec, pos // 3 AS k, max(CASE WHEN pos % 3 = 0 THEN value // 40 * 40 END) AS r, max(CASE WHEN pos % 3 = 1 THEN value // 40 * 40 END) AS g, max(CASE WHEN pos % 3 = 2 THEN value // 40 * 40 END) AS b FROM samples GROUP BY vec, pos // 3),
colours AS (SELECT (vec // 50)::BIGINT AS grp, (r * 65536 + g * 256 + b)::INT AS colour FROM thirds WHERE b IS NOT NULL)"""
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, ord, path, ext, size: documents as files of an extension by their number, in batches of four."""
    d = table(spark, sf_dir, "documents")
    batch = F.floor(F.col("doc_id") / 4)
    number = F.when(batch % 3 == 0, F.col("doc_id")).otherwise(batch)
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (number % len(EXTENSIONS) + 1).cast("int"))
    return d.select(F.floor(F.col("doc_id") / 4).alias("batch"), (F.col("doc_id") % 4).cast("int").alias("ord"), F.concat(F.lit("/data/"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), ext.alias("ext"), F.col("n_chars").alias("size"))


FILES = f"files AS (SELECT doc_id // 4 AS batch, (doc_id % 4)::INT AS ord, {listed(EXTENSIONS)}[CASE WHEN (doc_id // 4) % 3 = 0 THEN doc_id ELSE doc_id // 4 END % {len(EXTENSIONS)} + 1] AS ext, source, n_chars AS size, doc_id FROM documents)"


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, picture, lines, palette, objects: a small page for each document: letters on a panel, a photograph, a disc.

    Pages of odd numbers have a second panel on their right half; every third disc has a sign in it.
    """

    def draw(batches):
        import numpy as np

        panels = [(250, 250, 240), (200, 220, 250)]
        empty = np.full((2, 120, 160, 4), 255, np.uint8)
        empty[:, :, :, :3] = panels[0]
        empty[1, :, 80:, :3] = panels[1]
        y, x = np.ogrid[:40, :40]
        disc = np.hypot((x - 19.5) / 20, (y - 19.5) / 20) <= 1
        for b in batches:
            for page in b.column(0).to_pylist():
                a = empty[page % 2].copy()
                lines = [{"n": k, "text": "letters"[: 4 + page % 4], "x0": 10.0, "y0": 8.0 + 24 * k, "x1": 62.0, "y1": 24.0 + 24 * k} for k in range(2)]
                for line in lines:
                    for i in range(len(line["text"])):
                        a[int(line["y0"]) + 3 : int(line["y0"]) + 13, 13 + 7 * i : 16 + 7 * i, :3] = (20, 30, 40 + page % 8)
                a[30:70, 95:145, :3] = np.random.default_rng(page).integers(0, 256, (40, 50, 3))
                a[70:110, 20:60, :3][disc] = (30, 120, 60 + page % 16)
                if page % 3 == 0:
                    a[82:98, 36:44, :3] = 255
                objects = [{"n": 10, "kind": "photo", "x0": 95, "y0": 30, "x1": 145, "y1": 70}, {"n": 11, "kind": "ellipse", "x0": 20, "y0": 70, "x1": 60, "y1": 110}]
                yield page, {"h": 120, "w": 160, "data": a.tobytes()}, lines, [list(p) for p in panels], objects

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = "page long, picture struct<h:int,w:int,data:binary>, lines array<struct<n:int,text:string,x0:double,y0:double,x1:double,y1:double>>, palette array<array<int>>, objects array<struct<n:int,kind:string,x0:int,y0:int,x1:int,y1:int>>"
    into = to_arrow_schema(StructType.fromDDL(kind))
    return table(spark, sf_dir, "documents").select("doc_id").mapInArrow(lambda b: handed(draw(b), into), kind)
