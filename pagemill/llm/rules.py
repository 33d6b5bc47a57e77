"""Quality rules on words and on lines that many documents of a host share; DataFrame functions only.

Lines are normalised (white space runs to one space, trimmed, lower case, digit runs to 0) and hashed
together with their host. Lines found in more than ``most_docs`` distinct documents of a host are
removed, and a document that keeps too little of its lines is rejected. Removal joins the lines of
documents to the lines over the limit: those that occur most often, at most ``HOT`` by their threshold,
are broadcast; each other one occurs rarely, so no key of the shuffled join is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import WORD, written

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Lines over the limit that are broadcast at most.
HOT = 50_000


def repeated_words(hashes: Column) -> Column:
    """Words in windows (given by their hashes, in order) that are found twice or more in the array."""

    def of_sorted(s: Column) -> Column:
        # A window repeats if its neighbour in hash order has its hash; get() is null beyond the ends.
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(F.array(pairs), of_sorted)[0]


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, SPACES, " ")), "[0-9]+", "0"))


def line_hash(host: Column, norm: Column) -> Column:
    """64 bits of host and line; a null host is a host of its own."""
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull(), norm)


def with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(WORD))


def measured(rows: DataFrame) -> DataFrame:
    """Adds the counts of the base rules, and lines: hash and length of each line with a word, to rows of host and t."""
    rows = rows.withColumn("words", F.array_remove(F.split("t", SPACES), "")).withColumn("own", with_words(F.split("t", "\n")))
    n = F.size("words")
    # Python's default arguments don't reach Spark's lambdas; the windows' words are got one by one.
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW))))
    rows = rows.withColumn("hashes", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    lines = F.transform(F.transform("own", normalised), lambda x: F.struct(line_hash(F.col("host"), x).alias("h"), F.length(x).alias("n")))
    return rows.select(
        "rid", "k", "host",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), 0).otherwise(repeated_words(F.col("hashes"))).cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
    )


def over_limit(rows: DataFrame, most_docs: int) -> DataFrame:
    """h, times: the lines found in more than most_docs distinct documents of a host, and how often they occur."""
    each = rows.select("k", F.explode("lines.h").alias("h")).groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("times")).where(F.col("docs") > most_docs).drop("docs")


def removed_lines(rows: DataFrame, most_docs: int) -> DataFrame:
    """rid, h, n of each line, as often as it occurs, that is over the limit."""
    bad = written(over_limit(rows, most_docs), "lines")
    pairs = rows.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    line = F.lit(max(most_docs, pairs // HOT))
    hot = F.broadcast(bad.where(F.col("times") > line).select("h"))
    each = rows.select("rid", F.inline("lines"))
    rest = each.join(hot, "h", "left_anti").join(bad.where(F.col("times") <= line).select("h"), "h", "left_semi")
    return each.join(hot, "h", "left_semi").unionByName(rest)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most_docs: int = 20, least_kept: float = 0.5) -> DataFrame:
    """key, the counts of the base rules, base_failed, removed_chars, line_chars, kept for each row.

    base_failed: under 20 words, or over 30 of 100 words in repeated 8-word windows. kept: not
    base_failed, and lines within the limit hold ``least_kept`` of the characters of all its
    normalised lines with a word. Null texts are empty, so they fail. A null host is a host. Rows that
    repeat a key count as one document for the limit and are judged one by one; a null key is a key.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("k"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = written(measured(rows), "measured")
    gone = removed_lines(rows, most_docs).groupBy("rid").agg(F.sum("n").alias("removed"))
    all_chars = F.aggregate("lines.n", F.lit(0).cast("long"), lambda a, n: a + n)
    out = rows.withColumn("line_chars", all_chars).drop("lines", "host").join(gone, "rid", "left")
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = F.col("line_chars") - removed >= F.lit(least_kept) * F.col("line_chars")
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), removed.alias("removed_chars"), "line_chars", "rid")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most_docs: int = 20) -> DataFrame:
    """docs with the lines over the limit removed from the texts; blank lines and null texts stay."""
    rid, bad = "_pm_rid", "_pm_bad"
    kept = written(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    rows = written(measured(kept.select(F.col(rid).alias("rid"), F.col(key).alias("k"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))), "measured")
    gone = removed_lines(rows, most_docs).groupBy("rid").agg(F.collect_set("h").alias(bad)).withColumnRenamed("rid", rid)
    both = kept.join(gone, rid, "left")
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col(bad), line_hash(F.col(host).cast("string"), normalised(x)))))
    return both.withColumn(text, F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).select(docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own
  FROM d),
windows AS (SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, sum(least(8, coalesce(i - before, 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
lines AS (SELECT rid, doc_id, source, lower(regexp_replace(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')) AS x FROM (SELECT rid, doc_id, source, unnest(own) AS x FROM w)),
bad AS (SELECT source, x FROM lines GROUP BY source, x HAVING count(DISTINCT doc_id) > 20),
chars AS (SELECT l.rid, sum(length(l.x)) AS every, coalesce(sum(length(l.x)) FILTER (WHERE b.x IS NOT NULL), 0) AS gone
          FROM lines l LEFT JOIN bad b ON l.x = b.x AND l.source IS NOT DISTINCT FROM b.source GROUP BY l.rid),
s AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(own) - len(list_distinct(own)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(every, 0) AS every, coalesce(gone, 0)::BIGINT AS removed_chars
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN chars USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND every - removed_chars >= 0.5 * every AS kept, removed_chars
FROM s
"""
