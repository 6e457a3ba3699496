"""Operator 7: lines dropped by a log-template tree. DataFrame functions only.

Every line is parsed down a tree of fixed depth: by its count of tokens, then by its three leading tokens, to a leaf. A
token with a digit is a variable field, ``<*>``, from the start; in tokens of over ``LONG`` characters or of a script that
is written without spaces only the runs of digits are. A line with digits whose constant words, tokens that keep a letter,
are under two or under a third of its tokens is no template: rows of number tables, dates, a URL or an unspaced line recur by
their exact text only. In each leaf, fields without digits are found too: eight
token positions after the leading ones (all, in a line of up to 11 tokens; evenly spread ones in a longer line) are
compared over the leaf's distinct lines, weighted by documents, and a position is constant if one token holds at least half
the weight. If at least three fifths of the positions, and two at least, are constant, and two constants of these and the
leading tokens are no ``<*>``, the leaf has a template that takes all its lines that agree on the constants; the other
positions are variable fields.

A template (or a line as parsed, where its leaf has no template that takes it) recurs if it is in at least ``min_docs``
documents, or in ``min_docs_long`` if it has ``long_tokens`` tokens or more, for which chance is no explanation. Lines of a
recurring template are dropped, except in the document of the smallest doc_id that has it. Rows stay.

The tree's levels are hashes, so a line is about 70 bytes in the shuffles, whatever its length. Counts are aggregated
before each shuffle; a line that a third of all documents share is one row in every table but the last join, which Spark
splits where it is skewed. What goes from a text is listed by its doc_id and its hash, so rows that share a doc_id or have
none are not gathered.

Edge cases: rows of equal doc_id are one document, and so are all rows of null doc_id, which comes last; a null text stays
null and has no lines; lines without tokens are never dropped; a text whose lines all go becomes empty; an empty table
gives no rows; other columns are passed on as they are by ``drop_recurring``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, free_prefix

LEADING, PROBES, LONG = 3, 8, 48
#: Tokens that are masked whole, and tokens that keep a letter.
FIELD = (
    r"(?<![^ ])(?=[^ 0-9]*+[0-9])(?=[^ ]{1,%d}+(?![^ ]))(?![^ ]*[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])[^ ]++" % LONG
)
WORD = r"(?<![^ ])[^ \p{L}]*+\p{L}[^ ]*+"


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, own, raw, leaf, line, n, lead, probes) for each distinct line with tokens of each row; all but doc_id, n and
    lead, the leading tokens that are no variable field, are hashes; ``own`` is the whole text's."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("l"))
    clean = F.trim(F.regexp_replace("l", r"\s+", " "))
    one = one.select("doc_id", "own", F.xxhash64("l").alias("raw"), clean.alias("c")).where("c <> ''")
    digits = F.col("c").rlike("[0-9]")
    masked = F.when(digits, F.regexp_replace(F.regexp_replace("c", FIELD, "<*>"), "[0-9]+", "<*>")).otherwise(F.col("c"))
    one = one.select("doc_id", "own", "raw", "c", digits.alias("digits"), masked.alias("m")).withColumn("n", F.size(F.split("m", " ")))
    words = F.regexp_count("m", F.lit(WORD))
    exact = F.when(F.col("digits"), (words < 2) | (3 * words < F.col("n"))).otherwise(False)
    one = one.select("doc_id", "own", "raw", "n", exact.alias("exact"), "c", "m").withColumn("m", F.when(F.col("exact"), F.col("c")).otherwise(F.col("m")))
    one = one.select("doc_id", "own", "raw", "n", "exact", "m", F.split("m", " ").alias("t"))
    at = [F.when(F.col("n") <= LEADING + PROBES, F.lit(LEADING + k)).otherwise(LEADING + F.floor(k * (F.col("n") - LEADING) / PROBES)).cast("int") for k in range(PROBES)]
    leaf = F.xxhash64("n", *(F.get("t", F.lit(k)) for k in range(LEADING)))
    leaf = F.when(F.col("exact"), F.xxhash64("m", F.lit("exact"))).otherwise(leaf)  # a leaf of its own, so no template
    lead = sum(F.coalesce(F.get("t", F.lit(k)) != "<*>", F.lit(False)).cast("int") for k in range(LEADING))
    probes = F.array(*(F.hash(F.get("t", a)) for a in at))
    return one.select("doc_id", "own", "raw", leaf.alias("leaf"), F.xxhash64("m").alias("line"), "n", lead.alias("lead"), probes.alias("probes"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))


def _recurs(docs: str, min_docs: int, min_docs_long: int, long_tokens: int) -> Column:
    return F.col(docs) >= F.when(F.col("n") >= long_tokens, min_docs_long).otherwise(min_docs)


def recurring_lines(lines: DataFrame, scratch: Scratch, min_docs: int, min_docs_long: int, long_tokens: int) -> DataFrame:
    """(leaf, line, first): parsed lines whose template recurs, and the document that keeps it."""
    recurs = _recurs("docs", min_docs, min_docs_long, long_tokens)
    distinct = lines.groupBy("leaf", "line").agg(
        F.count_distinct(F.struct("doc_id")).alias("docs"), _first().alias("first"), F.min("n").alias("n"), F.min("lead").alias("lead"), F.min("probes").alias("probes")
    )
    distinct = scratch.save(distinct, "distinct")
    # Leaves with several lines in enough documents may have a template of their own.
    wide = distinct.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs"), F.min("n").alias("n"))
    wide = wide.where((F.col("lines") > 1) & (F.col("n") >= LEADING + 2) & recurs).select("leaf")
    some = distinct.join(wide, "leaf", "left_semi")
    weight = some.select("leaf", "n", "lead", "docs", F.posexplode("probes").alias("at", "token")).where(F.col("at") < F.col("n") - LEADING)
    weight = weight.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("w"), F.min("n").alias("n"), F.min("lead").alias("lead"))
    top = weight.groupBy("leaf", "at").agg(F.max(F.struct("w", "token")).alias("top"), F.sum("w").alias("all"), F.min("n").alias("n"), F.min("lead").alias("lead"))
    own = F.count_if(F.col("top.token") != F.hash(F.lit("<*>"))) + F.min("lead")
    const = top.where("2 * top.w >= all").groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "top.token"))).alias("const"), F.min("n").alias("n"), own.alias("own"))
    slots = F.least(F.lit(PROBES), F.col("n") - LEADING)
    const = const.where((5 * F.size("const") >= 3 * slots) & (F.size("const") >= 2) & (F.col("own") >= 2)).select("leaf", "const")
    agrees = F.forall(F.map_entries("const"), lambda e: F.get("probes", e["key"]) == e["value"])
    taken = scratch.save(some.join(const, "leaf").where(agrees).select("leaf", "line"), "taken")
    template = lines.join(taken, ["leaf", "line"], "left_semi").groupBy("leaf")
    template = template.agg(F.count_distinct(F.struct("doc_id")).alias("docs"), _first().alias("first"), F.min("n").alias("n")).where(recurs)
    by_template = taken.join(template.select("leaf", "first"), "leaf").select("leaf", "line", "first")
    by_line = distinct.where(recurs).select("leaf", "line", "first").join(by_template, ["leaf", "line"], "left_anti")
    return by_line.unionByName(by_template)


def drop_recurring(docs: DataFrame, min_docs: int = 3, min_docs_long: int = 2, long_tokens: int = 20, count: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates in ``text``, and ``n_chars``, where there is one, counted anew in the
    rows that changed. With ``count``, the columns ``n_lines`` and ``n_dropped`` are added."""
    scratch = Scratch(docs.sparkSession, "lines")
    names, p = docs.columns, free_prefix(docs.columns, "gone")
    lines = scratch.save(parsed_lines(docs), "lines")
    found = recurring_lines(lines, scratch, min_docs, min_docs_long, long_tokens)
    gone = lines.join(found, ["leaf", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first.id")))
    gone = gone.groupBy("doc_id", "own").agg(F.collect_set("raw").alias(p + "raw"))
    gone = gone.select(F.col("doc_id").alias(p + "id"), F.col("own").alias(p + "own"), p + "raw")
    # The lists are small beside the texts: they are hashed, and the texts need no sort.
    at = docs["doc_id"].cast("long").eqNullSafe(F.col(p + "id")) & (F.xxhash64(docs["text"]) == F.col(p + "own"))
    joined = docs.join(gone.hint("shuffle_hash"), at, "left")
    parts, none = F.split(docs["text"], "\n"), F.col(p + "raw").isNull()
    left = F.filter(parts, lambda l: ~F.array_contains(F.col(p + "raw"), F.xxhash64(l)))  # noqa: E741
    text = F.when(none, docs["text"]).otherwise(F.array_join(left, "\n"))
    out = []
    for name in names:
        column = docs[name]
        if name == "text":
            column = text.alias(name)
        elif name == "n_chars":
            column = F.when(none, column).otherwise(F.length(text)).cast(docs.schema[name].dataType).alias(name)
        out.append(column)
    if count:
        total = F.coalesce(F.size(parts).cast("long"), F.lit(0))
        out += [total.alias("n_lines"), F.when(none, 0).otherwise(total - F.size(left)).cast("long").alias("n_dropped")]
    return joined.select(*out)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs, count=True)


#: The same over strings instead of hashes; a null doc_id is the largest number there.
OP7_SQL = r"""
WITH raw AS (
  SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS doc_id, UNNEST(string_split(text, chr(10))) AS l FROM documents
), clean AS (
  SELECT doc_id, l, trim(regexp_replace(l, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c FROM raw
), tok AS (
  SELECT doc_id, l, c, list_transform(string_split(c, ' '), lambda x: CASE WHEN NOT regexp_matches(x, '[0-9]') THEN x
    WHEN length(x) <= 48 AND NOT regexp_matches(x, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]') THEN '<*>'
    ELSE regexp_replace(x, '[0-9]+', '<*>', 'g') END) AS m
  FROM clean WHERE c <> ''
), masked AS (
  SELECT *, len(list_filter(m, lambda x: regexp_matches(x, '\p{L}'))) AS words FROM tok
), apart AS (
  SELECT *, regexp_matches(c, '[0-9]') AND (words < 2 OR 3 * words < len(m)) AS exact FROM masked
), fields AS (
  SELECT doc_id, l, exact, CASE WHEN exact THEN string_split(c, ' ') ELSE m END AS t FROM apart
), lines AS (
  SELECT doc_id, l, array_to_string(t, ' ') AS line, len(t) AS n,
    CASE WHEN exact THEN 'exact|' || array_to_string(t, ' ') ELSE len(t) || '|' || array_to_string(t[1:3], ' ') END AS leaf,
    len(list_filter(t[1:3], lambda x: x <> '<*>')) AS lead,
    list_transform(range(0, 8), lambda k: coalesce(t[(CASE WHEN len(t) <= 11 THEN 4 + k ELSE 4 + (k * (len(t) - 3)) // 8 END)], '')) AS probes
  FROM fields
), dist AS (
  SELECT leaf, line, count(DISTINCT doc_id) AS docs, min(doc_id) AS first, min(n) AS n, min(lead) AS lead, min(probes) AS probes FROM lines GROUP BY leaf, line
), wide AS (
  SELECT leaf FROM dist GROUP BY leaf HAVING count(*) > 1 AND min(n) >= 5 AND sum(docs) >= CASE WHEN min(n) >= 20 THEN 2 ELSE 3 END
), several AS (
  SELECT * FROM dist WHERE leaf IN (SELECT leaf FROM wide)
), pos AS (
  SELECT leaf, n, lead, docs, k AS slot, probes[k + 1] AS token FROM several, (SELECT UNNEST(range(0, 8)) AS k) WHERE k < n - 3
), weight AS (
  SELECT leaf, slot, token, sum(docs) AS w, min(n) AS n, min(lead) AS lead FROM pos GROUP BY leaf, slot, token
), best AS (
  SELECT leaf, slot, token, n, lead, w, sum(w) OVER (PARTITION BY leaf, slot) AS total, row_number() OVER (PARTITION BY leaf, slot ORDER BY w DESC, token DESC) AS r FROM weight
), const AS (
  SELECT leaf, slot, token, n, lead FROM best WHERE r = 1 AND 2 * w >= total
), good AS (
  SELECT leaf, count(*) AS size FROM const GROUP BY leaf HAVING 5 * count(*) >= 3 * least(8, min(n) - 3) AND count(*) >= 2 AND count(*) FILTER (token <> '<*>') + min(lead) >= 2
), taken AS (
  SELECT s.leaf, s.line FROM several s JOIN good g ON s.leaf = g.leaf JOIN const c ON c.leaf = s.leaf AND s.probes[c.slot + 1] = c.token
  GROUP BY s.leaf, s.line, g.size HAVING count(*) = g.size
), template AS (
  SELECT leaf, min(doc_id) AS first FROM lines WHERE (leaf, line) IN (SELECT (leaf, line) FROM taken)
  GROUP BY leaf HAVING count(DISTINCT doc_id) >= CASE WHEN min(n) >= 20 THEN 2 ELSE 3 END
), recurring AS (
  SELECT t.leaf, t.line, p.first FROM taken t JOIN template p ON t.leaf = p.leaf
  UNION ALL
  SELECT leaf, line, first FROM dist WHERE docs >= CASE WHEN n >= 20 THEN 2 ELSE 3 END
    AND (leaf, line) NOT IN (SELECT (t.leaf, t.line) FROM taken t JOIN template p ON t.leaf = p.leaf)
), gone AS (
  SELECT doc_id, list(l) AS gone FROM lines x JOIN recurring r ON x.leaf = r.leaf AND x.line = r.line WHERE x.doc_id <> r.first GROUP BY doc_id
), parts AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS p, coalesce(g.gone, []) AS gone
  FROM documents d LEFT JOIN gone g ON coalesce(d.doc_id, 9223372036854775807) = g.doc_id
)
SELECT doc_id, array_to_string(list_filter(p, lambda x: NOT list_contains(gone, x)), chr(10)) AS text, len(p)::BIGINT AS n_lines,
  (len(p) - len(list_filter(p, lambda x: NOT list_contains(gone, x))))::BIGINT AS n_dropped
FROM parts
"""
