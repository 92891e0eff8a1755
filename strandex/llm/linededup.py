"""Line dedup by overlapping three-line windows, in DataFrame functions only.

A line ends after a newline, and, as prose comes in very long physical lines, after a mark that ends a
sentence or a clause and a space. Lines compare without outer white space. Every run of three lines is
a window. The first occurrence of a window, by document id and position, stays; the lines that any later
occurrence covers are merged to runs. A run is removed if it holds three physical lines or LEAST
characters: clauses are short, and three of them may agree by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandex.llm.runtime import Tables, settled

#: Cut points: zero-width, so that the lines of a text joined give the text; and what a cut follows.
LINE_END = r"(?<=\n)|(?<=[.!?,;:] )"
_END = r"[\n.!?,;:](?:(?<=\n)| )"
WINDOW = 3
#: Characters of a run of repeated lines to be removed, unless it holds so many newlines.
LEAST, NEWLINES = 80, 2
_MARK = "\x01"


def _lines(text):
    """The text cut at LINE_END. Setting marks and cutting there is much faster than cutting by a pattern of
    zero width, which is left for texts that hold the mark themselves."""
    marked = F.regexp_replace(text, _END, "$0" + _MARK)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, LINE_END)).otherwise(F.split(marked, _MARK))


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, w, v): two hashes (96 bits) of each window of three line hashes. Each step is a projection
    of its own, so that a text is cut and hashed once, however often the next step refers to its lines."""
    line = lambda x: F.xxhash64(F.btrim(x, F.lit(" \n\r\t\f\x0b")))
    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(_lines(F.col(text_col)), line).alias("h"))
    long = hashed.select("id", "h", F.greatest(F.size("h") - WINDOW + 1, F.lit(0)).alias("n"))  # a filter on the size would cut and hash the text again
    parts = long.select("id", *[F.slice("h", F.lit(k), F.col("n")).alias(f"h{k}") for k in (1, 2, 3)])
    three = [f"z.h{k}" for k in (1, 2, 3)]
    return parts.select("id", F.posexplode(F.arrays_zip("h1", "h2", "h3")).alias("pos", "z")).select("id", "pos", F.xxhash64(*three).alias("w"), F.hash(*three).alias("v"))


def _kept(lines, starts):
    """Positions of the lines that stay: all but those of long runs of covered lines."""
    taken = F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))
    first = F.array_except(taken, F.transform(taken, lambda p: p + 1))
    last = F.array_except(taken, F.transform(taken, lambda p: p - 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.array_join(F.slice(lines, a + 1, b - a + 1), "").alias("text")))
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    gone = F.filter(runs, lambda r: (F.length(r["text"]) >= LEAST) | (newlines(r["text"]) >= NEWLINES))
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(F.transform(gone, lambda r: F.sequence(r["a"], r["b"]))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text column cleaned, plus ``n_lines`` and ``n_removed`` (both long).

    Null text: stays null, no lines. Empty text: one empty line, kept. Texts of fewer than three
    lines: kept whole. Null id: kept whole; such rows take no part. Rows with the same id and
    position count as one place, so that repeated rows are treated alike. Columns of ``docs``
    named n_lines or n_removed are replaced; others may have any name.
    """
    work = Tables(docs.sparkSession, "linededup")
    places = work.write("places", _places(docs, id_col, text_col))
    repeated = work.write("repeated", places.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("kept")).where("n > 1").select("w", "v", "kept"))
    later = places.join(repeated, ["w", "v"]).where((F.col("id") > F.col("kept.id")) | ((F.col("id") == F.col("kept.id")) & (F.col("pos") > F.col("kept.pos"))))
    covered = work.write("covered", later.groupBy(F.col("id").alias("at")).agg(F.collect_set("pos").alias("starts")))
    work.drop("places", "repeated")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    text = F.col("row").getField(text_col)  # moves once, as a part of its row
    cut = rows.join(covered, F.col("id") == F.col("at"), "left").select("row", "starts", F.when(text.isNotNull(), _lines(text)).alias("lines"))
    kept = cut.select("row", "lines", F.when(F.col("starts").isNotNull(), _kept(F.col("lines"), F.col("starts"))).alias("kept"))
    n_lines = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long")
    clean = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.transform(F.col("kept"), lambda i: F.get("lines", i)), ""))
    return settled(kept.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], n_lines.alias("n_lines"), n_removed.alias("n_removed")))


SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(regexp_replace(text, '(\n|[.!?,;:] )', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS raw FROM t),
k AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(10) || chr(13) || chr(9) || chr(12) || chr(11)) AS line FROM u),
w AS (SELECT doc_id, i, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c, lead(i, 2) OVER d AS i2 FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w WHERE i2 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, i + s AS i FROM r, (SELECT unnest([0, 1, 2]) AS s) WHERE n > 1),
o AS (SELECT doc_id, i, raw, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c JOIN k USING (doc_id, i)),
x AS (SELECT doc_id, i FROM o WINDOW q AS (PARTITION BY doc_id, run) QUALIFY sum(length(raw)) OVER q >= 80 OR sum(length(raw) - length(replace(raw, chr(10), ''))) OVER q >= 2),
g AS (SELECT k.doc_id, count(*) AS n_lines, count(x.i) AS n_removed, coalesce(string_agg(k.raw, '' ORDER BY k.i) FILTER (x.i IS NULL), '') AS text
      FROM k LEFT JOIN x ON k.doc_id = x.doc_id AND k.i = x.i GROUP BY k.doc_id)
SELECT d.doc_id, g.text, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
