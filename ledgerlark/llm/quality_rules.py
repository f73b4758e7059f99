"""Quality rules: counts inside a text, and lines that many documents of a host share. DataFrame operations only.

Cross-document line frequency: lines are normalised (white space collapsed, A-Z lower-cased, digits
as 0) and hashed; the distinct documents of a host that have a line are counted, exact copies as one.
A line that more than SHARE of the host's distinct documents and more than LEAST of them have is furniture
of the host and is removed: `keep` returns the texts without such lines, `judge` counts their words. A
document of which less than LEFT of the words remains is depleted and rejected.

At most 1 / SHARE times the mean number of distinct lines can be furniture of a host, so the lines
of a host fit in one short array. These arrays are a table of one row for each host with furniture;
Spark broadcasts it while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD, aside, text_of
from ledgerlark.operators.common import stored

#: the same for hosts of all sizes; copies of a text, whatever their number, are one document
SHARE, LEAST, LEFT = 0.05, 5, 0.3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    plain = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.xxhash64(F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines_with_words(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more.

    Windows are compared by 64-bit hashes within one text: sorted with their places, equal
    neighbours are repeats. Each repeat at place p adds the words p to p + 2 not yet added.
    """

    def covered(order: Column) -> Column:
        n = F.size(order)
        same = lambda a, b: order[a]["h"] == order[b]["h"]
        at = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: F.when(j > 0, same(j, j - 1)).otherwise(F.lit(False)) | F.when(j + 1 < n, same(j, j + 1)).otherwise(F.lit(False)),
        )
        places = F.array_sort(F.transform(at, lambda j: order[j]["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, add, lambda acc: acc["n"])

    def marked(w: Column) -> Column:
        window = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
        return _let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)), covered)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, marked))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column `_rules`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines.

    `lines` has the hash and the number of words of each line with a word.
    """
    plain = text_of(text)

    def of_words(w: Column) -> Column:
        lines = lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.transform(ls, lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n"))).alias("lines"),
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(plain, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            repeat_words(w).alias("n_repeat_words"),
            _let(lines_with_words(plain), lines).alias("by_line"),
        )

    return docs.withColumn("_rules", _let(words_of(plain), of_words))


def furniture(docs: DataFrame, text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """_host, _furniture: for each host with lines above the limits, their hashes.

    Distinct documents are told apart by a hash of their text, which also deals a frequent line over all
    tasks. Every document has one line more, the null one, so the same counts give the sizes of the hosts.
    """
    body = text_of(text)
    hashes = F.array_append(F.array_distinct(F.transform(lines_with_words(body), line_hash)), F.lit(None).cast("long"))
    lines = docs.select(F.col(host).alias("_host"), F.xxhash64(body).alias("_t"), F.explode(hashes).alias("h"))
    seen = lines.groupBy("_host", "h").agg(F.count_distinct("_t").alias("n")).filter(F.col("h").isNull() | (F.col("n") > least))
    seen = stored(seen, "lines")
    sizes = seen.filter("h is null").select(F.col("_host").alias("_of"), F.col("n").alias("docs"))
    common = seen.filter("h is not null").join(sizes, F.col("_host").eqNullSafe(F.col("_of"))).filter(F.col("n") > F.col("docs") * share)
    return stored(common.groupBy("_host").agg(F.collect_list("h").alias("_furniture")), "furniture")


def _is_furniture(known: Column, h: Column) -> Column:
    return F.array_contains(known, h)


def _judged(docs: DataFrame, text: str, host: str, share: float, least: int, left: float) -> DataFrame:
    """docs with the struct `_quality`: the counts, base_failed, removed_words, kept."""
    found = furniture(docs.select(text, host), text, host, share, least)
    rows = counts(docs, text)
    rows = rows.join(found, rows[host].eqNullSafe(found["_host"]), "left")
    c = F.col("_rules")
    known = F.coalesce(F.col("_furniture"), F.array().cast("array<bigint>"))
    removed = F.when(F.size(known) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(c["by_line"]["lines"], F.lit(0).cast("long"), lambda acc, x: acc + F.when(_is_furniture(known, x["h"]), x["n"]).otherwise(F.lit(0).cast("long")))
    )
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return rows.withColumn("_quality", F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["by_line"]["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), removed.alias("removed_words"),
        # one expression over both sides of the join, so that a filter on it does not count the words twice
        F.when(failed, F.lit(False)).otherwise(c["n_words"] - removed >= c["n_words"] * left).alias("kept"),
    ))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST, left: float = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept for every row of docs.

    Null text counts as empty: no words, so base_failed. Documents without host form one host.
    Repeated rows and copies are judged alike and are one document in the counts of lines. An empty
    table gives an empty result; other columns are ignored. Long texts are judged whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    return _judged(rows, "text", "host", share, least, left).select("doc_id", "_quality.*")


def keep(docs: DataFrame, text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST, left: float = LEFT, n_chars: str | None = None) -> DataFrame:
    """The rows of docs that `judge` keeps, their text without the furniture lines; all other columns stay.

    n_chars: a column that holds the length of the text, set anew where lines were removed. A text
    without furniture stays as it is.
    """
    inner, names, back = aside(docs)
    at, cut = names[text], F.col("_quality.removed_words") > 0
    rows = _judged(inner, at, names[host], share, least, left).filter("_quality.kept")
    lines = F.filter(F.split(text_of(at), "\n", -1), lambda line: ~_is_furniture(F.col("_furniture"), line_hash(line)))
    rows = rows.withColumn(at, F.when(cut, F.array_join(lines, "\n")).otherwise(F.col(at)))
    if n_chars:
        size = names[n_chars]
        rows = rows.withColumn(size, F.when(cut, F.length(at).cast(inner.schema[size].dataType)).otherwise(F.col(size)))
    return back(rows)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, source, dense_rank() OVER (ORDER BY t) AS k, string_split(t, chr(10)) AS l FROM d),
lw AS (
  SELECT r, source, k, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS h
  FROM (SELECT r, source, k, unnest(l) AS l FROM l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY r),
hosts AS (SELECT source, count(DISTINCT k) AS docs FROM l GROUP BY source),
seen AS (SELECT source, h, count(DISTINCT k) AS n FROM lw GROUP BY source, h),
common AS (SELECT s.source, s.h FROM seen s JOIN hosts b ON s.source IS NOT DISTINCT FROM b.source WHERE s.n > 5 AND s.n > b.docs * 0.05),
gone AS (SELECT lw.r, sum(lw.n) AS n FROM lw JOIN common c ON lw.source IS NOT DISTINCT FROM c.source AND lw.h = c.h GROUP BY lw.r),
c AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= n_words * 0.3 AS kept
FROM c
"""
