"""Fill-in-middle transformation from relational units.

Each text is cut into units by a pattern (lines, unless told otherwise) and exploded to
rows (key, ordinal, length). A window sums the lengths, so that a row knows where its unit
ends. Each document asks for two cuts by unit ordinal; these requests join the units, the
offsets found are aggregated to one row for each document, and only then the text is met
again and cut by substring.

Scale: the units are slim (a 128-bit key, an ordinal, a length), repeated rows are combined
on the map side, and a window holds one document's units. Whole texts are shuffled once, to
meet their offsets; a hot key there is on the side that AQE can split. All of it is DataFrame
functions, so nothing but Spark's own shuffle files has to outlive an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines as units, the sentinels, the seed before the id, and shares of 100.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"
RATE, SPM = 100, 50
PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of the hex sha256 of seed and decimal id (a null id counts as empty)."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text from an output and its form.

    A transformed text holds no sentinel of its own, and none can arise where a piece meets a sentinel, as none ends as one begins.
    """
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == PSM, F.concat(piece(1), piece(3), piece(2)))
        .when(form == SPM_FORM, F.concat(piece(2), piece(3), piece(1)))
        .otherwise(output)
    )


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    pairs = [(s, t) for s in sentinels for t in sentinels]
    touching = any(s.endswith(t[:i]) for s, t in pairs for i in range(1, len(t)))
    if len(set(sentinels)) < 3 or not all(sentinels) or touching or any(s in t for s, t in pairs if s != t):
        raise ValueError("sentinels must be three texts of which none holds another or ends as one begins")
    return sentinels


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2): 128 bits name an id and its text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def unit_ends(keyed: DataFrame, unit: str = UNIT) -> DataFrame:
    """(k1, k2, ordinal, ends, n): for unit 1, 2, ... of a text the characters up to its end, and the number of units."""
    matches = F.regexp_extract_all("text", F.lit(unit), F.lit(0))
    units = keyed.select("k1", "k2", F.posexplode(matches).alias("pos", "unit")).select("k1", "k2", (F.col("pos") + 1).alias("ordinal"), F.length("unit").alias("chars"))
    # Repeated rows give the same units: one of each stays, mostly before the shuffle.
    units = units.groupBy("k1", "k2", "ordinal").agg(F.max("chars").alias("chars"))
    whole = Window.partitionBy("k1", "k2").orderBy("ordinal")
    before = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return units.select("k1", "k2", "ordinal", F.sum("chars").over(before).alias("ends"), F.max("ordinal").over(every).alias("n"))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: str = SEED,
    rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, text, output.

    Of a text with n units the prefix ends after the smaller of two drawn unit counts from 0 to n, the
    middle after the larger. ``rate`` of 100 texts are transformed, ``spm`` of 100 of these start with the suffix.
    Plain are also texts that hold a sentinel, and the empty text; null is the empty text (n is 0). Units must
    cover the text. A text without a line end is one unit; a blank line is a unit. A null id draws as the empty text does;
    repeated rows each give their row. An empty table gives an empty result; other columns are not read.
    """
    p, s, m = _checked(sentinels)
    keyed = _with_key(docs, id_col, text_col)
    ends = unit_ends(keyed, unit)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    # A request is about a document of n units; n is known where its first unit is.
    first = keyed.where("text != ''").select("k1", "k2", h1.alias("h1"), h2.alias("h2")).groupBy("k1", "k2").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    at = ends.join(first, ["k1", "k2"]).where((F.col("ordinal") == one) | (F.col("ordinal") == two) | (F.col("ordinal") == F.col("n")))
    cut = lambda k: F.max(F.when(F.col("ordinal") == k, F.col("ends")))
    offsets = at.groupBy("k1", "k2").agg(
        F.max("n").cast("long").alias("units"),
        F.coalesce(cut(F.least(one, two)), F.lit(0)).cast("long").alias("start"),
        F.coalesce(cut(F.greatest(one, two)), F.lit(0)).cast("long").alias("stop"),
    )
    rows = keyed.join(offsets, ["k1", "k2"], "left")
    plain = (F.col("text") == "") | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (h3 % 100 >= rate)
    form = F.when(plain, PLAIN).when(h4 % 100 < spm, SPM_FORM).otherwise(PSM)
    rows = rows.select("doc_id", F.coalesce("units", F.lit(0)).cast("long").alias("n"), form.alias("form"), "start", "stop", "text")
    start, stop = F.col("start").cast("int"), F.col("stop").cast("int")
    prefix, middle = F.substring("text", F.lit(1), start), F.substring("text", start + 1, stop - start)
    suffix = F.substring("text", stop + 1, F.length("text") - stop)
    output = (
        F.when(F.col("form") == PSM, F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("form") == SPM_FORM, F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != PLAIN
    return rows.select(
        "doc_id", "n", "form", F.when(moved, F.col("start")).alias("prefix_chars"), F.when(moved, F.col("stop") - F.col("start")).alias("middle_chars"),
        "text", output.alias("output"),
    )


def digests(transformed: DataFrame) -> DataFrame:
    """The result with digests in place of texts; the restored text is rebuilt from output and form alone."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
    FROM documents
), u AS (
    SELECT *, len(units) AS n, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS UBIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM d
), c AS (
    SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
                WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM u
), t AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
), o AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM t
), s AS (
    SELECT *, regexp_split_to_array(output, '<[PSM]>') AS p FROM o
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN p[2] || p[4] || p[3] ELSE p[3] || p[4] || p[2] END) AS restored_sha256
FROM s
"""
