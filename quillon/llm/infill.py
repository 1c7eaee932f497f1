"""Fill-in-middle transformation by escaped marker injection.

A delimiter that cannot be told from text is made safe first: the text's own delimiter
and escape characters become escape pairs. One ``regexp_replace`` then puts the delimiter
after every unit, so that units can be counted by it and ``substring_index`` cuts the text
at any two ranks. The parts lose their delimiters, are unescaped and put together. All of
it is a projection: no shuffle, no state, and a lost task is done again from its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITER, ESCAPE = "\x01", "\x02"
#: What the two become inside a text: pairs that hold neither delimiter.
PAIRS = ((ESCAPE, ESCAPE + "e"), (DELIMITER, ESCAPE + "d"))
#: Units by name, as patterns over escaped text. A code point is an escape pair or one of any other kind.
UNITS = {"char": f"{ESCAPE}.|.", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}
MARKERS = ("<P>", "<S>", "<M>")


def inject(text: Column, unit: str = "char") -> Column:
    """``text`` escaped, with the delimiter after every unit."""
    for plain, pair in PAIRS:
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return F.regexp_replace(text, f"(?s)({UNITS[unit]})", "$1" + DELIMITER)


def _plain(marked: Column) -> Column:
    """Marked text without delimiters, unescaped."""
    out = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    for plain, pair in reversed(PAIRS):
        out = F.replace(out, F.lit(pair), F.lit(plain))
    return out


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` of ``form`` was made of. No part holds a marker, so the first of each is the one put in."""
    p, s, m = markers
    body = F.substring_index(output, m, 1)
    first, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    head = F.substring(F.when(form == "psm", F.substring_index(body, s, 1)).otherwise(F.substring_index(body, p, 1)), len(p) + 1, 2**31 - 1)
    tail = F.when(form == "psm", F.substring_index(body, s, -1)).otherwise(F.substring_index(body, p, -1))
    middle = F.substring_index(output, m, -1)
    known = output.startswith(first) & output.contains(second)
    text = F.when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
    return F.when((form == "plain") | ~known, output).otherwise(text)


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str = "char", markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` counts units. Two cuts, the form's choice and the order come from the SHA-256 of
    ``seed:id``. ``plain``: the text as it is, for ``100 - percent`` of a hundred rows and for texts that
    are empty or hold a marker; ``psm``: prefix, suffix, middle behind their markers; ``spm``: suffix first.

    A null text is empty and a null id is the empty string in the digest. Rows that repeat an id are cut by
    the same numbers, each by its own text. An empty table gives an empty result; other columns are not read. A very
    long text takes memory in proportion to its length, and time likewise.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(F.col("_digest"), 8 * k + 1, 8), 16, 10).cast("long")
    p, s, m = markers
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), digest.alias("_digest"))
    rows = rows.withColumn("_marked", inject(F.col("_text"), unit))
    # The delimiter is one byte and no other character of the marked text, so what it loses without it is their number.
    rows = rows.withColumn("n", (F.octet_length("_marked") - F.octet_length(F.replace("_marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    one, two = number(0) % (F.col("n") + 1), number(1) % (F.col("n") + 1)
    rows = rows.select("*", F.least(one, two).cast("int").alias("_a"), F.greatest(one, two).cast("int").alias("_b"))
    held = F.col("_text").contains(p) | F.col("_text").contains(s) | F.col("_text").contains(m)
    form = F.when((F.col("_text") == "") | held | (number(2) % 100 >= percent), "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = lambda column, count: F.call_function("substring_index", column, F.lit(DELIMITER), count)
    head = cut(F.col("_marked"), F.col("_b"))
    rows = rows.select(
        "_id", "_text", "n", form.alias("form"),
        _plain(cut(F.col("_marked"), F.col("_a"))).alias("_prefix"),
        _plain(cut(head, F.col("_a") - F.col("_b"))).alias("_middle"),
        # behind the last delimiter stands one more, empty part
        _plain(cut(F.col("_marked"), F.col("_b") - F.col("n").cast("int") - 1)).alias("_suffix"),
    )
    prefix, middle, suffix = F.concat(F.lit(p), "_prefix"), F.concat(F.lit(m), "_middle"), F.concat(F.lit(s), "_suffix")
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("_text"))
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return rows.select(F.col("_id").alias(id_col), "n", "form", chars("_prefix").alias("prefix_chars"), chars("_middle").alias("middle_chars"), output.alias("output"))


def infill_digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts, form, and digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs, **options)
    text = restored(F.col("output"), F.col("form"), options.get("markers", MARKERS))
    return made.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(text, 256)).drop("output")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o
"""
