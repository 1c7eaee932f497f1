"""Secret scans: patterns of known secrets, and a randomness test battery with false-discovery control.

Everything is a DataFrame expression. A pattern's matches and their places come
from one scan: the text is cut into segments that end with a match, and places
are running sums of their lengths (code points).

Candidates of the battery are runs of 20 or more characters of an encoding's
alphabet that hold a digit and a letter. The encoding (hex, base32, base36,
base62, base64) is inferred from the characters. Three tests of H0 "independent
uniform characters" follow: chi-squared of the alphabet's cells (16 cells at
most), runs about the alphabet's middle, and lag-one serial correlation. A candidate passes
the battery if none of the three rejects at ``alpha`` over three. It is reported
if also its distance from text is significant. The same three statistics have
p-values under text (words, identifiers, paths): few letters carry most of the
weight, so chi-squared is high; runs of letters of one case or of digits are long, so
there are few; and neighbours are of one class, so that the serial correlation is high.
Text that was put into base64 or hex passes all three; it is told by what it decodes to, and the p-value under text is
the larger of the two.
They go into one p-value by Fisher's sum, scaled for their dependence, and then
through Benjamini and Hochberg within each encoding and class of length, since short
tokens have less power. That procedure runs over counts of p-values in classes of a
tenth of a decade, a bounded table. A random token without a digit or a letter is
missed: of 20 characters of base62 one in thirty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stage

#: The base patterns, by contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the battery.
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
LENGTHS = (24, 32, 48, 64, 128)
CELL = 10  # classes of p-values in a decade
CHUNK = 128


def _cut(pattern: str) -> str:
    return rf"(?s)(.*?)({pattern}|\z)"


def _matches(text: Column, pattern: str, prefilter: str | None = None) -> Column:
    """array<struct<start, end, b0, b1, value>> of the leftmost non-overlapping matches; b0 and b1 are places in UTF-8.

    Running sums are folds over chunks of CHUNK matches, and over the chunks' totals, so that the time
    is in proportion to the matches: a fold copies what it has gathered.
    """
    whole = F.lit(_cut(pattern))
    gaps, found = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    each = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("gap_b"), F.length(m).alias("n"), F.octet_length(m).alias("n_b"), m.alias("value")))
    ints = F.array().cast("array<struct<at:int,at_b:int>>")
    fold = lambda chunk: F.aggregate(
        chunk,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("at_b"), F.array().cast(f"array<{_MATCH}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            (acc["at_b"] + x["gap_b"] + x["n_b"]).alias("at_b"),
            F.when(x["n"] == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(_match(acc["at"] + x["gap"], acc["at"] + x["gap"] + x["n"], acc["at_b"] + x["gap_b"], acc["at_b"] + x["gap_b"] + x["n_b"], x["value"])))).alias("out"),
        ),
    )
    before = lambda folded: F.aggregate(
        folded,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("at_b"), ints.alias("out")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), (acc["at_b"] + c["at_b"]).alias("at_b"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["at_b"].alias("at_b")))).alias("out")),
        lambda acc: acc["out"],
    )
    move = lambda c, o: F.transform(c["out"], lambda m: _match(m["start"] + o["at"], m["end"] + o["at"], m["b0"] + o["at_b"], m["b1"] + o["at_b"], m["value"]))
    moved = _let(_let(each, lambda e: F.transform(_chunks(e), fold)), lambda folded: F.zip_with(folded, before(folded), move))
    return F.when(text.rlike(prefilter or pattern), F.flatten(moved)).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _let(value: Column, body) -> Column:
    """``body`` of a variable that stands for ``value``, which is computed once. In a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(items: Column) -> Column:
    """An array in arrays of CHUNK; ``items`` must be a variable of a lambda."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))


_MATCH = "struct<start:int,end:int,b0:int,b1:int,value:string>"
#: In the order by which spans are sorted.
_SPAN = "struct<start:int,kind:int,end:int,b0:int,b1:int>"


def _match(start: Column, end: Column, b0: Column, b1: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), b0.alias("b0"), b1.alias("b1"), value.alias("value"))


def _span(m: Column, kind: int) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["b0"].alias("b0"), m["b1"].alias("b1"))


def _normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution (a published rational approximation, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(value: Column) -> Column:
    """struct<enc, n, size, rank, breaks, places> of a candidate; breaks are places where a run of digits, or of letters (a capital may begin one), ends."""
    body = F.rtrim(F.translate(value, "=", " "))
    n = F.length(body)
    enc = (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(body.rlike("^[0-9A-Za-z]+$"), "base62")
        .otherwise("base64")
    )
    # A character's rank in its alphabet's order, as a share of the alphabet.
    order = (
        F.when(enc == "hex", F.lit("0123456789abcdef"))
        .when(enc == "base32", F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        .when(enc == "base36", F.lit("0123456789abcdefghijklmnopqrstuvwxyz"))
        .when(enc == "base62", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
        .otherwise(F.lit("+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"))
    )
    plain = F.when(enc.isin("hex", "base36"), F.lower(body)).otherwise(body)
    size = F.length(order)
    rank = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(order, c) - 1)
    joined = F.regexp_replace(body, "[+/_-]", "")
    breaks = F.regexp_count(joined, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"))
    return F.struct(enc.alias("enc"), n.alias("n"), size.alias("size"), rank.alias("rank"), breaks.alias("breaks"), (F.length(joined) - 1).alias("places"), _decoded(body).alias("decoded"))


def _decoded(body: Column) -> Column:
    """struct<n, printable>: bytes that the token decodes to, and how many of them are of text, for the reading (base64, or hex) that looks most like text.

    Bytes of text are 0x20 to 0x7E, tab, line feed and carriage return, and all that are not control characters where the whole is UTF-8. What is left of the last
    four characters is not decoded.
    """
    whole = F.translate(body, "-_", "+/")
    four = F.substring(whole, F.lit(1), (F.floor(F.length(whole) / 4) * 4).cast("int"))
    sixteen = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.substring(body, F.lit(1), (F.floor(F.length(body) / 2) * 2).cast("int")))

    def read(raw: Column) -> Column:
        latin = F.decode(raw, "ISO-8859-1")
        plain = F.length(F.regexp_replace(latin, "[^\\x20-\\x7E\\t\\n\\r]", ""))
        wide = F.length(F.regexp_replace(latin, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))
        n = F.octet_length(raw)
        good = F.when(F.is_valid_utf8(raw.cast("string")), wide).otherwise(plain)
        return F.struct((good / F.greatest(n, F.lit(1))).alias("share"), n.alias("n"), good.alias("printable"))

    readings = F.array(read(F.try_to_binary(four, F.lit("base64"))), read(F.try_to_binary(sixteen, F.lit("hex"))))
    best = F.array_max(F.filter(readings, lambda r: r["n"] > 0))
    return F.struct(F.coalesce(best["n"], F.lit(0)).alias("n"), F.coalesce(best["printable"], F.lit(0)).alias("printable"))


def _tests(df: DataFrame) -> DataFrame:
    """Adds p_rand (least of the three tests under randomness) and p_text (under prose)."""
    n, size, rank = F.col("b.n"), F.col("b.size").cast("double"), F.col("b.rank")
    cells = F.least(F.lit(16.0), size)
    cell = F.transform(rank, lambda r: F.floor(r * cells / size).cast("int"))
    # Cells of unequal width where the alphabet is not a multiple of them: the
    # width of each is counted from the ranks that fall into it.
    df = df.withColumn("cells", cells.cast("int")).withColumn("cell", cell)
    widths = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1),
        lambda k: F.ceil((k + 1) * size / F.col("cells")) - F.ceil(k * size / F.col("cells")),
    )
    counts = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda k: F.size(F.filter(F.col("cell"), lambda c: c == k)))
    df = df.withColumn("width", widths).withColumn("count", counts)
    chi = F.aggregate(
        F.zip_with("count", "width", lambda c, w: (c - n * w / size) * (c - n * w / size) / (n * w / size)),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    free = F.col("cells") - 1.0
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is about normal.
    root = lambda x, k: (F.pow(x / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    high = F.transform(rank, lambda r: (2 * r >= size - 1).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
    n0 = n - n1
    pairs = F.arrays_zip(F.slice("h", 1, F.size("h") - 1).alias("x"), F.slice("h", 2, F.size("h") - 1).alias("y"))
    df = df.withColumn("chi", chi).withColumn("h", high).withColumn("n1", n1).withColumn("n0", n0)
    runs = 1 + F.size(F.filter(pairs, lambda p: p["x"] != p["y"]))
    mean = 2 * F.col("n1") * F.col("n0") / n + 1
    var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
    z_runs = F.when((F.col("n1") == 0) | (F.col("n0") == 0), F.lit(99.0)).otherwise((runs - mean) / F.sqrt(var))
    centred = F.transform(rank, lambda r: r - (size - 1) / 2)
    df = df.withColumn("runs_z", z_runs).withColumn("c", centred)
    lag = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda x, y: x * y)
    power = F.aggregate(F.transform("c", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    serial = F.aggregate(lag, F.lit(0.0), lambda a, x: a + x) / F.greatest(power, F.lit(1e-9)) * F.sqrt(n.cast("double"))
    p_chi = _normal_sf(root(F.col("chi"), free))
    p_two = lambda z: 2 * _normal_sf(F.abs(z))
    # Prose: few letters carry most of the weight, so that sum(p^2) of its cells is
    # about PROSE times that of a uniform text; chi-squared is then about
    # noncentral with this excess for every character.
    excess = F.lit(PROSE) * (n - 1)
    m, v = free + excess, 2 * (free + 2 * excess)
    p_chi_text = _normal_sf(-(F.col("chi") - m) / F.sqrt(v))
    # Runs: the share of breaks by its arcsine, whose variance does not depend on the share.
    places = F.greatest(F.col("b.places"), F.lit(1)).cast("double")
    share = F.least(F.greatest((F.col("b.breaks") - 0.5) / places, F.lit(0.0)), F.lit(1.0))
    p_runs_text = _normal_sf(2 * F.sqrt(places) * (F.asin(F.sqrt(share)) - math.asin(math.sqrt(BREAKS))))
    p_serial_text = _normal_sf(F.lit(SERIAL) * F.sqrt(n.cast("double")) - serial)
    total = sum((-2 * F.log(F.greatest(p, F.lit(1e-12))) for p in (p_chi_text, p_runs_text, p_serial_text)), F.lit(0.0)) / 1.5
    p_text = F.exp(-total / 2) * (1 + total / 2)  # chi-squared of 4 degrees: three sums of a correlation of about 0.3
    # Text that was encoded is text, too: the null has two parts, and its p-value is the larger. Of encoded text at least PRINTABLE of the bytes
    # are printable; so few of them have a chance bounded by Chernoff's exponent.
    size_b, share_b = F.col("b.decoded.n"), F.col("b.decoded.printable") / F.greatest(F.col("b.decoded.n"), F.lit(1))
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    p_encoded = F.when(size_b == 0, 0.0).when(share_b >= PRINTABLE, 1.0).otherwise(F.exp(-size_b * (part(share_b, F.lit(PRINTABLE)) + part(1 - share_b, F.lit(1 - PRINTABLE)))))
    p_text = F.greatest(p_text, p_encoded)
    return df.withColumn("p_rand", F.least(p_chi, p_two(F.col("runs_z")), p_two(serial))).withColumn("p_text", p_text)


#: Under text. Excess of sum(p^2) over uniform, times the cells, of prose with the digits that identifiers hold.
PROSE = 1.0
#: Under encoded text: the share of printable bytes.
PRINTABLE = 0.95
#: Under text: the share of places at which a run ends, and the serial correlation about the alphabet's middle.
BREAKS, SERIAL = 0.17, 0.5


def _length_class() -> Column:
    out = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        out = F.when(F.col("b.n") < LENGTHS[k], k).otherwise(out)
    return out


def scan(docs: DataFrame, alpha: float = 0.01, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, extra) per row: arrays of struct<start, kind, end, b0, b1> (0-based code points, end exclusive; b0 and b1 are places in UTF-8).

    ``base`` holds the contract's patterns, ``extra`` what the battery adds at the
    false-discovery rate ``rate``. A null or empty text has none. Rows that
    repeat an id are scanned each. Other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("id"), *_found(F.col(text_col)))
    found = stage(found.withColumn("row", F.monotonically_increasing_id()))
    out = found.join(_extra(found, alpha, rate), "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("row"),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sort_array(F.concat("assign", "access", "hex")).alias("base"),
        F.coalesce("extra", F.array().cast(f"array<{_SPAN}>")).alias("extra"),
    )


def _found(column: Column) -> list[Column]:
    """Spans of the base patterns, and the battery's candidates, of a text column."""
    text = F.coalesce(column, F.lit(""))
    kind = lambda arr, k: F.transform(arr, lambda m: _span(m, k))
    assign = F.filter(_matches(text, ASSIGN, r"(?i:password|passwd|secret|token|api_?key)"), lambda m: F.length(F.regexp_extract(m["value"], "^" + ASSIGN, 1)) >= 6)
    access = F.filter(_matches(text, ACCESS), lambda m: F.length(m["value"]) >= 20)
    return [
        kind(assign, 0).alias("assign"),
        kind(access, 1).alias("access"),
        kind(_matches(text, HEX), 2).alias("hex"),
        F.filter(_matches(text, RANDOM), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")).alias("tokens"),
    ]


def _extra(found: DataFrame, alpha: float, rate: float) -> DataFrame:
    """(row, extra): the candidates of ``found(row, tokens)`` that the battery reports."""
    tests = found.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("m")).withColumn("b", _battery(F.col("m.value")))
    tests = _tests(tests).select("row", _span(F.col("m"), 3).alias("s"), F.col("b.enc").alias("enc"), _length_class().alias("len"), "p_rand", F.floor(-F.log10(F.greatest("p_text", F.lit(1e-12))) * CELL).cast("int").alias("cell"))
    tests = stage(tests)
    # Benjamini and Hochberg on classes of p-values: the largest p with m p <= rate k.
    cells = tests.groupBy("enc", "len", "cell").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the classes
    chosen = F.lit(False)
    for key in sorted({(r["enc"], r["len"]) for r in cells}):
        mine = sorted(((r["cell"], r["n"]) for r in cells if (r["enc"], r["len"]) == key), reverse=True)
        total, k, cut = sum(n for _, n in mine), 0, None
        for c, n in mine:
            k += n
            if 10 ** (-c / CELL) * total <= rate * k:
                cut = c
        if cut is not None:
            chosen = chosen | ((F.col("enc") == key[0]) & (F.col("len") == key[1]) & (F.col("cell") >= cut))
    extra = tests.where(chosen & (F.col("p_rand") >= alpha / 3)).select("row", "s")
    return extra.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("extra"))


def redact(docs: DataFrame, mark: str = "[SECRET]", alpha: float = 0.01, rate: float = 0.05) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; all rows and columns stay.

    Spans that overlap or touch become one mark. ``n_chars``, where there is such a
    column, becomes the length of a changed text. Null texts stay null.
    """
    suspect = F.coalesce(F.col("text").rlike("|".join((ASSIGN, ACCESS, HEX, RANDOM))), F.lit(False))
    rest = docs.where(~suspect)
    hit = docs.where(suspect).select(F.struct(*docs.columns).alias("_q_doc"), *_found(F.col("text")))
    hit = stage(hit.withColumn("row", F.monotonically_increasing_id()))
    hit = hit.join(_extra(hit, alpha, rate), "row", "left")
    spans = F.sort_array(F.concat("assign", "access", "hex", F.coalesce("extra", F.array().cast(f"array<{_SPAN}>"))))
    # Each piece is what lies between the spans so far and the next one; bytes are cut in constant time.
    hit = hit.withColumn("spans", spans).withColumn("reach", _let(F.transform("spans", lambda s: s["b1"]), _running_max))

    def redacted(raw: Column) -> Column:
        cut = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
        pieces = F.zip_with("spans", F.col("reach"), lambda s, r: F.when(s["b0"] > r, F.concat(cut(r, s["b0"]), F.lit(mark))).when(r == 0, F.lit(mark)).otherwise(F.lit("")))
        # a row of which no candidate is reported has no spans
        last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["b1"])), F.lit(0))
        return F.concat(F.array_join(pieces, ""), _let(last, lambda at: cut(at, F.octet_length(raw))))

    text = F.col("_q_doc.text")
    hit = hit.withColumn("new", _let(text.cast("binary"), redacted))
    new = {"text": F.col("new"), "n_chars": F.when(F.col("new") != text, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_q_doc.n_chars")) if "n_chars" in docs.columns else None}
    return rest.unionByName(hit.select(*[new[c].alias(c) if c in new else F.col("_q_doc")[c].alias(c) for c in docs.columns]))


def _running_max(values: Column) -> Column:
    """For each value of a lambda's variable the largest of those before it, 0 for the first; by chunks, as in _matches()."""
    ints = F.array().cast("array<int>")

    def fold(items: Column, most, start: Column) -> Column:
        state = F.struct(start.alias("top"), ints.alias("out"))
        step = lambda acc, x: F.struct(F.greatest(acc["top"], most(x)).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out"))
        return F.aggregate(items, state, step, lambda acc: acc["out"])

    before = lambda chunks: fold(chunks, lambda c: F.coalesce(F.array_max(c), F.lit(0)), F.lit(0))
    return _let(_chunks(values), lambda chunks: F.flatten(F.zip_with(chunks, before(chunks), lambda c, o: fold(c, lambda x: x, o))))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of the base spans, their digest, and all spans.

    Null and empty texts have no spans; rows that repeat an id are scanned each; an
    empty table gives an empty result. Other columns are not read.
    """
    found = scan(docs, **options)
    every = F.sort_array(F.concat("base", "extra"))
    return found.select(found.columns[0], "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"))
