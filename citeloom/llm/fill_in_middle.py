"""Fill-in-the-middle rows, cut by a counted pattern for each row.

A unit is a run of Latin letters or any other single character. regexp_count
gives their number n; two hashes of the key choose after how many units the
prefix and the middle end, a <= b; one match of a pattern made for the row,
with possessive groups unit{a} and unit{b-a}, captures prefix, middle and
suffix, and its replacement writes them between sentinels. A possessive
quantifier loops inside the matcher and never backtracks, so a cut deep in a
very long text needs no deep stack. All of it runs in the JVM, row by row:
nothing is shuffled.

Defined results: a null text is empty and stays plain, like every text that
holds a sentinel; a null key hashes as an empty number; rows that repeat give
repeated results; an empty table gives none. Extra columns pass through unless
they bear the name of an output column (FORM), which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters that one count looks at: its matches are an array for a moment.
SLICE = 1 << 20
FORM = ["n", "form", "prefix_chars", "middle_chars", "output"]


def n_units(text: Column, width: int = SLICE) -> Column:
    """How many units the text has; counted by slices, a run of letters that goes on into the next one counts once."""
    count = lambda c: F.regexp_count(c, F.lit(UNIT)).cast("long")
    size = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(width))
    torn = lambda at: F.when((at > 0) & F.substr(text, at, F.lit(2)).rlike("^[A-Za-z]{2}"), 1).otherwise(0)
    sliced = F.aggregate(starts, F.lit(0).cast("long"), lambda n, at: n + count(F.substr(text, at + 1, F.lit(width))) - torn(at))
    return F.when(size <= width, count(text)).otherwise(sliced)


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed, colon and key."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "utf-8"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: str = "1", rate: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS, width: int = SLICE) -> DataFrame:
    """docs with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate: rows in a hundred that are transformed; spm: of these, rows in a
    hundred that have the suffix first. The text column becomes never null.
    """
    p, s, m = sentinels
    names = [c for c in docs.columns if c not in FORM]
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for x in sentinels:
        marked = marked | F.contains(text, F.lit(x))
    drawn = docs.select(*[c for c in names if c != "text"], text.alias("text"), F.array(*draws(F.col(key), seed)).alias("__h"), n_units(text, width).alias("n"), marked.alias("__marked"))
    h = lambda i: F.element_at("__h", i)
    cuts = [h(i) % (F.col("n") + 1) for i in (1, 2)]
    form = F.when((F.col("text") == "") | F.col("__marked") | (h(3) % 100 >= rate), "plain").when(h(4) % 100 < spm, "spm").otherwise("psm")
    cut = drawn.select(*names, "n", form.alias("form"), F.least(*cuts).alias("__a"), F.greatest(*cuts).alias("__b"))
    units = lambda k: F.concat(F.lit(f"((?:{UNIT}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("^"), units(F.col("__a")), units(F.col("__b") - F.col("__a")), F.lit("((?s:.*))"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    out = cut.select(*names, "n", "form", output.alias("output"))
    # No text holds a sentinel, so the first of each is the one just written.
    begin = lambda x: F.locate(x, F.col("output")) + len(x)
    stop = lambda x: F.locate(x, F.col("output"))
    first = F.when(F.col("form") == "psm", stop(s)).otherwise(stop(m)) - begin(p)
    middle = F.length("output") + 1 - begin(m)
    shaped = F.col("form") != "plain"
    return out.select(*names, "n", "form", F.when(shaped, first.cast("long")).alias("prefix_chars"), F.when(shaped, middle.cast("long")).alias("middle_chars"), "output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output of that form was made."""
    p, s, m = sentinels
    after = lambda c, x: F.substr(c, F.locate(x, c) + len(x))
    upto = lambda c, x: F.substr(c, F.lit(1), F.locate(x, c) - 1)
    last = after(output, m)
    psm = F.concat(upto(after(output, p), s), last, upto(after(output, s), m))
    spm = F.concat(upto(after(output, p), m), last, upto(after(output, s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Form, cut and digests of every document's output, and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs)
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM t),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS f, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(f) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || f || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || f || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""
