"""Abstracts for bibliography entries out of recorded answers, run again and again over the same files.

A ledger says which abstract of which source an entry was given; what it
attests is not asked for again. Other entries are asked about once for each
different question (DOI, title, first surname), however many entries share it,
so that one DOI on a third of all entries is one question.

Defined results: an abstract is there from LONGER characters on, without white
space at its ends. Entries without DOI and title ask nothing and stay
incomplete. Of equal answers of a source the first (ord) counts. Null fields
count as empty. An abstract whose braces are not balanced is refused: the entry
stays as it is and nothing is attested. Files with a chunk that cannot be read
stay byte for byte, without ledger rows; so does a text in which no entry is
found. Of equal keys in a file the last written one is attested. Further
columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.operators.licence import field
from citeloom.operators.search import best_review
from citeloom.session import written
from citeloom.sources import bibtex, versions

#: Sources in the order in which they are asked, those that know works by DOI only, and marks of entries without abstract.
SOURCES, BY_DOI_ONLY = ("s2", "openalex", "core"), ("s2", "openalex")
REVIEW = "ndpr"
MARKS = ("INCOMPLETE", "no-abstract")
#: An entry's abstract is longer than this, a searched one and a review than that; characters by which titles are compared.
LONGER, LONGER_FOUND, HEAD = 10, 50, 30
LEDGER = "bib_file string, key string, abstract_source string, abstract_sha256 string"
OUTCOMES = ("attested", "prefilled_attested", "prefilled_unverified", "enriched", "incomplete", "refused")


def _head(title: Column) -> Column:
    return F.substring(F.lower(F.trim(title)), 1, HEAD)


def first_surname(author: Column) -> Column:
    """The first author's last name, lower-cased; empty if there is no author."""
    first = F.trim(F.element_at(F.split(F.coalesce(author, F.lit("")), r"\s+and\s+"), 1))
    return F.lower(F.when(first == "", "").otherwise(keys.surname_last_word(first)))


def answered(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """doi, title, surname, abstract, source: the first source's answer to each question (doi, title, surname: text, empty if unknown).

    answers: source, doi, title, surname, abstract, ord. s2 and openalex know
    works by DOI. core is asked by DOI and then must agree in the first HEAD
    characters of either title; without a DOI it is searched by them, and by
    the surname if there is one. Its abstracts are longer than LONGER_FOUND.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    text = lambda c: F.coalesce(c, F.lit(""))
    usable = F.when(F.col("source").isin(*BY_DOI_ONLY), text(F.col("abstract")) != "").otherwise(F.length(text(F.col("abstract"))) > LONGER_FOUND)
    given = answers.filter(F.col("source").isin(*SOURCES) & usable).select(
        keys.doi_key("doi").alias("doi"), F.lower(F.trim(text(F.col("title")))).alias("theirs"), F.lower(text(F.col("surname"))).alias("surname"), F.struct(rank.alias("rank"), "ord", "source", F.sha2("abstract", 256).alias("digest")).alias("answer")
    )
    given = written(given, "given")  # texts are digested once, not for each way of asking
    first = F.min("answer").alias("answer")
    of_doi = given.filter((F.col("doi") != "") & F.col("answer.source").isin(*BY_DOI_ONLY)).groupBy("doi").agg(first)
    core = given.filter(~F.col("answer.source").isin(*BY_DOI_ONLY))
    of_work = core.filter("doi != ''").groupBy("doi", "theirs").agg(first)
    titled = core.filter("theirs != ''").withColumn("head", _head(F.col("theirs")))
    of_title, of_author = titled.groupBy("head").agg(first), titled.groupBy("head", "surname").agg(first)
    each = asked.select("doi", "title", "surname").distinct()
    mine, theirs = F.lower(F.trim(F.col("title"))), F.col("theirs")
    agree = (mine == "") | F.contains(theirs, _head(mine)) | F.contains(mine, _head(theirs))
    no_doi = each.filter("doi = '' AND title != ''").withColumn("head", _head(F.col("title")))
    question = ["doi", "title", "surname"]
    found = each.filter("doi != ''").join(of_doi, "doi").select(*question, "answer")
    found = found.unionByName(each.filter("doi != ''").join(of_work, "doi").filter(agree).select(*question, "answer"))
    found = found.unionByName(no_doi.filter("surname != ''").join(of_author, ["head", "surname"]).select(*question, "answer"))
    found = found.unionByName(no_doi.filter("surname = ''").join(of_title, "head").select(*question, "answer"))
    best = written(found.groupBy(*question).agg(F.min("answer").alias("a")).select(*question, "a.source", "a.digest"), "best")
    # Only digests were dealt so far; each text that won is fetched once.
    texts = answers.filter("abstract IS NOT NULL").select(F.sha2("abstract", 256).alias("digest"), "abstract").join(best.select("digest").distinct(), "digest", "left_semi")
    return best.join(texts.groupBy("digest").agg(F.first("abstract").alias("abstract")), "digest").select(*question, "abstract", "source")


def with_marks(keywords: Column) -> Column:
    """Keywords with both marks of an entry that has no abstract, each unless it stands there."""
    out = F.trim(F.coalesce(keywords, F.lit("")))
    for mark in MARKS:
        out = F.when(F.contains(out, F.lit(mark)), out).when(out == "", mark).otherwise(F.concat(out, F.lit(", " + mark)))
    return out


def without_marks(keywords: Column) -> Column:
    """Keywords without the marks; null if none is left."""
    words = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda w: F.trim(w)), lambda w: (w != "") & ~w.isin(*MARKS))
    return F.nullif(F.array_join(words, ", "), F.lit(""))


def asked_columns() -> list[Column]:
    """What an entry (entry_type, fields) is asked about, without its texts."""
    value = lambda name: field(F.col("fields"), name)
    held = F.length(F.trim(value("abstract"))) > LONGER
    return [
        F.lower("entry_type").alias("kind"), held.alias("held"), F.when(held, keys.abstract_hash(value("abstract"))).alias("own_sha256"), F.lower(F.trim(value("abstract_source"))).alias("own_source"), value("keywords").alias("keywords"),
        keys.doi_key(value("doi")).alias("doi"), F.trim(value("title")).alias("title"), first_surname(value("author")).alias("surname"),
    ]


def plan(entries: DataFrame, answers: DataFrame, ledger: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """bib_file, entry_ord, key, outcome, abstract_source, abstract_sha256, edits for entries (bib_file, entry_ord, key, entry_type, fields).

    ledger: LEDGER; what it attests with the entry's own source and text is
    `attested` and asks nothing. An abstract that was there is attested only if
    an answer has its hash. Books of high or medium importance that no source
    knows may take the summary of a review (slug, ord, summary_text) instead.
    Source and hash are null where nothing is attested now.
    """
    return decided(entries.select("bib_file", "entry_ord", "key", *asked_columns()), answers, ledger, reviews)


def decided(own: DataFrame, answers: DataFrame, ledger: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The plan for entries that have asked_columns."""
    last = ledger.groupBy("bib_file", "key").agg(F.max_by(F.struct(F.lower(F.trim("abstract_source")).alias("source"), F.col("abstract_sha256").alias("sha256")), F.struct("abstract_source", "abstract_sha256")).alias("prior"))
    own = own.join(last, ["bib_file", "key"], "left")
    attested = F.coalesce(F.col("held") & (F.col("prior.sha256") == F.col("own_sha256")) & (F.col("own_source") != "") & (F.col("prior.source") == F.col("own_source")), F.lit(False))
    own = written(own.withColumn("attested", attested).drop("prior"), "asked")
    question = ["doi", "title", "surname"]
    told = answered(own.filter("NOT attested AND (doi != '' OR title != '')"), answers).withColumn("sha256", keys.abstract_hash("abstract"))
    new = own.filter("NOT attested").join(told, question, "left")
    if reviews is not None:
        eligible = (F.col("kind") == "book") & ~F.col("held") & F.col("source").isNull() & F.arrays_overlap(F.transform(F.split("keywords", ","), lambda w: F.trim(w)), F.array(F.lit("High"), F.lit("Medium"))) & (F.col("title") != "")
        books = own.filter("NOT attested AND NOT held AND kind = 'book'").select("title", "surname").distinct()
        named = books.select(F.struct("title", "surname").alias("book"), "title", F.col("surname").alias("author"))
        best = best_review(named, reviews.select("slug", "ord")).join(reviews.groupBy("slug").agg(F.min_by("summary_text", "ord").alias("summary")), "slug").filter(F.length("summary") > LONGER_FOUND)
        new = new.join(best.select("book.title", "book.surname", "summary"), ["title", "surname"], "left")
        reviewed = eligible & F.col("summary").isNotNull()
        new = new.withColumn("abstract", F.when(reviewed, F.col("summary")).otherwise(F.col("abstract"))).withColumn("sha256", F.when(reviewed, keys.abstract_hash("summary")).otherwise(F.col("sha256")))
        new = new.withColumn("source", F.when(reviewed, REVIEW).otherwise(F.col("source"))).drop("summary")
    same = F.coalesce(F.col("sha256") == F.col("own_sha256"), F.lit(False))
    outcome = F.when(F.col("held"), F.when(same, "prefilled_attested").otherwise("prefilled_unverified")).when(F.col("source").isNotNull(), "enriched").otherwise("incomplete")
    new = new.withColumn("outcome", outcome)
    pair = lambda name, v: F.create_map(F.lit(name), v.cast("string"))
    none = F.create_map().cast("map<string,string>")
    given = F.map_concat(pair("abstract", F.col("abstract")), pair("abstract_source", F.col("source")))
    unmarked = F.when((F.col("source") == REVIEW) & F.exists(F.array(*map(F.lit, MARKS)), lambda m: F.contains("keywords", m)), F.map_concat(given, pair("keywords", without_marks(F.col("keywords"))))).otherwise(given)
    marked = with_marks(F.col("keywords"))
    edits = (
        F.when(F.col("outcome") == "enriched", unmarked)
        .when((F.col("outcome") == "prefilled_attested") & (F.col("own_source") != F.col("source")), pair("abstract_source", F.col("source")))
        .when((F.col("outcome") == "incomplete") & (marked != F.trim("keywords")), pair("keywords", marked))
        .otherwise(none)
    )
    kept = F.col("outcome").isin("enriched", "prefilled_attested")
    out = ["bib_file", "entry_ord", "key", "outcome", "abstract_source", "abstract_sha256", "edits"]
    fresh = new.withColumn("abstract_source", F.when(kept, F.col("source"))).withColumn("abstract_sha256", F.when(kept, F.col("sha256"))).withColumn("edits", edits).select(*out)
    old = own.filter("attested").select("bib_file", "entry_ord", "key", F.lit("attested").alias("outcome"), F.lit(None).cast("string").alias("abstract_source"), F.lit(None).cast("string").alias("abstract_sha256"), none.alias("edits"))
    return fresh.unionByName(old)


def counted(done: DataFrame, files: DataFrame) -> DataFrame:
    """bib_file, state, total, had_abstract, one column for each of OUTCOMES and for each source: what a run did to each file (bib_file, state)."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    had = F.count_if(F.col("outcome").isin("attested", "prefilled_attested", "prefilled_unverified")).alias("had_abstract")
    by = [F.count_if((F.col("outcome") == "enriched") & (F.col("abstract_source") == s)).alias(s) for s in (*SOURCES, REVIEW)]
    sums = done.groupBy("bib_file").agg(F.count(F.lit(1)).alias("total"), had, *map(of, OUTCOMES), *by)
    return files.join(sums, "bib_file", "left").fillna(0, [c for c in sums.columns if c != "bib_file"])


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame] | None:
    """Texts (bib_file, file_ord, content) and ledger of the version that holds under out; None before the first run."""
    folder = versions.current(spark, out)
    if folder is None:
        return None
    return _texts(spark, folder), _ledger(spark, folder)


def current_ledger(spark: SparkSession, out: str) -> DataFrame | None:
    """The ledger alone: the texts' folders, one a file, are not listed."""
    folder = versions.current(spark, out)
    return None if folder is None else _ledger(spark, folder)


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(f"{folder}/ledger")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.read.schema("value string, bib_file string").text(f"{folder}/bib", wholetext=True)
    return texts.select("bib_file", F.lit(0).alias("file_ord"), F.col("value").alias("content"))


def enrich_files(texts: DataFrame, answers: DataFrame, out: str, reviews: DataFrame | None = None) -> DataFrame:
    """Texts (bib_file, file_ord, content) to texts with abstracts; what the run did to each file (see counted).

    Texts and ledger are one version under out, written before its pointer
    moves; the counts are its report. The ledger of the version before is read
    first: it spares what it attests, gives way to new rows, and loses keys
    that are no longer there.
    """
    spark = texts.sparkSession
    before = current_ledger(spark, out)
    prior = spark.createDataFrame([], LEDGER) if before is None else before
    # Without the fields: their texts stand in raw.
    parsed = written(bibtex.parse(texts).select("bib_file", "entry_ord", "raw", "entry_type", "key", "error", (F.trim("raw") != "").alias("some"), *asked_columns()), "entries")
    shapes = parsed.groupBy("bib_file").agg(F.count("error").alias("bad"), F.count("key").alias("entries"), F.coalesce(F.bool_or("some"), F.lit(False)).alias("some"))
    state = F.when(~F.coalesce("some", F.lit(False)), "empty").when(F.col("bad") > 0, "broken").when(F.col("entries") == 0, "unread").otherwise("done")
    files = written(texts.select("bib_file").distinct().join(shapes, "bib_file", "left").select("bib_file", state.alias("state")), "files")
    sound = parsed.join(files.filter("state = 'done'").select("bib_file"), "bib_file", "left_semi")
    asked = sound.filter("key IS NOT NULL").select("bib_file", "entry_ord", "key", *[c for c in parsed.columns if c not in ("bib_file", "entry_ord", "key", "raw", "entry_type", "error", "some")])
    planned = decided(asked, answers, prior, reviews).drop("key")
    chunks = parsed.select("bib_file", "entry_ord", "raw", "entry_type", "key").join(planned, ["bib_file", "entry_ord"], "left")
    # One pass over all chunks: those without edits go through it as they are.
    touched = chunks.withColumn("edits", F.when(F.size("edits") > 0, F.col("edits"))).withColumn("new_type", F.lit(None).cast("string"))
    whole = written(bibtex.spliced(touched), "spliced")
    no = F.col("refusal").isNotNull()
    done = whole.filter("outcome IS NOT NULL").select("bib_file", "entry_ord", "key", F.when(no, "refused").otherwise(F.col("outcome")).alias("outcome"), *[F.when(~no, F.col(c)).alias(c) for c in ("abstract_source", "abstract_sha256")])
    fresh = done.filter("abstract_sha256 IS NOT NULL").groupBy("bib_file", "key").agg(F.max_by(F.struct("abstract_source", "abstract_sha256"), "entry_ord").alias("a")).select("bib_file", "key", "a.*")
    stay = prior.join(done.select("bib_file", "key").distinct(), ["bib_file", "key"], "left_semi").join(fresh, ["bib_file", "key"], "left_anti")
    # Ledgers of files that could not be read are as they were: their entries are not known to be gone.
    unread = prior.join(files.filter("state IN ('broken', 'unread')").select("bib_file"), "bib_file", "left_semi")
    ledger = stay.unionByName(fresh).unionByName(unread)
    counts = written(counted(done, files), "counts")
    versions.commit(spark, out, lambda path: counts.write.json(path), {"ledger": lambda path: ledger.write.json(path), "bib": lambda path: bibtex.write_texts(bibtex.to_text(whole.withColumn("fields", F.create_map().cast("map<string,string>"))), path)})
    return counts
