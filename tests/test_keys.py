"""Keys and folds, case by case."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from citeloom.functions import folds, keys


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def each(spark, function, cases):
    df = spark.createDataFrame(list(cases.items()), "x string, want string")
    return [(r.x, r.got) for r in df.select("x", "want", function(F.col("x")).alias("got")).collect() if r.got != r.want]


CASES = [
    (keys.doi_key, {" https://doi.org/10.1/A ": "10.1/a", "http://dx.doi.org/10.2": "10.2", "doi:10.3": "10.3", "https://doi.org/": "", "https://doi.org/doi:10.4": "10.4", "": ""}),
    (keys.year_key, {"2019": "2019", "2019.0": "2019", "02019": "2019", "+7": "7", "-007.00": "-7", "-0": "0", "2019.": "2019.", " n.d. ": "n.d.", "": ""}),
    (keys.page_key, {"1 -- 9": "1-9", "3–5": "3-5", "7—8 ": "7-8", "12": "12"}),
    (keys.title_key, {"Straße & Söhne": "strasse sohne", "  The—Mind's   Eye ": "the mind s eye", "ﬁn": "fin", "": ""}),
    (keys.journal_key, {"The Philosophy \\& Technology": "philosophy & technology", "No\\^{u}s": "nous", "No&ucirc;s": "no&ucirc;s", "Philosophy &amp; X": "philosophy & x", "{Mind}": "mind", "No\\\"us": "nous"}),
    (keys.venue_key, {"Proceedings of the 34th International Conference on Machine Learning (ICML 2017)": "international conference on machine learning", "Advances in Neural Information Processing Systems 30": "neural information processing systems", "Advances in Applied Energy 12": "advances in applied energy 12", "Eighteenth-Century Life": "eighteenth-century life", "Library of Congress Quarterly 7": "library of congress quarterly 7", "Criminology (Beverly Hills)": "criminology", "Mind (Oxford) (Online)": "mind", "2019 Journal of X 3": "journal of x 3", "Proceedings of the Twenty-First Annual Meeting of Y 12": "annual meeting of y", "Proc. of 2017 Fifth 2018 Workshop on Z, 9": "workshop on z", "Proceedings of the Oxford Studies Conference Volume 5": "oxford studies conference volume 5", "Proceedings of the Aristotelian Society 10": "proceedings of the aristotelian society 10", "First Conference on A 7": "conference on a 7", "": ""}),
    (keys.slug_title, {"The Mind's Eye: A Tour": "the minds eye", "Self-Help  and\tX": "selfhelp and x", "": ""}),

    (keys.venue_lookup_key, {"The Mind & Machine": "mind and machine"}),
    (keys.url_key, {"HTTP://Ex.org:80/A/b/?q=1#f": "http://ex.org/A/b?q=1", "https://x.org/": "https://x.org", "https://x.org:443": "https://x.org", "http://x.org:8080/a": "http://x.org:8080/a", "http://x.org:99999/a": "http://x.org/a", "http://x.org:ab/": "http://x.org", "http://x.org:0080/": "http://x.org", "http://x.org:0/": "http://x.org", "nonsense": "nonsense"}),
    (lambda c: keys.registered_domain(keys.url_host(c)), {"http://a.b.example.com/x": "example.com", "http://me.github.io": "me.github.io", "https://www.ox.ac.uk/": "ox.ac.uk", "http://localhost": "localhost"}),
    (lambda c: keys.excluded_host(c), {"plato.stanford.edu": "plato.stanford.edu", "x.philpapers.org.": "philpapers.org", "notphilpapers.org": None, "iep。utm。edu": "iep.utm.edu"}),
    (lambda c: keys.surname_last_word(c), {"Ada Lovelace": "Lovelace", "Lovelace, Ada": "Lovelace", "Plato": "Plato"}),
    (lambda c: keys.surname_comma_first(c), {"Ada Lovelace": "Ada Lovelace", "Lovelace, Ada": "Lovelace"}),
    (lambda c: F.array_join(keys.name_variants(c), "|"), {"Müller": "muller|mueller", "Smith": "smith", "Øst": "øst|oest"}),
    (lambda c: keys.first_url(c, F.lit("see https://b.org/x).")), {"": "https://b.org/x", "\\url{http://a.org/p\\_q}": "http://a.org/p_q"}),
    (lambda c: F.array_join(keys.cleaned_fields(c), "|"), {"a, METADATA\\_CLEANED: doi, pages, year:1->2": "doi|pages", "High": ""}),
    (lambda c: F.array_join(keys.natural_key(c), ""), {"a2": "a00000000000000000002"}),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases(spark, n):
    assert each(spark, *CASES[n]) == []


def test_nulls_have_empty_keys(spark):
    none = F.lit(None).cast("string")
    for key in (keys.doi_key, keys.title_key, keys.year_key, keys.page_key, keys.journal_key, keys.url_key, keys.publisher_key):
        assert value(spark, key(none)) == ""


def test_fold_equals_python_over_latin_letters(spark):
    letters = [chr(c) for low, high in ((0x41, 0x250), (0x1E00, 0x1F00)) for c in range(low, high) if unicodedata.category(chr(c))[0] == "L"]
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    wrong = [r.c for r in df.select("c", folds.fold("c").alias("f")).collect() if r.f != folds.folded(r.c)]
    assert wrong == []


def test_url_key_twice_is_once(spark):
    urls = ["http://A.org:80//x/", "https://b.org/c?d#e", "ftp://x", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(keys.url_key("u").alias("k"))
    assert df.filter(keys.url_key("k") != F.col("k")).count() == 0


def test_typed_values(spark):
    assert value(spark, keys.dated_year([("print", F.lit(0)), ("online", F.lit(2011))])) == (2011, "online")
    assert value(spark, keys.entry_type(F.lit("book-set"))) == "book" and value(spark, keys.entry_type(F.lit("zzz"))) == "misc"
    index = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert value(spark, keys.text_of_inverted_index(index)) == "a b a b"
    assert value(spark, keys.display_year(F.lit("2010"), F.lit("b"))) == "2010b" and value(spark, keys.display_year(F.lit("2010"), F.lit("unassigned"))) == "2010"
    assert value(spark, keys.printable_share(F.lit(""))) == 0.0 and value(spark, keys.printable_share(F.lit("ab\x01\x02"))) == 0.5


def test_work_keys_and_signatures(spark):
    rows = [("The Mind's Eye", " 2001 ", "Müller", "Müller, Ann and Bo Weiß", None), ("T", "", "S", "", "Ed, A."), (None, "2001", "S", "Plato", None), ("T", "2001", "S", ", X and Y, Z", None)]
    df = spark.createDataFrame(rows, "title string, year string, surname string, author string, editor string")
    got = df.select(keys.fallback_key(F.col("title"), F.col("year"), F.col("surname")).alias("k"), F.transform(keys.author_signature(F.col("author"), F.col("editor")), lambda p: F.concat_ws("/", p["surname"], p["initial"])).alias("s")).collect()
    assert [r.k for r in got] == ["the mind s eye|2001|muller", None, None, "t|2001|s"]
    assert [r.s for r in got] == [["muller/a", "weiss/b"], ["ed/a"], ["plato/"], []]
    record = spark.createDataFrame([("J", " ", None, "1-2", "P"), (None, None, None, None, None)], "container_title string, volume string, issue string, pages string, publisher string")
    assert [(r.f, r.n) for r in record.select(keys.supplied_fields().alias("f"), keys.completeness().alias("n")).collect()] == [(["container_title", "pages", "publisher"], 3), ([], 0)]
