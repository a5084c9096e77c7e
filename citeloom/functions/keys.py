"""Comparison keys of bibliographic values, as Spark columns.

A null or blank value has the empty key, and the empty key matches nothing;
callers guard joins with `present`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.folds import fold, squeeze, transliterated

#: Spellings of a DOI resolver, each stripped once, in this order.
DOI_PREFIXES = ("https://dx.doi.org/", "http://dx.doi.org/", "https://doi.org/", "http://doi.org/", "doi:", "doi.org/")
#: Suffixes of two labels under which a domain has three.
TWO_PART_SUFFIXES = ("github.io", "gitlab.io", "blogspot.com", "wordpress.com", "substack.com", "webflow.io", "netlify.app", "vercel.app", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "edu.au", "co.nz", "co.jp", "co.za", "com.br")
#: Words that a title's tokens leave out.
STOPWORDS = ("and", "the", "for", "with", "from", "that", "this", "its", "are", "was", "has", "have", "but", "all", "can", "one", "two", "own", "out", "who")
#: Record types and the entry types they become.
ENTRY_TYPES = {"journal-article": "article", "book-chapter": "incollection", "book-section": "incollection", "book-part": "incollection", "book-track": "incollection", "book": "book", "monograph": "book", "edited-book": "book", "reference-book": "book", "book-set": "book", "book-series": "book", "proceedings-article": "inproceedings", "dissertation": "phdthesis", "posted-content": "misc", "report": "techreport", "reference-entry": "misc"}
#: Hosts whose pages never count as web evidence.
EXCLUDED_HOSTS = ("plato.stanford.edu", "plato.sydney.edu.au", "seop.illc.uva.nl", "iep.utm.edu", "ndpr.nd.edu", "philpapers.org")
#: What names a conference, ordinals in words, and series whose names have no such word.
CONFERENCE = r"\b(conference|proceedings|symposium|workshop|congress|annual meeting|colloquium)\b"
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth", "thirtieth", "fortieth", "fiftieth", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SERIES = ("neural information processing systems",)
#: LaTeX spellings of letters without an accent command.
LATEX_LETTERS = {r"{\ss}": "ß", r"\ss": "ß", r"{\o}": "ø", r"{\O}": "Ø", r"{\l}": "ł", r"{\L}": "Ł", r"{\aa}": "å", r"{\AA}": "Å", r"{\ae}": "æ", r"{\AE}": "Æ", r"{\oe}": "œ", r"{\OE}": "Œ"}
#: HTML entities that venue names hold.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def text_of(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def let(value: Column, then) -> Column:
    """then(value) with the value computed, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def present(key: Column) -> Column:
    """Whether a key can match at all."""
    return key.isNotNull() & (key != "")


def doi_key(value: Column | str) -> Column:
    x = F.lower(F.trim(text_of(value)))
    for prefix in DOI_PREFIXES:
        x = F.regexp_replace(x, "^" + prefix.replace(".", r"\."), "")
    return x


def title_key(value: Column | str) -> Column:
    """Folded letters and digits, words apart by one space."""
    return F.trim(F.regexp_replace(fold(text_of(value)), r"[^\p{L}\p{N}]+", " "))


def year_key(value: Column | str) -> Column:
    """Whole years without leading zeros and fractions of zero; anything else as it is, trimmed."""
    x = F.trim(text_of(value))
    shape = r"^([+-]?)([0-9]+)(?:\.0+)?$"
    digits = F.regexp_replace(F.regexp_extract(x, shape, 2), "^0+(?=[0-9])", "")
    sign = F.when((F.regexp_extract(x, shape, 1) == "-") & (digits != "0"), "-").otherwise("")
    return F.when(x.rlike(shape), F.concat(sign, digits)).otherwise(x)


def page_key(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_of(value), r"\s*[-–—]+\s*", "-"))


def publisher_key(value: Column | str) -> Column:
    return F.lower(F.trim(text_of(value)))


def latex_text(value: Column) -> Column:
    """LaTeX accents, letters, braces and escaped ampersands as plain text."""
    x = value
    for spelled, letter in LATEX_LETTERS.items():
        x = F.replace(x, F.lit(spelled), F.lit(letter))
    for command, mark in (("'", "́"), ("`", "̀"), ('"', "̈"), ("^", "̂"), ("~", "̃")):
        x = F.regexp_replace(x, r"\{?\\" + ("\\" + command) + r"\{?([A-Za-z])\}?\}?", "$1" + mark)
    x = F.regexp_replace(x, r"\{?\\c\{([cC])\}\}?", "$1̧")
    x = F.regexp_replace(x, r"\\+&", "&")
    return F.regexp_replace(x, r"[{}]", "")


def journal_key(value: Column | str) -> Column:
    x = text_of(value)
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = squeeze(F.regexp_replace(fold(latex_text(x)), r"\p{M}+", ""))
    return F.regexp_replace(x, "^the ", "")


def venue_key(value: Column | str) -> Column:
    """A journal key without the decoration of proceedings, taken off until nothing more goes.

    Brackets at the end and a year in front go from any name. `Proceedings of`
    and `Advances in` go if the rest names a conference or a known series (or,
    after `Proceedings of`, begins with an ordinal or a year); ordinals and
    years in front go from a conference's name. A last number goes only if such
    a prefix went, and never after a volume word.
    """
    word = "(" + "|".join(ORDINALS) + ")"
    ordinal, year, number = rf"^([0-9]+(st|nd|rd|th)|{word}(-{word})?)\s+", r"^(19|20)[0-9]{2}\s+", r"[\s,]+[0-9]{1,3}$"
    proceedings, advances = r"^(proceedings|proc\.?)\s+of\s+(the\s+)?", r"^advances\s+in\s+"
    volume = r"\b(vol\.?|volume|part|pt\.?|no\.?|issue|number)[\s,]+[0-9]{1,3}$"
    without = lambda x, pattern: F.trim(F.regexp_replace(x, pattern, ""))
    known = lambda x: without(x, number).isin(*SERIES)
    series = lambda x: without(x, number).rlike(CONFERENCE) | known(x)
    state = lambda x, shown: F.struct(x.alias("x"), shown.alias("shown"))

    def step(now: Column, _: Column) -> Column:
        x, shown = now["x"], now["shown"]
        rest, other = without(x, proceedings), without(x, advances)
        instance = x.rlike(proceedings) & (rest.rlike(ordinal) | rest.rlike(year) | series(rest))
        named = shown | x.rlike(CONFERENCE) | known(x)
        return (
            F.when(instance, state(rest, F.lit(True)))
            .when(x.rlike(advances) & series(other), state(other, F.lit(True)))
            .when(named & x.rlike(ordinal), state(without(x, ordinal), shown))
            .when(named & x.rlike(year), state(without(x, year), shown))
            .otherwise(now)
        )

    plain = without(F.regexp_replace(journal_key(value), r"(\s*\([^()]*\))+\s*$", ""), year)
    steps = lambda x: F.sequence(F.lit(1), F.size(F.split(x, " ")))  # noqa: E731  # each takes a word at least
    end = lambda now: F.when(now["shown"] & ~now["x"].rlike(volume), without(now["x"], number)).otherwise(now["x"])
    return let(plain, lambda x: F.aggregate(steps(x), state(x, F.lit(False)), step, lambda now: squeeze(end(now))))


def venue_lookup_key(value: Column | str) -> Column:
    x = F.regexp_replace(F.replace(F.lower(text_of(value)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(x), "^the ", "")


def url_host(value: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.trim(text_of(value)), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_key(value: Column | str) -> Column:
    """Scheme and host in lower case, no default or impossible port, last slash or fragment; path and query as they are."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(:[^/?#]*)?([^?#]*)(\?[^#]*)?"
    x = F.trim(text_of(value))
    part = lambda i: F.regexp_extract(x, shape, i)
    scheme, port = F.lower(part(1)), F.regexp_extract(part(3), "^:0*([1-9][0-9]{0,4})$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    kept = F.when((port == "") | usual | (port.try_cast("int") > 65535), "").otherwise(F.concat(F.lit(":"), port))
    key = F.concat(scheme, F.lit("://"), F.lower(part(2)), kept, F.regexp_replace(part(4), "/+$", ""), part(5))
    return F.when(x.rlike(shape), key).otherwise(x)


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two labels."""
    labels = F.split(F.regexp_replace(host, r"\.+$", ""), r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    return F.when((F.size(labels) >= 3) & tail(2).isin(*TWO_PART_SUFFIXES), tail(3)).otherwise(tail(2))


def excluded_host(host: Column, hosts: tuple[str, ...] = EXCLUDED_HOSTS) -> Column:
    """The host of the list that this one is or lies under, else null."""
    clean = F.regexp_replace(F.translate(F.lower(host), "。．｡", "..."), r"\.+$", "")
    found = None
    for name in hosts:
        hit = (clean == name) | F.endswith(clean, F.lit("." + name))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def first_url(url: Column, published: Column) -> Column:
    """The first http(s) address of url, else of howpublished, without closing punctuation."""
    find = lambda x: F.nullif(F.regexp_extract(F.regexp_replace(text_of(x), r"\\([_%&#~])", "$1"), r"(https?://[^\s{}<>\"]+)", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(find(url), find(published)), r"[.,;:)\]]+$", "")


def abstract_hash(value: Column | str) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.replace(text_of(value), F.lit("\\"), F.lit("")), r"\s+", " ")), 256)


def containment_text(value: Column | str) -> Column:
    """What quoted spans are looked up in: folded, spaces squeezed."""
    return squeeze(F.regexp_replace(fold(latex_text(text_of(value))), r"\p{M}+", ""))


def prose_fold(value: Column | str) -> Column:
    """ASCII letters with all punctuation in place."""
    return F.regexp_replace(fold(text_of(value)), r"[^\x00-\x7F]", "")


def name_variants(surname: Column) -> Column:
    """Both lower-case spellings of a surname, without empty ones."""
    return F.array_distinct(F.filter(F.array(F.trim(fold(surname)), F.trim(transliterated(surname))), lambda x: x != ""))


def surname_comma_first(name: Column) -> Column:
    """`Last, First` has its last name before the comma; a name without comma is all surname."""
    return F.trim(F.split_part(name, F.lit(","), F.lit(1)))


def surname_last_word(name: Column) -> Column:
    """As above, but a name without comma ends with its surname."""
    return F.when(F.contains(name, F.lit(",")), surname_comma_first(name)).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def author_names(authors: Column) -> Column:
    """Names of authors given as structs of family, given and name."""
    return F.transform(authors, lambda a: F.when(a["family"].isNotNull() & a["given"].isNotNull(), F.concat_ws(", ", a["family"], a["given"])).otherwise(F.coalesce(a["family"], a["name"])))


def title_tokens(value: Column | str) -> Column:
    """Distinct words of three letters or more, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text_of(value)), r"[^a-z0-9]+", " ")), " ")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), F.array(*map(F.lit, STOPWORDS)))


def slug_title(value: Column | str) -> Column:
    """A title as a review's slug has it: no subtitle; all but ASCII letters, digits and spaces is dropped."""
    x = F.regexp_replace(F.lower(F.split_part(text_of(value), F.lit(":"), F.lit(1))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def dated_year(dates: list[tuple[str, Column]]) -> Column:
    """The first year that is not null or zero, with its basis."""
    each = [F.when(F.coalesce(year, F.lit(0)) != 0, F.struct(year.cast("int").alias("year"), F.lit(basis).alias("basis"))) for basis, year in dates]
    return F.coalesce(*each)


def entry_type(value: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in ENTRY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, value), F.lit("misc"))


def text_of_inverted_index(index: Column) -> Column:
    """Words back in their places; an empty index has no text."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "))


def printable_share(value: Column | str) -> Column:
    x = text_of(value)
    return F.when(F.length(x) == 0, 0.0).otherwise(F.length(F.regexp_replace(x, r"[^\x20-\x7E\s¡-�]", "")) / F.length(x))


def display_year(year: Column, suffix: Column) -> Column:
    return F.concat(year, F.when(suffix.rlike("^[a-z]$"), suffix).otherwise(""))


def natural_key(value: Column) -> Column:
    """Runs of digits padded, so that text order is their numeric order."""
    parts = F.regexp_extract_all(F.lower(value), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x))


def cache_key(source: str, params: Column) -> Column:
    """Source and sixteen hex digits of the parameters' JSON."""
    return F.concat(F.lit(source + "_"), F.substring(F.sha2(F.to_json(params), 256), 1, 16))


def fallback_key(title: Column, year: Column, surname: Column) -> Column:
    """Title, year and first surname as one key for works without a DOI; null if any of them is empty."""
    parts = [title_key(title), F.trim(text_of(year)), title_key(surname)]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.concat_ws("|", *parts))


def author_signature(author: Column, editor: Column) -> Column:
    """Surname and first initial of every author (else editor), `a, b and c, d` in order; empty if a surname is missing."""
    names = F.split(F.coalesce(F.nullif(F.trim(text_of(author)), F.lit("")), F.trim(text_of(editor))), r"\s+and\s+")
    first = lambda n: F.when(F.contains(n, F.lit(",")), F.split_part(n, F.lit(","), F.lit(2))).otherwise(F.regexp_replace(n, r"\s*\S+$", ""))
    each = F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.struct(title_key(surname_last_word(F.trim(n))).alias("surname"), F.substring(title_key(first(F.trim(n))), 1, 1).alias("initial")))
    return F.when(F.exists(each, lambda p: p["surname"] == ""), F.slice(each, 1, 0)).otherwise(each)


#: Fields of a record that can verify an entry's.
AUTHORITY = ("container_title", "volume", "issue", "pages", "publisher")


def supplied_fields(record: Column | None = None) -> Column:
    """Names of the AUTHORITY fields that a record (columns, or a struct) supplies; white space supplies nothing."""
    of = lambda name: F.col(name) if record is None else record[name]
    return F.array_compact(F.array(*[F.when(F.trim(text_of(of(name))) != "", name) for name in AUTHORITY]))


def completeness(record: Column | None = None) -> Column:
    return F.size(supplied_fields(record))


def cleaned_fields(keywords: Column) -> Column:
    """Fields that a cleaning marker says were removed."""
    listed = F.regexp_extract(keywords, r"METADATA\\*_CLEANED:\s*([^;]*)", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~F.contains(x, F.lit(":")))
