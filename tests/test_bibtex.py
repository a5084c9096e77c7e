"""The scanner of entries, edits in place, and files that come back byte for byte."""

import random
import time

import pytest
from pyspark.sql import functions as F

from citeloom.sources import bibtex


def plain_value(text, at):
    """A braced or quoted value by recursion over its groups: (inner text, end)."""
    if text[at] == "{":
        begin = at = at + 1
        while text[at] != "}":
            at = plain_value(text, at)[1] if text[at] == "{" else at + 1
        return text[begin:at], at + 1
    begin = at = at + 1
    while text[at] != '"':
        at = plain_value(text, at)[1] if text[at] == "{" else at + 1
    return text[begin:at], at + 1


def made(rng, depth=0):
    parts = []
    for _ in range(rng.randint(0, 4)):
        parts.append(rng.choice(["a", " b", ",", "=", "@", "#", "\\'e", "(", ")", "x = ", "%", "é\n"]))
        if depth < 6 and rng.random() < 0.4:
            parts.append("{" + made(rng, depth + 1) + ("" if depth == 0 else rng.choice(["", '"'])) + "}")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(5))
def test_values_against_a_recursive_parser(seed):
    rng = random.Random(seed)
    for _ in range(200):
        names = [f"f{i}" for i in range(rng.randint(1, 5))]
        raw, expected, (opener, closer) = "@article", [], rng.choice(["{}", "()"])
        raw += opener + "key,"
        for name in names:
            value = made(rng)
            quoted = rng.random() < 0.4
            text = f'"{value}"' if quoted else "{" + value + "}"
            expected.append((name, plain_value(text, 0)[0].strip()))
            raw += rng.choice(["\n  ", " ", ""]) + name.upper() + rng.choice([" = ", "="]) + text + rng.choice([",", " ,"])
        raw += "\n" + closer + "\ntail"
        e = bibtex.scan(raw)
        assert (e.kind, e.key, e.error) == ("article", "key", None), raw
        assert [(p.name, p.value) for p in e.places] == expected, raw
        edits = {rng.choice([*names, "new"]): rng.choice([None, "v {w} \\1"]) for _ in range(2)}
        out, wrong = bibtex.splice(raw, edits, rng.choice([None, "misc"]))
        assert wrong is None
        again = bibtex.scan(out)
        assert [(p.name, p.value) for p in again.places if p.name not in edits] == [x for x in expected if x[0] not in edits]
        assert {k: v for k, v in edits.items() if v is not None} == {p.name: p.value for p in again.places if p.name in edits}
        assert out.endswith("\n" + closer + "\ntail")


def test_macros_joins_and_errors():
    text = '@string{pub = "MIT " # {Press}}\n@book{a, publisher = pub # " Books", month = jan, year = 2001, x = nope}\n@misc{open, title = {never {closed}\n@misc{b, title = "t {"} u", nonsense, year = 1}\n@misc{nokey}\n'
    macros, got = dict(bibtex.MONTHS), []
    for raw in bibtex.chunks(text):
        e = bibtex.scan(raw, macros)
        bibtex._macro(raw, macros)
        got.append((e.key, {p.name: p.value for p in e.places}, e.error))
    assert got[1] == ("a", {"publisher": "MIT Press Books", "month": "January", "year": "2001", "x": "nope"}, "unknown macro nope in x")
    assert got[2][0] == "open" and got[2][2] == "unclosed value in title"
    assert got[3] == ("b", {"title": 't {"} u', "year": "1"}, "field expected")
    assert got[4] == (None, {}, "key expected") and "".join(bibtex.chunks(text)) == text


def test_persons():
    say = lambda n: tuple(bibtex.person(n)[k] for k in ("given", "von", "family", "jr"))
    assert say("Ludwig van Beethoven") == ("Ludwig", "van", "Beethoven", None)
    assert say("de la Fontaine, Jean") == ("Jean", "de la", "Fontaine", None)
    assert say("King, Jr., Martin Luther") == ("Martin Luther", None, "King", "Jr.")
    assert say("{The Royal Society}") == (None, None, "The Royal Society", None)
    assert say("Plato") == (None, None, "Plato", None)
    assert say("Simone de Beauvoir") == ("Simone", "de", "Beauvoir", None)
    assert say("{\\'E}tienne Gilson") == ("{\\'E}tienne", None, "Gilson", None)
    assert say("Charles {van der} Berg") == ("Charles {van der}", None, "Berg", None)
    assert say("") == (None, None, "", None)


def test_time_is_in_proportion():
    seconds = []
    for size in (250_000, 1_000_000):
        bodies = ["x" * size, "{" * 5 + "deep " * (size // 5) + "}" * 5, "{a}" * (size // 3), "word" * (size // 4) + "="]
        raw = "@article{k,\n" + "".join(f"  f{i} = {{{b}}},\n" for i, b in enumerate(bodies)) + "junk" * (size // 4) + ",\n year = 1}"
        began = time.perf_counter()
        e = bibtex.scan(raw)
        seconds.append(time.perf_counter() - began)
        assert [p.value for p in e.places] == [*bodies, "1"]
    assert seconds[1] < 8 * seconds[0] + 0.2


def test_edits_touch_nothing_else():
    raw = '@Article{k,\n    title = {A {B {C}} d},\n\tnote="q" ,\n    abstract = {x}\n}\n\n% remark\n'
    assert bibtex.splice(raw, {}) == (raw, None)
    assert bibtex.splice(raw, {"note": "n"}) == (raw.replace('"q"', "{n}"), None)
    assert bibtex.splice(raw, {"note": None}) == (raw.replace('\n\tnote="q" ,', ""), None)
    assert bibtex.splice(raw, {"doi": "10.1/x"}) == (raw.replace("{k,", "{k,\n    doi = {10.1/x},"), None)
    assert bibtex.splice(raw, {}, "misc") == (raw.replace("Article", "misc"), None)
    assert bibtex.splice(raw, {"doi": "}{"}) == (raw, "unbalanced value")
    assert bibtex.splice("@comment{x}", {"doi": "1"}) == ("@comment{x}", "no entry")
    twice = "@misc{k, note = {a}, note = {b}}"
    assert bibtex.splice(twice, {"note": "c"})[0] == "@misc{k, note = {c}, note = {c}}"


def test_files_of_several_lines_folders_and_spaces(spark, tmp_path):
    one = "﻿@comment{c}\n\n@article{a,\n  title = {One},\n  year = 2001,\n}\n\n\n@book{b, title = {Two}}"
    for folder, name, text in (("x", "same.bib", one), ("y", "same.bib", one + "\n"), ("x", "a space+%20.bib", one)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    paths = [f"{tmp_path}/y/same.bib", f"file://{tmp_path}/x/same.bib", f"{tmp_path}/x/a space+%20.bib", f"{tmp_path}/y/same.bib"]
    texts = bibtex.read_texts(spark, paths)
    assert [(r.bib_file, r.file_ord, r.content) for r in texts.orderBy("file_ord").collect()] == [(paths[0], 0, one + "\n"), (f"{tmp_path}/x/same.bib", 1, one), (paths[2], 2, one)]
    entries = bibtex.parse(texts)
    assert {(r.key, len(r.fields)) for r in entries.filter("key IS NOT NULL").collect()} == {("a", 2), ("b", 1)} and entries.count() == 9
    bibtex.write_texts(bibtex.to_text(entries), f"{tmp_path}/out")
    back = {r.bib_file: r.value for r in spark.read.option("recursiveFileLookup", False).text(f"{tmp_path}/out", wholetext=True).collect()}
    assert back == {r.bib_file: r.content for r in texts.collect()}
    folder = bibtex.read_texts(spark, [f"{tmp_path}/y", f"{tmp_path}/x/same.bib"])
    assert sorted((r.file_ord, r.bib_file) for r in folder.collect()) == [(1, f"{tmp_path}/x/same.bib"), (2, f"{tmp_path}/y/same.bib")]


def test_edits_of_many_entries_and_violations(spark):
    bib = "@article{a, title = {T}, title = {U}, year = 1}\n@article{a, author = {A}, title = {T}, journal = {J}, year = 1}\n"
    texts = spark.createDataFrame([("x", 0, bib), ("y", 1, bib + "@misc{open, title = {"), ("z", 2, None), ("e", 3, "")], "bib_file string, file_ord int, content string")
    entries = bibtex.parse(texts)
    edits = entries.withColumn("edits", F.when(F.col("key") == "a", F.create_map(F.lit("year"), F.lit("2"), F.lit("title"), F.lit(None).cast("string")))).withColumn("new_type", F.lit(None).cast("string"))
    done = bibtex.spliced(edits)
    out = {r.bib_file: r.content for r in bibtex.to_text(done).collect()}
    assert out["x"] == "@article{a, year = {2}}\n@article{a, author = {A}, journal = {J}, year = {2}}\n"
    assert out["y"] == out["x"] + "@misc{open, title = {"
    found = {(r.bib_file, r.step, r.key, r.line, r.detail) for r in bibtex.violations(texts).collect()}
    assert ("x", 2, "a", 2, "first on line 1") in found and ("x", 3, "a", 1, "title x2") in found and ("x", 4, "a", None, "journal") in found
    assert ("y", 1, "open", 3, "unclosed value in title") in found and not any(f == "y" and s > 3 for f, s, *_ in found)


def counting(df, seen):
    """df, whose rows are counted as often as they are made."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_texts_are_made_once_to_be_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([("a", "one\ntwo\n"), ("b", "\n"), ("c", "")], "bib_file string, content string")
    bibtex.write_texts(counting(texts, seen), f"{tmp_path}/lines")
    assert seen.value == 3
    back = lambda path: {r.bib_file: r.value for r in spark.read.text(path, wholetext=True).collect()}
    assert back(f"{tmp_path}/lines") == {"a": "one\ntwo\n", "b": "\n"}
    other = spark.createDataFrame([("a", "one\n"), ("b", "two}"), ("d", "é")], "bib_file string, content string")
    bibtex.write_texts(other, f"{tmp_path}/mixed")
    assert back(f"{tmp_path}/mixed") == {"a": "one\n", "b": "two}", "d": "é"}
    bibtex.write_texts(texts.limit(0), f"{tmp_path}/none")
    assert bibtex.parse(bibtex.read_texts(spark, [f"{tmp_path}/lines"])).count() == 2


def test_texts_are_not_dealt_to_be_read(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@misc{a, x = {1}}\n")
    plan = bibtex.read_texts(spark, [f"{tmp_path}/a.bib"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_rows_leave_python_in_slices(spark, monkeypatch):
    texts = spark.createDataFrame([(f"f{i}", 0, "".join(f"@misc{{k{j}, n = {{{i}}}}}\n" for j in range(i))) for i in range(6)], "bib_file string, file_ord int, content string").coalesce(1)
    whole = sorted(map(str, bibtex.parse(texts).collect()))
    edits = F.when(F.col("entry_ord") % 2 == 0, F.create_map(F.lit("n"), F.concat("bib_file", F.lit("-"), "entry_ord")))
    asked = bibtex.parse(texts).select("bib_file", "entry_ord", "raw", edits.alias("edits"), F.lit(None).cast("string").alias("new_type"))
    done = sorted(map(str, bibtex.spliced(asked).collect()))
    monkeypatch.setattr(bibtex, "SLICE", 20)
    assert sorted(map(str, bibtex.parse(texts).collect())) == whole and sorted(map(str, bibtex.spliced(asked).collect())) == done
    left = spark.createDataFrame([("no entry", None, None)], "raw string, edits map<string,string>, new_type string")
    assert [(r.raw, r.refusal) for r in bibtex.spliced(left).collect()] == [("no entry", None)]
