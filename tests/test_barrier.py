"""The barrier over several bibliographies, and a kill between any two of its writes."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import barrier, licence
from citeloom.sources import versions

GOOD = "@article{a, title = {T}, doi = {10.1/a}, keywords = {x, High}}\n\n% note\n@book{b, title = {B}}\n"
LEDGER = '{"schema_version": 1, "bib_file": "%s", "entries": {}}'


def inputs(spark, good=GOOD):
    expected = spark.createDataFrame([(f"d{i}.bib",) for i in range(4)], "bib_file string")
    texts = spark.createDataFrame([("d0.bib", 0, good), ("d1.bib", 1, good.replace("10.1/a", "10.1/other")), ("d2.bib", 2, "@misc{open, title = {"), ("else.bib", 3, good)], "bib_file string, file_ord int, content string")
    files = lambda *names: spark.createDataFrame([(n, LEDGER % n) for n in names], "bib_file string, content string")
    ledgers = {"cleaning": files("d0.bib", "d1.bib", "d2.bib", "d3.bib"), "enrichment": files("d0.bib")}
    rows = [(f"d{i}.bib", "a", (None, None, None, None, None, None, True, False, "doi", "10.1/a")) for i in range(2)]
    return expected, texts, ledgers, spark.createDataFrame(rows, f"bib_file string, key string, attestation struct<{licence.ATTESTATION.replace(' ', ':').replace(',:', ',')}>")


def add_note(entries):
    return entries.filter("key = 'b'").select("bib_file", "entry_ord", F.create_map(F.lit("note"), F.lit("seen")).alias("edits"))


def fails(entries):
    return entries.select("bib_file", "entry_ord", F.create_map(F.lit("x"), F.raise_error(F.lit("lost"))).alias("edits"))


def texts_of(spark, out):
    folder = versions.current(spark, out)
    return {} if folder is None else {r.bib_file: r.value for r in spark.read.text(f"{folder}/bib", wholetext=True).collect()}


def test_states_tiers_passes_and_report(spark, tmp_path):
    out = str(tmp_path)
    got = barrier.execute(out, *inputs(spark), {"notes": add_note, "broken": fails})
    assert (got["status"], got["degraded_inputs"], got["present"], got["passes"]["notes"]) == ("degraded", 3, 2, "ok") and got["passes"]["broken"].startswith("failed")
    back = texts_of(spark, out)
    assert back == {
        "d0.bib": GOOD.replace("{x, High}", "{x, High, EVIDENCE-EXISTENCE}").replace("{b,", "{b,\n  note = {seen},\n  keywords = {EVIDENCE-NONE},"),
        "d1.bib": GOOD.replace("10.1/a", "10.1/other").replace("{x, High}", "{x, High, EVIDENCE-NONE}").replace("{b,", "{b,\n  note = {seen},\n  keywords = {EVIDENCE-NONE},"),
    }
    path = next((tmp_path / "reports").iterdir())
    rows = {(r.subject, r.name, r.measure): r.n for r in spark.read.json(f"{path}/part-*").collect()}
    assert rows["tier", "d0.bib", "EXISTENCE"] == 1 and rows["tier", "d0.bib", "ALL"] == 2 and rows["tier", "d1.bib", "NONE"] == 2
    assert ("input bib", "d2.bib", "malformed") in rows and ("input bib", "d3.bib", "missing") in rows and ("input enrichment", "d1.bib", "missing") in rows
    assert json.loads((path / "_summary.json").read_text())["status"] == "degraded"


def test_nothing_present_is_a_failed_run(spark, tmp_path):
    expected, texts, ledgers, vouched = inputs(spark)
    got = barrier.execute(str(tmp_path), expected, texts.filter("bib_file = 'd2.bib'"), ledgers, vouched)
    assert got["status"] == "failed" and versions.current(spark, str(tmp_path)) is None and len(list((tmp_path / "reports").iterdir())) == 1


def test_a_kill_between_any_two_writes_leaves_all_or_nothing(spark, tmp_path, monkeypatch):
    out, real, steps = str(tmp_path), versions._step, []
    barrier.execute(out, *inputs(spark))
    old = texts_of(spark, out)
    planned = barrier.plan(*inputs(spark, GOOD.replace("{T}", "{New}")))
    monkeypatch.setattr(versions, "_step", lambda name, write: (steps.append(name), real(name, write)))
    barrier.publish(f"{out}/dry", *planned)
    new = texts_of(spark, f"{out}/dry")
    assert steps == ["report", "bib", "manifest", "pointer"] and new != old and set(new) == set(old)
    for at, last in enumerate(list(steps)):
        for after in (False, True):  # dies before, or right after that write
            seen = []

            def killed(name, write, at=at, after=after, seen=seen):
                seen.append(name)
                if len(seen) <= at or after:
                    write()
                if len(seen) == at + 1:
                    raise SystemExit("killed")

            monkeypatch.setattr(versions, "_step", killed)
            with pytest.raises(SystemExit):
                barrier.publish(out, *planned)
            assert seen[-1] == last and texts_of(spark, out) == (new if (last, after) == ("pointer", True) else old)
