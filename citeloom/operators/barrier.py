"""One step over many bibliographies: state of every input, tiers, edits, report, commit.

The plan changes no file. Inputs that lack or cannot be read degrade the run and
are counted; a bibliography that cannot be read stays out of the outputs, so
that it is never made worse. Optional passes may fail: the report says so and
the others go on. The commit writes the report first, then a new version of all
texts, and moves the pointer last.

Defined results: no bibliography present at all is a failed run, which writes
its report only; an entry without attestation has the tier NONE; of edits of
one field by several passes the last one holds, and the tier is stamped after
all of them; equal keys within a file share their attestation.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators import licence
from citeloom.operators.prose import without_tiers
from citeloom.session import written
from citeloom.sources import bibtex, envelopes, versions

EDITS = "bib_file string, entry_ord int, edits map<string,string>"
Pass = Callable[[DataFrame], DataFrame]


def input_states(expected: DataFrame, entries: DataFrame, texts: DataFrame, ledgers: dict[str, DataFrame]) -> DataFrame:
    """bib_file with bib (present, malformed or missing), a state for each kind of ledger (also without_ledger), and degraded.

    expected: bib_file of all domains. entries: of bibtex.parse; ledgers: bib_file, content of each kind.
    """
    broken = entries.filter("error IS NOT NULL").select("bib_file").distinct().withColumn("__bad", F.lit(True))
    there = texts.filter("content IS NOT NULL").select("bib_file").distinct().withColumn("__there", F.lit(True))
    out = expected.select("bib_file").distinct().join(there, "bib_file", "left").join(broken, "bib_file", "left")
    out = out.withColumn("bib", F.when(F.col("__there").isNull(), "missing").when(F.col("__bad"), "malformed").otherwise("present")).drop("__there", "__bad")
    for kind, files in ledgers.items():
        out = out.join(envelopes.ledger_state(files, expected).select("bib_file", F.col("state").alias(kind)), "bib_file", "left")
        out = out.withColumn(kind, F.coalesce(kind, F.lit("missing")))
    bad = F.lit(False)
    for c in ("bib", *ledgers):
        bad = bad | (F.col(c) != "present")
    return out.withColumn("degraded", bad)


def stamped_keywords(keywords: Column, tier: Column) -> Column:
    """Keywords with one evidence token: after topics and importance, before a cleaning marker."""
    marker = F.regexp_extract(keywords, r"(METADATA\\*_CLEANED:.*)$", 1)
    plain = without_tiers(F.trim(F.regexp_replace(keywords, r",?\s*METADATA\\*_CLEANED:.*$", "")))
    return F.concat_ws(", ", F.nullif(plain, F.lit("")), F.concat(F.lit("EVIDENCE-"), tier), F.nullif(marker, F.lit("")))


def run_passes(entries: DataFrame, passes: dict[str, Pass]) -> tuple[DataFrame | None, dict[str, str]]:
    """Edits of all passes that worked (bib_file, entry_ord, edits), the later over the earlier; and how each fared."""
    done, fared = [], {}
    for i, (name, run) in enumerate(passes.items()):
        try:
            own = run(entries).select("bib_file", "entry_ord", "edits")
            done.append(written(own, f"pass-{name}").withColumn("__i", F.lit(i)))
            fared[name] = "ok"
        except Exception as error:  # an optional pass that fails costs its own edits only; the report names it
            fared[name] = f"failed: {str(error).splitlines()[0][:200] if str(error) else type(error).__name__}"
    if not done:
        return None, fared
    each = done[0]
    for more in done[1:]:
        each = each.unionByName(more)
    named = each.select("bib_file", "entry_ord", "__i", F.explode("edits").alias("field", "value"))
    last = named.groupBy("bib_file", "entry_ord", "field").agg(F.max_by(F.struct("value"), "__i").alias("v"))
    listed = last.groupBy("bib_file", "entry_ord").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("v.value").alias("value")))).alias("edits"))  # as long as an entry has fields
    return listed, fared


def plan(expected: DataFrame, texts: DataFrame, ledgers: dict[str, DataFrame], attestations: DataFrame, passes: dict[str, Pass] | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Chunks of all bibliographies that can be read, edited and stamped; the states of inputs; how the passes fared.

    attestations: bib_file, key, attestation (as licence has it).
    """
    entries = written(bibtex.parse(texts.join(expected.select("bib_file").distinct(), "bib_file", "left_semi")), "entries")
    states = written(input_states(expected, entries, texts, ledgers), "states")
    sound = entries.join(states.filter("bib = 'present'").select("bib_file"), "bib_file", "left_semi")
    edits, fared = run_passes(sound.filter("key IS NOT NULL"), passes or {})
    none = F.create_map().cast("map<string,string>")
    chunks = sound.join(edits, ["bib_file", "entry_ord"], "left") if edits is not None else sound.withColumn("edits", F.lit(None).cast("map<string,string>"))
    chunks = chunks.withColumn("edits", F.coalesce("edits", none))
    after = F.map_concat(F.map_filter(F.coalesce("fields", none), lambda k, v: ~F.map_contains_key("edits", k)), F.map_filter("edits", lambda k, v: v.isNotNull()))
    known = attestations.groupBy("bib_file", "key").agg(F.any_value("attestation").alias("attestation"))
    keyed = chunks.filter("key IS NOT NULL").select("bib_file", "entry_ord", "key", "entry_type", after.alias("fields"))
    tiers = licence.stamped(keyed, known, ["bib_file", "key"]).select("bib_file", "entry_ord", "tier", licence.field(F.col("fields"), "keywords").alias("__words"))
    chunks = chunks.join(tiers, ["bib_file", "entry_ord"], "left")
    words = stamped_keywords(F.col("__words"), F.col("tier"))
    stamped = F.map_concat(F.map_filter("edits", lambda k, v: k != "keywords"), F.create_map(F.lit("keywords"), words))
    chunks = chunks.withColumn("edits", F.when(F.col("tier").isNotNull(), stamped).otherwise(none)).withColumn("new_type", F.lit(None).cast("string")).drop("__words")
    return written(bibtex.spliced(chunks), "plan"), states, fared


def report(done: DataFrame, states: DataFrame, fared: dict[str, str]) -> DataFrame:
    """subject, name, measure, n: entries by bibliography and tier (tier null: all), edits refused, states of inputs, passes."""
    tiers = done.filter("tier IS NOT NULL")
    n = F.count(F.lit(1)).alias("n")
    rows = tiers.rollup("bib_file", "tier").agg(n).filter("bib_file IS NOT NULL").select(F.lit("tier").alias("subject"), F.col("bib_file").alias("name"), F.coalesce("tier", F.lit("ALL")).alias("measure"), "n")
    refused = done.filter("refusal IS NOT NULL AND key IS NOT NULL").groupBy("bib_file", "refusal").agg(n).select(F.lit("refused").alias("subject"), F.col("bib_file").alias("name"), F.col("refusal").alias("measure"), "n")
    kinds = [c for c in states.columns if c not in ("bib_file", "degraded")]
    each = states.select("bib_file", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("state")) for k in kinds])).alias("s"))
    inputs = each.select(F.concat(F.lit("input "), "s.kind").alias("subject"), F.col("bib_file").alias("name"), F.col("s.state").alias("measure"), F.lit(1).cast("long").alias("n"))
    passed = done.sparkSession.createDataFrame([("pass", name, how, 1) for name, how in fared.items()], "subject string, name string, measure string, n long")
    return rows.unionByName(refused).unionByName(inputs).unionByName(passed)


def publish(out: str, done: DataFrame, states: DataFrame, fared: dict[str, str]) -> dict:
    """Writes what plan gave: the report, and if any bibliography is present a new version of the texts.

    out/reports/<version>: the report as JSON rows, and its summary;
    out/versions/<version>/bib: all texts; out/CURRENT: the version that holds.
    Gives status (complete, degraded or failed), the numbers of degraded and
    present inputs, and the version's folder.
    """
    spark = done.sparkSession
    count = states.agg(F.count_if("degraded").alias("degraded"), F.count_if(F.col("bib") == "present").alias("present")).first()
    bad = count["degraded"] > 0 or any(how != "ok" for how in fared.values())
    status = "failed" if not count["present"] else "degraded" if bad else "complete"
    summary = {"schema_version": 1, "status": status, "degraded_inputs": count["degraded"], "present": count["present"], "passes": fared}

    def told(path: str) -> None:
        report(done, states, fared).write.json(path)
        versions.put(spark, f"{path}/_summary.json", json.dumps(summary))

    if status == "failed":
        told(f"{out.rstrip('/')}/reports/{uuid.uuid4().hex}")
        return summary | {"folder": None}
    return summary | {"folder": versions.commit(spark, out, told, {"bib": lambda path: bibtex.write_texts(bibtex.to_text(done), path)})}


def execute(out: str, expected: DataFrame, texts: DataFrame, ledgers: dict[str, DataFrame], attestations: DataFrame, passes: dict[str, Pass] | None = None) -> dict:
    """Plans, reports and commits."""
    return publish(out, *plan(expected, texts, ledgers, attestations, passes))
