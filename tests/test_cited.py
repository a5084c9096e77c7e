"""Cited entries merge under a total order: a plain version, and any order of rows."""

import random

from citeloom.operators import dedupe


def slow(rows):
    groups = {}
    by_work = {}
    for _, doi, work, _ in rows:
        if work:
            by_work.setdefault(work, set()).update({doi} if doi else set())
    for key, doi, work, fields in rows:
        sole = next(iter(by_work[work])) if work and len(by_work[work]) == 1 else None
        g = ("d", doi or sole) if doi or sole else ("w", work) if work else ("k", key)
        groups.setdefault(g, []).append((key, fields))
    out = []
    for own in groups.values():
        full = lambda f: sum(bool((f.get(k) or "").strip()) for k in dedupe.SUBSTANCE)
        own.sort(key=lambda e: (-full(e[1]), e[0]))
        gone = lambda f: [x.strip() for x in (f.get("keywords", "").split("METADATA_CLEANED:") + [""])[1].split(",") if x.strip() and ":" not in x]
        key, first = own[0]
        verdicts = {x for _, f in own[1:] for x in gone(f)}
        blocked = verdicts | set(gone(first))
        merged = {k: v for k, v in first.items() if k not in verdicts and k != "keywords"}
        for k in (*dedupe.SUBSTANCE, "year_suffix"):
            if not (first.get(k) or "").strip() and k not in blocked:
                for _, f in own[1:]:
                    if (f.get(k) or "").strip():
                        merged[k] = f[k]
                        break
        words = first.get("keywords", "")
        news = ", ".join(sorted(verdicts - set(gone(first))))
        if news:
            words = f"{words}, {news}" if "METADATA_CLEANED" in words else f"{words}, METADATA_CLEANED: {news}" if words else f"METADATA_CLEANED: {news}"
        if words:
            merged["keywords"] = words
        letters = {f["year_suffix"] for _, f in own if f.get("year_suffix", "").strip()}
        out.append((key, tuple(sorted(merged.items())), len(own), len(letters) > 1, tuple(sorted(k for k, _ in own))))
    return sorted(out)


def test_any_order_gives_the_same_survivors(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        fields = {k: f"{k}{i}" for k in rng.sample(["journal", "pages", "doi", "abstract", "note", "volume"], rng.randint(0, 4))}
        if rng.random() < 0.3:
            fields["pages"] = " "
        if rng.random() < 0.3:
            fields["year_suffix"] = rng.choice("ab")
        if rng.random() < 0.5:
            fields["keywords"] = rng.choice(["High", "x, METADATA_CLEANED: pages", "METADATA_CLEANED: journal, year:2001->2002"])
        rows.append((f"k{i:03}", rng.choice([None, "", "10.1/a", "10.1/b", "10.1/c"]), rng.choice([None, "", *(f"w{j}" for j in range(12))]), fields))
    rows += [("solo", None, None, {}), ("zz", "10.1/q", "wq", {"doi": "10.1/q"}), ("yy", None, "wq", {"abstract": "A"})]
    expected = slow(rows)
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        survivors, redirects = dedupe.cited_merge(spark.createDataFrame(rows, "key string, doi string, work string, fields map<string,string>").repartition(3 + seed))
        members = {}
        for r in redirects.collect():
            members.setdefault(r.survivor, []).append(r.key)
        assert sorted((r.key, tuple(sorted(r.fields.items())), r.members, r.suffix_conflict, tuple(sorted(members[r.key]))) for r in survivors.collect()) == expected
    empty = spark.createDataFrame([], "key string, doi string, work string, fields map<string,string>")
    assert [df.count() for df in dedupe.cited_merge(empty)] == [0, 0]
