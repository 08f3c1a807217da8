"""The licence index against comparing every window with every template."""

import random
from collections import Counter

from pyspark.sql import functions as F

from voltaloom.llm import licenses

FILLER = [f"w{i}" for i in range(50)] + "the of and in to is this work source code public version under".split()


def brute(m, text):
    lines, best, covered = (text or "").split("\n"), (0.0, None), set()
    whole = Counter(licenses._terms(text or ""))
    for name in sorted(licenses.FILES):
        t = m.vector(Counter(licenses._terms(licenses.FILES[name])))
        v = m.vector(whole)
        if sum(x * t.get(w, 0) for w, x in v.items()) >= licenses.FILE_COSINE:
            return name, True
    for lo in range(len(lines)):
        for hi in range(lo + 1, min(len(lines), lo + licenses.LINES) + 1):
            v = m.vector(Counter(licenses._terms("\n".join(lines[lo:hi]))))
            for name in sorted(licenses.TEMPLATES):
                t = m.vector(Counter(licenses._terms(licenses.TEMPLATES[name])))
                c = sum(x * t.get(w, 0) for w, x in v.items())
                if c >= licenses.COSINE:
                    covered.update(range(lo, hi))
                    if c > best[0] + 1e-12:
                        best = (c, name)
    size = [len(licenses._terms(x)) for x in lines]
    return best[1], bool(covered) and sum(size[k] for k in covered) >= licenses.FILE_SHARE * sum(size)


def texts():
    rng = random.Random(2)
    notices = [*licenses.TEMPLATES.values(), "Under CC BY-NC 4.0", "subject to the terms of the Mozilla Public, v. 2.0", "Under the GNU General Public, version 3"]
    for k in range(250):
        lines = [" ".join(rng.choice(FILLER) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.7:
            words = rng.choice(notices).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(FILLER)
            cut = rng.randint(0, len(words))
            lines.insert(rng.randint(0, len(lines)), " ".join(words[:cut]) + rng.choice(["\n", " "]) + " ".join(words[cut:]))
        if rng.random() < 0.1:
            lines = [f"Copyright (c) 20{k % 90 + 10} someone", rng.choice(list(licenses.FILES.values())).replace(". ", ".\n")]
        yield "\n".join(lines)


def test_index_loses_nothing():
    some = list(texts())
    for df, n in (({}, 0), ({"the": 900, "public": 40, "version": 300, "license": 9}, 1000)):
        m = licenses.Matcher(df, n)
        got = [(a, c) for a, _, c in map(m.scan, some)]
        assert got == [brute(m, t) for t in some]
        assert sum(a is not None for a, _ in got) > 80


def test_whole_table_against_brute_force_with_clashing_columns(spark):
    rows = [(k, t, f"/r{k % 3}/d{k % 7}/f{k}") for k, t in enumerate(texts())] + [(900, None, "/r0/x"), (901, "", None), (None, "All rights reserved", "/z/f"), (902, "x", "/z/q/y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumn("license", F.lit("clash")).withColumn("dir", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    words = Counter(w for _, t, _ in rows for w in licenses._VOCABULARY.intersection(licenses._terms(t or "")))
    m, votes = licenses.Matcher(words, len(rows)), {}
    own = {k: brute(m, t) for k, t, _ in rows}
    for k, _, p in rows:
        if own[k][1]:
            votes.setdefault(p.rsplit("/", 1)[0] if p else None, Counter())[own[k][0]] += 1
    for k, _, p in rows:
        want = own[k][0]
        up = p.rsplit("/", 1)[0] if p else ""
        while want is None and up:
            if up in votes:
                want = min(votes[up].items(), key=lambda v: (-v[1], v[0]))[0]
            up = up.rsplit("/", 1)[0]
        assert got[k].license == want, k
    assert got[902].license == "Proprietary" and got[902].how == "inherited" and got[901].license is None


def test_hot_directory_and_root_above_many(spark):
    grant = next(iter(licenses.FILES.values()))
    rows = [(k, "plain words", "/r/hot/f" if k % 3 == 0 else f"/r/d{k}/f") for k in range(3600)] + [(4000, grant, "/r/LICENSE"), (4001, "plain words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = licenses.scan_licenses(docs, F.col("path")).groupBy("how", "from_dir").count().collect()
    assert {(r.how, r.from_dir): r["count"] for r in got} == {("inherited", "/r"): 3600, ("file", None): 1, ("none", None): 1}
