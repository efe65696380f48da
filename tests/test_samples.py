import random

from pyspark.sql import functions as F
from rankloom.operators.samples import fair_sample, stratified, with_first


def test_first_values_without_gathering_a_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), f"u{rng.randrange(300):03d}") for _ in range(2000)] + [("z", 0, None)]
    df = spark.createDataFrame(rows, "rule string, kind int, url string")
    out = with_first(df.groupBy("rule", "kind").count(), df, ["rule", "kind"], "url", 10, "samples")
    got = {(r["rule"], r["kind"]): (r["count"], r["samples"]) for r in out.collect()}
    want = {k: [u for *g, u in rows if tuple(g) == k] for k in {r[:2] for r in rows}}
    assert got == {k: (len(v), sorted({u for u in v if u})[:10]) for k, v in want.items()}
    assert "collect_set" not in out._jdf.queryExecution().toString()


def test_stratified_samples(spark):
    rows = [("one", 1), ("two", 1), ("two", 2), *(("seven", i) for i in range(7)), *(("hot", i) for i in range(3000)), *((None, i) for i in range(3))]
    table = spark.createDataFrame(rows, "g string, v int").repartition(5)
    for k in (1, 2, 3, 5, 20):
        got = {}
        for r in stratified(table, ["g"], [F.desc("v")], k).collect():
            got.setdefault(r.g, []).append((r.pick, r.v, r.kind))
        for g in {g for g, _ in rows}:
            order = sorted((v for h, v in rows if h == g), reverse=True)
            want = []
            for i, kind in [(0, "best"), (len(order) - 1, "worst"), ((len(order) - 1) // 2, "median"), *((i, "fill") for i in range(len(order)))]:
                if order[i] not in [v for v, _ in want] and len(want) < k:
                    want.append((order[i], kind))
            assert sorted(got[g]) == [(n + 1, v, kind) for n, (v, kind) in enumerate(want)], (g, k)


def fnv(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return h, text


def test_fair_samples(spark):
    rng = random.Random(3)
    links = [(f"s{rng.randrange(12)}", f"u{min(rng.randrange(40), rng.randrange(40))}") for _ in range(150)] + [("s0", None), (None, "u")]
    by_source = {s: sorted({u for t, u in links if t == s and u}, key=fnv) for s in {s for s, _ in links if s}}
    for limit in (0, 1, 5, 25, 100):
        taken = []
        while len(taken) < limit:
            before = len(taken)
            for s in sorted(by_source, key=fnv):
                new = next((u for u in by_source[s] if u not in taken), None)
                if new and len(taken) < limit:
                    taken.append(new)
            if len(taken) == before:
                break
        got = fair_sample(spark.createDataFrame(links, "source string, url string"), limit).orderBy("pick").collect()
        assert [r.url for r in got] == taken


def test_prompts_meet_the_first_postings(spark, monkeypatch):
    from rankloom.plans import match_reports

    monkeypatch.setattr(match_reports, "MOST_POSTINGS", 3)
    rng = random.Random(5)
    rows = [(i, at, t) for i in range(40) for at, t in enumerate(rng.sample("abcdefg", 3))]
    prompts = [(100 + i, at, t) for i in range(5) for at, t in enumerate(rng.sample("abcdefg", 4))]
    kind = "id long, at int, term string"
    for most in (5, 12, 1000):
        index, n = {}, 0
        for i, _, t in rows:
            if len(index.setdefault(t, [])) < 3 and n < most:
                index[t].append(i)
                n += 1
        want = []
        for p in {p for p, _, _ in prompts}:
            shared = {}
            for q, _, t in prompts:
                for i in index.get(t, []) if q == p else []:
                    shared[i] = shared.get(i, 0) + 1
            want += [(p, i, s) for i, s in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:3]]
        got = match_reports.matched_prompts(spark.createDataFrame(prompts, kind), spark.createDataFrame(rows, kind), most)
        assert sorted(tuple(r) for r in got.select("id", "match", "shared").collect()) == sorted(want)


def test_prompts_of_the_same_terms_are_matched_once(spark):
    """Ten thousand prompts of three kinds and a hundred rows of each term: no join puts out a pair for each prompt and row."""
    from rankloom.plans import match_reports

    kinds = F.array(*[F.array(*map(F.lit, terms)) for terms in (["a", "b"], ["b", "c"], ["c"])])
    table = lambda df: df.select("id", F.posexplode(F.element_at(kinds, (F.col("id") % 3 + 1).cast("int"))).alias("at", "term"))
    got = match_reports.matched_prompts(table(spark.range(100_000, 110_000)), table(spark.range(600)), 50_000)
    rows = got.collect()
    want = {0: {(0, 2), (3, 2), (6, 2)}, 1: {(1, 2), (4, 2), (7, 2)}, 2: {(1, 1), (2, 1), (4, 1)}}
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, set()).add((r.match, r.shared))
    assert len(rows) == 30_000 and all(by_id[i] == want[i % 3] for i in range(100_000, 110_000))
    made, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [])
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
    assert made and max(made) <= 30_000


def test_prompts_meet_all_rows(spark, monkeypatch):
    """No list of a term and no number of rows is cut; long queries and repeated terms count as the SQL has them."""
    from rankloom.plans import match_reports

    monkeypatch.setattr(match_reports, "FEW_TERMS", 4)
    rng = random.Random(8)
    terms = lambda: rng.choices("abcdefgh", k=5) if rng.random() < 0.1 else rng.sample("abcdefgh", rng.choice([1, 2, 3, 4, 6]))
    rows = [(i, at, "all") for i in range(400, 900) for at in (9,)] + [(i, at, t) for i in range(900) for at, t in enumerate(terms())]
    prompts = [(1000 + i, at, t) for i in range(60) for at, t in enumerate(["all", *terms()] if i % 3 else terms())]
    of, want = {}, []
    for i, _, t in rows:
        of.setdefault(i, []).append(t)
    for p in {p for p, _, _ in prompts}:
        asked = [t for q, _, t in prompts if q == p]
        shared = {i: n for i, ts in of.items() if (n := sum(ts.count(t) for t in asked))}
        want += [(p, i, n) for i, n in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:3]]
    kind = "id long, at int, term string"
    got = match_reports.matched_prompts(spark.createDataFrame(prompts, kind), spark.createDataFrame(rows, kind))
    assert sorted(tuple(r) for r in got.select("id", "match", "shared").collect()) == sorted(want)
    assert max(i for _, i, _ in want) >= 400  # behind the first hundred rows of every term
