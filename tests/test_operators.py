"""Operators against plain loops: two-hop patterns, merged edges, containment by substrings, the quota of a selection."""

import random

import pytest

from weftgraph.operators import corpus, edges, linking, paths

EDGES = "head string, relation string, tail string"


def graph(seed):
    r = random.Random(seed)
    rows = {(f"c{r.randint(0, 25)}", "PARTICIPATED_IN", f"p{r.randint(0, 8)}") for _ in range(70)} | {(f"c{r.randint(0, 25)}", "FOUNDED", f"{r.choice('sc')}{r.randint(0, 9)}") for _ in range(40)}
    return sorted(rows)


def patterns(rows):
    part = {(h, t) for h, r, t in rows if r == "PARTICIPATED_IN"}
    founded = {(h, t) for h, r, t in rows if r == "FOUNDED"}
    return {(a, e, b, o) for a, e in part for b, f in part for c, o in founded if e == f and b == c and a != b and o not in (a, e)}


@pytest.mark.parametrize("seed", [1, 2])
def test_two_hop_patterns(spark, seed):
    rows, every = graph(seed), patterns(graph(seed))
    frame = spark.createDataFrame(rows, EDGES)
    counts = {r.event: (r.patterns, r.organizations) for r in paths.pattern_counts(frame).collect()}
    assert counts == {e: (sum(x[1] == e for x in every), len({x[3] for x in every if x[1] == e})) for e in {x[1] for x in every}}
    expected, events, used = [], [], set()
    for a, e, b, o in sorted(every):
        if len(expected) < 10 and b not in used and events.count(e) < 2:
            expected.append((a, e, b, o))
            events.append(e)
            used.add(b)
    assert paths.diverse_patterns(paths.bridges(frame)) == expected


def test_a_hot_edge_keeps_three_quotations(spark):
    rows = [("a", "Person", "R", "b", "Event", "x", "rule" if i % 2 else "llm", i / 1000, f"s{i % 3}", i // 2, f"q{i:04d}" if i % 5 else "") for i in range(1000)] + [("a", "Person", "R", "c", "Event", "y", "llm", 0.5, "s", 1, "")]
    frame = spark.createDataFrame(rows, "head string, head_type string, relation string, tail string, tail_type string, extractor string, origin string, confidence double, source string, ord long, evidence string")
    got = {r.tail: r for r in edges.merged(frame.repartition(4)).collect()}
    assert got["b"].evidence == ["q0001", "q0002", "q0003"] and got["b"].origin == "rule+llm" and got["b"].sources == ["s0", "s1", "s2"] and got["b"].confidence == 0.999
    assert got["c"].evidence == [] and got["c"].origin == "llm"


def test_containment_by_equality_and_by_loop(spark, monkeypatch):
    questions = spark.createDataFrame([("1", "가나다라 마바"), ("2", "가나"), ("3", ""), ("4", "하하하 파파")], "qid string, question string")
    aliases = spark.createDataFrame([("가나", "x", "Person"), ("나다라", "y", "Event"), ("마", "z", "Person"), ("라 마", "w", "Event")], "surface string, id string, type string")
    found = []
    for most in (1000, 0):
        monkeypatch.setattr(linking, "BROADCAST_ALIASES", most)
        rows = linking.contained(questions, aliases)
        seeds = linking.seeds(questions, aliases)
        found.append((sorted((r.qid, r.id) for r in rows.collect()), sorted(map(tuple, linking.unknown_concepts(questions, seeds, aliases).collect()))))
    assert found[0] == found[1]
    assert found[0][0] == [("1", "w"), ("1", "x"), ("1", "y"), ("2", "x")] and ("4", "하하하") in found[0][1]


@pytest.mark.parametrize("quota", [0, 2, 50])
def test_quota(spark, quota):
    rows = [(f"안중근{i}", ["한국의 독립운동가"], 5, i % 3 + 1, 9000, False) for i in range(8)]
    frame = spark.createDataFrame(rows, "title string, categories array<string>, support int, overlap int, chars int, failed boolean")
    got = {r.title for r in corpus.selected(frame, quota).filter("reason is null").collect()}
    fit = [r.title for r in corpus.selected(frame, 1000).filter("reason is null").collect()]
    assert got == set(sorted(fit, key=lambda t: (-(int(t[-1]) % 3), t))[:quota])


@pytest.mark.parametrize("quota", [0, 3, 5, 100])
def test_funnel(spark, quota):
    """The whole funnel against a loop that takes pages in order."""
    r = random.Random(quota)
    seeds = [f"S{i}" for i in range(4)]
    texts = {s: 1000 for s in seeds[:3]} | {f"T{i}": r.choice([0, 500, 900, 2000]) for i in range(30)}
    links = sorted({(r.choice(seeds), f"T{r.randint(0, 34)}") for _ in range(120)} | {("S3", "T99"), ("S0", "S1"), ("S1", "목록 T"), ("S2", "목록 T")})
    categories = {s: ["의병 1", "의병 2"] for s in seeds} | {f"T{i}": r.choice([["의병 1"], ["의병 1", "의병 2"], ["의병 3"], ["의병 1", "1950년 태어남"]]) for i in range(32)}
    got = corpus.collected(
        spark.createDataFrame([(s,) for s in seeds], "title string"), spark.createDataFrame(links, "seed string, target string"),
        spark.createDataFrame([(t, c) for t, cs in categories.items() for c in cs], "title string, category string"), spark.createDataFrame(list(texts.items()), "title string, chars int"), quota,
    )
    reasons = {x.title: x.reason for x in got.collect()}
    expected = {s: None for s in seeds[:3]} | {"S3": "seed_missing"}
    support = {t: len({s for s, u in links if u == t and s != "S3"}) for _, t in links if t not in seeds[:3]}
    overlap = {t: len({"의병 1", "의병 2"} & set(categories.get(t, []))) for t in support}
    saved = 3
    for t in sorted((t for t in support if support[t]), key=lambda t: (-overlap[t], -support[t], t)):
        if support[t] < 2:
            expected[t] = "few_links"
        elif "목록" in t:
            expected[t] = "list_page: 목록 문서"
        elif t not in categories:
            expected[t] = "no_category_data"
        elif not overlap[t]:
            expected[t] = "no_shared_category"
        elif "1950년 태어남" in categories[t]:
            expected[t] = "out_of_period_after"
        elif saved >= quota:
            expected[t] = "over_quota"
        elif not texts.get(t):
            expected[t] = "fetch_failed"
        elif texts[t] < 800:
            expected[t] = "stub"
        else:
            expected[t], saved = None, saved + 1
    assert reasons == expected


@pytest.mark.parametrize("people,stretches", [((1, 2), 3), ((3,), 2), ((1000,), 1)])
def test_two_hop_patterns_in_stretches_of_people(spark, people, stretches):
    """The choice is that of the whole graph, and the patterns of people after the last one needed are never listed."""
    rows = graph(1)
    frame = spark.createDataFrame(rows, EDGES)
    expected = paths.diverse_patterns(paths.bridges(frame))
    listed = []

    def write(found):
        listed.append({r.a for r in found.collect()})
        return found

    assert paths.first_patterns(frame, write, people=people) == expected
    assert len(listed) <= stretches and all(max(x, default="") < min(y, default="~") for x, y in zip(listed, listed[1:]))
    few = paths.first_patterns(frame.filter("tail in ('p1', 's1', 'c1')"), write, people=people)
    assert few == paths.diverse_patterns(paths.bridges(frame.filter("tail in ('p1', 's1', 'c1')"))) and len(few) < 10
    listed.clear()
    many = spark.createDataFrame([(f"a{i:05d}", "PARTICIPATED_IN", f"p{(7 * i + j) % 300}") for i in range(2000) for j in range(6)] + [(f"a{i:05d}", "FOUNDED", f"s{i % 7}") for i in range(2000)], EDGES)
    assert paths.first_patterns(many, write) == paths.diverse_patterns(paths.bridges(many)) and len(listed) == 1 and len(listed[0]) <= 16
