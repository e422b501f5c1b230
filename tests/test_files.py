"""Readers, writers, remote pages, cache and streams on small files."""

import json

from pyspark.sql import functions as F

from weftgraph.operators import extract, linking, paths
from weftgraph.operators.edges import confirmed, merged
from weftgraph.functions import fixed, rules, text
from weftgraph.functions.arrow import match_starts, mention_scan
from weftgraph.operators.answer import guarded
from weftgraph.plans import queries as Q
from weftgraph.plans import samples as S
from weftgraph.plans.ask import ask, ask_deepening
from weftgraph.plans.build import build
from weftgraph.sources import cache, files, sinks, wiki
from weftgraph.streaming.questions import answer_stream, event_counts


def test_documents(spark, tmp_path):
    (tmp_path / "가_나.md").write_text("# 제목\n\n분류: 하나, 둘\n\n본문이다.\n각주\n아래\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("no header", encoding="utf-8")
    got = files.documents(spark, str(tmp_path)).collect()
    assert [(r.title, r.categories, r.body) for r in got] == [("제목", ["하나", "둘"], "본문이다.")]
    assert sorted(r.doc for r in files.corpus_texts(spark, str(tmp_path)).collect()) == ["b", "가 나"]


def test_config(tmp_path):
    path = tmp_path / "config.json"
    assert files.read_config(str(path)) == files.Config() == files.read_config(None)
    path.write_text(json.dumps({"retrieval": {"max_triples": 5, "strange": 1}, "schema": {"relations": [{"head": "A", "relation": "R", "tail": "B"}]}}))
    assert files.read_config(str(path)).max_triples == 5 and files.read_config(str(path)).allowed == (("A", "R", "B"),)
    assert files.first_existing("", str(tmp_path / "none"), str(path)) == str(path)


def graph(spark):
    edges = Q.sample_edges(spark).withColumn("extractor", F.lit("x")).withColumn("evidence", F.array(F.lit("a & b")))
    nodes = spark.createDataFrame(S.NODES, "id string, type string, names string").select("id", "type", F.split("names", ";").alias("aliases"), F.array("id").alias("sources"), F.lit(1).alias("doc_count"), F.lit(2).alias("degree"))
    return nodes, edges


def test_graph_round_trips(spark, tmp_path):
    nodes, edges = graph(spark)
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    back_nodes, back_edges = files.graphml(spark, str(tmp_path / "g"))
    assert back_nodes.count() == len(S.NODES) and back_edges.count() == len(S.EDGES)
    row = back_edges.filter("head = '안중근' and relation = 'FOUNDED'").first()
    assert (row.tail, row.evidence, row.confidence, row.head_type, row.tail_type) == ("동의단지회", ["a & b"], 0.88, "Person", "Organization")
    whole = {"nodes": [{"id": n, "type": t, "aliases": [], "sources": [], "doc_count": 0, "degree": 0} for n, t, _ in S.NODES], "edges": [{"head": h, "relation": r, "tail": t, "confidence": c} for h, r, t, c, _ in S.EDGES], "alias_index": {"도마": "안중근"}}
    (tmp_path / "graph.json").write_text(json.dumps(whole, indent=1), encoding="utf-8")
    n, e, a = files.graph_json(spark, str(tmp_path / "graph.json"))
    assert n.count() == len(S.NODES) and e.filter("head_type is not null").count() == len(S.EDGES) and a.collect() == [("도마", "안중근")]
    sinks.write_graph(nodes, edges, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/edges")).count() == len(S.EDGES)


def test_golden_manifest_and_logs(spark, tmp_path):
    item = {"id": "Q1", "hops": 1, "question": "?", "expected_answer": ["a"], "expected_path": [{"head": "h", "relation": "r", "tail": "t"}], "answerable": True}
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "items": [item]}, indent=1))
    items, expected = files.golden(spark, str(tmp_path / "g.json"))
    assert items.first().expected == ["a"] and expected.first()["tail"] == "t"
    (tmp_path / "m.json").write_text("{ broken")
    assert files.manifest(spark, str(tmp_path / "m.json")).first().topic is None
    frame = spark.createDataFrame([("q", "a", True)], "question string, answer string, refused boolean")
    for _ in range(2):
        sinks.append_runs(frame, str(tmp_path / "runs"))
    assert files.run_log(spark, str(tmp_path / "runs")).count() == 2
    pages = spark.createDataFrame([("a b", ["x"], "body", None), ("c", ["y"], "t", "stub")], "title string, categories array<string>, body string, reason string")
    sinks.write_selection(pages, str(tmp_path / "s"))
    sinks.write_documents(pages, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "s/rejected")).count() == 1
    assert {r.file for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {"a_b.md", "c.md"}
    sinks.write_report({"one": pages.select("title")}, str(tmp_path / "r"))


def test_remote_pages_and_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def fetch(titles):
        calls.add(1)
        return [{"title": t, "alias": t.lower(), "categories": [f"c{i}"], "links": [], "redirects": [], "extract": "e"} for t in titles for i in range(2)]

    titles = spark.createDataFrame([(f"T{i:02}",) for i in range(45)], "title string").coalesce(1)
    got = wiki.pages(titles, wiki.with_retry(fetch)).collect()
    assert len(got) == 45 and got[0].categories == ["c0", "c1"] and calls.value >= 3

    def broken(_titles):
        raise OSError

    assert wiki.with_retry(broken, attempts=2, wait=0)(["x"]) == []
    assert wiki.recovered(titles, titles.limit(40), fetch).count() == 5
    asked = spark.createDataFrame([("m", "p1"), ("m", "p2")], "model string, prompt string")
    known = asked.limit(1).select(text.cache_key(F.col("model"), F.col("prompt")).alias("key"), F.lit("old").alias("answer"))
    fresh = cache.answered(asked, known, lambda p: F.concat(F.lit("new "), p), "prompt", "model", "prompt")
    assert {r.prompt: r.answer for r in fresh.collect()} == {"p1": "old", "p2": "new p2"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"qid": q, "question": t}, ensure_ascii=False) for q, t in S.QUESTIONS[:2]), encoding="utf-8")
    stream = answer_stream(spark, str(tmp_path / "in"), Q.sample_edges(spark), Q.aliases(spark), str(tmp_path / "log"), str(tmp_path / "c"))
    stream.awaitTermination(300)
    assert {r.qid for r in spark.read.json(str(tmp_path / "log")).collect()} == {"Q1", "Q2"}
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "events"))
    counts = event_counts(spark, str(tmp_path / "events"), table.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination(200)
    assert spark.sql("select sum(events) from counted").first()[0] == table.count()
    spark.catalog.clearCache()


def test_reverse_templates(spark):
    steps = paths.steps_of(Q.sample_edges(spark))
    found = paths.along(paths.start(spark.createDataFrame([("q", "청산리 전투")], "qid string, node string")), steps, paths.EVENT_PEOPLE)
    assert {r["at"] for r in found.collect()} == {"김좌진", "홍범도"}
    chain = paths.along(paths.start(spark.createDataFrame([("q", "홍범도")], "qid string, node string")), steps, paths.PERSON_ORGANIZATION_EVENT)
    assert {r["at"] for r in chain.collect()} == {"봉오동 전투", "청산리 전투"}


def test_large_alias_table_joins_by_equality(spark, monkeypatch):
    small = {tuple(r) for r in linking.contained(Q.questions(spark), Q.aliases(spark)).collect()}
    monkeypatch.setattr(linking, "BROADCAST_ALIASES", 1)
    assert {tuple(r) for r in linking.contained(Q.questions(spark), Q.aliases(spark)).collect()} == small


def test_guard(spark):
    nodes = spark.createDataFrame([("김구",), ("안중근",)], "id string")
    rows = [("1", "plain", "안중근 did", ["안중근"], "안중근"), ("2", "plain", "안중근 and 김구", ["안중근"], "안중근"), ("3", "plain", "nobody", ["안중근"], "안중근"), ("4", "plain", None, ["안중근"], "안중근")]
    answers = spark.createDataFrame(rows, "qid string, answer string, polished string, allowed array<string>, target string")
    assert {r.qid: r.final for r in guarded(answers, nodes).collect()} == {"1": "안중근 did", "2": "plain", "3": "plain", "4": "plain"}


def test_verbs_mentions_and_model(spark):
    rows = spark.createDataFrame([("단체를 조직하였고 다시 창설했다",), (None,)], "s string")
    assert [r[0] for r in rows.select(match_starts(fixed.FOUND_ACTIVE)(F.col("s"))).collect()] == [[4, 13], []]
    scan = mention_scan({"김구": ("김구", "Person"), "김구단": ("김구단", "Organization"), "의거": ("의거", "Event")})
    texts = spark.createDataFrame([("김구는 김구단을 만들고 대의거 의거에서 김구호",)], "sentence string")
    assert [m.surface for m in texts.select(scan(F.col("sentence")).alias("m")).first().m] == ["김구", "김구단", "의거"]
    sentences = texts.withColumn("mentions", scan(F.col("sentence"))).withColumn("title", F.lit("t")).withColumn("ord", F.lit(0))
    told = extract.model_candidates(sentences, lambda s: F.lit('[{"head":"김구","relation":"FOUNDED","tail":"김구단"},{"head":"김구","relation":"FOUNDED","tail":"other"}]'))
    assert [(r["head"], r["tail"], r.confidence) for r in told.collect()] == [("김구", "김구단", 0.7)]
    assert extract.model_candidates(sentences, None) is None
    assert extract.residual(sentences, told.limit(0)).count() == 1


def test_merge_keeps_three_first_quotes(spark):
    rows = [("a", "Person", "FOUNDED", "b", "Organization", "e%d" % (i % 5), "rule", 0.5 + i / 100, "s%d" % (i % 2), 9 - i, "q%d" % (i % 6)) for i in range(10)]
    frame = spark.createDataFrame(rows, "head string, head_type string, relation string, tail string, tail_type string, extractor string, origin string, confidence double, source string, ord int, evidence string")
    row = merged(frame).first()
    assert row.evidence == ["q3", "q2", "q1"] and row.sources == ["s0", "s1"] and abs(row.confidence - 0.59) < 1e-9 and len(row.extractors) == 5


def test_build_with_discovery(spark):
    docs = spark.createDataFrame([(f"인물 {t}", b) for t, b in S.BODIES], "title string, body string").withColumn("categories", F.array(F.lit("한국의 독립운동가")))
    assert build(docs, discovery=True).nodes.count() >= 5


def test_weights_and_accuracy(spark):
    row = spark.sql("select 0.5D as c, 'h' as head, 't' as tail, array('h', 'x') as s, array('abc', 'zz') as e").select(
        rules.edge_weight(F.col("c"), F.col("head"), F.col("tail"), F.col("s")).alias("w"), rules.answer_accuracy(F.lit("a b c"), F.col("e")).alias("one"), rules.answer_accuracy(F.lit("xbc"), F.col("e")).alias("half"), rules.answer_accuracy(F.lit("q"), F.col("e")).alias("none"), rules.answer_accuracy(F.lit("q"), F.array().cast("array<string>")).alias("empty"),
    ).first()
    assert abs(row.w - 0.5 * 1.3 * 1.2) < 1e-12 and (row.one, row.half, row.none, row.empty) == (1.0, 0.5, 0.0, 0.0)


def test_stored_documents_and_evaluation(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# 제목 \n\n분류: 하나, , 둘\n\n본문\n각주\n", encoding="utf-8")
    (tmp_path / "d/b.md").write_text("no header", encoding="utf-8")
    (tmp_path / "d/c.md").write_text("", encoding="utf-8")
    got = {r.file: (r.title, r.categories, r.body) for r in files.stored_documents(spark, str(tmp_path / "d")).collect()}
    assert got["a.md"] == ("제목", ["하나", "둘"], "본문\n각주\n") and got["b.md"] == ("", [], "no header")
    whole = {"run_at": "now", "n_items": 3, "by_hop": {"2": {"n": 2, "graphrag": {"answer_acc": 1.0, "path_recall": 0.5, "refusal_ok": None}, "basic_rag": {"answer_acc": 0.25}}}, "unanswerable": {"n": 1, "refusal_accuracy": 1.0, "hallucinated": 0}, "overall": {"graphrag_answer_acc": 1.0, "basic_rag_answer_acc": 0.25}, "failure_layer_counts": {"index": 1}}
    (tmp_path / "e.json").write_text(json.dumps(whole, indent=1))
    totals, hops = files.evaluation(spark, str(tmp_path / "e.json"))
    assert (totals.first().n_items, totals.first().accuracy, totals.first().failure_layer_counts) == (3, 1.0, {"index": 1}) and tuple(hops.first()) == (2, 2, 1.0, 0.5, 0.25)
    (tmp_path / "broken.json").write_text("{")
    totals, hops = files.evaluation(spark, str(tmp_path / "broken.json"))
    assert totals.first().run_at is None and hops.count() == 0


def test_manifest_round_trip(spark, tmp_path):
    kept = spark.createDataFrame([("b b", ["x"], 900, 2, "linked", ["B"]), ("a", ["y"], 1000, 0, "seed", [])], "title string, categories array<string>, chars int, hop int, why string, redirects array<string>")
    rejected = spark.createDataFrame([("d", "stub"), ("c", "few_links")], "title string, reason string")
    sinks.write_manifest(sinks.manifest_row(kept, rejected, kept.select("title", "categories", "redirects"), ["a"], {"saved": 2}, "wiki", "topic"), str(tmp_path / "m"))
    row = files.manifest(spark, str(tmp_path / "m")).first()
    assert [(x.title, x.file, x.hop, x.reason) for x in row.docs] == [("a", "a.md", 0, "seed"), ("b b", "b_b.md", 2, "linked")]
    assert row.seeds == ["a"] and row.stats == {"saved": 2} and row.gazetteer["b b"].redirects == ["B"] and [r.title for r in row.rejected] == ["c", "d"]
    sinks.write_manifest(sinks.manifest_row(kept.limit(0), rejected.limit(0), kept.limit(0).select("title", "categories", "redirects"), [], {}, "wiki", "topic"), str(tmp_path / "m"))
    assert files.manifest(spark, str(tmp_path / "m")).first().docs == []


def test_graph_export_counts(spark, tmp_path):
    nodes, edges = graph(spark)
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    stats = {(r.kind, r.value): r.n for r in spark.read.json(str(tmp_path / "g/stats")).collect()}
    assert stats["nodes", "all"] == len(S.NODES) and stats["edges", "all"] == len(S.EDGES) and stats["relation", "FOUNDED"] + stats["relation", "PARTICIPATED_IN"] == len(S.EDGES)
    index = {r.surface: r.id for r in spark.read.json(str(tmp_path / "g/alias_index")).collect()}
    # Two nodes have this alias; an id always stands for itself.
    assert index["백야"] == "김좌진" and all(index[n] == n for n, _, _ in S.NODES)


def test_cache_is_written_back(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(prompt):
        calls.add(1)
        return None if prompt == "bad" else f"to {prompt}"

    asked = spark.createDataFrame([(1, "m", "p"), (2, "m", "p"), (3, "m", "q"), (4, "m", "bad")], "n int, model string, prompt string")
    assert {r.status for r in cache.remembered(asked, path, None, "prompt", "model", "prompt").collect()} == {"skipped"}
    first = cache.remembered(asked, path, model, "prompt", "model", "prompt")
    assert {r.n: (r.answer, r.status) for r in first.collect()} == {1: ("to p", "call"), 2: ("to p", "call"), 3: ("to q", "call"), 4: (None, "error")} and calls.value == 3
    second = cache.remembered(asked, path, model, "prompt", "model", "prompt")
    assert cache.counters(second, cache.entries(spark, path)).first().asDict() == {"hit": 3, "miss": 1, "call": 0, "error": 1, "skipped": 0, "cached_entries": 2} and calls.value == 4


PAGES = {"A": {"categories": [{"title": "분류:하나"}], "links": [{"title": "B"}], "redirects": [{"title": "a2"}], "extract": " text "}, "C": {"categories": [], "extract": ""}}


def api(params):
    """A wiki with a page A that gives its links in two parts, an empty page C, a redirect a to A, and a title that always fails."""
    titles = params["titles"].split("|")
    if "down" in titles:
        raise wiki.Busy(0)
    key = {"info": None, "extracts": "extract"}.get(params["prop"], params["prop"])
    found, redirects = [], [{"from": "a", "to": "A"}] if "a" in titles else []
    for title in sorted({"A" if t == "a" else t for t in titles}):
        page = {"title": title} | ({} if title in PAGES else {"missing": True})
        if key in PAGES.get(title, {}):
            page[key] = PAGES[title][key]
        found.append(page)
    if key == "links" and "plcontinue" not in params:
        return {"query": {"pages": [p | {"links": [{"title": "Z"}]} for p in found], "redirects": redirects}, "continue": {"plcontinue": 1}}
    return {"query": {"pages": found, "redirects": redirects}}


def test_wiki_client(spark, tmp_path):
    fetch = wiki.with_retry(wiki.client(wiki.paced(api)), attempts=2, wait=0)
    titles = spark.createDataFrame([("a",), ("C",), ("none",)], "title string").coalesce(1)
    got = {r.title: r for r in wiki.pages(titles, fetch).collect()}
    assert (got["A"].aliases, got["A"].categories, got["A"].links, got["A"].redirects, got["A"].extract, got["A"].missing) == (["a"], ["하나"], ["B", "Z"], ["a2"], "text", False)
    assert got["none"].missing and not got["C"].missing and got["C"].extract == ""
    down = spark.createDataFrame([("down",)], "title string")
    path = str(tmp_path / "pages")
    first = wiki.stored(titles.unionByName(down), path, fetch, size=1)
    assert {r.title for r in first.collect()} == {"A", "C", "none"}
    assert [r.title for r in wiki.failed(titles.unionByName(down), first).collect()] == ["down"]

    def never(_titles):
        raise AssertionError("asked again")

    assert {r.title for r in wiki.stored(titles, path, never).collect()} == {"A", "C", "none"} and spark.read.parquet(path).count() == 3


def test_waits_as_long_as_asked(monkeypatch):
    waits = []
    monkeypatch.setattr(wiki.time, "sleep", waits.append)

    def busy(_params):
        raise wiki.Busy(30.0)

    assert wiki.with_retry(busy, attempts=3)({"titles": "x"}) == {} and waits == [30.0, 30.0]
    slow = wiki.paced(busy, interval=1.0)
    for _ in range(5):
        try:
            slow({})
        except wiki.Busy:
            pass
    assert waits[2:] == [1.0, 2.0, 4.0, 8.0, 8.0]


def test_build_with_a_model(spark):
    docs = spark.createDataFrame([("안중근", ["한국의 독립운동가"], "안중근은 하얼빈 의거에 참여하였다. 그 뒤 안중근 그리고 동의단지회 이야기가 남았다.")], "title string, categories array<string>, body string")
    more = spark.createDataFrame([("하얼빈 의거", ["1909년 사건"], []), ("동의단지회", ["한국의 독립운동단체"], [])], "title string, categories array<string>, redirects array<string>")
    answer = '[{"head":"안중근","relation":"FOUNDED","tail":"동의단지회"},{"head":"동의단지회","relation":"FOUNDED","tail":"안중근"}]'
    plain, told = build(docs, more), build(docs, more, ask=lambda s: F.lit(answer))
    edge = told.edges.join(plain.edges.select("head", "relation", "tail"), ["head", "relation", "tail"], "left_anti").collect()
    assert [(e["head"], e["tail"], e["origin"], e["confidence"]) for e in edge] == [("안중근", "동의단지회", "llm", 0.7)]
    assert told.refused.filter("head = '동의단지회' and reason = 'schema_type_mismatch'").count() == 1


def test_model_repeats_raise_confidence(spark):
    names = "head string, relation string, tail string, origin string, confidence double"
    frame = spark.createDataFrame([("a", "r", "b", "rule+llm", 0.75), ("a", "r", "c", "llm", 0.7), ("a", "r", "d", "llm", 0.7), ("a", "r", "e", "rule", 1.0), ("a", "r", "f", "rule+llm", 1.0)], names)
    told = spark.createDataFrame([("a", "r", t) for t in "bcddf"], "head string, relation string, tail string")
    assert {r["tail"]: r.confidence for r in confirmed(frame, told).collect()} == {"b": 0.95, "c": 0.7, "d": 0.95, "e": 1.0, "f": 0.99}


def test_asks_again_within_the_bound(spark):
    got = {r.qid: r for r in ask_deepening(Q.questions(spark), Q.sample_edges(spark), Q.aliases(spark)).collect()}
    once = {r.qid: r for r in ask(Q.questions(spark), Q.sample_edges(spark), Q.aliases(spark)).answers.collect()}
    assert {q: (r.refused, r.answer) for q, r in got.items()} == {q: (r.refused, r.answer) for q, r in once.items()}
    assert all(r.rounds == 1 for r in got.values() if not r.refused) and {r.rounds for r in got.values() if r.refused} <= {1, 2} and got["Q8"].rounds == 2


def test_graph_is_written_packed_from_nodes_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    nodes = spark.createDataFrame([(f"n{i}", "Person", ["x", f"m{i}"]) for i in range(50)], "id string, type string, aliases array<string>").mapInArrow(counted, "id string, type string, aliases array<string>")
    edges = spark.createDataFrame([(f"n{i}", "FOUNDED", f"n{i + 1}", "rule") for i in range(49)], "head string, relation string, tail string, origin string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert made.value == 50
    for name, n in (("nodes", 50), ("edges", 49), ("alias_index", 101), ("stats", 5)):
        parts = [p for p in (tmp_path / "g" / name).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.name.endswith(".json.gz") for p in parts) and spark.read.json(str(tmp_path / "g" / name)).count() == n
