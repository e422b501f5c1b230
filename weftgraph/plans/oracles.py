"""The same queries in DuckDB SQL, written on their own."""

from __future__ import annotations

from ..functions import fixed
from . import samples as S

LINES = """
lo AS (
  SELECT 'C' || o_custkey AS person, 'P' || l_partkey AS event, 'S' || l_suppkey AS org, 'S' || (l_partkey % 10) AS other, l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN 'llm' ELSE 'rule' END AS origin, 1 - l_discount AS confidence, o_orderpriority AS source, l_orderkey AS ord, CAST(l_orderkey AS VARCHAR) AS evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cand AS (
  SELECT person AS head, 'Person' AS head_type, 'PARTICIPATED_IN' AS relation, event AS tail, 'Event' AS tail_type, 'order' AS extractor, origin, confidence, source, ord, evidence FROM lo
  UNION ALL SELECT org, 'Organization', 'PARTICIPATED_IN', event, 'Event', 'supply', origin, confidence, source, ord, evidence FROM lo
  UNION ALL SELECT person, 'Person', 'FOUNDED', org, 'Organization', 'first_line', origin, confidence, source, ord, evidence FROM lo WHERE l_linenumber = 1
  UNION ALL SELECT event, 'Event', 'PARTICIPATED_IN', person, 'Person', 'reversed', origin, confidence, source, ord, evidence FROM lo WHERE l_linenumber = 2
  UNION ALL SELECT org, 'Organization', 'FOUNDED', other, 'Organization', 'third_line', origin, confidence, source, ord, evidence FROM lo WHERE l_linenumber = 3),
judged AS (
  SELECT *, CASE WHEN head = tail THEN 'self_loop'
    WHEN (head_type, relation, tail_type) NOT IN (('Person', 'PARTICIPATED_IN', 'Event'), ('Person', 'FOUNDED', 'Organization'), ('Organization', 'PARTICIPATED_IN', 'Event')) THEN 'schema_type_mismatch' END AS reason
  FROM cand),
acc AS (SELECT * FROM judged WHERE reason IS NULL)"""
EDGES = LINES + """,
edges AS (
  SELECT head, relation, tail, min(head_type) AS head_type, min(tail_type) AS tail_type,
    CASE WHEN bool_or(origin = 'rule') AND bool_or(origin = 'llm') THEN 'rule+llm' ELSE min(origin) END AS origin,
    max(confidence) AS confidence, list_sort(list(DISTINCT source)) AS sources, list_sort(list(DISTINCT extractor)) AS extractors
  FROM acc GROUP BY head, relation, tail),
ends AS (SELECT head AS id, head_type AS type FROM edges UNION ALL SELECT tail, tail_type FROM edges),
nodes AS (SELECT id, type, count(*) AS degree FROM ends GROUP BY id, type)"""
STEPS = EDGES + """,
steps AS (
  SELECT *, confidence * CASE WHEN list_contains(sources, head) OR list_contains(sources, tail) THEN 1.3 ELSE 1.0 END * CASE WHEN len(sources) >= 2 THEN 1.2 ELSE 1.0 END AS w FROM edges),
adj AS (
  SELECT head AS node, tail AS other, tail_type AS other_type, 'forward' AS direction, relation, head, tail, w, sources FROM steps
  UNION ALL SELECT tail, head, head_type, 'reverse', relation, head, tail, w, sources FROM steps)"""
CHAIN = """,
found AS (
  SELECT s.id AS qid, a.other AS ev, b.other AS per, c.other AS org, a.direction AS d1, b.direction AS d2, a.w * b.w * c.w AS score, a.w AS w1, b.w AS w2, c.w AS w3
  FROM seed s
  JOIN adj a ON a.node = s.id AND a.relation = 'PARTICIPATED_IN' AND a.other_type = 'Event'
  JOIN adj b ON b.node = a.other AND b.relation = 'PARTICIPATED_IN' AND b.other_type = 'Person' AND b.other <> s.id
  JOIN adj c ON c.node = b.other AND c.relation = 'FOUNDED' AND c.other_type = 'Organization' AND c.direction = 'forward'),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, org ORDER BY score DESC, [qid, ev, per, org]) AS rn FROM found) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, [qid, ev, per, org]) AS rank FROM best)"""


def seed(*names: str) -> str:
    return ", " + S.values(list(names), "id", "seed")


ALL_SEEDS = seed(*(f"C{i}" for i in range(5)))
TWO_SEEDS = seed("C0", "C1")
ORACLE_SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE_SQL[name] = text


sql("kg_edges_merge", f"""WITH {EDGES},
q AS (SELECT head, relation, tail, evidence, min(ord) AS ord FROM acc GROUP BY ALL),
three AS (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY ord, evidence) AS n FROM q),
quotes AS (SELECT head, relation, tail, string_agg(evidence, ';' ORDER BY n) AS evidence FROM three WHERE n <= 3 GROUP BY head, relation, tail)
SELECT head, relation, tail, origin, round(confidence, 6) AS confidence, array_to_string(sources, ';') AS sources, evidence, array_to_string(extractors, ';') AS extractors, CAST(len(sources) AS INT) AS doc_count
FROM edges JOIN quotes USING (head, relation, tail)""")
sql("kg_schema_gate", f"WITH {LINES} SELECT coalesce(reason, 'accepted') AS reason, extractor, count(*) AS n FROM judged GROUP BY 1, 2")
sql("kg_refused_log", f"WITH {LINES} SELECT head, relation, tail, reason, min(ord) AS first_seen, count(*) AS times FROM judged WHERE reason IS NOT NULL GROUP BY head, relation, tail, reason")
sql("kg_refused_log_top", f"WITH {LINES} SELECT head, relation, tail, reason FROM judged WHERE reason IS NOT NULL GROUP BY head, relation, tail, reason ORDER BY min(ord), head, relation, tail, reason LIMIT 300")
sql("kg_firing_counts", f"WITH {LINES} SELECT extractor, count(*) AS fired FROM acc GROUP BY extractor")
sql("kg_degree", f"WITH {EDGES} SELECT id, type, degree FROM nodes")
sql("kg_hubs", f"WITH {EDGES} SELECT id, type, degree FROM nodes WHERE degree > 25")
sql("kg_degree_penalty", f"WITH {EDGES} SELECT id, round(1 / (1 + sqrt(degree)), 6) AS penalty FROM nodes")
sql("kg_stats", f"""WITH {EDGES} SELECT 'relation' AS kind, relation AS value, count(*) AS edges FROM edges GROUP BY relation
UNION ALL SELECT 'origin', origin, count(*) FROM edges GROUP BY origin UNION ALL SELECT 'all', 'all', count(*) FROM edges""")
sql("kg_node_types", f"WITH {EDGES} SELECT type, count(*) AS nodes FROM nodes GROUP BY type")
sql("kg_adjacency", f"WITH {STEPS} SELECT node, other, other_type, direction, relation FROM adj")
sql("kg_node_documents", f"""WITH {EDGES}, told AS (SELECT head AS id, head_type AS type, unnest(sources) AS source FROM edges UNION SELECT tail, tail_type, unnest(sources) FROM edges)
SELECT id, type, string_agg(source, ';' ORDER BY source) AS sources, CAST(count(*) AS INT) AS doc_count FROM told GROUP BY id, type""")
sql("kg_relation_budget", f"""WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY head, relation ORDER BY confidence DESC, tail) AS n FROM edges WHERE origin NOT LIKE '%rule%')
SELECT head, relation, tail, origin FROM edges WHERE origin LIKE '%rule%' UNION ALL SELECT head, relation, tail, origin FROM r WHERE n <= 3""")
sql("kg_pruned", f"""WITH {EDGES}, big AS (SELECT id FROM nodes WHERE degree >= 8)
SELECT head, relation, tail, CASE WHEN head IN (SELECT id FROM big) AND tail IN (SELECT id FROM big) THEN 'kept' ELSE 'node_pruned' END AS state FROM edges""")
sql("kg_edge_weight", f"WITH {STEPS} SELECT head, relation, tail, round(w, 6) AS weight FROM steps")
sql("kg_1hop", f"""WITH {STEPS} {ALL_SEEDS}, f AS (SELECT id AS qid, other, w FROM seed JOIN adj ON node = id AND relation = 'FOUNDED' AND direction = 'forward' AND other_type = 'Organization'),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, other) AS rank FROM f)
SELECT qid, other AS target, round(w, 6) AS score, qid || ' -[FOUNDED]-> ' || other AS path, rank FROM r WHERE rank <= 10""")
sql("kg_2hop_coparticipant", f"""WITH {STEPS} {ALL_SEEDS} {CHAIN}
SELECT qid, org AS target, round(score, 6) AS score, qid || ' -[PARTICIPATED_IN]-> ' || ev || ' <-[PARTICIPATED_IN]- ' || per || ' -[FOUNDED]-> ' || org AS path, rank FROM ranked WHERE rank <= 5""")
sql("kg_3hop_chain", f"""WITH {STEPS} {seed("C1")} {CHAIN}
SELECT qid, a.other AS target, count(*) AS paths, round(max(w1 * w2 * w3 * a.w), 6) AS score
FROM found JOIN adj a ON a.node = org AND a.direction = 'forward' AND a.relation = 'PARTICIPATED_IN' AND a.other_type = 'Event' AND a.other <> ev GROUP BY qid, a.other""")
sql("kg_two_seed_intersect", f"""WITH {STEPS},
e AS (SELECT other AS per, min({{'t': node, 'w': w}}) AS x FROM adj WHERE node IN (SELECT 'P' || i FROM range(1, 40) r(i)) AND relation = 'PARTICIPATED_IN' AND other_type = 'Person' GROUP BY other),
o AS (SELECT other AS per, min({{'t': node, 'w': w}}) AS x FROM adj WHERE node IN (SELECT 'S' || i FROM range(1, 10) r(i)) AND relation = 'FOUNDED' AND other_type = 'Person' GROUP BY other),
r AS (SELECT per, o.x.w * e.x.w AS score, o.x.t AS ot, e.x.t AS et FROM e JOIN o USING (per)),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, [ot, per, et]) AS n FROM r)
SELECT 'q' AS qid, per AS target, round(score, 6) AS score, ot || ' <-[FOUNDED]- ' || per || ' -[PARTICIPATED_IN]-> ' || et AS path FROM k WHERE n <= 50""")
sql("kg_context_topup", f"""WITH {STEPS} {ALL_SEEDS},
p AS (SELECT id AS qid, 0 AS turn, id || '>' || other AS ord, 1 AS hop, head, relation, tail FROM seed JOIN adj ON node = id AND relation = 'FOUNDED' AND direction = 'forward'
  UNION ALL SELECT id, 1, id, 0, head, relation, tail FROM seed JOIN adj ON node = id),
o AS (SELECT qid, head, relation, tail, min({{'turn': turn, 'ord': ord, 'hop': hop}}) AS first FROM p GROUP BY qid, head, relation, tail),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first, head, relation, tail) AS rank FROM o)
SELECT qid, rank, head, relation, tail, first.turn AS turn FROM r WHERE rank <= 20""")
sql("kg_hops_used", f"""WITH {STEPS} {TWO_SEEDS} {CHAIN}, v AS (SELECT id AS qid, id AS node FROM seed UNION SELECT qid, unnest([qid, ev, per, org]) FROM best)
SELECT qid, 3 AS hops_used, CAST(count(*) AS INT) AS n_visited FROM v WHERE qid IN (SELECT qid FROM best) GROUP BY qid""")


sql("kg_penalised_paths", f"""WITH {STEPS} {TWO_SEEDS} {CHAIN.split("best AS")[0]}
pen AS (SELECT f.*, score / (1 + sqrt(x.degree)) / (1 + sqrt(y.degree)) AS ps FROM found f JOIN nodes x ON x.id = ev JOIN nodes y ON y.id = per),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, org ORDER BY ps DESC, [qid, ev, per, org]) AS k FROM pen), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ps DESC, [qid, ev, per, org]) AS n FROM b WHERE k = 1)
SELECT qid, org AS target, round(ps, 6) AS score, qid || ' -[PARTICIPATED_IN]-> ' || ev || ' <-[PARTICIPATED_IN]- ' || per || ' -[FOUNDED]-> ' || org AS path FROM r WHERE n <= 10""")
sql("kg_skipped_hubs", f"""WITH {STEPS} {TWO_SEEDS} {CHAIN.split("best AS")[0]}
i AS (SELECT qid, ev, per, org, unnest([ev, per]) AS id FROM found), h AS (SELECT i.*, degree FROM i JOIN nodes USING (id) WHERE degree > 40),
k AS (SELECT qid, count(*) AS kept FROM found f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.ev = f.ev AND h.per = f.per AND h.org = f.org) GROUP BY qid)
SELECT qid, id, max(degree) AS degree, count(*) AS paths, coalesce(any_value(kept), 0) AS kept FROM h LEFT JOIN k USING (qid) GROUP BY qid, id""")
sql("kg_context_sources", f"""WITH {STEPS} {ALL_SEEDS},
p AS (SELECT id AS qid, 0 AS turn, id || '>' || other AS ord, 1 AS hop, head, relation, tail FROM seed JOIN adj ON node = id AND relation = 'FOUNDED' AND direction = 'forward'
  UNION ALL SELECT id, 1, id, 0, head, relation, tail FROM seed JOIN adj ON node = id),
o AS (SELECT qid, head, relation, tail, min({{'turn': turn, 'ord': ord, 'hop': hop}}) AS first FROM p GROUP BY qid, head, relation, tail),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first, head, relation, tail) AS rank FROM o),
u AS (SELECT DISTINCT qid, unnest(sources) AS source FROM r JOIN edges USING (head, relation, tail) WHERE rank <= 20) SELECT qid, string_agg(source, ';' ORDER BY source) AS sources FROM u GROUP BY qid""")


def _bfs(passed: str) -> str:
    return f"""WITH RECURSIVE {EDGES}, near AS (SELECT head AS a, tail AS b FROM edges UNION SELECT tail, head FROM edges),
degree AS (SELECT a, count(*) AS n FROM near GROUP BY a), {S.values(["C1", "C2"], "s", "start")},
walk(seed, node, hop) AS (SELECT s, s, 0 FROM start UNION SELECT seed, b, hop + 1 FROM walk JOIN near ON a = node JOIN degree USING (a) WHERE hop < 2 AND {passed})
SELECT seed, node, CAST(min(hop) AS INT) AS hop FROM walk GROUP BY seed, node"""


sql("kg_bfs", _bfs("TRUE"))
sql("kg_bfs_hubs", _bfs("(hop = 0 OR n <= 40)"))
PATTERNS = f"""WITH {EDGES}, part AS (SELECT head, tail AS event FROM edges WHERE relation = 'PARTICIPATED_IN' AND head_type = 'Person'),
fo AS (SELECT head AS b, tail AS organization FROM edges WHERE relation = 'FOUNDED' AND head_type = 'Person'),
pat AS (SELECT x.head AS a, x.event, y.head AS b, organization FROM part x JOIN part y ON x.event = y.event AND x.head <> y.head JOIN fo ON fo.b = y.head)"""
sql("kg_two_hop_proof", f"{PATTERNS} SELECT event, count(*) AS patterns, count(DISTINCT organization) AS organizations FROM pat GROUP BY event")
sql("kg_two_hop_greedy", PATTERNS.replace("WITH", "WITH RECURSIVE", 1) + """,
one AS MATERIALIZED (SELECT a, event, b, min(organization) AS organization FROM pat GROUP BY a, event, b),
g(n, got, used, told) AS (
  SELECT 0, NULL::STRUCT(a VARCHAR, event VARCHAR, b VARCHAR, organization VARCHAR), []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT n + 1, m, list_append(used, m.b), list_append(told, m.event) FROM (
    SELECT n, used, told, min({'a': a, 'event': event, 'b': b, 'organization': organization}) AS m
    FROM g JOIN one ON n < 10 AND NOT list_contains(used, b) AND len(list_filter(told, lambda x: x = event)) < 2 GROUP BY n, used, told))
SELECT got.a AS a, got.event AS event, got.b AS b, got.organization AS organization FROM g WHERE n > 0""")
sql("kg_supporting", f"""WITH {STEPS} {TWO_SEEDS} {CHAIN}, top5 AS (SELECT * FROM ranked WHERE rank <= 5),
st AS (SELECT qid, rank, 1 AS hop, qid AS head, 'PARTICIPATED_IN' AS relation, ev AS tail FROM top5 UNION ALL SELECT qid, rank, 2, per, 'PARTICIPATED_IN', ev FROM top5 UNION ALL SELECT qid, rank, 3, per, 'FOUNDED', org FROM top5),
f AS (SELECT qid, head, relation, tail, min({{'rank': rank, 'hop': hop}}) AS m FROM st GROUP BY qid, head, relation, tail)
SELECT qid, head, relation, tail, m.rank AS rank, m.hop AS hop, array_to_string(e.sources, ';') AS sources FROM f JOIN edges e USING (head, relation, tail)""")
sql("kg_evidence_by_source", f"""WITH {EDGES}, q AS (SELECT head, relation, tail, evidence, min(ord) AS ord FROM acc GROUP BY ALL),
three AS (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY ord, evidence) AS n FROM q),
x AS (SELECT unnest(e.sources) AS source, head, tail, n, t.evidence FROM edges e JOIN three t USING (head, relation, tail) WHERE n <= 3 AND relation = 'FOUNDED'),
f AS (SELECT source, evidence, min({{'h': head, 't': tail, 'n': n}}) AS m FROM x GROUP BY source, evidence),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m, evidence) AS k FROM f)
SELECT source, count(*) AS quotes, max(k) AS last, min(CASE WHEN k = 1 THEN evidence END) AS first_quote FROM r GROUP BY source""")
NODES = S.values(S.NODES, "id, type, names", "n")
sql("kg_merge_log", f"WITH {NODES}, a AS (SELECT id, unnest(string_split(names, ';')) AS alias FROM n) SELECT id, string_agg(alias, ';' ORDER BY alias) AS merged FROM a WHERE alias <> '' AND alias <> id GROUP BY id")
sql("kg_alias_index", """WITH c AS (SELECT p_name AS surface, p_partkey AS ord, 'P' || p_partkey AS id FROM part UNION ALL SELECT 'P' || p_partkey, p_partkey, 'P' || p_partkey FROM part)
SELECT surface, arg_max(id, ord) AS last_id, arg_min(id, ord) AS first_id FROM c GROUP BY surface""")
sql("kg_alias_conflict", """WITH f AS (SELECT p_name, 'P' || p_partkey AS id, first_value('P' || p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS kept FROM part)
SELECT p_name AS surface, kept AS kept_id, id AS rejected_id FROM f WHERE id <> kept""")
sql("kg_homonym_ids", """WITH g AS (SELECT p_name AS name, p_brand AS type, max(p_size) > 40 AS is_doc, count(*) AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_doc DESC, n DESC, type) AS k FROM g)
SELECT name, type, CASE WHEN k = 1 THEN name ELSE name || ' (' || type || ')' END AS node_id FROM r""")
sql("kg_type_priority", f"""WITH {NODES}, a AS (SELECT id, type, unnest(string_split(names, ';')) AS name FROM n), w(name) AS (VALUES ('백야'), ('애국단'), ('없음')),
r AS (SELECT name, id, type, row_number() OVER (PARTITION BY name ORDER BY list_position(['Person', 'Organization', 'Event'], type), id) AS k FROM a JOIN w USING (name))
SELECT name, id, type FROM r WHERE k = 1""")
sql("kg_abbreviation_target", f"""WITH {NODES}, a AS (SELECT id, type, unnest(string_split(names, ';')) AS name FROM n), w(name) AS (VALUES ('백야'), ('애국단'), ('도마')),
r AS (SELECT name, id, type, row_number() OVER (PARTITION BY name ORDER BY list_position(['Organization', 'Event', 'Person'], type), id) AS k FROM a JOIN w USING (name))
SELECT name, id, type FROM r WHERE k = 1""")
sql("kg_golden_patterns", f"""WITH {S.values(S.EDGES, "head, relation, tail, confidence, sources", "e")}, {S.values(S.GOLDEN, "item_id, type, hops, answerable, a, event, b, organization", "g")},
pat AS (SELECT p.head AS a, p.tail AS event, q.head AS b, min(f.tail) AS organization FROM e p JOIN e q ON p.relation = 'PARTICIPATED_IN' AND q.relation = 'PARTICIPATED_IN' AND q.tail = p.tail AND q.head <> p.head
  JOIN e f ON f.relation = 'FOUNDED' AND f.head = q.head AND f.tail <> p.tail AND f.tail <> p.head GROUP BY p.head, p.tail, q.head),
u AS (SELECT * FROM g WHERE type = 'path' AND hops >= 2),
m AS (SELECT a, event, b, organization, max(item_id) AS goldenset_id FROM u GROUP BY ALL)
SELECT pat.*, goldenset_id, FALSE AS added FROM pat LEFT JOIN m USING (a, event, b, organization)
UNION ALL SELECT a, event, b, organization, min(item_id), TRUE FROM u WHERE answerable AND (a, event, b, organization) NOT IN (SELECT (a, event, b, organization) FROM pat) GROUP BY a, event, b, organization""")

QUESTIONS = S.values(S.QUESTIONS, "qid, question", "q")
ALIASES = f"""{NODES}, al AS (SELECT DISTINCT id, type, unnest([id] || CASE WHEN id = '대한독립군' THEN [] ELSE list_filter(string_split(names, ';'), lambda x: x <> '') END) AS surface FROM n)"""


def any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def last_of(words: tuple[str, ...]) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN contains(question, '{w}') THEN length(question) - strpos(reverse(question), '{w[::-1]}') - {len(w)} + 1 ELSE -1 END" for w in words) + ")"


sql("intent_questions", f"""WITH {QUESTIONS}, p AS (SELECT *, {", ".join(f"{last_of(tuple(w))} AS at_{k}" for k, w in fixed.TYPE_KEYWORDS)} FROM q)
SELECT qid, CASE WHEN greatest(at_Event, at_Organization, at_Person) < 0 THEN NULL WHEN at_Event >= at_Organization AND at_Event >= at_Person THEN 'Event' WHEN at_Organization >= at_Person THEN 'Organization' ELSE 'Person' END AS wanted,
regexp_matches(question, '{fixed.CO_PARTICIPANT}') OR regexp_matches(question, '{fixed.CO_PARTICIPANT_REVERSED}') AS co,
CASE WHEN regexp_matches(question, '세운|설립|창설|창립|만든|조직한|세웠|창건') THEN 'FOUNDED' ELSE 'PARTICIPATED_IN' END AS relation,
CASE WHEN {any_of("question", fixed.PATH_KEYWORDS)} OR regexp_matches(question, '(참여|세운|창설|설립|속한).*(인물|단체|조직|사건).*(세운|참여|일으킨|창설)') THEN 'path' ELSE 'local' END AS route FROM p""")
SEEDS = f"""WITH {QUESTIONS}, {ALIASES}, hit AS (SELECT qid, question, surface, id, type, row_number() OVER (PARTITION BY qid, id ORDER BY length(surface) DESC, surface) AS k FROM q JOIN al ON contains(question, surface) AND length(surface) >= 2),
sc AS (SELECT *, round(least(1.0, 0.7 + 0.2 + least(1.0, length(surface) / greatest(length(question), 1) * 2) * 0.1), 2) AS score FROM hit WHERE k = 1),
sd AS (SELECT qid, question, surface, id AS node, type, score, row_number() OVER (PARTITION BY qid ORDER BY CASE type WHEN 'Person' THEN 3 WHEN 'Organization' THEN 2 ELSE 1 END DESC, score DESC, length(surface) DESC, surface, id) AS rank FROM sc)"""
sql("link_seeds", f"{SEEDS} SELECT qid, surface, node, type, score, rank FROM sd")
sql("link_mentions", """WITH nm AS (SELECT upper(n_name[1]) || lower(n_name[2:]) AS surface, 'N' || n_nationkey AS id FROM nation UNION ALL VALUES ('the', 'W0'), ('que', 'W1'), ('von', 'W2'))
SELECT id, count(*) AS documents FROM documents JOIN nm ON contains(text, surface) GROUP BY id""")
PARTICLES = "|".join(sorted(fixed.QUESTION_PARTICLES, key=len, reverse=True))
sql("refusal_gate", f"""{SEEDS}, rest AS (SELECT qid, list_reduce([question] || coalesce((SELECT list(surface ORDER BY rank) FROM sd WHERE sd.qid = q.qid), []), lambda t, s: replace(t, s, ' ')) AS r FROM q),
w AS (SELECT DISTINCT qid, unnest(regexp_extract_all(r, '[가-힣]{{2,}}')) AS word FROM rest),
st AS (SELECT qid, word, regexp_replace(word, '^(.+?)(?:{PARTICLES})$', '\\1') AS lazy, CASE WHEN regexp_matches(word, '^.+({"|".join(p for p in fixed.QUESTION_PARTICLES if len(p) == 2)})$') THEN word[:-3] WHEN regexp_matches(word, '^.+({"|".join(p for p in fixed.QUESTION_PARTICLES if len(p) == 1)})$') THEN word[:-2] ELSE word END AS stem FROM w)
SELECT qid, word FROM st WHERE word NOT IN ({", ".join(S.quoted(x) for x in fixed.COMMON_WORDS)}) AND stem NOT IN ({", ".join(S.quoted(x) for x in fixed.COMMON_WORDS)}) AND NOT EXISTS (SELECT 1 FROM al WHERE contains(surface, stem))""")

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
sql("text_chunks", f"""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 650)) AS o FROM documents), c AS (SELECT doc_id, o, {STRIP.format("substring(text, o + 1, 800)")} AS chunk FROM p)
SELECT doc_id AS doc, CAST(o AS INT) AS "offset", CAST(length(chunk) AS INT) AS chars, md5(chunk) AS digest FROM c WHERE length(chunk) >= 40""")
sql("text_sentences", r"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+') AS parts FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^[ \t·\-—=*]+|[ \t·\-—=*]+$', '', 'g')), lambda x: length(x) >= 8 AND NOT starts_with(x, '[문서 ')) AS l FROM s),
u AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS n FROM t) SELECT doc_id, CAST(n AS INT) AS n, md5(sentence) AS digest FROM u""")
sql("text_quotable", rf"""WITH s AS (SELECT item_id, string_split_regex(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
t AS (SELECT item_id, list_filter(list_transform(parts, lambda x: {STRIP.format("x")}), lambda x: length(x) >= 15) AS l FROM s),
u AS (SELECT item_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS n FROM t) SELECT item_id, CAST(n AS INT) AS n, md5(sentence) AS digest FROM u""")
NAMES = S.values(S.NAMES, "name", "nm")
UNIFIED = r"""u AS (SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(name), '[·‧・•ㆍ･‧]', '·', 'g'), '[《》〈〉「」『』"''“”‘’]', '', 'g'), '\s*·\s*', '·', 'g'), '\s+', ' ', 'g')) AS one FROM nm),
b AS (SELECT *, trim(regexp_replace(one, '\s*[(（][^()（）]*[)）]', '', 'g')) AS bare, regexp_replace(regexp_extract(one, '[(（]\s*([一-鿿][一-鿿\s·,、]*)\s*[)）]', 1), '\s+', '', 'g') AS g FROM u),
z AS (SELECT *, trim(CASE WHEN bare <> '' THEN bare ELSE one END, ' ,;·') AS normalized FROM b)"""
ABBREVIATIONS = S.values(list(fixed.ABBREVIATIONS.items()), "short, long", "ab")
sql("text_normalize", f"WITH {NAMES}, {UNIFIED}, {ABBREVIATIONS} SELECT name, nfc_normalize(normalized) AS normalized, CASE WHEN g <> '' THEN g END AS gloss, coalesce(long, normalized) AS full_name FROM z LEFT JOIN ab ON short = normalized")
sql("text_normalization_rules", f"""WITH {NAMES}, {UNIFIED}, h AS (SELECT 'whitespace' AS rule, name FROM z WHERE one <> trim(name) UNION ALL SELECT 'gloss', name FROM z WHERE g <> '' UNION ALL SELECT 'qualifier', name FROM z WHERE bare <> '' AND bare <> one AND g = ''),
e(rule) AS (VALUES ('whitespace'), ('gloss'), ('qualifier'))
SELECT rule, count(name) AS applied, coalesce(min(name), '-') AS example FROM e LEFT JOIN h USING (rule) GROUP BY rule""")
sql("text_rule_report", f"""WITH {NAMES}, {UNIFIED}, {S.values(S.NODES, "name, type, names", "nd")}, {S.values(S.REDIRECTS, "title, named", "rd")}, {S.values(S.MENTIONS, "surface, raw", "mn")}, {ABBREVIATIONS},
c AS (SELECT name || ' → ' || normalized AS example, one <> trim(name) AS w, g <> '' AS g, bare <> '' AND bare <> one AND g = '' AS q FROM z),
s AS (SELECT title, {STRIP.format("regexp_replace(surface, '[(（][^()（）]*[)）]', '', 'g')")} AS surface FROM (SELECT title, unnest(string_split(named, ';')) AS surface FROM rd)),
h AS (SELECT 'whitespace' AS rule, example FROM c WHERE w UNION ALL SELECT 'qualifier', example FROM c WHERE q UNION ALL SELECT 'gloss', example FROM c WHERE g
  UNION ALL SELECT 'particle', raw || ' → ' || surface FROM mn WHERE raw <> surface UNION ALL SELECT 'redirect', surface || ' → ' || title FROM s WHERE surface <> title AND title IN (SELECT name FROM nd)
  UNION ALL SELECT 'abbreviation', short || ' → ' || long FROM ab WHERE long IN (SELECT name FROM nd) UNION ALL SELECT 'spaces', replace(name, ' ', '') || ' → ' || name FROM nd WHERE contains(name, ' ')),
e(turn, rule) AS (VALUES (0, 'whitespace'), (1, 'qualifier'), (2, 'gloss'), (3, 'particle'), (4, 'redirect'), (5, 'abbreviation'), (6, 'spaces'))
SELECT turn, rule, count(example) AS applied, coalesce(min(example), '-') AS example FROM e LEFT JOIN h USING (rule) GROUP BY turn, rule""")
WORDS = S.values(S.WORDS, "word", "w")
sql("text_particles", f"""WITH {WORDS} SELECT word, CASE WHEN regexp_matches(word, '^.+({"|".join(p for p in fixed.QUESTION_PARTICLES if len(p) == 2)})$') THEN word[:-3] WHEN regexp_matches(word, '^.+({"|".join(p for p in fixed.QUESTION_PARTICLES if len(p) == 1)})$') THEN word[:-2] ELSE word END AS stem,
CASE WHEN length(regexp_extract(word, '^(.*?)(?:은|는|이|가|을|를|의|와|과|에서|에게|에|도|으로|로|등)$', 1)) >= 2 THEN regexp_extract(word, '^(.*?)(?:은|는|이|가|을|를|의|와|과|에서|에게|에|도|으로|로|등)$', 1) ELSE word END AS name_stem FROM w""")
sql("text_tokens", "WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 20")
PAGES = S.values(S.PAGES, "title, categories, body, links", "pg")
CUT = fixed.SECTION_CUT.split("(", 1)[1].rsplit(")", 1)[0]
sql("text_body", rf"""WITH {PAGES} SELECT title, CASE WHEN regexp_matches(body, '(?m)^\s*({CUT})\s*$') THEN rtrim(regexp_replace(body, '(?ms)^\s*(?:{CUT})\s*$.*\z', ''), E' \n\t') ELSE body END AS body,
regexp_replace(replace(title, ' ', '_'), '[\\/:*?"<>|]', '_', 'g') || '.md' AS file FROM pg""")
sql("text_evidence", f"""WITH b AS (SELECT item_id, text, {STRIP.format("text")} AS s FROM benchmark)
SELECT item_id, CASE WHEN length(s) > 200 THEN regexp_replace(s[:199], '\\s+$', '') || '…' ELSE s END AS evidence, {STRIP.format("replace(text[:120], chr(10), ' ')")} AS excerpt FROM b""")
sql("text_secrets_masked", f"WITH {S.values(S.SECRETS, 'secret', 's')} SELECT secret, CASE WHEN length(secret) > 10 THEN secret[:3] || '********' || secret[-4:] ELSE repeat('*', length(secret)) END AS masked, regexp_matches(secret, '^sk-[A-Za-z0-9_\\-]{{20,}}$') AS key_like FROM s")
sql("text_json_payload", rf"""WITH {S.values(S.ANSWERS, "answer", "a")}, b AS (SELECT answer, trim(regexp_replace(regexp_replace(trim(answer), '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) AS bare FROM a)
SELECT answer, CASE WHEN regexp_matches(bare, '^[\[{{]') THEN bare WHEN regexp_matches(bare, '(?s)[\[{{].*[\]}}]') THEN regexp_extract(bare, '(?s)([\[{{].*[\]}}])', 1) END AS payload FROM b""")
sql("cache_lookup", """SELECT item_id, sha256('{"model":"m","prompt":"' || item_id || '"}') AS key, CASE WHEN item_id % 2 = 0 THEN 'answer ' || item_id END AS answer FROM benchmark""")


def cased(*rules: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def matched(column: str, pattern: str) -> str:
    return f"regexp_extract({column}, '({pattern})', 1)"


LISTED = f"{PAGES}, pc AS (SELECT *, array_to_string(list_filter(string_split(categories, ';'), lambda x: x <> ''), ' / ') AS blob, trim(regexp_replace(title, '\\s*[(（][^()（）]*[)）]', '', 'g')) AS base, list_filter(string_split(categories, ';'), lambda x: x <> '') AS cats FROM pg)"
_TYPES = (("blob", None, "non_entity", fixed.NON_ENTITY_CATEGORY), ("blob", "Person", "category", fixed.PERSON_CATEGORY), ("base", "Event", "title_suffix", fixed.EVENT_TITLE), ("blob", "Organization", "category", fixed.ORGANIZATION_CATEGORY), ("base", "Organization", "title_suffix", fixed.ORGANIZATION_TITLE), ("blob", "Event", "category", fixed.EVENT_CATEGORY))
TYPE = cased(*((f"regexp_matches({c}, '{p}')", S.quoted(k)) for c, k, _, p in _TYPES))
WHY = cased(*((f"regexp_matches({c}, '{p}')", f"'{label}:' || {matched(c, p)}") for c, _, label, p in _TYPES), otherwise="'unclassified'")
sql("entity_typing", f"WITH {LISTED} SELECT title, {TYPE} AS type, {WHY} AS reason FROM pc")
STOP = ", ".join(S.quoted(x) for x in fixed.STOPWORDS)


def dropped(name: str) -> str:
    return cased((f"contains({name}, '목록') OR contains({name}, '일람')", "'list_page'"), (f"regexp_matches({name}, '{fixed.POSITION_TITLE}')", "'position_title'"), (f"length({name}) < 2", "'too_short'"), (f"{name} IN ({STOP})", "'stopword'"), (rf"regexp_matches({name}, '^[^\p{{L}}]+$')", "'non_entity'"))


sql("entity_admission", f"WITH {S.values(sorted({t for t, *_ in S.PAGES} | set(S.TITLES) | {'A', '12·3', '회장'}), 'title', 't')} SELECT title, {dropped('title')} AS reason FROM t")
sql("entity_inventory", f"""WITH {LISTED}, {ABBREVIATIONS}, y AS (SELECT title, base, coalesce(long, base) AS name, {TYPE} AS type, {WHY} AS why FROM pc LEFT JOIN ab ON short = base),
j AS (SELECT *, coalesce(CASE WHEN type IS NULL THEN why END, {dropped("name")}) AS reason FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY name, type ORDER BY CAST(regexp_matches(title, '[(（]') AS INT), title) AS turn FROM j WHERE reason IS NULL)
SELECT title, CASE WHEN turn > 1 AND base = name AND title <> name THEN title ELSE name END AS name, type, NULL AS reason FROM k UNION ALL SELECT title, NULL, NULL, reason FROM j WHERE reason IS NOT NULL""")
sql("entity_merge", """SELECT c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS type, string_agg(DISTINCT right(c_name, 2), ';' ORDER BY right(c_name, 2)) AS aliases,
string_agg(DISTINCT CAST(c_custkey % 7 AS VARCHAR), ';' ORDER BY CAST(c_custkey % 7 AS VARCHAR)) AS sources, bool_or(c_acctbal > 9000) AS is_doc, arg_min('r' || c_custkey, c_custkey) FILTER (c_custkey % 3 <> 0) AS reason, count(DISTINCT c_custkey % 7) AS doc_count
FROM customer GROUP BY c_mktsegment, c_nationkey""")
sql("io_graph_json", f"""WITH {EDGES} SELECT 'relation' AS kind, relation AS value, count(*) AS n FROM edges GROUP BY relation UNION ALL SELECT 'origin', origin, count(*) FROM edges GROUP BY origin
UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'nodes', 'all', count(*) FROM nodes""")
sql("io_alias_index", f"""WITH {NODES}, a AS (SELECT id, unnest([id] || list_filter(string_split(names, ';'), lambda x: x <> '')) AS surface FROM n)
SELECT surface, coalesce(max(id) FILTER (id = surface), min(id)) AS id FROM a GROUP BY surface""")
sql("io_graphml", f"""WITH {NODES}, {S.values(S.EDGES, "head, relation, tail, confidence, sources", "e")}
SELECT head, h.type AS head_type, relation, tail, t.type AS tail_type, 'rule' AS origin, CAST(confidence AS DOUBLE) AS confidence, sources FROM e JOIN n h ON h.id = head JOIN n t ON t.id = tail""")
sql("io_manifest", """SELECT s_name AS title, CASE WHEN s_acctbal >= 3000 OR s_acctbal IS NULL THEN replace(s_name, ' ', '_') || '.md' END AS file, CASE WHEN s_acctbal >= 3000 OR s_acctbal IS NULL THEN CAST(s_nationkey AS VARCHAR) END AS categories,
CASE WHEN s_acctbal >= 3000 OR s_acctbal IS NULL THEN CAST(s_suppkey AS INT) END AS chars, CASE WHEN s_acctbal < 3000 THEN 'stub' ELSE 'linked' END AS reason FROM supplier""")
sql("io_cache_counters", """WITH b AS (SELECT item_id % 2 = 0 AS hit, right(CAST(item_id AS VARCHAR), 1) = '7' AS bad FROM benchmark)
SELECT count(*) FILTER (hit) AS hit, count(*) FILTER (NOT hit) AS miss, count(*) FILTER (NOT hit AND NOT bad) AS call, count(*) FILTER (NOT hit AND bad) AS error, 0 AS skipped, count(*) FILTER (NOT bad) AS cached_entries FROM b""")
sql("io_documents", f"""WITH {PAGES} SELECT title, array_to_string(list_filter(string_split(categories, ';'), lambda x: x <> ''), ';') AS categories, md5({STRIP.format("body")}) AS digest FROM pg UNION ALL SELECT '', '', md5('no header')""")


def starts(text: str, pattern: str) -> str:
    """Offsets of a pattern's matches: what lies before the i-th match is i gaps and the matches between them."""
    total = lambda parts: f"coalesce(list_sum(list_transform({parts}, lambda x: length(x))), 0)"
    found, gaps = f"regexp_extract_all({text}, {pattern})", f"string_split_regex({text}, {pattern})"
    return f"list_transform(range(1, len({found}) + 1), lambda i: CAST({total(f'{gaps}[1:i]')} + {total(f'{found}[1:i - 1]')} AS INT))"


def surfaces(extra: dict[str, tuple[str, str]]) -> str:
    """The sample's surface table as rows of SQL."""
    known = {x: (i, t) for i, t, names in S.NODES for x in [i, *filter(None, names.split(";"))]} | extra
    return S.values([(x, *v) for x, v in known.items()], "surface, name, type", "sf")


def mentions() -> str:
    """ms: the mentions of tx (title, ord, sentence) by the surfaces of sf, the longest first, that stand between the boundaries of names."""
    ends = f"^{fixed.NAME_SUFFIX}{fixed.NAME_PARTICLE}([^가-힣]|$)"
    return rf"""px AS (SELECT string_agg(surface, '|' ORDER BY length(surface) DESC, surface) AS every FROM sf),
mf AS (SELECT tx.*, regexp_extract_all(sentence, every) AS found, {starts("sentence", "every")} AS places FROM tx, px),
mu AS (SELECT title, ord, sentence, unnest(found) AS surface, unnest(places) AS start FROM mf),
ms AS (SELECT mu.*, CAST(start + length(surface) AS INT) AS "end", sf.name, sf.type FROM mu JOIN sf USING (surface)
  WHERE NOT regexp_matches(CASE WHEN start > 0 THEN substring(sentence, start, 1) ELSE '' END, '[가-힣A-Za-z0-9]') AND regexp_matches(substring(sentence, start + length(surface) + 1), '{ends}'))"""


sql("mention_spans", f"""WITH {PAGES}, {surfaces({})}, tx AS (SELECT title, 0 AS ord, body AS sentence FROM pg), {mentions()}
SELECT title, start, "end", surface, name, type FROM ms""")


def near(verbs: str, end: str, most: int) -> str:
    return f"len(list_filter({verbs}, lambda v: v BETWEEN {end} AND {end} + {most})) > 0"


def pair_rule(heads: str, relation: str, tails: str, fits: str, confidence: float, extractor: str) -> str:
    return f"""SELECT h.name AS head, '{relation}' AS relation, t.name AS tail, {confidence} AS confidence, '{extractor}' AS extractor, h.title AS source, h.sentence FROM mm h JOIN mm t USING (title, ord)
WHERE h.type IN ({heads}) AND t.type IN ({tails}) AND {fits}"""


def document_rule(kinds: str, alone: str, others: str, fits: str, relation: str, confidence: str, extractor: str, first: bool) -> str:
    head, tail = ("title", "name") if first else ("name", "title")
    return f"""SELECT {head} AS head, '{relation}' AS relation, {tail} AS tail, {confidence} AS confidence, {extractor} AS extractor, title AS source, sentence FROM mm
WHERE kind IN ({kinds}) AND NOT own AND type IN ({others}) AND NOT EXISTS (SELECT 1 FROM mm o WHERE o.title = mm.title AND o.ord = mm.ord AND NOT o.own AND o.type IN ({alone})) AND {fits}"""


PERSON, GROUP, EVENT = "'Person'", "'Organization'", "'Event'"
GAP = 'substring(h.sentence, h."end" + 1, list_filter(h.found_p, lambda v: v BETWEEN h."end" AND h."end" + 30)[1] - h."end")'
STRONG = "len(part_a) + len(part_p) > 0"
RULES = " UNION ALL ".join([
    pair_rule(f"{PERSON}, {GROUP}", "FOUNDED", f"{GROUP}, {EVENT}", f"""h.start < t.start AND h.subject AND t.object AND {near("t.found_a", 't."end"', 25)}""", 0.88, "rule_founded_v1_active"),
    pair_rule(f"{PERSON}, {GROUP}", "FOUNDED", f"{GROUP}, {EVENT}", f"""h.agent AND t.start < h.start AND {near("h.found_p", 'h."end"', 30)} AND ({GAP} = '' OR regexp_matches({GAP}, '{fixed.AGENT_MARKER}'))""", 0.80, "rule_founded_v2_passive"),
    pair_rule(f"{PERSON}, {GROUP}, {EVENT}", "PARTICIPATED_IN", f"{EVENT}, {GROUP}", f"""h.start < t.start AND h.subject AND {near("t.part_a", 't."end"', 30)}""", 0.88, "rule_participated_v1_active"),
    pair_rule(f"{PERSON}, {GROUP}, {EVENT}", "PARTICIPATED_IN", f"{EVENT}, {GROUP}", f"""t.place AND t.start < h.start AND h.subject AND {near("h.part_a", 'h."end"', 40)}""", 0.75, "rule_participated_v2_locative"),
    document_rule(GROUP, GROUP, PERSON, f"""NOT oblique AND {near("found_a", '"end"', 30)}""", "FOUNDED", "0.82", "'rule_founded_v3_doc_org'", False),
    document_rule(GROUP, GROUP, PERSON, f"""agent AND NOT oblique AND NOT ({near("found_a", '"end"', 30)}) AND {near("found_p", '"end"', 30)}""", "FOUNDED", "0.74", "'rule_founded_v3p_doc_org_passive'", False),
    document_rule(PERSON, PERSON, GROUP, f"""object AND {near("found_a", '"end"', 20)}""", "FOUNDED", "0.80", "'rule_founded_v4_doc_person'", True),
    document_rule(EVENT, EVENT, f"{PERSON}, {GROUP}", f"({STRONG} OR role)", "PARTICIPATED_IN", f"CASE WHEN {STRONG} THEN 0.80 ELSE 0.68 END", f"CASE WHEN {STRONG} THEN 'rule_participated_v3_doc_event' ELSE 'rule_participated_v5_doc_event_role' END", False),
    document_rule(f"{PERSON}, {GROUP}", f"{PERSON}, {GROUP}", EVENT, near("part_a", '"end"', 25), "PARTICIPATED_IN", "0.80", "'rule_participated_v4_doc_entity'", True),
])
def extraction() -> str:
    """ex: what the rules find in bd (title, kind, body) with the surfaces of sf."""
    return rf"""sp AS (SELECT title, string_split_regex(regexp_replace(body, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+') AS parts FROM bd),
sl AS (SELECT title, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^[ \t·\-—=*]+|[ \t·\-—=*]+$', '', 'g')), lambda x: length(x) >= 8 AND NOT starts_with(x, '[문서 ')) AS l FROM sp),
tx AS (SELECT title, unnest(l) AS sentence, generate_subscripts(l, 1) AS ord FROM sl), {mentions()},
mr AS (SELECT ms.*, kind, name = title AND type = kind AS own, regexp_replace(substring(sentence, "end" + 1), '{fixed.GLOSS_AFTER}', '') AS rest FROM ms JOIN (SELECT title, kind FROM bd) USING (title)),
mm AS (SELECT *, NOT regexp_matches(rest, '{fixed.NOT_SUBJECT}') AND (regexp_matches(rest, '{fixed.LISTED_SUBJECT}') OR (NOT regexp_matches(rest, '{fixed.OBJECT_PARTICLE}') AND regexp_matches(rest, '{fixed.SUBJECT_MARK}'))) AS subject,
  NOT regexp_matches(rest, '{fixed.NOT_OBJECT}') AND (regexp_matches(rest, '{fixed.OBJECT_MARK}') OR starts_with(rest, ' ')) AS object, regexp_matches(rest, '{fixed.OBLIQUE}') AS oblique, regexp_matches(substring(sentence, "end" + 1, 2), '{fixed.LOCATIVE}') AS place,
  regexp_matches(sentence, '{fixed.AGENT_MARKER}') AS agent, regexp_matches(sentence, '{fixed.PART_ROLE}') AS role,
  {starts("sentence", S.quoted(fixed.FOUND_ACTIVE))} AS found_a, {starts("sentence", S.quoted(fixed.FOUND_PASSIVE))} AS found_p, {starts("sentence", S.quoted(fixed.PART_ACTIVE))} AS part_a, {starts("sentence", S.quoted(fixed.PART_PASSIVE))} AS part_p FROM mr),
al AS ({RULES}),
ex AS (SELECT head, relation, tail, CAST(confidence AS DOUBLE) AS confidence, extractor, source, CASE WHEN length({STRIP.format("sentence")}) > 200 THEN regexp_replace({STRIP.format("sentence")}[:199], '\s+$', '') || '…' ELSE {STRIP.format("sentence")} END AS evidence FROM al)"""


sql("extract_edges", rf"""WITH {PAGES}, {surfaces({"안창호": ("안창호", "Person"), "신민회": ("신민회", "Organization")})}, dk(title, kind) AS (VALUES ('안중근', 'Person'), ('청산리 전투', 'Event'), ('신민회', 'Organization')),
bd AS (SELECT title, kind, CASE WHEN regexp_matches(body, '(?m)^\s*({CUT})\s*$') THEN rtrim(regexp_replace(body, '(?ms)^\s*(?:{CUT})\s*$.*\z', ''), E' \n\t') ELSE body END AS body FROM pg JOIN dk USING (title)),
{extraction()} SELECT head, relation, tail, confidence, extractor, source, evidence FROM ex""")
sql("extract_rules", f"""WITH {S.values(S.RULE_BODIES, "title, kind, body", "bd")}, {surfaces({})}, {extraction()} SELECT head, relation, tail, confidence, extractor, source, evidence FROM ex""")

sql("build_graph", rf"""WITH {S.values(S.PAGES, "title, categories, body, links", "p0")}, {S.values(S.GAZETTEER, "title, categories", "gz")},
pg AS (SELECT title, categories, body, TRUE AS is_doc FROM p0 UNION ALL SELECT title, categories, NULL, FALSE FROM gz WHERE title NOT IN (SELECT title FROM p0)){LISTED.removeprefix(PAGES)}, {ABBREVIATIONS},
y AS (SELECT title, body, cats, is_doc, base, coalesce(long, base) AS name, {TYPE} AS type FROM pc LEFT JOIN ab ON short = base),
k AS (SELECT *, row_number() OVER (PARTITION BY name, type ORDER BY CAST(regexp_matches(title, '[(（]') AS INT), title) AS turn FROM y WHERE type IS NOT NULL AND {dropped("name")} IS NULL),
en AS (SELECT title, body, cats, is_doc, type, CASE WHEN turn > 1 AND base = name AND title <> name THEN title ELSE name END AS name FROM k),
cl AS (SELECT title, type, name, unnest([name, replace(name, ' ', '')]) AS surface FROM en),
sf AS (SELECT surface, arg_min(name, title) AS name, arg_min(type, title) AS type FROM cl WHERE length(surface) >= 2 AND surface NOT IN ({STOP}) GROUP BY surface),
bd AS (SELECT name AS title, type AS kind, CASE WHEN regexp_matches(body, '(?m)^\s*({CUT})\s*$') THEN rtrim(regexp_replace(body, '(?ms)^\s*(?:{CUT})\s*$.*\z', ''), E' \n\t') ELSE body END AS body FROM en WHERE is_doc),
{extraction()},
ct AS (SELECT name, type, trim(regexp_replace(unnest(cats), '\s*[(（][^()（）]*[)）]', '', 'g')) AS category FROM en WHERE is_doc AND type IN ('Person', 'Organization')),
ca AS (SELECT head, relation, tail, confidence, extractor, source FROM ex UNION ALL
  SELECT ct.name, 'PARTICIPATED_IN', ev.name, 0.9, 'rule_cat_participated_v6', ct.name FROM ct LEFT JOIN ab ON short = category JOIN (SELECT DISTINCT name FROM en WHERE type = 'Event') ev ON ev.name = coalesce(long, category)),
kd AS (SELECT DISTINCT name, type FROM sf UNION SELECT DISTINCT name, type FROM en)
SELECT head, relation, tail, 'rule' AS origin, max(confidence) AS confidence, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, string_agg(DISTINCT extractor, ';' ORDER BY extractor) AS extractors FROM ca JOIN kd h ON h.name = head JOIN kd t ON t.name = tail
WHERE head <> tail AND h.type || '|' || relation || '|' || t.type IN ('Person|PARTICIPATED_IN|Event', 'Person|FOUNDED|Organization', 'Organization|PARTICIPATED_IN|Event') GROUP BY head, relation, tail""")

sql("discovered_entities", "SELECT * FROM (VALUES ('자유시 참변', 'Event', 3), ('대한청년회', 'Organization', 2), ('자강단', 'Organization', 3)) v(name, type, doc_support)")
sql("gloss_aliases", "SELECT * FROM (VALUES ('安重根', '안중근', 'Person'), ('金九', '김구', 'Person')) v(surface, id, type)")

GRAMS = r"""(SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '\s+'), lambda x: x <> '')) AS w FROM {source})"""


def grams(key: str, text: str, source: str) -> str:
    """(key, gram) with repeats: words padded by a space on either side."""
    padded = f"(SELECT {key}, ' ' || w || ' ' AS p FROM {GRAMS.format(key=key, text=text, source=source)})"
    return " UNION ALL ".join(f"SELECT {key}, substring(p, i, {n}) AS gram FROM (SELECT {key}, p, unnest(range(1, greatest(length(p) - {n} + 1, 1) + 1)) AS i FROM {padded} WHERE length(p) >= {n})" for n in (2, 3, 4))


CHUNKS = f"""ck AS (SELECT doc, o, chunk FROM (SELECT item_id AS doc, o, {STRIP.format("substring(text, o + 1, 800)")} AS chunk FROM (SELECT item_id, text, unnest(range(0, length(text), 650)) AS o FROM benchmark)) WHERE length(chunk) >= 40),
cg AS (SELECT doc, o, gram, 1 + ln(count(*)) AS tf FROM ({grams("doc, o", "chunk", "ck")}) GROUP BY doc, o, gram)"""
sql("tfidf_df", f"WITH {CHUNKS} SELECT gram, count(*) AS df FROM cg GROUP BY gram")
ASKED = "ask AS (SELECT conv_id AS qid, text AS question FROM conversations WHERE turn = 0)"
RANKED = f"""WITH {CHUNKS}, {ASKED}, idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM ck)) / (1 + count(*))) + 1 AS idf FROM cg GROUP BY gram),
wt AS (SELECT doc, o, gram, tf * idf AS w FROM cg JOIN idf USING (gram)), nr AS (SELECT doc, o, sqrt(sum(w * w)) AS n FROM wt GROUP BY doc, o),
qg AS (SELECT qid, gram, (1 + ln(count(*))) AS tf FROM ({grams("qid", "question", "ask")}) GROUP BY qid, gram), qw AS (SELECT qid, gram, tf * idf AS w FROM qg JOIN idf USING (gram)), qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qw GROUP BY qid),
sc AS (SELECT qid, doc, o, round(sum(wt.w * qw.w) / (any_value(nr.n) * any_value(qn.n)), 6) AS score FROM wt JOIN qw USING (gram) JOIN nr USING (doc, o) JOIN qn USING (qid) GROUP BY qid, doc, o),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, o) AS rank FROM sc)"""
sql("tfidf_topk", f'{RANKED} SELECT qid, doc, CAST(o AS INT) AS "offset", round(score, 4) AS score FROM rk WHERE rank <= 5 AND score > 0.001')



def stem(word: str) -> str:
    """A question's word without its particle."""
    ends = {n: "|".join(p for p in fixed.QUESTION_PARTICLES if len(p) == n) for n in (2, 1)}
    return f"CASE WHEN regexp_matches({word}, '^.+({ends[2]})$') THEN {word}[:-3] WHEN regexp_matches({word}, '^.+({ends[1]})$') THEN {word}[:-2] ELSE {word} END"


sql("tfidf_answers", rf"""{RANKED}, ht AS (SELECT qid, doc, o, rank FROM rk WHERE rank <= 5 AND score > 0.001),
rw AS (SELECT qid, rank, doc, chunk, list_distinct(raw || list_transform(raw, lambda x: {stem("x")})) AS keys FROM ht JOIN ck USING (doc, o) JOIN (SELECT qid, regexp_extract_all(question, '[가-힣A-Za-z0-9]{{2,}}') AS raw FROM ask) USING (qid)),
cu AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(chunk, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: length(x) >= 15) AS l FROM rw),
se AS (SELECT qid, rank, doc, keys, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM cu),
hs AS (SELECT *, len(list_filter(keys, lambda x: contains(sentence, x))) AS hits FROM se),
pl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, rank, pos) AS n FROM hs WHERE hits > 0),
qt AS (SELECT qid, n, '- [' || doc || '] ' || sentence AS line FROM (SELECT *, min(n) OVER (PARTITION BY qid, sentence) AS earliest FROM pl WHERE n <= 4) WHERE n = earliest),
ln AS (SELECT * FROM qt UNION ALL SELECT qid, rank, '- [' || doc || '] ' || {STRIP.format("replace(chunk[:300], chr(10), ' ')")} || '...' FROM rw WHERE rank <= 2 AND qid NOT IN (SELECT qid FROM qt)),
al AS (SELECT qid, string_agg(line, chr(10) ORDER BY n) AS lines FROM ln GROUP BY qid),
sr AS (SELECT qid, string_agg(CAST(doc AS VARCHAR), ';' ORDER BY best) AS sources FROM (SELECT qid, doc, min(rank) AS best FROM ht GROUP BY qid, doc) GROUP BY qid)
SELECT qid, CASE WHEN sources IS NULL THEN {S.quoted(fixed.NOTHING_FOUND)} ELSE {S.quoted(fixed.QUOTED)} || coalesce(lines, '') END AS answer, sources FROM ask LEFT JOIN sr USING (qid) LEFT JOIN al USING (qid)""")

LINKS = "lk AS (SELECT user_id % 16 AS seed, event_type || '-' || CAST(floor(value) AS BIGINT) AS target FROM events)"
sql("funnel_link_support", f"WITH {LINKS} SELECT target, count(DISTINCT seed) AS support FROM lk GROUP BY target HAVING count(DISTINCT seed) >= 2")
NOISE = "(" + " OR ".join([f"contains({{0}}, '{w}')" for w in fixed.CATEGORY_NOISE] + [f"regexp_matches({{0}}, '{p}')" for p in fixed.GENERIC_CATEGORIES]) + ")"
AFTER = "regexp_replace(category, '^[^:]*:', '')"
CATEGORIES = S.values(S.CATEGORIES, "category", "ct")
sql("funnel_noise_category", f"WITH {CATEGORIES} SELECT category, {NOISE.replace('{0}', AFTER)} AS noise FROM ct")
sql("funnel_shared_category", f"""WITH {CATEGORIES}, a AS (SELECT lang AS seed, source AS category FROM documents UNION ALL SELECT s, category FROM ct, (VALUES ('en'), ('de')) v(s))
SELECT category, count(DISTINCT seed) AS seeds FROM a WHERE NOT {NOISE.replace("{0}", AFTER)} GROUP BY category HAVING count(DISTINCT seed) >= 2""")
sql("funnel_category_overlap", "WITH p AS (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) >= 4) SELECT lang AS title, count(DISTINCT source) AS overlap FROM documents WHERE source IN (SELECT source FROM p) GROUP BY lang")
BLOCK = cased(*((f"regexp_matches(title, {S.quoted(p)})", S.quoted(r)) for p, r in fixed.TITLE_BLOCKS))
sql("funnel_title_block", f"WITH {S.values(S.TITLES, 'title', 't')} SELECT title, {BLOCK} AS reason FROM t")


def number_of(pattern: str) -> str:
    return f"len(list_filter(cats, lambda x: regexp_matches(x, '{pattern}')))"


def year(pattern: str) -> str:
    return f"TRY_CAST(regexp_extract(list_filter(cats, lambda x: regexp_matches(x, '{pattern}'))[-1], '{pattern}', 1) AS INT)"


SCOPE = cased(
    (f"{year(fixed.DIED)} < 1890", "'out_of_period_before'"), (f"{year(fixed.BORN)} > 1945", "'out_of_period_after'"), (f"{year(fixed.BORN)} < 1820", "'out_of_period_before'"), (f"{number_of(fixed.CORE_TOPIC)} = 0", "'not_independence_topic'"),
    (f"{number_of(fixed.STRONG_ACTIVIST)} = 0 AND {number_of(fixed.ARTS_IDENTITY)} >= 3 AND {number_of(fixed.ARTS_IDENTITY)} > {number_of(fixed.CORE_TOPIC)}", "'arts_identity_dominant'"),
    (f"{number_of(fixed.POST_LIBERATION)} > 0 AND {number_of(fixed.ACTIVIST_CAT)} = 0", "'post_liberation_office_holder'"),
    (f"len(list_filter(cats, lambda x: regexp_matches(x, '{fixed.FOREIGN_CAT}') AND NOT regexp_matches(x, '{fixed.KOREAN_MARKER}'))) >= 3 AND {number_of(fixed.FOREIGN_EXEMPT)} = 0", "'foreign_non_participant'"),
)
sql("funnel_scope", f"WITH {LISTED} SELECT title, {SCOPE} AS reason FROM pc")
SELECTED = f"""WITH {LISTED}, r AS (SELECT title, links, len(cats) AS overlap, CASE WHEN links < 2 THEN 'few_links' ELSE coalesce({BLOCK}, CASE WHEN len(cats) < 1 THEN 'no_shared_category' END, {SCOPE}, CASE WHEN title = '신민회' THEN 'fetch_failed' WHEN length(title) * 300 < 800 THEN 'stub' END) END AS reason FROM pc),
k AS (SELECT title, row_number() OVER (ORDER BY overlap DESC, links DESC, title) AS n FROM r WHERE reason IS NULL),
sl AS (SELECT title, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT title, CASE WHEN n > 2 THEN 'over_quota' END FROM k)"""
sql("funnel_selected", f"{SELECTED} SELECT title, reason FROM sl")
sql("funnel_collected", f"""WITH sp AS (SELECT 'S' || s_suppkey AS title, '의병 ' || (s_nationkey % 4) AS category, 700 + s_suppkey % 7 * 100 AS chars FROM supplier),
pp AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN '목록 ' ELSE '' END || 'P' || p_partkey AS title, p_partkey % 97 * 20 AS chars,
  CASE WHEN p_size % 7 <> 3 THEN list_sort(list_distinct(['의병 ' || (p_size % 6)] || CASE WHEN p_partkey % 3 = 0 THEN ['의병 1'] ELSE [] END || CASE WHEN p_size % 5 = 0 THEN ['1950년 태어남'] ELSE [] END)) END AS cats FROM part),
lk AS (SELECT CASE WHEN l_partkey % 11 = 0 THEN '목록 ' ELSE '' END || 'P' || l_partkey AS title, count(DISTINCT l_suppkey) AS support FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1),
pool AS (SELECT category FROM sp GROUP BY category HAVING count(*) >= 2),
j AS (SELECT title, support, coalesce(len(list_intersect(cats, (SELECT list(category) FROM pool))), 0) AS overlap, cats, chars FROM lk LEFT JOIN pp USING (title)),
y AS (SELECT *, CASE WHEN support < 2 THEN 'few_links' ELSE coalesce({BLOCK}, CASE WHEN cats IS NULL THEN 'no_category_data' WHEN overlap < 1 THEN 'no_shared_category' END, {SCOPE}) END AS early, CASE WHEN coalesce(chars, 0) = 0 THEN 'fetch_failed' WHEN chars < 800 THEN 'stub' END AS late FROM j),
sd AS (SELECT title, CASE WHEN chars < 800 THEN 'stub' END AS reason FROM sp UNION ALL SELECT n_name, 'seed_missing' FROM nation),
o AS (SELECT *, coalesce(sum(CASE WHEN late IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY overlap DESC, support DESC, title ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM y WHERE early IS NULL)
SELECT title, 0 AS hop, NULL AS support, NULL AS overlap, reason FROM sd UNION ALL SELECT title, 2, support, overlap, early FROM y WHERE early IS NOT NULL
UNION ALL SELECT title, 2, support, overlap, CASE WHEN taken >= 900 - (SELECT count(*) FROM sd WHERE reason IS NULL) THEN 'over_quota' ELSE late END FROM o""")
sql("funnel_pruned", f"WITH {LISTED} SELECT title, coalesce({SCOPE}, CASE WHEN length(title) * 300 < 800 THEN 'stub' END) AS reason FROM pc")
sql("funnel_expanded", f"WITH {LINKS} SELECT target, count(DISTINCT seed) AS support, CASE WHEN count(DISTINCT seed) < 3 THEN 'few_links' END AS reason, TRUE AS expanded FROM lk WHERE seed < 8 GROUP BY target HAVING count(DISTINCT seed) >= 2")
sql("reject_histogram", f"{SELECTED} SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM sl WHERE reason IS NOT NULL GROUP BY 1")
sql("reject_update", """WITH l AS (SELECT s_name AS title, CASE WHEN s_acctbal < 0 THEN 'debt: account' ELSE 'other: none' END AS reason FROM supplier),
o AS (SELECT * FROM l WHERE reason LIKE 'debt%' AND title NOT LIKE '%1') SELECT title, reason FROM o UNION ALL SELECT title, 'again' FROM l WHERE title LIKE '%2' AND title NOT IN (SELECT title FROM o)""")
sql("title_union", "SELECT n_name AS title, TRUE AS is_doc FROM nation UNION ALL SELECT r_name, FALSE FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")

ACCURACY = """CASE WHEN len(list_filter({e}, lambda x: contains(replace({a}, ' ', ''), replace(x, ' ', '')))) > 0 THEN 1.0
WHEN len(list_filter({e}, lambda x: length(trim(x)) >= 3 AND len(list_filter(range(1, length(trim(x))), lambda i: contains({a}, substring(trim(x), i, 2)))) > 0)) > 0 THEN 0.5 ELSE 0.0 END"""
GOLDEN = EDGES + f""",
it AS (SELECT 'G' || c_custkey AS item_id, CAST(c_custkey % 3 + 1 AS INT) AS hops, [c_mktsegment, c_name] AS expected, c_custkey % 11 <> 0 AS answerable,
  CASE WHEN c_custkey % 5 = 0 THEN 'It is ' || lower(c_mktsegment) WHEN c_custkey % 5 = 1 THEN 'none, BUx' ELSE 'It is ' || regexp_replace(c_mktsegment, '(.)', '\\1 ', 'g') END AS answer, c_custkey % 2 = 0 AS refused FROM customer),
ex AS (SELECT item_id, e.tail AS n, head, relation, CASE WHEN e.tail LIKE '%7' THEN 'P-none' ELSE e.tail END AS tail FROM edges e JOIN it ON item_id = 'G' || head[2:] WHERE head_type = 'Person' AND answerable AND confidence > 0.97),
cx AS (SELECT DISTINCT 'G' || head[2:] AS item_id, head, relation, tail FROM edges WHERE confidence < 0.995),
eh AS (SELECT ex.*, cx.head IS NOT NULL AS hit FROM ex LEFT JOIN cx USING (item_id, head, relation, tail)),
eg AS (SELECT ex.*, g.head IS NOT NULL AS hit FROM ex LEFT JOIN (SELECT head, relation, tail FROM edges) g USING (head, relation, tail)),
rc AS (SELECT it.item_id, coalesce(round(avg(CAST(hit AS INT)), 3), 1.0) AS recall FROM it LEFT JOIN eh USING (item_id) GROUP BY it.item_id),
sc AS (SELECT it.*, recall, CASE WHEN answerable THEN {ACCURACY.format(e="expected", a="answer")} END AS accuracy, CASE WHEN answerable THEN {ACCURACY.format(e="expected", a="upper(answer)")} END AS control_accuracy FROM it JOIN rc USING (item_id)),
ly AS (SELECT *, CASE WHEN answerable AND (accuracy < 1 OR recall < 1) THEN CASE WHEN item_id IN (SELECT item_id FROM eg WHERE NOT hit) THEN 'index' WHEN item_id IN (SELECT item_id FROM eh WHERE NOT hit) THEN 'retrieval' ELSE 'generation' END END AS layer FROM sc)"""
sql("eval_answer_acc", f"WITH {GOLDEN} SELECT item_id, CAST({ACCURACY.format(e='expected', a='answer')} AS DOUBLE) AS accuracy FROM it")
sql("eval_path_recall", f"WITH {GOLDEN} SELECT item_id, recall FROM rc")
sql("eval_by_hop", f"WITH {GOLDEN} SELECT hops, count(*) AS n, round(avg(accuracy), 3) AS accuracy, round(avg(recall), 3) AS recall, round(avg(control_accuracy), 3) AS control_accuracy FROM sc WHERE answerable GROUP BY hops")
sql("eval_overall", f"WITH {GOLDEN} SELECT count(*) FILTER (answerable) AS answerable, round(avg(accuracy), 3) AS accuracy, round(avg(control_accuracy), 3) AS control_accuracy, round(avg(CAST(refused AS INT)) FILTER (NOT answerable), 3) AS refusal_accuracy, count(*) FILTER (NOT answerable AND NOT refused) AS hallucinations FROM sc")
sql("eval_failure_layer", f"WITH {GOLDEN}, a(layer) AS (VALUES ('index'), ('retrieval'), ('generation')) SELECT layer, count(item_id) AS items FROM a LEFT JOIN ly USING (layer) GROUP BY layer")
sql("eval_missing_triples", f"WITH {GOLDEN} SELECT item_id, head, relation, tail FROM eg WHERE NOT hit")
sql("eval_golden_report", f"WITH {GOLDEN} SELECT item_id, hops, count(head) AS triples, count(head) FILTER (hit) AS present, count(head) = count(head) FILTER (hit) AS ok FROM it LEFT JOIN eg USING (item_id) WHERE answerable GROUP BY item_id, hops")
