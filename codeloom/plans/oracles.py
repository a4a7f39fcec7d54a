"""SQL for the queries over the lifted graph, written on its own terms: recursion where the operators loop."""

from __future__ import annotations

from ..functions.notation import SYMBOLS
from ..functions.scores import EDGE_CONFIDENCE
from ..functions.semantics import INTENTS, STOP_TOKENS, SUBJECT_SUFFIXES, VIEW_SUFFIXES
from ..operators import reachability as R
from ..schema import DEPENDENCY_EDGES, EDGE_TYPES, HIGH_RISK_TYPES, REVIEW_TYPES, TERMINAL_TYPES, TRACE_PRIORITY
from . import lifted

ORACLES: dict[str, str] = {}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_N, _E, _S, _D = (lifted.plain(x) for x in (lifted.NODES, lifted.EDGES, lifted.SUPPLY, lifted.DIFFS))
_GRAPH = f"nodes AS ({_N}), edges AS ({_E})"
_ID = "'edge:' || substr(sha256(source || chr(31) || type || chr(31) || target), 1, 16)"
_ENDS = "SELECT source AS id FROM edges UNION ALL SELECT target FROM edges"
_PRIORITY = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TRACE_PRIORITY)) + f" ELSE {len(TRACE_PRIORITY)} END"


def _sym(role: str) -> str:
    return f"coalesce(CASE {role} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYMBOLS.items()) + " END, '?')"


def _role(via: str, kind: str) -> str:
    return f"CASE {via} WHEN 'SERIALIZER_ENTANGLEMENT' THEN 'TRANSFORM' WHEN 'PARTICLE_ENTANGLEMENT' THEN 'PARTICLE' WHEN 'AJAX' THEN 'PROPAGATOR_AJAX' ELSE coalesce({kind}, 'MEDIATOR') END"


def _label(c: str, names=("high", "medium", "low")) -> str:
    return f"CASE WHEN {c} >= 0.8 THEN '{names[0]}' WHEN {c} >= 0.55 THEN '{names[1]}' ELSE '{names[2]}' END"


_STATUS = ("strong_candidate", "likely_candidate", "possible_candidate")

ORACLES["normalize_edges"] = f"""WITH edges AS ({_E})
SELECT edge_idx, {_ID} AS id, source, target, type, CASE WHEN confidence IS NOT NULL THEN round(least(1.0, greatest(0.0, confidence * 1.06::DOUBLE)), 4) END AS confidence, 0 AS evidence_count FROM edges"""
ORACLES["normalize_nodes"] = f"""WITH nodes AS ({_N})
SELECT node_idx, id, id AS name, id AS qualified_name, type, file, coalesce(line_start, -1) AS line_start, file AS meta_file, 'true' AS flag FROM nodes"""
ORACLES["validate_missing_refs"] = f"""WITH {_GRAPH}, kept AS (SELECT id FROM nodes WHERE type <> 'MEDIATOR')
SELECT 'warning' AS severity, 'missing_source' AS kind, count(*) AS n, min('edge ' || {_ID} || ' references missing source ''' || source || '''') AS first_message FROM edges WHERE source NOT IN (SELECT id FROM kept)
UNION ALL SELECT 'warning', 'missing_target', count(*), min('edge ' || {_ID} || ' references missing target ''' || target || '''') FROM edges WHERE target NOT IN (SELECT id FROM kept)"""
ORACLES["duplicate_ids"] = f"WITH e AS ({_S}) SELECT {_ID} AS id FROM e GROUP BY 1 HAVING count(*) > 1"
ORACLES["node_type_counts"] = f"WITH nodes AS ({_N}) SELECT type, count(*) AS n FROM nodes GROUP BY type"
ORACLES["degree_top5"] = f"WITH {_GRAPH} SELECT id, count(*) AS degree FROM ({_ENDS}) GROUP BY id ORDER BY degree DESC, id LIMIT 5"
ORACLES["isolated_nodes"] = f"WITH {_GRAPH} SELECT id FROM nodes EXCEPT ({_ENDS})"
ORACLES["overview_totals"] = f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM (SELECT id FROM nodes EXCEPT ({_ENDS}))) AS isolated_count"
ORACLES["neighbors_1hop"] = f"""WITH {_GRAPH}, own AS (SELECT id FROM nodes WHERE type = 'PARTICLE')
SELECT DISTINCT id, target AS neighbour, 'out' AS direction, type FROM edges JOIN own ON source = id
UNION SELECT DISTINCT id, source, 'in', type FROM edges JOIN own ON target = id"""
ORACLES["first_edge_by_type"] = f"WITH e AS ({_S} UNION ALL {_E}) SELECT source, type, arg_min(target, edge_idx) AS target FROM e GROUP BY source, type"
ORACLES["targets_by_type"] = f"WITH e AS ({_E}) SELECT source, string_agg(target, ',' ORDER BY edge_idx) AS targets FROM e WHERE type = 'PARTICLE_ENTANGLEMENT' GROUP BY source"
ORACLES["edge_priority_rank"] = f"WITH e AS ({_E}) SELECT edge_idx, source, (row_number() OVER (PARTITION BY source ORDER BY {_PRIORITY}, target, edge_idx))::INT AS rank FROM e"
ORACLES["impact_edge_rank"] = f"WITH e AS ({_E}) SELECT edge_idx, target, (row_number() OVER (PARTITION BY target ORDER BY source, type, edge_idx))::INT AS rank FROM e"
ORACLES["edge_dedup_first"] = f"WITH e AS ({_S}) SELECT min(edge_idx) AS edge_idx, source, target, type FROM e GROUP BY source, target, type"
ORACLES["node_upsert"] = f"""WITH nodes AS ({_N}), e AS ({_S}), r AS (SELECT node_idx, id, type, false AS imported FROM nodes UNION ALL SELECT edge_idx, source, 'UNKNOWN', true FROM e)
SELECT min(node_idx) AS node_idx, id, coalesce(max(type) FILTER (WHERE NOT imported), 'UNKNOWN') AS type, bool_and(imported) AS imported FROM r GROUP BY id"""
_CLOSURE = f"""WITH RECURSIVE {_GRAPH}, links AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
seen AS (SELECT id FROM nodes WHERE type = 'PARTICLE' UNION SELECT b FROM seen JOIN links ON id = a)"""
ORACLES["component_closure"] = f"{_CLOSURE} SELECT id FROM seen"
ORACLES["subgraph_reduction"] = f"""{_CLOSURE}, c AS (SELECT (SELECT count(*) FROM nodes WHERE id IN (SELECT id FROM seen)) AS nodes, (SELECT count(*) FROM edges WHERE source IN (SELECT id FROM seen)) AS edges, (SELECT count(*) FROM nodes) AS total)
SELECT nodes, edges, round((1 - nodes / total) * 100, 4) AS reduction FROM c"""


def _paths(depth: int, kind: str = "type", roots: str = "type IN ('VERTEX', 'FRONTEND')") -> str:
    """The tables ``done`` (all paths) and ``numbered``."""
    return f"""WITH RECURSIVE {_GRAPH}, kinds AS (SELECT id, {kind} AS kind FROM nodes),
steps AS (SELECT source, target, type, (row_number() OVER (PARTITION BY source ORDER BY {_PRIORITY}, target, edge_idx))::INT AS rank FROM edges),
walk AS (
  SELECT k.id AS root, k.id AS cur, [k.id] AS ids, []::INT[] AS key, ''::VARCHAR AS via, []::VARCHAR[] AS vias, 0 AS depth, k.kind, NULL::VARCHAR AS cycle_to, 0 AS hops FROM kinds k JOIN nodes n ON n.id = k.id AND n.{roots}
  UNION ALL
  SELECT w.root, s.target, CASE WHEN list_contains(w.ids, s.target) THEN w.ids ELSE list_append(w.ids, s.target) END, list_append(w.key, s.rank), s.type, list_append(w.vias, s.type), w.depth + 1, k.kind,
         CASE WHEN list_contains(w.ids, s.target) THEN s.target END, w.hops + 1
  FROM walk w JOIN steps s ON w.cur = s.source LEFT JOIN kinds k ON k.id = s.target
  WHERE w.cycle_to IS NULL AND w.depth < {depth} AND coalesce(w.kind, '') NOT IN {_in(TERMINAL_TYPES)}),
done AS (
  SELECT root, ids, key, vias, hops, cycle_to, CASE WHEN cycle_to IS NOT NULL THEN 'cycle' WHEN kind IN {_in(TERMINAL_TYPES)} THEN 'terminal' WHEN cur NOT IN (SELECT source FROM edges) THEN 'leaf' WHEN depth = {depth} THEN 'max_depth' END AS termination FROM walk),
numbered AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY key) AS no FROM done WHERE termination IS NOT NULL)"""


_FLAT = "SELECT root, 'path_' || lpad(no::VARCHAR, greatest(3, length(no::VARCHAR))::INT, '0') AS path_id, array_to_string(ids, '>') AS nodes, hops, termination, cycle_to FROM numbered"
_RING = _paths(26, "CASE WHEN id LIKE 'nation:%' THEN 'MEDIATOR' ELSE type END", "id LIKE 'nation:%'")
ORACLES["paths_enumerate"] = f"{_paths(4)} {_FLAT}"
ORACLES["paths_depth_cut"] = f"{_paths(1)} {_FLAT}"
ORACLES["paths_cycles"] = f"{_RING} {_FLAT}"
ORACLES["path_stats"] = f"""{_paths(4)} SELECT root, count(*) AS path_count, count(*) > 1 AS branching, count(*) FILTER (WHERE termination = 'max_depth') AS truncated_path_count, count(*) FILTER (WHERE termination = 'cycle') AS cycle_path_count FROM numbered GROUP BY root"""
ORACLES["graph_slice"] = f"""{_RING}, own AS (SELECT DISTINCT root, unnest(ids) AS id FROM numbered), ends AS (SELECT DISTINCT root, id FROM own),
used AS (SELECT DISTINCT o.root, e.source, e.target, e.type FROM ends o JOIN edges e ON e.source = o.id JOIN kinds k ON k.id = e.source WHERE k.kind NOT IN {_in(TERMINAL_TYPES)})
SELECT a.root, a.nodes, a.particles, b.edges FROM (SELECT root, count(*) AS nodes, count(*) FILTER (WHERE kind = 'PARTICLE') AS particles FROM ends JOIN kinds USING (id) GROUP BY root) a
JOIN (SELECT root, count(*) AS edges FROM used GROUP BY root) b USING (root)"""


def _num(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


_NOTE = f"""CASE WHEN mass IS NULL AND type <> 'VERTEX' THEN '' ELSE '{{' || concat_ws(',', 'ₘ' || {_num('mass')}, CASE WHEN type = 'VERTEX' THEN 'ᴱ^0.8' END) || '}}' END"""
_PIECES = f"""pieces AS (SELECT p.root, p.no, u.pos, n.id, n.mass, n.type, {_role("CASE WHEN u.pos > 1 THEN p.vias[u.pos - 1] END", "n.type")} AS role, p.termination
  FROM numbered p CROSS JOIN unnest(p.ids) WITH ORDINALITY AS u(id, pos) JOIN nodes n ON n.id = u.id)"""
_HTTP = "g[URL]{ₘ0.1,ᴱ^1.0,ᵏ^0.9} -> "
ORACLES["notation_strings"] = f"""{_paths(4)}, {_PIECES}
SELECT root, 'path_' || lpad(no::VARCHAR, greatest(3, length(no::VARCHAR))::INT, '0') AS path_id, '{_HTTP}' || string_agg({_sym('role')} || '[' || id || ']' || {_NOTE}, ' -> ' ORDER BY pos) AS notation,
       'g[URL] -> ' || string_agg({_sym('role')} || '[' || id || ']', ' -> ' ORDER BY pos) AS legacy_notation, max(termination) = 'max_depth' AS truncated FROM pieces GROUP BY root, no"""
ORACLES["branch_ledger"] = f"""{_paths(4)}, {_PIECES}, lines AS (SELECT root, no, string_agg({_sym('role')} || '[' || id || ']', ' -> ' ORDER BY pos) AS l FROM pieces GROUP BY root, no)
SELECT root, string_agg('PATH ' || no || ': ' || l, chr(10) ORDER BY no) AS legacy, count(*) AS path_count FROM lines GROUP BY root"""
ORACLES["diagram_categories"] = f"""{_paths(4)}, {_PIECES}
SELECT root, 'path_' || lpad(no::VARCHAR, greatest(3, length(no::VARCHAR))::INT, '0') AS path_id, (count(*) FILTER (WHERE role LIKE 'VERTEX%' OR role = 'MEDIATOR'))::INT AS vertices, (1 + count(*) FILTER (WHERE role LIKE 'PROPAGATOR%'))::INT AS propagators,
       (count(*) FILTER (WHERE role LIKE 'PARTICLE%' OR role IN ('FRONTEND', 'JAVASCRIPT')))::INT AS particles, (count(*) + 1)::INT AS interactions FROM pieces GROUP BY root, no"""
_VISITS = f"""WITH RECURSIVE {_GRAPH},
steps AS (SELECT e.source, e.target, e.type, (row_number() OVER (PARTITION BY e.source ORDER BY {_PRIORITY.replace('type', 'e.type', 1)}, e.target, e.edge_idx))::INT AS rank, n.type AS kind FROM edges e LEFT JOIN nodes n ON n.id = e.target),
walk AS (
  SELECT id AS root, id AS cur, [id] AS seen, []::INT[] AS key, {_role("NULL", "type")} AS role, type AS kind, 0 AS depth FROM nodes WHERE type IN ('VERTEX', 'FRONTEND')
  UNION ALL
  SELECT w.root, s.target, list_append(w.seen, s.target), list_append(w.key, s.rank), {_role("s.type", "s.kind")}, s.kind, w.depth + 1
  FROM walk w JOIN steps s ON w.cur = s.source WHERE w.depth < 4 AND NOT list_contains(w.seen, s.target) AND (w.depth = 0 OR w.kind NOT IN {_in(TERMINAL_TYPES)})),
visits AS (SELECT root, (row_number() OVER (PARTITION BY root ORDER BY key))::INT AS pos, cur AS node, role FROM walk)"""
ORACLES["trace_flat"] = f"{_VISITS} SELECT root, pos, node, role FROM visits"
ORACLES["flat_ledger"] = f"""{_VISITS}, shown AS (SELECT v.*, n.mass, n.type FROM visits v JOIN nodes n ON n.id = v.node JOIN nodes r ON r.id = v.root AND r.type = 'VERTEX')
SELECT root, '{_HTTP}' || string_agg({_sym('role')} || '[' || node || ']' || {_NOTE}, ' -> ' ORDER BY pos) AS notation, count(*) + 1 AS trace_length,
       round(sum(coalesce(mass, 1.0::DOUBLE)) + 0.1::DOUBLE, 6) AS complexity, round(sum(CASE WHEN type = 'VERTEX' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) + 1.0::DOUBLE, 6) AS energy, 0.9::DOUBLE AS coupling FROM shown GROUP BY root"""
ORACLES["minimal_ledger_metadata"] = f"""WITH nodes AS ({_N}) SELECT id, '{_HTTP}V[' || id || ']' || '{{ₘ' || mass || ',ᴱ^0.8}}' AS notation, 1 AS vertices, 1 AS propagators, 'backend' AS interaction_type,
  round(mass + 0.1::DOUBLE, 6) AS complexity, 1.8::DOUBLE AS energy, 0.9::DOUBLE AS coupling FROM nodes WHERE type = 'VERTEX'"""
ORACLES["minimal_ledger"] = f"WITH nodes AS ({_N}) SELECT id, 'g[URL] -> V[' || id || ']' AS notation FROM nodes WHERE type = 'VERTEX'"
ORACLES["ghost_nodes"] = f"{_VISITS} SELECT id FROM nodes EXCEPT SELECT node FROM visits"

_NAME = "lower(name)"
_BASE = "regexp_extract(file, '[^/]*$', 0)"
_REACH = f"""WITH RECURSIVE {_GRAPH},
entries AS (SELECT id, node_idx, CASE WHEN type = 'VERTEX' THEN 'http_entry_point' WHEN type = 'FRONTEND' THEN 'frontend_entry_point' ELSE 'cli_entry_point' END AS c,
  CASE WHEN type IN ('VERTEX', 'FRONTEND') THEN 1.0::DOUBLE WHEN regexp_matches(file, '/(__main__|manage|cli)\\.py$') THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS conf,
  CASE WHEN type IN ('VERTEX', 'FRONTEND') THEN 'Node type ' || type || ' is a recognized application entry surface.' WHEN regexp_matches(file, '/(__main__|manage|cli)\\.py$') THEN 'Source path ' || file || ' is a conventional executable entry point.'
       ELSE 'Top-level callable named main is a likely executable entry point.' END AS e
  FROM nodes WHERE type IN ('VERTEX', 'FRONTEND') OR regexp_matches(file, '/(__main__|manage|cli)\\.py$') OR ({_NAME} = 'main' AND file LIKE '%.py')),
walk AS (SELECT id, node_idx AS owner, 0 AS level FROM entries UNION SELECT e.target, w.owner, w.level + 1 FROM walk w JOIN edges e ON e.source = w.id WHERE w.level < 4),
first AS (SELECT id, min(level) AS level FROM walk GROUP BY id),
near AS (SELECT w.id, min(w.owner) AS owner FROM walk w JOIN first f ON f.id = w.id AND f.level = w.level GROUP BY w.id),
ring AS (SELECT id, owner, 0 AS more FROM near UNION SELECT e.target, r.owner, r.more + 1 FROM ring r JOIN edges e ON e.source = r.id WHERE r.more < 25 AND e.target NOT IN (SELECT id FROM near)),
owned AS (SELECT n.id, n.owner FROM near n UNION ALL SELECT id, arg_min(owner, (more, owner)) FROM ring WHERE more > 0 GROUP BY id),
owners AS (SELECT o.id, n.id AS owner FROM owned o JOIN nodes n ON n.node_idx = o.owner),
classes AS (
  SELECT n.id, n.type, CASE WHEN en.id IS NOT NULL THEN en.c WHEN o.id IS NOT NULL THEN 'reachable'
    WHEN regexp_matches(lower(file), '(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\\.py$') OR {_NAME} LIKE 'test\\_%' ESCAPE '\\' THEN 'test_only'
    WHEN {_BASE} IN {_in(R.ENTRY_FILES)} OR file LIKE '%management/commands%' OR file LIKE '%migrations%' THEN 'framework_entry_point'
    WHEN {_NAME} IN {_in(R.HOOKS)} THEN 'framework_hook'
    WHEN file LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' AND {_NAME} NOT LIKE '\\_%' ESCAPE '\\' THEN 'public_api_candidate'
    WHEN regexp_matches({_NAME} || ' ' || lower(file), '{"|".join(R.HINTS)}') THEN 'dynamic_reference_suspected'
    WHEN n.id NOT IN (SELECT target FROM edges) AND n.id NOT IN (SELECT source FROM edges) AND n.type IN ('MEDIATOR', 'TRANSFORM', 'PARTICLE') THEN 'possibly_unreachable'
    WHEN n.id NOT IN (SELECT target FROM edges) THEN 'isolated_root' ELSE 'unknown' END AS classification,
    en.conf, en.e, {_NAME} AS called, n.file, o.id IS NOT NULL AS reachable
  FROM nodes n LEFT JOIN entries en ON en.id = n.id LEFT JOIN owners o ON o.id = n.id)"""
ORACLES["reachability_classes"] = f"""{_REACH}
SELECT id, classification, CASE classification WHEN 'reachable' THEN 0.95 WHEN 'test_only' THEN 0.95 WHEN 'framework_entry_point' THEN 0.85 WHEN 'framework_hook' THEN 0.75 WHEN 'public_api_candidate' THEN 0.7
  WHEN 'dynamic_reference_suspected' THEN 0.65 WHEN 'possibly_unreachable' THEN 0.82 WHEN 'isolated_root' THEN 0.55 WHEN 'unknown' THEN 0.4 ELSE conf END::DOUBLE AS confidence, reachable,
  CASE classification WHEN 'reachable' THEN 'Reachable from a recognized entry point through graph edges.' WHEN 'test_only' THEN 'Node is defined in test code or follows test naming conventions.'
    WHEN 'framework_entry_point' THEN 'Source path ' || file || ' is conventionally loaded by the framework.' WHEN 'framework_hook' THEN 'Callable name ' || called || ' matches a conventional framework hook.'
    WHEN 'public_api_candidate' THEN 'Public symbol in __init__.py may be exported for external callers.' WHEN 'dynamic_reference_suspected' THEN 'Name or path suggests registration, callbacks, plugins, or dynamic loading.'
    WHEN 'possibly_unreachable' THEN 'No incoming or outgoing graph edges were found.' WHEN 'isolated_root' THEN 'Node has no incoming graph edges but may be called dynamically or externally.'
    WHEN 'unknown' THEN 'Node was not reached from known entry points, but existing graph evidence is insufficient to call it unused.' ELSE e END AS evidence FROM classes"""
ORACLES["reachability_summary"] = f"{_REACH} SELECT classification, count(*) AS n FROM classes GROUP BY classification"
ORACLES["reachability_totals"] = f"{_REACH} SELECT count(*) AS node_count, (SELECT count(*) FROM entries) AS entry_point_count, count(*) FILTER (WHERE reachable) AS reachable_count FROM classes"
ORACLES["reached_from"] = f"""{_REACH}, origins AS (SELECT e.target AS id, o.owner FROM edges e JOIN owners o ON o.id = e.source WHERE e.target NOT IN (SELECT id FROM entries) UNION SELECT id, id FROM entries)
SELECT id, count(DISTINCT owner)::INT AS n, min(owner) AS first, max(owner) AS last FROM origins GROUP BY id"""
ORACLES["possibly_unreachable"] = f"{_REACH} SELECT id FROM classes WHERE classification = 'possibly_unreachable'"

_DIFF = f"""lines AS ({_D}),
marked AS (SELECT *, CASE WHEN line LIKE '+++ %' THEN CASE WHEN line = '+++ /dev/null' THEN lag(substr(line, 7)) OVER (PARTITION BY diff ORDER BY line_no) ELSE substr(line, 7) END END AS file,
  CASE WHEN line LIKE '@@%' THEN regexp_extract(line, '\\+(\\d+)', 1)::INT END AS start FROM lines),
run AS (SELECT *, last_value(file IGNORE NULLS) OVER w AS path, last_value(start IGNORE NULLS) OVER w AS base, count(start) OVER w AS hunk FROM marked WINDOW w AS (PARTITION BY diff ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT *, base + coalesce(sum(CASE WHEN start IS NULL AND line NOT LIKE '-%' THEN 1 ELSE 0 END) OVER (PARTITION BY diff, hunk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at FROM run
  WHERE line NOT LIKE 'diff --git%' AND line NOT LIKE '--- %' AND line NOT LIKE '+++ %'),
deletions AS (SELECT diff, file AS path, bool_or(line = '+++ /dev/null') AS deleted FROM marked WHERE file IS NOT NULL GROUP BY diff, file),
changes AS (SELECT d.diff, d.path, d.deleted, list(DISTINCT p.line_at ORDER BY p.line_at) FILTER (WHERE p.line LIKE '+%' OR p.line LIKE '-%') AS changed FROM deletions d JOIN placed p ON p.diff = d.diff AND p.path = d.path GROUP BY ALL)"""
ORACLES["diff_parse"] = f"WITH {_DIFF} SELECT diff, path, array_to_string(changed, ',') AS changed_lines, deleted FROM changes"
_SEEDS = f"""{_GRAPH}, {_DIFF}, hit AS (SELECT n.*, c.*, list_filter(c.changed, lambda x: x BETWEEN n.line_start AND n.line_end) AS inside FROM nodes n JOIN changes c ON c.path = n.file),
seeds AS (SELECT id AS seed, path AS changed_file, CASE WHEN len(inside) > 0 THEN CASE WHEN deleted THEN 0.75 ELSE 1.0 END ELSE CASE WHEN deleted THEN 0.75 ELSE 0.82 END END::DOUBLE AS confidence,
  CASE WHEN len(inside) > 0 THEN 'Changed lines [' || array_to_string(inside, ', ') || '] overlap node source span ' || line_start || '-' || line_end || '.' ELSE 'Changed line ' || (line_end + 1) || ' is adjacent to node source span ' || line_start || '-' || line_end || '.' END
  || CASE WHEN deleted THEN ' Source file was deleted; node span could not be revalidated.' ELSE '' END AS evidence FROM hit WHERE len(inside) > 0 OR list_contains(changed, line_end + 1))"""
ORACLES["changed_seeds"] = f"WITH {_SEEDS} SELECT seed, confidence, evidence, changed_file FROM seeds"
_SURE = "coalesce(confidence, CASE type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in EDGE_CONFIDENCE.items()) + " ELSE 0.5::DOUBLE END)"
_IMPACT = f"""WITH RECURSIVE {_SEEDS}, back AS (SELECT target, source, type, resolution, {_SURE} AS sure FROM edges WHERE type IN {_in(DEPENDENCY_EDGES)}),
walk AS (
  SELECT seed, seed AS node, [seed] AS ids, ''::VARCHAR AS evidence, ''::VARCHAR AS kinds, 0 AS depth, confidence FROM seeds
  UNION ALL
  SELECT w.seed, b.source, list_append(w.ids, b.source), w.evidence || CASE WHEN w.depth > 0 THEN '; ' ELSE '' END || b.type || ' edge' || CASE WHEN b.resolution IS NOT NULL THEN ' resolved as ' || b.resolution ELSE '' END || ' with confidence ' || printf('%.2f', b.sure),
         w.kinds || '|' || b.type, w.depth + 1, round(w.confidence * b.sure * CASE WHEN w.depth = 0 THEN 0.96::DOUBLE ELSE 0.92::DOUBLE END, 4)
  FROM walk w JOIN back b ON b.target = w.node WHERE w.depth < 6 AND (w.depth = 0 OR w.confidence >= 0.2) AND NOT list_contains(w.ids, b.source)),
paths AS (SELECT *, array_to_string(ids, ' <- ') AS summary FROM walk WHERE depth > 0)"""
ORACLES["impact_paths"] = f"{_IMPACT} SELECT seed, node, depth, confidence, summary FROM paths"
ORACLES["impact_path_evidence"] = f"{_IMPACT} SELECT summary, round(confidence, 3) AS confidence, {_label('confidence')} AS confidence_label, evidence FROM paths"
_BEST = f"""{_IMPACT}, best AS (SELECT node, max(round(confidence, 3)) AS confidence, count(*) AS path_count FROM paths WHERE node NOT IN (SELECT seed FROM seeds) GROUP BY node),
labels AS (SELECT p.node, arg_min(CASE WHEN p.confidence >= 0.8 THEN 'high' WHEN p.confidence >= 0.55 THEN 'medium' ELSE 'low' END, (p.depth, p.seed, p.kinds)) AS l FROM paths p JOIN best b ON b.node = p.node AND round(p.confidence, 3) = b.confidence GROUP BY p.node),
report AS (SELECT n.id, n.type, b.confidence, l.l AS confidence_label, {_label('b.confidence', _STATUS)} AS impact_status, b.path_count FROM best b JOIN labels l USING (node) JOIN nodes n ON n.id = b.node)"""
ORACLES["impact_best"] = f"{_BEST} SELECT * FROM report"
ORACLES["impact_by_type_status"] = f"{_BEST} SELECT type, impact_status, count(*) AS n FROM report GROUP BY type, impact_status"
ORACLES["review_surfaces"] = f"{_BEST} SELECT id, type, impact_status AS status, confidence FROM report WHERE type IN {_in(REVIEW_TYPES)}"
_QUALITY = f"""{_BEST}, q AS (SELECT (SELECT count(*) FROM nodes) AS node_count, 0::BIGINT AS unresolved_node_count, (SELECT count(*) FROM back) AS dependency_edge_count, (SELECT count(*) FROM back WHERE sure < 0.65) AS low_confidence_edge_count,
  (SELECT count(*) FROM seeds WHERE seed NOT IN (SELECT target FROM back)) AS orphan_seed_count, (SELECT count(*) FROM seeds) AS seed_count,
  (SELECT count(*) FROM (SELECT path FROM changes EXCEPT SELECT changed_file FROM seeds)) AS unmatched_file_count, (SELECT count(*) FROM report) AS impacted_node_count),
scored AS (SELECT *, 1.0::DOUBLE - least(0.35::DOUBLE, unmatched_file_count * 0.1::DOUBLE) - least(0.25::DOUBLE, unresolved_node_count / node_count * 0.5::DOUBLE) - least(0.2::DOUBLE, low_confidence_edge_count / dependency_edge_count * 0.3::DOUBLE)
  - CASE WHEN orphan_seed_count > 0 THEN least(0.2::DOUBLE, orphan_seed_count / seed_count * 0.2::DOUBLE) ELSE 0.0::DOUBLE END AS raw FROM q)"""
ORACLES["graph_quality"] = f"""{_QUALITY} SELECT node_count, unresolved_node_count, dependency_edge_count, low_confidence_edge_count, orphan_seed_count, seed_count, unmatched_file_count, impacted_node_count,
  round(greatest(0.0, raw), 3)::DOUBLE AS score, {_label('raw')} AS label, round(dependency_edge_count / node_count, 3) AS dependency_edges_per_node FROM scored"""
ORACLES["report_confidence"] = f"""{_QUALITY}, every AS (SELECT round(confidence, 3) AS c FROM seeds UNION ALL SELECT confidence FROM report), m AS (SELECT avg(c) AS mean FROM every), g AS (SELECT round(greatest(0.0, raw), 3)::DOUBLE AS s FROM scored)
SELECT round(mean * s, 3) AS score, {_label('round(mean * s, 3)')} AS label, round(mean, 3) AS evidence_score, s AS graph_quality_score FROM m, g"""
_PLAIN = f"""WITH RECURSIVE {_GRAPH}, {_DIFF}, seeds AS (SELECT DISTINCT n.id AS seed FROM nodes n JOIN changes c ON c.path = n.file WHERE len(list_filter(c.changed, lambda x: x BETWEEN n.line_start AND n.line_end + 1)) > 0),
walk AS (SELECT seed, seed AS node, [seed] AS ids, 0 AS depth FROM seeds UNION ALL SELECT w.seed, e.source, list_append(w.ids, e.source), w.depth + 1 FROM walk w JOIN edges e ON e.target = w.node WHERE w.depth < 6 AND e.type IN {_in(DEPENDENCY_EDGES)} AND NOT list_contains(w.ids, e.source))"""
ORACLES["impact_unweighted"] = f"{_PLAIN} SELECT seed, depth, count(*) AS paths, count(DISTINCT node) AS nodes FROM walk WHERE depth > 0 GROUP BY seed, depth"
ORACLES["impact_unweighted_summary"] = f"""{_PLAIN}, hit AS (SELECT DISTINCT node FROM walk WHERE node NOT IN (SELECT seed FROM seeds)), k AS (SELECT n.type FROM hit JOIN nodes n ON n.id = hit.node)
SELECT count(*) AS impacted_node_count, count(*) FILTER (WHERE type IN {_in(HIGH_RISK_TYPES)}) AS high_risk_surface_count, count(*) FILTER (WHERE type IN {_in(REVIEW_TYPES)}) AS breaking_surface_count,
  (SELECT count(*) FROM seeds) AS changed_node_count, CASE WHEN (SELECT count(*) FROM seeds) = 0 THEN 'low' WHEN count(*) = 0 THEN 'medium' ELSE 'high' END AS confidence FROM k"""


def _strip(c: str, suffixes) -> str:
    return "CASE " + " ".join(f"WHEN suffix({c}, '{s}') THEN substr({c}, 1, length({c}) - {len(s)})" for s in suffixes) + f" ELSE {c} END"


def _subject(c: str) -> str:
    cut = f"regexp_split_to_array(trim(regexp_replace({_strip(c, SUBJECT_SUFFIXES)}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({cut}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


_TOKENS = f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(substr(id, 1, 1) || regexp_replace(substr(id, 2), '([A-Z])', ' \\1', 'g'), '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> '' AND w NOT IN {_in(STOP_TOKENS)})))"
_LISTS = {k: "[" + ", ".join(f"'{a}'" for a in v) + "]" for k, v in INTENTS.items()}
_INTENT = "CASE " + " ".join(f"WHEN list_has_any(tokens, {v}) THEN '{k}'" for k, v in _LISTS.items()) + " " + " ".join(f"WHEN regexp_matches(lower(id), '{'|'.join(v)}') THEN '{k}'" for k, v in INTENTS.items())
_INTENT += " WHEN type = 'TRANSFORM' THEN 'transform' WHEN type = 'PARTICLE' THEN 'data_model' WHEN type = 'FRONTEND' THEN 'interface' ELSE 'generic' END"
_PROFILES = f"""WITH raw AS ({lifted.plain(lifted.NAMED)}), named AS (SELECT id, arg_max(type, node_idx) AS type FROM raw WHERE type IN ('VERTEX', 'TRANSFORM', 'PARTICLE', 'MEDIATOR', 'FRONTEND') GROUP BY id),
links AS ({lifted.plain(lifted.NAMED_EDGES)}), linked AS (SELECT source AS id, list(DISTINCT {_subject('target')}) FILTER (WHERE type = 'PARTICLE_ENTANGLEMENT') AS l, true AS any_edge FROM links GROUP BY source),
a AS (SELECT n.id, n.type, {_TOKENS.replace('id', 'n.id')} AS tokens, coalesce(k.l, []) AS l, k.any_edge, {_strip('n.id', VIEW_SUFFIXES)} AS bare FROM named n LEFT JOIN linked k ON k.id = n.id),
b AS (SELECT *, list_sort(list_distinct(list_filter(list_concat(l, CASE WHEN type = 'PARTICLE' THEN [{_subject('id')}] WHEN type = 'TRANSFORM' AND len(l) = 0 THEN [{_subject('(' + _strip('id', ('Serializer', 'Schema')) + ')')}]
  WHEN type NOT IN ('PARTICLE', 'TRANSFORM') AND len(l) = 0 AND bare <> id AND bare <> '' THEN [{_subject('bare')}] ELSE [] END), lambda s: s <> '' AND lower(s) NOT IN {_in(INTENTS)}))) AS subjects, {_INTENT} AS intent FROM a),
profiles AS (SELECT *, CASE WHEN type = 'VERTEX' AND (len(subjects) > 0 OR intent IN {_in(INTENTS)}) THEN 'crud_interface' WHEN type = 'TRANSFORM' THEN 'data_transform' WHEN type = 'PARTICLE' THEN 'data_model'
  WHEN type = 'MEDIATOR' AND len(subjects) > 0 THEN 'data_service' WHEN type = 'FRONTEND' THEN 'frontend_surface' ELSE 'supporting_logic' END AS role FROM b)"""
ORACLES["semantic_tokens"] = f"{_PROFILES} SELECT id, array_to_string(tokens, ',') AS tokens FROM profiles"
ORACLES["semantic_subjects"] = f"{_PROFILES} SELECT id, type, array_to_string(subjects, ',') AS subjects FROM profiles"
ORACLES["semantic_intent"] = f"{_PROFILES} SELECT id, intent, role FROM profiles"
_CLUSTERS = f"""{_PROFILES}, keyed AS (SELECT 'data:' || s AS scope, role, id, type, intent, subjects FROM (SELECT *, unnest(subjects) AS s FROM profiles)
  UNION ALL SELECT 'data:' || s, 'data_workflow', id, type, intent, subjects FROM (SELECT *, unnest(subjects) AS s FROM profiles WHERE role = 'crud_interface')
  UNION ALL SELECT 'tokens:' || array_to_string(tokens[1:2], '-'), role, id, type, intent, subjects FROM profiles WHERE len(subjects) = 0 AND len(tokens) > 0),
g AS (SELECT scope, role, list(DISTINCT id ORDER BY id) AS members, list_sort(list_distinct(flatten(list(subjects)))) AS data_subjects, list(DISTINCT intent ORDER BY intent) AS intents, list(DISTINCT type ORDER BY type) AS node_types FROM keyed GROUP BY scope, role HAVING count(DISTINCT id) >= 2),
clusters AS (SELECT 'semantic_cluster_' || lpad((row_number() OVER (ORDER BY scope, role))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY scope, role))::VARCHAR))::INT, '0') AS id, *, round(least(0.5::DOUBLE + CASE WHEN len(data_subjects) > 0 THEN 0.25 ELSE 0 END + CASE WHEN len(node_types) = 1 OR len(intents) <= 2 THEN 0.15 ELSE 0 END + 0.1, 0.95), 2)::DOUBLE AS confidence,
  CASE role WHEN 'crud_interface' THEN 'Crud Interface' WHEN 'data_transform' THEN 'Data Transform' WHEN 'data_model' THEN 'Data Model' WHEN 'data_service' THEN 'Data Service' WHEN 'frontend_surface' THEN 'Frontend Surface' WHEN 'data_workflow' THEN 'Data Workflow' ELSE 'Supporting Logic' END
  || ' around ' || CASE WHEN len(data_subjects) > 0 THEN array_to_string(data_subjects, ', ') ELSE scope END || ' (' || array_to_string(intents, ', ') || ')' AS summary FROM g)"""
_CSV = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("members", "data_subjects", "intents", "node_types"))
ORACLES["semantic_clusters"] = f"{_CLUSTERS} SELECT id, scope, role, {_CSV}, confidence, summary FROM clusters"
_MEMBER = "SELECT m AS node, string_agg(id, ',' ORDER BY id) AS clusters, count(*) AS n FROM (SELECT id, unnest(members) AS m FROM clusters) GROUP BY m"
ORACLES["cluster_membership"] = f"{_CLUSTERS} SELECT node, clusters FROM ({_MEMBER})"
ORACLES["ledger_annotate"] = f"{_CLUSTERS} SELECT v.id, 'g[URL] -> V[' || v.id || ']' AS notation, coalesce(k.n, 0)::INT AS semantic_cluster_count, coalesce(k.clusters, '') AS cluster_ids FROM (SELECT DISTINCT id FROM raw WHERE type = 'VERTEX') v LEFT JOIN ({_MEMBER}) k ON k.node = v.id"

_TPL = f"t AS ({lifted.plain(lifted.TEMPLATES)})"


def _hits(pattern: str, prefix: str, kind: str, edge: str, own: bool, name: str = "n") -> str:
    target = f"'{prefix}:' || " + ("rel_path || '::' || " if own else "") + name
    return f"SELECT DISTINCT 'template:' || rel_path AS source, {target} AS target, '{kind}' AS target_type, {name} AS name, '{edge}' AS type FROM (SELECT rel_path, unnest(regexp_extract_all(content, '{pattern}', 1)) AS n FROM t)"


ORACLES["template_vars"] = f"WITH {_TPL} {_hits(r'\{\{\s*([\w.]+)\s*\}\}', 'template-symbol', 'OBSERVATION', 'OBSERVATION', True, 'split_part(n, chr(46), 1)')}"
ORACLES["template_js"] = f"""WITH {_TPL} {_hits(r'function\s+(\w+)\s*\(', 'javascript', 'JAVASCRIPT', 'EVENT', True)}
UNION SELECT * FROM ({_hits(r'(\w+)\s*=\s*(?:async\s+)?(?:function\s*\([^)]*\)|\([^)]*\))\s*=>', 'javascript', 'JAVASCRIPT', 'EVENT', True)}) WHERE name <> 'document'
UNION {_hits(r'async\s+function\s+(\w+)', 'javascript', 'JAVASCRIPT', 'VIRTUAL', True)}
UNION {_hits(r'addEventListener\s*\(\s*["]([^"]+)["]', 'javascript', 'JAVASCRIPT', 'EVENT', True, "n || '_handler'")}"""
ORACLES["template_fetch"] = f"WITH {_TPL} {_hits(r'fetch\s*\(\s*\x27([^\x27]+)\x27'.replace(chr(39), chr(39) * 2), 'ajax', 'AJAX', 'AJAX', False)}".replace(r"\x27", "''")
ORACLES["template_deps"] = "WITH " + _TPL + " " + " UNION ALL ".join(
    f"SELECT 'template:' || rel_path AS source, 'dependency:{n}' AS target, 'DEPENDENCY' AS target_type, '{n}' AS name, 'DEPENDENCY' AS type FROM t WHERE {test}"
    for n, test in (("Leaflet", "regexp_matches(content, 'L\\.(map|marker)\\(')"), ("jQuery", "content LIKE '%$(%' OR content LIKE '%jQuery%'"), ("Bootstrap", "lower(content) LIKE '%bootstrap%'"), ("Axios", "content LIKE '%axios%'"))
)
ORACLES["template_mass"] = f"""WITH {_TPL} SELECT rel_path, round(least(2.0, 0.3::DOUBLE + len(regexp_extract_all(content, '\\{{\\{{\\s*[\\w.]+\\s*\\}}\\}}')) * 0.05 + len(regexp_extract_all(content, '\\{{%\\s*[^%]+\\s*%\\}}')) * 0.1 + len(regexp_extract_all(content, 'function\\s+\\w+')) * 0.15), 2)::DOUBLE AS mass FROM t"""
ORACLES["template_nodes"] = f"WITH {_TPL} SELECT 'template:' || rel_path AS id, regexp_extract(rel_path, '[^/]*$', 0) AS name, 'FRONTEND' AS type, 1 AS line_start, 1 AS line_end FROM t"


def _half_up(x: str, places: int = 2) -> str:
    """Rounded as decimal digits are written, halves up."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 20), {places})::DOUBLE"


def _mass(kind: str) -> str:
    extra = f"CASE {kind} WHEN 'PARTICLE' THEN fields * 0.08::DOUBLE + rels * 0.16::DOUBLE WHEN 'TRANSFORM' THEN fields * 0.05::DOUBLE ELSE 0 END"
    return _half_up(f"least(2.0::DOUBLE, greatest(0.1::DOUBLE, (0.2::DOUBLE + least(loc, 200)::DOUBLE / 100 + (cc - 1) * 0.12::DOUBLE + calls * 0.03::DOUBLE) + {extra}))")


ORACLES["physics_metrics"] = f"""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS loc, (p_partkey % 9 + 1)::DOUBLE AS cc, (p_partkey % 13)::DOUBLE AS calls, (p_partkey % 5)::DOUBLE AS fields, (p_partkey % 3)::DOUBLE AS rels, CASE WHEN p_partkey % 2 = 0 THEN 'PARTICLE' ELSE 'TRANSFORM' END AS type FROM part)
SELECT p_partkey, type, {_mass('type')} AS mass,
  {_half_up('least(1.5::DOUBLE, 0.35::DOUBLE + least(calls, 20) * 0.04::DOUBLE + least(cc, 15) * 0.025::DOUBLE)')} AS energy, {_half_up('least(1.0::DOUBLE, 0.25::DOUBLE + least(calls + rels, 15) * 0.04::DOUBLE)')} AS coupling,
  CASE WHEN type = 'PARTICLE' THEN {_half_up('least(1.25::DOUBLE, 1.0::DOUBLE + rels * 0.05::DOUBLE)')} ELSE 1.0 END::DOUBLE AS charge FROM p"""
ORACLES["fallback_metrics"] = """SELECT p_partkey, round(least(2.0, 0.5::DOUBLE + ((p_size % 9) + 1) * 0.1::DOUBLE + (p_size % 9) * 0.2::DOUBLE), 2)::DOUBLE AS model_mass,
  round(least(2.0, least(((p_size % 9) + 1) / 100, 2.0) + CASE WHEN p_partkey % 2 = 0 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END), 2)::DOUBLE AS view_mass FROM part"""
ORACLES["suggestions"] = f"""WITH {_GRAPH} SELECT id, 'warning' AS level, 'High complexity: ' || id AS message FROM nodes WHERE type = 'VERTEX' AND mass > 1.5
UNION ALL SELECT id, 'info', 'Isolated model: ' || id FROM nodes WHERE type = 'PARTICLE' AND id NOT IN ({_ENDS})"""
ORACLES["unused_imports"] = f"WITH {_GRAPH} SELECT id, 'models/' || file AS file FROM nodes WHERE type = 'VERTEX' AND id NOT IN (SELECT source FROM edges WHERE type = 'PARTICLE_ENTANGLEMENT')"
ORACLES["editor_hints"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Consider linking this view to a model and a serializer' WHEN 1 THEN 'Model change: check the views and serializers that use it' WHEN 2 THEN 'Check that the serializer''s fields match its model' END AS hint FROM part"""
ORACLES["guess_framework"] = f"WITH n AS ({lifted.plain(lifted.NAMED)}) SELECT CASE WHEN bool_or(type = 'VERTEX' AND id LIKE '%View%') THEN 'django' ELSE 'generic' END AS framework FROM n"
ORACLES["components_in_file"] = f"""WITH {_GRAPH}, own AS (SELECT id, name, type FROM nodes WHERE file = 'lib/cli.py'), around AS (SELECT DISTINCT id, target AS o, 'out' AS d, e.type FROM own JOIN edges e ON e.source = id UNION SELECT DISTINCT id, source, 'in', e.type FROM own JOIN edges e ON e.target = id)
SELECT own.id, own.name, own.type, coalesce(k.related, 0) AS related FROM own LEFT JOIN (SELECT id, count(*) AS related FROM around GROUP BY id) k ON k.id = own.id"""
ORACLES["schema_compat"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'v' ELSE (o_orderkey % 5)::VARCHAR END || '.2.0' AS requested_version, '1.0.0' AS supported_version, o_orderkey % 5 IN (0, 1, 4) AS compatible, o_orderkey % 5 IN (0, 4) AS requires_migration FROM orders"""
ORACLES["rule_match"] = """WITH p AS (SELECT p_partkey, p_partkey % 10 AS k, split_part(p_name, ' ', 2) AS w FROM part), n AS (SELECT *, upper(substr(w, 1, 1)) || substr(w, 2) || CASE k WHEN 1 THEN 'View' WHEN 2 THEN 'Serializer' WHEN 6 THEN '_Detail' WHEN 7 THEN '_view' ELSE '' END AS name FROM p)
SELECT p_partkey, name, CASE WHEN k IN (3, 4) THEN 'PARTICLE' WHEN k = 1 THEN 'VERTEX' WHEN k >= 6 AND regexp_matches(lower(name), 'view|dashboard|home|detail|create|edit|list') THEN 'VERTEX' WHEN k = 2 THEN 'TRANSFORM' ELSE 'MEDIATOR' END AS type FROM n"""
ORACLES["module_names"] = f"""WITH nodes AS ({_N}) SELECT DISTINCT file, regexp_replace(replace(regexp_replace(file, '\\.[^./]+$', ''), '/', '.'), '\\.__init__$', '') AS module, file AS rel FROM nodes"""
ORACLES["relative_imports"] = """WITH n AS (SELECT n_nationkey, n_nationkey % 7 AS level, ['a', 'b' || n_regionkey, 'c', 'm' || n_nationkey] AS parts, CASE WHEN n_nationkey % 2 = 0 THEN 'x.y' ELSE '' END AS i FROM nation)
SELECT n_nationkey, CASE WHEN level = 0 THEN i ELSE array_to_string(list_concat(parts[1:greatest(0, 4 - level)], CASE WHEN i <> '' THEN [i] ELSE [] END), '.') END AS target FROM n"""
ORACLES["rule_match_decorators"] = """WITH p AS (SELECT p_partkey, p_partkey % 3 = 0 AS is_class, ['app.route(''/'')', 'bp.route(''/x'')', 'router.get(''/'')', 'table', 'APIRouter()', 'cached', 'app.get', 'tableless'][1 + p_partkey % 8] AS mark FROM part)
SELECT p_partkey, CASE WHEN NOT is_class AND (starts_with(mark, 'app.route') OR starts_with(mark, 'bp.route')) THEN 'VERTEX' ELSE 'MEDIATOR' END AS flask,
  CASE WHEN is_class AND starts_with(mark, 'table') THEN 'PARTICLE' WHEN is_class AND starts_with(mark, 'APIRouter') THEN 'VERTEX' WHEN NOT is_class AND (starts_with(mark, 'app.') OR starts_with(mark, 'router.')) THEN 'VERTEX' ELSE 'MEDIATOR' END AS fastapi FROM p"""

# What the project of each supplier holds, by the rules: {n} is its model, {k} its number.
_SHOP = "shop AS (SELECT s_suppkey::VARCHAR AS k, 'Item' || s_suppkey AS n FROM supplier)"
_DEFS = """defs(module, kind, tail, first, last, bases, type, loc, cc, branches, calls, assigned, returned, raised, handlers, fields, rels) AS (VALUES
  ('models', 'class', '{n}', 4, 14, 'models.Model', 'PARTICLE', 11, 1, 0, 2, 2, 0, 0, 0, 2, 1),
  ('models', 'method', '{n}.save', 8, 10, '', 'MEDIATOR', 3, 1, 0, 2, 0, 1, 0, 0, 0, 0),
  ('models', 'method', '{n}.check', 12, 14, '', 'MEDIATOR', 3, 2, 1, 1, 0, 0, 1, 0, 0, 0),
  ('models', 'function', 'helper', 17, 18, '', 'MEDIATOR', 2, 2, 1, 0, 0, 1, 0, 0, 0, 0),
  ('views', 'class', '{n}ListView', 5, 13, '', 'VERTEX', 9, 1, 0, 0, 2, 0, 0, 0, 2, 0),
  ('views', 'method', '{n}ListView.get', 9, 13, '', 'MEDIATOR', 5, 1, 0, 4, 1, 1, 0, 0, 0, 0),
  ('views', 'function', 'home', 16, 17, '', 'VERTEX', 2, 1, 0, 2, 0, 1, 0, 0, 0, 0),
  ('services', 'function', 'run', 4, 10, '', 'MEDIATOR', 7, 4, 2, 1, 1, 1, 0, 1, 0, 0),
  ('services', 'function', 'broken_{k}', 13, 14, '', 'MEDIATOR', 2, 1, 0, 1, 0, 0, 0, 0, 0, 0),
  ('routes', 'function', 'show_{k}', 8, 9, '', 'MEDIATOR', 2, 1, 0, 0, 0, 1, 0, 0, 0, 0),
  ('routes', 'class', 'Row{k}', 13, 14, '', 'MEDIATOR', 2, 1, 0, 0, 0, 0, 0, 0, 0, 0))"""
_CALLS = """calls(source, target, resolution, confidence, line) AS (VALUES
  ('models.{n}.save', 'models.{n}.check', 'self_method', 1.0, 9), ('models.{n}.save', 'models.helper', 'name', 0.95, 10), ('services.run', 'models.{n}.check', 'local_instance', 0.9, 6),
  ('views.{n}ListView.get', 'models.{n}', 'name', 0.95, 10), ('views.{n}ListView.get', 'models.{n}.save', 'local_instance', 0.9, 11), ('views.{n}ListView.get', 'services.run', 'qualified_import', 0.98, 12),
  ('views.home', 'models.{n}.save', 'constructed_instance', 0.95, 17), ('views.home', 'models.{n}', 'name', 0.95, 17))"""


def _fill(c: str) -> str:
    return f"replace(replace({c}, '{{n}}', n), '{{k}}', k)"


def _py(c: str) -> str:
    return f"'python:shop.p' || k || '.' || {_fill(c)}"


_TAIL = "module || '.' || tail"
ORACLES["py_extract"] = f"WITH {_SHOP}, {_DEFS} SELECT {_py(_TAIL)} AS id, kind, 'shop.p' || k || '.' || {_fill(_TAIL)} AS qualified, first AS line_start, last AS line_end, bases FROM shop, defs"
ORACLES["component_metrics"] = f"""WITH {_SHOP}, {_DEFS} SELECT {_py(_TAIL)} AS id, loc, cc AS cyclomatic_complexity, branches AS branch_count, calls AS call_count, assigned AS assignment_count, returned AS return_count,
  raised AS raise_count, handlers AS exception_handler_count, fields AS field_count, rels AS relationship_count FROM shop, defs"""
ORACLES["call_resolution"] = f"WITH {_SHOP}, {_CALLS} SELECT {_py('source')} AS source, {_py('target')} AS target, resolution, confidence::DOUBLE AS confidence, line FROM shop, calls"
ORACLES["component_lookup"] = f"""WITH {_SHOP}, w(f, name, line_start, tail, loc) AS (VALUES ('models', 'save', 8, 'models.{{n}}.save', 3), ('models', 'check', 13, 'models.{{n}}.check', 3), ('services', 'run', 0, 'services.run', 7),
  ('services', 'run', 12, 'services.run', 7), ('services', 'gone', 1, NULL, NULL))
SELECT 'shop/p' || k || '/' || f || '.py' AS rel_path, name, line_start, {_py('tail')} AS id, loc FROM shop, w"""
ORACLES["framework_detect"] = f"""WITH n AS (SELECT count(*) AS c, 10.0::DOUBLE * count(*) AS fastapi, 5.0::DOUBLE * count(*) AS django FROM supplier)
SELECT 'fastapi' AS framework, {_half_up('least(1.0::DOUBLE, fastapi / 10) * 0.65::DOUBLE + (fastapi - django) / greatest(fastapi, 1) * 0.35::DOUBLE')} AS confidence, (3 * c)::INT AS evidence_count, django AS django_score FROM n"""
_PAGE = "'shop/p' || k || '/page.html'"
ORACLES["project_nodes"] = f"""WITH {_SHOP}, {_DEFS}
SELECT {_py(_TAIL)} AS id, split_part({_fill('tail')}, '.', -1) AS name, 'shop.p' || k || '.' || {_fill(_TAIL)} AS qualified_name, type, 'python' AS language, first AS line_start, last AS line_end, {_mass('type')} AS mass FROM shop, defs
UNION ALL SELECT 'ajax:/api/' || k, '/api/' || k, '/api/' || k, 'AJAX', NULL, NULL, NULL, 1.0 FROM shop
UNION ALL SELECT 'javascript:' || {_PAGE} || '::show' || k, 'show' || k, {_PAGE} || '::show' || k, 'JAVASCRIPT', 'javascript', NULL, NULL, 0.3 FROM shop
UNION ALL SELECT 'template-symbol:' || {_PAGE} || '::' || lower(n), lower(n), {_PAGE} || '::' || lower(n), 'OBSERVATION', 'template', NULL, NULL, 1.0 FROM shop
UNION ALL SELECT 'template:' || {_PAGE}, 'page.html', {_PAGE}, 'FRONTEND', 'template', 1, 1, 0.5 FROM shop
UNION ALL SELECT 'unresolved:transform:Missing', 'Missing', 'Missing', 'TRANSFORM', 'python', NULL, NULL, NULL FROM (SELECT 1 FROM shop LIMIT 1)"""
ORACLES["project_edges"] = f"""WITH {_SHOP}, {_CALLS}, {_DEFS}, edges AS (
SELECT {_py('source')} AS source, {_py('target')} AS target, 'CALL' AS type, confidence::DOUBLE AS confidence, resolution FROM shop, calls
UNION ALL SELECT {_py("module || '.' || split_part(tail, '.', 1)")}, {_py(_TAIL)}, 'CONTAINS', NULL, NULL FROM shop, defs WHERE kind = 'method'
UNION ALL SELECT {_py("'views.{n}ListView'")}, {_py("'models.{n}'")}, 'PARTICLE_ENTANGLEMENT', NULL, NULL FROM shop
UNION ALL SELECT {_py("'views.{n}ListView'")}, 'unresolved:transform:Missing', 'SERIALIZER_ENTANGLEMENT', NULL, NULL FROM shop
UNION ALL SELECT {_py("'views.{n}ListView.get'")}, {_py("'models.{n}'")}, 'PARTICLE_ENTANGLEMENT', NULL, NULL FROM shop
UNION ALL SELECT 'template:' || {_PAGE}, 'ajax:/api/' || k, 'AJAX', NULL, NULL FROM shop
UNION ALL SELECT 'template:' || {_PAGE}, 'javascript:' || {_PAGE} || '::show' || k, 'EVENT', NULL, NULL FROM shop
UNION ALL SELECT 'template:' || {_PAGE}, 'template-symbol:' || {_PAGE} || '::' || lower(n), 'OBSERVATION', NULL, NULL FROM shop)
SELECT {_ID} AS id, source, target, type, confidence, resolution FROM edges"""
assert set(EDGE_TYPES) >= set(DEPENDENCY_EDGES)
