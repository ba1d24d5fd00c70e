"""DuckDB SQL for the queries, written from their definitions."""

from __future__ import annotations

INC = "inc AS (SELECT DISTINCT l_orderkey AS edge_id, l_partkey AS node_id FROM lineitem)"
SIZE = "sz AS (SELECT edge_id, count(*) AS size FROM inc GROUP BY edge_id)"
PAIRS = "pr AS (SELECT a.edge_id, a.node_id AS x, b.node_id AS y FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id < b.node_id)"
SUPPORT = "su AS (SELECT x, y, count(*) AS support FROM pr GROUP BY x, y)"
SETS = "st AS (SELECT edge_id, list(node_id ORDER BY node_id) AS nodes, count(*) AS size FROM inc GROUP BY edge_id)"
NUM = "num AS (SELECT max(node_id) + 1 AS n FROM inc)"
NEAR = """
aw AS (SELECT x, y, round(sum(1.0::DOUBLE / greatest(size - 1, 1)), 9) AS w FROM pr JOIN sz USING (edge_id) GROUP BY x, y),
ab AS (SELECT x, y, w FROM aw UNION ALL SELECT y, x, w FROM aw),
near AS (SELECT x, y, w FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS r FROM ab) WHERE r <= 128)"""
NEAR_ALL = NEAR.replace("SELECT x, y, w FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS r FROM ab) WHERE r <= 128", "SELECT x, y, w FROM ab")
CLOSURE = "clo AS (SELECT edge_id, avg(ln(1.0::DOUBLE + support)) AS r FROM pr JOIN su USING (x, y) GROUP BY edge_id)"
RESIDUAL = """
deg AS (SELECT node_id, count(*) AS d FROM inc GROUP BY node_id),
tot AS (SELECT sum(size)::DOUBLE AS t, sum(size * (size - 1))::DOUBLE AS x FROM sz),
ex AS (SELECT edge_id, support, tot.x * a.d * b.d / (tot.t * (tot.t - 1)) AS e
       FROM pr JOIN su USING (x, y) JOIN deg a ON a.node_id = pr.x JOIN deg b ON b.node_id = pr.y CROSS JOIN tot),
res AS (SELECT edge_id, avg(CASE WHEN support <= e THEN 0 ELSE ln(1 + (support - e) / sqrt(e + 1e-9)) END) AS r FROM ex GROUP BY edge_id)"""
NEAREST = """
kn AS (SELECT row_number() OVER () AS k, nodes, len(nodes) AS size FROM (SELECT DISTINCT nodes FROM st)),
ki AS (SELECT k, size, unnest(nodes) AS node_id FROM kn),
own AS (SELECT st.edge_id, kn.k AS own FROM st JOIN kn ON st.nodes = kn.nodes),
met AS (SELECT inc.edge_id, ki.k, count(*) AS i, any_value(ki.size) AS ks FROM inc JOIN ki USING (node_id) GROUP BY inc.edge_id, ki.k),
nea AS (SELECT met.edge_id, max(i / (ks + sz.size - i)::DOUBLE) AS r FROM met JOIN sz USING (edge_id) JOIN own USING (edge_id) WHERE k <> own GROUP BY met.edge_id)"""
COWALK = f"""{NEAR},
nm AS (SELECT x, sqrt(sum(w * w)) AS n FROM near GROUP BY x),
np AS (SELECT DISTINCT x, y FROM pr),
co AS (SELECT np.x, np.y, sum(a.w * b.w) AS dot FROM np JOIN near a ON a.x = np.x JOIN near b ON b.x = np.y AND b.y = a.y GROUP BY np.x, np.y),
cw AS (SELECT pr.edge_id, avg(coalesce(dot / (p.n * q.n), 0)) AS r FROM pr LEFT JOIN co ON co.x = pr.x AND co.y = pr.y
       JOIN nm p ON p.x = pr.x JOIN nm q ON q.x = pr.y GROUP BY pr.edge_id)"""
HITTING = """
tt AS (SELECT x, sum(w) AS t FROM near GROUP BY x),
pp AS (SELECT near.x, near.y, w / t AS p FROM near JOIN tt USING (x)),
dr AS (SELECT DISTINCT x, y FROM pr UNION SELECT DISTINCT y, x FROM pr),
h2 AS (SELECT dr.x, dr.y, sum(a.p * b.p) * 0.5 AS h FROM dr JOIN pp a ON a.x = dr.x JOIN pp b ON b.x = a.y AND b.y = dr.y GROUP BY dr.x, dr.y),
h1 AS (SELECT dr.x, dr.y, coalesce(pp.p, 0) + coalesce(h2.h, 0) AS h FROM dr LEFT JOIN pp ON pp.x = dr.x AND pp.y = dr.y LEFT JOIN h2 ON h2.x = dr.x AND h2.y = dr.y),
hit AS (SELECT pr.edge_id, avg((a.h + b.h) / 2) AS r FROM pr JOIN h1 a ON a.x = pr.x AND a.y = pr.y JOIN h1 b ON b.x = pr.y AND b.y = pr.x GROUP BY pr.edge_id)"""


def _risk(ctes: str, name: str) -> str:
    return f"WITH {ctes} SELECT sz.edge_id AS cand_id, round(coalesce({name}.r, 0)::DOUBLE, 6) AS risk FROM sz LEFT JOIN {name} USING (edge_id)"


BASE = f"{INC}, {SIZE}, {PAIRS}, {SUPPORT}"
EXPANSION = """
cx AS (SELECT x, y, count(*) AS c FROM bw GROUP BY x, y),
rd AS (SELECT x, sum(c) AS d FROM cx GROUP BY x)
SELECT cx.x, cx.y, c AS count, round((c / (sqrt(greatest(a.d, 1)) * sqrt(greatest(b.d, 1))))::DOUBLE, 6) AS value
FROM cx JOIN rd a ON a.x = cx.x JOIN rd b ON b.x = cx.y"""
TRIPLES = "tr AS (SELECT a.edge_id, a.node_id AS x, b.node_id AS y, c.node_id AS z FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id < b.node_id JOIN inc c ON c.edge_id = a.edge_id AND b.node_id < c.node_id)"
RANDOM = "('0x' || substr(md5(concat_ws(':', {})), 1, 8))::BIGINT"


def rnd(*parts: str) -> str:
    return RANDOM.format(", ".join(parts))


#: All sources' attempts (larger sets pass within four on these tables; sets of one node are often known), and draws of nodes in order: the first k distinct ones are taken by the place where they first come.
ATTEMPTS = "att AS (SELECT st.edge_id AS source_id, nodes AS source, size AS source_size, 0 AS slot, a.attempt FROM st CROSS JOIN (SELECT unnest(range(100)) AS attempt) a WHERE a.attempt < 4 OR size = 1)"
KNOWN = "known AS (SELECT DISTINCT nodes FROM st)"


def uniform_edges(want: str) -> str:
    return f"""{ATTEMPTS}, {KNOWN}, {NUM},
aw AS (SELECT *, {want} AS want FROM att),
dw AS (SELECT source_id, attempt, want, {rnd("'1'", "'node'", "source_id", "slot", "attempt", "i")} % n AS v, i
       FROM aw CROSS JOIN num CROSS JOIN (SELECT unnest(range(64)) AS i) WHERE i = 0 OR want > 1),
fw AS (SELECT source_id, attempt, want, v, min(i) AS i FROM dw GROUP BY ALL),
gw AS (SELECT *, row_number() OVER (PARTITION BY source_id, attempt ORDER BY i) AS r FROM fw),
ue AS (SELECT source_id, attempt, list(v ORDER BY v) AS nodes FROM gw WHERE r <= want GROUP BY source_id, attempt, want HAVING count(*) = want),
us AS (SELECT source_id, 0 AS slot, arg_min(nodes, attempt) AS nodes, min(attempt) AS attempt FROM ue WHERE nodes NOT IN (SELECT nodes FROM known) GROUP BY source_id)"""


def anchored(keep: str, fixed: bool, name: str = "an") -> str:
    drawn = rnd("'1'", "'keep'", "source_id", "slot", *([] if fixed else ["attempt"]), "v")
    return f"""{ATTEMPTS}, {KNOWN}, {NUM},
kp AS (SELECT *, {keep} AS keep FROM att WHERE source_size >= 2),
kv AS (SELECT source_id, slot, attempt, keep, unnest(source) AS v FROM kp),
kr AS (SELECT *, row_number() OVER (PARTITION BY source_id, attempt ORDER BY {drawn}, v) AS r FROM kv),
fl AS (SELECT source_id, attempt, source, source_size - keep AS want, {rnd("'1'", "'fill'", "source_id", "slot", "attempt", "i")} % n AS v, i
       FROM kp CROSS JOIN num CROSS JOIN (SELECT unnest(range(64)) AS i)),
ff AS (SELECT source_id, attempt, want, v, min(i) AS i FROM fl WHERE NOT list_contains(source, v) GROUP BY source_id, attempt, want, v),
fr AS (SELECT *, row_number() OVER (PARTITION BY source_id, attempt ORDER BY i) AS r FROM ff),
al AS (SELECT source_id, attempt, v FROM kr WHERE r <= keep UNION ALL SELECT source_id, attempt, v FROM fr WHERE r <= want),
ag AS (SELECT source_id, attempt, list(v ORDER BY v) AS nodes FROM al GROUP BY source_id, attempt),
{name} AS (SELECT ag.source_id, ag.attempt, ag.nodes, kp.source, kp.source_size FROM ag JOIN kp USING (source_id, attempt)
       WHERE len(ag.nodes) = source_size AND ag.nodes NOT IN (SELECT nodes FROM known))"""


SIMILAR = "(len(list_intersect(nodes, source)) / (2 * source_size - len(list_intersect(nodes, source)))::DOUBLE)"
ANCHOR = "least(source_size - 1, greatest(1, floor(source_size * 0.25)::BIGINT))"
SAMPLE = "SELECT source_id, slot, array_to_string(nodes, ',') AS edge, attempt FROM us"
#: The nearest known edge of sampled sets ``nodes`` that is not their source, from a table c(id, nodes, source).
NEAREST_OF = """
ck AS (SELECT row_number() OVER () AS k, nodes, len(nodes) AS size FROM known),
ci AS (SELECT k, size, unnest(nodes) AS v FROM ck),
cn AS (SELECT id, nodes, source, unnest(nodes) AS v FROM c),
cm AS (SELECT cn.id, ci.k, count(*) AS i, any_value(ci.size) AS ks, any_value(len(cn.nodes)) AS cs, any_value(cn.source) AS source FROM cn JOIN ci USING (v) GROUP BY cn.id, ci.k),
cx AS (SELECT cm.id, max(i / (ks + cs - i)::DOUBLE) AS near FROM cm JOIN ck USING (k) WHERE ck.nodes <> cm.source GROUP BY cm.id)"""
CLOSURE_OF = """
pc AS (SELECT c.id, p.x, p.y FROM (SELECT id, unnest(nodes) AS x, nodes FROM c) p0 JOIN c USING (id) CROSS JOIN LATERAL (SELECT p0.x AS x, unnest(c.nodes) AS y) p WHERE p.x < p.y),
cl AS (SELECT id, avg(ln(1.0::DOUBLE + coalesce(support, 0))) AS clo FROM pc LEFT JOIN su USING (x, y) GROUP BY id)"""

#: The nodes that the anchors' neighbours propose, with the risks of each anchor and one of them: nr(edge_id, node_id, support, place, need, clo, res).
NODE_RISKS = f"""{BASE}, {SETS}, {RESIDUAL},
ao AS (SELECT edge_id, node_id, size, {ANCHOR.replace('source_size', 'size')} AS keep,
              row_number() OVER (PARTITION BY edge_id ORDER BY {rnd("'1'", "'keep'", "edge_id", "0", "node_id")}, node_id) AS r FROM inc JOIN st USING (edge_id) WHERE size >= 2),
ak AS (SELECT edge_id, node_id AS v, size - keep AS need FROM ao WHERE r <= keep),
ab AS (SELECT x, y, support AS w FROM su UNION ALL SELECT y, x, support FROM su),
a32 AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS r FROM ab) WHERE r <= 32),
fo AS (SELECT edge_id, y AS node_id, any_value(need) AS need, count(*) AS support FROM ak JOIN a32 ON a32.x = ak.v GROUP BY edge_id, y),
fx AS (SELECT fo.* FROM fo ANTI JOIN inc ON inc.edge_id = fo.edge_id AND inc.node_id = fo.node_id),
fy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY support DESC, node_id) AS place FROM fx) WHERE place <= 16),
mb AS (SELECT fy.edge_id, fy.node_id, ak.v FROM fy JOIN ak USING (edge_id) UNION ALL SELECT edge_id, node_id, node_id FROM fy),
mp AS (SELECT a.edge_id, a.node_id, a.v AS x, b.v AS y FROM mb a JOIN mb b ON a.edge_id = b.edge_id AND a.node_id = b.node_id AND a.v < b.v),
me AS (SELECT mp.edge_id, mp.node_id, coalesce(support, 0) AS support, tot.x * a.d * b.d / (tot.t * (tot.t - 1)) AS e
       FROM mp LEFT JOIN su USING (x, y) JOIN deg a ON a.node_id = mp.x JOIN deg b ON b.node_id = mp.y CROSS JOIN tot),
mr AS (SELECT edge_id, node_id, avg(ln(1.0::DOUBLE + support)) AS clo, avg(CASE WHEN support <= e THEN 0 ELSE ln(1 + (support - e) / sqrt(e + 1e-9)) END) AS res FROM me GROUP BY edge_id, node_id),
nr AS (SELECT fy.*, clo, res FROM fy JOIN mr USING (edge_id, node_id))"""

SPLIT = f"""{INC}, {SETS},
ds AS (SELECT nodes, min(edge_id) AS edge_id, any_value(size) AS size FROM st WHERE size >= 2 GROUP BY nodes),
od AS (SELECT *, row_number() OVER (ORDER BY {rnd("'1'", "'split'", "edge_id")}, edge_id) - 1 AS place, count(*) OVER () AS n FROM ds),
sp AS (SELECT edge_id, nodes, size, CASE WHEN place < floor(n * 0.6) THEN 'train' WHEN place < floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM od)"""

ITEMS = "it AS (SELECT l_orderkey AS source_id, concat_ws(':', l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS item, l_returnflag AS label, l_extendedprice AS value, l_extendedprice / 105000.0::DOUBLE AS score FROM lineitem)"
PRED = "pd AS (SELECT o_orderkey AS pos, (o_orderstatus = 'F')::INT AS label, round(o_totalprice / 500000.0::DOUBLE, 3) AS score, o_orderpriority AS protocol FROM orders)"
AUC = """
rk AS (SELECT *, rank() OVER (PARTITION BY protocol ORDER BY score) + (count(*) OVER (PARTITION BY protocol, score) - 1) / 2.0::DOUBLE AS ar FROM pd),
au AS (SELECT protocol, (sum(ar) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS auc FROM rk GROUP BY protocol)"""
CURVE = """
ct AS (SELECT protocol, score, sum(label) AS p, count(*) AS c FROM pd GROUP BY protocol, score),
cv AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS al, sum(p) OVER (PARTITION BY protocol) AS pos, sum(c - p) OVER (PARTITION BY protocol) AS neg
       FROM ct WINDOW w AS (PARTITION BY protocol ORDER BY score DESC))"""
BATCHES = f"""{PRED.replace("pd AS", "p0 AS")}, names AS (SELECT DISTINCT protocol FROM p0),
pd AS (SELECT pos, label, score, names.protocol FROM p0 CROSS JOIN names WHERE label = 1 UNION ALL SELECT pos, label, score, protocol FROM p0 WHERE label = 0)"""
EVALUATED = f"""{BATCHES}, {AUC}, {CURVE},
ap AS (SELECT protocol, any_value(pos)::BIGINT AS positives, any_value(neg)::BIGINT AS negatives, sum(p / pos::DOUBLE * (tp / al::DOUBLE)) AS ap FROM cv GROUP BY protocol),
ev AS (SELECT * FROM ap JOIN au USING (protocol))"""
LOGITS = "lg AS (SELECT l_orderkey AS source_id, (l_returnflag = 'R')::INT AS label, l_quantity / 10.0::DOUBLE - 2.5::DOUBLE AS logit, 1.0::DOUBLE - l_discount AS weight FROM lineitem)"
FEATS = "ft AS (SELECT p_partkey AS node_id, 0 AS dim, p_size / 49.0::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 1, ln(p_retailprice) FROM part)"
OBSERVED = f"""{INC}, {SIZE}, {PAIRS}, {SUPPORT}, {SETS}, {anchored(ANCHOR, True)},
us AS (SELECT source_id AS id, arg_min(nodes, attempt) AS nodes, any_value(source) AS source, bool_or({SIMILAR} <= 0.75) AS ok,
       arg_min(nodes, attempt) FILTER (WHERE {SIMILAR} <= 0.75) AS good FROM an GROUP BY source_id),
c AS (SELECT id, good AS nodes, source FROM us WHERE ok), {CLOSURE_OF},
deg AS (SELECT node_id, count(*) AS d FROM inc GROUP BY node_id),
tot AS (SELECT sum(size)::DOUBLE AS t, sum(size * (size - 1))::DOUBLE AS x FROM sz),
ce AS (SELECT id, coalesce(support, 0) AS s, tot.x * coalesce(a.d, 0) * coalesce(b.d, 0) / (tot.t * (tot.t - 1)) AS e
       FROM pc LEFT JOIN su USING (x, y) LEFT JOIN deg a ON a.node_id = pc.x LEFT JOIN deg b ON b.node_id = pc.y CROSS JOIN tot),
cr AS (SELECT id, avg(CASE WHEN s <= e THEN 0 ELSE ln(1 + (s - e) / sqrt(e + 1e-9)) END) AS res FROM ce GROUP BY id),
ob AS (SELECT id, round(clo::DOUBLE, 6) AS closure, round(res::DOUBLE, 6) AS residual FROM cl JOIN cr USING (id))"""


def _bound(n: str) -> str:
    return f"CASE WHEN quantile_cont({n}, 0.9) > 1e-6 THEN quantile_cont({n}, 0.9) ELSE coalesce(quantile_cont({n}, 0.5) FILTER (WHERE {n} > 1e-6), 1e-6) END"


COMBINED = f"""{BASE}, {SETS}, {CLOSURE}, {RESIDUAL}, {NEAREST},
ra AS (SELECT sz.edge_id AS cand_id, round(coalesce(nea.r, 0)::DOUBLE, 6) AS a, round(coalesce(clo.r, 0)::DOUBLE, 6) AS b, round(coalesce(res.r, 0)::DOUBLE, 6) AS c
       FROM sz LEFT JOIN nea USING (edge_id) LEFT JOIN clo USING (edge_id) LEFT JOIN res USING (edge_id)),
rs AS (SELECT *, a / 0.25::DOUBLE AS ra, b / 0.35::DOUBLE AS rb, c / 0.5::DOUBLE AS rc, a / 0.25::DOUBLE + b / 0.35::DOUBLE + c / 0.5::DOUBLE AS s,
       a <= 0.5::DOUBLE AND b <= 0.7::DOUBLE AND c <= 1.0::DOUBLE AS safe FROM ra)"""
QUOTA = f"""{ITEMS},
wt AS (SELECT * FROM (VALUES ('A', 4.0::DOUBLE), ('N', 2.0::DOUBLE), ('R', 0.0::DOUBLE)) v(label, weight)),
"""


def quota(items: str, size: int, p: str) -> str:
    """Table {p}qt: the items of ``items`` that fill ``size`` by quota, with place and filled."""
    return f"""
{p}qh AS (SELECT DISTINCT source_id, label, weight FROM {items} JOIN wt USING (label)),
{p}qi AS (SELECT *, max((weight > 0)::INT) OVER (PARTITION BY source_id) AS any_weight FROM {p}qh),
{p}qj AS (SELECT source_id, label, {size}::DOUBLE * weight / greatest(sum(weight) OVER (PARTITION BY source_id), 1e-12) AS exact FROM {p}qi WHERE weight > 0 OR any_weight = 0),
{p}qk AS (SELECT *, floor(exact)::BIGINT AS base, {size} - sum(floor(exact)) OVER (PARTITION BY source_id) AS spare,
        row_number() OVER (PARTITION BY source_id ORDER BY exact - floor(exact) DESC, label DESC) AS r FROM {p}qj),
{p}qq AS (SELECT source_id, label, base + CASE WHEN r <= spare THEN 1 ELSE 0 END AS quota FROM {p}qk),
{p}qr AS (SELECT i.*, row_number() OVER (PARTITION BY i.source_id, i.label ORDER BY value DESC, item) <= coalesce(quota, 0) AS inq
        FROM {items} i LEFT JOIN {p}qq q ON q.source_id = i.source_id AND q.label = i.label),
{p}qs AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY inq DESC, value DESC, item) AS place FROM {p}qr),
{p}qt AS (SELECT *, CASE WHEN inq THEN 'quota' ELSE 'rest' END AS filled FROM {p}qs WHERE place <= {size})"""


def _band(order: str, extra: str = "") -> str:
    return f"""WITH {ITEMS}{extra}, b AS (SELECT *, score BETWEEN 0.3 AND 0.7 AS in_band FROM {'sm' if extra else 'it'}),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY NOT in_band, {order}) AS place FROM b)
SELECT source_id, item, place, in_band FROM r WHERE place <= 2"""


def _z(expr: str, *parts: str) -> str:
    return f"WITH {', '.join([ITEMS, *parts])} SELECT source_id, item, round(({expr})::DOUBLE, 6) AS z FROM {'mm' if parts else 'it'}"


def _zscore(by: str) -> str:
    return f"CASE WHEN stddev_pop(value) OVER (PARTITION BY {by}) <= 1e-12 THEN 0 ELSE (value - avg(value) OVER (PARTITION BY {by})) / stddev_pop(value) OVER (PARTITION BY {by}) END"


def _rank(by: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY {by}) = 1 THEN 0 ELSE 2.0::DOUBLE * (row_number() OVER (PARTITION BY {by} ORDER BY value, item) - 1) / (count(*) OVER (PARTITION BY {by}) - 1) - 1 END"


LINES_AS_SLOTS = "sl AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY item) AS slot, item FROM it)"
SP = "softplus AS (SELECT 1)"


def softplus(x: str) -> str:
    return f"(greatest({x}, 0.0::DOUBLE) + ln(1 + exp(-abs({x}))))"


SQL: dict[str, str] = {
    "hyperedge_load_canonical": f"WITH {INC}, {SETS} SELECT array_to_string(nodes, ',') AS edge, min(edge_id) AS edge_id, count(*) AS copies, len(nodes) AS size FROM st WHERE size >= 2 GROUP BY nodes",
    "incidence_degrees": f"WITH {INC} SELECT node_id, count(*) AS degree FROM inc GROUP BY node_id",
    "edge_size_histogram": f"WITH {INC}, {SIZE} SELECT size, count(*) AS edges FROM sz GROUP BY size",
    "edge_rule_violations": f"""WITH {INC}, {SETS}, {NUM}
SELECT count(*) AS edges, count(*) FILTER (WHERE size = 0) AS empty, count(*) FILTER (WHERE len(list_distinct(nodes)) < size) AS repeated_nodes,
       count(*) FILTER (WHERE list_min(nodes) < 0 OR list_max(nodes) >= n) AS out_of_range, count(*) - count(DISTINCT nodes) AS repeated_sets FROM st CROSS JOIN num""",
    "random_split": f"WITH {SPLIT} SELECT edge_id, split FROM sp",
    "sequence_digest": f"""WITH {INC}, {SETS},
q AS (SELECT row_number() OVER (ORDER BY edge_id) - 1 AS place, concat(size, ':', array_to_string(nodes, ','), ';') AS s FROM st),
b AS (SELECT place // 4096 AS b, sha256(string_agg(s, '' ORDER BY place)) AS d FROM q GROUP BY place // 4096)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b""",
    "pair_support": f"WITH {INC}, {PAIRS}, {SUPPORT} SELECT x, y, support FROM su",
    "pair_sketch_bounded": """
WITH i AS (SELECT DISTINCT l_partkey AS edge_id, l_suppkey AS node_id FROM lineitem),
s AS (SELECT edge_id, list(node_id ORDER BY node_id) AS nodes, count(*) AS n FROM i GROUP BY edge_id),
f AS (SELECT edge_id, a.node_id AS x, b.node_id AS y FROM i a JOIN i b USING (edge_id) JOIN s USING (edge_id) WHERE a.node_id < b.node_id AND n * (n - 1) / 2 <= 64),
o AS (SELECT edge_id, nodes, n, unnest(range(1, n, greatest(1, n // 8))) AS o FROM s WHERE n * (n - 1) / 2 > 64),
p AS (SELECT edge_id, o, i, nodes[1 + i] AS u, nodes[1 + (i + o) % n] AS v FROM o CROSS JOIN LATERAL (SELECT unnest(range(n)) AS i)),
d AS (SELECT edge_id, least(u, v) AS x, greatest(u, v) AS y, min((o, i)) AS first FROM p GROUP BY edge_id, least(u, v), greatest(u, v)),
r AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY first) AS r FROM d)
SELECT edge_id, x, y FROM f UNION ALL SELECT edge_id, x, y FROM r WHERE r <= 64""",
    "triple_support": f"WITH {INC}, {TRIPLES} SELECT x, y, z, count(*) AS support FROM tr GROUP BY x, y, z",
    "two_section_neighbors": f"WITH {INC} SELECT DISTINCT a.node_id AS x, b.node_id AS y FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id",
    "clique_expansion_full": f"WITH {INC}, {PAIRS}, bw AS (SELECT x, y FROM pr UNION ALL SELECT y, x FROM pr UNION ALL SELECT DISTINCT node_id, node_id FROM inc), {EXPANSION}",
    "clique_expansion_mediator": f"""WITH {INC}, {SETS},
md AS (SELECT nodes[1] AS low, nodes[-1] AS high, nodes FROM st WHERE size >= 2),
mp AS (SELECT low AS x, high AS y FROM md UNION ALL SELECT low, m FROM (SELECT low, high, unnest(nodes) AS m FROM md) WHERE m NOT IN (low, high)
       UNION ALL SELECT m, high FROM (SELECT low, high, unnest(nodes) AS m FROM md) WHERE m NOT IN (low, high)),
bw AS (SELECT x, y FROM mp UNION ALL SELECT y, x FROM mp UNION ALL SELECT DISTINCT node_id, node_id FROM inc), {EXPANSION}""",
    "closure_risk": _risk(f"{BASE}, {CLOSURE}", "clo"),
    "cowalk_risk": _risk(f"{BASE}, {COWALK}", "cw"),
    "hitting_risk": _risk(f"{BASE}, {NEAR_ALL}, {HITTING}", "hit"),
    "residual_risk": _risk(f"{BASE}, {RESIDUAL}", "res"),
    "nearest_positive": _risk(f"{INC}, {SIZE}, {SETS}, {NEAREST}", "nea"),
    "combined_risk_budget": f"""WITH {COMBINED}
SELECT cand_id, round(s, 6) AS score, safe,
       CASE WHEN ra > 1 AND ra = greatest(ra, rb, rc) THEN 'nearest' WHEN rb > 1 AND rb = greatest(ra, rb, rc) THEN 'closure'
            WHEN rc > 1 AND rc = greatest(ra, rb, rc) THEN 'residual' WHEN s > 3 THEN 'budget' WHEN NOT safe THEN 'safety' END AS reason FROM rs""",
    "all_risks": f"""WITH {BASE}, {SETS}, {CLOSURE}, {RESIDUAL}, {NEAREST}, {COWALK}, {HITTING}
SELECT sz.edge_id AS cand_id, round(coalesce(nea.r, 0)::DOUBLE, 6) AS nearest, round(coalesce(clo.r, 0)::DOUBLE, 6) AS closure, round(coalesce(cw.r, 0)::DOUBLE, 6) AS cowalk,
       round(coalesce(hit.r, 0)::DOUBLE, 6) AS hitting, round(coalesce(res.r, 0)::DOUBLE, 6) AS residual
FROM sz LEFT JOIN nea USING (edge_id) LEFT JOIN clo USING (edge_id) LEFT JOIN cw USING (edge_id) LEFT JOIN hit USING (edge_id) LEFT JOIN res USING (edge_id)""",
    "expansion_means": f"""WITH {BASE}, {TRIPLES}, ts AS (SELECT x, y, z, count(*) AS support FROM tr GROUP BY x, y, z),
m2 AS (SELECT edge_id, exp(avg(ln(support))) AS gm2, count(*) / sum(1.0::DOUBLE / support) AS hm2, avg(support) AS am2 FROM pr JOIN su USING (x, y) GROUP BY edge_id),
m3 AS (SELECT edge_id, exp(avg(ln(support))) AS gm3, count(*) / sum(1.0::DOUBLE / support) AS hm3, avg(support) AS am3 FROM tr JOIN ts USING (x, y, z) GROUP BY edge_id)
SELECT edge_id, round(coalesce(gm2, 0), 6) AS gm2, round(coalesce(hm2, 0), 6) AS hm2, round(coalesce(am2, 0), 6) AS am2,
       round(coalesce(gm3, 0), 6) AS gm3, round(coalesce(hm3, 0), 6) AS hm3, round(coalesce(am3, 0), 6) AS am3
FROM sz LEFT JOIN m2 USING (edge_id) LEFT JOIN m3 USING (edge_id)""",
    "expansion_neighbor_features": f"""WITH {INC}, {SETS},
ne AS (SELECT DISTINCT a.node_id AS x, b.node_id AS y FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id),
dg AS (SELECT x, count(*) AS d FROM ne GROUP BY x),
en AS (SELECT edge_id, nodes[1] AS a, nodes[-1] AS b FROM st WHERE size >= 2),
cm AS (SELECT edge_id, count(*) AS cn, sum(CASE WHEN dg.d > 1 THEN 1.0::DOUBLE / ln(dg.d) END) AS aa
       FROM en JOIN ne p ON p.x = en.a JOIN ne q ON q.x = en.b AND q.y = p.y JOIN dg ON dg.x = p.y GROUP BY edge_id)
SELECT st.edge_id, coalesce(cn, 0)::DOUBLE AS cn, round(coalesce(coalesce(cn, 0) / nullif(p.d + q.d - coalesce(cn, 0), 0)::DOUBLE, 0), 6) AS jc, round(coalesce(aa, 0), 6) AS aa
FROM st LEFT JOIN en USING (edge_id) LEFT JOIN cm USING (edge_id) LEFT JOIN dg p ON p.x = en.a LEFT JOIN dg q ON q.x = en.b""",
    "expansion_third_neighbors": f"""WITH {INC}, {SETS}, {TRIPLES}, t AS (SELECT DISTINCT x, y, z FROM tr),
l0 AS (SELECT (x, y) AS u, (x, z) AS v FROM t UNION SELECT (x, y), (y, z) FROM t UNION SELECT (x, z), (y, z) FROM t),
ne AS (SELECT u, v FROM l0 UNION SELECT v, u FROM l0),
dg AS (SELECT u, count(*) AS d FROM ne GROUP BY u),
en AS (SELECT edge_id, (nodes[1], nodes[2]) AS a, (nodes[-2], nodes[-1]) AS b FROM st WHERE size >= 3),
cm AS (SELECT edge_id, count(*) AS cn, sum(CASE WHEN dg.d > 1 THEN 1.0::DOUBLE / ln(dg.d) END) AS aa
       FROM en JOIN ne p ON p.u = en.a JOIN ne q ON q.u = en.b AND q.v = p.v JOIN dg ON dg.u = p.v GROUP BY edge_id)
SELECT st.edge_id, coalesce(cn, 0)::DOUBLE AS cn, round(coalesce(coalesce(cn, 0) / nullif(p.d + q.d - coalesce(cn, 0), 0)::DOUBLE, 0), 6) AS jc, round(coalesce(aa, 0), 6) AS aa
FROM st LEFT JOIN en USING (edge_id) LEFT JOIN cm USING (edge_id) LEFT JOIN dg p ON p.u = en.a LEFT JOIN dg q ON q.u = en.b""",
    "star_test": f"""WITH {INC}, {SETS},
ne AS (SELECT DISTINCT a.node_id AS x, b.node_id AS y FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id),
ms AS (SELECT a.edge_id, a.node_id, count(*) AS c FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id JOIN ne ON ne.x = a.node_id AND ne.y = b.node_id GROUP BY a.edge_id, a.node_id),
mx AS (SELECT edge_id, max(c) AS c FROM ms GROUP BY edge_id)
SELECT st.edge_id, coalesce(c, 0) >= size - 1 AS is_star FROM st LEFT JOIN mx USING (edge_id)""",
    "anchor_node_risks": f"WITH {NODE_RISKS} SELECT edge_id AS source_id, node_id, support, place, round(clo::DOUBLE, 6) AS closure, round(res::DOUBLE, 6) AS residual FROM nr",
    "risk_aware_pool": f"""WITH {NODE_RISKS},
rk AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(clo + res, 9), node_id) AS rank FROM nr)
SELECT edge_id AS source_id, node_id, round(round(clo + res, 9)::DOUBLE, 6) AS risk, rank FROM rk WHERE rank <= 2 * need""",
    "residual_safe_pool": f"""WITH {NODE_RISKS},
q AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY clo, node_id) AS r, floor(0.25 * (count(*) OVER (PARTITION BY edge_id) - 1)) + 1 AS pos FROM nr),
t AS (SELECT *, max(CASE WHEN r = pos THEN clo END) OVER w AS target, greatest(max(clo) OVER w, 1e-9) AS cs, greatest(0.5, max(res) OVER w) AS rs FROM q WINDOW w AS (PARTITION BY edge_id)),
dd AS (SELECT *, round((abs(clo - target) / cs + res / rs)::DOUBLE, 9) AS distance FROM t),
rk AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY distance, round(clo, 9) DESC, node_id) AS rank FROM dd)
SELECT edge_id AS source_id, node_id, round(distance, 6) AS distance, rank FROM rk WHERE rank <= 2 * need""",
    "proposal_diagnostics": """WITH p AS (SELECT list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(b.embedding, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT list_inner_product(a, b) AS ab, sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb FROM p)
SELECT count(*) AS pairs, round(avg(CASE WHEN na * nb = 0 THEN 0 ELSE ab / (na * nb) END)::DOUBLE, 6) AS cosine, round(avg(na)::DOUBLE, 6) AS norm, round(avg(nb)::DOUBLE, 6) AS proposal_norm FROM n""",
    "replacement_pool_topk": f"""WITH {BASE},
ab AS (SELECT x, y, support AS w FROM su UNION ALL SELECT y, x, support FROM su),
nr AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS r FROM ab) WHERE r <= 128),
fo AS (SELECT inc.edge_id, nr.y AS node_id, count(*) AS anchors FROM inc JOIN nr ON nr.x = inc.node_id GROUP BY inc.edge_id, nr.y),
fx AS (SELECT fo.* FROM fo ANTI JOIN inc ON inc.edge_id = fo.edge_id AND inc.node_id = fo.node_id),
fy AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY anchors DESC, node_id) AS place FROM fx)
SELECT edge_id, node_id, anchors, place FROM fy WHERE place <= 8""",
    "sampler_random": f"WITH {INC}, {SETS}, {uniform_edges(rnd(chr(39) + '1' + chr(39), chr(39) + 'size' + chr(39), 'source_id', 'slot', 'attempt') + ' % 5 + 2')} {SAMPLE}",
    "sampler_size_matched": f"WITH {INC}, {SETS}, {uniform_edges('source_size')} {SAMPLE}",
    "sampler_half_corruption": f"WITH {INC}, {SETS}, {anchored('ceil(source_size / 2)::BIGINT', False)}, us AS (SELECT source_id, 0 AS slot, arg_min(nodes, attempt) AS nodes, min(attempt) AS attempt FROM an GROUP BY source_id) {SAMPLE}",
    "sampler_anchored": f"""WITH {INC}, {SETS}, {anchored(ANCHOR, True)},
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY NOT {SIMILAR} <= 0.75, attempt) AS r FROM an),
us AS (SELECT source_id, 0 AS slot, nodes, attempt FROM rk WHERE r = 1 AND {SIMILAR} <= 0.75) {SAMPLE}""",
    "sampler_anchored_safe": f"""WITH {INC}, {SETS}, {anchored(ANCHOR, False)},
ok AS (SELECT * FROM an WHERE {SIMILAR} <= 0.75), c AS (SELECT (source_id, attempt) AS id, nodes, source FROM ok), {NEAREST_OF},
sc AS (SELECT ok.*, coalesce(near, 0) AS near FROM ok LEFT JOIN cx ON cx.id = (ok.source_id, ok.attempt)),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY NOT near <= 0.5, CASE WHEN near <= 0.5 THEN 0 ELSE near END, attempt) AS r FROM sc),
us AS (SELECT source_id, 0 AS slot, nodes, attempt FROM rk WHERE r = 1) {SAMPLE}""",
    "sampler_clique": f"""WITH {INC}, {SETS}, {uniform_edges('source_size')},
ne AS (SELECT DISTINCT a.node_id AS x, b.node_id AS y FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id),
cc AS (SELECT inc.edge_id, ne.y AS new, count(*) AS c, sum(ne.x) AS s FROM inc JOIN ne ON ne.x = inc.node_id GROUP BY inc.edge_id, ne.y),
cs AS (SELECT cc.*, st.nodes AS source, st.size FROM cc JOIN st USING (edge_id) WHERE st.size >= 2 AND c >= size - 1 AND NOT list_contains(st.nodes, new)),
cg AS (SELECT edge_id, new, source, unnest(CASE WHEN c = size THEN source ELSE [(list_sum(source) - s)::BIGINT] END) AS gone FROM cs),
ce AS (SELECT edge_id AS source_id, new, gone, list_sort(list_append(list_filter(source, lambda v: v <> gone), new)) AS nodes FROM cg),
cf AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {rnd("'1'", "'gone'", "source_id", "0", "gone")}, {rnd("'1'", "'new'", "source_id", "0", "new")}, nodes) AS r
       FROM ce WHERE nodes NOT IN (SELECT nodes FROM known)),
cb AS (SELECT source_id, 0 AS slot, nodes, 0 AS attempt FROM cf WHERE r = 1)
SELECT source_id, slot, array_to_string(nodes, ',') AS edge, attempt FROM cb
UNION ALL SELECT source_id, slot, array_to_string(nodes, ','), attempt FROM us WHERE source_id NOT IN (SELECT source_id FROM cb)""",
    "sampler_risk_controlled": f"""WITH {BASE}, {SETS}, {anchored(ANCHOR, False)},
c AS (SELECT (source_id, attempt) AS id, nodes, source FROM an), {NEAREST_OF}, {CLOSURE_OF},
sc AS (SELECT an.*, coalesce(near, 0) AS nearest, coalesce(clo, 0) AS closure FROM an LEFT JOIN cx ON cx.id = (an.source_id, an.attempt) LEFT JOIN cl ON cl.id = (an.source_id, an.attempt)),
sd AS (SELECT *, nearest <= 0.3 AND closure <= 0.35 AS accepted, round(nearest / 0.3::DOUBLE + closure / 0.35::DOUBLE, 9) AS score FROM sc),
rk AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS valid, row_number() OVER (PARTITION BY source_id ORDER BY NOT accepted, CASE WHEN accepted THEN 0 ELSE score END, attempt) AS r FROM sd)
SELECT source_id, 0 AS slot, array_to_string(nodes, ',') AS edge, attempt, accepted, round(score, 6) AS score, round(nearest, 6) AS nearest, round(closure, 6) AS closure, valid FROM rk WHERE r = 1""",
    "sampler_fast_safe": f"""WITH {INC}, {SETS}, {uniform_edges('source_size')}, {anchored(ANCHOR, False).split(NUM + ",")[1]},
gd AS (SELECT source_id, 0 AS slot, arg_min(nodes, attempt) AS nodes, min(attempt) AS attempt FROM an WHERE {SIMILAR} <= 0.5 GROUP BY source_id)
SELECT source_id, slot, array_to_string(nodes, ',') AS edge, attempt FROM gd
UNION ALL SELECT source_id, slot, array_to_string(nodes, ','), attempt FROM us WHERE source_id NOT IN (SELECT source_id FROM gd)""",
    "zscore_local": _z(_zscore("source_id")),
    "pool_zscore": _z(_zscore("source_id, label")),
    "rank_local": _z(_rank("source_id")),
    "pool_rank": _z(_rank("source_id, label")),
    "zscore_robust": _z(
        "CASE WHEN mad * 1.4826 <= 1e-12 THEN 0 ELSE (value - med) / (mad * 1.4826) END",
        "md AS (SELECT source_id, quantile_cont(value, 0.5) AS med FROM it GROUP BY source_id)",
        "mi AS (SELECT it.*, med FROM it JOIN md USING (source_id))",
        "ma AS (SELECT source_id, quantile_cont(abs(value - med), 0.5) AS mad FROM mi GROUP BY source_id)",
        "mm AS (SELECT mi.*, mad FROM mi JOIN ma USING (source_id))",
    ),
    "retrieval_score": f"WITH {ITEMS} SELECT source_id, item, round((0.36::DOUBLE * ({_zscore('source_id')}) + 0.64::DOUBLE * score)::DOUBLE, 6) AS combined FROM it",
    "rerank_boundary_closest": _band("abs(score - 0.5), score DESC, item"),
    "rerank_embedding_boundary": _band("abs(score - 0.5) - 0.5 * similarity, similarity DESC, score DESC, item", f", sm AS (SELECT *, round({rnd(chr(39) + 'similarity' + chr(39), 'source_id', 'item')} / 4294967296.0::DOUBLE, 6) AS similarity FROM it)"),
    "topk_softmax_select": f"""WITH {ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item) AS r FROM it),
g AS (SELECT source_id, item, score / 0.8::DOUBLE - ln(-ln(greatest({rnd("'1'", "'gumbel'", "source_id", "item")} / 4294967296.0::DOUBLE, 1e-9))) AS key FROM b WHERE r <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY key DESC, item) AS place FROM g) SELECT source_id, item, place FROM k WHERE place <= 2""",
    "source_quota_select": f"WITH {QUOTA}{quota('it', 3, 'a')} SELECT source_id, item, place, filled FROM aqt",
    "partitioned_quota_select": f"""WITH {QUOTA}{quota('it', 2, 'a')}, rest AS (SELECT it.* FROM it ANTI JOIN aqt ON aqt.source_id = it.source_id AND aqt.item = it.item), {quota('rest', 2, 'b')}
SELECT source_id, item, 0 AS part, place FROM aqt UNION ALL SELECT source_id, item, 1, place FROM bqt""",
    "padded_slots": f"""WITH {ITEMS}, r AS (SELECT source_id, item, row_number() OVER (PARTITION BY source_id ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM it)
SELECT source_id, item, slot FROM r JOIN (SELECT unnest(range(6)) AS slot) ON slot % n = i""",
    "candidate_union_dedup": """
SELECT l_orderkey AS source_id, l_suppkey AS edge_key, min(l_returnflag) AS pool FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "teacher_exclusion": """
SELECT l_orderkey AS source_id, l_partkey AS edge_key, l_returnflag AS label FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'A' AND t.l_orderkey = l.l_orderkey AND t.l_partkey = l.l_partkey)""",
    "teacher_pick": f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item) AS r FROM it) SELECT source_id, item FROM r WHERE r = 1",
    "replay_mix": f"""WITH {ITEMS}, {LINES_AS_SLOTS},
u AS (SELECT *, slot % 2 = 1 AND {rnd("'1'", "'replay'", "source_id", "slot")} / 4294967296.0::DOUBLE < 0.4 AS replayed FROM sl)
SELECT source_id, slot, CASE WHEN replayed THEN 'bank:' || item ELSE item END AS nodes, replayed FROM u""",
    "metric_auc": f"WITH {PRED}, {AUC} SELECT protocol, round(auc, 6) AS auc FROM au",
    "metric_average_precision": f"WITH {PRED}, {CURVE} SELECT protocol, round(sum(p / pos::DOUBLE * (tp / al::DOUBLE)), 6) AS ap FROM cv GROUP BY protocol",
    "metric_ndcg": f"""WITH {PRED},
o AS (SELECT protocol, score, label, row_number() OVER (PARTITION BY protocol ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY protocol ORDER BY label DESC) AS b FROM pd),
t AS (SELECT protocol, score, avg(label) * sum(1 / log2(r + 1)) AS g FROM o GROUP BY protocol, score),
i AS (SELECT protocol, sum(1 / log2(b + 1)) AS i FROM o WHERE label = 1 GROUP BY protocol)
SELECT protocol, round(sum(g) / any_value(i), 6) AS ndcg FROM t JOIN i USING (protocol) GROUP BY protocol""",
    "metric_mrr": f"WITH {PRED}, o AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY score DESC, pos) AS r FROM pd) SELECT protocol, round(avg(1.0::DOUBLE / r), 6) AS mrr FROM o WHERE label = 1 GROUP BY protocol",
    "metric_precision_f1": f"""WITH {PRED}, c AS (SELECT protocol, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn FROM pd GROUP BY protocol)
SELECT protocol, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c""",
    "youden_threshold": f"""WITH {PRED}, {CURVE}, g AS (SELECT protocol, score, round(tp / pos::DOUBLE - (al - tp) / neg::DOUBLE, 9) AS g FROM cv),
r AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY g DESC, score DESC) AS r FROM g)
SELECT protocol, round(least(greatest(score, 0), 1), 6) AS threshold, round(g, 6) AS gain FROM r WHERE r = 1""",
    "checkpoint_objective": f"WITH {PRED}, {AUC} SELECT round(sum(auc * CASE protocol WHEN '1-URGENT' THEN 3.0::DOUBLE ELSE 1 END) / sum(CASE protocol WHEN '1-URGENT' THEN 3.0::DOUBLE ELSE 1 END), 6) AS weighted, round(min(auc), 6) AS least FROM au",
    "checkpoint_objectives": f"""WITH {EVALUATED},
w AS (SELECT auc, ap, 0.25::DOUBLE * auc + 0.75::DOUBLE * ap AS mix, CASE protocol WHEN '1-URGENT' THEN 3.0::DOUBLE ELSE 1 END AS w FROM ev)
SELECT round(sum(auc * w) / sum(w), 6) AS mean_auc, round(min(auc), 6) AS min_auc, round(sum(ap * w) / sum(w), 6) AS mean_ap, round(min(ap), 6) AS min_ap,
       round(sum(mix * w) / sum(w), 6) AS mean_auc_ap, round(min(mix), 6) AS min_auc_ap FROM w""",
    "protocol_evaluation": f"WITH {EVALUATED} SELECT protocol, positives, negatives, round(auc, 6) AS auc, round(ap, 6) AS ap FROM ev",
    "validation_batches": f"WITH {BATCHES} SELECT protocol, pos, label, score FROM pd",
    "bank_violations": f"""WITH {INC}, {SETS}, so AS (SELECT edge_id, size FROM st WHERE size >= 2),
bk AS (SELECT l_orderkey AS source_id, list_sort(list_distinct([l_partkey, l_suppkey])) AS nodes FROM lineitem),
per AS (SELECT source_id, count(*) AS n FROM bk GROUP BY source_id)
SELECT (SELECT count(*) FROM so WHERE edge_id NOT IN (SELECT source_id FROM per)) AS sources_missing,
       (SELECT count(*) FROM per WHERE source_id NOT IN (SELECT edge_id FROM so)) AS sources_unknown,
       (SELECT count(*) FROM per WHERE n <> 4) AS wrong_count,
       (SELECT count(*) FROM bk JOIN so ON edge_id = source_id WHERE len(nodes) <> size) AS wrong_size,
       (SELECT count(*) FROM bk WHERE list_max(nodes) >= 1500 OR list_min(nodes) < 0) AS out_of_range,
       (SELECT count(*) FROM bk WHERE nodes IN (SELECT nodes FROM st)) AS known_edges""",
    "nearest_mean": f"WITH {INC}, {SIZE}, {SETS}, {NEAREST} SELECT round(avg(coalesce(r, 0)), 6) AS mean_nearest FROM sz LEFT JOIN nea USING (edge_id)",
    "source_sample": f"WITH {INC}, {SIZE} SELECT edge_id, size FROM sz ORDER BY {rnd("'1'", "'source'", "edge_id")}, edge_id LIMIT 100",
    "source_minibatches": f"WITH {INC}, {SIZE} SELECT edge_id, (row_number() OVER (ORDER BY {rnd("'1'", "'batch'", "edge_id")}, edge_id) - 1) // 128 AS batch FROM sz",
    "teacher_retrieval_split": f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item) AS place FROM it)
SELECT source_id, item, place, CASE WHEN place = 1 THEN 'teacher' ELSE 'retrieval' END AS role FROM r WHERE place <= 3""",
    "calibrated_bounds": f"""WITH {OBSERVED}
SELECT round({_bound('closure')}, 6) AS closure_bound, round(quantile_disc(closure, 0.9), 6) AS closure_stat, round(avg((closure <= 0)::INT), 6) AS closure_zero_rate,
       round({_bound('residual')}, 6) AS residual_bound, round(quantile_disc(residual, 0.9), 6) AS residual_stat, round(avg((residual <= 0)::INT), 6) AS residual_zero_rate FROM ob""",
    "calibrated_budget": f"""WITH {OBSERVED}, bd AS (SELECT {_bound('closure')} AS a, {_bound('residual')} AS b FROM ob)
SELECT round(quantile_cont(closure / a + residual / b, 0.8), 6) AS budget FROM ob CROSS JOIN bd""",
    "future_positive_hits": f"""WITH {SPLIT}, tn AS (SELECT edge_id, nodes, size FROM sp WHERE split = 'train'),
{uniform_edges('source_size').replace("FROM st CROSS JOIN", "FROM tn CROSS JOIN").replace("SELECT st.edge_id", "SELECT tn.edge_id").replace(KNOWN, KNOWN.replace("FROM st", "FROM tn"))}
SELECT count(*) FILTER (WHERE nodes IN (SELECT nodes FROM sp WHERE split <> 'train')) AS hits, count(*) AS samples,
       round(count(*) FILTER (WHERE nodes IN (SELECT nodes FROM sp WHERE split <> 'train')) / count(*)::DOUBLE, 6) AS hit_rate FROM us""",
    "negative_quality": f"""WITH {BASE}, {SETS}, {anchored('ceil(source_size / 2)::BIGINT', False)},
c AS (SELECT source_id AS id, arg_min(nodes, attempt) AS nodes, any_value(source) AS source FROM an GROUP BY source_id), {CLOSURE_OF}, {NEAREST_OF},
q AS (SELECT c.id, coalesce(clo, 0) AS clo, coalesce(near, 0) AS near, len(list_intersect(nodes, source)) / (len(nodes) + len(source) - len(list_intersect(nodes, source)))::DOUBLE AS j, coalesce(clo, 0) / (1 + coalesce(clo, 0)) AS h FROM c LEFT JOIN cl USING (id) LEFT JOIN cx USING (id))
SELECT round(avg(h), 6) AS mean_hardness, round(avg((h BETWEEN 0.1 AND 0.3)::INT), 6) AS hard_ratio, round(avg(j), 6) AS mean_source_jaccard, round(avg(near), 6) AS mean_nearest, round(avg(clo), 6) AS mean_closure FROM q""",
    "feature_row_normalize": """
WITH e AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT node_id, v, list_sum(v) AS s FROM e),
u AS (SELECT node_id, unnest(range(len(v))) AS dim, unnest(v) AS x, s FROM s)
SELECT node_id, dim, round(CASE WHEN s > 0 THEN x / s ELSE x END, 6) AS value FROM u""",
    "edge_pool_stats": f"WITH {INC}, {FEATS} SELECT edge_id, dim, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0) + 1e-8), 6) AS std, round(ln(1 + count(*)), 6) AS log_size FROM inc JOIN ft USING (node_id) GROUP BY edge_id, dim",
    "edge_norms": f"WITH {INC}, {FEATS} SELECT edge_id, dim, round(avg(value), 6) AS mean, round(sum(value) / sqrt(count(*)), 6) AS scaled FROM inc JOIN ft USING (node_id) GROUP BY edge_id, dim",
    "incidence_propagation": f"WITH {INC}, {FEATS}, e AS (SELECT edge_id, dim, avg(value) AS v FROM inc JOIN ft USING (node_id) GROUP BY edge_id, dim) SELECT node_id, dim, round(avg(v), 6) AS value FROM inc JOIN e USING (edge_id) GROUP BY node_id, dim",
    "weighted_propagation": f"""WITH {INC}, {SIZE}, {FEATS}, g AS (SELECT node_id, 1 / sqrt(count(*)) AS w FROM inc GROUP BY node_id),
e AS (SELECT edge_id, dim, sum(w * value) / sum(w) AS v FROM inc JOIN ft USING (node_id) JOIN g USING (node_id) GROUP BY edge_id, dim)
SELECT node_id, dim, round(sum(v / sqrt(size)) / sum(1 / sqrt(size)), 6) AS value FROM inc JOIN e USING (edge_id) JOIN sz USING (edge_id) GROUP BY node_id, dim""",
    "clique_product": f"""WITH {INC}, {PAIRS}, {FEATS}, bw AS (SELECT x, y FROM pr UNION ALL SELECT y, x FROM pr UNION ALL SELECT DISTINCT node_id, node_id FROM inc),
cx AS (SELECT x, y, count(*) AS c FROM bw GROUP BY x, y), rd AS (SELECT x, sum(c) AS d FROM cx GROUP BY x)
SELECT cx.x AS node_id, dim, round(sum(round(c / (sqrt(a.d) * sqrt(b.d)), 12) * value), 6) AS value FROM cx JOIN rd a ON a.x = cx.x JOIN rd b ON b.x = cx.y JOIN ft ON ft.node_id = cx.y GROUP BY cx.x, dim""",
    "cosine_topk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM s)
SELECT query_id, vec_id, round(s, 6) AS similarity, place FROM r WHERE place <= 10""",
    "loss_bce_gce": f"""WITH {LOGITS}
SELECT round(avg(({softplus('logit')} - label * logit) * weight), 6) AS bce,
       round(avg(weight * CASE WHEN label = 1 THEN {softplus('-logit')} ELSE (1 - pow(greatest(1 - 1 / (1 + exp(-logit)), 1e-7), 0.7)) / 0.7::DOUBLE END), 6) AS gce FROM lg""",
    "loss_nnpu": f"""WITH {LOGITS}, a AS (
SELECT least(greatest(avg(1 - weight) FILTER (WHERE label = 0), 0), 0.5) AS prior, avg({softplus('-logit')}) FILTER (WHERE label = 1) AS pr,
       avg({softplus('logit')} * weight) FILTER (WHERE label = 0) AS ur, avg({softplus('logit')}) FILTER (WHERE label = 1) AS pn FROM lg)
SELECT round(prior, 6) AS prior, round(pr + greatest(ur - prior * pn, 0), 6) AS nnpu FROM a""",
    "loss_pairwise": f"""WITH {LOGITS}, g AS (SELECT source_id, avg(1 / (1 + exp(-logit))) FILTER (WHERE label = 0) AS n, avg(1 / (1 + exp(-logit))) FILTER (WHERE label = 1) AS p FROM lg GROUP BY source_id)
SELECT round(avg({softplus('(n - p)')}), 6) AS pairwise FROM g WHERE n IS NOT NULL AND p IS NOT NULL""",
    "loss_weights": f"WITH {COMBINED} SELECT cand_id, round(greatest(0.1, exp(-ln(2) / 3 * round(s, 6))), 6) AS weight FROM rs",
    "streaming_pair_support": f"WITH {INC}, {PAIRS}, {SUPPORT} SELECT x, y, support FROM su",
}
