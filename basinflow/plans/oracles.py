"""DuckDB SQL for the clustering queries, put together from shared common table expressions."""

from __future__ import annotations

from basinflow.sources.tables import ELEVEN_DENSITIES, ELEVEN_NEIGHBOURS, ELEVEN_THRESHOLDS

K, DIM = 10, 64


def vectors(name: str = "e", value: str = "x") -> str:
    return f"{name} AS (SELECT vec_id AS id, list_transform(embedding, lambda x: {value}::DOUBLE) AS v, label FROM embeddings)"


def gap_sum(p: int) -> str:
    gap = "abs(z[1] - z[2])"
    term = {1: gap, 2: f"{gap} * {gap}"}.get(p, f"pow({gap}, {p})")
    return f"list_sum(list_transform(list_zip(a.v, b.v), lambda z: {term}))"


def neighbours(dist: str = gap_sum(2), shift: int = 0, base: str = "e") -> str:
    """``knn(i, rk, j, dist)``."""
    return f"""all_pairs AS (SELECT a.id AS i, b.id + {shift} AS j, {dist} AS dist FROM {base} a, {base} b),
    knn AS MATERIALIZED (SELECT i, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk, j, dist FROM all_pairs QUALIFY rk <= {K})"""


def cell_neighbours(cells: int, probed: int) -> str:
    """``knn(i, rk, j, dist)`` within the ``probed`` nearest of the cells around ``cells`` rows."""
    return f"""centre AS MATERIALIZED (SELECT id, v FROM e ORDER BY md5('47 ' || id), id LIMIT {cells}),
    cells AS MATERIALIZED (SELECT a.id, b.id AS c, row_number() OVER (PARTITION BY a.id ORDER BY {gap_sum(2)}, b.id) AS nth FROM e a, centre b),
    all_pairs AS (SELECT a.id AS i, b.id AS j, {gap_sum(2)} AS dist FROM cells q JOIN cells o ON o.c = q.c AND o.nth = 1 AND q.nth <= {probed} JOIN e a ON a.id = q.id JOIN e b ON b.id = o.id),
    knn AS MATERIALIZED (SELECT i, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk, j, dist FROM all_pairs QUALIFY rk <= {K})"""


DENSITY = f"dens AS MATERIALIZED (SELECT i, {-DIM / 2} * ln(avg(dist * dist)) AS f FROM knn GROUP BY i)"
UPHILL = "up AS MATERIALIZED (SELECT k.i, k.rk, k.j, a.f AS fi, b.f AS fj FROM knn k JOIN dens a ON a.i = k.i JOIN dens b ON b.i = k.j WHERE b.f > a.f)"
PARENTS = "par AS MATERIALIZED (SELECT d.i, coalesce(arg_max(u.j, (u.fj, -u.rk)), d.i) AS parent FROM dens d LEFT JOIN up u ON u.i = d.i GROUP BY d.i)"
CHASE = """chase AS (SELECT i, parent AS root FROM par UNION SELECT c.i, p.parent FROM chase c JOIN par p ON p.i = c.root WHERE p.parent <> c.root),
    roots AS MATERIALIZED (SELECT c.i, c.root FROM chase c JOIN par p ON p.i = c.root WHERE p.parent = p.i)"""
BASE = f"WITH RECURSIVE {vectors()}, {neighbours()}, {DENSITY}"
MODES = f"{BASE}, {UPHILL}, {PARENTS}, {CHASE}"


def sweep(taus: str, start: str = BASE, joins: str = "root[g]") -> str:
    """The sequential sweep: ``fin(tau, root, pairs)`` in ranks and ``ord(i, f, s)``; a vertex ``joins`` the
    cluster of its densest neighbour, or the densest cluster (``cm``)."""
    return f"""{start},
    ord AS MATERIALIZED (SELECT i, f, row_number() OVER (ORDER BY f DESC, i) AS s FROM dens),
    levels AS (SELECT list(f ORDER BY s) AS fs, max(s) AS n FROM ord),
    nb AS MATERIALIZED (SELECT o.s, o.f, list(p.s) FILTER (p.f > o.f) AS js, arg_max(p.s, (p.f, -k.rk)) FILTER (p.f > o.f) AS g
        FROM ord o LEFT JOIN knn k ON k.i = o.i LEFT JOIN ord p ON p.i = k.j GROUP BY o.s, o.f),
    st AS (SELECT unnest({taus})::DOUBLE AS tau, 0::BIGINT AS s, []::BIGINT[] AS root, []::STRUCT(birth BIGINT, death BIGINT)[] AS pairs
        UNION ALL
        SELECT tau, s, CASE WHEN g IS NULL THEN list_append(root, s) ELSE list_transform(list_append(root, {joins}), lambda r: CASE WHEN list_contains(dead, r) THEN cm ELSE r END) END,
            CASE WHEN g IS NULL THEN pairs ELSE list_concat(pairs, list_transform(dead, lambda c: {{'birth': c, 'death': s}})) END
        FROM (SELECT tau, s, g, root, pairs, cm, list_filter(seen, lambda c: c <> cm AND fs[c] - f < tau) AS dead
            FROM (SELECT tau, s, g, f, root, pairs, seen, list_min(seen) AS cm, fs
                FROM (SELECT st.tau, nb.s, nb.g, nb.f, st.root, st.pairs, l.fs, list_distinct(list_transform(nb.js, lambda x: st.root[x])) AS seen FROM st JOIN nb ON nb.s = st.s + 1, levels l)))),
    fin AS MATERIALIZED (SELECT tau, root, pairs FROM st WHERE s = (SELECT n FROM levels)),
    cut AS (SELECT tau, unnest(pairs) AS p FROM fin),
    ended AS (SELECT c.tau, a.i AS birth, b.i AS death, a.f AS birth_density, b.f AS death_density, a.f - b.f AS persistence FROM cut c JOIN ord a ON a.s = c.p.birth JOIN ord b ON b.s = c.p.death),
    alive AS (SELECT DISTINCT r.tau, o.i AS birth, o.f AS birth_density FROM (SELECT tau, unnest(root) AS s FROM fin) r JOIN ord o ON o.s = r.s)"""


#: Thresholds as Spark writes them.
TAU_TEXT = "CASE WHEN tau = 'inf'::DOUBLE THEN 'Infinity' ELSE printf('%.1f', tau) END AS tau"
SWEEP = sweep("[0, 0.5, 2, 'inf'::DOUBLE]")
GREEDY = sweep("[0, 0.5, 2, 'inf'::DOUBLE]", joins="cm")
LAST = sweep("['inf'::DOUBLE]")
ASSIGNED = f"SELECT {TAU_TEXT}, a.i, b.i AS root FROM (SELECT tau, unnest(root) AS r, unnest(range(1, len(root) + 1)) AS s FROM fin) x JOIN ord a ON a.s = x.s JOIN ord b ON b.s = x.r"
RANKED = """, ranked AS (SELECT birth, death, birth_density, death_density, persistence, row_number() OVER (ORDER BY persistence DESC, birth, death) AS rank FROM ended
    UNION ALL SELECT birth, NULL, birth_density, NULL, NULL, NULL FROM alive)"""
COUNTS = """, ct AS MATERIALIZED (SELECT e.label::BIGINT AS truth, r.root AS pred, count(*) AS n FROM roots r JOIN e ON e.id = r.i GROUP BY 1, 2), ma AS (SELECT truth, sum(n)::BIGINT AS a FROM ct GROUP BY 1), mb AS (SELECT pred, sum(n)::BIGINT AS b FROM ct GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS t FROM ct)"""
TABLE = f"{MODES}{COUNTS}"
MUTUAL = """, mu AS (SELECT greatest(sum(n / t * ln(n * t / (a::DOUBLE * b))), 0) AS mi FROM ct JOIN ma USING (truth) JOIN mb USING (pred), tot),
    ha AS (SELECT -sum(a / t * ln(a / t)) AS h FROM ma, tot), hb AS (SELECT -sum(b / t * ln(b / t)) AS h FROM mb, tot)"""
EXPECTED = """, terms AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS m FROM ma, mb, tot),
    em AS (SELECT sum(m / t * ln(t::DOUBLE * m / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1)
        - lgamma(t + 1) - lgamma(m + 1) - lgamma(a - m + 1) - lgamma(b - m + 1) - lgamma(t - a - b + m + 1))) AS emi FROM terms)"""
PAIRS_OF = "{0}::DOUBLE * ({0} - 1) / 2"
ARI = f"""(SELECT sum({PAIRS_OF.format("n")}) AS agreeing FROM ct), (SELECT sum({PAIRS_OF.format("a")}) AS pa FROM ma), (SELECT sum({PAIRS_OF.format("b")}) AS pb FROM mb), tot"""
ARI_VALUE = "(agreeing - pa * pb / (t * (t - 1.0) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1.0) / 2))"
AMI_VALUE = "(mi - emi) / ((ha.h + hb.h) / 2 - emi)"
#: Most rows in agreement: clusters one by one, best total for every set of classes used so far.
HITS = """, cl AS (SELECT truth, row_number() OVER (ORDER BY truth) - 1 AS bit FROM ma), cb AS (SELECT pred, row_number() OVER (ORDER BY pred) AS c FROM mb),
    gains AS MATERIALIZED (SELECT c, list({'bit': bit, 'n': n}) AS gs FROM ct JOIN cl USING (truth) JOIN cb USING (pred) GROUP BY c),
    dp AS (SELECT 0::BIGINT AS c, list_transform(range(0, (SELECT (1 << count(*)::INT) FROM cl)), lambda m: CASE WHEN m = 0 THEN 0 ELSE -1000000000 END)::BIGINT[] AS v
        UNION ALL
        SELECT g.c, list_transform(range(0, len(v)), lambda m: greatest(v[m + 1], coalesce(list_max(list_transform(list_filter(gs, lambda x: (m >> x.bit::INT) & 1 = 1), lambda x: v[m - (1 << x.bit::INT) + 1] + x.n)), -1000000000)))::BIGINT[]
        FROM dp JOIN gains g ON g.c = dp.c + 1),
    best AS (SELECT list_max(v) AS hits FROM dp WHERE c = (SELECT max(c) FROM gains))"""
CENTRES = """, near AS (SELECT a.id AS i, b.id AS centre, row_number() OVER (PARTITION BY a.id ORDER BY """ + gap_sum(2) + """, b.id) AS nth
    FROM e a, e b WHERE b.id IN (SELECT root FROM roots))"""


def scores(tau: str) -> str:
    """Scores of the clusters ``asg(tau, i, root)`` at one threshold."""
    return f"""SELECT * FROM (WITH RECURSIVE roots AS MATERIALIZED (SELECT i, root FROM asg WHERE tau = {tau}){COUNTS}{MUTUAL}{EXPECTED}{HITS}{CENTRES}
        SELECT {tau} AS tau, (SELECT count(*) FROM mb) AS clusters, (SELECT avg((root = centre)::INT) FROM near JOIN roots USING (i) WHERE nth = 1) AS agreement,
            {AMI_VALUE} AS ami, mi / ((ha.h + hb.h) / 2) AS nmi, 100.0 * hits / t AS accuracy FROM mu, ha, hb, em, best, tot)"""


EXPERIMENT_TAUS = ["0::DOUBLE", "1::DOUBLE", "2::DOUBLE", "'inf'::DOUBLE"]


def covering(budget: int, group_rows: int) -> str:
    """``st2(position, id, far)``: farthest first in groups, then among what they chose."""
    walk = lambda n: f"""gaps{n} AS MATERIALIZED (SELECT a.part, a.nth, any_value(a.id) AS id, list({gap_sum(2)} ORDER BY b.nth) AS ds FROM pool{n} a JOIN pool{n} b ON a.part = b.part GROUP BY a.part, a.nth),
        st{n} AS (SELECT part, 0 AS position, id, ds, NULL::DOUBLE AS far FROM gaps{n} WHERE nth = 1
            UNION ALL
            SELECT s.part, s.position + 1, g.id, list_transform(list_zip(s.ds, g.ds), lambda z: least(z[1], z[2])), sqrt(list_max(s.ds))
            FROM st{n} s JOIN gaps{n} g ON g.part = s.part AND g.nth = list_position(s.ds, list_max(s.ds)) WHERE s.position < {budget - 1})"""  # noqa: E731
    return f"""WITH RECURSIVE {vectors()}, keyed AS MATERIALIZED (SELECT id, v, md5('47 ' || id) AS key FROM e),
        pool1 AS MATERIALIZED (SELECT ('0x' || substr(key, 1, 7))::BIGINT % g AS part, id, v, row_number() OVER (PARTITION BY ('0x' || substr(key, 1, 7))::BIGINT % g ORDER BY key, id) AS nth
            FROM keyed, (SELECT ceil(count(*) / {group_rows}::DOUBLE)::BIGINT AS g FROM e)),
        {walk(1)},
        pool2 AS MATERIALIZED (SELECT 0 AS part, id, v, row_number() OVER (ORDER BY key, id) AS nth FROM keyed WHERE id IN (SELECT id FROM st1)),
        {walk(2)}"""


def experiment(start: str, taus: str, each: list[str]) -> str:
    return f"""{sweep(taus, start)}, asg AS MATERIALIZED (SELECT tau, a.i, b.i AS root FROM (SELECT tau, unnest(root) AS r, unnest(range(1, len(root) + 1)) AS s FROM fin) x JOIN ord a ON a.s = x.s JOIN ord b ON b.s = x.r)
        SELECT {TAU_TEXT}, clusters, round(agreement, 6) AS agreement, round(ami, 6) AS ami, round(nmi, 6) AS nmi, round(accuracy, 6) AS accuracy
        FROM ({" UNION ALL ".join(scores(t) for t in each)})"""


def steps(p: str) -> str:
    values = {"max": "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))", "min": "list_min(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"}
    dist = values[p] if p in values else f"pow({gap_sum(int(p))}, 1.0 / {p})"
    return f"WITH {vectors()} SELECT a.id AS vec_id, round({dist}, 6) AS dist FROM e a JOIN e b ON b.id = a.id + 1"


def found(dist: str = gap_sum(2), out: str = "dist", **how) -> str:
    start = how.pop("start", vectors())
    return f"WITH {start}, {neighbours(dist, **how)} SELECT i, rk::INT AS rk, j, round({out}, 6) AS dist FROM knn"


def dens(expression: str) -> str:
    return f"WITH {vectors()}, {neighbours()} SELECT i, round({expression}, 6) AS f FROM knn GROUP BY i"


NODES = ", ".join(f"({i}, {f})" for i, f in enumerate(ELEVEN_DENSITIES))
LINKS = ", ".join(f"({i}, {rk}, {j})" for i, row in enumerate(ELEVEN_NEIGHBOURS) for rk, j in enumerate(row, 1))
TOY = f"WITH RECURSIVE dens AS (SELECT i::BIGINT AS i, f::DOUBLE AS f FROM (VALUES {NODES}) t(i, f)), knn AS (SELECT i::BIGINT AS i, rk, j::BIGINT AS j FROM (VALUES {LINKS}) t(i, rk, j))"

SQL: dict[str, str] = {
    "cluster_sizes": f"{MODES} SELECT root, count(*) AS size FROM roots GROUP BY root",
    "pnorm_l1": steps("1"),
    "pnorm_l2": steps("2"),
    "pnorm_l3": steps("3"),
    "pnorm_max": steps("max"),
    "pnorm_min": steps("min"),
    "knn_exact": found(),
    "knn_lp": found(gap_sum(1)),
    "knn_rooted": found(out="sqrt(dist)"),
    "knn_normalized": found(gap_sum(1), start=f"{vectors('raw')}, e AS (SELECT id, list_transform(v, lambda x: x / greatest(list_sum(list_transform(v, lambda y: abs(y))), 1e-12)) AS v FROM raw)"),
    "knn_cross": found(shift=1_000_000),
    "knn_packed": f"WITH {vectors()}, {neighbours()} SELECT i, count(*) AS size, string_agg(j::VARCHAR, ',' ORDER BY rk) AS js FROM knn GROUP BY i",
    "knn_ivf_full_probe": found(),
    "dtm": f"WITH {vectors()}, {neighbours()} SELECT i, round(sqrt(avg(dist)), 6) AS dtm FROM knn GROUP BY i",
    "dtm_density": dens("1 / avg(dist * dist)"),
    "dtm_density_normalized": f"WITH {vectors()}, {neighbours()}, n AS (SELECT count(*) AS n FROM e), s AS (SELECT avg(x) AS s FROM range(1, {K + 1}) r(x)) SELECT i, round(1 / (avg(dist * dist) / any_value(s)) / (any_value(n) * pi()), 6) AS f FROM knn, n, s GROUP BY i",
    "dtm_density_weighted": dens(f"1 / sum(dist * dist * ({K + 1} - rk) / {K * (K + 1) / 2})"),
    "log_density": f"{BASE} SELECT i, round(f, 6) AS f FROM dens",
    "uphill_edges": f"{BASE}, {UPHILL} SELECT i, rk::INT AS rk, j FROM up",
    "steepest_parent": f"{BASE}, {UPHILL}, {PARENTS} SELECT i, parent FROM par",
    "local_maxima": f"{BASE}, {UPHILL} SELECT i, round(f, 6) AS f FROM dens WHERE i NOT IN (SELECT i FROM up)",
    "mode_seeking": f"{MODES} SELECT i, root FROM roots",
    "mode_labels": f"{MODES} SELECT i, root, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots",
    "saddles": f"{MODES} SELECT u.i, count(DISTINCT r.root) AS basins, arg_min(r.root, u.rk) AS first FROM up u JOIN roots r ON r.i = u.j GROUP BY u.i HAVING count(DISTINCT r.root) >= 2",
    "h0_tau_sweep": f"{SWEEP} {ASSIGNED}",
    "h0_greedy": f"{GREEDY} {ASSIGNED}",
    "pairs_below": f"{LAST} SELECT birth, death, round(persistence, 6) AS persistence FROM ended WHERE persistence < 2",
    "h0_pairs": f"{SWEEP} SELECT {TAU_TEXT}, birth, death, round(persistence, 6) AS persistence FROM ended UNION ALL SELECT {TAU_TEXT}, birth, NULL, NULL FROM alive",
    "persistence_pairs": f"{LAST}{RANKED} SELECT birth, death, round(birth_density, 6) AS birth_density, round(death_density, 6) AS death_density, round(persistence, 6) AS persistence, rank FROM ranked",
    "cluster_counts": f"{SWEEP} SELECT {TAU_TEXT}, count(*) AS clusters FROM alive GROUP BY 1",
    "components": f"{LAST}{RANKED} SELECT row_number() OVER (ORDER BY death IS NOT NULL, rank, birth) - 1 AS position, birth FROM ranked",
    "persistence_rank": f"{LAST}{RANKED} SELECT rank + (SELECT count(*) FROM alive) AS x, round(persistence, 6) AS persistence FROM ranked WHERE death IS NOT NULL",
    "persistence_diagram": f"{LAST}{RANKED} SELECT birth, round(birth_density, 6) AS x, round(coalesce(death_density, lo - 0.08 * (hi - lo)), 6) AS y, death IS NULL AS infinite FROM ranked, (SELECT min(death_density) AS lo, max(death_density) AS hi FROM ranked)",
    "saliency_shrinkage": f"{LAST}{RANKED} SELECT round(-s, 5) AS saliency, round(r, 5) AS shrinkage, round(r - s, 5) AS loss FROM (SELECT coalesce(sum(persistence) FILTER (rank <= 9), 0) AS s, coalesce(sum(persistence) FILTER (rank >= 10), 0) AS r FROM ranked)",
    "loss_gradient": f"{LAST}{RANKED} SELECT i, sum(g)::DOUBLE AS gradient FROM (SELECT birth AS i, CASE WHEN rank <= 9 THEN -1 ELSE 1 END AS g FROM ranked WHERE death IS NOT NULL UNION ALL SELECT death, CASE WHEN rank <= 9 THEN 1 ELSE -1 END FROM ranked WHERE death IS NOT NULL) GROUP BY i",
    "point_gradient": f"""{LAST}{RANKED}, slopes AS (SELECT i, sum(g)::DOUBLE AS g FROM (SELECT birth AS i, CASE WHEN rank <= 9 THEN -1 ELSE 1 END AS g FROM ranked WHERE death IS NOT NULL
            UNION ALL SELECT death, CASE WHEN rank <= 9 THEN 1 ELSE -1 END FROM ranked WHERE death IS NOT NULL) GROUP BY i),
        measures AS (SELECT i, avg(dist * dist) AS m, count(*) AS k FROM knn GROUP BY i),
        weights AS (SELECT n.i, n.j, g * -{DIM}.0 / m / k * dist * 2 AS w FROM knn n JOIN slopes s ON s.i = n.i JOIN measures u ON u.i = n.i WHERE n.i <> n.j),
        steps AS (SELECT w.i, w.j, unnest(list_transform(list_zip(a.v, b.v), lambda z: w.w * (z[1] - z[2]))) AS x, unnest(range(0, {DIM})) AS pos FROM weights w JOIN e a ON a.id = w.i JOIN e b ON b.id = w.j),
        sums AS (SELECT i, pos, sum(x) AS x FROM (SELECT i, pos, x FROM steps UNION ALL SELECT j, pos, -x FROM steps) GROUP BY i, pos)
        SELECT i, round(sqrt(sum(x * x)), 5) AS norm FROM sums GROUP BY i""",
    "toy_graph_edges": f"{TOY} SELECT k.j AS src, k.i AS dst, round(a.f - b.f, 2) AS weight FROM knn k JOIN dens a ON a.i = k.i JOIN dens b ON b.i = k.j",
    "toy_h0": f"{sweep(str(ELEVEN_THRESHOLDS), TOY)} SELECT tau, a.i, b.i AS root FROM (SELECT tau, unnest(root) AS r, unnest(range(1, len(root) + 1)) AS s FROM fin) x JOIN ord a ON a.s = x.s JOIN ord b ON b.s = x.r",
    "contingency": f"{TABLE} SELECT truth, pred, n FROM ct",
    "encoded_contingency": f"{TABLE} SELECT dense_rank() OVER (ORDER BY truth) - 1 AS row, dense_rank() OVER (ORDER BY pred) - 1 AS col, n FROM ct",
    "ari": f"{TABLE} SELECT round({ARI_VALUE}, 6) AS ari FROM {ARI}",
    "nmi": f"{TABLE}{MUTUAL} SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM mu, ha, hb",
    "ami": f"{TABLE}{MUTUAL}{EXPECTED} SELECT round({AMI_VALUE}, 6) AS ami FROM mu, ha, hb, em",
    "clustering_accuracy": f"{TABLE}{HITS} SELECT round(100.0 * hits / t, 6) AS accuracy FROM best, tot",
    "optimal_assignment": f"{TABLE}{HITS} SELECT hits FROM best",
    "clustering_metrics": f"""{TABLE}{MUTUAL}{EXPECTED}{HITS} SELECT 'modes/ARI' AS metric, round({ARI_VALUE}, 6) AS value FROM {ARI}
        UNION ALL SELECT 'modes/AMI', round({AMI_VALUE}, 6) FROM mu, ha, hb, em UNION ALL SELECT 'modes/NMI', round(mi / ((ha.h + hb.h) / 2), 6) FROM mu, ha, hb
        UNION ALL SELECT 'modes/Cluster_Acc/Total', round(hits / t, 6) FROM best, tot""",
    "class_metrics": """WITH t AS (SELECT label, vec_id % 6 <> 0 AS hit FROM embeddings),
        c AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS position, avg(hit::INT) AS value FROM t GROUP BY label)
        SELECT 'Cluster_Acc/' || position AS metric, round(value, 6) AS value FROM c UNION ALL SELECT 'Cluster_Acc/Total', round(avg(hit::INT), 6) FROM t""",
    "cluster_count": f"{MODES} SELECT count(DISTINCT root) AS clusters FROM roots",
    "dense_cost": """SELECT a.x::BIGINT AS row, b.x::BIGINT AS col, count(vec_id)::BIGINT AS n FROM range(0, 10) a(x) CROSS JOIN range(0, 10) b(x)
        LEFT JOIN embeddings ON label = a.x AND vec_id % 10 = b.x GROUP BY 1, 2""",
    "gather": "SELECT vec_id, label FROM range(0, 120) r(id) JOIN embeddings ON vec_id = id * 7 % 50 * 20",
    "density_of_points": dens("pow(avg(dist * dist), -0.5)"),
    "sample_rows": "SELECT vec_id, label FROM embeddings ORDER BY md5('47 ' || vec_id), vec_id LIMIT 300",
    "subgroup_id": "SELECT vec_id, ((label // 2) * 2 + label % 2)::BIGINT AS class FROM embeddings",
    "k_centre": f"{MODES}{CENTRES} SELECT i, centre FROM near WHERE nth = 1",
    "label_agreement": f"{MODES}{CENTRES} SELECT round(avg((root = centre)::INT), 6) AS agreement FROM near JOIN roots USING (i) WHERE nth = 1",
    "random_projection": f"""WITH {vectors()}, cells AS (SELECT r, c, ('0x' || substr(md5('47 ' || (r * 3 + c) || ' u'), 1, 13))::BIGINT / pow(2, 52) AS u,
            ('0x' || substr(md5('47 ' || (r * 3 + c) || ' v'), 1, 13))::BIGINT / pow(2, 52) AS w FROM range(0, {DIM}) a(r), range(0, 3) b(c)),
        m AS (SELECT r, c, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w) / 3 AS x FROM cells),
        long AS (SELECT id, unnest(v) AS y, unnest(range(0, len(v))) AS r FROM e) SELECT id AS vec_id, c AS component, round(sum(y * x), 6) AS value FROM long JOIN m USING (r) GROUP BY id, c""",
    "coreset_greedy": f"""WITH RECURSIVE {vectors()},
        pool AS MATERIALIZED (SELECT batch, id, v, row_number() OVER (PARTITION BY batch ORDER BY md5('47 ' || batch || ' ' || id), id) AS nth FROM e, range(0, 4) b(batch) QUALIFY nth <= 128),
        gaps AS MATERIALIZED (SELECT a.batch, a.nth, any_value(a.id) AS id, list({gap_sum(2)} ORDER BY b.nth) AS ds FROM pool a JOIN pool b ON a.batch = b.batch GROUP BY a.batch, a.nth),
        st AS (SELECT batch, 0 AS position, id, ds FROM gaps WHERE nth = 1
            UNION ALL
            SELECT s.batch, s.position + 1, g.id, list_transform(list_zip(s.ds, g.ds), lambda z: least(z[1], z[2]))
            FROM st s JOIN gaps g ON g.batch = s.batch AND g.nth = list_position(s.ds, list_max(s.ds)) WHERE s.position < 31)
        SELECT batch::INT AS batch, position::INT AS position, id FROM st""",
    "coreset_covering": f"{covering(16, 128)} SELECT position::INT AS position, id, round(far, 6) AS distance FROM st2",
    "covering_radius": f"{covering(16, 128)} SELECT round(sqrt(max(d)), 6) AS radius FROM (SELECT a.id, min({gap_sum(2)}) AS d FROM e a, e b WHERE b.id IN (SELECT id FROM st2) GROUP BY a.id)",
    "coreset_stream": f"""WITH RECURSIVE {vectors()}, keyed AS MATERIALIZED (SELECT id, v, md5('47 ' || id) AS key, ('0x' || substr(md5('47 ' || id), 1, 7))::BIGINT % 4 AS slot FROM e),
        pool AS MATERIALIZED (SELECT slot, (n - 1) // 32 AS batch, (n - 1) % 32 + 1 AS nth, id, v, count(*) OVER (PARTITION BY slot, (n - 1) // 32) AS size
            FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY key, id) AS n FROM keyed) QUALIFY size = 32),
        gaps AS MATERIALIZED (SELECT a.slot, a.batch, a.nth, any_value(a.id) AS id, list({gap_sum(2)} ORDER BY b.nth) AS ds FROM pool a JOIN pool b ON a.slot = b.slot AND a.batch = b.batch GROUP BY a.slot, a.batch, a.nth),
        st AS (SELECT slot, batch, 0 AS position, id, ds FROM gaps WHERE nth = 1
            UNION ALL
            SELECT s.slot, s.batch, s.position + 1, g.id, list_transform(list_zip(s.ds, g.ds), lambda z: least(z[1], z[2]))
            FROM st s JOIN gaps g ON g.slot = s.slot AND g.batch = s.batch AND g.nth = list_position(s.ds, list_max(s.ds)) WHERE s.position < 7)
        SELECT slot, batch, position::INT AS position, id FROM st""",
    "density_digraph": f"{BASE} SELECT k.j AS src, k.i AS dst, round(a.f - b.f, 2) AS weight FROM knn k JOIN dens a ON a.i = k.i JOIN dens b ON b.i = k.j",
    "archive_scan": f"WITH {vectors()} SELECT id AS vec_id, label::BIGINT AS label, round(list_sum(v), 6) AS total FROM e",
    "experiment": experiment(BASE, "[0, 1, 2, 'inf'::DOUBLE]", EXPERIMENT_TAUS),
    "experiment_ivf_given": experiment(f"WITH RECURSIVE {vectors()}, {cell_neighbours(5, 4)}, {DENSITY}", "[0, 'inf'::DOUBLE]", [EXPERIMENT_TAUS[0], EXPERIMENT_TAUS[-1]]),
    "knn_pruned": found(),
    "knn_ivf_given": f"WITH {vectors()}, {cell_neighbours(5, 4)} SELECT i, rk::INT AS rk, j, round(dist, 6) AS dist FROM knn",
    "no_reduction": f"WITH {vectors()} SELECT id AS vec_id, round(list_sum(v), 6) AS total FROM e",
}
SQL["metric_table"] = f"SELECT run, metric, value FROM ({SQL['class_metrics']}), (SELECT unnest(['first', 'second']) AS run)"
SQL["sparse_assignment"] = SQL["optimal_assignment"]
