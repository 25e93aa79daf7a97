"""The same results in plain SQL for DuckDB, on the given tables.

Queries are chains of common table expressions. Each function below appends
its expressions to a chain and assumes those named in its docstring.
"""

from __future__ import annotations

from mixframe import EvolveConfig
from mixframe.functions import hash_below

from . import points as src

CFG = src.EVENTS_CFG
P, D = "c0 c1 s0 s1".split(), ("x0", "x1")
# All components of the embeddings.
WIDTH = 64
ALL = tuple(f"x{k}" for k in range(WIDTH))


def parts(cfg: EvolveConfig) -> list[str]:
    return cfg.centre_cols + cfg.spread_cols


def product(cfg: EvolveConfig) -> str:
    """SQL for the square root of the product of the spreads."""
    return "sqrt(" + " * ".join(cfg.spread_cols) + ")"


def num(value: float) -> str:
    """A double literal (plain decimals would be exact numerics)."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def u(*parts) -> str:
    text = f"md5(concat_ws('|', {', '.join(map(str, parts))}))"
    return f"(CAST(CAST(('0x' || substr({text}, 1, 13)) AS BIGINT) AS DOUBLE) / {num(2**52)})"


def d2(a: str, b: str, s: str, dims: int = 2, bx: str = "c") -> str:
    """Squared distance of ``a``'s centre to ``b``'s in the spread of ``s``."""
    parts = [f"((({a}c{k} - {b}{bx}{k}) / {s}s{k}))" for k in range(dims)]
    return "(" + " + ".join(f"{p} * {p}" for p in parts) + ")"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0 AS {name}"


def rounds(names, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(r(prefix + n, n, digits) for n in names)


class Chain:
    """Common table expressions in order, closed by ``select``."""

    def __init__(self, *steps):
        self.ctes: list[tuple[str, str]] = []
        for step in steps:
            step(self)

    def add(self, name: str, sql: str) -> Chain:
        self.ctes.append((name, sql))
        return self

    def select(self, sql: str) -> str:
        body = ",\n".join(
            f"{name} AS ({sql})" if name.endswith("_fold") else f"{name} AS MATERIALIZED ({sql})"
            for name, sql in self.ctes
        )
        return f"WITH RECURSIVE {body}\n{sql}"


# --- point sets ---------------------------------------------------------------


def _cases(column: str, values) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(values))
    return f"CAST(CASE {column} {whens} END AS BIGINT)"


EVENTS = (
    "SELECT event_id AS point_id, value AS x0, CAST(hour(ts) AS DOUBLE) + "
    f"CAST(minute(ts) AS DOUBLE) / {num(60)} AS x1, "
    f"{_cases('event_type', src.EVENT_TYPES)} AS label, "
    "CAST(day(ts) AS BIGINT) AS day FROM events"
)
PARTS = (
    "SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1, "
    "p_brand AS label FROM part"
)
LINES = (
    "SELECT l_quantity AS x0, l_extendedprice AS x1, "
    f"{_cases('l_returnflag', src.RETURN_FLAGS)} AS label FROM lineitem"
)


def embeddings(dims: int) -> str:
    cols = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(dims))
    return f"SELECT vec_id AS point_id, {cols}, CAST(label AS BIGINT) AS label FROM embeddings"


def extent(source: str, dims=D) -> str:
    cols = ", ".join(f"min({d}) AS min_{d}, max({d}) AS max_{d}" for d in dims)
    return f"SELECT count(*) AS n, {cols} FROM {source}"


def scaled(sql: str, name: str = "pts", columns: str = "point_id, label", dims=D):
    """``name``: the source min-max scaled; ``name_ext``: its extent after that."""

    def step(chain: Chain):
        chain.add(f"{name}_raw", sql).add(f"{name}_was", extent(f"{name}_raw", dims))
        cols = ", ".join(f"(p.{d} - w.min_{d}) / (w.max_{d} - w.min_{d}) AS {d}" for d in dims)
        lead = f"{columns}, " if columns else ""
        chain.add(name, f"SELECT {lead}{cols} FROM {name}_raw p, {name}_was w")
        chain.add(f"{name}_ext", extent(name, dims))

    return step


# --- population -----------------------------------------------------------------


def first(cfg: EvolveConfig = CFG, pts: str = "pts", ext: str = "pts_ext", name: str = "pop0"):
    """The first population from ``pts`` and ``ext``."""

    def step(chain: Chain):
        total = cfg.runs * cfg.pop_size
        number = f"floor({u(cfg.seed, 'run_id', 0, chr(39) + 'draw' + chr(39), 'id')} * n)"
        chain.add(
            f"{name}_slots",
            f"SELECT run_id, id, dense_rank() OVER (ORDER BY number) AS pick FROM ("
            f"SELECT run_id, id, {number} AS number FROM (SELECT i // {cfg.pop_size} AS run_id, "
            f"i % {cfg.pop_size} AS id FROM range({total}) t(i)), {ext})",
        )
        hashed = f"md5(concat_ws('|', {cfg.seed}, 'point', point_id))"
        chain.add(
            f"{name}_ranked",
            f"SELECT row_number() OVER (ORDER BY {hashed}, point_id) AS pick, {', '.join(cfg.dims)} FROM {pts}",
        )
        spreads = ", ".join(
            f"{num(cfg.eps)} + {u(cfg.seed, 'run_id', 0, chr(39) + 'spread' + chr(39), 'id', k)} "
            f"* ((max_{d} - min_{d}) / {num(cfg.beta)}) AS s{k}"
            for k, d in enumerate(cfg.dims)
        )
        centres = ", ".join(f"{d} AS c{k}" for k, d in enumerate(cfg.dims))
        chain.add(
            name,
            f"SELECT run_id, id, {centres}, {spreads} "
            f"FROM {name}_slots JOIN {name}_ranked USING (pick), {ext}",
        )

    return step


def partners(cfg: EvolveConfig, gen: int, pop: str, name: str):
    """Three partners each, by shifting draws past the taken ids."""

    def step(chain: Chain):
        f = ", ".join(
            f"CAST(floor({u(cfg.seed, 'run_id', gen, chr(39) + 'partner' + chr(39), 'id', k)} * "
            f"{cfg.pop_size - k}) AS BIGINT) AS f{k}"
            for k in (1, 2, 3)
        )
        chain.add(f"{name}_a", f"SELECT run_id, id, {f} FROM {pop}")
        chain.add(
            f"{name}_b", f"SELECT *, f1 + CAST(f1 >= id AS BIGINT) AS r1 FROM {name}_a"
        )
        chain.add(
            f"{name}_c",
            "SELECT *, t + CAST(t >= greatest(id, r1) AS BIGINT) AS r2 FROM (SELECT *, "
            f"f2 + CAST(f2 >= least(id, r1) AS BIGINT) AS t FROM {name}_b)",
        )
        chain.add(
            f"{name}_d",
            f"SELECT * EXCLUDE (t), list_sort([id, r1, r2]) AS taken FROM {name}_c",
        )
        chain.add(
            name,
            "SELECT run_id, id, r1, r2, b + CAST(b >= taken[3] AS BIGINT) AS r3 FROM (SELECT *, "
            "a + CAST(a >= taken[2] AS BIGINT) AS b FROM (SELECT *, "
            f"f3 + CAST(f3 >= taken[1] AS BIGINT) AS a FROM {name}_d))",
        )

    return step


def varied(cfg: EvolveConfig, gen: int, pop: str, name: str):
    """Children of ``pop``."""

    def step(chain: Chain):
        partners(cfg, gen, pop, f"{name}_partners")(chain)
        cols = []
        for p in parts(cfg):
            chance = u(cfg.seed, "o.run_id", gen, "'mutate'", "o.id", f"'{p}'")
            mutated = f"m3.{p} + {num(cfg.weight)} * (m1.{p} - m2.{p})"
            value = f"CASE WHEN {chance} < {num(cfg.crossover)} THEN {mutated} ELSE o.{p} END"
            cols.append(f"greatest(abs({value}), {num(cfg.eps)}) AS {p}" if p[0] == "s" else f"{value} AS {p}")
        joins = " ".join(
            f"JOIN {pop} m{k} ON m{k}.run_id = o.run_id AND m{k}.id = q.r{k}" for k in (1, 2, 3)
        )
        chain.add(
            name,
            f"SELECT o.run_id, o.id, {', '.join(cols)} FROM {pop} o "
            f"JOIN {name}_partners q ON q.run_id = o.run_id AND q.id = o.id {joins}",
        )

    return step


def rated(pop: str, pts: str, name: str, cfg: EvolveConfig = CFG, key: str = "id", size: str | None = None):
    """``pop`` with fitness over ``pts``."""

    def step(chain: Chain):
        chain.add(
            f"{name}_sum",
            f"SELECT run_id, {key}, sum(exp({num(-0.5)} * {d2('m.', 'p.', 'm.', len(cfg.dims), 'x')})) AS kernel "
            f"FROM {pts} p, {pop} m GROUP BY run_id, {key}",
        )
        chain.add(
            name,
            f"SELECT m.*, kernel / ({product(cfg)} * {size or cfg.pop_size}) AS fitness "
            f"FROM {pop} m JOIN {name}_sum USING (run_id, {key})",
        )

    return step


def nearest(left: str, right: str, name: str, dims: int = 2):
    """Nearest ``right`` per ``left``, in the spread of ``left``."""

    def step(chain: Chain):
        chain.add(
            name,
            "SELECT run_id, id, match_id, distance FROM (SELECT a.run_id, a.id, b.id AS match_id, "
            f"{d2('a.', 'b.', 'a.', dims)} AS distance, row_number() OVER (PARTITION BY a.run_id, a.id "
            f"ORDER BY {d2('a.', 'b.', 'a.', dims)}, b.id) AS place "
            f"FROM {left} a JOIN {right} b ON a.run_id = b.run_id) WHERE place = 1",
        )

    return step


def survivors(parents: str, children: str, name: str, mode: str, slot: str = "self", cfg: EvolveConfig = CFG):
    """Next population from two rated ones."""
    body, dims = [*parts(cfg), "fitness"], len(cfg.dims)

    def pick(test: str, child: str = "c") -> str:
        return ", ".join(f"CASE WHEN {test} THEN {child}.{b} ELSE p.{b} END AS {b}" for b in body)

    def step(chain: Chain):
        if mode == "greedy":
            chain.add(
                name,
                f"SELECT p.run_id, p.id, {pick('c.fitness > p.fitness')} FROM {parents} p "
                f"JOIN {children} c USING (run_id, id)",
            )
        elif mode == "nearest_child":
            nearest(parents, children, f"{name}_near", dims)(chain)
            chain.add(
                name,
                f"SELECT p.run_id, p.id, {pick('NOT p.fitness > c.fitness')} FROM {parents} p "
                f"JOIN {name}_near m ON m.run_id = p.run_id AND m.id = p.id "
                f"JOIN {children} c ON c.run_id = p.run_id AND c.id = m.match_id",
            )
        else:
            nearest(children, parents, f"{name}_near", dims)(chain)
            target = "c.id" if slot == "self" else "m.match_id"
            chain.add(
                f"{name}_won",
                f"SELECT * FROM (SELECT c.*, {target} AS slot, row_number() OVER (PARTITION BY "
                f"c.run_id, {target} ORDER BY c.fitness DESC, c.id) AS place FROM {children} c "
                f"JOIN {name}_near m ON m.run_id = c.run_id AND m.id = c.id "
                f"JOIN {parents} v ON v.run_id = c.run_id AND v.id = m.match_id "
                "WHERE c.fitness > v.fitness) WHERE place = 1",
            )
            chain.add(
                name,
                f"SELECT p.run_id, p.id, {pick('c.id IS NOT NULL')} FROM {parents} p "
                f"LEFT JOIN {name}_won c ON c.run_id = p.run_id AND c.slot = p.id",
            )

    return step


def evolved(cfg: EvolveConfig, name: str = "final", pts: str = "pts", start: str = "pop0", tag: str = ""):
    """The generations, unrolled, from ``start``."""
    gen, kids = f"{tag}gen", f"{tag}kids"

    def step(chain: Chain):
        rated(start, pts, f"{gen}0", cfg)(chain)
        for g in range(1, cfg.generations + 1):
            varied(cfg, g, f"{gen}{g - 1}", f"{kids}{g}")(chain)
            rated(f"{kids}{g}", pts, f"r{kids}{g}", cfg)(chain)
            survivors(f"{gen}{g - 1}", f"r{kids}{g}", f"{gen}{g}", cfg.selection, cfg.slot, cfg)(chain)
        chain.add(name, f"SELECT * FROM {gen}{cfg.generations}")

    return step


# --- representatives ---------------------------------------------------------------


def led(pop: str, name: str = "reps", settings: str | None = None, cfg: EvolveConfig = CFG):
    """Leaders of every run of ``pop`` as a recursive fold over lists. With
    ``settings`` (``set_id, delta1, delta2``) one fold per setting over the one
    run there is; ``run_id`` is then the setting."""
    names = parts(cfg)

    def step(chain: Chain):
        if settings is None:
            chain.add(
                f"{name}_in",
                f"SELECT run_id, id, {num(cfg.delta1)} AS d1, {num(cfg.delta2)} AS d2, "
                f"{', '.join(names)} FROM {pop}",
            )
        else:
            chain.add(
                f"{name}_in",
                f"SELECT set_id AS run_id, id, delta1 AS d1, delta2 AS d2, {', '.join(names)} "
                f"FROM {pop}, {settings}",
            )
        def entry(label: str, values: list[str]) -> str:
            return "{label: " + label + ", " + ", ".join(f"{n}: {v}" for n, v in zip(names, values)) + "}"

        own = entry("CAST(1 AS BIGINT)", names)
        merged = entry("fresh", [f"({n} + near.{n}) / 2" if n in cfg.centre_cols else f"greatest({n}, near.{n})" for n in names])
        alone, same = entry("fresh", names), entry("near.label", names)
        gap = d2("m.", "z.", "z.", len(cfg.dims))
        chain.add(
            f"{name}_fold",
            f"SELECT run_id, CAST(0 AS BIGINT) AS i, [{own}] AS reps, CAST(2 AS BIGINT) AS fresh "
            f"FROM {name}_in WHERE id = 0 UNION ALL "
            "SELECT run_id, i + 1, CASE "
            f"WHEN share <= d1 OR own <= d1 THEN list_append(reps, {merged}) "
            f"WHEN share > d2 AND own > d2 THEN list_append(reps, {alone}) "
            f"WHEN list_contains(reps, {same}) THEN reps "
            f"ELSE list_append(reps, {same}) END, "
            "CASE WHEN share <= d1 OR own <= d1 OR (share > d2 AND own > d2) "
            "THEN fresh + 1 ELSE fresh END FROM ("
            "SELECT *, CASE WHEN total > 0 THEN gaps[pos] / total END AS share, "
            + d2("", "near.", "", len(cfg.dims))
            + " AS own FROM (SELECT *, reps[pos] AS near, list_sum(gaps) AS total FROM ("
            "SELECT *, list_position(gaps, list_min(gaps)) AS pos FROM ("
            f"SELECT f.run_id, f.i, f.reps, f.fresh, m.* EXCLUDE (run_id, id), "
            f"list_transform(f.reps, lambda z: {gap}) AS gaps FROM {name}_fold f "
            f"JOIN {name}_in m ON m.run_id = f.run_id AND m.id = f.i + 1))))",
        )
        chain.add(
            f"{name}_last",
            f"SELECT run_id, arg_max(reps, i) AS reps FROM {name}_fold GROUP BY run_id",
        )
        chain.add(
            name,
            f"SELECT run_id, rep_id, e.label AS label, {', '.join(f'e.{n} AS {n}' for n in names)} FROM (SELECT run_id, unnest(reps) AS e, "
            f"CAST(unnest(range(len(reps))) AS BIGINT) AS rep_id FROM {name}_last)",
        )

    return step


def refined(pts: str, name: str = "refs", reps: str = "reps", settings: str | None = None, cfg: EvolveConfig = CFG):
    """Labels merged pair by pair, pass by pass; the step counter runs through
    the close pairs as often as there are representatives."""

    def step(chain: Chain):
        rated(reps, pts, f"{name}_fit", cfg, key="rep_id", size="1")(chain)
        limit, dims = num(cfg.delta2) if settings is None else "t.delta2", len(cfg.dims)
        join = "" if settings is None else f"JOIN {settings} t ON t.set_id = a.run_id "
        chain.add(
            f"{name}_pairs",
            "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY i, j) - 1 AS pos, "
            "count(*) OVER (PARTITION BY run_id) AS n_pairs, i, j, wins FROM ("
            "SELECT a.run_id, a.rep_id + 1 AS i, b.rep_id + 1 AS j, a.fitness > b.fitness AS wins "
            f"FROM {name}_fit a JOIN {name}_fit b ON a.run_id = b.run_id AND a.rep_id < b.rep_id "
            f"{join}WHERE least({d2('a.', 'b.', 'a.', dims)}, {d2('a.', 'b.', 'b.', dims)}) <= {limit})",
        )
        chain.add(
            f"{name}_fold",
            f"SELECT run_id, CAST(0 AS BIGINT) AS n, list(label ORDER BY rep_id) AS labels "
            f"FROM {reps} GROUP BY run_id UNION ALL "
            "SELECT f.run_id, f.n + 1, CASE WHEN f.labels[p.i] = f.labels[p.j] THEN f.labels "
            "WHEN p.wins THEN list_transform(f.labels, lambda v, k: "
            "CASE WHEN k = p.j THEN f.labels[p.i] ELSE v END) "
            "ELSE list_transform(f.labels, lambda v, k: "
            "CASE WHEN k = p.i THEN f.labels[p.j] ELSE v END) END "
            f"FROM {name}_fold f JOIN {name}_pairs p ON p.run_id = f.run_id "
            "AND p.pos = f.n % p.n_pairs AND f.n < p.n_pairs * len(f.labels)",
        )
        chain.add(
            f"{name}_last",
            f"SELECT run_id, arg_max(labels, n) AS labels FROM {name}_fold GROUP BY run_id",
        )
        chain.add(
            name,
            f"SELECT a.run_id, a.rep_id, l.labels[a.rep_id + 1] AS label, {', '.join(f'a.{n}' for n in parts(cfg))} "
            f"FROM {reps} a JOIN {name}_last l USING (run_id)",
        )

    return step


# --- assignment ------------------------------------------------------------------------


def classified(pts: str, reps: str, name: str = "near", cfg: EvolveConfig = CFG, columns: str = "point_id, label"):
    """Per point and run: labels and distances of the two nearest."""
    wanted = ", ".join(f"p.{c.strip()}" for c in columns.split(","))

    def step(chain: Chain):
        chain.add(
            f"{name}_two",
            f"SELECT run_id, {columns}, min_by(e, e, 2) AS two FROM ("
            f"SELECT r.run_id, {wanted}, {{d: {d2('r.', 'p.', 'r.', len(cfg.dims), 'x')}, pos: r.rep_id, "
            f"label: r.label}} AS e FROM {pts} p, {reps} r) GROUP BY run_id, {columns}",
        )
        alt = "two[2].label"
        if cfg.second == "rep1":
            alt = f"(SELECT label FROM {reps} z WHERE z.run_id = {name}_two.run_id AND z.rep_id = 1)"
        chain.add(
            name,
            f"SELECT run_id, {columns}, "
            f"CASE WHEN two[1].d <= {num(cfg.delta3)} THEN two[1].label ELSE 0 END AS cluster, "
            f"CASE WHEN two[2].d <= {num(cfg.delta3)} THEN {alt} ELSE -1 END AS alt FROM {name}_two",
        )

    return step


def moved(near: str, reps: str, name: str = "assigned"):
    """Points of small clusters moved, then dense numbers."""

    def step(chain: Chain):
        chain.add(
            f"{name}_facts",
            f"SELECT run_id, count(DISTINCT label) AS n_labels, count(*) AS n_reps FROM {reps} GROUP BY run_id",
        )
        chain.add(
            f"{name}_sized",
            "SELECT *, count(*) OVER (PARTITION BY run_id) AS n, "
            f"count(*) OVER (PARTITION BY run_id, cluster) AS size FROM {near}",
        )
        chain.add(
            f"{name}_moved",
            "SELECT s.* EXCLUDE (cluster), CASE WHEN n_reps > 1 AND cluster <> 0 AND alt <> -1 "
            f"AND size < n / ({num(4)} * n_labels) THEN alt ELSE cluster END AS cluster "
            f"FROM {name}_sized s JOIN {name}_facts USING (run_id)",
        )
        chain.add(
            name,
            "SELECT * EXCLUDE (cluster), CAST(cluster = 0 AS INTEGER) AS is_outlier, "
            f"dense_rank() OVER (PARTITION BY run_id ORDER BY cluster) AS cluster FROM {name}_moved",
        )

    return step


# --- scores ---------------------------------------------------------------------------


def scored(source: str, by: str | None, name: str = "scores"):
    """Homogeneity, completeness, V-measure and adjusted Rand index of
    ``label`` against ``cluster`` by their usual sums."""
    keys = by or "1"
    lead = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"

    def level(columns: str) -> str:
        group = f"{lead}{columns}"
        return f"SELECT {group}, CAST(count(*) AS DOUBLE) AS m FROM {source} GROUP BY {group}"

    def step(chain: Chain):
        chain.add(f"{name}_nij", level("label, cluster"))
        chain.add(f"{name}_ni", level("label"))
        chain.add(f"{name}_nj", level("cluster"))
        chain.add(
            f"{name}_n",
            f"SELECT {lead}CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY {keys}"
            if by
            else f"SELECT CAST(count(*) AS DOUBLE) AS n FROM {source}",
        )
        for side in ("ni", "nj"):
            chain.add(
                f"{name}_h{side}",
                f"SELECT {lead}-sum(m / n * ln(m / n)) AS h_{side}, sum(m * (m - 1) / 2) AS p_{side} "
                f"FROM {name}_{side} JOIN {name}_n {using}" + (f" GROUP BY {by}" if by else ""),
            )
        on = f"a.{by} = c.{by} AND " if by else ""
        on_b = f"b.{by} = c.{by} AND " if by else ""
        on_n = f"z.{by} = c.{by}" if by else "true"
        chain.add(
            f"{name}_mi",
            (f"SELECT c.{by} AS {by}, " if by else "SELECT ")
            + "sum(c.m / n * ln(n * c.m / (a.m * b.m))) AS mi, sum(c.m * (c.m - 1) / 2) AS p_nij "
            f"FROM {name}_nij c JOIN {name}_ni a ON {on}a.label = c.label "
            f"JOIN {name}_nj b ON {on_b}b.cluster = c.cluster JOIN {name}_n z ON {on_n}"
            + (f" GROUP BY c.{by}" if by else ""),
        )
        chain.add(
            f"{name}_parts",
            f"SELECT {lead}CASE WHEN h_ni = 0 THEN 1 ELSE mi / h_ni END AS homogeneity, "
            "CASE WHEN h_nj = 0 THEN 1 ELSE mi / h_nj END AS completeness, p_nij, "
            "p_ni * p_nj / (n * (n - 1) / 2) AS e, (p_ni + p_nj) / 2 AS most "
            f"FROM {name}_mi JOIN {name}_hni {using} JOIN {name}_hnj {using} JOIN {name}_n {using}",
        )
        chain.add(
            name,
            f"SELECT {lead}homogeneity, completeness, CASE WHEN homogeneity + completeness = 0 THEN 0 "
            "ELSE 2 * homogeneity * completeness / (homogeneity + completeness) END AS v_measure, "
            f"CASE WHEN most = e THEN 1 ELSE (p_nij - e) / (most - e) END AS ari FROM {name}_parts",
        )

    return step


SCORES = ("homogeneity", "completeness", "v_measure", "ari")


def unpivoted(source: str, lead: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {lead}, '{s}' AS metric, {s} AS value FROM {source}" for s in SCORES
    )


# --- the queries ----------------------------------------------------------------------------

BODY = ["c0", "c1", "s0", "s1"]
SCALED = scaled(EVENTS, columns="point_id, label")
DAILY = (
    f"SELECT day, label, CAST(floor(x1 / {num(6)}) AS BIGINT) AS cluster FROM ({EVENTS})"
)


def _sample(cfg: EvolveConfig) -> str:
    return hash_below(src.SAMPLE_FRACTION, cfg.seed, "'sample'", "point_id")


def _population(source: str, fitness: bool = False) -> str:
    extra = f", {r('fitness / n', 'fitness')}" if fitness else ""
    tail = ", pts_ext" if fitness else ""
    return f"SELECT run_id, id, {rounds(BODY)}{extra} FROM {source}{tail}"


def _generation(*steps) -> Chain:
    return Chain(
        SCALED, first(), rated("pop0", "pts", "old"), varied(CFG, 1, "old", "kids"),
        rated("kids", "pts", "new"), *steps,
    )


def _farthest() -> str:
    """Farthest-first of two runs over points as lists."""
    cfg = src.FARTHEST_CFG
    chain = Chain().add("pts", WIDE_POINTS).add("runs", f"SELECT CAST(i AS BIGINT) AS run_id FROM range({cfg.runs}) t(i)")
    hashed = f"md5(concat_ws('|', {cfg.seed}, run_id, 0, 'first', point_id))"
    chain.add(
        "k0",
        f"SELECT run_id, 0 AS id, e.x AS x FROM (SELECT run_id, min({{h: {hashed}, id: point_id, x: x}}) AS e FROM pts, runs GROUP BY run_id)",
    )
    gap = GAP.format(a="p.x", b="c.x")
    for k in range(1, cfg.pop_size):
        chosen = " UNION ALL ".join(f"SELECT run_id, x FROM k{j}" for j in range(k))
        chain.add(
            f"g{k}",
            f"SELECT c.run_id, p.point_id, any_value(p.x) AS x, min({gap}) AS gap FROM pts p, ({chosen}) c GROUP BY c.run_id, p.point_id",
        )
        chain.add(
            f"k{k}",
            f"SELECT run_id, {k} AS id, e.x AS x FROM (SELECT run_id, max({{gap: gap, id: -point_id, x: x}}) AS e FROM g{k} GROUP BY run_id)",
        )
    rows = " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(cfg.pop_size))
    cols = ", ".join(r(f"x[{k + 1}]", f"c{k}") for k in range(WIDTH))
    return chain.select(f"SELECT run_id, CAST(id AS BIGINT) AS id, {cols} FROM ({rows})")


def _mixture() -> Chain:
    return Chain(SCALED).add(
        "comps",
        "SELECT label AS comp, count(*) / CAST((SELECT n FROM pts_ext) AS DOUBLE) AS w, avg(x0) AS m0, avg(x1) AS m1, "
        "var_pop(x0) AS v00, covar_pop(x0, x1) AS v01, var_pop(x1) AS v11 FROM pts GROUP BY label",
    )


def _stepped(chain: Chain, comps: str, name: str):
    """One EM step from ``comps``."""
    maha = (
        "(v11 * (x0 - m0) * (x0 - m0) - 2 * v01 * (x0 - m0) * (x1 - m1) "
        "+ v00 * (x1 - m1) * (x1 - m1)) / det"
    )
    chain.add(f"{name}_shaped", f"SELECT *, v00 * v11 - v01 * v01 AS det FROM {comps}")
    chain.add(
        f"{name}_dens",
        f"SELECT comp, point_id, x0, x1, w * exp({num(-0.5)} * {maha}) / (2 * pi() * sqrt(det)) AS q "
        f"FROM pts, {name}_shaped",
    )
    chain.add(
        f"{name}_resp", f"SELECT *, q / sum(q) OVER (PARTITION BY point_id) AS g FROM {name}_dens"
    )
    chain.add(
        f"{name}_moments",
        "SELECT comp, sum(g) AS mass, sum(g * x0) / sum(g) AS m0, sum(g * x1) / sum(g) AS m1 "
        f"FROM {name}_resp GROUP BY comp",
    )
    reg = num(1e-6)
    chain.add(
        name,
        "SELECT comp, any_value(mass) / any_value(n) AS w, any_value(m0) AS m0, any_value(m1) AS m1, "
        f"sum(g * (x0 - m0) * (x0 - m0)) / any_value(mass) + {reg} AS v00, "
        "sum(g * (x0 - m0) * (x1 - m1)) / any_value(mass) AS v01, "
        f"sum(g * (x1 - m1) * (x1 - m1)) / any_value(mass) + {reg} AS v11 "
        f"FROM {name}_resp JOIN {name}_moments USING (comp), pts_ext GROUP BY comp",
    )


def _gmm_step() -> str:
    chain = _mixture()
    _stepped(chain, "comps", "once")
    _stepped(chain, "once", "twice")
    return chain.select(
        f"SELECT CAST(0 AS BIGINT) AS run_id, comp, {r('w', 'weight')}, "
        f"{rounds(['m0', 'm1', 'v00', 'v01', 'v11'])} FROM twice"
    )


# Points as lists, for any number of dimensions.
GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
WIDE_POINTS = "SELECT vec_id AS point_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings"


def wide(source: str = WIDE_POINTS):
    """``pts``: points with the list ``x`` min-max scaled; ``long``: one row per
    coordinate."""

    def step(chain: Chain):
        chain.add("raw", source)
        chain.add("raw_long", "SELECT point_id, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM raw")
        chain.add(
            "ends",
            "SELECT list(low ORDER BY k) AS low, list(reach ORDER BY k) AS reach, count(*) AS d FROM "
            "(SELECT k, min(v) AS low, max(v) - min(v) AS reach FROM raw_long GROUP BY k)",
        )
        chain.add(
            "pts",
            "SELECT point_id, list_transform(list_zip(x, low, reach), lambda z: (z[1] - z[2]) / z[3]) AS x FROM raw, ends",
        )
        chain.add("long", "SELECT point_id, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM pts")
        chain.add("size", "SELECT CAST(count(*) AS DOUBLE) AS n FROM pts")

    return step


def moments(near: str, name: str, whole: bool):
    """Means of hard clusters ``run_id, comp, point_id`` and, if ``whole``, their
    weights and covariances."""

    def step(chain: Chain):
        chain.add(
            f"{name}_cols",
            "SELECT run_id, comp, k, avg(v) AS m, list(v ORDER BY point_id) AS col "
            f"FROM {near} JOIN long USING (point_id) GROUP BY run_id, comp, k",
        )
        if not whole:
            chain.add(name, f"SELECT run_id, comp, list(m ORDER BY k) AS mean FROM {name}_cols GROUP BY run_id, comp")
            return
        reg = num(1e-6)
        chain.add(
            f"{name}_off",
            f"SELECT run_id, comp, k, m, list_transform(col, lambda v: v - m) AS off FROM {name}_cols",
        )
        chain.add(
            f"{name}_cov",
            "SELECT a.run_id, a.comp, a.k AS i, any_value(a.m) AS m, any_value(len(a.off)) AS n, "
            f"list(list_dot_product(a.off, b.off) / len(a.off) + CASE WHEN a.k = b.k THEN {reg} ELSE 0 END ORDER BY b.k) AS line "
            f"FROM {name}_off a JOIN {name}_off b USING (run_id, comp) GROUP BY a.run_id, a.comp, a.k",
        )
        chain.add(
            name,
            "SELECT run_id, comp, any_value(c.n) / any_value(s.n) AS w, list(m ORDER BY i) AS mean, "
            f"list(line ORDER BY i) AS cov FROM {name}_cov c, size s GROUP BY run_id, comp",
        )

    return step


def started(runs: int, k: int, seed: int, turns: int = 5, name: str = "start"):
    """Centres by a weighted race, then rounds of nearest centre and mean."""

    def step(chain: Chain):
        for run in range(runs):
            names: list[str] = []
            for turn in range(k):
                at = f"seed{run}_{turn}"
                time = f"-ln(1 - {u(seed, run, turn, chr(39) + 'seed' + chr(39), 'point_id')})"
                source = "pts"
                if names:
                    chosen = " UNION ALL ".join(f"SELECT mean FROM {n}" for n in names)
                    chain.add(
                        f"{at}_gap",
                        f"SELECT point_id, any_value(x) AS x, min({GAP.format(a='x', b='mean')}) AS gap "
                        f"FROM pts, ({chosen}) GROUP BY point_id",
                    )
                    source, time = f"{at}_gap WHERE gap > 0", f"{time} / gap"
                chain.add(
                    at,
                    f"SELECT CAST({run} AS BIGINT) AS run_id, CAST({turn} AS BIGINT) AS comp, x AS mean "
                    f"FROM {source} ORDER BY {time}, point_id LIMIT 1",
                )
                names.append(at)
        chain.add(
            "turn0",
            " UNION ALL ".join(f"SELECT * FROM seed{run}_{turn}" for run in range(runs) for turn in range(k)),
        )
        for turn in range(1, turns + 1):
            chain.add(
                f"near{turn}",
                f"SELECT run_id, point_id, arg_min(comp, {{gap: {GAP.format(a='x', b='mean')}, comp: comp}}) AS comp "
                f"FROM pts, turn{turn - 1} GROUP BY run_id, point_id",
            )
            moments(f"near{turn}", f"turn{turn}" if turn < turns else name, turn == turns)(chain)

    return step


def fitted(start: str, max_iter: int = 100, tol: float = 1e-3, name: str = "comps"):
    """EM of every run from ``start`` until its mean log-likelihood grows by less
    than ``tol``, as a recursive fold; a run that has ended is not taken up again."""

    def step(chain: Chain):
        # Gauss-Jordan sweep of all pivots: the inverse, and the pivots as a last row.
        sweep = (
            "list_reduce(range(1, len(mean) + 1), lambda m, j: list_transform(m, lambda r, i: CASE "
            "WHEN i > len(m) - 1 THEN list_append(r, m[j][j]) "
            "WHEN i = j THEN list_transform(r, lambda v, q: CASE WHEN q = j THEN 1 / m[j][j] ELSE v / m[j][j] END) "
            "ELSE list_transform(list_zip(r, m[j]), lambda z, q: CASE WHEN q = j THEN -r[j] / m[j][j] "
            "ELSE z[1] - r[j] * z[2] / m[j][j] END) END), list_append(cov, CAST([] AS DOUBLE[])))"
        )
        reg = num(1e-6)
        chain.add(
            f"{name}_fold",
            f"SELECT run_id, comp, 0 AS turn, w, mean, cov, CAST(NULL AS DOUBLE) AS ll, false AS done FROM {start} UNION ALL ("
            f"WITH shaped AS (SELECT *, {sweep} AS m FROM {name}_fold WHERE NOT done), "
            "dens AS (SELECT run_id, comp, turn, point_id, mean, ll AS last, "
            "list_transform(list_zip(x, mean), lambda z: z[1] - z[2]) AS off, "
            "ln(w) - 0.5 * len(mean) * ln(2 * pi()) - 0.5 * list_sum(list_transform(m[-1], lambda p: ln(p))) "
            "- 0.5 * list_dot_product(off, list_transform(m[:-2], lambda r: list_dot_product(r, off))) AS q "
            "FROM pts, shaped), "
            "tops AS (SELECT *, max(q) OVER (PARTITION BY run_id, point_id) AS top FROM dens), "
            "resp AS (SELECT *, top + ln(sum(exp(q - top)) OVER (PARTITION BY run_id, point_id)) AS lp FROM tops), "
            "lls AS (SELECT run_id, avg(lp) AS now FROM resp WHERE comp = 0 GROUP BY run_id), "
            "cols AS (SELECT run_id, comp, k, any_value(turn) AS turn, any_value(last) AS last, any_value(mean) AS mean, "
            "sum(exp(q - lp)) AS mass, list(exp(q - lp) ORDER BY point_id) AS g, list(o ORDER BY point_id) AS o FROM ("
            "SELECT run_id, comp, point_id, turn, last, mean, q, lp, unnest(off) AS o, unnest(range(1, len(off) + 1)) AS k FROM resp) "
            "GROUP BY run_id, comp, k), "
            "moved AS (SELECT *, list_dot_product(g, o) / mass AS move, "
            "list_transform(list_zip(g, o), lambda z: z[1] * z[2]) AS go FROM cols), "
            "lines AS (SELECT a.run_id, a.comp, a.k AS i, any_value(a.turn) AS turn, any_value(a.last) AS last, any_value(a.mass) AS mass, "
            "any_value(a.mean[a.k] + a.move) AS m, list(list_dot_product(a.go, b.o) / a.mass - a.move * b.move "
            f"+ CASE WHEN a.k = b.k THEN {reg} ELSE 0 END ORDER BY b.k) AS line "
            "FROM moved a JOIN moved b USING (run_id, comp) GROUP BY a.run_id, a.comp, a.k) "
            "SELECT run_id, comp, any_value(turn) + 1, any_value(mass) / any_value(n), list(m ORDER BY i), list(line ORDER BY i), "
            f"any_value(now), coalesce(abs(any_value(now) - any_value(last)) < {num(tol)}, false) OR any_value(turn) + 1 >= {max_iter} "
            "FROM lines JOIN lls USING (run_id), size GROUP BY run_id, comp)",
        )
        chain.add(name, f"SELECT run_id, comp, w, mean, {sweep} AS m FROM {name}_fold WHERE done")
        chain.add(
            f"{name}_labels",
            "SELECT run_id, point_id, arg_max(comp, {q: q, first: -comp}) AS prediction FROM ("
            "SELECT run_id, comp, point_id, list_transform(list_zip(x, mean), lambda z: z[1] - z[2]) AS off, "
            "ln(w) - 0.5 * list_sum(list_transform(m[-1], lambda p: ln(p))) "
            "- 0.5 * list_dot_product(off, list_transform(m[:-2], lambda r: list_dot_product(r, off))) AS q "
            f"FROM pts, {name}) GROUP BY run_id, point_id",
        )

    return step


def flat_em(runs: int, k: int, seed: int, turns: int = 5, max_iter: int = 100, tol: float = 1e-3, name: str = "em"):
    """The same in two dimensions with plain columns, all runs at once:
    ``{name}`` has the label each run gives each point of ``pts``."""
    gap = "(p.x0 - c.m0) * (p.x0 - c.m0) + (p.x1 - c.m1) * (p.x1 - c.m1)"
    reg = num(1e-6)

    def step(chain: Chain):
        chain.add(f"{name}_runs", f"SELECT CAST(i AS BIGINT) AS run_id FROM range({runs}) t(i)")
        seeds: list[str] = []
        for turn in range(k):
            time = f"-ln(1 - {u(seed, 'run_id', turn, chr(39) + 'seed' + chr(39), 'point_id')})"
            source = f"SELECT run_id, point_id, x0, x1, 1 AS gap FROM pts, {name}_runs"
            if seeds:
                chosen = " UNION ALL ".join(f"SELECT * FROM {s}" for s in seeds)
                source = (
                    f"SELECT c.run_id, p.point_id, p.x0, p.x1, min({gap}) AS gap FROM pts p, ({chosen}) c "
                    "GROUP BY c.run_id, p.point_id, p.x0, p.x1"
                )
            chain.add(
                f"{name}_s{turn}",
                f"SELECT run_id, CAST({turn} AS BIGINT) AS comp, e.x0 AS m0, e.x1 AS m1 FROM ("
                f"SELECT run_id, min({{t: {time} / gap, id: point_id, x0: x0, x1: x1}}) AS e FROM ({source}) WHERE gap > 0 GROUP BY run_id)",
            )
            seeds.append(f"{name}_s{turn}")
        chain.add(f"{name}_t0", " UNION ALL ".join(f"SELECT * FROM {s}" for s in seeds))
        for turn in range(1, turns + 1):
            chain.add(
                f"{name}_t{turn}",
                "SELECT run_id, comp, count(*) / any_value(n) AS w, avg(x0) AS m0, avg(x1) AS m1, "
                f"var_pop(x0) + {reg} AS v00, covar_pop(x0, x1) AS v01, var_pop(x1) + {reg} AS v11 FROM ("
                f"SELECT c.run_id, p.x0, p.x1, arg_min(c.comp, {{gap: {gap}, comp: c.comp}}) AS comp "
                f"FROM pts p, {name}_t{turn - 1} c GROUP BY c.run_id, p.point_id, p.x0, p.x1), pts_ext GROUP BY run_id, comp",
            )
        det = "(v00 * v11 - v01 * v01)"
        q = (
            f"ln(w) - ln(2 * pi()) - 0.5 * ln({det}) - 0.5 * (v11 * (x0 - m0) * (x0 - m0) "
            f"- 2 * v01 * (x0 - m0) * (x1 - m1) + v00 * (x1 - m1) * (x1 - m1)) / {det}"
        )
        chain.add(
            f"{name}_fold",
            f"SELECT run_id, comp, 0 AS turn, w, m0, m1, v00, v01, v11, CAST(NULL AS DOUBLE) AS ll, false AS done FROM {name}_t{turns} "
            f"UNION ALL (WITH dens AS (SELECT run_id, comp, turn, point_id, x0 - m0 AS a, x1 - m1 AS b, m0, m1, ll AS last, "
            f"{q} AS q FROM pts, {name}_fold WHERE NOT done), "
            "tops AS (SELECT run_id, point_id, max(q) AS top FROM dens GROUP BY run_id, point_id), "
            "lps AS (SELECT d.run_id, d.point_id, any_value(top) + ln(sum(exp(q - top))) AS lp FROM dens d JOIN tops t "
            "ON t.run_id = d.run_id AND t.point_id = d.point_id GROUP BY d.run_id, d.point_id), "
            "lls AS (SELECT run_id, avg(lp) AS now FROM lps GROUP BY run_id), "
            "sums AS (SELECT d.run_id, comp, any_value(turn) AS turn, any_value(last) AS last, any_value(m0) AS m0, any_value(m1) AS m1, "
            "sum(g) AS mass, sum(g * a) / sum(g) AS da, sum(g * b) / sum(g) AS db, sum(g * a * a) / sum(g) AS aa, "
            "sum(g * a * b) / sum(g) AS ab, sum(g * b * b) / sum(g) AS bb FROM (SELECT d.*, exp(q - lp) AS g FROM dens d JOIN lps l "
            "ON l.run_id = d.run_id AND l.point_id = d.point_id) d GROUP BY d.run_id, comp) "
            f"SELECT run_id, comp, turn + 1, mass / n, m0 + da, m1 + db, aa - da * da + {reg}, ab - da * db, bb - db * db + {reg}, "
            f"now, coalesce(abs(now - last) < {num(tol)}, false) OR turn + 1 >= {max_iter} FROM sums JOIN lls USING (run_id), pts_ext)",
        )
        chain.add(
            name,
            f"SELECT run_id, point_id, any_value(label) AS label, arg_max(comp, {{q: {q}, first: -comp}}) AS cluster "
            f"FROM pts, {name}_fold WHERE done GROUP BY run_id, point_id",
        )

    return step


def _kmeans_start(runs: int = 2) -> str:
    """Means and the ends of the covariances of the starting components."""
    chain = Chain(wide(), started(runs, src.START_K, src.START_SEED))
    return chain.select(
        f"SELECT run_id, comp, {r('w', 'weight')}, {r('list_sum(mean)', 'mean_sum')}, {r('mean[-1]', 'last_mean')}, "
        f"{r('list_sum(list_transform(cov, lambda c: list_sum(c)))', 'cov_sum')}, {r('cov[-1][1]', 'corner')} FROM start"
    )


def _em_fit_predict() -> str:
    chain = Chain(wide(), started(1, src.START_K, src.START_SEED), fitted("start"))
    return chain.select("SELECT point_id, run_id, prediction FROM comps_labels")


def _ellipse() -> str:
    chain = _mixture().add(
        "axes",
        "SELECT *, (v00 + v11) / 2 AS middle, sqrt((v00 - v11) * (v00 - v11) / 4 + v01 * v01) AS reach, "
        "degrees(atan2(2 * v01, v00 - v11)) / 2 AS major FROM comps",
    )
    return chain.select(
        f"SELECT CAST(0 AS BIGINT) AS run_id, comp, {r('m0', 'x')}, {r('m1', 'y')}, "
        f"{r('2 * sqrt(2) * sqrt(middle - reach)', 'width')}, "
        f"{r('2 * sqrt(2) * sqrt(middle + reach)', 'height')}, "
        f"{r('180 + CASE WHEN major > 0 THEN major - 90 ELSE major + 90 END', 'angle')} FROM axes"
    )


def _compared() -> str:
    """Both evolutions and EM on the scaled events."""
    chain, names = Chain(SCALED), {}
    for tag, cfg in (("distributed", src.COMPARE_CFG), ("sequential", src.COMPARE_SEQUENTIAL_CFG)):
        t = tag[0]
        first(cfg, name=f"{t}pop")(chain)
        evolved(cfg, f"{t}final", start=f"{t}pop", tag=t)(chain)
        led(f"{t}final", f"{t}reps", cfg=cfg)(chain)
        refined("pts", f"{t}refs", f"{t}reps", cfg=cfg)(chain)
        classified("pts", f"{t}refs", f"{t}near", cfg)(chain)
        moved(f"{t}near", f"{t}refs", f"{t}assigned")(chain)
        scored(f"{t}assigned", None, f"{t}s")(chain)
        names[tag] = f"{t}s"
    flat_em(1, len(src.EVENT_TYPES), src.COMPARE_CFG.seed)(chain)
    scored("em", None, "es")(chain)
    names["em"] = "es"
    long = " UNION ALL ".join(unpivoted(source, f"'{name}' AS algorithm") for name, source in names.items())
    return chain.select(f"SELECT algorithm, metric, {r('value', 'value', 7)} FROM ({long}) ORDER BY value")


def _replicates() -> Chain:
    """``runs_of``: the scores of every run of both algorithms."""
    cfg = src.REPLICATES_CFG.with_(runs=src.REPLICATES)
    chain = Chain(
        SCALED, first(cfg), evolved(cfg), led("final", cfg=cfg), refined("pts", cfg=cfg),
        classified("pts", "refs", cfg=cfg), moved("near", "refs"), scored("assigned", "run_id", "ev"),
        flat_em(src.REPLICATES, len(src.EVENT_TYPES), cfg.seed), scored("em", "run_id", "fit"),
    )
    return chain.add(
        "runs_of",
        "SELECT run_id, 'evolution' AS algorithm, homogeneity, completeness, v_measure, ari FROM ev "
        "UNION ALL SELECT run_id, 'em', homogeneity, completeness, v_measure, ari FROM fit",
    )


def _search() -> Chain:
    cfg = src.SEARCH_CFG.with_(dims=ALL)
    chain = Chain(scaled(embeddings(WIDTH), dims=ALL), first(cfg), evolved(cfg))
    step = num(0.05)
    chain.add(
        "trials",
        f"SELECT a AS i, b AS j, c AS k, a * {step} AS delta1, b * {step} AS delta2, c * {step} AS delta3, "
        "a * 100 + b AS set_id, a * 10000 + b * 100 + c AS trial FROM range(1, 21) x(a), range(1, 21) y(b), "
        "range(1, 21) z(c) WHERE a < b AND b < c",
    )
    chain.add("sets", "SELECT DISTINCT set_id, delta1, delta2 FROM trials")
    led("final", "reps", "sets", cfg)(chain)
    refined("pts", "refs", "reps", "sets", cfg)(chain)
    chain.add(
        "two",
        "SELECT run_id, point_id, label, min_by(e, e, 2) AS two FROM (SELECT r.run_id, p.point_id, p.label, "
        f"{{d: {d2('r.', 'p.', 'r.', WIDTH, 'x')}, pos: r.rep_id, label: r.label}} AS e FROM pts p, refs r) "
        "GROUP BY run_id, point_id, label",
    )
    chain.add(
        "near",
        "SELECT trial AS run_id, label, CASE WHEN two[1].d <= delta3 THEN two[1].label ELSE 0 END AS cluster, "
        "CASE WHEN two[2].d <= delta3 THEN two[2].label ELSE -1 END AS alt "
        "FROM two JOIN trials ON set_id = run_id",
    )
    chain.add("near_reps", "SELECT t.trial AS run_id, r.label FROM refs r JOIN trials t ON t.set_id = r.run_id")
    moved("near", "near_reps")(chain)
    scored("assigned", "run_id")(chain)
    return chain


def oracle() -> dict[str, str]:
    two_runs = CFG.with_(runs=2)
    sampled = CFG.with_(runs=2, sample_fraction=src.SAMPLE_FRACTION)
    five = src.NEAREST_CFG.with_(dims=ALL)
    base = Chain(SCALED, first())
    led_chain = Chain(SCALED, first(), led("pop0"))
    near_cols = "point_id, label"
    content = "md5(concat_ws('|', '=' || x0, '=' || x1, '=' || label, copy))"
    out = {
        "points_split": f"SELECT point_id, {rounds(ALL)}, label FROM ({embeddings(WIDTH)})",
        "delimited_scan": (
            "SELECT CAST(substr(p_brand, 7) AS INTEGER) AS label, count(*) AS n, "
            "CAST(sum(p_size) AS DOUBLE) AS sum_size, round(avg(p_retailprice), 4) AS avg_price "
            "FROM part GROUP BY 1"
        ),
        "content_ids": (
            f"SELECT CAST(('0x' || substr({content}, 1, 15)) AS BIGINT) AS point_id, x0, x1, label FROM ("
            "SELECT l_quantity AS x0, l_extendedprice AS x1, l_returnflag AS label, row_number() OVER "
            "(PARTITION BY l_quantity, l_extendedprice, l_returnflag) AS copy FROM lineitem)"
        ),
        "vector_roundtrip": Chain(SCALED).select(f"SELECT point_id, {rounds(D)} FROM pts"),
        "gmm_components": f"SELECT CAST(2 AS BIGINT) AS k, {num(1)} AS weight, count(*) AS n, count(*) AS n_same FROM events",
        "relabel_all": f"SELECT point_id, dense_rank() OVER (ORDER BY floor(x0 * 10)) AS cluster FROM ({EVENTS})",
        "label_count": f"SELECT max(label) + 1 AS k FROM ({EVENTS})",
        "rejected_points": (
            "SELECT count(*) FILTER (o_orderstatus = 'F') AS kept, "
            "count(*) FILTER (o_orderstatus <> 'F') AS rejected FROM orders"
        ),
        "domain_bounds": extent(f"({LINES})"),
        "minmax_scale": Chain(scaled(PARTS)).select(f"SELECT point_id, {rounds(D)}, label FROM pts"),
        "zscore_scale": (
            f"WITH p AS ({PARTS}), s AS (SELECT avg(x0) a0, stddev_pop(x0) d0, avg(x1) a1, stddev_pop(x1) d1 FROM p) "
            f"SELECT point_id, {r('(x0 - a0) / d0', 'x0')}, {r('(x1 - a1) / d1', 'x1')}, label FROM p, s"
        ),
        "hash_sample": f"SELECT point_id, label FROM ({EVENTS}) WHERE {_sample(CFG)}",
        "init_random": base.select(_population("pop0")),
        "init_sampled": Chain(SCALED)
        .add("few", f"SELECT * FROM pts WHERE {_sample(CFG)}")
        .add("few_ext", extent("few")),
        "init_farthest": _farthest(),
        "partners": Chain(SCALED, first(), partners(CFG, 1, "pop0", "q")).select("SELECT * FROM q"),
        "vary": Chain(SCALED, first(), varied(CFG, 1, "pop0", "kids")).select(_population("kids")),
        "point_distance": Chain(scaled(embeddings(WIDTH), dims=ALL), first(five)).select(
            f"SELECT point_id, run_id, id, {r('distance', 'distance', 3)} FROM (SELECT p.point_id, m.run_id, m.id, "
            f"{d2('m.', 'p.', 'm.', WIDTH, 'x')} AS distance FROM pts p, pop0 m) "
            "QUALIFY row_number() OVER (PARTITION BY point_id, run_id ORDER BY distance, id) <= 3"
        ),
        "population_distance": Chain(SCALED, first(), varied(CFG, 1, "pop0", "kids")).select(
            f"SELECT a.run_id, a.id AS id1, b.id AS id2, {r(d2('a.', 'b.', 'a.'), 'distance', 4)} "
            "FROM kids a JOIN pop0 b ON a.run_id = b.run_id"
        ),
        "fitness": Chain(
            scaled(PARTS, "prt"),
            first(src.FITNESS_CFG, "prt", "prt_ext"),
            scaled(LINES, columns=""),
            rated("pop0", "pts", "res", src.FITNESS_CFG),
        ).select(f"SELECT run_id, id, {r('fitness / n', 'fitness')} FROM res, pts_ext"),
        "gmm_step": _gmm_step(),
        "kmeans_start": _kmeans_start(),
        "em_fit_predict": _em_fit_predict(),
        "component_ellipse": _ellipse(),
        "leaders": led_chain.select(f"SELECT run_id, rep_id, label, {rounds(BODY)} FROM reps"),
        "close_pairs": led_chain.select(
            f"SELECT a.run_id, a.rep_id AS rep1, b.rep_id AS rep2, a.label AS label1, b.label AS label2, "
            f"{r(d2('a.', 'b.', 'a.'), 'distance1')}, {r(d2('a.', 'b.', 'b.'), 'distance2')} FROM reps a JOIN reps b "
            "ON a.run_id = b.run_id AND a.rep_id < b.rep_id AND a.label <> b.label "
            f"WHERE least({d2('a.', 'b.', 'a.')}, {d2('a.', 'b.', 'b.')}) <= {num(CFG.delta2)}"
        ),
        "refine_labels": Chain(SCALED, first(), led("pop0"), refined("pts")).select(
            f"SELECT run_id, rep_id, label, {rounds(BODY)} FROM refs"
        ),
        "assign_nearest": Chain(SCALED, first(), led("pop0"), classified("pts", "reps")).select(
            "SELECT point_id, cluster, alt FROM near"
        ),
        "relabel_dense": (
            "SELECT label AS run_id, point_id, dense_rank() OVER (PARTITION BY label ORDER BY floor(x1)) AS cluster "
            f"FROM ({EVENTS})"
        ),
        "contingency": f"SELECT label, cluster, count(*) AS n FROM ({DAILY}) GROUP BY label, cluster",
    }
    first(sampled, "few", "few_ext")(out["init_sampled"])
    out["init_sampled"] = out["init_sampled"].select(_population("pop0"))
    for name in ("nearest_window", "nearest_minby"):
        out[name] = Chain(SCALED, first(), varied(CFG, 1, "pop0", "kids"), nearest("kids", "pop0", "m")).select(
            f"SELECT run_id, id, match_id, {r('distance', 'distance')} FROM m"
        )
    for name, mode, slot in (
        ("select_greedy", "greedy", "self"),
        ("select_crowding", "crowding", "self"),
        ("select_competitor", "crowding", "competitor"),
        ("select_nearest_child", "nearest_child", "self"),
    ):
        out[name] = _generation(survivors("old", "new", "next", mode, slot)).select(_population("next", True))
    for name, changes in (
        ("evolve_1gen", {"generations": 1}),
        ("evolve_3gen", {"generations": 3}),
        ("evolve_resumed", {"generations": 3}),
        ("evolve_greedy", {"generations": 2, "selection": "greedy", "runs": 2}),
        ("evolve_nearest_child", {"generations": 2, "selection": "nearest_child"}),
    ):
        cfg = CFG.with_(**changes)
        out[name] = Chain(SCALED, first(cfg), evolved(cfg)).select(_population("final", True))
    out["evolve_sequential"] = Chain(
        SCALED, first(src.SEQUENTIAL_CFG), evolved(src.SEQUENTIAL_CFG)
    ).select(_population("final", True))
    for name, second in (("assign_refined", "own"), ("assign_rep1", "rep1")):
        cfg = CFG.with_(second=second)
        out[name] = Chain(
            SCALED, first(), led("pop0"), classified("pts", "reps", cfg=cfg), moved("near", "reps")
        ).select("SELECT point_id, cluster, is_outlier FROM assigned")
    whole = Chain(
        SCALED, first(two_runs), evolved(two_runs), led("final"), refined("pts"),
        classified("pts", "refs", columns=near_cols), moved("near", "refs"),
    )
    out["predict"] = whole.select("SELECT run_id, point_id, cluster, is_outlier FROM assigned")
    short = two_runs.with_(generations=5)
    out["predicted_scores"] = Chain(
        SCALED, first(short), evolved(short), led("final"), refined("pts"),
        classified("pts", "refs", columns=near_cols), moved("near", "refs"), scored("assigned", "run_id"),
    ).select(f"SELECT run_id, {rounds(SCORES, 7)} FROM scores")
    daily = Chain().add("cut", DAILY)
    scored("cut", "day")(daily)
    out["cluster_scores"] = daily.select(f"SELECT day, {rounds(SCORES, 8)} FROM scores")
    out["sorted_results"] = daily.select(f"SELECT day, {r('ari', 'ari', 8)} FROM scores ORDER BY ari")
    means = ", ".join(r(f"avg({s})", s, 8) for s in SCORES)
    out["mean_scores"] = daily.select(f"SELECT 'quarter' AS algorithm, {means} FROM scores")
    stats = ", ".join(
        r(e, n, 8)
        for n, e in (
            ("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"),
            ("p25", "quantile_cont(value, 0.25)"), ("p50", "quantile_cont(value, 0.5)"),
            ("p75", "quantile_cont(value, 0.75)"), ("max", "max(value)"),
        )
    )
    out["score_summary"] = daily.select(
        f"SELECT algorithm, metric, count(value) AS n, {stats} "
        f"FROM ({unpivoted('scores', chr(39) + 'quarter' + chr(39) + ' AS algorithm')}) GROUP BY algorithm, metric"
    )
    out["compare_algorithms"] = _compared()
    repeated = _replicates()
    out["replicates"] = repeated.select(f"SELECT run_id, algorithm, {rounds(SCORES, 7)} FROM runs_of")
    out["replicate_means"] = repeated.select(
        f"SELECT algorithm, {', '.join(r(f'avg({s})', s, 7) for s in SCORES)} FROM runs_of GROUP BY algorithm"
    )
    spread = stats.replace(", 8)", ", 7)")
    out["replicate_summary"] = repeated.select(
        f"SELECT algorithm, metric, count(value) AS n, {spread} "
        f"FROM ({unpivoted('runs_of', 'algorithm')}) GROUP BY algorithm, metric"
    )
    out["replicate_comparison"] = repeated.select(
        f"SELECT run_id, algorithm, metric, {r('value', 'value', 7)} FROM ({unpivoted('runs_of', 'run_id, algorithm')}) ORDER BY value"
    )
    search = _search()
    deltas = ["delta1", "delta2", "delta3"]
    out["delta_search"] = search.select(
        f"SELECT i, j, k, {rounds(deltas)}, {r('ari', 'ari')} FROM scores JOIN trials ON trial = run_id"
    )
    out["best_deltas"] = search.select(
        f"SELECT {rounds(deltas)}, {r('ari', 'ari')} FROM scores JOIN trials ON trial = run_id "
        "ORDER BY round(ari, 9) DESC, delta1, delta2, delta3 LIMIT 1"
    )
    out["snapshot_roundtrip"] = Chain(SCALED, first(two_runs)).select(_population("pop0"))
    return out
