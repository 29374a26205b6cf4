"""Small helpers to spell the library's column formulas as oracle SQL.

Literals are cast to DOUBLE so DuckDB evaluates them in binary floating
point, as Spark does (a bare ``0.3`` would be a DECIMAL there).
"""

from __future__ import annotations

from pondflow.functions import physics as ph


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def horner(x: str, coefs) -> str:
    acc = d(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {d(c)})"
    return acc


def zone_volume(wl: str = "wl") -> str:
    return (f"CASE WHEN {wl} > {d(ph.ZONE_LINEAR_ABOVE)} THEN {d(ph.ZONE_VOLUME_SLOPE)} * {wl} - "
            f"{d(ph.ZONE_VOLUME_OFFSET)} ELSE {horner(wl, ph.ZONE_VOLUME_POLY)} END")


def zone_area(wl: str = "wl") -> str:
    return (f"CASE WHEN {wl} > {d(ph.ZONE_LINEAR_ABOVE)} THEN {d(ph.ZONE_AREA_LINEAR)} "
            f"ELSE {horner(wl, ph.ZONE_AREA_POLY)} END")


def cubic_volume(wl: str = "wl") -> str:
    return horner(wl, (ph.CUBIC_A, ph.CUBIC_B, ph.CUBIC_C, ph.CUBIC_D))


def cubic_surface(wl: str = "wl") -> str:
    return f"({d(3 * ph.CUBIC_A)} * {wl} + {d(2 * ph.CUBIC_B)} * {wl} + {d(ph.CUBIC_C)})"


def pond_volume_case(pond: str, table: dict, default: float, scale: float | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in table.items())
    expr = f"COALESCE(CASE upper({pond}) {whens} END, {d(default)})"
    return f"({expr} * {d(scale)})" if scale else expr


def running(agg: str, expr: str, part: str = "site", order: str = "date", exclusive: bool = False) -> str:
    end = "1 PRECEDING" if exclusive else "CURRENT ROW"
    return (f"{agg}({expr}) OVER (PARTITION BY {part} ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND {end})")


def boosted(rows: str, key: str, features, label: str, trees: int, depth: int, rate: float, bins: int, l2: float = 1.0, gamma: float = 0.0) -> str:
    """CTEs ``cuts``, ``r0``, … after a CTE ``rows``, and last ``fitted`` (its columns and ``pred``): the keyed second-order
    ensemble of ``operators.boosting`` on all rows and columns, every level of every tree spelled out."""
    fs = range(len(features))
    shares = ", ".join(repr(i / bins) for i in range(1, bins))
    out = [f"base AS (SELECT *, {label}::DOUBLE AS y FROM {rows} WHERE {label} IS NOT NULL)",
           f"cuts AS (SELECT {key}, " + ", ".join(f"list_sort(list_distinct(quantile_disc({f}::DOUBLE, [{shares}]))) AS c{i}" for i, f in enumerate(features))
           + f" FROM base GROUP BY {key})",
           f"r0 AS (SELECT base.*, avg(y) OVER (PARTITION BY {key}) AS pred, "
           + ", ".join(f"CASE WHEN {f} IS NULL THEN -1 ELSE len(list_filter(c{i}, lambda c: c < {f})) END AS b{i}" for i, f in enumerate(features))
           + f" FROM base JOIN cuts USING ({key}))"]
    value = f"-({{g}}) / ({{h}} + {d(l2)}) * {d(rate)}"
    for t in range(trees):
        out.append(f"p{t}_0 AS (SELECT *, 0 AS node, {d(0)} AS v, true AS is_open FROM r{t})")
        for level in range(depth):
            a, n = f"p{t}_{level}", f"{t}_{level}"
            cells = " UNION ALL ".join(f"SELECT {key}, node, {i} AS f, b{i} AS bin, pred - y AS g FROM {a} WHERE is_open" for i in fs)
            out.append(f"h{n} AS (SELECT {key}, node, f, bin, sum(g) AS g, count(*)::DOUBLE AS h FROM ({cells}) GROUP BY ALL)")
            part = f"PARTITION BY {key}, node, f"
            out.append(f"w{n} AS (SELECT *, coalesce(sum(g) FILTER (bin < 0) OVER ({part}), 0) AS gm, coalesce(sum(h) FILTER (bin < 0) OVER ({part}), 0) AS hm, "
                       f"sum(g) OVER ({part}) AS gs, sum(h) OVER ({part}) AS hs, sum(g) OVER ({part} ORDER BY bin) AS ga, sum(h) OVER ({part} ORDER BY bin) AS ha FROM h{n})")
            out.append(f"s{n} AS (SELECT *, gl * gl / (hl + {d(l2)}) + (gs - gl) * (gs - gl) / (hs - hl + {d(l2)}) - gs * gs / (hs + {d(l2)}) AS gain FROM ("
                       f"SELECT *, ga AS gl, ha AS hl, true AS blanks_left FROM w{n} WHERE bin >= 0 UNION ALL "
                       f"SELECT *, ga - gm AS gl, ha - hm AS hl, false FROM w{n} WHERE bin >= 0) WHERE hl >= 1 AND hs - hl >= 1)")
            out.append(f"x{n} AS (SELECT {key}, node, f, bin, blanks_left, gl, hl FROM s{n} WHERE gain > {max(gamma, 1e-9)!r} QUALIFY row_number() OVER "
                       f"(PARTITION BY {key}, node ORDER BY gain::FLOAT DESC, f, bin, blanks_left) = 1)")
            out.append(f"t{n} AS (SELECT {key}, node, gs, hs FROM w{n} WHERE f = 0 GROUP BY ALL)")
            bin_ = "CASE x.f " + " ".join(f"WHEN {i} THEN b{i}" for i in fs) + " END"
            left = f"CASE WHEN {bin_} < 0 THEN x.blanks_left ELSE {bin_} <= x.bin END"
            leaf = f"CASE WHEN {left} THEN {value.format(g='x.gl', h='x.hl')} ELSE {value.format(g='z.gs - x.gl', h='(z.hs - x.hl)')} END"
            keep = f"{a}.* EXCLUDE (node, v, is_open)"
            out.append(f"p{t}_{level + 1} AS (SELECT {keep}, CASE WHEN x.f IS NULL THEN {a}.node WHEN {left} THEN 2 * {a}.node + 1 ELSE 2 * {a}.node + 2 END AS node, "
                       f"CASE WHEN x.f IS NOT NULL THEN {leaf} WHEN is_open AND {a}.node = 0 THEN {value.format(g='z.gs', h='z.hs')} ELSE v END AS v, "
                       f"is_open AND x.f IS NOT NULL AS is_open FROM {a} "
                       f"LEFT JOIN t{n} z ON z.{key} = {a}.{key} AND z.node = {a}.node AND is_open LEFT JOIN x{n} x ON x.{key} = {a}.{key} AND x.node = {a}.node AND is_open)")
        out.append(f"r{t + 1} AS (SELECT * EXCLUDE (pred, node, v, is_open), pred + v AS pred FROM p{t}_{depth})")
    out.append(f"fitted AS (SELECT * FROM r{trees})")
    return ",\n".join(out)


def boosted_nodes(key: str, features, trees: int, depth: int, rate: float, l2: float = 1.0) -> str:
    """CTEs ``nodes`` and ``walks`` after ``boosted``: each key's base and a map from 1000 * tree + heap number to (f, cut, v)."""
    value = f"-({{g}}) / ({{h}} + {d(l2)}) * {d(rate)}"
    rows = []
    for t in range(trees):
        for level in range(depth):
            n = f"{t}_{level}"
            cut = "CASE x.f " + " ".join(f"WHEN {i} THEN c{i}[x.bin + 1]" for i in range(len(features))) + " END"
            rows.append(f"SELECT z.{key}, {1000 * t} + z.node AS place, x.f, {cut} AS cut, {value.format(g='z.gs', h='z.hs')} AS v "
                        f"FROM t{n} z JOIN cuts USING ({key}) LEFT JOIN x{n} x ON x.{key} = z.{key} AND x.node = z.node")
        n = f"{t}_{depth - 1}"
        for side, g, h in ((1, "x.gl", "x.hl"), (2, "z.gs - x.gl", "z.hs - x.hl")):
            rows.append(f"SELECT z.{key}, {1000 * t} + 2 * z.node + {side}, NULL, NULL, {value.format(g=g, h='(' + h + ')')} "
                        f"FROM t{n} z JOIN x{n} x ON x.{key} = z.{key} AND x.node = z.node")
    return (f"nodes AS ({' UNION ALL '.join(rows)}),\n"
            f"walks AS (SELECT {key}, map(list(place), list({{'f': f, 'cut': cut, 'v': v}})) AS m FROM nodes GROUP BY {key})")


def boosted_walk(x: str, base: str, trees: int, depth: int) -> str:
    """The ensemble's value at the feature list ``x``, walking the map ``m``."""
    total = base
    for t in range(trees):
        at = str(1000 * t)
        for _ in range(depth):
            node = f"m[{at}]"
            at = f"CASE WHEN {node}.f IS NULL THEN {at} WHEN {x}[{node}.f + 1] <= {node}.cut THEN {1000 * t} + 2 * ({at} - {1000 * t}) + 1 ELSE {1000 * t} + 2 * ({at} - {1000 * t}) + 2 END"
        total += f" + m[{at}].v"
    return total
