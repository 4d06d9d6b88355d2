"""DuckDB SQL for the registered queries, written from the operator definitions.

The texts share the input views and two formulas with nothing on the Spark side:
reflectance is computed here by carrying the surface admittance up through the
layers, and quantiles come from DuckDB's own functions or from sorted lists.
"""

from __future__ import annotations

from lumisweep.functions.formatting import SI_PREFIXES
from lumisweep.functions.optics import QE_PER_NM
from lumisweep.operators.bootstrap import FACTORS, POISSON, PRIME
from lumisweep.operators.rollup import RISETIME_LIMITS_PS
from lumisweep.operators.sweepgrid import thickness_decades
from lumisweep.plans.views import (ALL_LAMBDAS, ANGLES, DEVICE_POINTS, FEW_LAMBDAS, LAMBDAS,
                                   MEASURED_LAMBDAS, POWERS, WHOLE_POINTS)

ORACLE_SQL: dict[str, str] = {}


def rd(expr: str, digits: int = 6) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def rds(digits: int, *names: str) -> str:
    return ", ".join(f"{rd(n, digits)} AS {n}" for n in names)


V1 = """v1 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE AS f, value / 10 AS a
  FROM events)"""

V2 = """v2 AS (SELECT l_returnflag AS operator, l_linestatus AS run, l_suppkey AS part,
  l_quantity AS f, l_extendedprice / 10000 AS a FROM lineitem)"""

V3 = f"""v3 AS (SELECT p_partkey, p_brand, p_size, i - 1 AS pos, (10 * i)::DOUBLE AS f,
  -20.0 * log10(1 + pow((10 * i)::DOUBLE / (200.0::DOUBLE + 5 * p_size), 2))
  + (((p_partkey * 37 + i * 101) % 97)::DOUBLE / 97.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE AS a
  FROM part, range(1, {DEVICE_POINTS + 1}) AS t(i))"""

V3_WHOLE = V3.replace(f"range(1, {DEVICE_POINTS + 1})", f"range(1, {WHOLE_POINTS + 1})").replace(
    "(10 * i)", f"({10 * DEVICE_POINTS // WHOLE_POINTS} * i)")


def readout_ctes(src: str, keys: str, fmin: float, fmax: float, closed: bool = False,
                 last: bool = False, digits: int | None = 1) -> str:
    """Plateau limits, level and cut-off of the sweeps in ``src``; result in ``res``."""
    upper = "<=" if closed else "<"
    usable = "" if last else "AND s.pos < e.p"
    cutoff = "b.f" if digits is None else rd("b.f", digits)
    return f"""
lo AS (SELECT {keys}, pos AS p FROM {src}
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY abs(f - {fmin}), pos) = 1),
hi AS (SELECT {keys}, pos AS p FROM {src}
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY abs(f - {fmax}), pos) = 1),
en AS (SELECT {keys}, max(pos) AS p FROM {src} GROUP BY ALL),
lst AS (SELECT {keys}, list_sort(list(s.a)) AS l FROM {src} s JOIN lo USING ({keys})
  JOIN hi USING ({keys}) WHERE s.pos >= lo.p AND s.pos {upper} hi.p GROUP BY ALL),
med AS (SELECT {keys}, len(l) AS n, (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS m FROM lst),
best AS (SELECT {keys}, s.pos, s.f FROM {src} s JOIN lo USING ({keys}) JOIN en e USING ({keys})
  JOIN med USING ({keys}) WHERE s.pos >= lo.p {usable}
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY abs(3 - abs(s.a - m)), s.pos) = 1),
res AS (SELECT {keys}, m AS plateau, n AS n_plateau, b.pos, {cutoff} AS cutoff_mhz
  FROM en LEFT JOIN med USING ({keys}) LEFT JOIN best b USING ({keys}))"""


RISE = "0.35::DOUBLE / cutoff_mhz * 1e6"

ORACLE_SQL["positions"] = """
SELECT l_suppkey, l_orderkey, count(*) AS lines, max(l_extendedprice) AS top,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS pos
FROM lineitem GROUP BY l_suppkey, l_orderkey"""

ORACLE_SQL["nearest_sample"] = f"""
WITH {V1} SELECT user_id, pos, {rd('f')} AS f, {rd('abs(f - 8.0)')} AS distance FROM v1
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(f - 8.0), pos) = 1"""

_V1_READ = f"WITH {V1}, {readout_ctes('v1', 'user_id', 8.0, 40.0)}"

ORACLE_SQL["plateau_median"] = f"""
{_V1_READ} SELECT user_id, {rd('m')} AS plateau, n AS n_plateau FROM med"""

ORACLE_SQL["plateau_rows"] = f"""
{_V1_READ} SELECT user_id, s.pos, s.f, {rd('s.a')} AS a FROM v1 s JOIN lo USING (user_id)
JOIN hi USING (user_id) WHERE s.pos BETWEEN lo.p AND hi.p"""

ORACLE_SQL["cutoff_readout_events"] = f"""
{_V1_READ} SELECT user_id, {rds(6, 'plateau')}, n_plateau, pos, cutoff_mhz FROM res"""

_V3_READ = f"WITH {V3}, {readout_ctes('v3', 'p_partkey', 8.0, 100.0)}"
_V3_RES = f"""{_V3_READ}, dev AS (SELECT res.*, p_brand, p_size, {rd(RISE, 1)} AS risetime_ps
  FROM res JOIN part USING (p_partkey))"""

ORACLE_SQL["cutoff_readout"] = f"""
{_V3_RES} SELECT p_partkey, p_brand, p_size, {rds(6, 'plateau')}, n_plateau, pos, cutoff_mhz
FROM dev"""

ORACLE_SQL["risetime"] = f"""
{_V3_RES} SELECT p_partkey, cutoff_mhz, risetime_ps FROM dev"""

ORACLE_SQL["cutoff_closed_plateau"] = f"""
WITH {V2}, m2 AS (SELECT operator, run, part, f, f AS pos, {rd('avg(a)', 9)} AS a
  FROM v2 GROUP BY ALL),
{readout_ctes('m2', 'operator, run, part', 10.0, 25.0, True, True, None)}
SELECT operator, run, part, {rds(6, 'plateau')}, n_plateau, pos, {rds(6, 'cutoff_mhz')} FROM res"""

ORACLE_SQL["positional_slice"] = f"""
WITH {V3} SELECT p_partkey, pos, f, {rd('a')} AS a FROM v3 WHERE pos >= 15 AND pos < 50"""

ORACLE_SQL["positional_slice_whole"] = f"""
WITH {V3_WHOLE} SELECT p_partkey, pos, f, {rd('a')} AS a FROM v3 WHERE pos >= 15 AND pos < 500"""

ORACLE_SQL["pack_unpack"] = f"""
WITH {V1} SELECT user_id, pos, f, {rd('a')} AS a FROM v1 WHERE pos >= 10 AND pos < 30"""

ORACLE_SQL["mean_over_repeats"] = f"""
WITH {V2} SELECT operator, run, part, f, {rd('avg(a)', 10)} AS a FROM v2 GROUP BY ALL"""

ORACLE_SQL["rollup_mean_of_ratios"] = f"""
{_V3_RES} SELECT p_brand, p_size::BIGINT AS p_size, {rd('avg(cutoff_mhz)', 4)} AS cutoff_mhz,
  {rd('avg(risetime_ps)', 4)} AS risetime_ps FROM dev GROUP BY ALL"""

ORACLE_SQL["rollup_ratio_of_means"] = f"""
{_V3_RES}, g AS (SELECT p_brand, p_size, avg(abs(cutoff_mhz)) AS cutoff_mhz FROM dev GROUP BY ALL)
SELECT p_brand, p_size::BIGINT AS p_size, {rd('cutoff_mhz', 4)} AS cutoff_mhz,
  {rd(RISE, 4)} AS risetime_ps FROM g"""

ORACLE_SQL["average_then_detect"] = f"""
WITH {V3}, m3 AS (SELECT p_brand, p_size, f, f AS pos, {rd('avg(a)', 9)} AS a FROM v3 GROUP BY ALL),
{readout_ctes('m3', 'p_brand, p_size', 8.0, 100.0)}
SELECT p_brand, p_size::BIGINT AS p_size, {rds(6, 'plateau')}, cutoff_mhz,
  {rd(RISE, 1)} AS risetime_ps FROM res"""

ORACLE_SQL["device_lookup"] = f"""
WITH {V2}, runs AS (SELECT DISTINCT operator, run, part FROM v2)
SELECT operator, run, part, s_name, n_name FROM runs
LEFT JOIN supplier ON part = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"""

ORACLE_SQL["attach_identity"] = """
SELECT o_orderpriority AS operator, count(*) AS samples, sum(l_quantity) AS sum_f
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""

ORACLE_SQL["parts_excluded"] = """
SELECT l_suppkey AS part, count(*) AS samples FROM lineitem
WHERE l_suppkey NOT IN (1, 2, 3, 4) GROUP BY 1"""

ORACLE_SQL["distinct_runs"] = f"WITH {V2} SELECT DISTINCT operator, run, part FROM v2"

ORACLE_SQL["part_operator_summary"] = f"""
SELECT l_suppkey AS part, l_returnflag AS operator,
  CASE WHEN grouping(l_suppkey) = 0 AND grouping(l_returnflag) = 0 THEN 'part_operator'
       WHEN grouping(l_suppkey) = 1 THEN 'operator' ELSE 'part' END AS level,
  count(l_extendedprice) AS n, min(l_extendedprice) AS min,
  {rd('avg(l_extendedprice)', 4)} AS mean, max(l_extendedprice) AS max,
  {rd('stddev_samp(l_extendedprice)', 4)} AS sd
FROM lineitem
GROUP BY GROUPING SETS ((l_suppkey), (l_returnflag), (l_suppkey, l_returnflag))"""

_band = " ".join(f"WHEN risetime_ps < {v} THEN {i}" for i, v in enumerate(RISETIME_LIMITS_PS))
ORACLE_SQL["threshold_bands"] = f"""
{_V3_RES} SELECT p_brand, (CASE {_band} WHEN risetime_ps IS NOT NULL
  THEN {len(RISETIME_LIMITS_PS)} END)::BIGINT AS band, count(*) AS n FROM dev GROUP BY 1, 2"""

ORACLE_SQL["mean_curve_ci"] = f"""
WITH {V2}, g AS (SELECT part, f, count(a) AS n, avg(a) AS mean, stddev_samp(a) AS sd
  FROM v2 GROUP BY ALL)
SELECT part, f, n, {rd('mean')} AS mean, {rd('sd')} AS sd,
  {rd('mean - 1.96::DOUBLE * sd / sqrt(n)')} AS ci_low,
  {rd('mean + 1.96::DOUBLE * sd / sqrt(n)')} AS ci_high FROM g"""

# ------------------------------------------------------------------ names, text, files

ORACLE_SQL["parse_names"] = """
WITH n AS (SELECT string_split(l_returnflag || 'OP_RO' || l_suppkey || '_part' || l_linenumber
  || '_' || lpad((l_quantity::INT)::VARCHAR, 3, '0') || '.CSV', '_') AS p FROM lineitem)
SELECT p[1] AS operator, regexp_extract(p[2], '[0-9]+')::BIGINT AS run_order,
  regexp_extract(p[3], '[0-9]+')::BIGINT AS part, left(p[4], 3) AS repeat, count(*) AS files
FROM n GROUP BY ALL"""

ORACLE_SQL["decimal_comma_roundtrip"] = """
SELECT o_orderkey, replace(o_totalprice::VARCHAR, '.', ',') AS text, o_totalprice AS value
FROM orders"""

_FILE = """'OP' || p_partkey || '_RO' || p_size || '_part' || (1 + p_partkey % 10) || '_'
  || lpad((p_partkey % 5 + 1)::VARCHAR, 3, '0') || '.CSV'"""

ORACLE_SQL["sweep_text_readout"] = f"""
WITH {V3}, t3 AS (SELECT p_partkey, pos, f, round(a, 4) AS a FROM v3),
{readout_ctes('t3', 'p_partkey', 8.0, 100.0)}
SELECT 'OP' || p_partkey AS operator, p_size::BIGINT AS run_order, 1 + p_partkey % 10 AS part,
  lpad((p_partkey % 5 + 1)::VARCHAR, 3, '0') AS repeat, {rds(6, 'plateau')}, cutoff_mhz,
  {rd(RISE, 1)} AS risetime_ps
FROM res JOIN part USING (p_partkey) WHERE p_partkey % 10 + 1 NOT IN (1, 2, 3, 4)"""

ORACLE_SQL["sweep_text_samples"] = f"""
WITH {V3} SELECT {_FILE} AS file, count(a) AS samples, max(f) AS f_max,
  {rd('sum(round(a, 4))', 3)} AS a_sum
FROM v3 WHERE pos < 150 GROUP BY 1"""

ORACLE_SQL["sweep_text_samples_whole"] = f"""
WITH {V3_WHOLE} SELECT {_FILE} AS file, count(a) AS samples, max(f) AS f_max,
  {rd('sum(round(a, 4))', 3)} AS a_sum
FROM v3 GROUP BY 1"""

_REPORT = "'report_' || lpad(s_suppkey::VARCHAR, 12, '0') || '.csv'"

ORACLE_SQL["report_header_recipe"] = f"""
SELECT {_REPORT} AS path, '2022-07-21' AS date, s_name AS article_name,
  'FA' || (s_suppkey % 13) AS fa_nr, 'W' || s_nationkey AS wafer_batch,
  s_suppkey::VARCHAR AS device_nr, '25,0' AS temperature, '10' AS filter_counts,
  (s_suppkey % 3)::VARCHAR AS delay, '1' AS nplc, '-5' AS voltage, 'an' AS channel_b,
  '1e-9' AS dark_current FROM supplier"""

ORACLE_SQL["report_measured"] = f"""
SELECT {_REPORT} AS path, i AS pos, (400 + 10 * i)::DOUBLE AS wellenlange,
  ('0.' || lpad(((s_suppkey * 7 + i * 13) % 1000)::VARCHAR, 3, '0'))::DOUBLE AS empfindlichkeit,
  s_name AS article_name, 'FA' || (s_suppkey % 13) AS fa_nr, s_suppkey::VARCHAR AS device_nr
FROM supplier, range(20) AS t(i)"""

ORACLE_SQL["report_header_ids"] = f"""
SELECT {_REPORT} AS path, row_number() OVER (ORDER BY {_REPORT}) AS header_id FROM supplier"""

ORACLE_SQL["clean_name_values"] = """
SELECT p_partkey, lower(replace(p_type, ' ', '_')) || '_' || lower(replace(p_name, ' ', '_'))
  || '_grosse' AS name FROM part"""

_LOG = "floor(log10(abs(x)))::INT"
_si = " ".join(f"WHEN abs(x) >= 1e{3 * i - 24} THEN {i + 1}"
               for i in range(len(SI_PREFIXES) - 1, -1, -1))
_si_factor = " ".join(f"WHEN abs(x) >= 1e{3 * i - 24} THEN 1e{3 * i - 24}"
                      for i in range(len(SI_PREFIXES) - 1, -1, -1))
_prefix_list = "[" + ", ".join(f"'{p}'" for p in SI_PREFIXES) + "]"
ORACLE_SQL["number_formats"] = f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS x FROM orders),
e AS (SELECT *, {_LOG.replace('abs(x)', 'x / 7')} AS e,
  round(x / 7 / pow(10, {_LOG.replace('abs(x)', 'x / 7')}), 6) AS m,
  x / (CASE {_si_factor} END) AS v, CASE {_si} END AS ix FROM o)
SELECT o_orderkey,
  regexp_replace(round(m * pow(10, e % 3), 6)::VARCHAR, '\\.0$', '') || 'e' || (e - e % 3) AS eng,
  regexp_replace(round(v, CASE WHEN v >= 100 THEN 12 WHEN v >= 10 THEN 13 ELSE 14 END)::VARCHAR,
    '\\.0$', '') || {_prefix_list}[ix] || 'Hz' AS si,
  round(x / 1e6, 4)::DECIMAL(38, 4)::VARCHAR AS fixed FROM e"""

ORACLE_SQL["unit_and_rounding"] = f"""
WITH o AS (SELECT o_orderkey, {rd('o_totalprice * 1000 / 1e6', 4)} AS mhz,
  {rd('o_totalprice / 7', 4)} AS seventh FROM orders)
SELECT *, {rd('0.35::DOUBLE / mhz * 1e6', 1)} AS risetime_ps FROM o"""

# ------------------------------------------------------------------ layer stacks

CONSTANTS = """1.0::DOUBLE AS n_env, 3.42 + 120000.0 / (lam * lam) AS n_si,
  100000.0 * exp(-(lam - 400.0) / 90.0) AS alpha_si, 1.448 + 3540.0 / (lam * lam) AS n_sio2,
  0.0::DOUBLE AS k_sio2, 1.98 + 14000.0 / (lam * lam) AS n_si3n4,
  0.002 * exp(-(lam - 400.0) / 50.0) AS k_si3n4,
  100000.0 * exp(-(lam - 400.0) / 90.0) * lam * 1e-7 / (4 * pi()) AS k_si"""


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def reflect(out: str, d2: str, d3: str, mode: str = "te", tilted: bool = True) -> list[str]:
    """Select lists, one after the other, for one polarisation: admittance up the layers."""
    p = f"{out}_"

    def cos(n: str) -> str:
        return f"sqrt(1 - pow(n_env * sin(radians(ang)) / {n}, 2))" if tilted else "1.0::DOUBLE"

    cos0 = "cos(radians(ang))" if tilted else "1.0::DOUBLE"
    op = "*" if mode == "te" else "/"
    return [
        f"{cos('n_sio2')} AS {p}k2, {cos('n_si3n4')} AS {p}k1, {cos('n_si')} AS {p}ks",
        f"""n_env {op} {cos0} AS {p}y0, n_si {op} {p}ks AS {p}ar, k_si {op} {p}ks AS {p}ai,
  n_sio2 {op} {p}k2 AS {p}y2r, k_sio2 {op} {p}k2 AS {p}y2i,
  n_si3n4 {op} {p}k1 AS {p}y1r, k_si3n4 {op} {p}k1 AS {p}y1i,
  2 * pi() / (lam * 1e-9) * n_sio2 * {d2} * {p}k2 AS {p}f2,
  2 * pi() / (lam * 1e-9) * n_si3n4 * {d3} * {p}k1 AS {p}f1""",
        *admit(p, "a", "2", "b"), *admit(p, "b", "1", "c"),
        f"(pow({p}y0 - {p}cr, 2) + pow({p}ci, 2)) / (pow({p}y0 + {p}cr, 2) + pow({p}ci, 2)) AS {out}"]


def admit(p: str, below: str, layer: str, above: str) -> list[str]:
    """(Y cos f + i y sin f) / (cos f + i (Y / y) sin f) in real arithmetic."""
    a, y = p + below, f"{p}y{layer}"
    f, t = f"{p}f{layer}", f"{p}{above}"
    return [f"""{a}r * cos({f}) - {y}i * sin({f}) AS {t}tr,
  {a}i * cos({f}) + {y}r * sin({f}) AS {t}ti,
  cos({f}) - ({a}i * {y}r - {a}r * {y}i) / ({y}r * {y}r + {y}i * {y}i) * sin({f}) AS {t}br,
  ({a}r * {y}r + {a}i * {y}i) / ({y}r * {y}r + {y}i * {y}i) * sin({f}) AS {t}bi""",
            f"""({t}tr * {t}br + {t}ti * {t}bi) / ({t}br * {t}br + {t}bi * {t}bi) AS {t}r,
  ({t}ti * {t}br - {t}tr * {t}bi) / ({t}br * {t}br + {t}bi * {t}bi) AS {t}i"""]


def chain(source: str, name: str, *parts: list[str], keep: bool = False) -> str:
    """CTEs ``name_0 ..`` and ``name`` that add the select lists of ``parts`` in step.

    ``keep`` materializes them, which shortens planning where many are nested.
    """
    kind = "AS MATERIALIZED" if keep else "AS"
    ctes, last = [], source
    stages = list(zip(*parts))
    for i, lists in enumerate(stages):
        new = name if i == len(stages) - 1 else f"{name}_{i}"
        ctes.append(f"{new} {kind} (SELECT *, {', '.join(lists)} FROM {last})")
        last = new
    return ",\n".join(ctes)


def stack_cte(lambdas, angles=(0.0,), n: int = 3) -> str:
    """``sw``: every part, level combination, wavelength and angle with its response."""
    half = (n - 1) // 2
    tilted = tuple(angles) != (0.0,)
    modes = ([reflect("r_te", "d2", "d3", "te"), reflect("r_tm", "d2", "d3", "tm")] if tilted
             else [reflect("r", "d2", "d3", "te", False)])
    mean = ", (r_te + r_tm) / 2 AS r" if tilted else ""
    return f"""
lv AS (SELECT p_partkey, p_brand, i1, i2, i3, lam, ang,
  (80 + p_size) * 1e-7 + i1 * 1.5e-6 / {half} AS d1,
  (12 + p_partkey % 7) * 1e-9 + i2 * 5e-9 / {half} AS d2,
  (60 + p_partkey % 11) * 1e-9 + i3 * 5e-9 / {half} AS d3,
  ((i1 + {half}) * {n} + i2 + {half}) * {n} + i3 + {half} AS combo
  FROM part, range(-{half}, {half + 1}) AS t1(i1), range(-{half}, {half + 1}) AS t2(i2),
  range(-{half}, {half + 1}) AS t3(i3), unnest({_list(lambdas)}) AS t4(lam),
  unnest({_list(angles)}) AS t5(ang)),
co AS (SELECT *, {CONSTANTS} FROM lv), {chain('co', 'rf', *modes)},
sb AS (SELECT *, 1 - exp(-alpha_si * 100 * d1) AS absorption, lam * {QE_PER_NM!r} AS qe{mean}
  FROM rf),
sw AS (SELECT *, absorption * qe * (1 - r) AS sabs FROM sb)"""


TARGET = "i1 = 0 AND i2 = 0 AND i3 = 0"

ORACLE_SQL["tolerance_sweep"] = f"""
WITH {stack_cte(LAMBDAS)} SELECT p_partkey, count(*) AS n, sum(combo)::BIGINT AS combos,
  {rd('avg(sabs)', 7)} AS sabs_mean, {rd('avg(r)', 7)} AS r_mean,
  {rd('avg(absorption)', 7)} AS absorption_mean, {rd('max(qe)', 7)} AS qe_max,
  {rd('avg(d1) * 1e6')} AS si_mean FROM sw GROUP BY 1"""

ORACLE_SQL["reflectance_grid"] = f"""
WITH {stack_cte(FEW_LAMBDAS, ANGLES)} SELECT p_partkey, ang AS angle_deg,
  {rd('avg(r_te)', 7)} AS r_te, {rd('avg(r_tm)', 7)} AS r_tm, {rd('avg(r)', 7)} AS r,
  {rd('avg(1 - r_te)', 7)} AS t_te, {rd('avg(1 - r_tm)', 7)} AS t_tm, {rd('avg(1 - r)', 7)} AS t,
  {rd('max(asin(n_env * sin(radians(ang)) / n_si))', 7)} AS angle_si FROM sw GROUP BY 1, 2"""

ORACLE_SQL["absorption_sweep"] = f"""
SELECT p_partkey, lam AS lambda_nm, count(*) AS n,
  {rd('sum(1 - exp(-100000.0 * exp(-(lam - 400.0) / 90.0) * (1 + p_partkey % 5) * 100 * d))', 5)}
  AS total
FROM part, unnest({_list([660, 905, 940, 1064])}) AS t(lam), unnest({_list(thickness_decades())}) AS u(d)
GROUP BY 1, 2"""

ORACLE_SQL["envelope_all"] = f"""
WITH {stack_cte(LAMBDAS)} SELECT p_partkey, lam AS lambda_nm,
  {rd(f'max(sabs) FILTER ({TARGET})', 7)} AS target, {rd('min(sabs)', 7)} AS min,
  {rd('max(sabs)', 7)} AS max FROM sw GROUP BY 1, 2"""

ORACLE_SQL["envelope_all_whole"] = f"""
WITH {stack_cte(ALL_LAMBDAS)} SELECT p_partkey, lam AS lambda_nm,
  {rd(f'max(sabs) FILTER ({TARGET})', 7)} AS target, {rd('min(sabs)', 7)} AS min,
  {rd('max(sabs)', 7)} AS max FROM sw GROUP BY 1, 2"""

_vary = {"all": "true", "si": "i2 = 0 AND i3 = 0", "sio2": "i1 = 0 AND i3 = 0",
         "si3n4": "i1 = 0 AND i2 = 0"}
ORACLE_SQL["envelope_one_factor"] = f"WITH {stack_cte(LAMBDAS)} " + " UNION ALL ".join(
    f"SELECT p_brand, lam AS lambda_nm, '{v}' AS varying, {rd('min(sabs)', 7)} AS min, "
    f"{rd('max(sabs)', 7)} AS max FROM sw WHERE {cond} GROUP BY 1, 2" for v, cond in _vary.items())


def envelope_one_factor_sql(lambdas, n: int) -> str:
    """Every envelope of every combination of levels, wide."""
    held = {**_vary, "target": TARGET}
    return f"WITH {stack_cte(lambdas, n=n)} SELECT p_brand, lam AS lambda_nm, " + ", ".join(
        rd(f"{e}(sabs) FILTER ({cond})", 7) + f" AS {v}_{e}"
        for v, cond in held.items() for e in ("min", "max")) + " FROM sw GROUP BY 1, 2"


def envelope_bands_sql(lambdas, n: int, bands: dict[str, int]) -> str:
    return f"WITH {stack_cte(lambdas, n=n)} " + \
        "SELECT p_brand, lam AS lambda_nm, " + ", ".join(
            rd(f"{e}(r) FILTER (greatest(abs(i1), abs(i2), abs(i3)) <= {w})", 7) + f" AS {b}_{e}"
            for b, w in bands.items() for e in ("min", "max")) + " FROM sw GROUP BY 1, 2"


ORACLE_SQL["envelope_bands"] = envelope_bands_sql(
    FEW_LAMBDAS, 5, {"tol": 2, "sd_1": 0, "sd_2": 1, "sd_3": 1})

# Thin layers repeat among the parts; each pair of them is computed once here.
_THIN = f"""th AS (SELECT DISTINCT p_partkey % 7 AS k2, p_partkey % 11 AS k3 FROM part),
tl AS (SELECT k2, k3, i2, i3, lam, (12 + k2) * 1e-9 + i2 * 5e-9 / 4 AS d2,
  (60 + k3) * 1e-9 + i3 * 5e-9 / 4 AS d3, {CONSTANTS} FROM th, range(-4, 5) AS t2(i2),
  range(-4, 5) AS t3(i3), unnest({_list(ALL_LAMBDAS)}) AS t4(lam)),
{chain('tl', 'tr', reflect('r', 'd2', 'd3', 'te', False))}"""
_BANDS = {"tol": 4, "sd_1": 1, "sd_2": 2, "sd_3": 3}
ORACLE_SQL["envelope_bands_whole"] = f"WITH {_THIN}, bd AS (SELECT k2, k3, lam, " + ", ".join(
    f"{e}(r) FILTER (greatest(abs(i2), abs(i3)) <= {w}) AS {b}_{e}"
    for b, w in _BANDS.items() for e in ("min", "max")) + """ FROM tr GROUP BY ALL)
SELECT p_brand, lam AS lambda_nm, """ + ", ".join(
    rd(f"{e}({b}_{e})", 7) + f" AS {b}_{e}" for b in _BANDS for e in ("min", "max")) + """
FROM part JOIN bd ON p_partkey % 7 = k2 AND p_partkey % 11 = k3 GROUP BY ALL"""

#: Levels of silicon and pairs of thin layers of each envelope.
_FREE = {"target": ("i1 = 0", "i2 = 0 AND i3 = 0"), "all": ("true", "true"),
         "si": ("true", "i2 = 0 AND i3 = 0"), "sio2": ("i1 = 0", "i3 = 0"),
         "si3n4": ("i1 = 0", "i2 = 0")}
ORACLE_SQL["envelope_one_factor_whole"] = f"""WITH {_THIN}, tt AS (SELECT k2, k3, lam, """ + ", ".join(
    f"{e}(1 - r) FILTER ({thin}) AS t_{b}_{e}" for b, (_, thin) in _FREE.items()
    for e in ("min", "max")) + f""" FROM tr GROUP BY ALL),
al AS (SELECT size, lam, i1, 1 - exp(-100000.0 * exp(-(lam - 400.0) / 90.0) * 100
  * ((80 + size) * 1e-7 + i1 * 1.5e-6 / 4)) AS a FROM (SELECT DISTINCT p_size AS size FROM part),
  range(-4, 5) AS t1(i1), unnest({_list(ALL_LAMBDAS)}) AS t4(lam)),
aa AS (SELECT size, lam, """ + ", ".join(
    f"{e}(a) FILTER ({si}) AS a_{b}_{e}" for b, (si, _) in _FREE.items()
    for e in ("min", "max")) + """ FROM al GROUP BY ALL)
SELECT p_brand, tt.lam AS lambda_nm, """ + ", ".join(
    rd(f"{e}(a_{b}_{e} * t_{b}_{e} * tt.lam * {QE_PER_NM!r})", 7) + f" AS {b}_{e}"
    for b in _FREE for e in ("min", "max")) + """
FROM part JOIN tt ON p_partkey % 7 = k2 AND p_partkey % 11 = k3
JOIN aa ON aa.size = p_size AND aa.lam = tt.lam GROUP BY ALL"""

ORACLE_SQL["envelope_by_angle"] = f"""
WITH {stack_cte(FEW_LAMBDAS, ANGLES)} SELECT p_brand, ang AS angle_deg,
  {rd(f'max(sabs) FILTER ({TARGET})', 7)} AS target, {rd('min(sabs)', 7)} AS min,
  {rd('max(sabs)', 7)} AS max FROM sw GROUP BY 1, 2"""

ORACLE_SQL["target_by_angle"] = f"""
WITH {stack_cte([905.0], ANGLES)}, b AS (SELECT ang, min(sabs) AS lo, max(sabs) AS hi FROM sw
  GROUP BY 1), t AS (SELECT * FROM sw WHERE {TARGET})
SELECT b.ang AS angle_deg, p_partkey, {rd('sabs', 7)} AS sabs, {rd('lo', 7)} AS min,
  {rd('hi', 7)} AS max FROM t RIGHT JOIN b ON t.ang = b.ang"""

ORACLE_SQL["target_by_angle_whole"] = f"""
WITH {stack_cte(ALL_LAMBDAS, ANGLES)}, b AS (SELECT ang, min(sabs) AS lo, max(sabs) AS hi FROM sw
  GROUP BY 1), t AS (SELECT * FROM sw WHERE {TARGET})
SELECT b.ang AS angle_deg, p_partkey, lam AS lambda_nm, {rd('sabs', 7)} AS sabs,
  {rd('lo', 7)} AS min, {rd('hi', 7)} AS max FROM t RIGHT JOIN b ON t.ang = b.ang"""

ORACLE_SQL["point_table"] = f"""
WITH {stack_cte([1064.0])} SELECT p_partkey, lam AS lambda_nm,
  {rd(f'max(r) FILTER ({TARGET})', 4)} AS target, {rd('min(r)', 4)} AS min,
  {rd('max(r)', 4)} AS max FROM sw GROUP BY 1, 2"""

# ------------------------------------------------------------------ distributions

_DECILES = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


def deciles(src: str, key: str, value: str, sd: str, digits: int) -> str:
    qs = ", ".join(f"{rd(f'q[{i + 1}]', digits)} AS q_{i * 10}" for i in range(11))
    return f"""(SELECT {key}, {qs}, {rd('sd', digits)} AS {sd} FROM (SELECT {key},
  quantile_cont({value}, {_DECILES}) AS q, stddev_samp({value}) AS sd FROM {src} GROUP BY 1))"""


_PRICES = deciles("lineitem", "l_quantity", "l_extendedprice", "sd_l_extendedprice", 4)
ORACLE_SQL["decile_bands"] = f"SELECT * FROM {_PRICES}"
ORACLE_SQL["decile_bands_long"] = f"""
UNPIVOT (SELECT * EXCLUDE (sd_l_extendedprice) FROM {_PRICES})
ON {', '.join(f'q_{i * 10}' for i in range(11))} INTO NAME quantile VALUE value"""
ORACLE_SQL["decile_bands_sweep"] = f"""
WITH {stack_cte(FEW_LAMBDAS)}, s AS (SELECT lam AS lambda_nm, sabs FROM sw)
SELECT * FROM {deciles('s', 'lambda_nm', 'sabs', 'sd_sabs', 6)}"""

_PEAKS = f"""{stack_cte(LAMBDAS)}, pk AS (SELECT p_partkey, combo, lam AS lambda_nm,
  {rd('sabs', 7)} AS sabs FROM sw QUALIFY row_number() OVER (
    PARTITION BY p_partkey, combo ORDER BY {rd('sabs', 7)} DESC, lam) = 1)"""

ORACLE_SQL["peak_row"] = f"""
WITH {_PEAKS} SELECT p_partkey, count(*) AS combos, min(lambda_nm) AS lambda_min,
  max(lambda_nm) AS lambda_max, sum(lambda_nm) AS lambda_sum, {rd('sum(sabs)', 7)} AS sabs_sum
FROM pk GROUP BY 1"""

_PEAKS_WHOLE = _PEAKS.replace(_list(LAMBDAS), _list(ALL_LAMBDAS))
ORACLE_SQL["peak_row_whole"] = f"""
WITH {_PEAKS_WHOLE} SELECT p_partkey, count(*) AS combos, min(lambda_nm) AS lambda_min,
  max(lambda_nm) AS lambda_max, sum(lambda_nm) AS lambda_sum, {rd('sum(sabs)', 7)} AS sabs_sum
FROM pk GROUP BY 1"""


def summary(column: str) -> str:
    return f"""SELECT '{column}' AS "column", {rd('q[1]', 10)} AS min, {rd('q[2]', 10)} AS q1,
  {rd('q[3]', 10)} AS median, {rd('m', 10)} AS mean, {rd('q[4]', 10)} AS q3, {rd('q[5]', 10)} AS max
  FROM (SELECT quantile_cont({column}, [0, 0.25, 0.5, 0.75, 1]) AS q, avg({column}) AS m FROM pk)"""


ORACLE_SQL["peak_summary"] = f"""
WITH {_PEAKS} {summary('lambda_nm')} UNION ALL {summary('sabs')}"""

ORACLE_SQL["peak_ecdf"] = f"""
WITH {_PEAKS}, c AS (SELECT lambda_nm, count(*) AS n FROM pk GROUP BY 1)
SELECT lambda_nm, n, {rd('sum(n) OVER (ORDER BY lambda_nm) / sum(n) OVER ()', 8)} AS ecdf FROM c"""

ORACLE_SQL["peak_ecdf_whole"] = f"""
WITH {_PEAKS_WHOLE}, c AS (SELECT lambda_nm, count(*) AS n FROM pk GROUP BY 1)
SELECT lambda_nm, n, {rd('sum(n) OVER (ORDER BY lambda_nm) / sum(n) OVER ()', 8)} AS ecdf FROM c"""

ORACLE_SQL["value_ecdf"] = f"""
SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS n,
  {rd('cume_dist() OVER (PARTITION BY event_type ORDER BY value)', 8)} AS ecdf FROM events"""

ORACLE_SQL["box_stats"] = f"""
WITH i AS (SELECT l_quantity, {rd('l_extendedprice * l_discount', 4)} AS value FROM lineitem),
q AS (SELECT l_quantity, count(*) AS n, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM i
  GROUP BY 1)
SELECT l_quantity, any_value(n) AS n, {rd('any_value(q[1])', 8)} AS q1,
  {rd('any_value(q[2])', 8)} AS median, {rd('any_value(q[3])', 8)} AS q3,
  {rd('min(value) FILTER (value >= q[1] - 1.5 * (q[3] - q[1]))', 8)} AS whisker_low,
  {rd('max(value) FILTER (value <= q[3] + 1.5 * (q[3] - q[1]))', 8)} AS whisker_high
FROM i JOIN q USING (l_quantity) GROUP BY 1"""


def _kde_stats(src: str, key: str, v: str, rule: float, grid: int, tag: str = "") -> str:
    return f"""(SELECT {key}, count({v}) AS n{tag}, min({v}) AS lo{tag},
  (max({v}) - min({v})) / {grid - 1} AS st{tag},
  {rule}::DOUBLE * least(stddev_samp({v}), (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))
    / 1.34::DOUBLE) * pow(count({v}), -0.2::DOUBLE) AS bw{tag} FROM {src} GROUP BY {key})"""


def _share(v: str, grid: int, tag: str = "") -> str:
    return f"""least(greatest(floor(({v} - lo{tag}) / st{tag}), 0), {grid - 2})::INT AS j{tag},
  ({v} - lo{tag}) / st{tag} - j{tag} AS t{tag}"""


ORACLE_SQL["kde_1d"] = f"""
WITH st AS {_kde_stats('events', 'event_type', 'value', 0.9, 512)},
p AS (SELECT event_type, {_share('value', 512)} FROM events JOIN st USING (event_type)),
b AS (SELECT event_type, j, sum(w) AS w FROM (
  SELECT event_type, j, 1 - t AS w FROM p UNION ALL SELECT event_type, j + 1, t FROM p) GROUP BY 1, 2)
SELECT event_type, {rd('any_value(lo) + i * any_value(st)', 7)} AS x,
  {rd('sum(w * exp(-0.5 * pow((i - j) * st / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n)', 7)}
  AS density
FROM b JOIN st USING (event_type), range(512) AS g(i) GROUP BY event_type, i"""


def kde_2d_sql(grid: int) -> str:
    return f"""
WITH v AS (SELECT l_returnflag, l_quantity + l_discount * 10 AS x, l_extendedprice / 1000 AS y
  FROM lineitem),
sx AS {_kde_stats('v', 'l_returnflag', 'x', 1.06, grid, 'x')},
sy AS {_kde_stats('v', 'l_returnflag', 'y', 1.06, grid, 'y')},
st AS (SELECT * FROM sx JOIN sy USING (l_returnflag)),
p AS (SELECT l_returnflag, {_share('x', grid, 'x')}, {_share('y', grid, 'y')}
  FROM v JOIN st USING (l_returnflag)),
b AS (SELECT l_returnflag, jx, jy, sum(w) AS w FROM (
  SELECT l_returnflag, jx, jy, (1 - tx) * (1 - ty) AS w FROM p UNION ALL
  SELECT l_returnflag, jx + 1, jy, tx * (1 - ty) FROM p UNION ALL
  SELECT l_returnflag, jx, jy + 1, (1 - tx) * ty FROM p UNION ALL
  SELECT l_returnflag, jx + 1, jy + 1, tx * ty FROM p) GROUP BY 1, 2, 3),
ax AS (SELECT l_returnflag, i, jy, sum(w * exp(-0.5 * pow((i - jx) * stx / bwx, 2))
  / (bwx * sqrt(2 * pi()))) AS w FROM b JOIN st USING (l_returnflag), range({grid}) AS g(i)
  GROUP BY 1, 2, 3)
SELECT l_returnflag, {rd('any_value(lox) + i * any_value(stx)', 8)} AS x,
  {rd('any_value(loy) + k * any_value(sty)', 8)} AS y,
  {rd('sum(w * exp(-0.5 * pow((k - jy) * sty / bwy, 2)) / (bwy * sqrt(2 * pi()))) / any_value(nx)', 8)}
  AS density
FROM ax JOIN st USING (l_returnflag), range({grid}) AS h(k) GROUP BY l_returnflag, i, k"""


ORACLE_SQL["kde_2d"] = kde_2d_sql(50)
ORACLE_SQL["kde_2d_whole"] = kde_2d_sql(100)

# ------------------------------------------------------------------ interpolation and fits

ORACLE_SQL["linear_segments"] = f"""
WITH {V1}, n AS (SELECT user_id, f, a, lead(f) OVER w AS f_next, lead(a) OVER w AS a_next FROM v1
  WINDOW w AS (PARTITION BY user_id ORDER BY f))
SELECT user_id, f, {rd('a')} AS a, f_next, {rd('a_next')} AS a_next,
  {rd('(a_next - a) / (f_next - f)')} AS slope FROM n WHERE f_next IS NOT NULL"""

KNOTS = f"""kn AS (SELECT l_suppkey, l_quantity AS x, {rd('avg(l_extendedprice) / 1e4')} AS y
  FROM lineitem GROUP BY 1, 2),
pt AS (SELECT DISTINCT l_suppkey, i / 2.0::DOUBLE AS u FROM lineitem, range(1, 102) AS t(i))"""

ORACLE_SQL["interpolate_linear"] = f"""
WITH {KNOTS}, sg AS (SELECT l_suppkey, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM kn
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY x))
SELECT pt.l_suppkey, u AS x, {rd('y + (y2 - y) / (x2 - sg.x) * (u - sg.x)')} AS y
FROM pt ASOF LEFT JOIN (SELECT * FROM sg WHERE x2 IS NOT NULL) sg
  ON pt.l_suppkey = sg.l_suppkey AND pt.u >= sg.x AND pt.u <= sg.x2""".replace(
    "ASOF LEFT JOIN", "LEFT JOIN").replace("pt.u <= sg.x2", "(pt.u < sg.x2 OR (pt.u = sg.x2 AND "
    "sg.x2 = (SELECT max(x) FROM kn k WHERE k.l_suppkey = pt.l_suppkey)))")

ORACLE_SQL["spline_resample"] = f"""
WITH RECURSIVE {KNOTS},
k AS (SELECT l_suppkey, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_suppkey) AS n,
  lead(x) OVER w - x AS h, x - lag(x) OVER w AS g,
  (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM kn
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY x)),
e AS (SELECT l_suppkey, max(h) FILTER (i = 1) AS h1, max(h) FILTER (i = n - 1) AS hn,
  (max(s) FILTER (i = 2) - max(s) FILTER (i = 1)) / (max(x) FILTER (i = 3) - max(x) FILTER (i = 1)) AS d1,
  (max(s) FILTER (i = 3) - max(s) FILTER (i = 2)) / (max(x) FILTER (i = 4) - max(x) FILTER (i = 2)) AS d2,
  (max(s) FILTER (i = n - 1) - max(s) FILTER (i = n - 2))
    / (max(x) FILTER (i = n) - max(x) FILTER (i = n - 2)) AS dn2,
  (max(s) FILTER (i = n - 2) - max(s) FILTER (i = n - 3))
    / (max(x) FILTER (i = n - 1) - max(x) FILTER (i = n - 3)) AS dn3,
  max(x) FILTER (i = 4) - max(x) FILTER (i = 1) AS w1,
  max(x) FILTER (i = n) - max(x) FILTER (i = n - 3) AS wn FROM k GROUP BY 1),
eq AS (SELECT k.l_suppkey, k.i, k.n,
  CASE WHEN i = 1 THEN 0 WHEN i = n THEN hn ELSE g END AS lo,
  CASE WHEN i = 1 THEN -h1 WHEN i = n THEN -hn ELSE 2 * (g + h) END AS mid,
  CASE WHEN i = 1 THEN h1 WHEN i = n THEN 0 ELSE h END AS up,
  CASE WHEN i = 1 THEN h1 * h1 * (d2 - d1) / w1 WHEN i = n THEN -hn * hn * (dn2 - dn3) / wn
    ELSE s - lag(s) OVER (PARTITION BY k.l_suppkey ORDER BY i) END AS b
  FROM k JOIN e USING (l_suppkey)),
fw AS (SELECT l_suppkey, i, n, up / mid AS cp, b / mid AS dp FROM eq WHERE i = 1
  UNION ALL SELECT eq.l_suppkey, eq.i, eq.n, up / (mid - lo * cp), (b - lo * dp) / (mid - lo * cp)
  FROM fw JOIN eq ON eq.l_suppkey = fw.l_suppkey AND eq.i = fw.i + 1),
bw AS (SELECT l_suppkey, i, dp AS c FROM fw WHERE i = n
  UNION ALL SELECT fw.l_suppkey, fw.i, dp - cp * c FROM bw JOIN fw
  ON fw.l_suppkey = bw.l_suppkey AND fw.i = bw.i - 1),
sg AS (SELECT k.l_suppkey, i, n, x, y, s - h * (lead(c) OVER w + 2 * c) AS b, c,
  (lead(c) OVER w - c) / h AS d, lead(x) OVER w AS x2 FROM k JOIN bw USING (l_suppkey, i)
  WINDOW w AS (PARTITION BY k.l_suppkey ORDER BY i))
SELECT pt.l_suppkey, u AS x,
  {rd('y + (u - sg.x) * (b + (u - sg.x) * (3 * c + (u - sg.x) * d))')} AS y
FROM pt JOIN sg ON pt.l_suppkey = sg.l_suppkey AND i < n
  AND (u >= sg.x OR i = 1) AND (u < x2 OR i = n - 1)"""


def lowpass_sql() -> str:
    """Newton steps that begin at the pole the view was made with."""
    drop = "20.0 * log10(1 + pow(f / exp(th), 2))"
    ctes = ["t0 AS (SELECT p_partkey, any_value(ln(200 + 5 * p_size)) AS th FROM v3 GROUP BY 1)"]
    for i in range(5):
        ctes.append(f"""r{i} AS (SELECT p_partkey, th, pow(f / exp(th), 2) AS u, a + {drop} AS z,
  40.0 / ln(10) * u / (1 + u) AS d FROM v3 JOIN t{i} USING (p_partkey)),
t{i + 1} AS (SELECT p_partkey, any_value(th) + covar_pop(z, d) / var_pop(d) AS th
  FROM r{i} GROUP BY 1)""")
    return f"""
WITH {V3}, {', '.join(ctes)}, o AS (SELECT p_partkey, any_value(exp(th)) AS f0, count(*) AS n,
  avg(a + {drop}) AS z, var_pop(a + {drop}) AS v FROM v3 JOIN t5 USING (p_partkey) GROUP BY 1)
SELECT p_partkey, {rd('f0', 4)} AS f0_mhz, {rd('z', 4)} AS level_db, {rd('v * n', 4)} AS sse,
  {rd(rd('f0 * 1e6', 1) + ' / 1e6', 1)} AS cutoff_mhz, true AS converged FROM o"""


ORACLE_SQL["fit_lowpass2"] = lowpass_sql()

MEASURED = f"""ms0 AS (SELECT p_partkey, lam, (95 + p_size % 11) * 1e-7 AS d1,
  (13 + p_partkey % 5) * 1e-9 AS d2, (67 + p_partkey % 7) * 1e-9 AS d3, {CONSTANTS}
  FROM part, unnest({_list(MEASURED_LAMBDAS)}) AS t(lam)),
{chain('ms0', 'ms1', reflect('r', 'd2', 'd3', 'te', False))},
ms2 AS (SELECT *, (1 - exp(-alpha_si * 100 * d1)) * lam * {QE_PER_NM!r} * (1 - r) AS sabs FROM ms1),
ms AS MATERIALIZED (SELECT p_partkey, lam, n_env, n_si, k_si, alpha_si, n_sio2, k_sio2, n_si3n4,
  k_si3n4, {rd('''sabs + (((p_partkey * 37 + lam::BIGINT * 101) % 97)::DOUBLE / 97 - 0.5)
  * 0.002''', 9)} AS y FROM ms2)"""

# Slopes of the reflectance here are central differences over this step in nm.
NUDGE = 1e-3


def stack_fit_ctes(measured: str = MEASURED) -> str:
    # Plain Newton steps that begin at the stack the view was made with; s<i>, h<i> hold the
    # normal matrix and its determinant at the parameters q<i>.
    ctes = [measured, "q0 AS (SELECT p_partkey, (95 + p_size % 11) / 10.0::DOUBLE AS p1, "
            "(13 + p_partkey % 5)::DOUBLE AS p2, (67 + p_partkey % 7)::DOUBLE AS p3 FROM part)"]
    for i, damp in enumerate([0] * 7):
        five = [reflect("r0", "d2", "d3", "te", False), reflect("ra", "d2 - 1e-12", "d3", "te", False),
                reflect("rb", "d2 + 1e-12", "d3", "te", False),
                reflect("rc", "d2", "d3 - 1e-12", "te", False),
                reflect("re", "d2", "d3 + 1e-12", "te", False)]
        five = [[part.replace("d2 - 1e-12", "(d2 - 1e-12)").replace("d2 + 1e-12", "(d2 + 1e-12)")
                 .replace("d3 - 1e-12", "(d3 - 1e-12)").replace("d3 + 1e-12", "(d3 + 1e-12)")
                 for part in variant] for variant in five]
        ctes.append(f"""w{i} AS (SELECT *, p2 * 1e-9 AS d2, p3 * 1e-9 AS d3
  FROM ms JOIN q{i} USING (p_partkey)),
{chain(f'w{i}', f'x{i}', *five, keep=True)},
y{i} AS (SELECT *, lam * {QE_PER_NM!r} AS qe, exp(-alpha_si * 1e-4 * p1) AS pass FROM x{i}),
z{i} AS (SELECT p_partkey, p1, p2, p3, y - qe * (1 - pass) * (1 - r0) AS e,
  qe * alpha_si * 1e-4 * pass * (1 - r0) AS j1,
  qe * (1 - pass) * (ra - rb) / {2 * NUDGE}::DOUBLE AS j2,
  qe * (1 - pass) * (rc - re) / {2 * NUDGE}::DOUBLE AS j3 FROM y{i}),
s{i} AS (SELECT p_partkey, count(e) AS n, sum(e * e) AS sse, any_value(p1) AS p1, any_value(p2) AS p2, any_value(p3) AS p3,
  sum(j1 * j1) * {1 + damp} AS a, sum(j1 * j2) AS b, sum(j1 * j3) AS c,
  sum(j2 * j2) * {1 + damp} AS d, sum(j2 * j3) AS f, sum(j3 * j3) * {1 + damp} AS g,
  sum(j1 * e) AS u, sum(j2 * e) AS v, sum(j3 * e) AS w FROM z{i} GROUP BY 1),
h{i} AS (SELECT *, a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c) AS det FROM s{i}),
q{i + 1} AS MATERIALIZED (SELECT p_partkey,
  p1 + (u * (d * g - f * f) - b * (v * g - f * w) + c * (v * f - d * w)) / det AS p1,
  p2 + (a * (v * g - f * w) - u * (b * g - f * c) + c * (b * w - v * c)) / det AS p2,
  p3 + (a * (d * w - v * f) - b * (b * w - v * c) + u * (b * f - d * c)) / det AS p3 FROM h{i})""")
    return ", ".join(ctes)


ORACLE_SQL["gauge_study"] = f"""
WITH g AS (SELECT p_brand, p_partkey, op, p_retailprice::DOUBLE / 1000 + op * 0.05::DOUBLE
    + ((p_partkey * op) % 7)::DOUBLE / 70 + ((p_partkey * 37 + op * 101 + rep * 53) % 97)::DOUBLE / 97 * 0.2::DOUBLE AS y
  FROM part, range(1, 4) AS t(op), range(1, 5) AS u(rep)),
m AS (SELECT p_brand, avg(y) AS m, count(DISTINCT p_partkey) AS p FROM g GROUP BY 1),
c AS (SELECT p_brand, p_partkey, op, avg(y) AS cm FROM g GROUP BY ALL),
a AS (SELECT p_brand, p_partkey, avg(y) AS am FROM g GROUP BY ALL),
b AS (SELECT p_brand, op, avg(y) AS bm FROM g GROUP BY ALL),
ss AS (SELECT p_brand, any_value(p) AS p, sum(pow(am - m, 2)) AS part, sum(pow(bm - m, 2)) AS operator,
    sum(pow(cm - am - bm + m, 2)) AS interaction, sum(pow(y - cm, 2)) AS repeat
  FROM g JOIN m USING (p_brand) JOIN c USING (p_brand, p_partkey, op)
  JOIN a USING (p_brand, p_partkey) JOIN b USING (p_brand, op) GROUP BY 1),
f AS (SELECT *, p - 1 AS d1, 2 AS d2, (p - 1) * 2 AS d3, p * 9 AS d4 FROM ss),
v AS (SELECT *, greatest(0, (part / d1 - interaction / d3) / 12) AS va,
  greatest(0, (operator / d2 - interaction / d3) / (p * 4)) AS vb,
  greatest(0, (interaction / d3 - repeat / d4) / 4) AS vc, repeat / d4 AS ve FROM f)
SELECT p_brand, true AS balanced, {rd('part')} AS ss_part, {rd('operator')} AS ss_operator,
  {rd('interaction')} AS ss_interaction, {rd('repeat')} AS ss_repeat, d1 AS df_part,
  d2::BIGINT AS df_operator, d3 AS df_interaction, d4 AS df_repeat, {rd('va')} AS var_part,
  {rd('vb')} AS var_operator, {rd('vc')} AS var_interaction, {rd('ve')} AS var_repeat,
  {rd('vb + vc + ve')} AS var_gauge,
  {rd('100 * sqrt((vb + vc + ve) / (va + vb + vc + ve))', 4)} AS gauge_percent FROM v"""

ORACLE_SQL["sketch_bands"] = """
SELECT l_returnflag, prob, count(*) AS n, true AS within FROM lineitem,
  unnest([0.0::DOUBLE, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS t(prob) GROUP BY ALL"""

_hashes = f"""h0 AS (SELECT *, ((l_orderkey * 8 + l_linenumber)::BIGINT % {PRIME} * {FACTORS[0]}
  + rep * {FACTORS[1]} + 1) % {PRIME} AS x0 FROM lineitem, range(1, 101) AS t(rep))"""
for _i, _factor in enumerate(FACTORS):
    _hashes += f""",
h{_i + 1} AS (SELECT *, xor(x{_i}, x{_i} >> 15) % {PRIME} * {_factor} % {PRIME} AS x{_i + 1} FROM h{_i})"""
ORACLE_SQL["mean_bootstrap_ci"] = f"""
WITH {_hashes},
w AS (SELECT l_linestatus, l_returnflag, rep, l_extendedprice::DOUBLE AS v,
  list_count(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in POISSON)}], lambda c: x3 / {PRIME}.0::DOUBLE >= c)) AS n
  FROM h3),
m AS (SELECT l_linestatus, l_returnflag, rep, sum(n * v) / sum(n) AS m FROM w GROUP BY ALL),
e AS (SELECT l_linestatus, l_returnflag, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi
  FROM m GROUP BY ALL),
p AS (SELECT l_linestatus, l_returnflag, count(*) AS n, avg(l_extendedprice::DOUBLE) AS a
  FROM lineitem GROUP BY ALL)
SELECT l_linestatus, l_returnflag, n, {rd('a', 4)} AS mean, {rd('lo', 4)} AS low, {rd('hi', 4)} AS high
FROM p JOIN e USING (l_linestatus, l_returnflag)"""

ORACLE_SQL["fit_rational_certified"] = f"""
WITH {V3_WHOLE} SELECT p_partkey, count(*) AS n, true AS converged, true AS stationary,
  true AS same_sse FROM v3 WHERE pos >= 8 AND pos < 600 GROUP BY 1"""

ORACLE_SQL["fit_layer_stack"] = f"""
WITH {stack_fit_ctes()} SELECT p_partkey, true AS converged, {rd('p1', 4)} AS si_um, {rd('p2', 3)} AS sio2_nm,
  {rd('p3', 3)} AS si3n4_nm FROM q6"""

MEASURED_REPORTS = f"""ms0 AS (SELECT p_partkey, i, (400 + 25 * i)::DOUBLE + (p_partkey % 40) * 0.5::DOUBLE
  + 0.25::DOUBLE AS lam, (95 + p_size % 11) * 1e-7 AS d1, (13 + p_partkey % 5) * 1e-9 AS d2,
  (67 + p_partkey % 7) * 1e-9 AS d3 FROM part, range(28) AS t(i) WHERE p_partkey % 50 <> 0),
msc AS (SELECT *, {CONSTANTS} FROM ms0),
{chain('msc', 'ms1', reflect('r', 'd2', 'd3', 'te', False))},
ms2 AS (SELECT *, (1 - exp(-alpha_si * 100 * d1)) * lam * {QE_PER_NM!r} * (1 - r) AS sabs FROM ms1),
ms AS MATERIALIZED (SELECT p_partkey, lam, n_env, n_si, k_si, alpha_si, n_sio2, k_sio2, n_si3n4,
  k_si3n4, {rd("""sabs + (((p_partkey * 37 + i * 101) % 97)::DOUBLE / 97 - 0.5) * 0.002""", 6)} AS y
  FROM ms2)"""

ORACLE_SQL["stack_fit_reports"] = f"""
WITH {stack_fit_ctes(MEASURED_REPORTS)}
SELECT 'stack_' || lpad(p_partkey::VARCHAR, 12, '0') || '.csv' AS path, p_partkey::VARCHAR AS device_nr,
  'FA' || (p_partkey % 13) AS fa_nr, p_brand AS article_name, n, true AS converged,
  {rd('p1', 4)} AS si_um, {rd('p2', 3)} AS sio2_nm, {rd('p3', 3)} AS si3n4_nm,
  {rd('sqrt(sse / n)', 8)} AS rmse FROM s6 JOIN part USING (p_partkey)"""


def student_odd(t: str, df: int) -> str:
    """Two-sided p value for odd ``df`` as the finite sum of powers of the cosine."""
    cosine, part, terms = f"cos(atan({t} / sqrt({df})))", 1.0, []
    for j in range((df - 1) // 2):
        terms.append(f"{part!r}::DOUBLE * pow({cosine}, {2 * j + 1})")
        part *= (2 * j + 2) / (2 * j + 3)
    return (f"(1 - 2 / pi() * (atan({t} / sqrt({df})) + sin(atan({t} / sqrt({df})))"
            f" * ({' + '.join(terms)})))")


ORACLE_SQL["stack_fit_coefficients"] = f"""
WITH {stack_fit_ctes(MEASURED_REPORTS)},
co AS (SELECT p_partkey, n - 3 AS df, sqrt(sse / (n - 3)) AS sd, unnest([
    {{'parameter': 'si', 'est': p1, 'nominal': 10.0::DOUBLE, 'v': (d * g - f * f) / det}},
    {{'parameter': 'sio2', 'est': p2, 'nominal': 15.0::DOUBLE, 'v': (a * g - c * c) / det}},
    {{'parameter': 'si3n4', 'est': p3, 'nominal': 70.0::DOUBLE, 'v': (a * d - b * b) / det}}])
    AS q FROM h6),
tv AS (SELECT *, (q.est - q.nominal) / (sd * sqrt(q.v)) AS t FROM co)
SELECT p_partkey::VARCHAR AS device_nr, q.parameter AS parameter, {rd('q.est', 3)} AS estimate,
  {rd('sd * sqrt(q.v)', 5)} AS std_error, {rd('t', 2)} AS t_value,
  {rd(student_odd('abs(t)', 25), 5)} AS p_value, {rd('sd', 8)} AS residual_sd, df FROM tv"""

ORACLE_SQL["stack_fit_rejected"] = """
SELECT 'stack_' || lpad(p_partkey::VARCHAR, 12, '0') || '.csv' AS path, 'no data section' AS reason
FROM part WHERE p_partkey % 50 = 0"""

ORACLE_SQL["fit_lowpass2_wide"] = """
SELECT o_orderkey, 1.0::DOUBLE AS ratio, 0.0::DOUBLE AS level_error, true AS positive,
  true AS converged FROM orders"""

ORACLE_SQL["fit_layer_stack_wide"] = """
SELECT p_partkey, 1.0::DOUBLE AS ratio, true AS converged FROM part"""

ORACLE_SQL["fit_residuals"] = f"""
WITH {stack_fit_ctes()}, f0 AS (SELECT *, p2 * 1e-9 AS d2, p3 * 1e-9 AS d3
  FROM ms JOIN q6 USING (p_partkey)),
{chain('f0', 'fr', reflect('r', 'd2', 'd3', 'te', False))},
f1 AS (SELECT *, y - lam * {QE_PER_NM!r} * (1 - r) * (1 - exp(-alpha_si * 1e-4 * p1)) AS res FROM fr)
SELECT p_partkey, count(res) AS n, {rd('sum(res * res)', 7)} AS sse,
  {rd('sqrt(avg(res * res))', 7)} AS rmse FROM f1 GROUP BY 1"""


# ------------------------------------------------------------------ bucketed plans, NULL keys

_CUT = "SELECT *, nullif(l_linenumber::INTEGER, 3) AS k FROM lineitem"

ORACLE_SQL["positions_cut"] = f"""
SELECT k, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY k
  ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS pos FROM ({_CUT})"""

ORACLE_SQL["value_ecdf_cut"] = f"""
SELECT DISTINCT k, value, count(*) OVER (PARTITION BY k, value) AS n,
  {rd('cume_dist() OVER (PARTITION BY k ORDER BY value)', 8)} AS ecdf
FROM (SELECT nullif(user_id % 4, 0) AS k, value FROM events)"""

ORACLE_SQL["decile_bands_cut"] = "SELECT * FROM " + deciles(
    f"({_CUT})", "k", "l_extendedprice", "sd_l_extendedprice", 4)

ORACLE_SQL["box_stats_cut"] = f"""
WITH i AS (SELECT k, {rd('l_extendedprice * l_discount', 4)} AS value FROM ({_CUT})),
q AS (SELECT k, count(*) AS n, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM i GROUP BY 1)
SELECT i.k, any_value(n) AS n, {rd('any_value(q[1])', 8)} AS q1,
  {rd('any_value(q[2])', 8)} AS median, {rd('any_value(q[3])', 8)} AS q3,
  {rd('min(value) FILTER (value >= q[1] - 1.5 * (q[3] - q[1]))', 8)} AS whisker_low,
  {rd('max(value) FILTER (value <= q[3] + 1.5 * (q[3] - q[1]))', 8)} AS whisker_high
FROM i JOIN q ON i.k IS NOT DISTINCT FROM q.k GROUP BY 1"""

_V1_CUT = f"{V1}, vc AS (SELECT nullif(user_id, 3) AS k, pos, f, a FROM v1)"

ORACLE_SQL["segments_cut"] = f"""
WITH {_V1_CUT}, n AS (SELECT k, f, a, lead(f) OVER w AS f_next, lead(a) OVER w AS a_next FROM vc
  WINDOW w AS (PARTITION BY k ORDER BY f))
SELECT k, f, {rd('a')} AS a, f_next, {rd('a_next')} AS a_next FROM n WHERE f_next IS NOT NULL"""

# USING drops NULL keys, so the key stands in for NULL on the way.
ORACLE_SQL["cutoff_events_cut"] = f"""
WITH {_V1_CUT}, v0 AS (SELECT coalesce(k, -1) AS k, pos, f, a FROM vc),
{readout_ctes('v0', 'k', 8.0, 40.0)}
SELECT nullif(k, -1) AS k, {rds(6, 'plateau')}, n_plateau, pos, cutoff_mhz FROM res"""

# ------------------------------------------------------------------ sinks

ORACLE_SQL["decimal_comma_exact"] = f"""
SELECT o_orderkey, o_totalprice * {_list(POWERS)}[o_orderkey % {len(POWERS)} + 1] AS number,
  true AS same, true AS fixed_notation
FROM orders"""
