"""Queries of the operators for raw measurement data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import packed, regrid, rejects, spikes, units
from tidemark.sources.tables import table

ANGLES = {"strike": 360, "dip": 90}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Series that are not in millimetres, with the length of their unit in micrometres."""
    u = units.series_units(table(spark, d, "obs"), table(spark, d, "series"))
    return u.select("series_id", F.round("um_per_unit").cast("bigint").alias("um_per_unit")).filter("um_per_unit <> 1000").distinct()


def p1_millimetres(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with data in mm, variances and covariances in mm²."""
    obs = table(spark, d, "obs")
    u = units.series_units(obs, table(spark, d, "series"))
    return units.to_millimetres(obs.select("obs_id", "series_id", "t", *units.DATA, *units.VARS, *units.COVS), u)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rejected data lines with their reason."""
    return rejects.load_lines(table(spark, d, "location_lines"))[1].select("line_id", "reason").distinct()


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The good lines as typed rows."""
    return rejects.load_lines(table(spark, d, "location_lines"))[0]


def p2_decided(spark: SparkSession, d: str) -> DataFrame:
    """How many lines the reader decided and how many the exact check behind it."""
    return rejects.decided(table(spark, d, "location_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Empty periods of each series."""
    grid = regrid.regular_grid(table(spark, d, "obs"), table(spark, d, "series"))
    return grid.filter("empty").select("series_id", "slot")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular grid, one row per series, period and data column."""
    series = table(spark, d, "series")
    return regrid.long_grid(regrid.regular_grid(table(spark, d, "obs"), series), series)


def p3_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How well hidden readings are filled, by sampling interval and column."""
    return regrid.held_out(table(spark, d, "obs"), table(spark, d, "series"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Angles of nodal planes, one row each."""
    got = packed.unpack(table(spark, d, "catalog_eq"), "eq_id", ANGLES)
    return got.filter("degrees is not null").select("eq_id", "field_name", "pos", "degrees").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Faulty readings."""
    return spikes.implausible(table(spark, d, "obs"), table(spark, d, "series")).select("obs_id", "col_name").distinct()


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Faulty readings with the reason."""
    return spikes.implausible(table(spark, d, "obs"), table(spark, d, "series"))


QUERIES = {f.__name__: f for f in (p1_found, p1_millimetres, p2_found, p2_rows, p2_decided, p3_found, p3_grid, p3_held_out, p4_found, p5_found, p5_reasons)}

# --- the same in DuckDB ---


def _unit_sql(text: str, name: str) -> str:
    """The size in micrometres of the unit that `text` as a whole states."""
    whole = units._WHOLE.replace("'", "''")
    g = lambda i: f"regexp_extract({name}_t, '{whole}', {i})"
    number = f"(case when {g(1)} = '' then 1.0 when starts_with({g(1)}, '10^') then pow(10.0, cast(substr({g(1)}, 4) as double)) when contains({g(1)}, '/') then cast(split_part({g(1)}, '/', 1) as double) / cast(split_part({g(1)}, '/', 2) as double) else cast({g(1)} as double) end)"
    size = " ".join(f"when '{a}' then {um}::double" for a, um in units.ALIASES.items())
    return f"(case when regexp_matches({name}_t, '{whole}') then (case {g(2)} {size} end) * {number} * pow(10.0, coalesce(try_cast({g(3)} as double), 0.0)) / coalesce(try_cast({g(4)} as double), 1.0) end) as {name}"


def _fold_sql(text: str) -> str:
    t = f"translate(lower({text}), 'µμèéêàâ', 'uueeeaa')"
    for words, number in units.FRACTIONS.items():
        t = f"replace({t}, '{words} ', '{number}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _strip_sql(text: str) -> str:
    return f"coalesce(trim(regexp_replace({_fold_sql(text)}, '^[\\s\\[(]+|[\\s\\]).]+$', '', 'g')), '')"


_STATED = units._STATED.replace("'", "''")
_UNITS = f"""ep as (select series_id, floor(epoch_us(t) / 1000000.0)::bigint as sec, arg_min(east, obs_id) as x from obs
  where east is not null and not isnan(east) and series_id is not null and t is not null group by 1, 2),
dl as (select series_id, abs(x - lag(x) over (partition by series_id order by sec)) as d from ep),
sc as (select series_id, quantile_disc(d, 0.5) / 0.6744897501960817 as delta from dl where d is not null group by series_id),
s0 as (select series_id, any_value(src) as src, any_value(data_unit) as data_unit, any_value(notes) as notes from series where series_id is not null group by series_id),
s1 as (select *, {_strip_sql(f"regexp_extract({_fold_sql("coalesce(notes, '')")}, '{_STATED}', 1)")} as notes_um_t, {_strip_sql('data_unit')} as field_um_t from s0),
s2 as (select series_id, src, {_unit_sql('notes_um_t', 'notes_um')}, {_unit_sql('field_um_t', 'field_um')} from s1),
s3 as (select s2.*, delta, coalesce(delta > 0, false) as has, coalesce(delta * notes_um / {units.TYPICAL_UM} between {1 / units.DECADE} and {units.DECADE}, false) as fit_n,
  coalesce(delta * field_um / {units.TYPICAL_UM} between {1 / units.DECADE} and {units.DECADE}, false) as fit_f from s2 left join sc using (series_id)),
s4 as (select *, case when has and fit_n then notes_um when has and fit_f then field_um when has then list_min([{{'o': abs(log10(delta * um / {units.TYPICAL_UM})), 'u': um}} for um in [1e3, 1e4, 1e6, 1.0]]).u else coalesce(notes_um, field_um) end as said from s3),
us as (select src, arg_max(said, {{'n': n, 'm': -said}}) as source_um from (select src, said, count(*) as n from s4 where said is not null and src is not null group by all) group by src),
un as (select series_id, coalesce(said, source_um, 1e3)::double as um from s4 left join us using (src))"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^ \t"]+)'
_PART = r'("(?:[^"]|"")*"|[^ \t"]+)'
_LINES = rf"""l as (select line_id, file_name, line_no, trim(coalesce(raw_line, ''), e' \t\r\n') as s from location_lines),
k as (select *, regexp_replace(s, '^[\s\p{{Z}}\x{{00}}-\x{{1f}}\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{2060}}-\x{{2064}}\x{{feff}}]+', '') as seen from l),
f as (select *, regexp_full_match(s, '{_FIELD}(?:[ \t]+{_FIELD})*') as quoted_well, regexp_extract(s, '^{_PART}[ \t]+{_PART}[ \t]+{_PART}[ \t]+{_PART}$', ['name', 'lat', 'lon', 'alt']) as g from k where seen <> '' and seen[1] <> '#'),
u as (select *, case when name is null then null when name[1] = '"' then replace(name[2:-2], '""', '"') else name end as name_u, {', '.join(f"case when {c}[1] = '\"' then replace({c}[2:-2], '\"\"', '\"') else {c} end as {c}_u" for c in ('lat', 'lon', 'alt'))}
  from (select line_id, file_name, line_no, quoted_well, nullif(g.name, '') as name, g.lat as lat, g.lon as lon, g.alt as alt from f)),
v as (select *, {' and '.join(f"regexp_full_match({c}_u, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') and coalesce(try_cast({c}_u as double) between {a} and {b}, false)" for c, (a, b) in rejects.BOUNDS.items())} as fine from u),
j as (select *, case when not quoted_well then 'quote' when name is null then 'columns' when not fine then 'value' end as reason from v),
h as (select file_name, min(line_no) as first_no from j where reason is null group by file_name)"""


def _course_sql(c: str) -> str:
    """Deviation, distance from the course and runs of one column, in steps over its epochs."""
    k = spikes.COURSE
    side = lambda a, b: f"case when count(x) over (partition by series_id order by sec rows between {a} and {b}) >= {spikes.BOTH_SIDES} then median(x) over (partition by series_id order by sec rows between {a} and {b}) end"
    before = side(f"{k} preceding", "1 preceding")
    afters = ", ".join(f"{side(f'{n} following', f'{n + k - 1} following')} as a{n}" for n in range(1, spikes.LONGEST + 1))
    nexts = ", ".join(f"lead(x, {n}) over w as x{n}" for n in range(1, spikes.LONGEST))
    lows = lambda n: [f"x{j}" if j else "x" for j in range(n)]
    up = lambda n: f"least({', '.join(f'{v} - greatest(b, a{n})' for v in lows(n))})"
    down = lambda n: f"least({', '.join(f'least(b, a{n}) - {v}' for v in lows(n))})"
    whole = lambda n: " and ".join([*(f"{v} is not null" for v in lows(n)), "b is not null", f"a{n} is not null"])
    sizes = ", ".join(f"case when {whole(n)} then case when {up(n)} > 0 then {up(n)} when {down(n)} > 0 then -{down(n)} end end as z{n}" for n in range(1, spikes.LONGEST + 1))
    best = [f"lag(z{n}, {j}) over w" if j else f"z{n}" for n in range(1, spikes.LONGEST + 1) for j in range(n)]
    return f"""
e_{c} as (select series_id, sec, arg_min({c}, coalesce(obs_id, 4611686018427387904)) as x from obs where {c} is not null and not isnan({c}) and series_id is not null and t is not null group by series_id, sec),
c_{c} as (select *, {before} as b, {afters}, {nexts} from e_{c} window w as (partition by series_id order by sec)),
z_{c} as (select *, x - (b + a1) / 2 as off, {sizes} from c_{c}),
d_{c} as (select series_id, sec, x, off, (select max_by(v, abs(v)) from (select unnest([{', '.join(f'q{i}' for i in range(len(best)))}]) as v)) as dev
  from (select *, {', '.join(f'{b} as q{i}' for i, b in enumerate(best))} from z_{c} window w as (partition by series_id order by sec))),
r_{c} as (select series_id, sec, count(*) over (partition by series_id, run) >= {spikes.STUCK} as stuck from (select *, sum(fresh) over (partition by series_id order by sec) as run from (select *, case when x = lag(x) over (partition by series_id order by sec) then 0 else 1 end as fresh from e_{c}))),
g_{c} as (select series_id, quantile_disc(off, 0.25) as q1, quantile_disc(off, 0.75) as q3 from d_{c} where off is not null group by series_id),
h_{c} as (select series_id, sec % 86400 * {spikes.CONTEXTS} // 86400 as hour, count(off) as n, quantile_disc(off, 0.25) as q1, quantile_disc(off, 0.75) as q3 from d_{c} where off is not null group by 1, 2),
l_{c} as (select h.series_id, h.hour, n / (n + {spikes.LEAN}) * h.q1 + (1 - n / (n + {spikes.LEAN})) * g.q1 as q1, n / (n + {spikes.LEAN}) * h.q3 + (1 - n / (n + {spikes.LEAN})) * g.q3 as q3 from h_{c} h join g_{c} g using (series_id)),
f_{c} as (select series_id, sec, x, coalesce(dev > q3 + {spikes.FENCE_IQR} * (q3 - q1) or dev < q1 - {spikes.FENCE_IQR} * (q3 - q1), false) and coalesce(q3 > q1, false) as spike, stuck
  from d_{c} join r_{c} using (series_id, sec) left join l_{c} on l_{c}.series_id = d_{c}.series_id and l_{c}.hour = d_{c}.sec % 86400 * {spikes.CONTEXTS} // 86400)"""


#: DuckDB equivalents. The others are tested against brute force (tests/test_data_quality.py).
SQL = {
    "p1_found": f"with {_UNITS} select series_id, cast(round(um) as bigint) as um_per_unit from un where round(um) <> 1000",
    "p1_millimetres": f"with {_UNITS} select obs_id, o.series_id, t, "
    + ", ".join(f"case when not isnan({c}) then {c} end * coalesce(um / 1000.0, 1.0) + 0.0 as {c}" for c in units.DATA)
    + ", "
    + ", ".join(f"case when not isnan({c}) then {c} end * (coalesce(um / 1000.0, 1.0) * coalesce(um / 1000.0, 1.0)) as {c}" for c in (*units.VARS, *units.COVS))
    + ", um as um_per_unit from obs o left join un using (series_id)",
    "p2_found": f"with {_LINES} select distinct line_id, reason from j join h on j.file_name is not distinct from h.file_name where line_no > first_no and reason is not null",
    "p2_rows": f"with {_LINES} select line_id, file_name, line_no, name_u as name, cast(lat_u as double) as lat, cast(lon_u as double) as lon, cast(alt_u as double) as alt from j where reason is null",
    "p3_found": """
with own as (
  select series_id, any_value(step_s)::bigint as step_s, any_value(',' || replace(data_cols, ' ', '') || ',') as cols
  from series where step_s > 0 group by series_id),
r as (
  select distinct o.series_id, floor(epoch_us(o.t) / 1000000.0 / w.step_s)::bigint as slot
  from obs o join own w using (series_id)
  where (w.cols like '%,east,%' and o.east is not null and not isnan(o.east))
     or (w.cols like '%,north,%' and o.north is not null and not isnan(o.north))
     or (w.cols like '%,up,%' and o.up is not null and not isnan(o.up))),
span as (select series_id, min(slot) as a, max(slot) as b from r group by series_id),
every as (select series_id, unnest(generate_series(a, b)) as slot from span)
select e.series_id, e.slot from every e anti join r on r.series_id = e.series_id and r.slot = e.slot""",
}
_COLS = "(select series_id, any_value(',' || replace(coalesce(data_cols, ''), ' ', '') || ',') as dc, any_value(',' || replace(coalesce(var_cols, ''), ' ', '') || ',') as vc from series where series_id is not null group by series_id)"
_OBS_SEC = "(select *, floor(epoch_us(t) / 1000000.0)::bigint as sec from obs)"
_FAULTS = " union ".join(
    [f"select o.obs_id, o.series_id, '{c}' as col_name, '{why}' as reason from {_OBS_SEC} o join f_{c} f using (series_id, sec) join {_COLS} s using (series_id) where o.obs_id is not null and contains(dc, ',{c},') and o.{c} = f.x and f.{why}" for c in spikes.DATA for why in ("spike", "stuck")]
    + [f"select obs_id, o.series_id, '{c}', 'limit' from obs o join un using (series_id) join {_COLS} s using (series_id) where obs_id is not null and contains(dc, ',{c},') and not isnan({c}) and abs({c}) >= {spikes.LIMIT_UM} / um" for c in spikes.DATA]
    + [f"select obs_id, o.series_id, '{c}', 'variance' from obs o join (select series_id, quantile_disc({c}, 0.5) filter (where not isnan({c})) as med from obs group by series_id) m using (series_id) join {_COLS} s using (series_id) where obs_id is not null and contains(vc, ',{c},') and not isnan({c}) and ({c} <= 0 or {c} > {spikes.VAR_RATIO} * med)" for c in spikes.VARS]
)
SQL["p5_reasons"] = f"with {_UNITS}, {', '.join(_course_sql(c).replace('from obs where', f'from {_OBS_SEC} where') for c in spikes.DATA)} {_FAULTS}"
SQL["p5_found"] = f"select distinct obs_id, col_name from ({SQL['p5_reasons']})"
# a plain rule: labels, quotes and wrappers go, the separators become one, and what is left is counted
_TIDY = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(v, e' \r\n\t'), '["''\[\]\(\)\{\}<>°º]', '', 'g')), '[A-Za-z]+[0-9]+\s*[:=]\s*', e'\x01', 'g'), '^\s*\x01', ''), '\s*[;,|/&]?\s*\x01', ';', 'g')"""
_ANGLES = " union all ".join(f"select eq_id, '{f}' as field_name, {f} as v, {most} as most from catalog_eq where {f} is not null" for f, most in ANGLES.items())
SQL["p4_found"] = rf"""with f as ({_ANGLES}), t as (select *, {_TIDY} as s from f),
u as (select *, case when regexp_matches(s, '[;,|/&\t\n]|\bor\b|\band\b') then regexp_split_to_array(s, '[;,|/&\t\n]|\bor\b|\band\b') when regexp_matches(s, '[0-9.]\s*[-‒–—―−]\s*[0-9]') then regexp_split_to_array(s, '[-‒–—―−]') else regexp_split_to_array(s, ' +') end as p from t),
w as (select eq_id, field_name, most, unnest(p) as x, generate_subscripts(p, 1) as pos from u)
select distinct eq_id, field_name, cast(pos as integer) as pos, cast(floor(cast(trim(x) as double)) as integer) as degrees from w where regexp_full_match(trim(x), '0*[0-9]{{1,9}}(?:\.0*)?') and cast(trim(x) as double) <= most"""
