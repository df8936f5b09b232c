"""Queries of the information-dynamics operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewire.functions import bijection
from tidewire.functions.scalar import equal_width, max_entropy, psi, radix, standardise
from tidewire.operators import discrete, gaussian, knn, permutation, significance
from tidewire.operators.embedding import column, lag_embed, realisations
from tidewire.plans import comparison, history, inference, pid, results, subgraphs
from tidewire.sources import generators, views
from tidewire.sources.series import TimeSeries, spike_trains
from tidewire.streaming.raster import binned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS, SEED, PERMS = 8, 11, 40


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, without a negative zero."""
    return df.select(*((F.round(f.name, DIGITS) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL where there is some."""

    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


#: Cases whose right answer is known, over made series: tests, not queries, as they read none of the tables.
KNOWN: dict[str, Query] = {}
KNOWN_SQL: dict[str, str] = {}


def known(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a case for the tests."""

    def keep(f: Query) -> Query:
        KNOWN[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            KNOWN_SQL[name] = sql
        return f

    return keep


# ---- series ---------------------------------------------------------------------------------

_EVENTS = """
types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS proc FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT proc, user_id, event_id, epoch_us(ts) AS us, value FROM events JOIN types USING (event_type))"""
_HOURLY = f"""{_EVENTS},
found AS (SELECT proc, CAST(us // 3600000000 - (SELECT min(us) // 3600000000 FROM ev) AS INTEGER) AS sample, sum(value) AS value FROM ev GROUP BY ALL),
grid AS (SELECT proc, CAST(s AS INTEGER) AS sample FROM types, unnest(range(0, (SELECT max(sample) + 1 FROM found))) t(s)),
series AS (SELECT grid.proc, 0 AS repl, grid.sample, coalesce(found.value, 0.0) AS value FROM grid LEFT JOIN found USING (proc, sample))"""
_DAILY = f"""{_EVENTS},
found AS (
    SELECT proc, CAST(us // 86400000000 - (SELECT min(us) // 86400000000 FROM ev) AS INTEGER) AS repl, CAST((us // 3600000000) % 24 AS INTEGER) AS sample, sum(value) AS value
    FROM ev GROUP BY ALL
),
grid AS (SELECT proc, CAST(r AS INTEGER) AS repl, CAST(s AS INTEGER) AS sample FROM types, unnest(range(0, (SELECT max(repl) + 1 FROM found))) u(r), unnest(range(0, 24)) t(s)),
series AS (SELECT grid.proc, grid.repl, grid.sample, coalesce(found.value, 0.0) AS value FROM grid LEFT JOIN found USING (proc, repl, sample))"""
_BINS = """,
ends AS (SELECT proc, min(value) AS low, max(value) AS high FROM series GROUP BY proc),
bins AS (SELECT proc, repl, sample, CAST(least(floor((value - low) / ((high - low) / 3.0)), 2) AS INTEGER) AS value FROM series JOIN ends USING (proc))"""
_BINNED = _HOURLY + _BINS


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hourly_series(spark, sf_dir)


def hourly_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_width(hourly(spark, sf_dir), 3)


@query("hourly_series", f"WITH {_HOURLY} SELECT proc, repl, sample, round(value, 8) + 0.0 AS value FROM series")
def _(spark, sf_dir):
    return hourly(spark, sf_dir)


@query("daily_series", f"WITH {_DAILY} SELECT proc, repl, sample, round(value, 8) + 0.0 AS value FROM series")
def _(spark, sf_dir):
    return views.daily_series(spark, sf_dir)


@query("series_slice", f"WITH {_HOURLY} SELECT proc, repl, sample, round(value, 8) + 0.0 AS value FROM series WHERE proc = 2 AND sample >= 10")
def _(spark, sf_dir):
    return TimeSeries(hourly(spark, sf_dir)).slice(2, 10)


@query("spike_trains", f"WITH {_EVENTS} SELECT proc, round(us / 1e6 - min(us / 1e6) OVER (PARTITION BY proc), 5) + 0.0 AS t FROM ev")
def _(spark, sf_dir):
    return spike_trains(views.event_spikes(spark, sf_dir)).withColumn("t", F.round("t", 5))


@query("stream_bins", "SELECT event_type AS process, time_bucket(INTERVAL 6 HOUR, ts) AS begin, round(sum(value), 8) + 0.0 AS value, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return binned(spark.read.parquet(f"{sf_dir}/events.parquet"), "6 hours").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


# ---- scalar transforms ----------------------------------------------------------------------


@query("standardise", f"WITH {_HOURLY} SELECT proc, repl, sample, round((value - avg(value) OVER (PARTITION BY proc)) / stddev_samp(value) OVER (PARTITION BY proc), 8) + 0.0 AS value FROM series")
def _(spark, sf_dir):
    return standardise(hourly(spark, sf_dir))


@query("bins_equal_width", f"WITH {_BINNED} SELECT * FROM bins")
def _(spark, sf_dir):
    return hourly_bins(spark, sf_dir)


@query(
    "bins_max_entropy",
    f"""WITH {_HOURLY},
    r AS (SELECT *, row_number() OVER (PARTITION BY proc ORDER BY value) AS k, count(*) OVER (PARTITION BY proc) AS n FROM series),
    c AS (SELECT proc, value AS cut FROM r WHERE k IN (CAST(floor(n / 3.0) AS BIGINT), CAST(floor(2 * n / 3.0) AS BIGINT)))
    SELECT s.proc, s.repl, s.sample, CAST((SELECT count(*) FROM c WHERE c.proc = s.proc AND c.cut < s.value) AS INTEGER) AS value FROM series s""",
)
def _(spark, sf_dir):
    return max_entropy(hourly(spark, sf_dir), 3)


@query("radix_codes", f"WITH {_BINNED} SELECT sample, CAST(sum(value * CAST(pow(3, 4 - proc) AS BIGINT)) AS BIGINT) AS code FROM bins GROUP BY sample")
def _(spark, sf_dir):
    wide = lag_embed(hourly_bins(spark, sf_dir), [(p, 0) for p in range(5)], 0)
    return wide.select("sample", radix([column((p, 0)) for p in range(5)], 3).alias("code"))


def _lagged(variables: list[tuple[int, int]], most: int, table: str = "series") -> str:
    """SELECT of the embedding in SQL."""
    joins = " ".join(f"JOIN {table} t{k} ON t{k}.proc = {p} AND t{k}.repl = b.repl AND t{k}.sample = b.sample - {lag}" for k, (p, lag) in enumerate(variables))
    columns = ", ".join(f"round(t{k}.value, 8) + 0.0 AS {column(v)}" if table == "series" else f"t{k}.value AS {column(v)}" for k, v in enumerate(variables))
    return f"SELECT b.repl, b.sample, {columns} FROM (SELECT DISTINCT repl, sample FROM {table} WHERE sample >= {most}) b {joins}"


_VARS = [(0, 0), (0, 1), (1, 2), (3, 1)]


@query("lag_embedding", f"WITH {_DAILY} {_lagged(_VARS, 3)}")
def _(spark, sf_dir):
    return lag_embed(views.daily_series(spark, sf_dir), _VARS, 3)


@query("realisations", f"WITH {_DAILY} {_lagged([(2, 5), (4, 0)], 5)}")
def _(spark, sf_dir):
    return realisations(views.daily_series(spark, sf_dir), 5, [(2, 0), (4, 5)])


# ---- discrete estimators --------------------------------------------------------------------

_PAIRS = """,
pairs AS (
    SELECT x.proc AS source, y.proc AS target, l.lag, x.value AS x, y.value AS y, w.value AS w, y.repl, y.sample
    FROM bins y JOIN bins w ON w.proc = y.proc AND w.repl = y.repl AND w.sample = y.sample - 1
    JOIN (VALUES (1), (2), (3)) l(lag) ON true JOIN bins x ON x.repl = y.repl AND x.sample = y.sample - l.lag AND x.proc <> y.proc
)"""
_LAGS = (1, 2, 3)


def _cmi_sql(keys: str, x: str, y: str, z: str, source: str, name: str) -> str:
    """Plug-in information of ``source``'s columns per ``keys``, in SQL."""
    k = f"{keys}, " if keys else ""
    part = lambda *c: "OVER (PARTITION BY " + ", ".join(v for v in (keys, *c) if v) + ")" if keys or any(c) else "OVER ()"
    zs = f", {z}" if z else ""
    return f"""
    SELECT {k}sum(CAST(n AS DOUBLE) / tot * log2(CAST(n AS DOUBLE) * nz / (CAST(nxz AS DOUBLE) * nyz))) AS {name} FROM (
        SELECT {k}n, sum(n) {part()} AS tot, sum(n) {part(z)} AS nz, sum(n) {part(x, z)} AS nxz, sum(n) {part(y, z)} AS nyz
        FROM (SELECT {k}{x}, {y}{zs}, count(*) AS n FROM {source} GROUP BY ALL)
    ) {f"GROUP BY {keys}" if keys else ""}"""


@query("discrete_te_pairs", f"WITH {_BINNED}{_PAIRS}, r AS ({_cmi_sql('source, target, lag', 'x', 'y', 'w', 'pairs', 'te')}) SELECT source, target, lag, round(te, 8) + 0.0 AS te FROM r")
def _(spark, sf_dir):
    return discrete.te_pairs(hourly_bins(spark, sf_dir), _LAGS)


@query("discrete_mi_pairs", f"WITH {_BINNED}{_PAIRS}, r AS ({_cmi_sql('source, target, lag', 'x', 'y', '', 'pairs', 'mi')}) SELECT source, target, lag, round(mi, 8) + 0.0 AS mi FROM r")
def _(spark, sf_dir):
    return discrete.mi_pairs(hourly_bins(spark, sf_dir), _LAGS)


@query(
    "discrete_ais",
    f"""WITH {_BINNED},
    h AS (SELECT y.proc, y.value AS y, a.value * 3 + b.value AS h FROM bins y JOIN bins a ON a.proc = y.proc AND a.sample = y.sample - 1 JOIN bins b ON b.proc = y.proc AND b.sample = y.sample - 2),
    r AS ({_cmi_sql('proc', 'h', 'y', '', 'h', 'ais')}) SELECT proc, round(ais, 8) + 0.0 AS ais FROM r""",
)
def _(spark, sf_dir):
    return discrete.ais(hourly_bins(spark, sf_dir), 2)


@query(
    "discrete_local_te",
    f"""WITH {_BINNED}{_PAIRS}
    SELECT source, target, sample, round(log2(CAST(count(*) OVER (PARTITION BY source, target, x, y, w) AS DOUBLE) * count(*) OVER (PARTITION BY source, target, w)
        / (CAST(count(*) OVER (PARTITION BY source, target, x, w) AS DOUBLE) * count(*) OVER (PARTITION BY source, target, y, w))), 8) + 0.0 AS local
    FROM pairs WHERE lag = 1""",
)
def _(spark, sf_dir):
    pairs = discrete.pair_table(hourly_bins(spark, sf_dir), (1,))
    return discrete.local_cmi(pairs, ["x"], ["y"], ["w"], ["source", "target"]).select("source", "target", "sample", "local")


@query("entropy_rate", f"WITH {_BINNED}, c AS (SELECT proc, value, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY proc) AS p FROM bins GROUP BY proc, value) SELECT proc, round(-sum(p * log2(p)), 8) + 0.0 AS h FROM c GROUP BY proc")
def _(spark, sf_dir):
    return discrete.entropy(hourly_bins(spark, sf_dir), ["value"], ["proc"])


# ---- Gaussian estimators --------------------------------------------------------------------

_REAL_PAIRS = _PAIRS.replace("bins", "series")


@query("gaussian_mi_pairs", f"WITH {_HOURLY}{_REAL_PAIRS} SELECT source, target, lag, round(-0.5 * ln(1 - corr(x, y) * corr(x, y)), 8) + 0.0 AS mi FROM pairs GROUP BY ALL")
def _(spark, sf_dir):
    return discrete.pair_table(hourly(spark, sf_dir), _LAGS).groupBy("source", "target", "lag").agg(gaussian.mi_expr("x", "y").alias("mi"))


@query(
    "gaussian_te_pairs",
    f"""WITH {_HOURLY}{_REAL_PAIRS}, c AS (SELECT source, target, lag, corr(x, y) AS xy, corr(x, w) AS xw, corr(y, w) AS yw FROM pairs GROUP BY ALL)
    SELECT source, target, lag, round(-0.5 * ln(1 - (xy - xw * yw) * (xy - xw * yw) / ((1 - xw * xw) * (1 - yw * yw))), 8) + 0.0 AS te FROM c""",
)
def _(spark, sf_dir):
    return discrete.pair_table(hourly(spark, sf_dir), _LAGS).groupBy("source", "target", "lag").agg(gaussian.cmi_expr("x", "y", "w").alias("te"))


@query("gaussian_ais", f"WITH {_HOURLY} SELECT a.proc, round(-0.5 * ln(1 - corr(a.value, b.value) * corr(a.value, b.value)), 8) + 0.0 AS ais FROM series a JOIN series b ON a.proc = b.proc AND b.sample = a.sample - 1 GROUP BY a.proc")
def _(spark, sf_dir):
    return discrete.history(hourly(spark, sf_dir), 1).groupBy("proc").agg(gaussian.mi_expr("h1", "y").alias("ais"))


@query("gaussian_covariances", f"WITH {_HOURLY} SELECT a.proc AS a, b.proc AS b, round(covar_samp(a.value, b.value), 6) + 0.0 AS c FROM series a JOIN series b ON a.sample = b.sample AND a.proc <= b.proc GROUP BY ALL")
def _(spark, sf_dir):
    wide = lag_embed(hourly(spark, sf_dir), [(p, 0) for p in range(5)], 0)
    n, c = gaussian.covariances(wide, [column((p, 0)) for p in range(5)])[None]
    return spark.createDataFrame([(a, b, round(float(c[a, b]), 6)) for a in range(5) for b in range(a, 5)], "a int, b int, c double")


# ---- nearest neighbours ---------------------------------------------------------------------


#: Hourly sums to six places: what is closer than a k-th neighbour must not hang on the order in which doubles were added.
_STEADY_HOURLY = f"{_HOURLY}, steady AS (SELECT proc, repl, sample, round(value, 6) AS value FROM series)"
_LAGGED = f"""{_STEADY_HOURLY},
points AS (
    SELECT a.proc AS source, b.proc AS target, b.sample AS rid, a.value AS x, b.value AS y, c.value AS z
    FROM steady a JOIN steady b ON a.proc <> b.proc AND a.sample = b.sample - 1 JOIN steady c ON c.proc = b.proc AND c.sample = b.sample - 1
)"""
#: Each process's value and the one before.
_OWN_PAST = f"{_STEADY_HOURLY}, points AS (SELECT a.proc, a.sample AS rid, b.value AS x, a.value AS y, 0 AS z FROM steady a JOIN steady b ON b.proc = a.proc AND b.sample = a.sample - 1)"


def _neighbours_sql(points: str, keys: str, joint: str, counts: str, least_gap: int = 1) -> str:
    """The k-th distance and the counts of closer points of every point in its group, by comparing all pairs."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{points},
    psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(CASE WHEN n > 1 THEN 1.0 / (n - 1) END) OVER (ORDER BY n), 0) AS psi FROM unnest(range(1, (SELECT count(*) + 2 FROM points))) t(n)),
    d AS (SELECT {", ".join(f"a.{k}" for k in keys.split(", "))}, a.rid, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, abs(a.z - b.z) AS dz FROM points a JOIN points b ON {same} AND abs(a.rid - b.rid) >= {least_gap}),
    r AS (SELECT {keys}, rid, list_sort(min({joint}, 4))[4] AS radius FROM d GROUP BY ALL),
    n AS (SELECT {keys}, rid, radius, {counts} FROM d JOIN r USING ({keys}, rid) GROUP BY ALL)"""


_XY = ("greatest(dx, dy)", "count(*) FILTER (dx < radius) AS n_x, count(*) FILTER (dy < radius) AS n_y")


def _mi_sql(points: str, keys: str, name: str, least_gap: int = 1) -> str:
    return f"""WITH {_neighbours_sql(points, keys, *_XY, least_gap)}
    SELECT {keys}, round((SELECT psi FROM psi WHERE n = 4) - w + psi, 8) + 0.0 AS {name}
    FROM (SELECT {keys}, avg(a.psi + b.psi) AS w, count(*) AS size FROM n JOIN psi a ON a.n = n_x + 1 JOIN psi b ON b.n = n_y + 1 GROUP BY {keys}) JOIN psi ON psi.n = size"""


def steady_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums to six places, so that distances that tie don't hang on the order of sums."""
    return hourly(spark, sf_dir).withColumn("value", F.round("value", 6))


def _lagged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discrete.pair_table(steady_hourly(spark, sf_dir), (1,)).select("source", "target", F.col("sample").alias("rid"), "x", "y", F.col("w").alias("z"))


@query("knn_neighbour_counts", f"WITH {_neighbours_sql(_LAGGED, 'source, target', *_XY)} SELECT source, target, rid, round(radius, 8) + 0.0 AS radius, n_x, n_y FROM n")
def _(spark, sf_dir):
    return knn.neighbour_counts(_lagged_points(spark, sf_dir), ["source", "target"], {"x": ["x"], "y": ["y"]}, 4)


@query("kraskov_mi", _mi_sql(_LAGGED, "source, target", "mi"))
def _(spark, sf_dir):
    return knn.ksg_by_group(_lagged_points(spark, sf_dir), ["source", "target"], ["x"], ["y"], name="mi", k=4)


@query(
    "kraskov_te",
    f"""WITH {_neighbours_sql(_LAGGED, 'source, target', 'greatest(dx, dy, dz)', 'count(*) FILTER (greatest(dx, dz) < radius) AS n_xz, count(*) FILTER (greatest(dy, dz) < radius) AS n_yz, count(*) FILTER (dz < radius) AS n_z')}
    SELECT source, target, round((SELECT psi FROM psi WHERE n = 4) + avg(c.psi - a.psi - b.psi), 8) + 0.0 AS te
    FROM n JOIN psi a ON a.n = n_xz + 1 JOIN psi b ON b.n = n_yz + 1 JOIN psi c ON c.n = n_z + 1 GROUP BY source, target""",
)
def _(spark, sf_dir):
    return knn.ksg_by_group(_lagged_points(spark, sf_dir), ["source", "target"], ["x"], ["y"], ["z"], "te", k=4)


@query("kraskov_mi_by_joins", _mi_sql(_LAGGED, "source, target", "mi"))
def _(spark, sf_dir):
    """The same estimate by expressions over the joined neighbour counts."""
    counted = knn.neighbour_counts(_lagged_points(spark, sf_dir), ["source", "target"], {"x": ["x"], "y": ["y"]}, 4)
    return counted.groupBy("source", "target").agg((psi(F.lit(4)) - F.avg(psi(F.col("n_x") + 1) + psi(F.col("n_y") + 1)) + psi(F.count("*"))).alias("mi"))


@query("kraskov_ais", _mi_sql(_OWN_PAST, "proc", "ais"))
def _(spark, sf_dir):
    return knn.ais_by_process(steady_hourly(spark, sf_dir), 1, k=4)


@query("kraskov_theiler", _mi_sql(_OWN_PAST, "proc", "mi", 6))
def _(spark, sf_dir):
    """Neighbours are at least six samples away."""
    past = discrete.history(steady_hourly(spark, sf_dir), 1).select("proc", F.col("sample").alias("rid"), F.col("h1").alias("x"), "y")
    return knn.ksg_by_cells(past, ["proc"], ["x"], ["y"], k=4, theiler=5)


@query(
    "kraskov_segments",
    _mi_sql("points AS (SELECT c_mktsegment AS segment, o_orderkey AS rid, o_totalprice AS x, c_acctbal AS y, 0 AS z FROM orders JOIN customer ON o_custkey = c_custkey)", "segment", "mi"),
)
def _(spark, sf_dir):
    """What an order's price says of its customer's balance, by market segment: groups that grow with the tables, balances tied."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    points = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"))
    return knn.ksg_by_cells(points, ["segment"], ["x"], ["y"], k=4)


# ---- surrogates -----------------------------------------------------------------------------



def _mixed_sql(h: str) -> str:
    for _ in range(2):
        h = f"((xor({h}, ({h}) >> 16) * {bijection.FACTOR}) & {bijection.MASK})"
    return h


def _key_sql(*parts: str) -> str:
    """A key from SEED and columns; every part has to be a column's name or a number."""
    out = str(bijection.mixed_number(SEED))
    for p in parts:
        out = _mixed_sql(f"(({out} + {p} + 1) & {bijection.MASK})")
    return out


def _turns_sql(x: str) -> str:
    high, low = _mixed_sql("xor(e >> 1, x % b)"), _mixed_sql("xor(e >> 1, x // b)")
    return f"list_reduce(ks, lambda x, e: CASE WHEN e % 2 = 1 THEN ((x // b + {high}) % a) * b + x % b ELSE (x // b) * b + (x % b + {low}) % b END, {x})"


def _moved_sql(n: str, width: int | None = None, name: str = "moved") -> str:
    """Tables that end with ``name`` (perm, i, src): item src takes place i of all n, or of its window of ``width``."""
    window = f"src // {width}" if width else "0"
    key = _key_sql("perm", "w") if width else _key_sql("perm")
    round_key = _mixed_sql(f"((key + r * {bijection.APART}) & {bijection.MASK})")
    return f"""{name}_g AS (SELECT perm, src, w, w * {width or 0} AS first, {f"least({width}, n - w * {width})" if width else "n"} AS size FROM (
        SELECT CAST(p AS BIGINT) AS perm, CAST(j AS BIGINT) AS src, CAST({window.replace("src", "j")} AS BIGINT) AS w, CAST({n} AS BIGINT) AS n FROM unnest(range(0, {PERMS})) x(p), unnest(range(0, {n})) y(j))),
    {name}_k AS (SELECT perm, src, first, size, a, CAST(ceil(size / a) AS BIGINT) AS b, list_transform(range(1, {bijection.ROUNDS + 1}), lambda r: {round_key} * 2 + r % 2) AS ks
        FROM (SELECT *, {key} AS key, CAST(ceil(sqrt(size)) AS BIGINT) AS a FROM {name}_g)),
    {name} AS (SELECT CAST(perm AS INTEGER) AS perm, CAST(first + list_reduce(range(1, {bijection.STEPS + 1}), lambda y, t: CASE WHEN y < size THEN y ELSE {_turns_sql("y")} END, {_turns_sql("src - first")}) AS INTEGER) AS i, CAST(src AS INTEGER) AS src FROM {name}_k)"""


_SLICE = "SELECT m.perm, s.repl, m.i AS sample, round(s.value, 8) + 0.0 AS value FROM moved m JOIN series s ON s.sample = m.src AND s.proc = 1"


def _slices(how: permutation.Permutation) -> Query:
    return lambda spark, sf_dir: permutation.slice_surrogates(views.daily_series(spark, sf_dir), 1, permutation.Surrogates(24, PERMS, SEED, how))


query("permutation_random", f"WITH {_DAILY}, {_moved_sql('24')} {_SLICE}")(_slices(permutation.Permutation()))
query("permutation_local", f"WITH {_DAILY}, {_moved_sql('24', 5)} {_SLICE}")(_slices(permutation.Permutation("local", perm_range=5)))
query(
    "permutation_circular",
    f"WITH {_DAILY}, moved AS (SELECT CAST(p AS INTEGER) AS perm, CAST(j AS INTEGER) AS src, CAST((j + {_key_sql('p')} % 10 + 1) % 24 AS INTEGER) AS i FROM unnest(range(0, {PERMS})) a(p), unnest(range(0, 24)) b(j)) {_SLICE}",
)(_slices(permutation.Permutation("circular", max_shift=10)))
query(
    "permutation_block",
    f"""WITH {_DAILY}, {_moved_sql('5', 3, 'blocks')},
    moved AS (
        SELECT b.perm, CAST(j AS INTEGER) AS src, CAST(b.i * 5 + j % 5 - CASE WHEN b.src // 3 = 1 AND b.i > e.i THEN 1 ELSE 0 END AS INTEGER) AS i
        FROM blocks b JOIN blocks e ON e.perm = b.perm AND e.src = 4 JOIN (SELECT unnest(range(0, 24)) AS j) ON j // 5 = b.src
    ) {_SLICE}""",
)(_slices(permutation.Permutation("block", block_size=5, perm_range=3)))


_TESTED = f"""{_BINNED},
{_moved_sql('(SELECT max(sample) FROM bins)')},
now AS (SELECT y.proc AS target, y.sample, y.value AS y, w.value AS w FROM bins y JOIN bins w ON w.proc = y.proc AND w.sample = y.sample - 1),
past AS (SELECT proc AS source, sample + 1 AS sample, value AS x FROM bins),
both_ AS (
    SELECT -1 AS perm, source, target, x, y, w FROM now JOIN past USING (sample) WHERE source <> target
    UNION ALL
    SELECT perm, source, target, x, y, w FROM moved JOIN past ON past.sample = moved.src + 1 JOIN now ON now.sample = moved.i + 1 WHERE source <> target
),
te AS ({_cmi_sql('perm, source, target', 'x', 'y', 'w', 'both_', 'te')}),
observed AS (SELECT source, target, te AS stat FROM te WHERE perm = -1),
surrogates AS (SELECT perm, source, target, te AS stat FROM te WHERE perm >= 0)"""


def surrogate_te(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observed te of all pairs, and that of permuted source pasts: one aggregate over all permutations."""
    bins = hourly_bins(spark, sf_dir)
    pairs = discrete.pair_table(bins, (1,)).select("source", "target", "repl", "sample", "x", "y", "w")
    n = bins.agg(F.max("sample")).first()[0]
    past = bins.where(F.col("sample") < n).select(F.col("proc").alias("source"), "repl", (F.col("sample") + 1).alias("sample"), F.col("value").alias("x"))
    now = discrete.history(bins, 1).select(F.col("proc").alias("target"), "repl", "sample", "y", F.col("h1").alias("w"))
    moved = now.join(permutation.moved(past, permutation.Surrogates(n, PERMS, SEED, offset=1)), ["repl", "sample"]).where("source <> target")
    keys = ["perm", "source", "target"]
    return discrete.cmi(pairs, ["x"], ["y"], ["w"], ["source", "target"], "stat"), discrete.cmi(moved, ["x"], ["y"], ["w"], keys, "stat").select(*keys, "stat")


_ROUND_KEYS = "round(stat, 8) + 0.0 AS stat"


@query("surrogate_table", f"WITH {_TESTED} SELECT perm, source, target, {_ROUND_KEYS} FROM surrogates")
def _(spark, sf_dir):
    return surrogate_te(spark, sf_dir)[1]


_PVALUES = f"""{_TESTED},
p AS (
    SELECT o.source, o.target, o.stat, greatest(avg(CASE WHEN round(s.stat, 10) >= round(o.stat, 10) THEN 1.0 ELSE 0.0 END), 1.0 / count(*)) AS p
    FROM observed o JOIN surrogates s USING (source, target) GROUP BY ALL
)"""


def _steady(df: DataFrame) -> DataFrame:
    """Statistics to ten places, so that ties don't hang on the order of sums."""
    return df.withColumn("stat", F.round("stat", 10))


def te_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, table = map(_steady, surrogate_te(spark, sf_dir))
    met = observed.join(table.withColumnRenamed("stat", "s"), ["source", "target"])
    return met.groupBy("source", "target", "stat").agg(significance.p_value(F.col("stat"), F.col("s")).alias("p"))


@query("te_p_values", f"WITH {_PVALUES} SELECT source, target, {_ROUND_KEYS}, round(p, 8) + 0.0 AS p FROM p")
def _(spark, sf_dir):
    return te_p_values(spark, sf_dir)


@query(
    "max_statistic",
    f"""WITH {_TESTED}, o AS (SELECT target, round(max(stat), 10) AS stat FROM observed GROUP BY target), s AS (SELECT perm, target, round(max(stat), 10) AS stat FROM surrogates GROUP BY ALL)
    SELECT target, round(o.stat, 8) + 0.0 AS stat, round(greatest(avg(CASE WHEN s.stat >= o.stat THEN 1.0 ELSE 0.0 END), 1.0 / count(*)), 8) + 0.0 AS p FROM o JOIN s USING (target) GROUP BY target, o.stat""",
)
def _(spark, sf_dir):
    return significance.extreme_statistic(*map(_steady, surrogate_te(spark, sf_dir)), ["target"], "max")


@query(
    "min_statistic",
    f"""WITH {_TESTED}, o AS (SELECT target, round(min(stat), 10) AS stat FROM observed GROUP BY target), s AS (SELECT perm, target, round(min(stat), 10) AS stat FROM surrogates GROUP BY ALL)
    SELECT target, round(o.stat, 8) + 0.0 AS stat, round(greatest(avg(CASE WHEN s.stat >= o.stat THEN 1.0 ELSE 0.0 END), 1.0 / count(*)), 8) + 0.0 AS p FROM o JOIN s USING (target) GROUP BY target, o.stat""",
)
def _(spark, sf_dir):
    return significance.extreme_statistic(*map(_steady, surrogate_te(spark, sf_dir)), ["target"], "min")


@query(
    "sequential_max_statistic",
    f"""WITH {_TESTED},
    o AS (SELECT target, source AS cand, round(stat, 10) AS stat, row_number() OVER (PARTITION BY target ORDER BY round(stat, 10) DESC, source) AS rank FROM observed),
    s AS (SELECT target, round(stat, 10) AS stat, row_number() OVER (PARTITION BY target, perm ORDER BY round(stat, 10) DESC) AS rank FROM surrogates),
    p AS (SELECT target, cand, rank, o.stat, greatest(avg(CASE WHEN s.stat >= o.stat THEN 1.0 ELSE 0.0 END), 1.0 / count(*)) AS p FROM o JOIN s USING (target, rank) GROUP BY target, cand, rank, o.stat),
    f AS (SELECT *, coalesce(max(CASE WHEN p >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM p)
    SELECT target, cand, CAST(rank AS INTEGER) AS rank, round(stat, 8) + 0.0 AS stat, round(CASE WHEN failed = 1 THEN 1.0 ELSE p END, 8) + 0.0 AS p, failed = 0 AND p < 0.3 AS significant FROM f""",
)
def _(spark, sf_dir):
    observed, table = map(_steady, surrogate_te(spark, sf_dir))
    return significance.sequential_max(observed.withColumnRenamed("source", "cand"), table.withColumnRenamed("source", "cand"), 0.3, ["target"])


@query(
    "fdr_by",
    f"""WITH {_PVALUES},
    r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM p),
    l AS (SELECT *, max(CASE WHEN p <= k / CAST(n AS DOUBLE) * 0.5 / (SELECT sum(1.0 / i) FROM unnest(range(1, (SELECT count(*) + 1 FROM p))) t(i)) THEN k ELSE 0 END) OVER () AS last FROM r)
    SELECT source, target, round(p, 8) + 0.0 AS p, k <= last AS significant FROM l""",
)
def _(spark, sf_dir):
    return significance.fdr(te_p_values(spark, sf_dir), 0.5, 2).select("source", "target", "p", "significant")


# ---- results --------------------------------------------------------------------------------

_VARIABLES = f"""{_BINNED}{_PAIRS}, r AS ({_cmi_sql('source, target, lag', 'x', 'y', 'w', 'pairs', 'te')}),
v AS (SELECT target, source, lag, round(te, 8) AS stat, round(1 / (1 + te), 8) AS pval FROM r WHERE round(te, 8) > 0.01)"""


def link_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = discrete.te_pairs(hourly_bins(spark, sf_dir), _LAGS)
    return te.where(F.round("te", 8) > 0.01).select("target", "source", "lag", F.round("te", 8).alias("stat"), F.round(1 / (1 + F.col("te")), 8).alias("pval"))


for _w, _sql in {
    "max_te_lag": "SELECT source, target, lag AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY stat DESC, lag) AS k FROM v) WHERE k = 1",
    "max_p_lag": "SELECT source, target, lag AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY pval, lag) AS k FROM v) WHERE k = 1",
    "vars_count": "SELECT source, target, CAST(count(*) AS INTEGER) AS weight FROM v GROUP BY ALL",
    "binary": "SELECT DISTINCT source, target, 1 AS weight FROM v",
}.items():
    query(f"adjacency_{_w}", f"WITH {_VARIABLES} {_sql}")(lambda spark, sf_dir, w=_w: results.adjacency(link_variables(spark, sf_dir), w))


@query("target_sources", f"WITH {_VARIABLES} SELECT target, list_sort(list(DISTINCT source)) AS sources FROM v GROUP BY target")
def _(spark, sf_dir):
    return results.target_sources(link_variables(spark, sf_dir))


@query("network_union", f"WITH {_VARIABLES} SELECT DISTINCT target, source, lag FROM v WHERE stat > 0.015 UNION SELECT target, source, lag FROM v WHERE pval < 0.99")
def _(spark, sf_dir):
    v = link_variables(spark, sf_dir)
    return results.union_of_networks(v.where("stat > 0.015"), v.where("pval < 0.99"))


@query("source_graph", f"WITH {_VARIABLES} SELECT source AS proc, lag, target, round(stat, 8) + 0.0 AS stat, round(pval, 8) + 0.0 AS pval FROM v WHERE target = 1")
def _(spark, sf_dir):
    return results.source_graph(link_variables(spark, sf_dir), 1).select(F.col("src.proc").alias("proc"), F.col("src.lag").alias("lag"), F.col("dst.proc").alias("target"), "stat", "pval")


@query(
    "edge_replacement",
    f"""WITH {_VARIABLES},
    edges AS (SELECT source, target, lag AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY stat DESC, lag) AS k FROM v) WHERE k = 1),
    other AS (SELECT source, target, CAST(count(*) AS INTEGER) AS weight FROM v WHERE target = 1 GROUP BY ALL)
    SELECT * FROM other UNION ALL SELECT * FROM edges WHERE (source, target) NOT IN (SELECT source, target FROM other)""",
)
def _(spark, sf_dir):
    """Edges by lag, those into one target replaced by counts."""
    v = link_variables(spark, sf_dir)
    return results.edge_list(results.add_edge_list(results.adjacency(v, "max_te_lag"), results.adjacency(v.where("target = 1"), "vars_count")))


# ---- decomposition --------------------------------------------------------------------------

_PID_ROWS = f"{_BINNED}, q AS (SELECT a.value AS s1, b.value AS s2, t.value AS t FROM bins t JOIN bins a ON a.proc = 0 AND a.sample = t.sample - 1 JOIN bins b ON b.proc = 1 AND b.sample = t.sample - 1 WHERE t.proc = 2)"


def pid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pid.sources_frame(hourly_bins(spark, sf_dir), 2, [0, 1])


@query("joint_pmf", f"WITH {_PID_ROWS} SELECT s1, s2, t, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 8) + 0.0 AS p FROM q GROUP BY s1, s2, t")
def _(spark, sf_dir):
    return discrete.pmf(pid_rows(spark, sf_dir), ["s1", "s2", "t"])


@query(
    "pid_shared_exclusions",
    f"""WITH {_PID_ROWS},
    p AS (SELECT s1, s2, t, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM q GROUP BY s1, s2, t),
    m AS (
        SELECT p, -log2(p1 + p2 - p12) AS a0, -log2(p1) AS a1, -log2(p2) AS a2, -log2(p12) AS a12, -log2((p1t + p2t - p) / pt) AS b0, -log2(p1t / pt) AS b1, -log2(p2t / pt) AS b2, -log2(p / pt) AS b12
        FROM (SELECT p, sum(p) OVER (PARTITION BY s1) AS p1, sum(p) OVER (PARTITION BY s2) AS p2, sum(p) OVER (PARTITION BY s1, s2) AS p12,
              sum(p) OVER (PARTITION BY s1, t) AS p1t, sum(p) OVER (PARTITION BY s2, t) AS p2t, sum(p) OVER (PARTITION BY t) AS pt FROM p)
    ),
    e AS (
        SELECT p, unnest([{{'alpha': '{{1}}{{2}}', 'a': a0, 'b': b0}}, {{'alpha': '{{1}}', 'a': a1 - a0, 'b': b1 - b0}}, {{'alpha': '{{2}}', 'a': a2 - a0, 'b': b2 - b0}}, {{'alpha': '{{12}}', 'a': a12 - a1 - a2 + a0, 'b': b12 - b1 - b2 + b0}}]) AS e FROM m
    )
    SELECT e.alpha AS alpha, round(sum(p * e.a), 8) + 0.0 AS pi_plus, round(sum(p * e.b), 8) + 0.0 AS pi_minus, round(sum(p * (e.a - e.b)), 8) + 0.0 AS pi FROM e GROUP BY e.alpha""",
)
def _(spark, sf_dir):
    return pid.shared_exclusions_two(pid_rows(spark, sf_dir))


@query("pid_two_sources")
def _(spark, sf_dir):
    return pid.decompose_two(pid_rows(spark, sf_dir))


@query("pid_network")
def _(spark, sf_dir):
    return pid.analyse_network(hourly_bins(spark, sf_dir), [2, 3, 4], [[0, 1], [0, 1], [2, 3]])


@query("pid_against_surrogates")
def _(spark, sf_dir):
    return pid.against_surrogates(hourly_bins(spark, sf_dir), 2, [0, 1], PERMS, seed=SEED)


@query("pid_three_sources")
def _(spark, sf_dir):
    return pid.decompose(pid.sources_frame(hourly_bins(spark, sf_dir), 3, [0, 1, 2]), 3)


query("slice_surrogates", f"WITH {_DAILY}, {_moved_sql('24')} {_SLICE}")(_slices(permutation.Permutation()))


@query(
    "swapped_replications",
    f"""WITH {_DAILY},
    half AS (SELECT (max(repl) + 1) // 2 AS h FROM series),
    two AS (SELECT CAST(repl // h AS INTEGER) AS g, repl % h AS i, proc, sample, value FROM series, half WHERE repl < 2 * h),
    dealt AS (SELECT CAST(p AS INTEGER) AS perm, CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', p, i)), 1, 8)) AS BIGINT) % 2 = 1 THEN 1 - g ELSE g END AS g, proc, sample, value FROM two, unnest(range(0, {PERMS})) a(p))
    SELECT perm, CAST(g AS INTEGER) AS group_id, proc, count(*) AS n, round(avg(value), 8) + 0.0 AS mean FROM dealt GROUP BY ALL""",
)
def _(spark, sf_dir):
    """The first and the second half of the days as two conditions: the processes' means under swaps of paired days."""
    days = views.daily_series(spark, sf_dir)
    h = (days.agg(F.max("repl")).first()[0] + 1) // 2
    two = days.where(F.col("repl") < 2 * h).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(PERMS - 1))))
    dealt = permutation.with_swapped(two, F.floor(F.col("repl") / h).cast("int"), F.col("repl") % h, F.col("perm"), h, SEED, True)
    return dealt.groupBy("perm", F.col("new_group").alias("group_id"), "proc").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query(
    "dealt_replications",
    f"""WITH {_DAILY},
    half AS (SELECT (max(repl) + 1) // 2 AS h FROM series),
    {_moved_sql('(SELECT 2 * h FROM half)')}
    SELECT m.perm, CAST(m.i // h AS INTEGER) AS group_id, proc, count(*) AS n, round(avg(value), 8) + 0.0 AS mean FROM series JOIN moved m ON m.src = repl, half GROUP BY ALL""",
)
def _(spark, sf_dir):
    """The same with days dealt anew to both conditions."""
    days = views.daily_series(spark, sf_dir)
    h = (days.agg(F.max("repl")).first()[0] + 1) // 2
    two = days.where(F.col("repl") < 2 * h).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(PERMS - 1))))
    dealt = permutation.with_swapped(two, F.floor(F.col("repl") / h).cast("int"), F.col("repl") % h, F.col("perm"), h, SEED, False)
    return dealt.groupBy("perm", F.col("new_group").alias("group_id"), "proc").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query(
    "gaussian_local_mi",
    f"""WITH {_HOURLY}, q AS (SELECT a.sample, a.value AS x, b.value AS y FROM series a JOIN series b ON a.sample = b.sample AND a.proc = 0 AND b.proc = 1),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM q)
    SELECT sample, round(-0.5 * ln(1 - c * c / (vx * vy)) - 0.5 * ((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * vx) / (vx * vy - c * c)
        + 0.5 * (x - mx) * (x - mx) / vx + 0.5 * (y - my) * (y - my) / vy, 8) + 0.0 AS local FROM q, m""",
)
def _(spark, sf_dir):
    wide = lag_embed(hourly(spark, sf_dir), [(0, 0), (1, 0)], 0)
    return gaussian.local_cmi(wide, ["v0_0"], ["v1_0"]).select("sample", "local")


# ---- comparison and graphs ------------------------------------------------------------------

_STEPS = f"""{_EVENTS},
steps AS (SELECT user_id, proc, next FROM (SELECT user_id, proc, lead(proc) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next FROM ev) WHERE next IS NOT NULL)"""
_SUBJECTS = f"""{_STEPS},
vals AS (
    SELECT CAST(user_id % 2 AS INTEGER) AS group_id, user_id AS subject, proc AS source, next AS target, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS cmi
    FROM steps GROUP BY user_id, proc, next
)"""


def transition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the share of each transition between event types: subjects' link values for group comparison."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    steps = views._events(spark, sf_dir).select("user_id", F.col("proc").alias("source"), F.lead("proc").over(order).alias("target")).where("target is not null")
    counts = steps.groupBy("user_id", "source", "target").agg(F.count("*").alias("n"))
    return counts.select((F.col("user_id") % 2).cast("int").alias("group_id"), F.col("user_id").alias("subject"), "source", "target", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("cmi"))


@query("group_difference", f"WITH {_SUBJECTS} SELECT target, source, round(avg(CASE WHEN group_id = 0 THEN cmi END) - avg(CASE WHEN group_id = 1 THEN cmi END), 8) + 0.0 AS diff FROM vals GROUP BY ALL")
def _(spark, sf_dir):
    return comparison.group_difference(transition_shares(spark, sf_dir))


@query(
    "compare_between_groups",
    f"""WITH {_SUBJECTS},
    people AS (SELECT DISTINCT group_id, subject FROM vals),
    dealt AS (
        SELECT perm, group_id, subject, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws('|', '{SEED}', perm, group_id, subject)), group_id, subject) > (SELECT count(*) FROM people WHERE group_id = 0) THEN 1 ELSE 0 END AS new
        FROM people, unnest(range(0, {PERMS})) t(perm)
    ),
    s AS (SELECT perm, target, source, avg(CASE WHEN new = 0 THEN cmi END) - avg(CASE WHEN new = 1 THEN cmi END) AS d FROM vals JOIN dealt USING (group_id, subject) GROUP BY ALL),
    o AS (SELECT target, source, avg(CASE WHEN group_id = 0 THEN cmi END) - avg(CASE WHEN group_id = 1 THEN cmi END) AS d FROM vals GROUP BY ALL),
    p AS (SELECT target, source, o.d, greatest(least(avg(CASE WHEN s.d >= o.d THEN 1.0 ELSE 0.0 END), avg(CASE WHEN s.d <= o.d THEN 1.0 ELSE 0.0 END)), 1.0 / count(*)) AS p FROM o JOIN s USING (target, source) GROUP BY target, source, o.d)
    SELECT target, source, round(d, 8) + 0.0 AS diff, round(p, 8) + 0.0 AS pval, p < 0.1 AS significant FROM p""",
)
def _(spark, sf_dir):
    return comparison.between_groups(transition_shares(spark, sf_dir), PERMS, 0.2, "two", SEED).select("target", "source", "diff", "pval", "significant")


_GRAPHS = f"""{_EVENTS},
day_steps AS (
    SELECT subject, many, proc, next FROM (
        SELECT user_id * 100000 + us // 86400000000 AS subject, proc, lead(proc) OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us, event_id) AS next, count(*) OVER (PARTITION BY user_id, us // 86400000000) AS many FROM ev
    ) WHERE next IS NOT NULL
),
graphs AS (SELECT DISTINCT CASE WHEN many < {views.BUSY} THEN 1 ELSE 0 END AS group_id, subject, CAST(proc * 5 + next AS INTEGER) AS link_id FROM day_steps),
occurrences AS (
    SELECT group_id, subject, [link_id] AS links FROM graphs
    UNION ALL
    SELECT o.group_id, o.subject, list_append(o.links, g.link_id) FROM occurrences o JOIN graphs g ON g.subject = o.subject AND g.link_id > o.links[-1]
),
counts AS (SELECT links, count(*) FILTER (group_id = 0) AS in_a, count(*) AS total FROM occurrences GROUP BY links)"""


@query("subgraph_counts", f"WITH RECURSIVE {_GRAPHS} SELECT array_to_string(links, ',') AS links, in_a, total FROM counts")
def _(spark, sf_dir):
    return _mining(spark, sf_dir).totals().select(F.array_join("links", ",").alias("links"), "in_a", "total")


@query("coded_transitions", f"WITH {_STEPS} SELECT DISTINCT user_id AS subject, proc AS source, next AS target, CAST(dense_rank() OVER (ORDER BY proc, next) - 1 AS INTEGER) AS link_id FROM steps")
def _(spark, sf_dir):
    """Links of users' graphs with their numbers among all links."""
    links = transition_shares(spark, sf_dir).select("subject", "source", "target")
    return subgraphs.coded(links, ["source", "target"]).select("subject", "source", "target", "link_id")


def _mining(spark: SparkSession, sf_dir: str) -> subgraphs.SubgraphMining:
    graphs = views.user_day_graphs(spark, sf_dir)
    sizes = {r[0]: r[1] for r in graphs.groupBy("group_id").agg(F.count_distinct("subject")).collect()}
    return subgraphs.SubgraphMining(graphs, sizes.get(0, 0), sizes.get(1, 0))


#: Fisher's exact test by counts (groups of different sizes), and Tarone's factor.
_TESTED_SETS = f"""{_GRAPHS},
size AS (SELECT count(DISTINCT subject) FILTER (group_id = 0) AS n_a, count(DISTINCT subject) FILTER (group_id = 1) AS n_b FROM graphs),
tables AS (SELECT DISTINCT total FROM counts),
pmf AS (
    SELECT total, j, exp(lgamma(total + 1) + lgamma(n_a + n_b - total + 1) + lgamma(n_a + 1) + lgamma(n_b + 1) - lgamma(n_a + n_b + 1) - lgamma(j + 1) - lgamma(total - j + 1) - lgamma(n_a - j + 1) - lgamma(n_b - total + j + 1)) AS f
    FROM (SELECT total, n_a, n_b, unnest(range(greatest(0, total - n_b), least(n_a, total) + 1)) AS j FROM tables, size)
),
tails AS (SELECT total, j, 2 * least(sum(f) OVER (PARTITION BY total ORDER BY j), sum(f) OVER (PARTITION BY total ORDER BY j DESC)) AS p_value FROM pmf),
lows AS (SELECT total, 2 * least(arg_max(f, j), arg_min(f, j)) AS min_p FROM pmf GROUP BY total),
sets AS (SELECT links, p_value, min_p FROM counts JOIN tails ON tails.total = counts.total AND j = in_a JOIN lows ON lows.total = counts.total),
factor AS (SELECT min(k) AS k FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM sets))) AS k) WHERE (SELECT count(*) FROM sets WHERE min_p <= 0.05 / k) <= k),
testable AS (SELECT links, p_value, k FROM sets, factor WHERE min_p <= 0.05 / k)"""


def _significant(method: str) -> Query:
    return lambda spark, sf_dir: _mining(spark, sf_dir).significant(method, 10_000, SEED).select(F.array_join("links", ",").alias("links"), "p_value")


query("significant_subgraphs_tarone", f"WITH RECURSIVE {_TESTED_SETS} SELECT array_to_string(links, ',') AS links, round(p_value, 8) + 0.0 AS p_value FROM testable WHERE p_value * k <= 0.05")(_significant("Tarone"))
query(
    "significant_subgraphs_hommel",
    f"""WITH RECURSIVE {_TESTED_SETS},
    ranked AS (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS n FROM testable),
    trials AS (SELECT m, bool_and(p_value > (r - (n - m)) * 0.05 / m) AS ok FROM ranked, (SELECT unnest(range(1, (SELECT count(*) + 1 FROM testable))) AS m) WHERE r > n - m GROUP BY m),
    level AS (SELECT coalesce(0.05 / max(m), 0.05) AS level FROM trials WHERE ok)
    SELECT array_to_string(links, ',') AS links, round(p_value * 0.05 / greatest(level, 0.05 / k), 8) + 0.0 AS p_value FROM testable, level WHERE p_value <= 0.05 / k OR p_value <= level""",
)(_significant("Hommel"))
query("significant_subgraphs_westfall_young")(_significant("Westfall-Young"))


# ---- history dependence ---------------------------------------------------------------------

_TRAINS = f"{_EVENTS}, trains AS (SELECT proc, us / 1e6 - min(us / 1e6) OVER (PARTITION BY proc) AS t FROM ev)"
#: Events are minutes apart: bins of half an hour, windows stepped by a quarter.
_EMBEDDING, _STEP = history.Embedding(3600.0, 2, 0.0), 900.0
_COUNTS = f"""{_TRAINS},
wn AS (SELECT proc, CAST(floor((max(t) - 4500.0) / 900.0) AS BIGINT) AS n_windows FROM trains GROUP BY proc),
dealt AS (
    SELECT proc, n_windows, k, CASE WHEN t <= k * 900.0 + 1800.0 THEN 0 WHEN t <= k * 900.0 + 3600.0 THEN 1 ELSE 2 END AS bin
    FROM (SELECT proc, n_windows, t, unnest(range(greatest(CAST(floor((t - 4500.0) / 900.0) AS BIGINT) - 1, 0), least(CAST(floor(t / 900.0) AS BIGINT) + 1, n_windows - 1) + 1)) AS k FROM trains JOIN wn USING (proc))
    WHERE t >= k * 900.0 AND t < k * 900.0 + 4500.0
),
c AS (SELECT proc, k, bin, count(*) AS c FROM dealt GROUP BY ALL),
dense AS (SELECT proc, k, bin, coalesce(c, 0) AS c FROM (SELECT proc, unnest(range(0, n_windows)) AS k FROM wn) JOIN (VALUES (0), (1), (2)) b(bin) ON true LEFT JOIN c USING (proc, k, bin)),
med AS (SELECT proc, bin, median(c) AS m FROM dense GROUP BY ALL),
sym AS (SELECT proc, k, CAST(sum(CASE WHEN c > m THEN CAST(pow(2, 2 - bin) AS BIGINT) ELSE 0 END) AS BIGINT) AS symbol FROM dense JOIN med USING (proc, bin) GROUP BY proc, k),
counts AS (SELECT proc, symbol, count(*) AS n FROM sym GROUP BY ALL)"""


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike_trains(views.event_spikes(spark, sf_dir))


@query("history_symbol_counts", f"WITH {_COUNTS} SELECT proc, symbol, n FROM counts")
def _(spark, sf_dir):
    return history.symbol_counts(trains(spark, sf_dir), _EMBEDDING, _STEP)


@query(
    "history_plug_in",
    f"""WITH {_COUNTS},
    h AS (
        SELECT proc, kind, -sum(p * ln(p)) AS h FROM (
            SELECT proc, kind, n / CAST(sum(n) OVER (PARTITION BY proc, kind) AS DOUBLE) AS p FROM (
                SELECT proc, 'now' AS kind, symbol % 2 AS s, sum(n) AS n FROM counts GROUP BY ALL UNION ALL
                SELECT proc, 'past', symbol // 2, sum(n) FROM counts GROUP BY ALL UNION ALL SELECT proc, 'joint', symbol, n FROM counts)) GROUP BY ALL
    ),
    w AS (SELECT proc, max(CASE WHEN kind = 'now' THEN h END) AS a, max(CASE WHEN kind = 'past' THEN h END) AS b, max(CASE WHEN kind = 'joint' THEN h END) AS c FROM h GROUP BY proc)
    SELECT proc, round(a + b - c, 8) + 0.0 AS mi, round(CASE WHEN a > 0 THEN (a + b - c) / a ELSE 0.0 END, 8) + 0.0 AS r FROM w""",
)
def _(spark, sf_dir):
    return history.plug_in(history.symbol_counts(trains(spark, sf_dir), _EMBEDDING, _STEP))


@query(
    "firing_rates",
    f"""WITH {_TRAINS}, r AS (SELECT proc, count(*) / max(t) AS rate, max(t) AS length, count(DISTINCT floor(t / 900.0)) / (floor(max(t) / 900.0) + 1) AS p FROM trains GROUP BY proc)
    SELECT proc, round(rate, 8) + 0.0 AS rate, round(length, 8) + 0.0 AS length, round(-p * ln(p) - CASE WHEN 1 - p > 0 THEN (1 - p) * ln(1 - p) ELSE 0.0 END, 8) + 0.0 AS h_spiking FROM r""",
)
def _(spark, sf_dir):
    return history.firing_rate(trains(spark, sf_dir), _STEP)


@query(
    "auto_information",
    f"""WITH {_TRAINS}, size AS (SELECT proc, CAST(floor(max(t) / 900.0) + 1 AS BIGINT) AS m FROM trains GROUP BY proc),
    act AS (SELECT DISTINCT proc, CAST(floor(t / 900.0) AS BIGINT) AS b FROM trains),
    bin AS (SELECT proc, b, CASE WHEN a.b IS NULL THEN 0 ELSE 1 END AS x FROM (SELECT proc, unnest(range(0, m)) AS b FROM size) g LEFT JOIN act a USING (proc, b)),
    h1 AS (SELECT proc, -sum(p * ln(p)) AS h FROM (SELECT proc, count(*) / CAST(sum(count(*)) OVER (PARTITION BY proc) AS DOUBLE) AS p FROM bin GROUP BY proc, x) GROUP BY proc),
    pr AS (SELECT u.proc, CAST(d.delay AS INTEGER) AS delay, u.x AS x, v.x AS y FROM bin u JOIN (VALUES (1), (2), (3), (4)) d(delay) ON true JOIN bin v ON v.proc = u.proc AND v.b = u.b + d.delay),
    h2 AS (SELECT proc, delay, -sum(p * ln(p)) AS h FROM (SELECT proc, delay, count(*) / CAST(sum(count(*)) OVER (PARTITION BY proc, delay) AS DOUBLE) AS p FROM pr GROUP BY proc, delay, x, y) GROUP BY ALL)
    SELECT h2.proc, delay, round(CASE WHEN h1.h > 0 THEN 2 - h2.h / h1.h ELSE 0.0 END, 8) + 0.0 AS r FROM h2 JOIN h1 ON h1.proc = h2.proc""",
)
def _(spark, sf_dir):
    return history.auto_information(trains(spark, sf_dir), _STEP, 4)


_GRID = history.embeddings([900.0, 1800.0, 3600.0, 7200.0], [1, 2], 3, least_first_bin=450.0)


def _grid_values() -> str:
    """Embeddings as (e, bins, length, end of the first bin, end of the second)."""
    rows = []
    for k, e in enumerate(_GRID):
        ends = e.delimiters(_STEP)
        rows.append(f"({k}, {e.bins}, {ends[-1]!r}::DOUBLE, {ends[0]!r}::DOUBLE, {ends[1]!r}::DOUBLE)")
    return ", ".join(rows)


_GRID_COUNTS = f"""{_TRAINS},
emb(e, bins, len, e0, e1) AS (VALUES {_grid_values()}),
wn AS (SELECT proc, e, bins, len, e0, e1, CAST(floor((last - len) / 900.0::DOUBLE) AS BIGINT) AS n_windows FROM (SELECT proc, max(t) AS last FROM trains GROUP BY proc) JOIN emb ON last - len >= 900.0::DOUBLE),
dealt AS (
    SELECT e, proc, k, CASE WHEN t <= k * 900.0::DOUBLE + e0 THEN 0 WHEN bins = 1 OR t <= k * 900.0::DOUBLE + e1 THEN 1 ELSE 2 END AS bin
    FROM (SELECT e, proc, bins, len, e0, e1, t, unnest(range(greatest(CAST(floor((t - len) / 900.0::DOUBLE) AS BIGINT) - 1, 0), least(CAST(floor(t / 900.0::DOUBLE) AS BIGINT) + 1, n_windows - 1) + 1)) AS k FROM trains JOIN wn USING (proc))
    WHERE t >= k * 900.0::DOUBLE AND t < k * 900.0::DOUBLE + len
),
c AS (SELECT e, proc, k, bin, count(*) AS c FROM dealt GROUP BY ALL),
dense AS (SELECT e, proc, bins, k, bin, coalesce(c, 0) AS c FROM (SELECT e, proc, bins, unnest(range(0, n_windows)) AS k FROM wn) JOIN (VALUES (0), (1), (2)) b(bin) ON bin <= bins LEFT JOIN c USING (e, proc, k, bin)),
med AS (SELECT e, proc, bin, median(c) AS m FROM dense GROUP BY ALL),
sym AS (SELECT e, proc, k, CAST(sum(CASE WHEN c > m THEN CAST(pow(2, bins - bin) AS BIGINT) ELSE 0 END) AS BIGINT) AS symbol FROM dense JOIN med USING (e, proc, bin) GROUP BY e, proc, k),
counts AS (SELECT e, proc, symbol, count(*) AS n FROM sym GROUP BY ALL)"""


def _grid_counts(spark, sf_dir):
    return history.grid_counts(history.grid_symbols(trains(spark, sf_dir), _GRID, _STEP))


@query("history_grid_counts", f"WITH {_GRID_COUNTS} SELECT CAST(e AS INTEGER) AS e, proc, symbol, n FROM counts")
def _(spark, sf_dir):
    return _grid_counts(spark, sf_dir)


@query(
    "history_grid_plug_in",
    f"""WITH {_GRID_COUNTS},
    h AS (
        SELECT e, proc, kind, -sum(p * ln(p)) AS h FROM (
            SELECT e, proc, kind, n / CAST(sum(n) OVER (PARTITION BY e, proc, kind) AS DOUBLE) AS p FROM (
                SELECT e, proc, 'now' AS kind, symbol % 2 AS s, sum(n) AS n FROM counts GROUP BY ALL UNION ALL
                SELECT e, proc, 'past', symbol // 2, sum(n) FROM counts GROUP BY ALL UNION ALL SELECT e, proc, 'joint', symbol, n FROM counts)) GROUP BY ALL
    ),
    w AS (SELECT e, proc, max(CASE WHEN kind = 'now' THEN h END) AS a, max(CASE WHEN kind = 'past' THEN h END) AS b, max(CASE WHEN kind = 'joint' THEN h END) AS c FROM h GROUP BY e, proc)
    SELECT CAST(e AS INTEGER) AS e, proc, round(a + b - c, 8) + 0.0 AS mi, round(CASE WHEN a > 0 THEN (a + b - c) / a ELSE 0.0 END, 8) + 0.0 AS r FROM w""",
)
def _(spark, sf_dir):
    return history.plug_in(_grid_counts(spark, sf_dir), ("e", "proc"))


@query("history_estimates")
def _(spark, sf_dir):
    return history.estimates(_grid_counts(spark, sf_dir), _GRID)


def _optimised(spark, sf_dir, method):
    # events remember little, so the two estimates of the criterion lie further apart than the usual 0.05
    found = history.optimised(trains(spark, sf_dir), _GRID, method, _STEP, tolerance=1.0, n_boot=10, least_range=450.0)
    at = F.array(*(F.struct(F.lit(e.bins).alias("bins"), F.lit(float(e.scaling)).alias("scaling")) for e in _GRID))[F.col("e")]
    return found.select("proc", "temporal_depth", "timescale", "r_tot", "r_low", "r_high", at["bins"].alias("bins"), at["scaling"].alias("scaling"))


@query("history_optimised")
def _(spark, sf_dir):
    return _optimised(spark, sf_dir, "shuffling")


@query("history_optimised_bbc")
def _(spark, sf_dir):
    return _optimised(spark, sf_dir, "bbc")


# ---- network analyses -----------------------------------------------------------------------

_NETWORK = dict(estimator="gaussian", max_lag_sources=2, max_lag_target=2, n_perm_max_stat=100, n_perm_min_stat=100, n_perm_omnibus=100, n_perm_max_seq=100, permute_in_time=True)
_STORAGE = dict(estimator="gaussian", max_lag=3, permute_in_time=True, n_perm_max_stat=100, n_perm_min_stat=100, n_perm_mi=100)

_FLOW = """
o AS (SELECT epoch_us(o_orderdate) // 86400000000 AS d, sum(o_totalprice) AS value FROM orders GROUP BY 1),
b AS (SELECT min(d) AS f, max(d) AS l FROM o),
li AS (SELECT epoch_us(l_shipdate) // 86400000000 AS d, sum(l_quantity) AS value FROM lineitem GROUP BY 1),
days AS (SELECT unnest(range(0, (SELECT l - f + 1 FROM b))) AS t),
flow AS (
    SELECT 0 AS proc, t, coalesce(value, 0.0) AS value FROM days JOIN b ON true LEFT JOIN o ON o.d = f + t
    UNION ALL SELECT 1, t, coalesce(value, 0.0) FROM days JOIN b ON true LEFT JOIN li ON li.d = f + t
),
units AS (SELECT proc, avg(value) AS m FROM flow GROUP BY proc),
adds(proc, later, to_proc) AS (VALUES (0, 1, 2), (0, 2, 2), (1, 0, 2), (1, 0, 3), (1, 1, 3), (1, 2, 3)),
series AS (
    SELECT proc, t, value FROM flow
    UNION ALL
    SELECT to_proc, t + later, sum(CASE WHEN to_proc = 3 THEN value ELSE value / m END) FROM flow JOIN adds USING (proc) JOIN units USING (proc) WHERE t + later <= (SELECT max(t) FROM days) GROUP BY ALL
)"""


def _tail_sql(stat: str, dof: str) -> str:
    """The chi-square tail of 2 n times a statistic (n a column), by the series of the incomplete gamma function."""
    x, a = f"(n * ({stat}))", f"(({dof}) / 2.0)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 300 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 900), lambda i: exp((i + {a}) * ln({x}) - {x} - lgamma(i + {a} + 1))))) END"


def _selection_sql(variables: str, k: int, most: int, past: str, allowed: str, start: int, starts: str, floor: float = 0.01) -> str:
    """Greedy selection in SQL, for Gaussian variables (target, v, t, value) with v below k, and the target's value as k.

    Log-determinants of all subsets come from Schur complements; a state is two masks,
    what is fixed and what is selected; phases 0 and 1 include, 2 prunes, 3 is the end.
    """
    held = "greatest({p}, 0.01) < 0.05"
    return f"""{_FLOW},
    x AS ({variables} UNION ALL SELECT proc, {k}, t, value FROM series WHERE t >= {most}),
    rows_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM series WHERE proc = 0 AND t >= {most}),
    cov AS (SELECT a.target, a.v AS i, c.v AS j, covar_samp(a.value, c.value) AS c FROM x a JOIN x c ON a.target = c.target AND a.t = c.t GROUP BY ALL),
    lines AS (SELECT target, i, list(c ORDER BY j) AS line FROM cov GROUP BY target, i),
    subsets AS (
        SELECT target, CAST(0 AS BIGINT) AS mask, -1 AS top, CAST(0 AS DOUBLE) AS ld, list(line ORDER BY i) AS m FROM lines GROUP BY target
        UNION ALL
        SELECT target, mask + (1 << q), q, ld + ln(m[q + 1][q + 1]),
               list_transform(range(1, {k + 2}), lambda i: list_transform(range(1, {k + 2}), lambda j: m[i][j] - m[i][q + 1] * m[q + 1][j] / m[q + 1][q + 1]))
        FROM subsets, (SELECT CAST(unnest(range(0, {k + 1})) AS INTEGER) AS q) WHERE q > top
    ),
    ld AS (SELECT target, mask, ld FROM subsets),
    cmi AS (
        SELECT z.target, v, z.mask AS z, 0.5 * (zx.ld + zy.ld - z.ld - zxy.ld) AS c, n
        FROM rows_n, ld z, (SELECT CAST(unnest(range(0, {k})) AS INTEGER) AS v), ld zx, ld zy, ld zxy
        WHERE z.mask < (1 << {k}) AND (z.mask >> v) & 1 = 0 AND zx.target = z.target AND zx.mask = z.mask + (1 << v) AND zy.target = z.target AND zy.mask = z.mask + (1 << {k}) AND zxy.target = z.target AND zxy.mask = zx.mask + (1 << {k})
    ),
    st AS (
        SELECT target, source, {start} AS phase, CAST(0 AS BIGINT) AS fixed, CAST(0 AS BIGINT) AS sel FROM ({starts})
        UNION ALL
        SELECT target, source,
               CASE WHEN phase < 2 THEN CASE WHEN ok THEN phase ELSE phase + 1 END ELSE CASE WHEN gone THEN 2 ELSE 3 END END,
               CASE WHEN phase = 0 AND ok THEN fixed + (1 << best) WHEN phase = 0 AND fixed = 0 THEN 1 << (target * {most}) ELSE fixed END,
               CASE WHEN phase = 1 AND ok THEN sel + (1 << best) WHEN phase = 2 AND gone THEN sel - (1 << worst) ELSE sel END
        FROM (
            SELECT *, m > 0 AND {held.format(p=f"1 - pow(1 - {_tail_sql('most', '1')}, m)")} AS ok, m > 1 AND NOT {held.format(p=f"pow({_tail_sql('least', '1')}, m)")} AS gone
            FROM (
                SELECT s.target, s.source, s.phase, s.fixed, s.sel, arg_max(v, c) AS best, max(c) AS most, arg_min(v, c) AS worst, min(c) AS least, count(v) AS m, max(n) AS n
                FROM st s LEFT JOIN cmi ON cmi.target = s.target AND CASE s.phase
                    WHEN 0 THEN {past} AND (s.fixed >> v) & 1 = 0 AND z = s.fixed
                    WHEN 1 THEN {allowed} AND (s.sel >> v) & 1 = 0 AND z = s.fixed + s.sel
                    ELSE (s.sel >> v) & 1 = 1 AND z = s.fixed + s.sel - (1 << v) END
                WHERE s.phase < 3 GROUP BY s.target, s.source, s.phase, s.fixed, s.sel
            )
        )
    ),
    chosen AS (SELECT target, source, fixed, sel FROM st WHERE phase = 3 AND sel > 0),
    together AS (SELECT target, any_value(fixed) AS fixed, CAST(bit_or(sel) AS BIGINT) AS sel FROM chosen GROUP BY target),
    omnibus AS (
        SELECT *, greatest({_tail_sql("stat", "bit_count(sel)")}, {floor}) AS p FROM (
            SELECT g.target, g.fixed, g.sel, 0.5 * (a.ld + b.ld - c.ld - d.ld) AS stat, n FROM rows_n, together g
            JOIN ld a ON a.target = g.target AND a.mask = g.fixed + g.sel JOIN ld b ON b.target = g.target AND b.mask = g.fixed + (1 << {k})
            JOIN ld c ON c.target = g.target AND c.mask = g.fixed JOIN ld d ON d.target = g.target AND d.mask = g.fixed + g.sel + (1 << {k})
        )
    )"""


def _fdr_sql(targets: str) -> str:
    """kept_targets: those whose omnibus p-values pass Benjamini and Yekutieli's steps among all ``targets``."""
    return f""",
    all_p AS (SELECT t.target, coalesce(p, 1.0) AS p FROM ({targets}) t LEFT JOIN omnibus USING (target)),
    steps AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS many FROM all_p),
    reached AS (SELECT coalesce(max(CASE WHEN p <= r / many * 0.05 / (SELECT sum(1.0 / i) FROM unnest(range(1, (SELECT count(*) + 1 FROM all_p))) u(i)) THEN r END), 0) AS upto FROM steps),
    kept_targets AS (SELECT target FROM steps, reached WHERE r <= upto AND p < 1)"""


def _network_sql(te: bool, multivariate: bool, fdr: bool = False) -> str:
    variables = "SELECT y.proc AS target, s.proc * 2 + lag - 1 AS v, s.t + lag AS t, s.value FROM series s JOIN (VALUES (1), (2)) l(lag) ON s.t + lag BETWEEN 2 AND (SELECT max(t) FROM days) JOIN (SELECT DISTINCT proc FROM series) y ON true"
    allowed = "v // 2 <> s.target" if multivariate else "v // 2 = s.source"
    starts = "SELECT proc AS target, -1 AS source FROM units UNION ALL SELECT unnest([2, 3]), -1" if multivariate else "SELECT a.p AS target, b.p AS source FROM (SELECT unnest(range(0, 4)) AS p) a JOIN (SELECT unnest(range(0, 4)) AS p) b ON a.p <> b.p"
    return f"""WITH RECURSIVE {_selection_sql(variables, 8, 2, "v // 2 = s.target", allowed, 0 if te else 1, starts, 0.001 if fdr else 0.01)}{_fdr_sql("SELECT DISTINCT proc AS target FROM series") if fdr else ""},
    each AS (
        SELECT *, greatest(list_sum(list_transform(range(r, m + 1), lambda j: round(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1))) * pow(q, j) * pow(1 - q, m - j))), 0.01) AS p FROM (
            SELECT h.target, h.source AS own, v, c, {_tail_sql("c", "1")} AS q, row_number() OVER (PARTITION BY h.target, h.source ORDER BY c DESC) AS r, CAST(bit_count(h.sel) AS BIGINT) AS m
            FROM chosen h JOIN (SELECT target FROM omnibus WHERE p < 0.05) o ON o.target = h.target JOIN cmi ON cmi.target = h.target AND (h.sel >> v) & 1 = 1 AND z = h.fixed + h.sel - (1 << v)
        )
    ),
    kept AS (SELECT *, max(CASE WHEN p >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY target, own ORDER BY r) AS failed FROM each)
    SELECT CAST(target AS INTEGER) AS target, CAST(v // 2 AS INTEGER) AS source, CAST(v % 2 + 1 AS INTEGER) AS lag, round(c, 8) + 0.0 AS stat, round(p, 8) + 0.0 AS pval FROM kept WHERE failed = 0{" AND target IN (SELECT target FROM kept_targets)" if fdr else ""}"""


def network(spark: SparkSession, sf_dir: str, measure: str = "te", multivariate: bool = True, targets: list[int] | str = "all", **more) -> list[inference.TargetResult]:
    return inference.NetworkInference(measure, multivariate).analyse_network({**_NETWORK, **more}, TimeSeries.from_frame(views.order_flow(spark, sf_dir)), targets)


for _measure in ("te", "mi"):
    for _multi in (True, False):
        query(f"{'multivariate' if _multi else 'bivariate'}_{_measure}", _network_sql(_measure == "te", _multi))(lambda spark, sf_dir, m=_measure, v=_multi: results.variables_frame(spark, network(spark, sf_dir, m, v)))


@query("network_fdr", _network_sql(True, True, fdr=True))
def _(spark, sf_dir):
    """Multivariate transfer entropy, corrected over the targets."""
    more = {"n_perm_omnibus": 1_000}
    found = inference.network_fdr({**_NETWORK, **more}, network(spark, sf_dir, **more))
    return results.variables_frame(spark, found)


@query("target_omnibus", f"""WITH RECURSIVE {_selection_sql("SELECT y.proc AS target, s.proc * 2 + lag - 1 AS v, s.t + lag AS t, s.value FROM series s JOIN (VALUES (1), (2)) l(lag) ON s.t + lag BETWEEN 2 AND (SELECT max(t) FROM days) JOIN (SELECT DISTINCT proc FROM series) y ON true", 8, 2, "v // 2 = s.target", "v // 2 <> s.target", 0, "SELECT unnest(range(0, 4)) AS target, -1 AS source")}
    SELECT CAST(target AS INTEGER) AS target, array_to_string(list_filter(range(1, 3), lambda lag: (fixed >> CAST(target * 2 + lag - 1 AS INTEGER)) & 1 = 1), ',') AS past, round(stat, 8) + 0.0 AS stat, round(p, 8) + 0.0 AS pval, p < 0.05 AS significant FROM omnibus""")
def _(spark, sf_dir):
    """The test of all selected sources together, and the target's own past, of targets with any."""
    found = results.targets_frame(spark, network(spark, sf_dir)).where("omnibus_stat is not null")
    past = F.array_join(F.array_sort(F.transform("selected_vars_target", lambda v: v["lag"])).cast("array<string>"), ",")
    return found.select("target", past.alias("past"), F.col("omnibus_stat").alias("stat"), F.col("omnibus_pval").alias("pval"), F.col("omnibus_sign").alias("significant"))


def _stored_sql(fdr: bool = False) -> str:
    variables = "SELECT proc AS target, lag - 1 AS v, t + lag AS t, value FROM series JOIN (VALUES (1), (2), (3)) l(lag) ON t + lag BETWEEN 3 AND (SELECT max(t) FROM days)"
    return f"""WITH RECURSIVE {_selection_sql(variables, 3, 3, "false", "true", 1, "SELECT unnest(range(0, 4)) AS target, -1 AS source", 0.001 if fdr else 0.01)}{_fdr_sql("SELECT DISTINCT proc AS target FROM series") if fdr else ""}
    SELECT CAST(target AS INTEGER) AS process, CAST(v + 1 AS INTEGER) AS lag, round(stat, 8) + 0.0 AS ais, round(p, 8) + 0.0 AS pval
    FROM omnibus JOIN (SELECT unnest(range(0, 3)) AS v) ON (sel >> CAST(v AS INTEGER)) & 1 = 1 WHERE p < 0.05{" AND target IN (SELECT target FROM kept_targets)" if fdr else ""}"""


def _stored(spark: SparkSession, sf_dir: str, fdr: bool) -> DataFrame:
    s = {**_STORAGE, "n_perm_mi": 1_000} if fdr else _STORAGE
    found = inference.InformationStorage().analyse_network(s, TimeSeries.from_frame(views.order_flow(spark, sf_dir)))
    found = results.storage_frame(spark, inference.storage_fdr(s, found) if fdr else found)
    return found.select("process", F.explode("selected_vars.lag").alias("lag"), "ais", F.col("ais_pval").alias("pval"))


query("information_storage", _stored_sql())(lambda spark, sf_dir: _stored(spark, sf_dir, False))
query("storage_fdr", _stored_sql(fdr=True))(lambda spark, sf_dir: _stored(spark, sf_dir, True))


@query("order_flow", f"WITH {_FLOW} SELECT CAST(proc AS INTEGER) AS proc, 0 AS repl, CAST(t AS INTEGER) AS sample, round(value, 6) + 0.0 AS value FROM series")
def _(spark, sf_dir):
    return views.order_flow(spark, sf_dir).withColumn("value", F.round("value", 6) + 0.0)


@known("benchmark_network")
def _(spark, sf_dir):
    series = TimeSeries.from_frame(generators.coupled_network(spark, 300, 5))
    found = inference.NetworkInference("te").analyse_network({**_NETWORK, "max_lag_sources": 3}, series)
    return results.variables_frame(spark, inference.network_fdr({**_NETWORK, "max_lag_sources": 3}, found) or found)


@known("generated_series")
def _(spark, sf_dir):
    a = np.array([[[0.5, 0.0], [0.4, 0.5]]])
    frames = [generators.coupled_network(spark, 50, 2), generators.autoregressive(spark, a, 50, 2), generators.logistic_maps(spark, a, 50, 2)]
    return reduce(DataFrame.unionByName, [f.withColumn("kind", F.lit(k)) for k, f in enumerate(frames)]).groupBy("kind", "proc", "repl").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("compare_conditions")
def _(spark, sf_dir):
    hours = TimeSeries.from_frame(hourly(spark, sf_dir))
    half = hours.n_samples // 2
    first = TimeSeries(hours.df.where(F.col("sample") < half))
    second = TimeSeries(hours.df.where((F.col("sample") >= half) & (F.col("sample") < 2 * half)).withColumn("sample", F.col("sample") - half))
    own = [inference.TargetResult(t, [s], 2, [(t, 1)], [(s, 1)]) for t, s in ((0, 1), (2, 3))]
    return comparison.NetworkComparison({**_NETWORK, "stats_type": "independent", "n_perm_comp": 100, "permute_in_time": True}).compare_within(own, own, first, second)
