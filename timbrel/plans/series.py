"""Queries over ordered series, frames and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions.scalars import dot
from timbrel.operators import frames as FR
from timbrel.operators import series as SR
from timbrel.operators import spectral as SP
from timbrel.operators.ordered import neighbourhood, quantiles
from timbrel.plans.registry import SQL, query
from timbrel.session import materialise
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col


def rounded(df, *keys: str, digits: int = 6):
    """Round the double columns; leave keys and whole numbers alone."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if f.dataType.simpleString() == "double" and f.name not in keys
            else (c(f.name).cast("long").alias(f.name)
                  if f.dataType.simpleString() == "int" else c(f.name))
            for f in df.schema.fields
        ]
    )


def stored(view, spark, folder):
    """A view written once, for operators that read their input more than once."""
    return materialise(view(spark, folder), "series")


# --- windows -------------------------------------------------------------------------------

_MOVED = """moved as (select *, lag(x) over w as px,
    avg(x) over (w rows between 1 preceding and 1 following) as m3, count(x) over (w rows between 1 preceding and 1 following) as n3,
    avg(x) over (w rows between 2 preceding and 2 following) as m5, count(x) over (w rows between 2 preceding and 2 following) as n5,
    avg(x) over (w rows between 5 preceding and 5 following) as m11, count(x) over (w rows between 5 preceding and 5 following) as n11
    from {src} window w as (partition by series_id order by t))"""
_JITTER = """select series_id, case when ok then abs_ else 0 end as jitter_abs, case when ok then abs_ / m * 100 else 0 end as jitter_pct,
    case when ok then coalesce(d3 / m, 0) else 0 end as rap, case when ok then coalesce(d5 / m, 0) else 0 end as ppq,
    case when ok then 3 * coalesce(d3 / m, 0) else 0 end as ddp
  from (select series_id, count(*) >= 5 and avg(x) <> 0 as ok, avg(x) as m, avg(abs(x - px)) as abs_,
      avg(case when n3 = 3 then abs(x - m3) end) as d3, avg(case when n5 = 5 then abs(x - m5) end) as d5
    from moved group by series_id)"""
_SHIMMER = """select series_id, case when ok then step / m else 0 end as shimmer_local, case when ok then db else 0 end as shimmer_db,
    case when ok then coalesce(d3 / m, 0) else 0 end as apq3, case when ok then coalesce(d5 / m, 0) else 0 end as apq5,
    case when ok then coalesce(d11 / m, 0) else 0 end as apq11, case when ok then 3 * coalesce(d3 / m, 0) else 0 end as dda
  from (select series_id, count(*) >= 5 and avg(x) <> 0 as ok, avg(x) as m, avg(abs(x - px)) as step, avg(abs(20 * log10(x / px))) as db,
      avg(case when n3 = 3 then abs(x - m3) end) as d3, avg(case when n5 = 5 then abs(x - m5) end) as d5,
      avg(case when n11 = 11 then abs(x - m11) end) as d11
    from moved group by series_id)"""


def _r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) as {x}" for x in cols.split())


@query("w1_jitter", with_views(
    "series_ev", f"select series_id, {_r('jitter_abs jitter_pct')} from ({_JITTER})", _MOVED.format(src="series_ev")))
def w1(spark, folder):
    return rounded(SR.jitter(V.series_ev(spark, folder)).select(
        "series_id", "jitter_abs", "jitter_pct"))


@query("w2_rap_ddp", with_views(
    "series_ev", f"select series_id, {_r('rap ddp')} from ({_JITTER})", _MOVED.format(src="series_ev")))
def w2(spark, folder):
    return rounded(SR.jitter(V.series_ev(spark, folder)).select("series_id", "rap", "ddp"))


@query("w3_ppq", with_views(
    "series_ev", f"select series_id, {_r('ppq')} from ({_JITTER})", _MOVED.format(src="series_ev")))
def w3(spark, folder):
    return rounded(SR.jitter(V.series_ev(spark, folder)).select("series_id", "ppq"))


@query("w4_shimmer", with_views(
    "voiced_ev", f"select series_id, {_r('shimmer_local shimmer_db')} from ({_SHIMMER})", _MOVED.format(src="voiced_ev")))
def w4(spark, folder):
    return rounded(SR.shimmer(stored(V.series_ev, spark, folder)).select(
        "series_id", "shimmer_local", "shimmer_db"))


@query("w5_apq_dda", with_views(
    "voiced_ev", f"select series_id, {_r('apq3 apq5 apq11 dda')} from ({_SHIMMER})", _MOVED.format(src="voiced_ev")))
def w5(spark, folder):
    return rounded(SR.shimmer(stored(V.series_ev, spark, folder)).select(
        "series_id", "apq3", "apq5", "apq11", "dda"))


@query("p3_voiced_mask", with_views("series_ev", """
    select series_id, row_number() over (partition by series_id order by t) - 1 as t, x from (
      select series_id, t, case when t % 7 = 3 then 'nan'::double when t % 11 = 5 then 'inf'::double when t % 13 = 1 then -x else x end as x from series_ev)
    where not isnan(x) and not isinf(x) and x > 0"""))
def p3(spark, folder):
    x = (
        F.when(c("t") % 7 == 3, float("nan")).when(c("t") % 11 == 5, float("inf"))
        .when(c("t") % 13 == 1, -c("x")).otherwise(c("x"))
    )
    return SR.voiced(V.series_ev(spark, folder).withColumn("x", x))


@query("p4_positive_amplitudes", with_views("signal_ev", """
    select series_id, row_number() over (partition by series_id order by t) - 1 as t, x from signal_ev where x > 0"""))
def p4(spark, folder):
    return SR.voiced(V.signal_ev(spark, folder))


L, H = 16, 8
FRAMES_SQL = f"""framed as (select series_id, f as frame, t - f * {H} as pos, x
    from signal_ev, unnest(range(greatest(0, ceil((t - {L} + 1) / {H})::bigint), t // {H} + 1)) u(f)),
  whole as (select series_id, frame from framed group by series_id, frame having count(*) = {L}),
  fr as (select framed.* from framed join whole using (series_id, frame)),
  energy as (select series_id, frame, sqrt(avg(x * x)) as rms from fr group by series_id, frame)"""


@query("g1_framing", with_views("signal_ev", "select series_id, frame, pos, x from fr", FRAMES_SQL))
def g1(spark, folder):
    return FR.frames(V.signal_ev(spark, folder), L, H).select(
        "series_id", "frame", F.posexplode("xs").alias("pos", "x")
    ).withColumn("pos", c("pos").cast("long"))


@query("g2_frame_energy", with_views("signal_ev", """
    select series_id, frame, round(rms, 6) as rms, round(avg(rms) over (partition by series_id), 6) as mean_energy from energy""", FRAMES_SQL))
def g2(spark, folder):
    from timbrel.operators.ordered import with_stats

    e = materialise(FR.frame_rms(V.signal_ev(spark, folder), L, H))
    return rounded(with_stats(e, ["series_id"], {"mean_energy": F.avg("rms")}))


# per-frame flag used by the run queries: energy above the series' mean
_ACTIVE = FRAMES_SQL + """,
  flagged as (select series_id, frame, rms > avg(rms) over (partition by series_id) as active from energy),
  runs as (select series_id, min(frame) as s, max(frame) as e, count(*) as n from (
     select series_id, frame, frame - row_number() over (partition by series_id order by frame) as g from flagged where active) group by series_id, g)"""


def _flagged(spark, folder):
    from timbrel.operators.ordered import with_stats

    e = materialise(FR.frame_rms(V.signal_ev(spark, folder), L, H))
    return with_stats(e, ["series_id"], {"m": F.avg("rms")}).withColumn(
        "active", c("rms") > c("m")
    )


@query("w6_longest_active_run", with_views("signal_ev", f"""
    select n.series_id, coalesce(b.s * {H}, 0) as start, coalesce(b.e * {H} + {L}, n.n) as "end"
    from (select series_id, count(*) as n from signal_ev group by series_id) n
    left join (select * from runs qualify row_number() over (partition by series_id order by n desc, s) = 1) b using (series_id)""", _ACTIVE))
def w6(spark, folder):
    return FR.longest_active(V.signal_ev(spark, folder), _flagged(spark, folder), L, H)


@query("w7_edge_trim", with_views("signal_ev", f"""
    select g.series_id, g.t, g.x from gated g join (
      select series_id, min(frame) * {H} as s, max(frame) * {H} + {L} as e from (
        select series_id, frame, rms, max(rms) over (partition by series_id) as pk from (
          select series_id, frame, sqrt(avg(x * x)) as rms from gfr group by series_id, frame having count(*) = {L}))
      where rms > pk * pow(10, -30 / 20.0) group by series_id) b on g.series_id = b.series_id and g.t >= b.s and g.t < b.e""",
    f"""gated as (select series_id, t, case when t between 20 and 35 then x else x * 0.0001::double end as x from signal_ev),
    gfr as (select series_id, f as frame, x from gated, unnest(range(greatest(0, ceil((t - {L} + 1) / {H})::bigint), t // {H} + 1)) u(f))"""))
def w7(spark, folder):
    s = stored(V.signal_ev, spark, folder).withColumn(
        "x", F.when(c("t").between(20, 35), c("x")).otherwise(c("x") * 0.0001)
    )
    return FR.cut(s, FR.trim_bounds(s, L, H))


@query("w8_peak_normalise", with_views("signal_ev", """
    select series_id, t, round(x / max(abs(x)) over (partition by series_id) * 0.95::double, 6) as x from signal_ev"""))
def w8(spark, folder):
    return rounded(FR.peak_normalise(V.signal_ev(spark, folder)))


@query("w9_running_profile", with_views("series_ev", """
    select series_id, t, round(sum(x - m) over (partition by series_id order by t) + 3.3e-8, 6) as y
    from (select *, avg(x) over (partition by series_id) as m from series_ev)"""))
def w9(spark, folder):
    # means of two-decimal values end in exact halves; the nudge keeps ties out of rounding
    y = SR.profile(stored(V.series_ev, spark, folder)).drop("n")
    return rounded(y.withColumn("y", c("y") + 3.3e-8))


SPECTRUM_SQL = FRAMES_SQL + f""",
  spec as (select series_id, frame, b as bin,
      sqrt(pow(sum(x * w * cos(2 * pi() * b * pos / {L})), 2) + pow(sum(x * w * sin(2 * pi() * b * pos / {L})), 2)) as mag
    from (select *, 0.5 - 0.5 * cos(2 * pi() * pos / {L}) as w from fr), unnest(range({L // 2 + 1})) u(b)
    group by series_id, frame, b)"""
RATE = 1000.0


def _spectrum(spark, folder):
    return SP.spectrogram(V.signal_ev(spark, folder), L, H)


@query("w11_rolloff", with_views("signal_ev", """
    select series_id, frame, min(bin) as bin from (select *, sum(mag) over (partition by series_id, frame order by bin) as run,
      sum(mag) over (partition by series_id, frame) as total from spec) where run >= total * 0.85::double group by series_id, frame""", SPECTRUM_SQL))
def w11(spark, folder):
    return _spectrum(spark, folder).select("series_id", "frame", SP.rolloff_bin().alias("bin"))


@query("w15_delay_vectors", with_views("series_ev", """
    select series_id, t, a, b, c from (select series_id, t, x as a, lead(x, 1) over w as b, lead(x, 2) over w as c
      from series_ev window w as (partition by series_id order by t)) where c is not null"""))
def w15(spark, folder):
    return SR.delay_vectors(V.series_ev(spark, folder))


@query("w16_zero_crossings", with_views("signal_ev", """
    select series_id, round(avg(case when (x < 0) <> (px < 0) then 1.0 when px is not null then 0.0 end), 6) as zcr
    from (select *, lag(x) over (partition by series_id order by t) as px from signal_ev) group by series_id"""))
def w16(spark, folder):
    return rounded(SR.crossing_rate(V.signal_ev(spark, folder)))


@query("w17_peaks_to_cycles", with_views("signal_ev", """
    select series_id, row_number() over w - 1 as i, round((lead(t) over w - t) / 1000.0, 6) as period, amplitude from (
      select series_id, t, x as amplitude, count(*) over (partition by series_id) as n from (
        select *, lag(x) over (partition by series_id order by t) as px, lead(x) over (partition by series_id order by t) as nx,
          max(x) over (partition by series_id order by t rows between 2 preceding and 2 following) as top,
          min(x) over (partition by series_id order by t rows between 2 preceding and 2 following) as low from signal_ev)
      where x > px and x >= nx and x = top and x - low >= 0.01) where n >= 5
    window w as (partition by series_id order by t)"""))
def w17(spark, folder):
    return rounded(SR.cycles(V.signal_ev(spark, folder), 1000.0, 400.0), "amplitude")


@query("w19_chunk_assembly", """
    select conv_id, off + p as t, len(w[p + 1])::bigint as x from (
      select conv_id, w, coalesce(sum(len(w)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as off
      from (select conv_id, turn, string_split(text, ' ') as w from conversations)), unnest(range(len(w))) u(p)""")
def w19(spark, folder):
    chunks = V.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
        .alias("samples"),
    )
    return FR.assemble_chunks(chunks, ["conv_id"], "turn", "samples")


# --- aggregates of series --------------------------------------------------------------------


@query("a13_contour_stats", with_views("signal_ev", """
    select series_id, round(coalesce(avg(x) filter (x > 0), 0) + 3.3e-8, 6) as fo_mean, round(coalesce(max(x) filter (x > 0), 0), 6) as fhi,
           round(coalesce(min(x) filter (x > 0), 0), 6) as flo from signal_ev group by series_id"""))
def a13(spark, folder):
    stats = SR.contour_stats(V.signal_ev(spark, folder))
    return rounded(stats.withColumn("fo_mean", c("fo_mean") + 3.3e-8))


def entropy_sql(top: str, source: str) -> str:
    """Entropy with explicit empty bins. ``source``: series_id, n, bins, width, bin, cnt."""
    return f"""select series_id, greatest(0, least(1, sum(-p * log2(p)) / {top})) as e from (
        select series_id, d / sum(d) over (partition by series_id) as p from (
          select g.series_id, coalesce(h.cnt, 0) / (g.n * g.width) + 1e-10 as d from (
            select s.series_id, s.n, s.width, b from (select distinct series_id, n, bins, width from {source}) s, unnest(range(bins::bigint)) u(b)) g
          left join {source} h on g.series_id = h.series_id and g.b = h.bin)) group by series_id"""


@query("a14_period_entropy", with_views("series_ev", f"""
    select k.series_id, round(coalesce(e.e, 0), 6) as ppe from (select distinct series_id from series_ev) k
    left join ({entropy_sql('log2(100)', 'hist')}) e using (series_id)""",
    """lp as (select series_id, log2((1 / x) / avg(1 / x) over (partition by series_id)) as v, count(*) over (partition by series_id) as n from series_ev where x > 0),
    lim as (select series_id, n, v, min(v) over (partition by series_id) as lo, max(v) over (partition by series_id) as hi from lp where n >= 10),
    hist as (select series_id, n, 100 as bins, (hi - lo) / 100 as width, least(floor((v - lo) / ((hi - lo) / 100)), 99) as bin, count(*) as cnt
      from lim group by all)"""))
def a14(spark, folder):
    return rounded(SR.period_entropy(stored(V.series_ev, spark, folder)))


_Z = "z as (select series_id, t, (x - avg(x) over (partition by series_id)) / (stddev_pop(x) over (partition by series_id) + 1e-8) as v from {src})"
_REC = "rec as (select a.series_id, a.t, min(b.t - a.t) as length from z a join z b on a.series_id = b.series_id and b.t > a.t and abs(b.v - a.v) < 0.5 group by a.series_id, a.t)"


@query("j7_first_recurrence", with_views(
    "series_ev", "select series_id, t, length from rec",
    _Z.format(src="series_ev") + ", " + _REC))
def j7(spark, folder):
    return SR.first_recurrence(stored(V.series_ev, spark, folder)).select("series_id", "t", "length")


@query("a15_recurrence_entropy", with_views("series_li", f"""
    select k.series_id, round(coalesce(e.e, 0.5), 6) as rpde from (select distinct series_id from series_li) k
    left join ({entropy_sql('log2(30)', 'hist')}) e using (series_id)""",
    _Z.format(src="series_li") + ", " + _REC + """,
    lim as (select series_id, length, count(*) over w as n, min(length) over w as lo, max(length) over w as hi from rec
       window w as (partition by series_id)),
    sized as (select *, least(30, n // 2 + 1) as bins from lim where n >= 5 and series_id in (select series_id from series_li group by series_id having count(*) >= 20)),
    hist as (select series_id, n, bins, (hi - lo) / bins as width, least(floor((length - lo) / ((hi - lo) / bins)), bins - 1) as bin, count(*) as cnt from sized group by all)"""))
def a15(spark, folder):
    return rounded(SR.recurrence_entropy(stored(V.series_li, spark, folder)))


@query("a16_noise_floor", with_views("signal_ev", """
    select series_id, round(avg(rms), 6) as floor from (select *, row_number() over (partition by series_id order by rms) as rn,
      count(*) over (partition by series_id) as n from energy) where rn <= greatest(1, floor(0.1 * n)) group by series_id""", FRAMES_SQL))
def a16(spark, folder):
    return rounded(FR.noise_floor(FR.frame_rms(V.signal_ev(spark, folder), L, H)))


_LEVELS = """, fl as (select series_id, avg(rms) as floor from (select *, row_number() over (partition by series_id order by rms) as rn,
      count(*) over (partition by series_id) as n from energy) where rn <= greatest(1, floor(0.1 * n)) group by series_id),
    lev as (select series_id, floor, avg(case when rms > greatest(3 * floor, 0.005) then 1.0 else 0.0 end) * 100 as coverage,
      avg(case when rms > greatest(3 * floor, 0.005) then rms end) as sp, max(rms) as peak from energy join fl using (series_id) group by all),
    levels as (select series_id, floor, coverage, 100 - coverage as silence, greatest(0, least(100, floor / case when peak > 0 then peak else 1e-10 end * 100)) as noise_pct,
      case when floor > 0 then greatest(0, least(60, 20 * log10(coalesce(sp, peak) / floor))) else 40 end as snr, peak from lev)"""


@query("a17_speech_levels", with_views(
    "signal_ev", f"select series_id, {_r('floor coverage silence noise_pct snr peak')} from levels",
    FRAMES_SQL + _LEVELS))
def a17(spark, folder):
    return rounded(FR.speech_levels(FR.frame_rms(V.signal_ev(spark, folder), L, H)))


@query("a18_clipping_ratio", with_views("signal_ev", """
    select series_id, round(avg(case when abs(x) >= 0.99 then 1.0 else 0.0 end), 6) as clip_ratio,
           avg(case when abs(x) >= 0.99 then 1.0 else 0.0 end) > 0.001 as clipped from signal_ev group by series_id"""))
def a18(spark, folder):
    return rounded(FR.clipping(V.signal_ev(spark, folder)))


@query("a19_silent_series", with_views("signal_ev", """
    select series_id, max(abs(x * case when series_id % 5 = 0 then 0.00001 else 1 end)) < 1e-4 as silent from signal_ev group by series_id"""))
def a19(spark, folder):
    s = V.signal_ev(spark, folder).withColumn(
        "x", c("x") * F.when(c("series_id") % 5 == 0, 0.00001).otherwise(1.0)
    )
    return FR.silent(s)


@query("a20_spread_measures", with_views("voiced_ev", """
    select series_id, round(case when n < 10 then -5 else greatest(-8, least(-2, 3 * (p25 - ml))) end, 6) as spread1,
      round(case when n < 10 then 0.2 else greatest(0.001, least(0.5, cv)) end, 6) as spread2
    from (select series_id, count(*) as n, quantile_cont(ln(x + 1e-8), 0.25) as p25, avg(ln(x + 1e-8)) as ml, stddev_pop(x) / (avg(x) + 1e-8) as cv from voiced_ev group by series_id)"""))
def a20(spark, folder):
    return rounded(SR.spread(stored(V.series_ev, spark, folder)))


@query("a12_exact_quantiles", with_views("series_li", """
    select series_id, round(quantile_cont(x, 0.05), 6) as p05, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as p50 from series_li group by series_id"""))
def a12(spark, folder):
    s = V.series_li(spark, folder)
    return rounded(quantiles(s, ["series_id"], "x", {"p05": 0.05, "p25": 0.25, "p50": 0.5}))


_PAIRS = """dv as (select series_id, t, x as a, lead(x, 1) over w as b, lead(x, 2) over w as c, count(*) over (partition by series_id) - 2 as n
      from voiced_ev window w as (partition by series_id order by t)),
    kk as (select distinct series_id, n, unnest(range(least(500, n * (n - 1) // 2))) as k from dv where n >= 2),
    u1 as (select *, (k + 1) * 48271 % 2147483647 as u, (k + 1) * 40692 % 2147483647 as w from kk),
    u2 as (select *, u * u % 2147483647 as p, (w * w + w) % 2147483647 as q from u1),
    ij as (select series_id, k, (p * 2147483648 + p * 69621 % 2147483647) % n as i, (q * 2147483648 + q * 69621 % 2147483647) % n as j from u2),
    pd as (select ij.series_id, k, sqrt(pow(l.a - r.a, 2) + pow(l.b - r.b, 2) + pow(l.c - r.c, 2)) as dist
      from ij join dv l on ij.series_id = l.series_id and ij.i = l.t join dv r on ij.series_id = r.series_id and ij.j = r.t where i <> j)"""


@query("j9_sampled_pair_distances", with_views(
    "voiced_ev", "select series_id, k, round(dist, 6) as dist from pd", _PAIRS))
def j9(spark, folder):
    pairs = SR.sampled_pairs(
        materialise(SR.delay_vectors(SR.voiced(V.series_ev(spark, folder)))))
    return rounded(pairs.withColumnRenamed("_k", "k"))


@query("a21_correlation_dimension", with_views("voiced_ev", """
    select s.series_id, round(case when s.n >= 30 and d.s is not null then greatest(1, least(4, d.s)) else 2.3 end, 6) as d2
    from (select series_id, count(*) filter (x > 0) as n from series_ev group by series_id) s left join (
      select series_id, regr_slope(ln(cr), ln(r + 1e-10)) as s from (
        select q.series_id, q.r, avg(case when pd.dist < q.r then 1.0::double else 0.0 end) + 1e-10 as cr from (
          select series_id, unnest(range(1, 6)) as pi, unnest(quantile_cont(dist, [0.1, 0.2, 0.3, 0.4, 0.5])) as r from pd group by series_id having count(*) >= 20) q
        join pd on q.series_id = pd.series_id group by q.series_id, q.pi, q.r) group by series_id having min(r) > 0) d using (series_id)""", _PAIRS))
def a21(spark, folder):
    return rounded(SR.correlation_dimension(stored(V.series_ev, spark, folder)))


@query("a22_detrended_fluctuation", with_views("series_li", """
    select k.series_id, round(case when a is null then 0.7 else greatest(0.1, least(2, a)) end, 6) as dfa from (select distinct series_id from series_li) k left join (
      select series_id, regr_slope(ln(f + 1e-10), ln(box)) as a from (
        select series_id, box, avg(sqrt(greatest(0, syy - sxy * sxy / sxx) / box)) as f from (
          select series_id, box, t // box as k, regr_syy(y, t % box) as syy, regr_sxy(y, t % box) as sxy, regr_sxx(y, t % box) as sxx
          from (select y.*, b.box from y join boxes b using (series_id) where b.box >= 2 and n // b.box >= 2 and t // b.box < n // b.box)
          group by series_id, box, t // box) group by series_id, box) group by series_id having count(*) >= 4) d using (series_id)""",
    """y as (select series_id, t, n, sum(x - m) over (partition by series_id order by t) as y from (
        select *, avg(x) over (partition by series_id) as m, count(*) over (partition by series_id) as n from series_li)),
    boxes as (select distinct series_id, round_even(pow(10, log10(4) + i * (log10(n // 4) - log10(4)) / 11), 0)::bigint as box
      from (select distinct series_id, n from y where n >= 30), unnest(range(12)) u(i))"""))
def a22(spark, folder):
    return rounded(SR.fluctuation(stored(V.series_li, spark, folder)))


@query("a25_ambient_calibration", with_views("signal_ev", """
    select series_id, round(avg(r), 6) as level, avg(r) > 0.05 as warn from (
      select series_id, t // 8 as b, sqrt(avg(x * x)) as r from signal_ev group by series_id, t // 8 having count(*) = 8) group by series_id"""))
def a25(spark, folder):
    return rounded(FR.ambient_noise(V.signal_ev(spark, folder), 8))


@query("a27_duration", with_views("series_ev", """
    select series_id, round_even(count(*) / 16.0 * 10, 0) / 10 as seconds from series_ev group by series_id"""))
def a27(spark, folder):
    return FR.duration(V.series_ev(spark, folder), 16.0)


# --- spectra --------------------------------------------------------------------------------


@query("g3_spectrogram_flatness", with_views("signal_ev", """
    select series_id, frame, round(sum(mag), 6) as total, round(max(mag), 6) as top,
      round(exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag)), 6) as flatness from spec group by series_id, frame""", SPECTRUM_SQL))
def g3(spark, folder):
    return rounded(_spectrum(spark, folder).select(
        "series_id", "frame", SP.total(c("mags")).alias("total"),
        F.array_max("mags").alias("top"), SP.flatness().alias("flatness"),
    ))


@query("g4_centroid_bandwidth", with_views("signal_ev", f"""
    select series_id, round(avg(ce), 6) as centroid, round(avg(bw), 6) as bandwidth from (
      select series_id, frame, any_value(ce) as ce, sqrt(sum(mag * pow(hz - ce, 2)) / sum(mag)) as bw from (
        select *, bin * {RATE} / {L} as hz, sum(mag * bin * {RATE} / {L}) over (partition by series_id, frame) / sum(mag) over (partition by series_id, frame) as ce from spec)
      group by series_id, frame) group by series_id""", SPECTRUM_SQL))
def g4(spark, folder):
    s = _spectrum(spark, folder).withColumn("cb", SP.centroid_bandwidth("mags", L, RATE))
    return rounded(s.groupBy("series_id").agg(
        F.avg("cb.centroid").alias("centroid"), F.avg("cb.bandwidth").alias("bandwidth")))


@query("g5_noise_gate", with_views("signal_ev", """
    select series_id, frame, spec.bin, round(case when mag > lim then mag else mag * 0.15::double end, 6) as mag from spec join (
      select series_id, bin, avg(mag) + 2 * stddev_pop(mag) as lim from spec where frame < 3 group by series_id, bin) using (series_id, bin)""", SPECTRUM_SQL))
def g5(spark, folder):
    return rounded(SP.noise_gate(_spectrum(spark, folder), 3).select(
        "series_id", "frame", F.posexplode("mags").alias("bin", "mag")))


@query("g6_activity_mask", with_views("signal_ev", """
    select series_id, frame, rms > 0.015 and flat < 0.15 as active from energy join (
      select series_id, frame, exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag)) as flat from spec group by series_id, frame) using (series_id, frame)""", SPECTRUM_SQL))
def g6(spark, folder):
    return SP.activity(_spectrum(spark, folder)).select("series_id", "frame", "active")


N_MEL, N_CEP = 6, 5
MEL = SP.mel_weights(N_MEL, L, 16000.0)
CLASSES = SP.pitch_class_weights(L, 16000.0)


def _weights_sql(name: str, rows) -> str:
    cells = ", ".join(f"({i}, {j}, {v!r})" for i, r in enumerate(rows) for j, v in enumerate(r))
    return f"{name}(o, i, w) as (select o, i, w::double from (values {cells}) v(o, i, w))"


@query("g7_filter_banks", with_views("signal_ev", """
    select series_id, 'cepstrum' as bank, o::bigint as i, round(avg(v), 6) as mean from (
      select series_id, frame, d.o, sum(lg * w) as v from (
        select series_id, frame, mel.o as i, 10 * log10(greatest(1e-10, sum(mag * mag * w))) as lg from spec join mel on spec.bin = mel.i group by series_id, frame, mel.o) l
      join dct d using (i) group by series_id, frame, d.o) group by series_id, o
    union all
    select series_id, 'pitch_class', o::bigint, round(avg(v / case when top > 0 then top else 1 end), 6) from (
      select *, max(v) over (partition by series_id, frame) as top from (
        select series_id, frame, cls.o, sum(mag * mag * w) as v from spec join cls on spec.bin = cls.i group by series_id, frame, cls.o))
    group by series_id, o""", SPECTRUM_SQL + ", " + _weights_sql("mel", MEL) + ", "
    + _weights_sql("dct", SP.cosine_basis(N_CEP, N_MEL)) + ", " + _weights_sql("cls", CLASSES)))
def g7(spark, folder):
    s = _spectrum(spark, folder).select(
        "series_id",
        F.explode(F.array(
            F.struct(F.lit("cepstrum").alias("bank"), SP.cepstrum("mags", MEL, N_CEP).alias("v")),
            F.struct(F.lit("pitch_class").alias("bank"),
                     SP.pitch_classes("mags", CLASSES).alias("v")),
        )).alias("b"),
    ).select("series_id", "b.*")
    return rounded(SP.pool(s, "v", "mean", ("series_id", "bank")))


_ACF = """acf as (select a.series_id, b.t - a.t as lag, sum(a.x * b.x) as r from {src} a join {src} b
      on a.series_id = b.series_id and b.t - a.t between 0 and 19 group by a.series_id, b.t - a.t)"""
_HNR = """select series_id, case when fb then 15 when r > 0 then greatest(0, least(40, 10 * log10(r / (r0 - r)))) else 0 end as hnr,
      case when fb then 0.03 when r = 0 then 10 else greatest(0.001, least(10, (r0 - r) / r)) end as nhr
    from (select *, least(n, 20) <= 13 or r0 <= 0 or r0 - r <= 0 as fb from (
      select series_id, max(r) filter (lag = 0) as r0, max(r) filter (lag between 2 and 12) as r from acf group by series_id)
    join (select series_id, count(*) as n from {src} group by series_id) using (series_id))"""


@query("g8_harmonicity", with_views(
    "series_li", f"select series_id, {_r('hnr nhr')} from ({_HNR.format(src='series_li')})",
    _ACF.format(src="series_li")))
def g8(spark, folder):
    return rounded(SP.harmonicity(stored(V.series_li, spark, folder), 1000))


@query("g9_difference_pitch", with_views("signal_ev", """
    select series_id, frame, round(1000.0 / coalesce(min(lag) filter (v < 0.1), arg_min(lag, v)), 6) as f0 from (
      select series_id, frame, lag, coalesce(d * lag / nullif(sum(d) over (partition by series_id, frame order by lag), 0), 1) as v from (
        select a.series_id, a.frame, b.pos - a.pos as lag, sum(pow(a.x - b.x, 2)) as d from pf a join pf b
          on a.series_id = b.series_id and a.frame = b.frame and a.pos < 12 and b.pos - a.pos between 1 and 13 group by a.series_id, a.frame, b.pos - a.pos))
    where lag >= 2 group by series_id, frame""",
    """pf0 as (select series_id, f as frame, t - f * 8 as pos, x from signal_ev, unnest(range(greatest(0, ceil((t - 25 + 1) / 8)::bigint), t // 8 + 1)) u(f)),
    pf as (select * from pf0 join (select series_id, frame from pf0 group by series_id, frame having count(*) = 25) using (series_id, frame))"""))
def g9(spark, folder):
    return rounded(SP.pitch(V.signal_ev(spark, folder), 1000.0, 12, 8))


@query("g10_resample", with_views("signal_ev", """
    select series_id, g, round(x + (coalesce(nx, x) - x) * (g * 3 / 2.0 - t), 6) as x from (
      select *, lead(x) over (partition by series_id order by t) as nx, max(t) over (partition by series_id) as last from signal_ev) s
    join unnest(range(100000)) u(g) on floor(g * 3 / 2.0) = t where g * 3 / 2.0 <= last"""))
def g10(spark, folder):
    return rounded(SR.resample(V.signal_ev(spark, folder), 3, 2))


@query("j10_asof_lookup", """
    select s.user_id as series_id, s.event_id, s.us, coalesce(m.us, f.us) as mark_us, coalesce(m.value, f.value) as period
    from (select *, epoch_us(ts) as us from events) s
    asof left join (select user_id, epoch_us(ts) as us, value from events where event_type = 'error') m on s.user_id = m.user_id and s.us >= m.us
    left join (select user_id, min(epoch_us(ts)) as us, arg_min(value, ts) as value from events where event_type = 'error' group by user_id) f on s.user_id = f.user_id""")
def j10(spark, folder):
    e = V.table(spark, folder, "events").select(
        c("user_id").alias("series_id"), "event_id", V.micros("ts").alias("us"),
        c("value").alias("period"), "event_type",
    )
    marks = e.filter("event_type = 'error'").select("series_id", "us", "period")
    return SR.asof_lookup(
        e.select("series_id", "event_id", "us"), marks, ["series_id"], "us", ["period"],
        V.minute_block(),
    )


_ALL = "jitter_abs jitter_pct rap ppq ddp shimmer_local shimmer_db apq3 apq5 apq11 dda fo_mean fhi flo ppe rpde dfa d2 spread1 spread2 hnr nhr energy centroid bandwidth zcr"


def feature_row(contour, signal, rate: float, n_fft: int, hop: int):
    """All scalar measures of a series in one row."""
    spec = SP.spectrogram(signal, n_fft, hop).withColumn(
        "cb", SP.centroid_bandwidth("mags", n_fft, rate)
    ).groupBy("series_id").agg(
        F.avg("rms").alias("energy"), F.avg("cb.centroid").alias("centroid"),
        F.avg("cb.bandwidth").alias("bandwidth"),
    )
    clean = materialise(SR.voiced(contour))
    parts = [
        SR.shimmer(clean), SR.contour_stats(contour), SR.period_entropy(clean),
        SR.recurrence_entropy(clean, clean=True), SR.fluctuation(clean, clean=True),
        SR.correlation_dimension(clean, clean=True), SR.spread(clean),
        SP.harmonicity(signal, int(rate)), spec, SR.crossing_rate(signal),
    ]
    out = SR.jitter(contour)
    for part in parts:
        out = out.join(part, "series_id", "left")
    # fixed values: harmonicity of a series without pitch
    pitched = F.coalesce(c("fo_mean"), F.lit(0.0)) > 0
    out = out.withColumns({
        "hnr": F.when(pitched, c("hnr")).otherwise(0.0), "nhr": F.when(pitched, c("nhr")).otherwise(99.0),
    })
    # fixed values: what a series without voiced samples or without a whole frame gets
    return out.na.fill({"rpde": 0.5, "dfa": 0.7, "d2": 2.3}).na.fill(0.0)


def _on(sql: str, view: str, other: str) -> str:
    """A twin over another view: its own views, then the wanted one under the old name."""
    body = sql.split(f"{view} as (", 1)[1]
    depth, at = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(body[at], 0)
        at += 1
    return with_views(other, "", f"{view} as (select * from {other})") + body[at:]


def _feature_sql() -> str:
    contour = with_views("series_ev", """
        select series_id, round(avg(x) filter (x > 0), 6) as fo_mean, round(max(x) filter (x > 0), 6) as fhi,
          round(min(x) filter (x > 0), 6) as flo from series_ev group by series_id""")
    parts = {
        "j": SQL["w1_jitter"], "r": SQL["w2_rap_ddp"], "q": SQL["w3_ppq"],
        "s": SQL["w4_shimmer"], "a": SQL["w5_apq_dda"],
        "f": contour,
        "p": SQL["a14_period_entropy"],
        "e": _on(SQL["a15_recurrence_entropy"], "series_li", "voiced_ev"),
        "d": _on(SQL["a22_detrended_fluctuation"], "series_li", "voiced_ev"),
        "c": SQL["a21_correlation_dimension"], "v": SQL["a20_spread_measures"],
        "h": f"select series_id, case when fo_mean > 0 then hnr else 0 end as hnr, case when fo_mean > 0 then nhr else 99 end as nhr "
             f"from ({_on(SQL['g8_harmonicity'], 'series_li', 'signal_ev')}) join ({contour}) using (series_id)",
        "m": with_views("signal_ev", """
            select series_id, round(avg(rms), 6) as energy from energy group by series_id""", FRAMES_SQL),
        "b": SQL["g4_centroid_bandwidth"], "z": SQL["w16_zero_crossings"],
    }
    joined = " join ".join(
        f"({sql}) {n}" + (" using (series_id)" if n != "j" else "") for n, sql in parts.items()
    )
    return f"select series_id, {', '.join(_ALL.split())} from {joined}"


@query("g11_feature_row", _feature_sql())
def g11(spark, folder):
    contour = materialise(V.series_ev(spark, folder))
    signal = materialise(V.signal_ev(spark, folder))
    return rounded(feature_row(contour, signal, RATE, L, H).select("series_id", *_ALL.split()))
