"""What the registered queries return, as SQL for another engine, written apart from the operators.

Windows, tapers and wavelets are formulas or inlined as VALUES; every double is rounded as the query
rounds it, and 0.0 is added so that no negative zero is left.
"""

from __future__ import annotations

import cmath
import math

from covaria.functions import windows

ORACLES: dict[str, str] = {}


def _r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"


DAYS = """
cell AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(hour(ts) AS INT) AS t, sum(value) AS v FROM events GROUP BY ALL),
nm AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS ch FROM (SELECT DISTINCT event_type FROM events)),
sig AS (SELECT CAST(date_diff('day', DATE '1970-01-01', d.day) AS BIGINT) AS epoch, nm.ch, CAST(r.t AS INT) AS t, coalesce(cell.v, 0.0) AS value
        FROM (SELECT DISTINCT day FROM cell) d CROSS JOIN nm CROSS JOIN (SELECT unnest(range(24)) AS t) r
        LEFT JOIN cell ON cell.day = d.day AND cell.event_type = nm.event_type AND cell.t = r.t)"""


def _fourier(source: str = "sig", n: int = 24, low: int = 1, high: int = 11, name: str = "sp") -> str:
    angle = f"2 * pi() * b.k * s.t / {n}"
    return f"""
{name}c AS (SELECT epoch, ch, t, (value - avg(value) OVER (PARTITION BY epoch, ch)) * (0.5 - 0.5 * cos(2 * pi() * t / {n - 1})) AS c FROM {source}),
{name} AS (SELECT s.epoch, s.ch, CAST(b.k AS INT) AS f, sum(s.c * cos({angle})) AS re, -sum(s.c * sin({angle})) AS im
           FROM {name}c s CROSS JOIN (SELECT unnest(range({low}, {high + 1})) AS k) b GROUP BY ALL)"""


def _pairs(spectra: str = "sp", extra: str = "", every: bool = False, name: str = "x") -> str:
    more = "".join(f", a.{c}" for c in extra.split())
    on = "".join(f" AND a.{c} = b.{c}" for c in extra.split())
    return f"""
{name} AS (SELECT a.epoch, a.ch AS seed, b.ch AS target, a.f{more}, 2 * (a.re * b.re + a.im * b.im) AS re, 2 * (a.im * b.re - a.re * b.im) AS im,
             2 * (a.re * a.re + a.im * a.im) AS pxx, 2 * (b.re * b.re + b.im * b.im) AS pyy
      FROM {spectra} a JOIN {spectra} b ON a.epoch = b.epoch AND a.f = b.f{on}{"" if every else " AND a.ch > b.ch"})"""


_U = "sqrt(re * re + im * im)"
MEASURES = {
    "coh": "sqrt(avg(re) ** 2 + avg(im) ** 2) / sqrt(avg(pxx) * avg(pyy))",
    "imcoh": "avg(im) / sqrt(avg(pxx) * avg(pyy))",
    "plv": f"sqrt(avg(re / {_U}) ** 2 + avg(im / {_U}) ** 2)",
    "ciplv": f"abs(avg(im / {_U})) / sqrt(1 - avg(re / {_U}) ** 2)",
    "ppc": f"(sum(re / {_U}) ** 2 + sum(im / {_U}) ** 2 - count(*)) / (count(*) * (count(*) - 1.0::DOUBLE))",
    "pli": "abs(avg(sign(im)))",
    "pli2_unbiased": "(count(*) * avg(sign(im)) ** 2 - 1) / (count(*) - 1.0::DOUBLE)",
    "dpli": "avg(CASE WHEN im > 0 THEN 1.0::DOUBLE WHEN im = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)",
    "wpli": "abs(sum(im)) / sum(abs(im))",
    "wpli2_debiased": "(sum(im) ** 2 - sum(im * im)) / (sum(abs(im)) ** 2 - sum(im * im))",
}
COHY = [_r("avg(re) / sqrt(avg(pxx) * avg(pyy))", "cohy_re"), _r("avg(im) / sqrt(avg(pxx) * avg(pyy))", "cohy_im")]
SPECTRA = f"WITH {DAYS}, {_fourier()}"
CROSS = f"{SPECTRA}, {_pairs()}"

for _m, _sql in MEASURES.items():
    ORACLES[_m] = f"{CROSS} SELECT seed, target, f, {_r(_sql, _m)} FROM x GROUP BY ALL"
ORACLES["cohy"] = f"{CROSS} SELECT seed, target, f, {', '.join(COHY)} FROM x GROUP BY ALL"
ORACLES["all_measures"] = f"{CROSS} SELECT seed, target, f, {', '.join(_r(s, m) for m, s in MEASURES.items())} FROM x GROUP BY ALL"
ORACLES["custom_measure"] = f"{CROSS} SELECT seed, target, f, {_r(f'avg(re / {_U}) / sqrt(avg(re / {_U}) ** 2 + avg(im / {_U}) ** 2)', 'phase_cosine')} FROM x GROUP BY ALL"
ORACLES["coh_stream"] = ORACLES["coh"]
ORACLES["coh_indices"] = f"{SPECTRA}, {_pairs(every=True)} SELECT CAST(con AS INT) AS con, seed, target, f, {_r(MEASURES['coh'], 'coh')} FROM x JOIN (VALUES (0, 0, 1), (1, 3, 2), (2, 0, 1)) e(con, s, t) ON seed = s AND target = t GROUP BY ALL"

# signals, edges, frequencies
ORACLES["signals_dense"] = f"WITH {DAYS} SELECT epoch, ch, t, {_r('value', 'value')} FROM sig"
ORACLES["signals_time_window"] = f"WITH {DAYS} SELECT epoch, ch, CAST(t - 6 AS INT) AS t, {_r('value', 'value')} FROM sig WHERE t BETWEEN 6 AND 18"
ORACLES["signals_drop_bads"] = f"WITH {DAYS} SELECT epoch, ch, t, {_r('value', 'value')} FROM sig WHERE ch NOT IN (1, 3)"
ORACLES["signals_stacked"] = f"WITH {DAYS} SELECT epoch, ch, t, {_r('value', 'value')} FROM sig WHERE ch < 2 UNION ALL SELECT epoch, CAST(ch + 2 AS INT), t, {_r('value', 'value')} FROM sig WHERE ch = 2"
ORACLES["edges_prune_channels"] = f"WITH {DAYS} SELECT epoch, ch, t, {_r('value', 'value')} FROM sig WHERE ch IN (0, 2, 4)"
ORACLES["signals_orders"] = f"""
WITH c AS (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS epoch, o_orderpriority AS p,
                  CAST(date_diff('day', CAST(date_trunc('quarter', o_orderdate) AS DATE), CAST(o_orderdate AS DATE)) AS INT) AS t, o_totalprice AS v FROM orders),
g AS (SELECT epoch, p, t, sum(v) AS v FROM c GROUP BY ALL),
nm AS (SELECT p, CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS ch FROM (SELECT DISTINCT o_orderpriority AS p FROM orders))
SELECT d.epoch, nm.ch, CAST(r.t AS INT) AS t, {_r('coalesce(g.v, 0.0)', 'value', 2)} FROM (SELECT DISTINCT epoch FROM g) d CROSS JOIN nm
CROSS JOIN (SELECT unnest(range(92)) AS t) r LEFT JOIN g ON g.epoch = d.epoch AND g.p = nm.p AND g.t = r.t"""
VECS = """
sig AS (SELECT CAST(vec_id // 4 AS BIGINT) AS epoch, CAST(vec_id % 4 AS INT) AS ch, CAST(unnest(range(64)) AS INT) AS t, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
ORACLES["signals_embeddings"] = f"WITH {VECS} SELECT epoch, ch, t, {_r('value', 'value')} FROM sig"
ORACLES["edges_lower_tri"] = f"WITH {DAYS} SELECT a.ch AS seed, b.ch AS target FROM nm a JOIN nm b ON a.ch > b.ch"
ORACLES["edges_seed_target"] = f"WITH {DAYS} SELECT CAST(row_number() OVER (ORDER BY a.ch, b.ch) - 1 AS INT) AS con, a.ch AS seed, b.ch AS target FROM nm a CROSS JOIN nm b WHERE a.ch < 2 AND b.ch >= 2"
ORACLES["freq_grid"] = "SELECT CAST(k AS INT) AS f, CAST(k AS DOUBLE) AS freq FROM (SELECT unnest(range(13)) AS k)"
ORACLES["freq_mask_bands"] = "SELECT CAST(k AS INT) AS f, CAST(k AS DOUBLE) AS freq FROM (SELECT unnest(range(13)) AS k) WHERE k BETWEEN 2 AND 6 OR k BETWEEN 5 AND 11"
ORACLES["freq_decimate"] = "SELECT CAST(k AS INT) AS f FROM (SELECT unnest(range(13)) AS k) WHERE (k BETWEEN 2 AND 6 OR k BETWEEN 5 AND 11) AND (k - 2) % 3 = 0"
ORACLES["band_nearest"] = "SELECT band, CAST(k AS INT) AS f FROM (SELECT unnest(range(13)) AS k) CROSS JOIN (VALUES (0, 2.2), (1, 6.7), (2, 11.6)) b(band, edge) QUALIFY row_number() OVER (PARTITION BY band ORDER BY abs(k - edge), k) = 1"

# spectra
ORACLES["spectra_fourier"] = f"{SPECTRA} SELECT epoch, ch, f, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM sp"
ORACLES["psd_fourier"] = f"{SPECTRA} SELECT epoch, ch, f, {_r('2 * (re * re + im * im)', 'power', 3)} FROM sp"
ORACLES["csd_fourier"] = f"{CROSS} SELECT epoch, seed, target, f, {_r('re', 're', 3)}, {_r('im', 'im', 3)} FROM x"
_tapers, _ratios = windows.dpss(24, 4.0)
TAPERED = f"""WITH {DAYS}, tp AS (SELECT * FROM (VALUES {", ".join(f"({k}, {t}, {float(v)!r}::DOUBLE, {float(r)!r}::DOUBLE)" for k, (taper, r) in enumerate(zip(_tapers, _ratios, strict=True)) for t, v in enumerate(taper))}) v(taper, t, h, lam)),
cen AS (SELECT epoch, ch, t, value - avg(value) OVER (PARTITION BY epoch, ch) AS c FROM sig),
mt AS (SELECT s.epoch, s.ch, CAST(taper AS INT) AS taper, CAST(b.k AS INT) AS f, any_value(lam) AS lam, sum(s.c * h * cos(2 * pi() * b.k * s.t / 24)) AS re, -sum(s.c * h * sin(2 * pi() * b.k * s.t / 24)) AS im
       FROM cen s JOIN tp USING (t) CROSS JOIN (SELECT unnest(range(1, 12)) AS k) b GROUP BY ALL)"""
ORACLES["spectra_multitaper"] = f"{TAPERED} SELECT epoch, ch, taper, f, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM mt"
ORACLES["coh_multitaper"] = f"""{TAPERED},
x AS (SELECT a.epoch, a.ch AS seed, b.ch AS target, a.f, 2 * sum(a.lam * (a.re * b.re + a.im * b.im)) / sum(a.lam) AS re, 2 * sum(a.lam * (a.im * b.re - a.re * b.im)) / sum(a.lam) AS im,
      2 * sum(a.lam * (a.re * a.re + a.im * a.im)) / sum(a.lam) AS pxx, 2 * sum(a.lam * (b.re * b.re + b.im * b.im)) / sum(a.lam) AS pyy
      FROM mt a JOIN mt b ON a.epoch = b.epoch AND a.f = b.f AND a.taper = b.taper AND a.ch > b.ch GROUP BY ALL)
SELECT seed, target, f, {_r(MEASURES["coh"], "coh")}, {_r(MEASURES["wpli"], "wpli")} FROM x GROUP BY ALL"""
ORACLES["coh_embeddings"] = f"WITH {VECS}, {_fourier(n=64, low=1, high=31)}, {_pairs()} SELECT seed, target, f, {', '.join(_r(MEASURES[m], m) for m in ('coh', 'imcoh', 'plv'))} FROM x GROUP BY ALL"
_COH = f"m AS (SELECT seed, target, f, {MEASURES['coh']} AS coh FROM x GROUP BY ALL)"
_BANDS = "(VALUES (0, 2, 6), (1, 5, 11)) b(band, lo, hi)"
ORACLES["coh_faverage"] = f"{CROSS}, {_COH} SELECT seed, target, band, {_r('avg(CAST(f AS DOUBLE))', 'freq')}, {_r('avg(coh)', 'coh')} FROM m JOIN {_BANDS} ON f BETWEEN lo AND hi GROUP BY ALL"
ORACLES["coh_all_to_all_dense"] = f"{CROSS}, {_COH} SELECT a.ch AS seed, b.ch AS target, f.f, {_r('coalesce(coh, 0.0)', 'value')} FROM nm a CROSS JOIN nm b CROSS JOIN (SELECT DISTINCT f FROM m) f LEFT JOIN m ON m.seed = a.ch AND m.target = b.ch AND m.f = f.f"


def _psi(head: str, keys: str, bands: str, freq: str = "CAST(f AS DOUBLE)") -> str:
    value = "avg(re) / sqrt(avg(pxx) * avg(pyy)) AS cr, avg(im) / sqrt(avg(pxx) * avg(pyy)) AS ci"
    return f"""{head}, c AS (SELECT {keys}, f, {freq} AS freq, {value} FROM x GROUP BY ALL),
s AS (SELECT *, cr * lead(ci) OVER w - ci * lead(cr) OVER w AS step FROM c JOIN {bands} ON freq > lo AND freq < hi WINDOW w AS (PARTITION BY {keys}, band ORDER BY f))
SELECT {keys}, CAST(band AS INT) AS band, {_r("coalesce(sum(step), 0.0)", "psi")}, {_r("avg(freq)", "freq")} FROM s GROUP BY {keys}, band"""


ORACLES["psi_fourier"] = _psi(CROSS, "seed, target", "(VALUES (0, -1000, 1000)) b(band, lo, hi)")
ORACLES["psi_bands"] = _psi(CROSS, "seed, target", _BANDS)


# wavelets and measures over time
def _wavelets(zero_mean: bool = False, freqs: tuple[float, ...] = (4.0, 6.0, 8.0), cycles: float = 2.0) -> str:
    rows = []
    for f, w in enumerate(windows.morlet(24.0, freqs, cycles, zero_mean)):
        rows += [f"({f}, {j - (len(w) - 1) // 2}, {float(v.real)!r}::DOUBLE, {float(v.imag)!r}::DOUBLE)" for j, v in enumerate(w)]
    return f"""WITH {DAYS}, wv AS (SELECT * FROM (VALUES {", ".join(rows)}) v(f, o, wr, wi)),
tf AS (SELECT s.epoch, s.ch, CAST(wv.f AS INT) AS f, CAST(s.t + wv.o AS INT) AS t, sum(s.value * wr) AS re, sum(s.value * wi) AS im
       FROM sig s JOIN wv ON s.t + wv.o BETWEEN 0 AND 23 GROUP BY ALL)"""


TFR = _wavelets()
#: Wavelet cross-spectra lack the factor 2 of tapered ones; both have it here, where it cancels.
TCROSS = f"{TFR}, {_pairs('tf', 't')}"
ORACLES["tfr_wavelet"] = f"{TFR} SELECT epoch, ch, f, t, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM tf"
ORACLES["coh_cwt_epochs"] = f"{_wavelets(True)}, {_pairs('tf', 't')} SELECT seed, target, f, t, {_r(MEASURES['coh'], 'coh')} FROM x GROUP BY ALL"
for _m in ("coh", "imcoh", "plv", "ciplv", "pli", "wpli"):
    ORACLES[f"{_m}_time"] = f"{TCROSS} SELECT epoch, seed, target, f, {_r(MEASURES[_m], _m)} FROM x GROUP BY ALL"
ORACLES["cohy_time"] = f"{TCROSS} SELECT epoch, seed, target, f, {', '.join(COHY)} FROM x GROUP BY ALL"
_TCOH = f"m AS (SELECT epoch, seed, target, f, {MEASURES['coh']} AS coh FROM x GROUP BY ALL)"
ORACLES["time_average"] = f"{TCROSS}, {_TCOH} SELECT seed, target, f, {_r('avg(coh)', 'coh')} FROM m GROUP BY ALL"
ORACLES["time_faverage"] = f"{TCROSS}, {_TCOH} SELECT epoch, seed, target, CAST(band AS INT) AS band, {_r('avg(coh)', 'coh')} FROM m JOIN (VALUES (0, 0, 2), (1, 1, 4), (2, 2, 3)) b(band, first, past) ON f >= first AND f < past GROUP BY ALL"
ORACLES["time_padding"] = f"{TCROSS} SELECT epoch, seed, target, f, {_r(MEASURES['wpli'], 'wpli')} FROM x WHERE t BETWEEN 4 AND 19 GROUP BY ALL"
ORACLES["time_decimated"] = f"{TCROSS} SELECT epoch, seed, target, f, {_r(MEASURES['plv'], 'plv')} FROM x WHERE t % 2 = 0 GROUP BY ALL"


def _smoothed(kernel) -> str:
    nf, nt = kernel.shape
    rows = ", ".join(f"({i - (nf - 1) // 2}, {j - (nt - 1) // 2}, {float(kernel[i, j])!r}::DOUBLE)" for i in range(nf) for j in range(nt))
    return f"""{TFR}, {_pairs('tf', 't', name='raw')}, x AS (SELECT raw.epoch, raw.seed, raw.target, CAST(raw.f + k.df AS INT) AS f, raw.t + k.dt AS t,
sum(re * k.w) AS re, sum(im * k.w) AS im, sum(pxx * k.w) AS pxx, sum(pyy * k.w) AS pyy FROM raw CROSS JOIN (VALUES {rows}) k(df, dt, w)
WHERE raw.f + k.df BETWEEN 0 AND 2 AND raw.t + k.dt BETWEEN 0 AND 23 GROUP BY ALL) SELECT epoch, seed, target, f, {_r(MEASURES['coh'], 'coh')} FROM x GROUP BY ALL"""


ORACLES["time_smoothed_square"] = _smoothed(windows.smoothing_kernel(3, 1, "square"))
ORACLES["time_smoothed_hanning"] = _smoothed(windows.smoothing_kernel(5, 3, "hanning"))
ORACLES["psi_time"] = _psi(TCROSS, "epoch, seed, target", "(VALUES (0, 3, 9)) b(band, lo, hi)", "4.0::DOUBLE + 2 * f")

# envelopes: the analytic signal by a transform, one-sided gains, and the transform back
def _analytic(source: str = DAYS, n: int = 24) -> str:
    return f"""WITH {source},
ft AS (SELECT epoch, ch, k, sum(value * cos(2 * pi() * k * t / {n})) AS fr, -sum(value * sin(2 * pi() * k * t / {n})) AS fi FROM sig CROSS JOIN (SELECT unnest(range({n // 2 + 1})) AS k) GROUP BY ALL),
z AS (SELECT epoch, ch, CAST(r.t AS INT) AS t, sum(g * (fr * cos(2 * pi() * k * r.t / {n}) - fi * sin(2 * pi() * k * r.t / {n}))) / {n} AS re,
             sum(g * (fr * sin(2 * pi() * k * r.t / {n}) + fi * cos(2 * pi() * k * r.t / {n}))) / {n} AS im
      FROM (SELECT *, CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END AS g FROM ft) CROSS JOIN (SELECT unnest(range({n})) AS t) r GROUP BY ALL)"""

ANALYTIC = _analytic()
ORACLES["analytic_signal"] = f"{ANALYTIC} SELECT epoch, ch, t, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM z"


def _envelope(log: bool = False, orth: bool = True, head: str = ANALYTIC) -> str:
    o, m = ("abs(b.re * a.im - a.re * b.im) / sqrt(b.re * b.re + b.im * b.im)", "sqrt(b.re * b.re + b.im * b.im)")
    if not orth:
        o = "sqrt(a.re * a.re + a.im * a.im)"
    if log:
        o, m = f"ln(({o}) ** 2)", f"ln(({m}) ** 2)"
    value = "(abs(p.c) + abs(q.c)) / 2" if orth else "p.c"
    return f"""{head}, o AS (SELECT a.epoch, a.ch AS i, b.ch AS j, corr({o}, {m}) AS c FROM z a JOIN z b ON a.epoch = b.epoch AND a.t = b.t AND a.ch <> b.ch GROUP BY ALL),
e AS (SELECT p.epoch, p.i AS seed, p.j AS target, {value} AS v FROM o p JOIN o q ON p.epoch = q.epoch AND p.i = q.j AND p.j = q.i WHERE p.i > p.j)"""


PAIRWISE = _envelope()
ORACLES["envcorr_plain"] = f"{_envelope(orth=False)} SELECT epoch, seed, target, {_r('v', 'value')} FROM e"
ORACLES["envcorr_pairwise"] = f"{PAIRWISE} SELECT epoch, seed, target, {_r('v', 'value')} FROM e"
ORACLES["envcorr_log"] = f"{_envelope(log=True, head=_analytic(VECS, 64))} SELECT epoch, seed, target, {_r('v', 'value')} FROM e"
for _n, _f in (("mean", "avg(v)"), ("median", "median(v)"), ("custom", "max(v) - min(v)")):
    ORACLES[f"envcorr_combine_{_n}"] = f"{PAIRWISE} SELECT seed, target, {_r(_f, 'value')} FROM e GROUP BY ALL"
MEAN = f"{PAIRWISE}, g AS (SELECT seed, target, avg(v) AS v FROM e GROUP BY ALL)"
ORACLES["conn_roundtrip"] = ORACLES["envcorr_combine_mean"]
ORACLES["conn_dense_symmetric"] = f"{MEAN}, b AS (SELECT * FROM g UNION ALL SELECT target, seed, v FROM g) SELECT i.ch AS seed, j.ch AS target, {_r('coalesce(v, 0.0)', 'value')} FROM nm i CROSS JOIN nm j LEFT JOIN b ON b.seed = i.ch AND b.target = j.ch"
ORACLES["conn_rename"] = f"{MEAN} SELECT 'channel ' || seed AS seed_name, 'channel ' || target AS target_name, {_r('v', 'value')} FROM g"
ORACLES["conn_topn"] = f"{MEAN} SELECT seed, target, {_r('v', 'value')} FROM g QUALIFY rank() OVER (ORDER BY v DESC) <= 4"
ORACLES["conn_append"] = f"{_envelope(orth=False)}, top AS (SELECT max(epoch) + 1 AS o FROM e WHERE epoch % 2 = 0) SELECT CASE WHEN epoch % 2 = 0 THEN epoch ELSE epoch + o END AS epoch, seed, target, {_r('v', 'value')} FROM e CROSS JOIN top"
ORACLES["conn_degree"] = f"""{CROSS}, m AS (SELECT seed, target, {MEASURES['coh']} AS v FROM x WHERE f = 4 GROUP BY ALL),
k AS (SELECT * FROM m QUALIFY row_number() OVER (ORDER BY v DESC, target, seed) <= 4) SELECT nm.ch AS node, count(k.v) AS degree FROM nm LEFT JOIN k ON nm.ch = k.seed OR nm.ch = k.target GROUP BY ALL"""


# symbols
def _symbols(tau: int = 1, weighted: bool = True, source: str = "sig") -> str:
    a, b, c = "value", f"lead(value, {tau}) OVER w", f"lead(value, {2 * tau}) OVER w"
    # of equal samples the earlier comes first
    cases = [("a <= b AND b <= c", 0), ("a <= c AND c < b", 1), ("b < a AND a <= c", 2), ("c < a AND a <= b", 3), ("b <= c AND c < a", 4)]
    names = " ".join(f"WHEN {cond} THEN {s}" for cond, s in cases)
    term = "n / al * (ln(n / al) - ln(na / al) - ln(nb / al))"
    value = f"sum(CASE WHEN sa <> sb AND sa + sb <> 5 THEN {term} ELSE 0.0 END)" if weighted else f"sum({term})"
    return f"""WITH {DAYS}, l AS (SELECT epoch, ch, t, {a} AS a, {b} AS b, {c} AS c FROM {source} WINDOW w AS (PARTITION BY epoch, ch ORDER BY t)),
s AS (SELECT epoch, ch, t, CASE {names} ELSE 5 END AS s FROM l WHERE c IS NOT NULL),
j AS (SELECT p.epoch, p.ch AS seed, q.ch AS target, p.s AS sa, q.s AS sb, CAST(count(*) AS DOUBLE) AS n FROM s p JOIN s q ON p.epoch = q.epoch AND p.t = q.t AND p.ch > q.ch GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY epoch, seed, target) AS al, sum(n) OVER (PARTITION BY epoch, seed, target, sa) AS na, sum(n) OVER (PARTITION BY epoch, seed, target, sb) AS nb FROM j),
v AS (SELECT epoch, seed, target, {value} / ln(6) AS v FROM h GROUP BY ALL)"""


ORACLES["wsmi_k3"] = f"{_symbols()} SELECT epoch, seed, target, {_r('v', 'value')} FROM v"
ORACLES["smi_k3"] = f"{_symbols(weighted=False)} SELECT epoch, seed, target, {_r('v', 'value')} FROM v"
ORACLES["wsmi_tau2"] = f"{_symbols(2)} SELECT epoch, seed, target, {_r('v', 'value')} FROM v"
ORACLES["wsmi_avg"] = f"{_symbols()} SELECT seed, target, {_r('avg(v)', 'value')} FROM v GROUP BY ALL"


# the low-pass before symbols two samples apart: poles on a circle, moved by the bilinear map, a pair a section of unit gain at zero
def _low_pass(order: int, cutoff: float) -> list[tuple[float, float, float]]:
    poles = [2 * math.tan(math.pi * cutoff / 2) * cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order // 2)]
    return [((1 - 2 * z.real + abs(z) ** 2) / 4, -2 * z.real, abs(z) ** 2) for z in ((2 + p) / (2 - p) for p in poles)]


def _recursed(source: str, name: str, sections: list[tuple[float, float, float]]) -> str:
    """(ch, i, v): v through all sections along i, which begin as if the first value had been there for ever."""
    start = ", ".join(f"({2 * g - a!r}::DOUBLE + {g - b!r}::DOUBLE) * v AS y{k}, {g - b!r}::DOUBLE * v AS z{k}" for k, (g, a, b) in enumerate(sections))
    rows = f"SELECT r.* EXCLUDE (i, v), p.i, p.v AS o FROM r JOIN {source} p ON p.ch = r.ch AND p.i = r.i + 1"
    for k, (g, _, _) in enumerate(sections):
        rows = f"SELECT *, {g!r}::DOUBLE * {f'o{k - 1}' if k else 'o'} + y{k} AS o{k} FROM ({rows})"
    states = ", ".join(f"{2 * g!r}::DOUBLE * {f'o{k - 1}' if k else 'o'} - {a!r}::DOUBLE * o{k} + z{k}, {g!r}::DOUBLE * {f'o{k - 1}' if k else 'o'} - {b!r}::DOUBLE * o{k}" for k, (g, a, b) in enumerate(sections))
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE r AS (SELECT ch, CAST(-1 AS BIGINT) AS i, v, {start} FROM {source} WHERE i = 0
  UNION ALL SELECT ch, i, o{len(sections) - 1}, {states} FROM ({rows})) SELECT ch, i, v FROM r WHERE i >= 0)"""


_SECTIONS = _low_pass(6, 1 / 3)
_LOW = f"""line AS MATERIALIZED (SELECT *, least({3 * (2 * len(_SECTIONS) + 1)}, n - 1) AS pad FROM (SELECT epoch, ch, t, value AS v, row_number() OVER (PARTITION BY ch ORDER BY epoch, t) - 1 AS i, count(*) OVER (PARTITION BY ch) AS n FROM sig)),
ends AS (SELECT ch, max(v) FILTER (i = 0) AS head, max(v) FILTER (i = n - 1) AS tail FROM line GROUP BY ch),
long AS MATERIALIZED (SELECT ch, i + pad AS i, v FROM line UNION ALL SELECT ch, pad - i, 2 * head - v FROM line JOIN ends USING (ch) WHERE i BETWEEN 1 AND pad
  UNION ALL SELECT ch, pad + 2 * n - 2 - i, 2 * tail - v FROM line JOIN ends USING (ch) WHERE i BETWEEN n - 1 - pad AND n - 2),
{_recursed('long', 'there', _SECTIONS)},
turned AS MATERIALIZED (SELECT ch, max(i) OVER (PARTITION BY ch) - i AS i, v FROM there),
{_recursed('turned', 'back', _SECTIONS)},
low AS (SELECT epoch, line.ch, t, back.v AS value FROM line JOIN back ON back.ch = line.ch AND back.i = n + pad - 1 - line.i)"""
ORACLES["wsmi_antialias"] = f"{_symbols(2, source='low').replace(f'WITH {DAYS},', f'WITH {DAYS}, {_LOW},', 1)} SELECT epoch, seed, target, {_r('v', 'value')} FROM v"


# autoregression of all five channels: Gram sums, then elimination column by column
K = 5


def _eliminated(source: str, by: str, n: int, m: int, name: str = "s") -> str:
    """CTEs from a table of augmented rows g{i}_{j} to {name}{n}, in which g{i}_{n + r} solves the r-th system."""
    steps, last = [], source
    for k in range(n):
        cells = [f"g{k}_{j} / g{k}_{k} AS g{k}_{j}" if i == k else f"g{i}_{j} - g{i}_{k} * g{k}_{j} / g{k}_{k} AS g{i}_{j}" for i in range(n) for j in range(k + 1, n + m)]
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {by}{', '.join(cells)} FROM {last})")
        last = f"{name}{k + 1}"
    return ", ".join(steps)


def _listed(rows: list[str]) -> str:
    return f"unnest([{', '.join(rows)}])"


def _lagged(lags: int) -> str:
    """CTEs y (epoch, t, y0, ...) and l, with the lags of all channels as z0, ..."""
    wide = ", ".join(f"max(value) FILTER (ch = {i}) AS y{i}" for i in range(K))
    past = ", ".join(f"lag(y{i}, {d}) OVER w AS z{(d - 1) * K + i}" for d in range(1, lags + 1) for i in range(K))
    return f"""y AS (SELECT epoch, t, {wide} FROM sig GROUP BY ALL),
l AS (SELECT *, {past} FROM y WINDOW w AS (PARTITION BY epoch ORDER BY t))"""


def _var(pooled: bool = False, ridge: float = 0.0, lags: int = 1) -> str:
    by, m = "" if pooled else "epoch, ", K * lags
    sums = [f"sum(z{i} * z{j}) + {ridge if i == j else 0.0} AS g{i}_{j}" for i in range(m) for j in range(m)] + [f"sum(z{i} * y{r}) AS g{i}_{m + r}" for i in range(m) for r in range(K)]
    cells = [f"{{'i': CAST({r} AS INT), 'j': CAST({i % K} AS INT), 'lag': CAST({i // K + 1} AS INT), 'value': g{i}_{m + r}}}" for r in range(K) for i in range(m)]
    return f"""WITH {DAYS}, {_lagged(lags)},
g AS (SELECT {by}{', '.join(sums)} FROM l WHERE t >= {lags} {"" if pooled else "GROUP BY epoch"}), {_eliminated('g', by, m, K)},
a AS (SELECT {by}{', '.join(f"g{i}_{m + r} AS a{r}_{i}" for r in range(K) for i in range(m))} FROM s{m}),
u AS (SELECT {by}unnest(c, recursive := true) FROM (SELECT {by}[{', '.join(cells)}] AS c FROM s{m}))"""


def _each(exprs: list[str]) -> str:
    """A list with an element for each channel."""
    return f"[{', '.join(exprs)}]"


ORACLES["var1_dynamic"] = f"{_var()} SELECT epoch, i, j, lag, {_r('value', 'value')} FROM u"
ORACLES["var1_pooled"] = f"{_var(True)} SELECT i, j, lag, {_r('value', 'value')} FROM u"
ORACLES["var_ridge"] = f"{_var(ridge=100.0)} SELECT epoch, i, j, lag, {_r('value', 'value')} FROM u"
ORACLES["var_ridge_pooled"] = f"{_var(True, 10000.0)} SELECT i, j, lag, {_r('value', 'value')} FROM u"
ORACLES["var_p_dynamic"] = f"{_var(lags=2)} SELECT epoch, i, j, lag, {_r('value', 'value')} FROM u"
ORACLES["var_companion"] = f"""{_var(lags=2)} SELECT epoch, i AS row, CAST(j + {K} * (lag - 1) AS INT) AS col, {_r('value', 'value')} FROM u
UNION ALL SELECT epoch, CAST({K} + c AS INT), CAST(c AS INT), 1.0::DOUBLE FROM (SELECT DISTINCT epoch FROM u) CROSS JOIN (SELECT unnest(range({K})) AS c)"""
_GUESS = [" + ".join(f"a{r}_{i} * z{i}" for i in range(K)) for r in range(K)]
_TURN = f"(SELECT unnest(range({K})) AS ch) k"
ORACLES["var_predict"] = f"""{_var()} SELECT l.epoch, CAST(k.ch AS INT) AS ch, t, {_r(f'{_each([f"y{r}" for r in range(K)])}[k.ch + 1]', 'value', 4)},
{_r(f'coalesce({_each(_GUESS)}[k.ch + 1], 0.0)', 'predicted', 4)} FROM l JOIN a ON l.epoch = a.epoch CROSS JOIN {_TURN}"""
_E = [f"y{r} - ({g})" for r, g in enumerate(_GUESS)]
ORACLES["var_residual"] = f"""{_var()} SELECT l.epoch, CAST(k.ch AS INT) AS ch, t, {_r(f'{_each(_E)}[k.ch + 1]', 'residual', 4)}
FROM l JOIN a ON l.epoch = a.epoch CROSS JOIN {_TURN} WHERE t >= 1"""
ORACLES["var_residual_cov"] = f"""{_var()}, r AS (SELECT l.epoch, {_each(_E)} AS e FROM l JOIN a ON l.epoch = a.epoch WHERE t >= 1)
SELECT epoch, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_r(f'sum(e[i + 1] * e[j + 1]) / {24 - 1 - K}', 'value', 2)}
FROM r CROSS JOIN (SELECT unnest(range({K})) AS i) CROSS JOIN (SELECT unnest(range({K})) AS j) GROUP BY ALL"""
# the largest modulus of eigenvalues is the limit of the root of a power's norm: the matrix is squared, its norm taken out and kept as a logarithm
_SQUARE = [f"({' + '.join(f'a{i}_{k} * a{k}_{j}' for k in range(K))})" for i in range(K) for j in range(K)]
_NORM = f"sqrt({' + '.join(f'{c} * {c}' for c in _SQUARE)})"
ORACLES["var_eigvals"] = f"""{_var()}, q AS (WITH RECURSIVE q AS (SELECT 0 AS n, epoch, 0.0::DOUBLE AS ln_norm, {', '.join(f'a{i}_{j}' for i in range(K) for j in range(K))} FROM a
UNION ALL SELECT n + 1, epoch, 2 * ln_norm + ln({_NORM}), {', '.join(f'{c} / {_NORM}' for c in _SQUARE)} FROM q WHERE n < 40) SELECT * FROM q)
SELECT epoch, {_r('exp(ln_norm / pow(2.0, 40))', 'largest')} FROM q WHERE n = 40"""

# surrogates
RESTING = f"""{{head}}, pl AS (SELECT epoch, ch, row_number() OVER (PARTITION BY ch ORDER BY epoch) AS place FROM (SELECT DISTINCT epoch, ch FROM sig)),
dr AS (SELECT CAST(k AS INT) AS shuffle, epoch, ch, place, row_number() OVER (PARTITION BY k, ch ORDER BY md5('7|' || k || '|' || ch || '|' || epoch), epoch) AS too FROM pl CROSS JOIN (SELECT unnest(range({{n}})) AS k)),
sur AS (SELECT d.shuffle, d.epoch, d.ch, sig.t, sig.value FROM dr d JOIN dr s ON s.shuffle = d.shuffle AND s.ch = d.ch AND s.too = d.place JOIN sig ON sig.epoch = s.epoch AND sig.ch = s.ch)"""
ORACLES["surrogate_resting"] = RESTING.format(head=f"WITH {DAYS}", n=3) + f" SELECT shuffle, epoch, ch, t, {_r('value', 'value')} FROM sur"
ORACLES["surrogate_evoked"] = f"""WITH {DAYS}, c AS (SELECT *, CAST('0x' || substr(md5('7|' || k || '|' || ch || '|' || epoch), 1, 8) AS BIGINT) % 23 + 1 AS cut FROM sig CROSS JOIN (SELECT unnest(range(3)) AS k))
SELECT CAST(k AS INT) AS shuffle, epoch, ch, CAST((t - cut + 24) % 24 AS INT) AS t, {_r('value', 'value')} FROM c"""
ORACLES["surrogate_pvalue"] = RESTING.format(head=f"WITH {DAYS}", n=10) + f""", alt AS (SELECT epoch * 10 + shuffle AS epoch, ch, t, value FROM sur),
{_fourier()}, {_pairs()}, {_COH}, {_fourier('alt', name='sq')}, {_pairs('sq', name='y')},
n AS (SELECT epoch % 10 AS shuffle, seed, target, f, {MEASURES['coh']} AS coh FROM y GROUP BY ALL)
SELECT m.seed, m.target, m.f, {_r('avg(CASE WHEN m.coh <= n.coh THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'p')} FROM m JOIN n ON m.seed = n.seed AND m.target = n.target AND m.f = n.f GROUP BY ALL"""

# sets of signals, in closed form
ALL = f"{SPECTRA}, {_pairs(every=True)}, av AS (SELECT seed, target, f, avg(re) AS re, avg(im) AS im FROM x GROUP BY ALL)"
_ONE = "FROM (VALUES (0, 2, 0), (1, 4, 1)) c(con, s, t) JOIN av p ON p.seed = s AND p.target = t JOIN av a ON a.seed = s AND a.target = s AND a.f = p.f JOIN av b ON b.seed = t AND b.target = t AND b.f = p.f"
ORACLES["mim_1x1"] = f"{ALL} SELECT CAST(con AS INT) AS con, p.f, {_r('p.im * p.im / (a.re * b.re)', 'mim')} {_ONE}"
ORACLES["cacoh_1x1_abs"] = f"{ALL} SELECT CAST(con AS INT) AS con, p.f, {_r('sqrt((p.re * p.re + p.im * p.im) / (a.re * b.re))', 'cacoh', 5)} {_ONE}"
_CELLS = ", ".join(f"max(re) FILTER (seed = {i} AND target = {j}) AS r{i}{j}, max(im) FILTER (seed = {i} AND target = {j}) AS i{i}{j}" for i in range(4) for j in range(4))
TWO = f"""{ALL}, w AS (SELECT f, {_CELLS} FROM av GROUP BY f),
v AS (SELECT f, r11 / da AS a00, -r01 / da AS a01, r00 / da AS a11, r33 / db AS b00, -r23 / db AS b01, r22 / db AS b11, i02, i03, i12, i13 FROM (SELECT *, r00 * r11 - r01 * r10 AS da, r22 * r33 - r23 * r32 AS db FROM w)),
p AS (SELECT f, a00 * i02 + a01 * i12 AS p00, a00 * i03 + a01 * i13 AS p01, a01 * i02 + a11 * i12 AS p10, a01 * i03 + a11 * i13 AS p11,
             b00 * i02 + b01 * i03 AS q00, b00 * i12 + b01 * i13 AS q01, b01 * i02 + b11 * i03 AS q10, b01 * i12 + b11 * i13 AS q11 FROM v),
m AS (SELECT f, p00 * q00 + p01 * q10 AS m00, p00 * q01 + p01 * q11 AS m01, p10 * q00 + p11 * q10 AS m10, p10 * q01 + p11 * q11 AS m11 FROM p)"""
ORACLES["mim_2x2"] = f"{TWO} SELECT CAST(0 AS INT) AS con, f, {_r('m00 + m11', 'mim')} FROM m"
ORACLES["mic_2x2_abs"] = f"{TWO} SELECT CAST(0 AS INT) AS con, f, {_r('sqrt(((m00 + m11) + sqrt(greatest((m00 + m11) ** 2 - 4 * (m00 * m11 - m01 * m10), 0))) / 2)', 'mic')} FROM m"

ORACLES["signals_selected"] = f"WITH {DAYS} SELECT epoch, ch, t, {_r('value', 'value')} FROM sig WHERE epoch % 7 IN (2, 3)"
ORACLES["coh_from_spectra"] = f"{CROSS} SELECT seed, target, f, {_r(MEASURES['coh'], 'value')} FROM x WHERE f BETWEEN 2 AND 6 GROUP BY ALL"
ORACLES["conn_topn_distance"] = f"""{_envelope(orth=False)}, g AS (SELECT seed, target, avg(v) AS v FROM e GROUP BY ALL), r AS (SELECT *, rank() OVER (ORDER BY abs(v) DESC) AS k FROM g)
SELECT seed, target, {_r('v', 'value')} FROM r WHERE k <= 6 AND abs(seed - target) >= 1.5"""
ORACLES["coh_from_tfr"] = f"{TCROSS} SELECT epoch, seed, target, f, {_r(MEASURES['coh'], 'value')} FROM x GROUP BY ALL"

# what has no query elsewhere
ORACLES["coh_five_cycles"] = f"{CROSS} SELECT seed, target, f, {_r(MEASURES['coh'], 'value')} FROM x WHERE f >= 5 GROUP BY ALL"
ORACLES["surrogate_alias"] = ORACLES["surrogate_resting"]
ORACLES["wsmi_window"] = f"{_symbols(source='(SELECT * FROM sig WHERE t BETWEEN 6 AND 18)')} SELECT epoch, seed, target, {_r('v', 'value')} FROM v"
_OWN = " UNION ALL ".join(f"SELECT {f} AS f, {d} AS dt, 1.0::DOUBLE / {2 * reach + 1} AS w" for f, reach in enumerate((2, 1, 0)) for d in range(-reach, reach + 1))
ORACLES["time_smoothed_by_freq"] = f"""{TFR}, {_pairs('tf', 't', name='raw')}, k AS ({_OWN}), x AS (SELECT raw.epoch, raw.seed, raw.target, raw.f, raw.t + k.dt AS t,
sum(re * k.w) AS re, sum(im * k.w) AS im, sum(pxx * k.w) AS pxx, sum(pyy * k.w) AS pyy FROM raw JOIN k ON k.f = raw.f WHERE raw.t + k.dt BETWEEN 0 AND 23 GROUP BY ALL)
SELECT epoch, seed, target, f, {_r(MEASURES['coh'], 'value')} FROM x GROUP BY ALL"""
ORACLES["edges_multivariate"] = """SELECT CAST(con AS INT) AS con, CAST(side AS INT) AS side, CAST(place AS INT) AS place, CAST(ch AS INT) AS ch FROM (VALUES
(0, 0, 0, 0), (0, 0, 1, 1), (1, 0, 0, 0), (1, 0, 1, 1), (2, 0, 0, 2), (3, 0, 0, 2), (0, 1, 0, 3), (1, 1, 0, 4), (1, 1, 1, 0), (2, 1, 0, 3), (3, 1, 0, 4), (3, 1, 1, 0)) v(con, side, place, ch)"""
ORACLES["edges_padded"] = """SELECT CAST(side AS INT) AS side, CAST(con AS INT) AS con, CAST(place AS INT) AS place, CAST(ch AS INT) AS ch FROM (VALUES
(0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 0, 3), (0, 1, 1, -1), (0, 1, 2, -1), (1, 0, 0, 4), (1, 0, 1, -1), (1, 0, 2, -1), (1, 1, 0, 0), (1, 1, 1, 2), (1, 1, 2, -1)) v(side, con, place, ch)"""
ORACLES["refused"] = """SELECT c AS what, e AS error FROM (VALUES ('band without a bin', 'ValueError'), ('band upside down', 'ValueError'), ('unknown mode', 'ValueError'), ('unknown measure', 'ValueError'),
('sets and pairs mixed', 'ValueError'), ('causality without indices', 'ValueError'), ('causality of a channel with itself', 'ValueError'), ('falling freqs', 'ValueError'), ('freqs above Nyquist', 'ValueError'),
('padding that leaves nothing', 'ValueError'), ('smoothing times for other freqs', 'ValueError'), ('sets where channels are due', 'TypeError'), ('seeds and targets of different number', 'ValueError'),
('no such channel', 'ValueError'), ('a channel twice', 'ValueError'), ('prediction without a model', 'ValueError'), ('orthogonalisation of no kind', 'ValueError'), ('singular cross-spectrum', 'RuntimeError'),
('singular autocovariance', 'RuntimeError'), ('more lags than frequencies', 'ValueError')) v(c, e)"""
ORACLES["conn_accessors"] = f"""WITH {DAYS}, n AS (SELECT count(DISTINCT epoch) AS n FROM sig) SELECT what, CASE what WHEN 'n_epochs' THEN CAST(n AS VARCHAR) ELSE v END AS value FROM n CROSS JOIN
(VALUES ('kind', 'EpochConnectivity'), ('dims', 'epoch,seed,target'), ('n_epochs', ''), ('n_seeds', '4'), ('n_targets', '4'), ('names', '0,1,2,3,4'), ('combined kind', 'Connectivity'), ('nodes', '5'), ('method', 'envelope correlation')) v(what, v)"""

# sets of signals by elimination: all five channels with themselves
_WHOLE = ", ".join(f"max({part}) FILTER (seed = {i} AND target = {j}) AS g{i}_{j + shift}" for part, shift in (("re", 0), ("im", K)) for i in range(K) for j in range(K))
ORACLES["mim_all"] = f"""{ALL}, w AS (SELECT f, {_WHOLE} FROM av GROUP BY f), {_eliminated('w', 'f, ', K, K)}
SELECT CAST(0 AS INT) AS con, f, {_r(f"-0.5 * ({' + '.join(f'g{i}_{K + j} * g{j}_{K + i}' for i in range(K) for j in range(K))})", 'mim')} FROM s{K}"""
# patterns of two channels with two: inverse roots of 2 x 2 matrices in closed form, then the leading vectors of E E' and E' E
_ROOT = "(r{1}{1} + s{2}) / t{2} / s{2} AS {2}00, -r{0}{1} / t{2} / s{2} AS {2}01, (r{0}{0} + s{2}) / t{2} / s{2} AS {2}11"
_LEADING = "(m00 + m11) / 2 + sqrt(((m00 - m11) / 2) ** 2 + m01 * m01)"
def _mic(channels: tuple[int, int, int, int]) -> str:
    """The sides' leading vectors (v0, v1), their length, and the inverse roots (w00, w01, w11) that make filters of them."""
    cells = ", ".join(f"max({part}) FILTER (seed = {a} AND target = {b}) AS {part[0]}{i}{j}" for part in ("re", "im") for i, a in enumerate(channels) for j, b in enumerate(channels))
    return f"""{ALL}, w AS (SELECT f, {cells} FROM av GROUP BY f),
d AS (SELECT *, sqrt(r00 * r11 - r01 * r01) AS sa, sqrt(r22 * r33 - r23 * r23) AS sb FROM w), h AS (SELECT *, sqrt(r00 + r11 + 2 * sa) AS ta, sqrt(r22 + r33 + 2 * sb) AS tb FROM d),
q AS (SELECT *, {_ROOT.format(0, 1, 'a')}, {_ROOT.format(2, 3, 'b')} FROM h),
p AS (SELECT *, a00 * i02 + a01 * i12 AS p00, a00 * i03 + a01 * i13 AS p01, a01 * i02 + a11 * i12 AS p10, a01 * i03 + a11 * i13 AS p11 FROM q),
e AS (SELECT *, p00 * b00 + p01 * b01 AS e00, p00 * b01 + p01 * b11 AS e01, p10 * b00 + p11 * b01 AS e10, p10 * b01 + p11 * b11 AS e11 FROM p),
m AS (SELECT f, 'seed' AS side, r00 AS c00, r01 AS c01, r11 AS c11, a00 AS w00, a01 AS w01, a11 AS w11, e00 * e00 + e01 * e01 AS m00, e00 * e10 + e01 * e11 AS m01, e10 * e10 + e11 * e11 AS m11 FROM e
      UNION ALL SELECT f, 'target', r22, r23, r33, b00, b01, b11, e00 * e00 + e10 * e10, e00 * e01 + e10 * e11, e01 * e01 + e11 * e11 FROM e),
v AS (SELECT *, m01 AS v0, {_LEADING} - m00 AS v1 FROM m), n AS (SELECT *, sqrt(v0 * v0 + v1 * v1) AS long FROM v)"""


ORACLES["mic_patterns"] = f"""{_mic((0, 1, 2, 3))}
SELECT f, side, CAST(ch AS INT) AS ch, {_r("abs(CASE ch WHEN 0 THEN c00 * v0 + c01 * v1 ELSE c01 * v0 + c11 * v1 END) / long", "value", 2)} FROM n CROSS JOIN (SELECT unnest(range(2)) AS ch)"""
for _name, _matrix, _places in (("mic_patterns_bad", "c", 2), ("mic_filters_bad", "w", 6)):
    ORACLES[_name] = f"""{_mic((0, 2, 3, 4))}, pl AS (SELECT * FROM (VALUES ('seed', 0, 0), ('seed', 1, NULL), ('seed', 2, 1), ('target', 3, 0), ('target', 4, 1)) v(side, ch, place))
SELECT CAST(0 AS INT) AS con, f, n.side, CAST(ch AS INT) AS ch,
  {_r(f"coalesce(abs(CASE place WHEN 0 THEN {_matrix}00 * v0 + {_matrix}01 * v1 WHEN 1 THEN {_matrix}01 * v0 + {_matrix}11 * v1 END) / long, 0)", "value", _places)} FROM n JOIN pl ON pl.side = n.side"""
ORACLES["mim_from_spectra"] = ORACLES["mim_2x2"]
ORACLES["mim_faverage"] = f"{TWO} SELECT CAST(0 AS INT) AS con, CAST(band AS INT) AS band, {_r('avg(m00 + m11)', 'value')} FROM m JOIN (VALUES (0, 2, 6), (1, 5, 11)) b(band, low, high) ON f BETWEEN low AND high GROUP BY band"
# ranks of two and of three channels: full unless the determinant of their products vanishes beside the product of their squares
_GRAM = ", ".join(f"sum(y{i} * y{j}) AS g{i}{j}" for i in range(K) for j in range(i, K))
_THREE = "g22 * (g33 * g44 - g34 * g34) - g23 * (g23 * g44 - g34 * g24) + g24 * (g23 * g34 - g33 * g24)"
_RANKS = f"""SELECT CAST(0 AS INT) AS con, CAST(min(CASE WHEN g00 * g11 - g01 * g01 > 1e-12 * g00 * g11 THEN 2 ELSE 1 END) AS INT) AS seeds, CAST(min(CASE WHEN {_THREE} > 1e-12 * g22 * g33 * g44 THEN 3 ELSE 2 END) AS INT) AS targets FROM g"""
_EACH = lambda value: ", ".join(f"max({value}) FILTER (ch = {i}) AS y{i}" for i in range(K))
ORACLES["rank_estimate"] = f"WITH {DAYS}, y AS (SELECT epoch, t, {_EACH('value')} FROM sig GROUP BY ALL), g AS (SELECT epoch, {_GRAM} FROM y GROUP BY epoch) {_RANKS}"
ORACLES["rank_from_spectra"] = f"{SPECTRA}, y AS (SELECT epoch, f, {_EACH('re * re + im * im')} FROM sp GROUP BY ALL), g AS (SELECT epoch, {_GRAM} FROM y GROUP BY epoch) {_RANKS}"


# causality: autocovariances by a cosine sum, the autoregression by elimination, one row of the transfer function by cofactors
def _causality(con: int, channels: list[int], lags: int, reverse: bool, bins: int = 13, by: str = "") -> str:
    """CTEs that end in gc{con}([epoch,] f, gc): of the seeds, all channels but the last, on the last."""
    last = bins - 1
    n, s = len(channels), f"{con}{'r' if reverse else ''}"
    g = lambda k, i, j: f"g{k}_{j}{i}" if reverse else f"g{k}_{i}{j}"
    lag = lambda k, i, j: g(k, i, j) if k >= 0 else g(-k, j, i)
    angle = f"pi() * {{k}} * f / {last}"
    sums = [f"sum(CASE WHEN f IN (0, {last}) THEN 1 ELSE 2 END * (re * cos({angle.format(k=k)}) - im * sin({angle.format(k=k)}))) FILTER (seed = {a} AND target = {b}) / {2 * last} AS g{k}_{i}{j}" for k in range(lags + 1) for i, a in enumerate(channels) for j, b in enumerate(channels)]
    m = n * lags
    cells = [f"{lag(i - j, b, a)} AS g{i * n + a}_{j * n + b}" for i in range(lags) for a in range(n) for j in range(lags) for b in range(n)] + [f"{lag(i + 1, r, a)} AS g{i * n + a}_{m + r}" for i in range(lags) for a in range(n) for r in range(n)]
    coef = lambda k, r, c: f"x{k}_{r}{c}"
    left = lambda r, c: f"({g(0, r, c)} - ({' + '.join(f'{coef(k, r, q)} * {g(k + 1, c, q)}' for k in range(lags) for q in range(n))}))"
    powers = [f"{'1.0::DOUBLE' if i == j else '0.0::DOUBLE'} - ({' + '.join(f'{coef(k, i, j)} * cos(pi() * f / {last} * {k + 1})' for k in range(lags))}) AS m{i}{j}r, {' + '.join(f'{coef(k, i, j)} * sin(pi() * f / {last} * {k + 1})' for k in range(lags))} AS m{i}{j}i" for i in range(n) for j in range(n)]
    times = lambda a, b: (f"({a[0]} * {b[0]} - {a[1]} * {b[1]})", f"({a[0]} * {b[1]} + {a[1]} * {b[0]})")
    at = lambda i, j: (f"m{i}{j}r", f"m{i}{j}i")
    t, cofactors = n - 1, []
    for j in range(n):
        rows = [i for i in range(n) if i != j]
        if n == 2:
            minor = at(rows[0], 0)
        else:
            first, second = times(at(rows[0], 0), at(rows[1], 1)), times(at(rows[0], 1), at(rows[1], 0))
            minor = tuple(f"({x} - {y})" for x, y in zip(first, second, strict=True))
        sign = "" if (j + t) % 2 == 0 else "-"
        cofactors.append(f"{sign}{minor[0]} AS c{j}r, {sign}{minor[1]} AS c{j}i")
    det = [times(at(j, t), (f"c{j}r", f"c{j}i")) for j in range(n)]
    # |row|^2 under a covariance, over |det|^2
    under = lambda v, k: " + ".join(f"{v(a, b)} * (c{a}r * c{b}r + c{a}i * c{b}i)" for a in range(k) for b in range(k))
    whole, part = under(lambda a, b: f"v{a}{b}", n), under(lambda a, b: f"(v{a}{b} - v{a}{t} * v{t}{b} / v{t}{t})", t)
    both = "JOIN" if by else "CROSS JOIN"
    using = "USING (epoch)" if by else ""
    return f"""ac{s} AS MATERIALIZED (SELECT {by}{', '.join(sums)} FROM av {"GROUP BY epoch" if by else ""}), y{s} AS (SELECT {by}{', '.join(cells)} FROM ac{s}), {_eliminated(f'y{s}', by, m, n, f's{s}_')},
x{s} AS (SELECT {by}{', '.join(f'g{k * n + c}_{m + r} AS {coef(k, r, c)}' for k in range(lags) for r in range(n) for c in range(n))} FROM s{s}_{m}),
v{s} AS MATERIALIZED (SELECT x{s}.*, {', '.join(f'({left(r, c)} + {left(c, r)}) / 2 AS v{r}{c}' for r in range(n) for c in range(n))} FROM x{s} {both} ac{s} {using}),
m{s} AS MATERIALIZED (SELECT f, v{s}.*, {', '.join(powers)} FROM v{s} CROSS JOIN (SELECT CAST(unnest(range({bins})) AS INT) AS f)), c{s} AS MATERIALIZED (SELECT *, {', '.join(cofactors)} FROM m{s}),
d{s} AS (SELECT *, {' + '.join(d[0] for d in det)} AS dr, {' + '.join(d[1] for d in det)} AS di FROM c{s}),
gc{s} AS (SELECT CAST({con} AS INT) AS con, {by}f, ln(({whole}) / (dr * dr + di * di)) - ln((({whole}) - ({part})) / (dr * dr + di * di)) AS gc FROM d{s})"""


_EDGES = f"WITH {DAYS}, {_fourier(low=0, high=12)}, {_pairs(every=True)}, av AS (SELECT seed, target, f, avg(re) AS re, avg(im) AS im FROM x GROUP BY ALL)"
_CONNECTIONS = [[0, 1], [1, 0], [0, 1, 2]]


def _causalities(reverse: bool, connections: list = _CONNECTIONS) -> str:
    return ", ".join(_causality(c, channels, 4, reverse) for c, channels in enumerate(connections))


for _m, _back in (("gc", False), ("gc_tr", True)):
    ORACLES[_m] = f"{_EDGES}, {_causalities(_back)} {' UNION ALL '.join(f"SELECT con, f, {_r('gc', _m)} FROM gc{c}{'r' * _back}" for c in range(3))}"
ORACLES["trgc_net"] = f"""{_EDGES}, {_causalities(False, _CONNECTIONS[:2])}, {_causalities(True, _CONNECTIONS[:2])}
SELECT gc0.f, {_r('(gc0.gc - gc1.gc) - (gc0r.gc - gc1r.gc)', 'net')} FROM gc0 JOIN gc1 ON gc1.f = gc0.f JOIN gc0r ON gc0r.f = gc0.f JOIN gc1r ON gc1r.f = gc0.f"""

# waves under several tapers: literals, as single ones
_WAVES = ", ".join(f"({f}, {k}, {j - (len(w) - 1) // 2}, {float(v.real)!r}::DOUBLE, {float(v.imag)!r}::DOUBLE, {float(weight)!r}::DOUBLE)" for f, group in enumerate(windows.tapered_waves(24.0, [4.0, 6.0, 8.0], 2.0)) for k, (w, weight) in enumerate(group) for j, v in enumerate(w))
ORACLES["tfr_multitaper"] = f"""WITH {DAYS}, wv AS (SELECT * FROM (VALUES {_WAVES}) v(f, k, o, wr, wi, weight)),
y AS (SELECT s.epoch, s.ch, wv.f, k, any_value(weight) AS weight, s.t + wv.o AS t, sum(s.value * wr) AS re, sum(s.value * wi) AS im FROM sig s JOIN wv ON s.t + wv.o BETWEEN 0 AND 23 GROUP BY ALL)
SELECT epoch, ch, CAST(f AS INT) AS f, 4.0::DOUBLE + 2 * f AS freq, CAST(t AS INT) AS t, {_r('2 * sum(weight * weight * (re * re + im * im)) / sum(weight * weight)', 'power', 3)} FROM y GROUP BY ALL"""
# adaptive weights: 150 rounds of the fixed point for each channel and bin
_NT = len(_ratios)
_D = [f"sqrt({float(r)!r}::DOUBLE) * psd / ({float(r)!r}::DOUBLE * psd + {float(1 - r)!r}::DOUBLE * spread + 1e-300)" for r in _ratios]
ORACLES["spectra_adaptive"] = f"""{TAPERED.replace('unnest(range(1, 12))', 'unnest(range(13))')},
w AS (SELECT epoch, ch, f, {', '.join(f'max(re * re + im * im) FILTER (taper = {k}) AS p{k}, max(re) FILTER (taper = {k}) AS re{k}, max(im) FILTER (taper = {k}) AS im{k}' for k in range(_NT))} FROM mt GROUP BY ALL),
b AS (SELECT *, avg({' + '.join(f'p{k}' for k in range(_NT))}) OVER (PARTITION BY epoch, ch) / {_NT} AS spread FROM w),
q AS (WITH RECURSIVE q AS (SELECT 0 AS n, epoch, ch, f, spread, {', '.join(f'p{k}' for k in range(_NT))}, (p0 + p1) / 2 AS psd FROM b WHERE f BETWEEN 1 AND 11
      UNION ALL SELECT n + 1, epoch, ch, f, spread, {', '.join(f'p{k}' for k in range(_NT))}, ({' + '.join(f'({d}) ** 2 * p{k}' for k, d in enumerate(_D))}) / ({' + '.join(f'({d}) ** 2' for d in _D)}) FROM q WHERE n < 150)
      SELECT epoch, ch, f, {', '.join(f'{d} AS d{k}' for k, d in enumerate(_D))} FROM q WHERE n = 150),
o AS (SELECT q.*, {', '.join(f'd{k} * re{k} AS r{k}, d{k} * im{k} AS i{k}' for k in range(_NT))}, {' + '.join(f'd{k} * d{k}' for k in range(_NT))} AS w2 FROM q JOIN b USING (epoch, ch, f)),
x AS (SELECT x.epoch, x.ch AS seed, y.ch AS target, x.f, 2 * ({' + '.join(f'x.r{k} * y.r{k} + x.i{k} * y.i{k}' for k in range(_NT))}) / sqrt(x.w2 * y.w2) AS re, 2 * ({' + '.join(f'x.i{k} * y.r{k} - x.r{k} * y.i{k}' for k in range(_NT))}) / sqrt(x.w2 * y.w2) AS im,
      2 * ({' + '.join(f'x.r{k} * x.r{k} + x.i{k} * x.i{k}' for k in range(_NT))}) / x.w2 AS pxx, 2 * ({' + '.join(f'y.r{k} * y.r{k} + y.i{k} * y.i{k}' for k in range(_NT))}) / y.w2 AS pyy
      FROM o x JOIN o y ON x.epoch = y.epoch AND x.f = y.f AND x.ch > y.ch)
SELECT seed, target, f, CAST(f AS DOUBLE) AS freq, {_r(MEASURES['coh'], 'coh')} FROM x GROUP BY ALL"""


# orders of an autoregression on one sample of a day: residual products by elimination, their determinant by pivots
def _order(p: int, most: int, n_times: int = 24, many: str = "1", source: str = "l") -> str:
    """Criteria o{p} of one order by epoch; many epochs count as one if source gives them one number."""
    m, seen = K * p, f"({many} * {n_times - p})"
    sums = [f"sum(z{i} * z{j}) AS g{i}_{j}" for i in range(m) for j in range(m)] + [f"sum(z{i} * y{r}) AS g{i}_{m + r}" for i in range(m) for r in range(K)]
    more = [f"sum(y{r} * y{q}) AS yy{r}_{q}" for r in range(K) for q in range(K)] + [f"sum(z{i} * y{r}) AS zy{i}_{r}" for i in range(m) for r in range(K)]
    down, free = f"({seen} - {m})", f"({many} * {n_times - most} - {m})"
    left = [f"(yy{r}_{q} - ({' + '.join(f'g{i}_{m + r} * zy{i}_{q}' for i in range(m))})) / {free} * {down} / {seen} AS h{r}_{q}" for r in range(K) for q in range(K)]
    pivots = [f"b{p}_{k + 1} AS MATERIALIZED (SELECT epoch, {''.join(f'd{i}, ' for i in range(k))}h{k}_{k} AS d{k}{''.join(f', h{i}_{j} - h{i}_{k} * h{k}_{j} / h{k}_{k} AS h{i}_{j}' for i in range(k + 1, K) for j in range(k + 1, K))} FROM b{p}_{k})" for k in range(K)]
    cost = f"({p * K * K}::DOUBLE / {seen})"
    return f"""g{p} AS (SELECT epoch, {', '.join(sums)} FROM {source} WHERE t >= {most} GROUP BY epoch), k{p} AS (SELECT epoch, {', '.join(more)} FROM {source} WHERE t >= {most} GROUP BY epoch), {_eliminated(f'g{p}', 'epoch, ', m, K, f'e{p}_')},
b{p}_0 AS MATERIALIZED (SELECT epoch, {', '.join(left)} FROM e{p}_{m} JOIN k{p} USING (epoch)), {', '.join(pivots)},
o{p} AS (SELECT epoch, {p} AS lags, ld + 2 * {cost}::DOUBLE AS aic, ld + ln({seen}) * {cost}::DOUBLE AS bic, ld + 2 * ln(ln({seen})) * {cost}::DOUBLE AS hqic, pow(({seen} + {m})::DOUBLE / {down}, {K}) * exp(ld) AS fpe
      FROM (SELECT epoch, {' + '.join(f'ln(d{k})' for k in range(K))} AS ld FROM b{p}_{K}))"""


_MOST = 3
ORACLES["select_order"] = f"""WITH {DAYS}, {_lagged(_MOST)}, {', '.join(_order(p, _MOST) for p in range(1, _MOST + 1))}, o AS ({' UNION ALL '.join(f'SELECT * FROM o{p}' for p in range(1, _MOST + 1))})
SELECT epoch, {', '.join(f'CAST(arg_min(lags, {c}) AS INT) AS {c}' for c in ('aic', 'bic', 'hqic', 'fpe'))} FROM o GROUP BY epoch"""

ORACLES["select_order_pooled"] = f"""WITH {DAYS}, {_lagged(_MOST)}, lp AS (SELECT * REPLACE (0 AS epoch) FROM l), ne AS (SELECT count(DISTINCT epoch) AS n FROM sig),
{', '.join(_order(p, _MOST, many='(SELECT n FROM ne)', source='lp') for p in range(1, _MOST + 1))}, o AS ({' UNION ALL '.join(f'SELECT * FROM o{p}' for p in range(1, _MOST + 1))})
SELECT CAST(lags AS INT) AS lags, {', '.join(_r(c, c, 5) for c in ('aic', 'bic', 'hqic', 'fpe'))} FROM o"""

# the same within each epoch, from means over time
_BY_EPOCH = "av AS (SELECT epoch, seed, target, f, avg(re) AS re, avg(im) AS im FROM x GROUP BY ALL)"
ORACLES["gc_time"] = f"""{_wavelets(freqs=tuple(float(f) for f in range(3, 12)), cycles=1.5)}, {_pairs('tf', 't', every=True)}, {_BY_EPOCH}, {_causality(0, [0, 1], 3, False, 9, 'epoch, ')}
SELECT con, f, {_r('avg(gc)', 'value')} FROM gc0 GROUP BY ALL"""
_TWO_EACH = TWO.split(", w AS (SELECT f,", 1)[1].replace("GROUP BY f)", "GROUP BY epoch, f)").replace("(SELECT f, ", "(SELECT epoch, f, ")
ORACLES["mim_time"] = f"{TFR}, {_pairs('tf', 't', every=True)}, {_BY_EPOCH}, w AS (SELECT epoch, f,{_TWO_EACH} SELECT epoch, f, {_r('m00 + m11', 'value')} FROM m"
# a decomposition: filters of two channels with two over a band, by inverse roots and the vectors of E E' and E' E; each vector's largest entry is positive
_BAND = f"""{SPECTRA}, {_pairs(every=True)}, av AS (SELECT seed, target, avg(re) AS re, avg(im) AS im FROM x WHERE f BETWEEN 3 AND 6 GROUP BY ALL), w AS (SELECT {_CELLS} FROM av),
d AS (SELECT *, sqrt(r00 * r11 - r01 * r01) AS sa, sqrt(r22 * r33 - r23 * r23) AS sb FROM w), h AS (SELECT *, sqrt(r00 + r11 + 2 * sa) AS ta, sqrt(r22 + r33 + 2 * sb) AS tb FROM d),
q AS (SELECT *, {_ROOT.format(0, 1, 'a')}, {_ROOT.format(2, 3, 'b')} FROM h),
p AS (SELECT *, a00 * i02 + a01 * i12 AS p00, a00 * i03 + a01 * i13 AS p01, a01 * i02 + a11 * i12 AS p10, a01 * i03 + a11 * i13 AS p11 FROM q),
e AS (SELECT *, p00 * b00 + p01 * b01 AS e00, p00 * b01 + p01 * b11 AS e01, p10 * b00 + p11 * b01 AS e10, p10 * b01 + p11 * b11 AS e11 FROM p),
m AS (SELECT 0 AS side, a00 AS c00, a01 AS c01, a11 AS c11, e00 * e00 + e01 * e01 AS m00, e00 * e10 + e01 * e11 AS m01, e10 * e10 + e11 * e11 AS m11 FROM e
      UNION ALL SELECT 1, b00, b01, b11, e00 * e00 + e10 * e10, e00 * e01 + e10 * e11, e01 * e01 + e11 * e11 FROM e),
v AS (SELECT *, m01 AS v0, {_LEADING} - m00 AS v1 FROM m), k AS (SELECT side, c00, c01, c11, 0 AS component, v0, v1 FROM v UNION ALL SELECT side, c00, c01, c11, 1, -v1, v0 FROM v),
n AS (SELECT *, sqrt(v0 * v0 + v1 * v1) * CASE WHEN abs(v0) >= abs(v1) THEN sign(v0) ELSE sign(v1) END AS long FROM k),
fl AS (SELECT CAST(side AS INT) AS side, CAST(component AS INT) AS component, CAST(ch AS INT) AS ch, CASE ch WHEN 0 THEN c00 * v0 + c01 * v1 ELSE c01 * v0 + c11 * v1 END / long AS weight FROM n CROSS JOIN (SELECT unnest(range(2)) AS ch))"""
ORACLES["decomp_filters"] = f"{_BAND} SELECT side, component, ch, {_r('abs(weight)', 'weight')} FROM fl"
ORACLES["decomp_transform"] = f"{_BAND} SELECT epoch, CAST(2 * side + component AS INT) AS ch, t, {_r('sum(weight * value)', 'value')} FROM fl JOIN sig ON sig.ch = 2 * fl.side + fl.ch GROUP BY epoch, side, component, t"
# a pooled model driven by the same noise at every step, from nothing; the first eleven samples are left out
ORACLES["var_simulate_noise"] = f"""{_var(True)}, q AS (WITH RECURSIVE q AS (SELECT 0 AS n, {', '.join(f'0.0::DOUBLE AS x{i}' for i in range(K))}
UNION ALL SELECT n + 1, {', '.join(f"{' + '.join(f'a{r}_{i} * x{i}' for i in range(K))} + {r + 1}" for r in range(K))} FROM q CROSS JOIN a WHERE n < 30) SELECT * FROM q)
SELECT CAST(ch AS INT) AS ch, CAST(n - 11 AS INT) AS t, {_r(f"[{', '.join(f'x{i}' for i in range(K))}][ch + 1]", 'value', 4)} FROM q CROSS JOIN (SELECT unnest(range({K})) AS ch) WHERE n >= 11"""
# patterns of two channels with one and of one with one, filled up to two: E has one column, so its leading vector is that column
_COLUMN = "a00 * i02 + a01 * i12 AS v0, a01 * i02 + a11 * i12 AS v1"
_ROWS = ", ".join(f"max({part}) FILTER (seed = {i} AND target = {j}) AS {part[0]}{i}{j}" for part in ("re", "im") for i, j in ((0, 0), (0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (0, 2), (1, 2)))
ORACLES["mic_patterns_padded"] = f"""{ALL}, w AS (SELECT f, {_ROWS} FROM av GROUP BY f), h AS (SELECT *, sqrt(r00 * r11 - r01 * r01) AS sa FROM w), d AS (SELECT *, sqrt(r00 + r11 + 2 * sa) AS ta FROM h),
q AS (SELECT *, {_ROOT.format(0, 1, 'a')} FROM d), v AS (SELECT *, {_COLUMN} FROM q),
n AS (SELECT f, 0 AS con, 'seed' AS side, [abs(r00 * v0 + r01 * v1) / sqrt(v0 * v0 + v1 * v1), abs(r01 * v0 + r11 * v1) / sqrt(v0 * v0 + v1 * v1)] AS p FROM v
      UNION ALL SELECT f, 0, 'target', [r22, 0] FROM w UNION ALL SELECT f, 1, 'seed', [r33, 0] FROM w UNION ALL SELECT f, 1, 'target', [r44, 0] FROM w)
SELECT CAST(con AS INT) AS con, f, side, CAST(slot AS INT) AS place, {_r('p[slot + 1]', 'value', 2)} FROM n CROSS JOIN (SELECT unnest(range(2)) AS slot)"""
# days that two hours before the latest event have passed
ORACLES["coh_samples_stream"] = f"""WITH {DAYS}, closed AS (SELECT * FROM sig WHERE DATE '1970-01-01' + CAST(epoch + 1 AS INT) <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)),
{_fourier('closed')}, {_pairs()} SELECT seed, target, f, {_r(MEASURES['coh'], 'coh')}, {_r(MEASURES['wpli2_debiased'], 'wpli2_debiased')} FROM x GROUP BY ALL"""
# tapers are summed before phases are averaged over time
_TAPERED = ORACLES["tfr_multitaper"].split("SELECT epoch, ch, CAST(f AS INT) AS f, 4.0", 1)[0]
ORACLES["plv_time_multitaper"] = f"""{_TAPERED}, x AS (SELECT a.epoch, a.ch AS seed, b.ch AS target, a.f, a.t, sum(a.weight * b.weight * (a.re * b.re + a.im * b.im)) AS re, sum(a.weight * b.weight * (a.im * b.re - a.re * b.im)) AS im
  FROM y a JOIN y b ON a.epoch = b.epoch AND a.f = b.f AND a.k = b.k AND a.t = b.t AND a.ch > b.ch GROUP BY ALL)
SELECT epoch, seed, target, CAST(f AS INT) AS f, {_r(MEASURES['plv'], 'value', 5)} FROM x GROUP BY ALL"""
ORACLES["spectra_decimated"] = f"{SPECTRA} SELECT epoch, ch, f, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM sp WHERE (f BETWEEN 2 AND 6 OR f BETWEEN 5 AND 11) AND (f - 2) % 3 = 0"
ORACLES["mim_every_set"] = f"""{ALL} SELECT CAST(3 * p.seed + p.target - 2 AS INT) AS con, p.f, {_r('p.im * p.im / (a.re * b.re)', 'value')} FROM av p
JOIN av a ON a.seed = p.seed AND a.target = p.seed AND a.f = p.f JOIN av b ON b.seed = p.target AND b.target = p.target AND b.f = p.f WHERE p.seed < 2 AND p.target >= 2"""
ORACLES["edges_sets_of_events"] = """WITH c AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY event_type) - 1 AS ch FROM events WHERE event_type IS NOT NULL GROUP BY event_type),
g AS (SELECT CAST(ch AS INT) AS ch, ch // 2 AS s, n > (SELECT count(*) / count(DISTINCT event_type) FROM events) AS often FROM c),
q AS (SELECT often, s, row_number() OVER (PARTITION BY often ORDER BY s) - 1 AS k FROM (SELECT DISTINCT often, s FROM g)),
p AS (SELECT a.s AS a, b.s AS b, a.k * (SELECT count(*) FROM q WHERE NOT often) + b.k AS con FROM q a JOIN q b ON a.often AND NOT b.often)
SELECT CAST(con AS INT) AS con, CAST(CASE WHEN often THEN 0 ELSE 1 END AS INT) AS side, CAST(row_number() OVER (PARTITION BY con, often ORDER BY ch) - 1 AS INT) AS place, ch FROM p JOIN g ON g.s = CASE WHEN often THEN a ELSE b END"""
# days without their first hour: 23 samples, transformed as 24
ORACLES["analytic_signal_padded"] = f"""{_analytic(f"{DAYS.replace('sig AS', 'whole AS')}, sig AS (SELECT epoch, ch, t - 1 AS t, value FROM whole WHERE t >= 1)")}
SELECT epoch, ch, t, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM z WHERE t < 23"""

# leading components of two channels: the longer axis of a symmetric matrix of two rows; projected channels are 0 and 1 of a connection
_SETS = [([0, 1], [2, 3]), ([4, 2], [1, 0])]


def _projected(con: int, by: str, name: str) -> str:
    """CTEs that end in {name}(seed, target, f, re, im), between the leading components of both sides of a connection; by is 'f' or ''."""
    key, join = ("f, ", "USING (f)") if by else ("", "ON true")
    axis = lambda a, b: f"0.5 * atan2(2 * sum(re) FILTER (seed = {a} AND target = {b}), sum(re) FILTER (seed = {a} AND target = {a}) - sum(re) FILTER (seed = {b} AND target = {b}))"
    (a, b), (c, d) = _SETS[con]
    weights = f"(VALUES (0, {a}, 0), (0, {b}, 1), (1, {c}, 0), (1, {d}, 1)) v(side, ch, sine)"
    return f"""ax{con} AS (SELECT {key}{axis(a, b)} AS a0, {axis(c, d)} AS a1 FROM whole {"GROUP BY f" if by else ""}),
pr{con} AS (SELECT {key}side, ch, CASE sine WHEN 0 THEN cos(CASE side WHEN 0 THEN a0 ELSE a1 END) ELSE sin(CASE side WHEN 0 THEN a0 ELSE a1 END) END AS w FROM ax{con} CROSS JOIN {weights}),
{name} AS (SELECT p.side AS seed, q.side AS target, x.f, sum(p.w * q.w * x.re) AS re, sum(p.w * q.w * x.im) AS im
  FROM whole x JOIN pr{con} p ON p.ch = x.seed {"AND p.f = x.f" if by else ""} JOIN pr{con} q ON q.ch = x.target {"AND q.f = x.f" if by else ""} GROUP BY ALL)"""


_WHOLE_AV = "whole AS (SELECT seed, target, f, avg(re) AS re, avg(im) AS im FROM x GROUP BY ALL)"
ORACLES["mim_rank"] = f"WITH {DAYS}, {_fourier()}, {_pairs(every=True)}, {_WHOLE_AV}, {_projected(0, 'f', 'p0')}, {_projected(1, 'f', 'p1')} " + " UNION ALL ".join(
    f"SELECT CAST({c} AS INT) AS con, f, {_r('max(im) FILTER (seed = 0 AND target = 1) ** 2 / (max(re) FILTER (seed = 0 AND target = 0) * max(re) FILTER (seed = 1 AND target = 1))', 'mim')} FROM p{c} GROUP BY f" for c in range(2)
)
ORACLES["gc_rank_pairs"] = f"WITH {DAYS}, {_fourier(low=0, high=12)}, {_pairs(every=True)}, {_WHOLE_AV}, {', '.join(f"""{_projected(c, '', f'p{c}')}, g{c} AS (WITH av AS (SELECT * FROM p{c}), {_causality(c, [0, 1], 4, False)} SELECT con, f, gc FROM gc{c})""" for c in range(2))} " + " UNION ALL ".join(f"SELECT con, f, {_r('gc', 'gc')} FROM g{c}" for c in range(2))

# components of coherence: the largest singular value of a matrix of two rows over the phase, by a grid that closes in; then what is orthogonal to both filters
_TURNED = [f"(cos(phi) * e{i}{j} + sin(phi) * o{i}{j})" for i in range(2) for j in range(2)]
_SINGULAR = f"(({' + '.join(f'{t} ** 2' for t in _TURNED)}) / 2 + sqrt(greatest((({' + '.join(f'{t} ** 2' for t in _TURNED)}) / 2) ** 2 - ({_TURNED[0]} * {_TURNED[3]} - {_TURNED[1]} * {_TURNED[2]}) ** 2, 0)))"


def _whitened(part: str, out: str) -> str:
    p = lambda i, j: "(" + " + ".join(f"a{min(i, k)}{max(i, k)} * {part}{k}{2 + m} * b{min(m, j)}{max(m, j)}" for k in range(2) for m in range(2)) + ")"
    return ", ".join(f"{p(i, j)} AS {out}{i}{j}" for i in range(2) for j in range(2))


def _between(part: str, u: tuple[str, str], v: tuple[str, str], rows: tuple[int, int], cols: tuple[int, int]) -> str:
    return "(" + " + ".join(f"{u[i]} * {part}{rows[i]}{cols[j]} * {v[j]}" for i in range(2) for j in range(2)) + ")"


_GA, _GB = ("-fa1", "fa0"), ("-fb1", "fb0")
ORACLES["cacoh_multi"] = f"""{ALL}, w AS (SELECT f, {_CELLS} FROM av GROUP BY f),
d AS (SELECT *, sqrt(r00 * r11 - r01 * r01) AS sa, sqrt(r22 * r33 - r23 * r23) AS sb FROM w), h AS (SELECT *, sqrt(r00 + r11 + 2 * sa) AS ta, sqrt(r22 + r33 + 2 * sb) AS tb FROM d),
q AS (SELECT *, {_ROOT.format(0, 1, 'a')}, {_ROOT.format(2, 3, 'b')} FROM h), e AS MATERIALIZED (SELECT *, {_whitened('r', 'e')}, {_whitened('i', 'o')} FROM q),
z AS (WITH RECURSIVE z AS (SELECT 0 AS n, f, 0.0::DOUBLE AS mid, pi() / 2 AS half FROM e
  UNION ALL SELECT n + 1, f, arg_max(phi, {_SINGULAR}), half / 16 FROM (SELECT z.n, z.f, z.half, z.mid + z.half * k / 64 AS phi, e.* EXCLUDE (f) FROM z JOIN e ON e.f = z.f CROSS JOIN (SELECT unnest(range(-64, 65)) AS k) WHERE z.n < 10) GROUP BY n, f, half) SELECT f, mid AS phi FROM z WHERE n = 10),
m AS (SELECT e.*, phi, {', '.join(f'{t} AS m{k // 2}{k % 2}' for k, t in enumerate(_TURNED))}, {_SINGULAR} AS square FROM e JOIN z ON z.f = e.f),
u AS (SELECT *, m00 * m10 + m01 * m11 AS u0, square - m00 * m00 - m01 * m01 AS u1 FROM m), v AS (SELECT *, m00 * u0 + m10 * u1 AS v0, m01 * u0 + m11 * u1 AS v1 FROM u),
g AS (SELECT *, a00 * u0 + a01 * u1 AS fa0, a01 * u0 + a11 * u1 AS fa1, b00 * v0 + b01 * v1 AS fb0, b01 * v0 + b11 * v1 AS fb1 FROM v),
l AS (SELECT f, square, {_between('r', _GA, _GB, (0, 1), (2, 3))} AS re, {_between('i', _GA, _GB, (0, 1), (2, 3))} AS im, {_between('r', _GA, _GA, (0, 1), (0, 1))} * {_between('r', _GB, _GB, (2, 3), (2, 3))} AS power FROM g)
SELECT f, CAST(component AS INT) AS component, {_r('CASE component WHEN 1 THEN sqrt(square) ELSE sqrt((re * re + im * im) / power) END', 'cacoh', 5)} FROM l CROSS JOIN (SELECT unnest([1, 2]) AS component)"""

# pairs of channels: sums of products over a day
_DUO = f"""WITH {DAYS}, two AS (SELECT a.epoch * 100 + a.ch * 10 + b.ch AS epoch, a.t, a.value AS x, b.value AS y FROM sig a JOIN sig b ON b.epoch = a.epoch AND b.t = a.t AND a.ch < b.ch)"""
# the square root's principal branch: half the turn of each eigenvalue, of two negative ones nothing real
_FB = {
    "both": "CASE WHEN half * half < det THEN 0 WHEN half - sqrt(half * half - det) >= 0 THEN 0 WHEN half + sqrt(half * half - det) > 0 THEN 1 ELSE 2 END",
    "low": "sqrt(greatest(sqrt(greatest(half * half - det, 0)) - half, 0))",
    "high": "sqrt(greatest(half + sqrt(greatest(half * half - det, 0)), 0))",
}


def _operator(z: str, a: str, b: str, d: str, past: list[tuple[str, str]]) -> str:
    """{z}ij from the products (a, b, b, d) of the lagged with themselves, and of each channel with both of them; by the pseudoinverse of a singular matrix."""
    solved = lambda p, q: (f"({p} * {d} - {q} * {b}) / ({a} * {d} - {b} * {b})", f"({q} * {a} - {p} * {b}) / ({a} * {d} - {b} * {b})")
    pseudo = lambda p, q: (f"coalesce(({p} * {a} + {q} * {b}) / nullif({a} * {a} + 2 * {b} * {b} + {d} * {d}, 0), 0)", f"coalesce(({p} * {b} + {q} * {d}) / nullif({a} * {a} + 2 * {b} * {b} + {d} * {d}, 0), 0)")
    return ", ".join(f"CASE WHEN {a} * {d} = {b} * {b} THEN {pseudo(*pq)[j]} ELSE {solved(*pq)[j]} END AS {z}{i}{j}" for i, pq in enumerate(past) for j in range(2))


_OPERATORS = f"{_operator('a', 'oo', 'op', 'pp', [('xo', 'xp'), ('yo', 'yp')])}, {_operator('b', 'xx', 'xy', 'yy', [('xo', 'yo'), ('xp', 'yp')])}"
_INVERSE = [("b11", "b00"), ("-b01", "b10"), ("-b10", "b01"), ("b00", "b11")]
_INVERTED = ", ".join(f"CASE WHEN d = 0 THEN coalesce({turned} / nullif(b00 * b00 + b01 * b01 + b10 * b10 + b11 * b11, 0), 0) ELSE {cofactor} / d END AS i{k // 2}{k % 2}" for k, (cofactor, turned) in enumerate(_INVERSE))
_TIMES = "sqrt(2 * half + 2 * sqrt(det))"
ORACLES["var_fb_pairs"] = f"""{_DUO}, l AS (SELECT *, lag(x) OVER (PARTITION BY epoch ORDER BY t) AS o, lag(y) OVER (PARTITION BY epoch ORDER BY t) AS p FROM two),
s AS (SELECT epoch, sum(o * o) AS oo, sum(o * p) AS op, sum(p * p) AS pp, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * o) AS xo, sum(x * p) AS xp, sum(y * o) AS yo, sum(y * p) AS yp FROM l WHERE t >= 1 GROUP BY epoch),
o AS (SELECT epoch, {_OPERATORS} FROM s), n AS (SELECT *, b00 * b11 - b01 * b10 AS d FROM o), i AS (SELECT *, {_INVERTED} FROM n),
q AS (SELECT epoch, {', '.join(f'a{i}0 * i0{j} + a{i}1 * i1{j} AS q{i}{j}' for i in range(2) for j in range(2))} FROM i),
k AS (SELECT *, (q00 + q11) / 2 AS half, q00 * q11 - q01 * q10 AS det FROM q), c AS (SELECT *, {_FB['both']} AS below, {_FB['low']} AS lo, {_FB['high']} AS hi FROM k),
r AS (SELECT *, CASE below WHEN 0 THEN CASE WHEN half = 0 AND det = 0 THEN CASE WHEN abs(q01) + abs(q10) > 0 THEN NULL ELSE 0 END ELSE 1 / {_TIMES} END WHEN 1 THEN hi / (hi * hi + lo * lo) ELSE 0 END AS times, CASE below WHEN 0 THEN coalesce(sqrt(det) / nullif({_TIMES}, 0), 0) WHEN 1 THEN hi * lo * lo / (hi * hi + lo * lo) ELSE 0 END AS plus FROM c)
SELECT epoch, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(1 AS INT) AS lag, {_r('[q00, q01, q10, q11][2 * i + j + 1] * times + CASE WHEN i = j THEN plus ELSE 0 END', 'value', 4)}
FROM r CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)"""
# orthogonalisation in turns on the matrix of products alone: the inverse root of that of the scaled signals, then new scales
ORACLES["symmetric_orth_pairs"] = f"""{_DUO}, g AS (SELECT epoch, sum(x * x) AS g00, sum(x * y) AS g01, sum(y * y) AS g11 FROM two GROUP BY epoch),
z AS (WITH RECURSIVE z AS (SELECT 0 AS n, epoch, g00, g01, g11, 1.0::DOUBLE AS s0, 1.0::DOUBLE AS s1, 0.0::DOUBLE AS b01, 0.0::DOUBLE AS b10, NULL::DOUBLE AS error, false AS done FROM g
  UNION ALL SELECT n + 1, epoch, g00, g01, g11, new0, new1, w00 * s0 * g01 + w01 * s1 * g11, w01 * s0 * g00 + w11 * s1 * g01, now, coalesce((error - now) / now < 1e-6, false) OR now = 0
  FROM (SELECT *, g00 + g11 - new0 * new0 - new1 * new1 AS now FROM (SELECT *, w00 * s0 * g00 + w01 * s1 * g01 AS new0, w01 * s0 * g01 + w11 * s1 * g11 AS new1
    FROM (SELECT *, (s1 * s1 * g11 + root) / (root * long) AS w00, -s0 * s1 * g01 / (root * long) AS w01, (s0 * s0 * g00 + root) / (root * long) AS w11
      FROM (SELECT *, sqrt(s0 * s0 * g00 + s1 * s1 * g11 + 2 * root) AS long FROM (SELECT *, s0 * s1 * sqrt(g00 * g11 - g01 * g01) AS root FROM z WHERE NOT done AND n < 50)))))) SELECT * FROM z),
e AS (SELECT * FROM z QUALIFY n = max(n) OVER (PARTITION BY epoch))
SELECT epoch, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_r('[s0 * s0, s0 * b01, s1 * b10, s1 * s1][2 * i + j + 1]', 'product', 2)} FROM e CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)"""


# a band-pass by its frequency response: gains in between by straight lines, half a spectrum summed up to taps, a Hamming window
_EDGES = [(1.0, 0.0), (3.0, 1.0), (6.0, 1.0), (8.0, 0.0)]
_GRID, _N_TAPS = 1024, 11


def _gain(f: float) -> float:
    return next((g + (h - g) * (f - a) / (b - a) for (a, g), (b, h) in zip(_EDGES, _EDGES[1:], strict=False) if a <= f <= b), 0.0)


def _tap(i: int) -> float:
    turn = [(1 if 0 < k < _GRID else 0.5) * _gain(12 * k / _GRID) * math.cos(math.pi * k / _GRID * (i - (_N_TAPS - 1) / 2)) for k in range(_GRID + 1)]
    return sum(turn) / _GRID * (0.54 - 0.46 * math.cos(2 * math.pi * i / (_N_TAPS - 1)))


_BAND = f"""fir(j, h) AS (VALUES {", ".join(f"({i - _N_TAPS // 2}, {_tap(i)!r}::DOUBLE)" for i in range(_N_TAPS))}),
band AS (SELECT a.epoch, a.ch, a.t, sum(h * coalesce(b.value, 0)) AS v FROM sig a CROSS JOIN fir LEFT JOIN sig b ON b.epoch = a.epoch AND b.ch = a.ch AND b.t = a.t - j GROUP BY ALL)"""
ORACLES["events_band_passed"] = f"WITH {DAYS}, {_BAND} SELECT epoch, ch, t, {_r('v', 'value', 4)} FROM band"
_COUPLED = f"""WITH {DAYS}, {_BAND}, drive AS (SELECT epoch, t, CASE WHEN stddev_pop(v) OVER w > 0 THEN v / stddev_pop(v) OVER w ELSE 0 END AS s FROM band WHERE ch = 0 WINDOW w AS (PARTITION BY epoch)),
own AS (SELECT epoch, ch, t, CASE WHEN stddev_pop(value) OVER w > 0 THEN value / stddev_pop(value) OVER w ELSE 0 END AS v FROM sig WHERE ch > 0 WINDOW w AS (PARTITION BY epoch, ch)),
cpl AS (SELECT own.epoch, ch, own.t, 0.6::DOUBLE * coalesce(s, 0) + 0.4::DOUBLE * v AS value FROM own LEFT JOIN drive ON drive.epoch = own.epoch AND drive.t = own.t - CASE WHEN ch >= 3 THEN 2 ELSE 0 END)"""
ORACLES["events_coupled"] = f"{_COUPLED} SELECT epoch, ch, t, {_r('value', 'value')} FROM cpl"
ORACLES["events_coupled_coherence"] = f"{_COUPLED}, {_fourier('cpl')}, {_pairs()} SELECT seed, target, f, {_r(MEASURES['coh'], 'coh')}, {_r(MEASURES['dpli'], 'dpli')} FROM x GROUP BY ALL"
