"""DuckDB SQL for the registered queries: an independent statement of the same results on the same tables."""

from __future__ import annotations

from ..functions.text import CHORD_KINDS
from ..operators.chords import FLATS, TEMPLATES
from ..sources.bindings import TEMPO_SEGMENTS

NE = """o AS (SELECT user_id AS track_id, event_id, value, epoch_us(ts) AS us, MIN(epoch_us(ts)) OVER (PARTITION BY user_id) AS us0,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM events),
ne AS (SELECT track_id, CAST(id AS INT) AS id, CAST(21 + (event_id * 7) % 88 AS INT) AS pitch, CAST(us - us0 AS DOUBLE) / 43200000000.0 AS start_time,
  CAST(us - us0 AS DOUBLE) / 43200000000.0 + 0.05 + value / 200.0 AS end_time, CAST(1 + (event_id * 13) % 127 AS INT) AS velocity FROM o)"""
NFA = "nfa AS (SELECT CAST(label AS BIGINT) AS track_id, CAST(ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding FROM embeddings)"
NF = NFA + ", nf AS (SELECT track_id, frame, CAST(i + 20 AS INT) AS pitch, least(1.0, abs(CAST(embedding[i] AS DOUBLE)) * 4) AS prob FROM nfa, range(1, 65) r(i))"
SG = NFA + ", sg AS (SELECT track_id, CAST(frame AS BIGINT) * 64 + i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM nfa, range(1, 65) r(i))"
TR = "tr AS (SELECT DISTINCT user_id AS track_id FROM events)"
BT = TR + ", bt AS (SELECT track_id, CAST(i AS INT) AS beat_idx, i * 0.5::DOUBLE + ((i * 7) % 5 - 2) / 100.0::DOUBLE + 0.02::DOUBLE AS t FROM tr, range(0, 131) r(i)), db AS (SELECT track_id, beat_idx // 4 AS db_idx, t FROM bt WHERE beat_idx % 4 = 0)"
TS = "ts AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for n, (a, b, c, d, e) in enumerate(TEMPO_SEGMENTS)) + ") v(seg_no, s, e, bpm, bd, off))"
SS = NF + ", sf AS (SELECT CAST(1 AS BIGINT) AS song, CAST(track_id % 6 AS INT) AS stem_idx, frame, pitch, MAX(prob) AS prob FROM nf GROUP BY ALL)"
STS = SG + ", st AS (SELECT CAST(1 AS BIGINT) AS song, CAST(track_id % 6 AS INT) AS stem_idx, i, MAX(x) AS x FROM sg GROUP BY ALL)"
SIG = "sig AS (SELECT * FROM (VALUES (0.0::DOUBLE, 32.0::DOUBLE, 4, 4, 1.0::DOUBLE), (32.0, 80.0, 3, 4, 0.8)) v(start_beat, end_beat, numerator, denominator, confidence))"


def _snap_start(v: str) -> str:
    e = lambda g: f"abs({v} - round({v} / {g}) * {g})"
    b2 = f"CASE WHEN {e(0.5)} + 0.03 < {e(1.0)} THEN round({v} / 0.5) * 0.5 ELSE round({v}) END"
    e2 = f"CASE WHEN {e(0.5)} + 0.03 < {e(1.0)} THEN {e(0.5)} ELSE {e(1.0)} END"
    return f"CASE WHEN {e(0.25)} + 0.03 < {e2} THEN round({v} / 0.25) * 0.25 ELSE {b2} END"


def _fold_durations(source: str = "d_", name: str = "d") -> str:
    """CTEs name0 to name7: best point and error after each candidate length, from source with columns d, be, er."""
    out = []
    for k, g in enumerate((4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.25)):
        p, e = f"round(d / {g}) * {g}", f"abs(d - round(d / {g}) * {g})"
        out.append(f"{name}{k} AS (SELECT * REPLACE (CASE WHEN {e} + 0.015 < er THEN {p} ELSE be END AS be, CASE WHEN {e} + 0.015 < er THEN {e} ELSE er END AS er) FROM {f'{name}{k - 1}' if k else source})")
    return ", ".join(out)


QC = NE + f""", q_ AS (SELECT track_id, id, pitch, velocity, start_time / 0.5 AS b0, greatest(0.0, end_time / 0.5 - start_time / 0.5) AS d FROM ne),
d_ AS (SELECT *, CAST(NULL AS DOUBLE) AS be, CAST('inf' AS DOUBLE) AS er FROM q_), {_fold_durations()},
q AS (SELECT track_id, id, pitch, velocity, {_snap_start('b0')} AS beat_start, greatest(0.25, coalesce(be, 0.25)) AS beat_duration FROM d7)"""
BARS = SIG + """, bl AS (SELECT DISTINCT start_beat + k * 4.0 * numerator / denominator AS beat FROM sig, range(0, 100) r(k) WHERE start_beat + k * 4.0 * numerator / denominator < least(end_beat, 120.0) - 1e-9
  UNION SELECT 80.0 + 4.0 * k FROM range(0, 11) r(k))"""
AL = NE + ", " + BT + """, bx AS (SELECT *, LEAD(t) OVER w AS nt, LAG(t) OVER w AS lt, COUNT(*) OVER (PARTITION BY track_id) AS n FROM bt WINDOW w AS (PARTITION BY track_id ORDER BY beat_idx)),
bs AS (SELECT track_id, t AS pb, coalesce(nt, t + t - lt) AS nb, CAST(least(beat_idx, n - 2) AS INT) AS bi, (SELECT MAX(d.db_idx) FROM db d WHERE d.track_id = bx.track_id AND d.t <= bx.t + 0.001) AS bar FROM bx),
al AS (SELECT ne.*, coalesce(bs.pb, f.t0) AS pb, coalesce(bs.nb, f.t1) AS nb, coalesce(bs.bi, 0) AS bi, coalesce(bs.bar, 0) AS bar FROM ne
  JOIN (SELECT track_id, MIN(t) FILTER (beat_idx = 0) AS t0, MIN(t) FILTER (beat_idx = 1) AS t1 FROM bt GROUP BY 1) f USING (track_id) ASOF LEFT JOIN bs ON ne.track_id = bs.track_id AND ne.start_time >= bs.pb),
aln AS (SELECT *, nb - pb AS bd, greatest(0.0, least(1.0, (start_time - pb) / (nb - pb))) AS ip FROM al)"""
SEC = AL + """, bn AS (SELECT *, CAST(least(round(ip * 20), 19) AS INT) AS b, CAST(floor(bar / 4.0) AS INT) AS section FROM aln),
sec AS (SELECT track_id, section, COUNT(*) AS n, COUNT(DISTINCT bar) AS nbars, COUNT(*) FILTER (b IN (0, 1, 19)) AS onb, COUNT(*) FILTER (b BETWEEN 9 AND 11) AS st, COUNT(*) FILTER (b BETWEEN 12 AND 14) AS sw FROM bn GROUP BY 1, 2),
sx AS (SELECT *, (n >= 4 AND nbars >= 2 AND (onb + sw) / CAST(n AS DOUBLE) > 0.55 AND sw > st) AS is_sw FROM sec)"""
ISL = """on_ AS (SELECT *, frame - ROW_NUMBER() OVER (PARTITION BY {k}, pitch ORDER BY frame) AS run FROM {src} WHERE prob >= {t}),
isl AS (SELECT {k}, pitch, MIN(frame) AS f0, MAX(frame) + 1 AS f1, MAX(prob) AS peak FROM on_ GROUP BY {k}, pitch, run),
ni AS (SELECT {k}, CAST(ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY pitch, f0) AS INT) AS id, pitch, f0 * 0.05::DOUBLE AS start_time, f1 * 0.05::DOUBLE AS end_time, CAST(greatest(1, least(127, round(peak * 127))) AS INT) AS velocity FROM isl)"""
MRG = """mb AS (SELECT *, MAX(end_time) OVER (PARTITION BY {k}, pitch ORDER BY start_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS be FROM {src}),
mg AS (SELECT *, SUM(CASE WHEN be IS NULL OR start_time - be >= {g} THEN 1 ELSE 0 END) OVER (PARTITION BY {k}, pitch ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS grp FROM mb),
mm AS (SELECT {k}, arg_min(id, struct_pack(s := start_time, i := id)) AS id, pitch, MIN(start_time) AS start_time, MAX(end_time) AS end_time, MAX(velocity) AS velocity FROM mg GROUP BY {k}, pitch, grp)"""
_NOTE = "id, pitch, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, velocity"
_W = "PARTITION BY track_id, pitch ORDER BY frame"


def _to_beat(t: str) -> str:
    """Beat at a time: the segment that holds it, the first before all, the last otherwise."""
    rows = [f"WHEN {t} >= {a} AND {t} < {b} THEN {e} + ({t} - {a}) / {d}" for a, b, _, d, e in TEMPO_SEGMENTS]
    (a0, _, _, d0, e0), (a2, _, _, d2, e2) = TEMPO_SEGMENTS[0], TEMPO_SEGMENTS[-1]
    return f"CASE {' '.join(rows)} WHEN {t} < {a0} THEN {e0} + ({t} - {a0}) / {d0} ELSE {e2} + ({t} - {a2}) / {d2} END"


def _to_time(b: str) -> str:
    rows = [f"WHEN {b} >= {e} AND {b} <= {e} + ({z} - {a}) / {d} THEN greatest({a}::DOUBLE, least({z}::DOUBLE, {a} + ({b} - {e}) * {d}))" for a, z, _, d, e in TEMPO_SEGMENTS]
    a, z, _, d, e = TEMPO_SEGMENTS[-1]
    return f"CASE {' '.join(rows)} ELSE greatest({a}::DOUBLE, least({z}::DOUBLE, {a} + ({b} - {e}) * {d})) END"


_TEMPLATES = ", ".join(f"({r}, {n}, {sum(1 << ((r + i) % 12) for i in iv)}, {len(iv)})" for r in range(12) for n, (_, iv) in enumerate(TEMPLATES))
CS = f"""sh AS (SELECT * FROM (VALUES {_TEMPLATES}) v(root, template, shape, k)),
cs AS (SELECT CAST(m AS INT) AS mask, root, template, CAST(bit_count(CAST(m AS INT) & shape) * 4 - (bit_count(CAST(m AS INT)) - bit_count(CAST(m AS INT) & shape)) + CASE WHEN k = 3 THEN 1 WHEN k = 4 THEN 0 ELSE 4 - k END AS INT) AS score
  FROM range(1, 4096) r(m), sh WHERE bit_count(CAST(m AS INT) & shape) >= 2)"""
_NAMES = "[" + ", ".join(f"'{x}'" for x in FLATS) + "]"
_KINDS = "[" + ", ".join(f"'{k}'" for k, _ in TEMPLATES) + "]"
# the letter of the interval, then what is left to the natural note of that letter; four names give way to naturals
_LETTER = "(([0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 6][x.root + 1] + [0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 6][(bass - x.root + 12) % 12 + 1]) % 7 + 1)"
_RAW = f"(substr('CDEFGAB', {_LETTER}, 1) || CASE (bass + 12 - [0, 2, 4, 5, 7, 9, 11][{_LETTER}]) % 12 WHEN 0 THEN '' WHEN 1 THEN '#' ELSE 'b' END)"
_BASS = f"(CASE {_RAW} WHEN 'Cb' THEN 'B' WHEN 'Fb' THEN 'E' WHEN 'B#' THEN 'C' WHEN 'E#' THEN 'F' ELSE {_RAW} END)"
CT = CS + f""", bb AS (SELECT mask, CAST(b AS INT) AS bass, arg_max(struct_pack(root := root, template := template), (score + CASE WHEN root = b THEN 2 ELSE 0 END) * 100000 - root * 100 - template) AS x FROM cs, range(-1, 12) r(b) GROUP BY 1, 2),
ev AS (SELECT CAST(m AS INT) AS mask, CAST(b AS INT) AS bass, list_filter(range(0, 12), lambda p: (CAST(m AS INT) & CAST(power(2, p) AS INT)) <> 0) AS pcs FROM range(1, 4096) r(m), range(-1, 12) s(b)),
ct AS (SELECT mask, bass, CASE WHEN len(pcs) = 1 THEN {_NAMES}[pcs[1] + 1] || ' (8ve)' WHEN len(pcs) = 2 AND pcs[2] - pcs[1] = 7 THEN {_NAMES}[pcs[1] + 1] || '5'
  ELSE {_NAMES}[x.root + 1] || {_KINDS}[x.template + 1] || CASE WHEN bass >= 0 AND bass <> x.root THEN '/' || {_BASS} ELSE '' END END AS symbol FROM ev LEFT JOIN bb USING (mask, bass))"""
SND = """snd AS (SELECT g.track_id, g.beat, CAST(SUM(DISTINCT power(2, q.pitch % 12)) AS INT) AS mask, CAST(MIN(q.pitch) % 12 AS INT) AS bass, COUNT(*) AS n_notes, SUM(q.beat_duration) AS held
  FROM {grid} g JOIN q ON q.track_id = g.track_id AND q.beat_start - 1e-5 <= g.beat AND g.beat < q.beat_start + q.beat_duration GROUP BY 1, 2)"""
# kernels of 35 semitones from 27.5 Hz: three periods, a Gaussian, unit length
CQ = """fq AS (SELECT CAST(k AS INT) AS k, 27.5::DOUBLE * power(2, k / 12.0::DOUBLE) AS f FROM range(0, CAST(ceil(log2(200 / 27.5::DOUBLE) * 12) AS INT)) r(k)),
kj AS (SELECT k, f, j, (j - (ceil(3 * 441 / f) - 1) / 2) / 441 AS t FROM fq, range(0, 64) r(j) WHERE j < ceil(3 * 441 / f)),
kw AS (SELECT *, exp(-2 * pi() * (f / 20) * t * t) AS w FROM kj),
kern AS (SELECT k, j, w * cos(2 * pi() * f * t) / norm AS c, w * sin(2 * pi() * f * t) / norm AS s FROM (SELECT *, sqrt(SUM(w * w) OVER (PARTITION BY k)) + 1e-7 AS norm FROM kw))"""
_PC = "coalesce((CASE substr({0}, 1, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END + CASE substr({0}, 2, 1) WHEN 'b' THEN 11 WHEN '#' THEN 1 ELSE 0 END) % 12, 0)"
HS = f"{QC}, g AS (SELECT DISTINCT track_id, floor(beat_start) AS beat FROM q), {SND.format(grid='g')}, hs AS (SELECT mask, bass, COUNT(*) AS n FROM snd GROUP BY 1, 2)"
PRS = f"""{HS}, {CT}, sy AS (SELECT DISTINCT symbol FROM hs LEFT JOIN ct USING (mask, bass)), hd AS (SELECT symbol, split_part(symbol, '/', 1) AS head, split_part(symbol, '/', 2) AS low FROM sy),
rt AS (SELECT *, regexp_extract(head, '^([A-G][#b]?)(.*)$', 1) AS name, regexp_extract(head, '^([A-G][#b]?)(.*)$', 2) AS rest FROM hd),
prs AS (SELECT symbol, CAST(CASE WHEN name <> '' THEN {_PC.format('name')} ELSE 0 END AS INT) AS root, CASE WHEN name <> '' THEN rest ELSE substr(head, 2) END AS suffix, CAST(CASE WHEN low <> '' THEN {_PC.format('low')} END AS INT) AS bass FROM rt)"""
_CHG = "SELECT track_id, beat, symbol FROM (SELECT *, LAG(symbol) OVER (PARTITION BY track_id ORDER BY beat) AS was FROM {src} WHERE symbol IS NOT NULL) WHERE was IS NULL OR was <> symbol"
BG = BT + ", bg AS (SELECT track_id, beat_idx, LEAD(t) OVER (PARTITION BY track_id ORDER BY beat_idx) - t AS gap FROM bt)"
BC = BG + """, bar AS (SELECT track_id, db_idx, t AS bar_t, LEAD(t) OVER (PARTITION BY track_id ORDER BY db_idx) AS next_t FROM db),
bc AS (SELECT bar.track_id, db_idx, bar_t, next_t, COUNT(*) AS nb, median(gap) AS bg FROM bar JOIN bt ON bt.track_id = bar.track_id AND bt.t >= bar_t - 0.001 AND bt.t < next_t - 0.001 JOIN bg ON bg.track_id = bt.track_id AND bg.beat_idx = bt.beat_idx WHERE next_t IS NOT NULL GROUP BY 1, 2, 3, 4)"""
SPAN = QC + f""", e_ AS (SELECT track_id, id, pitch, velocity, beat_start AS bs0, beat_duration AS d, CAST(NULL AS DOUBLE) AS be, CAST('inf' AS DOUBLE) AS er FROM q), {_fold_durations('e_', 'x')},
sp0 AS (SELECT track_id, id, pitch, velocity, CAST(round(bs0 * 480) AS INT) AS start_tick, CAST(round(bs0 * 480) AS INT) + CAST(round(greatest(0.25, coalesce(be, 0.25)) * 480) AS INT) AS end_tick, CASE WHEN pitch >= 60 THEN 1 ELSE 2 END AS staff FROM x7),
sp AS (SELECT * EXCLUDE rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, start_tick, pitch ORDER BY end_tick DESC, id) AS rn FROM sp0) WHERE rn = 1)"""
MT = NE + ", " + TS + """, mt AS (SELECT * FROM (VALUES (2, 4, 0.92::DOUBLE, 0), (3, 4, 0.94, 1), (4, 4, 1.0, 2), (6, 8, 0.90, 3), (12, 8, 0.86, 4)) v(num, den, prior, rank)),
mn AS (SELECT track_id, seg_no, num, den, prior, rank, velocity / 127.0 AS v, ((start_time - s) / bd) % CAST(num AS DOUBLE) AS phase FROM ne JOIN ts ON start_time >= s AND start_time < e, mt),
mh AS (SELECT track_id, seg_no, num, den, prior, rank, CAST(round(phase) AS INT) % num AS bin, SUM(greatest(0.2, least(1.0, v)) * greatest(0.15, least(1.0, 1 - 0.7 * abs(phase - CAST(round(phase) AS INT) % num)))) AS w, COUNT(*) AS n FROM mn GROUP BY ALL),
ma AS (SELECT track_id, seg_no, num, den, prior, rank, SUM(w) AS total, SUM(n) AS n FROM mh GROUP BY ALL),
mr AS (SELECT ma.*, (coalesce(mh.w, 0) * 1.35 - (total - coalesce(mh.w, 0)) / (ma.num - 1) + total / ma.num) / greatest(total, 1.0) AS score
  FROM ma JOIN range(0, 12) r(rot) ON rot < ma.num LEFT JOIN mh ON mh.track_id = ma.track_id AND mh.seg_no = ma.seg_no AND mh.num = ma.num AND mh.bin = rot),
mx AS (SELECT track_id, seg_no, num, den, prior, rank, n, MAX(score) + prior AS score FROM mr GROUP BY track_id, seg_no, num, den, prior, rank, n),
mb_ AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, seg_no ORDER BY round(score, 9) DESC, rank) AS rn FROM mx),
ms AS (SELECT t.track_id, ts.seg_no, off AS start_beat, off + (e - s) / bd AS end_beat, CASE WHEN coalesce(n, 0) >= 8 THEN num ELSE 4 END AS numerator, CASE WHEN coalesce(n, 0) >= 8 THEN den ELSE 4 END AS denominator,
  CASE WHEN coalesce(n, 0) >= 8 THEN greatest(0.05, least(0.99, (score - 0.2) / 3)) ELSE 0.2 END AS confidence FROM (SELECT DISTINCT track_id FROM ne) t CROSS JOIN ts LEFT JOIN mb_ ON mb_.track_id = t.track_id AND mb_.seg_no = ts.seg_no AND rn = 1),
mc AS (SELECT *, CASE WHEN numerator = LAG(numerator) OVER w AND denominator = LAG(denominator) OVER w THEN 0 ELSE 1 END AS fresh FROM ms WINDOW w AS (PARTITION BY track_id ORDER BY seg_no)),
mg_ AS (SELECT *, SUM(fresh) OVER (PARTITION BY track_id ORDER BY seg_no) AS grp FROM mc)"""

SB = BT + """, sb AS (SELECT track_id, CAST(CASE WHEN track_id % 2 = 1 THEN beat_idx ELSE beat_idx // 4 END AS INT) AS k, t FROM bt WHERE track_id % 2 = 1 OR beat_idx % 4 = 0),
ml AS (SELECT b.track_id, 60.0 / b.g AS bpm, round(d.g / b.g) AS per FROM (SELECT track_id, median(g) AS g FROM (SELECT track_id, LEAD(t) OVER (PARTITION BY track_id ORDER BY k) - t AS g FROM sb) WHERE g > 0.001 GROUP BY 1 HAVING COUNT(*) >= 3) b
  LEFT JOIN (SELECT track_id, median(g) AS g FROM (SELECT track_id, LEAD(t) OVER (PARTITION BY track_id ORDER BY t) - t AS g FROM db) WHERE g > 0.001 GROUP BY 1) d USING (track_id)),
lv AS (SELECT track_id, bpm, CASE WHEN per < 2.5 AND bpm < 70 THEN 'double' WHEN per > 6 AND bpm > 160 THEN 'halve' ELSE 'keep' END AS level FROM ml)"""
NMS = STS + """, ns AS (SELECT song, stem_idx, i, x FROM st UNION ALL SELECT 2, stem_idx, i, x FROM st WHERE stem_idx > 1)"""
PTS = NF + ", pt AS (SELECT track_id, t FROM (SELECT DISTINCT track_id FROM nf), (VALUES (0.02::DOUBLE), (0.61), (99.0)) v(t))"

ORACLES: dict[str, str] = {
    "note_islands": f"WITH {NF}, {ISL.format(k='track_id', src='nf', t=0.12)} SELECT track_id, {_NOTE} FROM ni",
    "note_extract": f"WITH {NF}, {ISL.format(k='track_id', src='nf', t=0.12)}, {MRG.format(k='track_id', src='ni', g=0.1)} SELECT track_id, {_NOTE} FROM mm WHERE end_time - start_time >= 0.1",
    "note_merge_gap": f"WITH {NE}, {MRG.format(k='track_id', src='ne', g=0.5)} SELECT track_id, {_NOTE} FROM mm",
    "note_union_stems": f"WITH {SS}, {ISL.format(k='song, stem_idx', src='sf', t=0.3)}, {MRG.format(k='song, stem_idx', src='ni', g=0.1)} SELECT song, stem_idx, CAST(ROW_NUMBER() OVER (PARTITION BY song ORDER BY stem_idx, id) AS INT) AS id, pitch, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, velocity FROM mm WHERE end_time - start_time >= 0.1",
    "frame_threshold": f"WITH {NF} SELECT track_id, frame, COUNT(*) FILTER (prob >= 0.12) AS n_on FROM nf GROUP BY 1, 2",
    "frame_active_notes": f"WITH {NF} SELECT track_id, frame, CAST(pitch - 21 AS INT) AS idx, round(prob, 6) AS conf FROM nf WHERE prob >= 0.5",
    "frame_topk_floor": f"WITH {NF} SELECT track_id, frame, round(prob, 6) AS floor12 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, frame ORDER BY prob DESC, pitch) AS rn FROM nf) WHERE rn = 12",
    "frame_argmax_pitch": f"WITH {NF} SELECT track_id, frame, CASE WHEN prob > 0.28 THEN pitch END AS pitch FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, frame ORDER BY prob DESC, pitch) AS rn FROM nf) WHERE rn = 1",
    "frame_lookahead_vote": f"WITH {NF}, v AS (SELECT *, SUM(prob) OVER w AS s, COUNT(*) OVER w AS n FROM nf WINDOW w AS ({_W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) SELECT track_id, frame, pitch FROM v WHERE s > n * 0.6",
    "frame_min_duration": f"WITH {NF}, a AS (SELECT *, frame - ROW_NUMBER() OVER ({_W}) AS run FROM nf WHERE prob >= 0.12) SELECT track_id, frame, pitch FROM (SELECT *, COUNT(*) OVER (PARTITION BY track_id, pitch, run) AS n FROM a) WHERE n >= 2",
    "note_onsets": f"WITH {NF}, a AS (SELECT *, prob >= 0.12 AS act, LAG(prob >= 0.12, 1, false) OVER ({_W}) AS was FROM nf) SELECT track_id, pitch, frame FROM a WHERE act AND NOT was",
    "note_offsets": f"WITH {NF}, a AS (SELECT *, prob >= 0.12 AS act, LAG(prob >= 0.12, 1, false) OVER ({_W}) AS was FROM nf) SELECT track_id, pitch, frame FROM a WHERE NOT act AND was",
    "stem_max_combine": f"WITH {SS} SELECT song, frame, pitch, round(prob, 6) AS prob, stem_idx FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY song, frame, pitch ORDER BY prob DESC, stem_idx) AS rn FROM sf) WHERE rn = 1",
    "timeline_transpose": f"""WITH {NF} SELECT track_id, frame, CAST(pitch - 21 AS INT) AS pos, round(coalesce(0.5 * LAG(prob, 2) OVER w + 0.5 * LAG(prob, 1) OVER w, 0.0), 6) AS prob FROM nf WINDOW w AS (PARTITION BY track_id, frame ORDER BY pitch)""",
    "nearest_frame_lookup": f"WITH {NE} SELECT track_id, id, CAST(least(floor(start_time / 0.05::DOUBLE + 0.5::DOUBLE), 1199) AS INT) AS frame FROM ne",
    "joint_rhythm_states": f"""WITH {BT}, m AS (SELECT mc, p, ROW_NUMBER() OVER (ORDER BY mc, p) - 1 AS pos FROM (VALUES (0, 2), (1, 3), (2, 4), (3, 6), (4, 12)) v(mc, n), range(0, 12) r(p) WHERE p < n)
      SELECT CAST((tb - 20) * 27 + pos AS INT) AS state_idx, COUNT(*) AS n, CAST(tb AS INT) AS tempo_bin, mc AS meter_class, CAST(p AS INT) AS phase FROM range(20, 81) r(tb), m, bt WHERE beat_idx % 1647 = (tb - 20) * 27 + pos GROUP BY ALL""",
    "joint_path_segments": f"WITH {TR} SELECT track_id, a AS start_frame, b AS end_frame, m AS meter_class FROM tr, (VALUES (0, 64, 2), (64, 131, 1)) v(a, b, m)",
    "joint_path_downbeats": f"WITH {BT} SELECT track_id, beat_idx AS frame FROM bt WHERE beat_idx % 4 = 0",
    "beat_intervals": f"WITH {BG} SELECT track_id, beat_idx, round(gap, 6) AS gap FROM bg WHERE gap IS NOT NULL",
    "beats_per_bar": f"WITH {BC} SELECT track_id, CAST(list_sort(list(nb))[len(list(nb)) // 2 + 1] AS INT) AS beats_per_bar FROM bc GROUP BY 1",
    "bar_tempo_map": f"""WITH {BC}, tg AS (SELECT track_id, median(gap) AS g FROM bg WHERE gap IS NOT NULL GROUP BY 1)
      SELECT track_id, CAST(ROW_NUMBER() OVER w - 1 AS INT) AS seg_no, round(bar_t, 6) AS start_time_sec, round(next_t, 6) AS end_time_sec, round(60 / coalesce(bc.bg, g), 6) AS bpm, round(coalesce(bc.bg, g), 6) AS beat_duration_sec, round((ROW_NUMBER() OVER w - 1) * 4.0::DOUBLE, 6) AS beat_offset
      FROM bc JOIN tg USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY db_idx)""",
    "tempo_map_from_beats": f"""WITH {BG}, g AS (SELECT track_id, median(gap) AS m, avg(gap) AS mean, stddev_pop(gap) AS sd FROM bg WHERE gap > 0.001 GROUP BY 1), e AS (SELECT track_id, MIN(t) AS f, MAX(t) AS l, COUNT(*) AS n FROM bt GROUP BY 1),
      b AS (SELECT *, greatest(40.0, least(260.0, 60.0 / m)) AS bpm, greatest(0.1, least(0.99, 1 - sd / mean)) AS c FROM e JOIN g USING (track_id)),
      s AS (SELECT track_id, 0 AS seg_no, 0.0 AS a, f AS z, -f / (60 / bpm) AS off, bpm, c FROM b UNION ALL SELECT track_id, 1, f, l, 0.0, bpm, c FROM b UNION ALL SELECT track_id, 2, l, l + 60 / bpm, n - 1, bpm, c FROM b)
      SELECT track_id, seg_no, round(CAST(a AS DOUBLE), 6) AS start_time_sec, round(z, 6) AS end_time_sec, round(CAST(bpm AS DOUBLE), 6) AS bpm, round(CAST(60 / bpm AS DOUBLE), 6) AS beat_duration_sec, round(CAST(off AS DOUBLE), 6) AS beat_offset, round(CAST(c AS DOUBLE), 6) AS confidence FROM s WHERE z > a""",
    "beat_grid_from_bpm": f"WITH {NE}, e AS (SELECT track_id, MAX(end_time) AS d FROM ne GROUP BY 1) SELECT track_id, CAST(i AS INT) AS beat_idx, round(i * 0.5::DOUBLE, 6) AS t, i % 4 = 0 AS downbeat FROM e, range(0, 400) r(i) WHERE i <= floor((greatest(10.0, d) + 2.0) / 0.5)",
    "beat_grid_from_notes": f"WITH {NE}, e AS (SELECT track_id, floor(MIN(start_time) / 0.5) * 0.5 AS s, MAX(end_time) AS l FROM ne GROUP BY 1) SELECT track_id, CAST(i AS INT) AS beat_idx, round(s + i * 0.5::DOUBLE, 6) AS t FROM e, range(0, 400) r(i) WHERE i <= floor((l + 0.5 - s) / 0.5) AND floor((l + 0.5 - s) / 0.5) + 1 >= 4 AND l > 0",
    "metric_level_double": f"WITH {BT}, m AS (SELECT track_id, t FROM bt UNION ALL SELECT track_id, x FROM (SELECT track_id, (t + LEAD(t) OVER (PARTITION BY track_id ORDER BY beat_idx)) / 2 AS x FROM bt) WHERE x IS NOT NULL) SELECT track_id, CAST(ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY t) - 1 AS INT) AS beat_idx, round(t, 6) AS t FROM m",
    "metric_level_halve": f"WITH {BT} SELECT track_id, CAST(beat_idx // 2 AS INT) AS beat_idx, round(t, 6) AS t FROM bt WHERE beat_idx % 2 = 0",
    "metric_level_choice": f"WITH {SB} SELECT track_id, round(bpm, 6) AS bpm, level FROM lv",
    "metric_level_fixed": f"""WITH {SB}, nx AS (SELECT sb.*, LEAD(t) OVER (PARTITION BY track_id ORDER BY k) AS nt FROM sb), e AS (SELECT track_id, t, level FROM nx JOIN lv USING (track_id) WHERE level <> 'halve' OR k % 2 = 0 UNION ALL SELECT track_id, (t + nt) / 2, level FROM nx JOIN lv USING (track_id) WHERE level = 'double' AND nt IS NOT NULL)
      SELECT track_id, CAST(ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY t) - 1 AS INT) AS beat_idx, round(t, 6) AS t FROM e""",
    "beat_agreement": f"""WITH {BT}, src AS (SELECT * FROM (VALUES ('combined', 0.0::DOUBLE), ('drums', 0.05), ('bass', 0.09)) v(source, d)), b AS (SELECT track_id, source, t + d AS t FROM bt, src),
      dn AS (SELECT track_id, source, t + d AS t FROM db, src WHERE (source = 'combined' AND db_idx % 7 <> 3) OR source = 'drums' OR (source = 'bass' AND db_idx % 2 = 0)),
      g AS (SELECT track_id, median(60.0 / g) AS bpm FROM (SELECT track_id, source, median(g) AS g FROM (SELECT track_id, source, LEAD(t) OVER (PARTITION BY track_id, source ORDER BY t) - t AS g FROM b) GROUP BY 1, 2) GROUP BY 1),
      p AS (SELECT track_id, t, LEAD(t) OVER (PARTITION BY track_id ORDER BY t) - t AS bar, 1 + (SELECT COUNT(DISTINCT source) FROM dn o WHERE o.track_id = dn.track_id AND o.source <> 'combined' AND abs(o.t - dn.t) < 0.07) AS hits FROM dn WHERE source = 'combined')
      SELECT track_id, round(MAX(bpm), 6) AS bpm, CAST(greatest(2, least(8, round(median(bar) * MAX(bpm) / 60.0))) AS INT) AS beats_per_bar, round(greatest(0.0, least(1.0, (AVG(hits) - 1) / 2)), 6) AS confidence, CAST(3 AS BIGINT) AS sources FROM p JOIN g USING (track_id) GROUP BY 1""",
    "beat_single_source": f"""WITH {BT} SELECT b.track_id, round(greatest(40.0, least(260.0, 60.0 / b.g)), 6) AS bpm, CAST(greatest(2, least(8, round(d.g / b.g))) AS INT) AS beats_per_bar, 0.5::DOUBLE AS confidence, 1 AS sources
      FROM (SELECT track_id, median(g) AS g FROM (SELECT track_id, LEAD(t) OVER (PARTITION BY track_id ORDER BY t) - t AS g FROM bt) GROUP BY 1) b JOIN (SELECT track_id, median(g) AS g FROM (SELECT track_id, LEAD(t) OVER (PARTITION BY track_id ORDER BY t) - t AS g FROM db) GROUP BY 1) d USING (track_id)""",
    "moving_average": f"WITH {SG} SELECT track_id, i, round(SUM(x) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5, 6) AS x FROM sg",
    "low_stems": f"WITH {NMS} SELECT song, i, round(SUM(x), 6) AS x FROM ns WHERE song = 2 OR stem_idx IN (0, 1) GROUP BY 1, 2",
    "analysis_mix": f"""WITH {NMS}, m AS (SELECT song, i, SUM(x) AS x FROM ns WHERE song = 1 AND stem_idx IN (1, 3) GROUP BY 1, 2), p AS (SELECT greatest(1.0, MAX(abs(x))) AS peak FROM m)
      SELECT song, i, round(x / peak, 6) AS x FROM m, p UNION ALL SELECT DISTINCT song, i, 0.0::DOUBLE FROM ns WHERE song = 2""",
    "stereo_resample": f"""WITH {SG}, n AS (SELECT track_id, MAX(i) + 1 AS n FROM sg GROUP BY 1), k AS (SELECT track_id, n, k, k / (600.0::DOUBLE / 441) AS pos FROM n, range(0, 1000000) r(k) WHERE k < round(n * (600.0::DOUBLE / 441))),
      a AS (SELECT k.track_id, k, pos - floor(pos) AS f, 0.0::DOUBLE AS l0, sg.x / 2 AS r0, least(CAST(floor(pos) AS BIGINT) + 1, n - 1) AS i1 FROM k JOIN sg ON sg.track_id = k.track_id AND sg.i = CAST(floor(pos) AS BIGINT))
      SELECT a.track_id, k AS i, round(l0 * (1 - f) + f * 0.0, 6) AS l, round(r0 * (1 - f) + f * sg.x / 2, 6) AS r FROM a JOIN sg ON sg.track_id = a.track_id AND sg.i = a.i1""",
    "stereo_blend": f"""WITH {STS}, c AS (SELECT song, i, ch AS channel, SUM(CASE WHEN ch = 1 AND stem_idx > 0 THEN x * 0.5 ELSE x END) AS x FROM st, (VALUES (0), (1)) v(ch) GROUP BY 1, 2, 3), p AS (SELECT song, greatest(1.0, MAX(abs(x))) AS peak FROM c GROUP BY 1)
      SELECT song, i, channel, round(x / peak, 6) AS x FROM c JOIN p USING (song)""",
    "stem_selection": "SELECT c_custkey AS song, CAST(k AS INT) AS stem_idx FROM customer, range(1, 6) r(k) WHERE k <= CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 5 END AND (c_custkey % 4 = 0 OR c_custkey % 3 = 0 OR k IN (1, 4))",
    "output_time": f"WITH {NE} SELECT track_id, id, round(start_time / greatest(0.25, least(4.0, velocity / 20.0)), 6) AS out, round(greatest(0.001, end_time / pitch), 6) AS step FROM ne",
    "current_frame": f"WITH {PTS} SELECT pt.track_id, t, nf.frame, CAST(pitch - 21 AS INT) AS pos, round(prob, 6) AS prob FROM pt JOIN (SELECT track_id, MAX(frame) AS last FROM nf GROUP BY 1) m USING (track_id) JOIN nf ON nf.track_id = pt.track_id AND nf.frame = least(last, CAST(floor(t / 0.05) AS INT))",
    "point_probabilities": f"""WITH {PTS}, p AS (SELECT pt.track_id, t, CAST(k AS INT) AS pitch_idx FROM pt, range(0, 64) r(k)) SELECT p.track_id, p.t, pitch_idx, round(coalesce(AVG(prob), 0.0), 6) AS prob FROM p LEFT JOIN nf ON nf.track_id = p.track_id AND nf.pitch = pitch_idx + 21 AND nf.frame BETWEEN CAST(floor(t / 0.05) AS INT) - 1 AND CAST(floor(t / 0.05) AS INT) + 1 GROUP BY 1, 2, 3""",
    "pitch_track": f"WITH {NF}, m AS (SELECT track_id, frame, MAX(prob) AS top, arg_min(pitch, -prob * 1000000 + pitch * 1e-6) AS p FROM nf GROUP BY 1, 2) SELECT track_id, frame, top <= 0.9 AS silent, CASE WHEN top > 0.9 THEN (SELECT MIN(pitch) FROM nf WHERE nf.track_id = m.track_id AND nf.frame = m.frame AND nf.prob = m.top) END AS pitch FROM m",
    "spectral_peaks": f"""WITH {NF}, k AS (SELECT DISTINCT track_id, frame, CAST(k AS INT) AS k FROM nf, range(0, 64, 9) r(k)), j AS (SELECT k.track_id, k.frame, k.k, nf.pitch - 21 - k.k AS d, prob FROM k JOIN nf ON nf.track_id = k.track_id AND nf.frame = k.frame AND abs(nf.pitch - 21 - k.k) <= 7)
      SELECT track_id, frame, k, round(SUM(prob * CASE abs(d) WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.15 END) FILTER (abs(d) <= 2) / SUM(CASE abs(d) WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.15 END) FILTER (abs(d) <= 2), 6) AS peak, round(AVG(prob) FILTER (abs(d) >= 3), 6) AS floor FROM j GROUP BY 1, 2, 3""",
    "tempo_and_meter_at_beat": f"WITH {BT}, {TS}, {SIG} SELECT track_id, CAST(beat_idx AS DOUBLE) AS beat, (SELECT arg_max(bpm, off) FROM ts WHERE off <= beat_idx) AS bpm, CASE WHEN beat_idx < 32 THEN 4 ELSE 3 END AS numerator, 4 AS denominator FROM bt",
    "svg_note_positions": f"WITH {NE} SELECT track_id AS page_id, CAST(id AS BIGINT) AS note_id, pitch, CAST(id * 120 AS INT) AS tick, 240 AS duration_ticks, round((id * 3 + 50) / 1000.0::DOUBLE, 6) AS x, round((pitch + 20) / 200.0::DOUBLE, 6) AS y, 0.01::DOUBLE AS w, 0.025::DOUBLE AS h FROM ne",
    "cache_timeline_lookup": f"""WITH {NFA} SELECT CAST(track_id AS VARCHAR) AS content_hash, CAST(1 AS BIGINT) AS variant_key, CAST(2 AS BIGINT) AS candidates, CAST(track_id % 4 = 0 AS BIGINT) AS other_version, CAST(track_id % 4 = 1 AS BIGINT) AS other_parameters, CAST(track_id % 4 = 2 AND COUNT(*) * 0.05 * 8 > 2 AS BIGINT) AS other_length,
      CAST(track_id % 3 = 0 AS BIGINT) AS invalid_timeline, CASE WHEN track_id % 4 = 3 OR (track_id % 4 = 2 AND COUNT(*) * 0.05 * 8 <= 2) THEN 1 WHEN track_id % 3 <> 0 THEN 2 END AS entry FROM nfa GROUP BY track_id""",
    "downbeat_consensus": f"WITH {BT}, s AS (SELECT track_id, 1 AS src, t FROM db UNION ALL SELECT track_id, 2, t + 0.05 FROM db UNION ALL SELECT track_id, 3, t + 0.09 FROM db WHERE db_idx % 2 = 0) SELECT d.track_id, d.db_idx, round(d.t, 6) AS t, COUNT(DISTINCT src) AS hits FROM db d LEFT JOIN s ON s.track_id = d.track_id AND abs(s.t - d.t) < 0.07 GROUP BY 1, 2, d.t",
    "downbeat_gap_fill": f"""WITH {BT}, d AS (SELECT track_id, t, LEAD(t) OVER w - t AS gap, ROW_NUMBER() OVER w AS rn FROM db WHERE db_idx % 7 <> 3 WINDOW w AS (PARTITION BY track_id ORDER BY t)), x AS (SELECT *, CASE WHEN gap > 3.0 THEN CAST(round(gap / 2.0) - 1 AS INT) ELSE 0 END AS extra FROM d)
      SELECT track_id, round(t + CASE WHEN k > 0 THEN k * gap / (extra + 1) ELSE 0.0 END, 6) AS t, k > 0 AS added FROM x, range(0, 50) r(k) WHERE k <= extra UNION ALL SELECT track_id, 0.0, true FROM x WHERE rn = 1 AND t > 1.0""",
    "downbeats_without_beat": f"WITH {BT} SELECT track_id, db_idx, round(t, 6) AS t FROM db d WHERE NOT EXISTS (SELECT 1 FROM bt b WHERE b.track_id = d.track_id AND b.beat_idx % 8 <> 0 AND abs(b.t - d.t) < 0.15)",
    "barline_grid": f"WITH {TR}, {BARS} SELECT track_id, round(CAST(beat AS DOUBLE), 6) AS beat FROM tr, bl",
    "subdivision_alignment": f"WITH {NE}, f AS (SELECT track_id, id, start_time / 0.5 AS x FROM ne) SELECT track_id, id, round(least(abs(x * 8 - round(x * 8)) / 8, abs(x * 12 - round(x * 12)) / 12), 6) AS error FROM f",
    "sliding_tempo": f"WITH {NE}, w AS (SELECT track_id, start_time, CAST(floor(start_time / 2) AS BIGINT) - k AS w FROM ne, range(0, 4) r(k)) SELECT track_id, CAST(w * 2 AS DOUBLE) AS window_start, COUNT(*) AS n, round((MAX(start_time) - MIN(start_time)) / (COUNT(*) - 1), 6) AS mean_gap FROM w WHERE w >= 0 GROUP BY track_id, w HAVING COUNT(*) >= 5",
    "meter_inference": f"WITH {MT} SELECT track_id, MIN(start_beat) AS start_beat, MAX(end_beat) AS end_beat, CAST(MIN(numerator) AS INT) AS numerator, CAST(MIN(denominator) AS INT) AS denominator, round(MAX(confidence), 6) AS confidence FROM mg_ GROUP BY track_id, grp",
    "meter_merge": f"WITH {TR}, {SIG} SELECT track_id, start_beat, end_beat, numerator, denominator, round(confidence, 6) AS confidence FROM tr, sig",
    "rhythm_confidence": f"WITH {TR}, {TS} SELECT track_id, round((0.9 + (0.8 + greatest(0.0, (SELECT 1 - avg(abs(bpm / 125.0 - 1)) FROM ts))) / 2) / 2, 6) AS confidence FROM tr",
    "note_to_beat_time": f"WITH {NE} SELECT track_id, id, round(start_time, 6) AS t, round({_to_beat('start_time')}, 6) AS beat FROM ne",
    "beat_to_time": f"WITH {BT} SELECT track_id, beat_idx, CAST(beat_idx AS DOUBLE) AS beat, round({_to_time('beat_idx')}, 6) AS t FROM bt",
    "note_in_bar_interval": f"WITH {NE}, {BT}, b AS (SELECT track_id, db_idx, t, LEAD(t) OVER (PARTITION BY track_id ORDER BY db_idx) AS z FROM db) SELECT ne.track_id, id, db_idx FROM ne JOIN b ON b.track_id = ne.track_id AND start_time >= t AND start_time < z",
    "note_beat_association": f"WITH {AL} SELECT track_id, id, bi AS beat_index, CAST(bar AS INT) AS bar_index, round(pb, 6) AS prev_beat_time, round(nb, 6) AS next_beat_time, round(ip, 6) AS intra_beat_pos FROM aln",
    "beat_to_bar": f"WITH {BT}, b AS (SELECT track_id, (SELECT MAX(d.db_idx) FROM db d WHERE d.track_id = bt.track_id AND d.t <= bt.t + 0.001) AS db_idx FROM bt) SELECT track_id, db_idx, COUNT(*) AS n_beats FROM b GROUP BY 1, 2",
    "swing_sections": f"WITH {SEC} SELECT track_id, section, section * 4 AS bar_start, section * 4 + 4 AS bar_end, CASE WHEN is_sw THEN 'Swing' ELSE 'Straight' END AS style, n, CASE WHEN is_sw THEN round(2.0::DOUBLE / 3, 6) END AS swing_ratio FROM sx",
    "swing_majority": f"WITH {SEC} SELECT track_id, CAST(SUM(CASE WHEN is_sw THEN 4 ELSE 0 END) AS BIGINT) AS swing_bars, CAST(SUM(4) AS BIGINT) AS bars, CASE WHEN SUM(CASE WHEN is_sw THEN 4 ELSE 0 END) * 2 > SUM(4) THEN 'Swing' ELSE 'Straight' END AS style FROM sx GROUP BY 1",
    "quantize_constant": f"WITH {QC} SELECT track_id, id, pitch, velocity, round(beat_start, 6) AS beat_start, round(beat_duration, 6) AS beat_duration FROM q",
    "quantize_tempo_map": f"WITH {NE}, q_ AS (SELECT track_id, id, pitch, velocity, {_to_beat('start_time')} AS b0, greatest(0.0, {_to_beat('end_time')} - {_to_beat('start_time')}) AS d FROM ne), d_ AS (SELECT *, CAST(NULL AS DOUBLE) AS be, CAST('inf' AS DOUBLE) AS er FROM q_), {_fold_durations()} SELECT track_id, id, pitch, velocity, round({_snap_start('b0')}, 6) AS beat_start, round(greatest(0.25, coalesce(be, 0.25)), 6) AS beat_duration FROM d7",
    "quantize_aligned": f"""WITH {AL}, u AS (SELECT *, CAST(round(start_time * 1e6) AS BIGINT) AS us FROM aln),
      nx AS (SELECT a.*, (SELECT MIN(b.start_time) FROM u b WHERE b.track_id = a.track_id AND (b.start_time, b.id) > (a.start_time, a.id) AND (b.pitch <> a.pitch OR b.us >= a.us + 1001)) AS up FROM u a),
      y AS (SELECT *, CASE WHEN bar < 4 THEN 'Straight' WHEN bar < 8 THEN 'Swing' WHEN bar < 12 THEN 'Triplet' ELSE 'Straight' END AS sty FROM nx),
      c1 AS (SELECT *, CASE WHEN up > start_time THEN up - start_time ELSE greatest(0.05, end_time - start_time) END / bd AS raw,
        unnest(CASE sty WHEN 'Swing' THEN [0.0::DOUBLE, 2.0::DOUBLE / 3, 1.0] WHEN 'Triplet' THEN [0.0::DOUBLE, 1.0::DOUBLE / 3, 2.0::DOUBLE / 3, 1.0] ELSE [0.0::DOUBLE, 0.5, 1.0] END) AS best FROM y),
      r AS (SELECT * FROM c1 QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id, id ORDER BY abs(ip - best), best) = 1),
      g AS (SELECT *, CASE WHEN sty = 'Triplet' THEN 1.0::DOUBLE / 3 ELSE greatest(best, 0.25)::DOUBLE END AS grid, abs(ip - best) AS er FROM r)
      SELECT track_id, id, pitch, velocity, round(CAST(bi + best AS DOUBLE), 6) AS beat_start, round(greatest(grid, round(raw / grid) * grid), 6) AS beat_duration, round(greatest(0.3, least(1.0, 1 - 2 * er)), 6) AS confidence, CAST(bar AS INT) AS bar_index, CAST(bi % 4 AS INT) AS beat_in_bar, sty AS swing_style FROM g""",
    "barline_crossings": f"WITH {QC}, {BARS} SELECT track_id, id, round(CAST(beat AS DOUBLE), 6) AS beat FROM q JOIN bl ON beat > beat_start AND beat < beat_start + beat_duration",
    "notes_with_ties": f"""WITH {NE}, {SIG}, w_ AS (SELECT track_id, id, pitch, velocity, {_snap_start('b0')} AS s0, {_snap_start('b1')} AS s1 FROM (SELECT *, {_to_beat('start_time')} AS b0, {_to_beat('end_time')} AS b1 FROM ne)),
      bl AS (SELECT DISTINCT start_beat + k * 4.0 * numerator / denominator AS beat FROM sig, range(1, 100) r(k) WHERE start_beat + k * 4.0 * numerator / denominator < end_beat),
      mk AS (SELECT track_id, id, pitch, velocity, s0, s1, s0 AS b FROM w_ UNION ALL SELECT track_id, id, pitch, velocity, s0, s1, beat FROM w_ JOIN bl ON beat > s0 AND beat < s1),
      pc AS (SELECT *, coalesce(LEAD(b) OVER w, s1) AS nb, ROW_NUMBER() OVER w - 1 AS k, COUNT(*) OVER (PARTITION BY track_id, id) AS n FROM mk WINDOW w AS (PARTITION BY track_id, id ORDER BY b)),
      t_ AS (SELECT track_id, id, pitch, velocity, b, k, n, greatest(0.25, nb - b) AS d, CAST(NULL AS DOUBLE) AS be, CAST('inf' AS DOUBLE) AS er FROM pc), {_fold_durations('t_', 'u')}
      SELECT track_id, id, CAST(k AS INT) AS seg_no, pitch, velocity, round(CAST(b AS DOUBLE), 6) AS beat_start, round(greatest(0.25, coalesce(be, 0.25)), 6) AS beat_duration, k < n - 1 AS tie_start, k > 0 AS tie_stop FROM u7""",
    "grace_notes": f"WITH {NE}, g AS (SELECT *, LEAD(start_time) OVER w AS ns, LEAD(pitch) OVER w AS np FROM ne WINDOW w AS (PARTITION BY track_id ORDER BY start_time, id)) SELECT track_id, id, pitch, coalesce(end_time - start_time < 0.08 AND ns - start_time < 0.6 AND np <> pitch, false) AS is_grace FROM g",
    "articulation_nearest": f"""WITH {QC}, n AS (SELECT track_id, pitch, start_time, arg_min(end_time - start_time, id) AS len FROM ne GROUP BY 1, 2, 3),
      c AS (SELECT q.track_id, q.id, q.pitch, q.beat_duration, n.len, ROW_NUMBER() OVER (PARTITION BY q.track_id, q.id ORDER BY abs(n.start_time - q.beat_start * 0.5), n.start_time) AS rn FROM q JOIN n ON n.track_id = q.track_id AND n.pitch = q.pitch)
      SELECT track_id, id, pitch, CASE WHEN len / (beat_duration * 0.5) < 0.5 OR len < 0.08 THEN 'Staccato' WHEN len / (beat_duration * 0.5) > 0.9 THEN 'Tenuto' ELSE 'Normal' END AS articulation FROM c WHERE rn = 1""",
    "chord_symbol_parse": f"WITH {PRS} SELECT * FROM prs",
    "chord_kind_map": f"WITH {PRS} SELECT DISTINCT suffix, CASE suffix {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in CHORD_KINDS.items())} ELSE 'other' END AS kind FROM prs",
    "joint_viterbi": f"WITH {BT} SELECT track_id, beat_idx AS frame, CAST(20 * 27 + 5 + beat_idx % 4 AS INT) AS state_idx FROM bt",
    "chunk_rebuild_trigger": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, value AS size, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, event_id, n, 0.0::DOUBLE AS held, us AS last, TRUE AS due FROM o WHERE n = 1
        UNION ALL SELECT user_id, event_id, n, CASE WHEN due THEN 0 ELSE h END, CASE WHEN due THEN us ELSE last END, due FROM (SELECT o.user_id, o.event_id, o.n, o.us, f.last, f.held + o.size AS h, f.held + o.size >= 500 OR o.us - f.last >= 1000000 AS due FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
      SELECT user_id, event_id FROM f WHERE due""",
    "chord_scores": f"WITH {HS}, {CS} SELECT cs.* FROM cs WHERE mask IN (SELECT mask FROM hs)",
    "chord_symbol_lookup": f"WITH {HS}, {CT} SELECT mask, bass, n, symbol FROM hs LEFT JOIN ct USING (mask, bass)",
    "chord_active_set": f"WITH {QC}, g AS (SELECT DISTINCT track_id, floor(beat_start) AS beat FROM q), {SND.format(grid='g')} SELECT track_id, beat, mask, bass, n_notes, round(held, 6) AS held, CAST(bit_count(mask) AS INT) AS n_pcs FROM snd",
    "chord_scan_step": f"WITH {QC}, {CT}, g AS (SELECT track_id, CAST(k AS DOUBLE) AS beat FROM (SELECT track_id, MAX(beat_start + beat_duration) AS e FROM q GROUP BY 1), range(0, 400) r(k) WHERE k <= floor(e)), {SND.format(grid='g')}, h AS (SELECT * FROM snd JOIN ct USING (mask, bass) WHERE bit_count(mask) >= 2) {_CHG.format(src='h')}",
    "onset_collect": f"""WITH RECURSIVE {NE}, k AS (SELECT track_id, MIN(start_time) AS t, 0 AS pos FROM ne WHERE start_time >= 0 GROUP BY 1
      UNION ALL SELECT k.track_id, (SELECT MIN(ne.start_time) FROM ne WHERE ne.track_id = k.track_id AND ne.start_time - k.t > 0.005) AS t, k.pos + 1 FROM k WHERE k.t IS NOT NULL)
      SELECT track_id, CAST(pos AS INT) AS pos, round(t, 6) AS t FROM k WHERE t IS NOT NULL""",
    "bpm_autocorrelation": f"""WITH RECURSIVE {NE}, k AS (SELECT track_id, MIN(start_time) AS t FROM ne WHERE start_time >= 0 GROUP BY 1
      UNION ALL SELECT k.track_id, (SELECT MIN(ne.start_time) FROM ne WHERE ne.track_id = k.track_id AND ne.start_time - k.t > 0.005) AS t FROM k WHERE k.t IS NOT NULL),
      ob AS (SELECT track_id, CAST(round(t / 0.01) AS INT) AS b FROM k WHERE t IS NOT NULL), z AS (SELECT track_id, COUNT(*) AS n FROM ob GROUP BY 1 HAVING COUNT(*) >= 3),
      c AS (SELECT a.track_id, a.b, a.m, lag, MIN(abs(x.b - a.b - lag)) AS d FROM (SELECT track_id, b, COUNT(*) AS m FROM ob GROUP BY 1, 2) a JOIN range(30, 151) r(lag) ON true JOIN (SELECT DISTINCT track_id, b FROM ob) x ON x.track_id = a.track_id AND abs(x.b - a.b - lag) <= 2 GROUP BY ALL),
      s AS (SELECT track_id, lag, round(SUM(m * (1 - d / 3.0)), 6) AS score FROM c GROUP BY 1, 2), w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY score DESC, lag) AS rn FROM s)
      SELECT w.track_id, CAST(lag AS INT) AS lag, CAST(score AS DOUBLE) AS score, round(60.0 / (lag * 0.01), 6) AS bpm, round(CAST(least(1.0, score / n) AS DOUBLE), 6) AS confidence FROM w JOIN z USING (track_id) WHERE rn = 1""",
    "stem_label_classify": """WITH l AS (SELECT p_partkey, p_type || ' ' || ['Drum kit', 'Bass', 'Lead Vocal', 'Guitar', 'Keys', 'misc'][p_partkey % 6 + 1] AS label FROM part),
      s AS (SELECT p_partkey, CASE WHEN lower(label) LIKE '%drum%' OR lower(label) LIKE '%percussion%' THEN 'drums' WHEN lower(label) LIKE '%bass%' THEN 'bass' WHEN lower(label) LIKE '%vocal%' OR lower(label) LIKE '%voice%' OR lower(label) LIKE '%singing%' THEN 'vocals'
        WHEN lower(label) LIKE '%guitar%' THEN 'guitar' WHEN lower(label) LIKE '%piano%' OR lower(label) LIKE '%keys%' THEN 'piano' WHEN lower(label) LIKE '%other%' OR lower(label) LIKE '%accompaniment%' THEN 'other' ELSE label END AS stem FROM l)
      SELECT p_partkey, stem, stem NOT IN ('drums', 'bass') AS melodic FROM s""",
    "clock_text": "WITH s AS (SELECT o_orderkey, o_orderkey % 20000 AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, CAST(s AS DOUBLE) AS seconds FROM s",
    "midi_names": f"WITH {NE} SELECT DISTINCT pitch, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name, pitch % 12 IN (1, 3, 6, 8, 10) AS black, round(440 * power(2.0::DOUBLE, (pitch - 69) / 12.0), 6) AS hz FROM ne",
    "xml_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages",
    "resample_up": f"WITH {SG}, n AS (SELECT track_id, COUNT(*) AS n FROM sg GROUP BY 1), g AS (SELECT track_id, n, CAST(k AS BIGINT) AS i FROM n, range(0, 100000) r(k) WHERE k < 2 * n) SELECT g.track_id, g.i, round(a.x + (b.x - a.x) * (g.i % 2) / 2.0, 6) AS x FROM g JOIN sg a ON a.track_id = g.track_id AND a.i = g.i // 2 JOIN sg b ON b.track_id = g.track_id AND b.i = least(g.i // 2 + 1, n - 1)",
    "waveform_points": f"WITH {SG}, s AS (SELECT *, greatest(1, COUNT(*) OVER (PARTITION BY track_id) // 500) AS step FROM sg) SELECT track_id, i, round(i / 441.0::DOUBLE, 6) AS t, round(x, 6) AS amp FROM s WHERE i % step = 0",
    "waveform_peak_norm": f"WITH {SG}, s AS (SELECT *, greatest(1, COUNT(*) OVER (PARTITION BY track_id) // 500) AS step FROM sg), w AS (SELECT *, MAX(abs(x)) OVER (PARTITION BY track_id) AS pk FROM s WHERE i % step = 0) SELECT track_id, i, round(i / 441.0::DOUBLE * 1.5, 6) AS t, round(CASE WHEN pk > 0 THEN x / pk ELSE 0 END, 6) AS amp FROM w",
    "stem_blend": f"WITH {STS}, t AS (SELECT song, i, SUM(x) AS x FROM st GROUP BY 1, 2) SELECT song, i, round(CASE WHEN MAX(abs(x)) OVER () > 1 THEN x / MAX(abs(x)) OVER () ELSE x END, 6) AS x FROM t",
    "loudness_match": f"""WITH {SG}, f AS (SELECT track_id, sqrt(avg(x * x)) AS s, sqrt(avg(x * 0.1 * x * 0.1)) AS m, MAX(abs(x * 0.1)) AS pk FROM sg GROUP BY 1),
      g AS (SELECT *, CASE WHEN m < 1e-6 OR s < 1e-6 THEN 1.0 WHEN abs(greatest(0.25, least(32.0, s / m)) - 1) < 0.02 THEN 1.0 ELSE greatest(0.25, least(32.0, s / m)) END AS gain FROM f), y AS (SELECT track_id, i, x * 0.1 * gain AS y, pk * gain AS p FROM sg JOIN g USING (track_id))
      SELECT track_id, i, round(CASE WHEN p > 1 AND abs(y) > 0.9 THEN sign(y) * (0.9 + 0.1 * tanh((abs(y) - 0.9) / 0.1)) ELSE y END, 6) AS x FROM y""",
    "edge_fades": f"WITH {SG}, n AS (SELECT *, COUNT(*) OVER (PARTITION BY track_id) AS n FROM sg) SELECT track_id, i, round(x * least(1.0, i / 22.0, (n - 1 - i) / 22.0), 6) AS x FROM n",
    "rms_energy": f"WITH {SG} SELECT track_id, round(sqrt(avg(x * x)), 6) AS rms FROM sg GROUP BY 1",
    "zero_crossing_variance": f"""WITH {SG}, c AS (SELECT track_id, i // 64 AS h, CASE WHEN sign(x) * sign(LAG(x) OVER (PARTITION BY track_id ORDER BY i)) < 0 THEN 1 ELSE 0 END AS c FROM sg), b AS (SELECT track_id, h, SUM(c) AS c, COUNT(*) AS n FROM c GROUP BY 1, 2),
      w AS (SELECT *, SUM(c) OVER v AS tot, SUM(n) OVER v AS held FROM b WINDOW v AS (PARTITION BY track_id ORDER BY h ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)), d AS (SELECT track_id, abs(tot - LAG(tot) OVER (PARTITION BY track_id ORDER BY h)) AS d FROM w WHERE held = 128)
      SELECT t.track_id, round(coalesce(greatest(0.0, least(1.0, v / 100)), 0.5), 6) AS variance FROM (SELECT DISTINCT track_id FROM sg) t LEFT JOIN (SELECT track_id, var_pop(CAST(d AS DOUBLE)) AS v FROM d GROUP BY 1) x USING (track_id)""",
    "stem_energy_share": f"WITH {STS}, e AS (SELECT song, stem_idx, avg(x * x) AS e FROM st GROUP BY 1, 2) SELECT song, stem_idx, round(e / SUM(e) OVER (PARTITION BY song), 6) AS confidence FROM e",
    "moving_median": f"WITH {SG}, w AS (SELECT *, list_sort(list(x) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS xs FROM sg) SELECT track_id, i, round(xs[len(xs) // 2 + 1], 6) AS x FROM w",
    "min_max_normalize": f"WITH {SG}, w AS (SELECT *, MIN(x) OVER v AS lo, MAX(x) OVER v AS hi FROM sg WINDOW v AS (PARTITION BY track_id)) SELECT track_id, i, round(CASE WHEN hi - lo < 1e-7 THEN x ELSE (x - lo) / (hi - lo) END, 6) AS x FROM w",
    "db_scale": f"WITH {SG} SELECT track_id, i, round(CASE WHEN x > 0 THEN log10(x * x) * 10 ELSE -80.0 END, 5) AS db FROM sg",
    "mel_pool": f"WITH {SG} SELECT track_id, CAST(i // 64 AS INT) AS block_no, CAST(i % 64 // 6 AS INT) AS g, round(avg(x), 6) AS mean FROM sg WHERE i % 64 < 60 GROUP BY 1, 2, 3",
    "stem_separation_identity": f"WITH {SG} SELECT track_id, stem, i, round(x, 6) AS l, round(x * 0.5 + 0.1, 6) AS r, round((x + x * 0.5 + 0.1) / 2, 6) AS mono FROM sg, (VALUES ('drums'), ('bass')) s(stem)",
    "audio_blocks": f"WITH {SG} SELECT track_id, i // 262144 AS part, i % 262144 AS i, round(x, 6) AS x FROM sg",
    "audio_probe": f"WITH {SG} SELECT track_id, i // 262144 AS part, 441 AS sample_rate, 1 AS channels, COUNT(*) AS n_frames, round(COUNT(*) / 441.0::DOUBLE, 6) AS seconds, 0 AS tags, NULL::VARCHAR AS error FROM sg GROUP BY 1, 2",
    "audio_preview": f"WITH {SG} SELECT track_id, i // 262144 AS part, 441 AS sample_rate, CAST(i % 262144 - 22 AS INT) AS i, round(x, 6) AS x FROM sg WHERE i % 262144 BETWEEN 22 AND 132",
    "ema_fold": "WITH c AS (SELECT user_id, list(least(4.0::DOUBLE, greatest(0.02::DOUBLE, value / 100.0::DOUBLE)) ORDER BY ts, event_id) AS xs FROM events GROUP BY 1) SELECT user_id, round(list_reduce(xs, lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE), 6) AS rate FROM c",
    "highlight_decay": f"WITH {NF} SELECT n.track_id, n.pitch, n.frame, round(SUM(k.prob * (1 - exp(-1.0::DOUBLE)) * power(exp(-1.0::DOUBLE), n.frame - k.frame)), 6) AS level FROM nf n JOIN nf k ON k.track_id = n.track_id AND k.pitch = n.pitch AND k.frame BETWEEN n.frame - 60 AND n.frame GROUP BY 1, 2, 3",
    # the lead of on over off in whole units, frame by frame, then the states back from the last frame
    "viterbi_binary": f"""WITH RECURSIVE {NF}, ev AS (SELECT *, CAST(round_even((ln(greatest(1e-10::DOUBLE, prob)) - ln(greatest(1e-10::DOUBLE, 1 - prob))) * 4294967296, 0) AS BIGINT) AS e, MAX(frame) OVER (PARTITION BY track_id) AS final FROM nf),
      ld AS (SELECT track_id, pitch, frame, e AS lead FROM ev WHERE frame = 0 UNION ALL SELECT ev.track_id, ev.pitch, ev.frame, greatest(-858993459, least(858993459, lead)) + e FROM ld JOIN ev ON ev.track_id = ld.track_id AND ev.pitch = ld.pitch AND ev.frame = ld.frame + 1),
      both_ AS (SELECT ev.*, lead FROM ev JOIN ld USING (track_id, pitch, frame)),
      st AS (SELECT track_id, pitch, frame, lead > 0 AS state FROM both_ WHERE frame = final UNION ALL SELECT b.track_id, b.pitch, b.frame, CASE WHEN state THEN lead >= -858993459 ELSE lead >= 858993459 END FROM st JOIN both_ b ON b.track_id = st.track_id AND b.pitch = st.pitch AND b.frame = st.frame - 1)
      SELECT st.track_id, st.frame, st.pitch FROM st JOIN nf USING (track_id, pitch, frame) WHERE state AND prob >= 0.6""",
    "cqt_frame": f"WITH {SG}, {CQ} SELECT track_id, CAST(i // 64 AS INT) AS block_no, k AS bin, round(sqrt(power(SUM(x * c), 2) + power(SUM(x * s), 2)), 6) AS magnitude FROM sg JOIN kern ON j = i % 64 GROUP BY 1, 2, 3",
    "cqt_full": f"""WITH {SG}, {CQ}, fr AS (SELECT track_id, f * 64 AS a, f FROM (SELECT track_id, COUNT(*) AS n FROM sg GROUP BY 1), range(0, 100000) r(f) WHERE f * 64 + (SELECT MAX(j) + 1 FROM kern) <= n)
      SELECT fr.track_id, f AS frame, k AS bin, round(10 * log10(power(SUM(x * c), 2) + power(SUM(x * s), 2)), 6) AS db FROM fr, kern JOIN sg ON sg.track_id = fr.track_id AND sg.i = a + j GROUP BY 1, 2, 3""",
    "resample_down": f"WITH {SG}, n AS (SELECT track_id, COUNT(*) AS n FROM sg GROUP BY 1), g AS (SELECT track_id, n, CAST(k AS BIGINT) AS i, greatest(0, 3 * k - 1) AS a FROM n, range(0, 100000) r(k) WHERE k < floor(n / 3.0 + 0.5)) SELECT g.track_id, g.i, round(avg(x), 6) AS x FROM g JOIN sg ON sg.track_id = g.track_id AND sg.i >= a AND sg.i < a + 3 GROUP BY 1, 2",
    "overlap_add": f"WITH {SG} SELECT track_id, i, round(x, 6) AS x FROM sg",
    "stft_magnitude": f"""WITH {SG}, n AS (SELECT track_id, COUNT(*) AS n FROM sg GROUP BY 1), f AS (SELECT track_id, CAST(k AS BIGINT) AS frame FROM n, range(0, 100000) r(k) WHERE k * 32 + 64 <= n),
      y AS (SELECT f.track_id, frame, i - frame * 32 AS p, x * (0.5 - 0.5 * cos(2 * pi() * (i - frame * 32) / 63)) AS y FROM f JOIN sg ON sg.track_id = f.track_id AND i >= frame * 32 AND i < frame * 32 + 64)
      SELECT track_id, frame, CAST(b AS INT) AS bin, round(sqrt(power(SUM(y * cos(2 * pi() * b * p / 64)), 2) + power(SUM(y * sin(2 * pi() * b * p / 64)), 2)), 5) AS mag FROM y, range(0, 33) r(b) GROUP BY 1, 2, 3""",
    "note_spans": f"WITH {SPAN} SELECT * FROM sp",
    "spans_to_measures": f"""WITH {SPAN} SELECT track_id, id, pitch, staff, CAST(m + 1 AS INT) AS measure, CAST(greatest(start_tick, m * 1920) AS INT) AS start_tick, CAST(least(end_tick, (m + 1) * 1920) AS INT) AS end_tick, m < (greatest(end_tick, start_tick + 1) - 1) // 1920 AS tie_start, m > start_tick // 1920 AS tie_stop
      FROM sp, range(0, 400) r(m) WHERE m >= start_tick // 1920 AND m <= (greatest(end_tick, start_tick + 1) - 1) // 1920""",
    "measure_boundaries": f"""WITH {SPAN}, {SIG}, u AS (SELECT track_id, MAX(end_tick) AS e FROM sp GROUP BY 1), z AS (SELECT track_id, CAST(start_beat * 480 AS BIGINT) AS s, least(CAST(end_beat * 480 AS BIGINT), e) AS stop, numerator, denominator FROM u, sig UNION ALL SELECT track_id, least(80 * 480, e), e, 3, 4 FROM u),
      m AS (SELECT track_id, s + k * numerator * 480 AS a, least(s + (k + 1) * numerator * 480, stop) AS b, numerator, denominator FROM z, range(0, 200) r(k) WHERE s + k * numerator * 480 < stop)
      SELECT track_id, CAST(ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY a) AS INT) AS measure, a AS start_tick, b AS end_tick, numerator, denominator FROM m""",
    "midi_events": f"""WITH {NE}, e AS (SELECT track_id, CAST(floor(start_time * 960) AS BIGINT) AS tick, 1 AS is_on, pitch, velocity, id FROM ne UNION ALL SELECT track_id, CAST(floor(end_time * 960) AS BIGINT), 0, pitch, 0, id FROM ne)
      SELECT track_id, CAST(ROW_NUMBER() OVER w AS INT) AS seq, tick, tick - coalesce(LAG(tick) OVER w, 0) AS delta, is_on, pitch, velocity FROM e WINDOW w AS (PARTITION BY track_id ORDER BY tick, id, is_on DESC)""",
    "late_early_classify": "SELECT event_id, CASE WHEN d < -20000 THEN 'drop' WHEN d <= 10000 THEN 'show' ELSE 'hold' END AS class FROM (SELECT event_id, -((event_id * 13) % 60 - 30) * 1000 AS d FROM events)",
    "debounce_sessions": """WITH s AS (SELECT user_id AS key, epoch_us(ts) AS us, value, CASE WHEN epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
      g AS (SELECT *, SUM(new) OVER (PARTITION BY key ORDER BY us) AS grp FROM s) SELECT key, MIN(us) AS start_us, MAX(us) + 21600000000 AS end_us, round(arg_max(value, us), 6) AS value, COUNT(*) AS n FROM g GROUP BY key, grp""",
    "ring_buffer_tail": "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5",
    "cache_variant_lookup": f"""WITH {NE}, t AS (SELECT track_id, MAX(end_time) AS d FROM ne GROUP BY 1) SELECT CAST(track_id AS VARCHAR) AS content_hash, CAST(7 AS BIGINT) AS variant_key, round(d, 6) AS duration, CASE WHEN track_id % 2 = 0 THEN round(CASE WHEN track_id % 3 = 0 THEN d * 1.5 ELSE d END, 6) END AS cached_duration,
      CASE WHEN track_id % 2 <> 0 THEN 'missing' WHEN track_id % 3 = 0 AND d * 0.5 > 0.02 * d AND d * 0.5 > 2 THEN 'stale' ELSE 'hit' END AS result FROM t""",
    "cache_validation": f"WITH {NFA} SELECT track_id, true AS ok, COUNT(*) AS frames FROM nfa GROUP BY 1",
    "loop_split": f"WITH {SG}, s AS (SELECT *, greatest(1, COUNT(*) OVER (PARTITION BY track_id) // 500) AS step FROM sg) SELECT track_id, CASE WHEN i / 441.0::DOUBLE < 1 THEN 'pre' WHEN i / 441.0::DOUBLE > 3 THEN 'post' ELSE 'mid' END AS part, COUNT(*) AS n FROM s WHERE i % step = 0 GROUP BY 1, 2",
    "note_at_beat": f"WITH {NE}, {BT}, h AS (SELECT bt.track_id, beat_idx, t, id, pitch, ROW_NUMBER() OVER (PARTITION BY bt.track_id, beat_idx ORDER BY start_time, id) AS rn FROM bt JOIN ne ON ne.track_id = bt.track_id AND start_time <= t AND t < end_time) SELECT track_id, beat_idx, round(t, 6) AS t, id, pitch FROM h WHERE rn = 1",
    "cursor_offset": f"""WITH {NE}, q_ AS (SELECT track_id, id, {_snap_start('b')} AS b FROM (SELECT track_id, id, {_to_beat('start_time')} AS b FROM ne)), d AS (SELECT q_.track_id, ne.start_time - {_to_time('q_.b')} AS d FROM q_ JOIN ne USING (track_id, id)),
      k AS (SELECT track_id, CASE WHEN abs(d) <= 2 THEN d END AS d FROM d) SELECT track_id, CASE WHEN COUNT(d) >= 4 THEN round(median(d), 6) ELSE 0.0 END AS offset, COUNT(d) AS n FROM k GROUP BY 1""",
    "mean_tempo": f"WITH {TR}, {TS} SELECT track_id, round((SELECT SUM(bpm * (e - s)) / SUM(e - s) FROM ts), 6) AS bpm FROM tr",
    "clef_by_measure": f"WITH {SPAN}, p AS (SELECT track_id, pitch, staff, CAST(m + 1 AS INT) AS measure FROM sp, range(0, 400) r(m) WHERE m >= start_tick // 1920 AND m <= (greatest(end_tick, start_tick + 1) - 1) // 1920) SELECT track_id, measure, staff, round(avg(pitch), 6) AS mean_pitch, CASE WHEN avg(pitch) < 46 THEN 'F' ELSE 'G' END AS clef FROM p GROUP BY 1, 2, 3",
    "energy_notes": f"""WITH {SG}, p AS (SELECT track_id, i // 32 AS h, SUM(x * x) AS e, COUNT(*) AS n FROM sg GROUP BY 1, 2), w AS (SELECT *, sqrt(SUM(e) OVER v / SUM(n) OVER v) AS rms FROM p WINDOW v AS (PARTITION BY track_id ORDER BY h ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
      o2 AS (SELECT *, h - ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY h) AS run FROM w WHERE round(rms, 9) > 0.125), r AS (SELECT track_id, MIN(h) * (32 / 441.0::DOUBLE) AS a, (MAX(h) + 1) * (32 / 441.0::DOUBLE) AS z, MAX(rms) AS pk FROM o2 GROUP BY track_id, run)
      SELECT track_id, 60 AS pitch, round(a, 6) AS start_time, round(z, 6) AS end_time, CAST(greatest(1, least(127, round(pk * 127))) AS INT) AS velocity FROM r WHERE z - a > 0.05""",
    "adaptive_budget": "WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 4000 AS DOUBLE) AS s FROM orders) SELECT o_orderkey, CAST(CASE WHEN s > 1800 THEN 3000 WHEN s > 300 THEN 3000 ELSE 6000 END AS INT) AS budget, round(greatest(0.8, least(300.0, 0.8 + s * (0.4 * 0.07 + 0.6 * 0.05) * 1.35)), 6) AS estimate, round(CASE WHEN s > 0.5 THEN CASE WHEN s > 3000 THEN 2850.0 ELSE s END ELSE 0 END, 6) AS resume, CAST(floor(s / 8) * 8 AS BIGINT) AS bucket FROM s",
    "meter_classes": "WITH m AS (SELECT DISTINCT CAST(l_linenumber % 13 AS INT) AS numerator, CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 8 END AS denominator FROM lineitem) SELECT numerator, denominator, CASE numerator || '/' || denominator WHEN '2/4' THEN 'SimpleDuple' WHEN '3/4' THEN 'SimpleTriple' WHEN '4/4' THEN 'SimpleQuadruple' WHEN '6/8' THEN 'CompoundDuple' WHEN '12/8' THEN 'CompoundQuadruple' ELSE 'Other' END AS meter_class FROM m",
}
ORACLES["measure_of_tick"] = f"""SELECT p.track_id, p.tick, coalesce(MAX(m.measure) FILTER (p.tick >= m.start_tick AND p.tick < m.end_tick), MAX(m.measure)) AS measure
  FROM (SELECT DISTINCT track_id, start_tick AS tick FROM ({ORACLES['note_spans']}) n) p JOIN ({ORACLES['measure_boundaries']}) m USING (track_id) GROUP BY 1, 2"""
