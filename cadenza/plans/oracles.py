"""The registered queries in plain SQL, straight from the rules and independent of the operators."""

from __future__ import annotations

import re

W = r"\p{L}\p{N}_"


def r(e: str) -> str:
    """Six places, rounded on the scaled double."""
    return f"floor(({e}) * 1000000.0 + 0.5) / 1000000.0"


def mean(e: str, only: str = "true") -> str:
    """Mean whatever the order of addition."""
    return f"(CAST(sum(CAST({e} AS DECIMAL(26,12))) FILTER ({only}) AS DOUBLE) / count({e}) FILTER ({only}))"


def hu(e: str, d: int) -> str:
    s = f"{10**d}.0"
    return f"(floor(({e}) * {s} + 0.5) / {s})"


def fx(e: str, d: int) -> str:
    return f"printf('%.{d}f', CAST({e} AS DOUBLE))"


def srt(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def mmss(ms: str) -> str:
    return f"printf('%02d:%02d', {ms} // 60000, {ms} // 1000 % 60)"


def mmss_ms(ms: str) -> str:
    return f"printf('%02d:%02d.%03d', {ms} // 60000, {ms} // 1000 % 60, {ms} % 1000)"


def present(*pairs: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for cond, label in pairs)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def lines(source: str, section: int, item: str, *parts: str) -> str:
    """Rows (recording_id, section, item, sub, line) from a list of line expressions."""
    return (
        f"SELECT recording_id, {section} AS section, CAST({item} AS BIGINT) AS item, "
        f"CAST(unnest(range(len(ls))) AS INT) AS sub, unnest(ls) AS line FROM (SELECT *, "
        f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS ls FROM {source})"
    )


ORD = "sort_ms, segment_id, pos"
RW = "PARTITION BY recording_id ORDER BY sort_ms, segment_id, pos"
VAR = "greatest(0.0, gap_squares / gap_count - (gap_sum / gap_count) * (gap_sum / gap_count)) / 1000000.0"
SVAR = "greatest(0.0, gap_squares - gap_sum * (gap_sum / gap_count)) / (gap_count - 1) / 1000000.0"
UNKNOWN = "unknown check pyannote"
FILLERS = ("uh", "um", "er", "ah", "like", "you know")


def _text_features(source: str, ids: str) -> str:
    """Text problems by looking at tokens: runs of word characters and single other characters."""
    fillers = " + ".join(f"CAST(contains(lt, '{f}') AS INT)" for f in FILLERS)
    return rf"""
    SELECT {ids}, text, lt, n, {fillers} AS fc,
      len(list_filter(wt, lambda x: length(x) <= 2))
        + len(list_filter(range(1, len(tk) - 1), lambda i:
            regexp_full_match(tk[i], '[a-z]+') AND tk[i + 1] = '-' AND regexp_full_match(tk[i + 2], '[{W}]+'))) AS iw,
      len(regexp_extract_all(t, '\.{{2,}}')) + len(regexp_extract_all(t, '\?{{2,}}')) + len(regexp_extract_all(t, '!{{2,}}')) AS up,
      len(list_filter(regexp_extract_all(lt, '[{W}]+'), lambda x: regexp_full_match(x, '[bcdfghjklmnpqrstvwxyz]{{4,}}'))) AS im,
      len(list_filter(range(1, len(sk) - 1), lambda i:
        regexp_full_match(sk[i], '[{W}]+') AND regexp_full_match(sk[i + 1], '\s+') AND sk[i] = sk[i + 2])) > 0 AS rep,
      length(t) = 0 AS empty
    FROM (SELECT *, trim(text) AS t, lower(trim(text)) AS lt,
        len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS n,
        regexp_extract_all(trim(text), '[{W}]+') AS wt,
        regexp_extract_all(trim(text), '[{W}]+|[^{W}]') AS tk,
        regexp_extract_all(lower(trim(text)), '[{W}]+|\s+|[^{W}\s]+') AS sk
      FROM {source})"""


ISSUES = (
    "CASE WHEN empty THEN ['empty_text'] ELSE "
    + present(
        ("rep", "repetitive_text"),
        ("n > 0 AND fc / n > 0.2", "excessive_fillers"),
        ("iw > 2", "incomplete_words"),
        ("up > 0", "unusual_punctuation"),
        ("n < 2", "very_short_segment"),
        ("n > 50", "very_long_segment"),
        ("im > 0", "incoherent_text"),
    )
    + " END"
)

def _percentile(q: int) -> str:
    """Linear interpolation between the two values around rank (n - 1) * q / 100."""
    rank = f"n * CAST({q / 100} AS DOUBLE)"
    lo, hi = f"l[CAST(floor({rank}) AS INT) + 1]", f"l[CAST(ceil({rank}) AS INT) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({rank} - floor({rank}))) / 1000.0 AS p{q}"


CTES: dict[str, str] = {
    "conv": "SELECT conv_id AS recording_id, turn AS segment_id, role, text FROM conversations",
    "tok": r"SELECT recording_id, segment_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS t FROM conv",
    "w0": "SELECT recording_id, segment_id, unnest(range(len(t))) AS pos, unnest(t) AS word FROM tok",
    "w1": """SELECT *, (recording_id * 7919 + segment_id * 104729 + pos * 12917) % 9973 AS h,
        120 + 35 * least(length(word), 12) AS dur FROM w0""",
    "w2": """SELECT *, CAST(sum(dur + CASE WHEN h % 37 = 0 THEN -60 WHEN h % 41 = 0 THEN 2500 ELSE h % 400 END)
        OVER (PARTITION BY recording_id ORDER BY segment_id, pos) AS BIGINT) AS e FROM w1""",
    "words": """SELECT recording_id, segment_id, pos, word, h,
        CASE WHEN h % 211 = 0 THEN -1 ELSE e - dur END AS start_ms,
        CASE WHEN h % 53 = 0 THEN e - dur ELSE e END AS end_ms, (h % 101) / 100.0 AS probability FROM w2""",
    "c0": """SELECT *, start_ms AS sort_ms, end_ms <= start_ms AS timing_repaired,
        CASE WHEN end_ms <= start_ms THEN start_ms + 20 ELSE end_ms END AS e2 FROM words WHERE start_ms >= 0 AND end_ms >= 0""",
    "c1": f"SELECT *, lag(e2) OVER ({RW}) AS prev_end_ms, row_number() OVER ({RW}) AS rn FROM c0",
    "clean": """SELECT recording_id, segment_id, pos, word, h, probability, timing_repaired, sort_ms, rn, prev_end_ms, e2 AS end_ms,
        CASE WHEN start_ms < prev_end_ms THEN prev_end_ms + 1 ELSE start_ms END AS start_ms FROM c1""",
    "spans": "SELECT recording_id, segment_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM clean GROUP BY ALL",
    "segments": """SELECT recording_id, segment_id, start_ms, end_ms, text, role,
        -((recording_id * 31 + segment_id * 17) % 250) / 100.0 AS avg_logprob,
        ((recording_id * 13 + segment_id * 29) % 100) / 100.0 AS no_speech_prob FROM conv JOIN spans USING (recording_id, segment_id)""",
    "talk": """SELECT recording_id, role AS speaker, greatest(0, start_ms - 300) AS start_ms, end_ms + 400 AS end_ms FROM segments
        UNION ALL SELECT recording_id, 'moderator', (start_ms + end_ms) // 2, (start_ms + end_ms) // 2 + 800 FROM segments
        WHERE (recording_id + segment_id) % 5 = 0""",
    "turns": """SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker) - 1 AS turn_no,
        speaker, start_ms, end_ms FROM talk""",
    "durations": "SELECT recording_id, max(end_ms) AS duration_ms FROM clean GROUP BY 1",
    # buckets: one step of the recursion closes one bucket
    "cut": """SELECT recording_id, 0 AS b, start_ms AS s0, 1 AS rn0 FROM clean WHERE rn = 1
        UNION ALL SELECT c.recording_id, b + 1, arg_min(c.end_ms, c.rn), min(c.rn) + 1
        FROM cut JOIN clean c ON c.recording_id = cut.recording_id AND c.rn >= rn0 AND c.end_ms >= s0 + 4000
        GROUP BY c.recording_id, b""",
    "bucketed": """SELECT clean.*, b AS bucket_index, s0 AS bucket_start_ms,
        CASE WHEN rn > rn0 THEN greatest(0, start_ms - prev_end_ms) END AS gap_ms
        FROM clean ASOF JOIN cut ON clean.recording_id = cut.recording_id AND clean.rn >= cut.rn0""",
    "old_cut": """SELECT recording_id, 0 AS b, start_ms AS s0, 1 AS rn0 FROM clean WHERE rn = 1
        UNION ALL SELECT c.recording_id, b + 1, arg_min(c.start_ms, c.rn), min(c.rn)
        FROM old_cut JOIN clean c ON c.recording_id = old_cut.recording_id AND c.rn > rn0
          AND c.end_ms - s0 BETWEEN 3750 AND 4250
        GROUP BY c.recording_id, b""",
    "old_bucketed": """SELECT clean.*, b AS bucket_index, s0 AS bucket_start_ms,
        CASE WHEN rn > rn0 THEN greatest(0, start_ms - prev_end_ms) END AS gap_ms
        FROM clean ASOF JOIN old_cut ON clean.recording_id = old_cut.recording_id AND clean.rn >= old_cut.rn0""",
    "buckets": f"""SELECT recording_id, bucket_index, min(bucket_start_ms) AS start_ms, arg_max(end_ms, rn) AS end_ms,
        count(*) AS word_count, string_agg(word, ' ' ORDER BY rn) AS text, count(gap_ms) AS gap_count,
        list(gap_ms ORDER BY rn) FILTER (gap_ms IS NOT NULL) AS gaps, CAST(coalesce(sum(gap_ms), 0) AS BIGINT) AS gap_sum,
        CAST(coalesce(sum(gap_ms * gap_ms), 0) AS BIGINT) AS gap_squares, coalesce(min(gap_ms), 0) AS gap_min,
        coalesce(max(gap_ms), 0) AS gap_max,
        coalesce(CAST(sum(CAST(probability AS DECIMAL(18,8))) FILTER (probability > 0) AS DOUBLE) / count(*) FILTER (probability > 0), 0.0) AS confidence
        FROM bucketed GROUP BY 1, 2""",
    "b2": f"""SELECT *, CASE WHEN gap_count > 0 THEN gap_sum / 1000.0 / gap_count ELSE 0.0 END AS m,
        CASE WHEN gap_count > 0 THEN {VAR} ELSE 0.0 END AS v FROM buckets""",
    "ctx0": """SELECT recording_id, CAST(sum(gap_count) AS BIGINT) AS gap_count, CAST(sum(gap_sum) AS BIGINT) AS gap_sum,
        CAST(sum(gap_squares) AS BIGINT) AS gap_squares FROM buckets GROUP BY 1""",
    "ctx": f"""SELECT recording_id, gap_count AS total_gaps, CASE WHEN gap_count > 0 THEN gap_sum / 1000.0 / gap_count ELSE 0.0 END AS gm,
        CASE WHEN gap_count > 0 THEN {VAR} ELSE 0.0 END AS gv FROM ctx0""",
    "rec0": """SELECT b2.*, gm, gv, CASE WHEN gap_count = 0 THEN 'normal' WHEN m > gm + 1.5 * sqrt(gv) THEN 'slow'
        WHEN m < gm - 1.5 * sqrt(gv) THEN 'fast' ELSE 'normal' END AS cadence FROM b2 JOIN ctx USING (recording_id)""",
    "pairs": """SELECT a.recording_id, a.turn_no AS first_turn, b.turn_no AS second_turn, greatest(a.start_ms, b.start_ms) AS start_ms,
        least(a.end_ms, b.end_ms) AS end_ms, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS duration_ms,
        a.speaker || '|' || b.speaker AS speakers,
        CASE WHEN (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) * 100
          >= least(a.end_ms - a.start_ms, b.end_ms - b.start_ms) * 80 THEN 'complete' ELSE 'partial' END AS overlap_type
        FROM turns a JOIN turns b ON a.recording_id = b.recording_id AND a.turn_no < b.turn_no AND a.speaker <> b.speaker
          AND a.end_ms > b.start_ms AND b.end_ms > a.start_ms""",
    "pn": "SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY first_turn, second_turn) AS n FROM pairs",
    # greedy removal of near-duplicates, one candidate per step
    "greedy": """SELECT recording_id, 0 AS n, CAST([] AS STRUCT(s BIGINT, e BIGINT, n BIGINT)[]) AS kept FROM (SELECT DISTINCT recording_id FROM pn)
        UNION ALL SELECT g.recording_id, p.n, CASE WHEN len(list_filter(g.kept, lambda k: abs(k.s - p.start_ms) < 100 AND abs(k.e - p.end_ms) < 100)) > 0
          THEN g.kept ELSE list_append(g.kept, {'s': p.start_ms, 'e': p.end_ms, 'n': p.n}) END
        FROM greedy g JOIN pn p ON p.recording_id = g.recording_id AND p.n = g.n + 1""",
    "keepers": """SELECT recording_id, unnest(list_transform(k, lambda x: x.n)) AS n
        FROM (SELECT recording_id, arg_max(kept, n) AS k FROM greedy GROUP BY 1)""",
    "laps": "SELECT pn.* EXCLUDE (n) FROM pn JOIN keepers USING (recording_id, n)",
    "touch": """SELECT DISTINCT b.recording_id, b.bucket_index FROM buckets b JOIN laps o
        ON o.recording_id = b.recording_id AND o.start_ms < b.end_ms AND o.end_ms > b.start_ms""",
    "status": """SELECT b.recording_id, b.bucket_index, CASE WHEN t.bucket_index IS NOT NULL THEN 'overlap' ELSE 'single' END AS speaker_overlap
        FROM buckets b SEMI JOIN turns USING (recording_id) LEFT JOIN touch t USING (recording_id, bucket_index)""",
    "records": f"SELECT rec0.*, coalesce(speaker_overlap, '{UNKNOWN}') AS speaker_overlap FROM rec0 LEFT JOIN status USING (recording_id, bucket_index)",
    "distribution": f"""SELECT recording_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, CAST(sum(word_count) AS BIGINT) AS wc,
        CAST(sum(gap_count) AS BIGINT) AS gc, count(*) FILTER (cadence = 'slow') AS slow_count, count(*) FILTER (cadence = 'normal') AS normal_count,
        count(*) FILTER (cadence = 'fast') AS fast_count, count(*) FILTER (speaker_overlap = 'overlap') AS overlap_count,
        count(*) FILTER (speaker_overlap = 'single') AS single_count, count(*) FILTER (speaker_overlap LIKE 'unknown%') AS unknown_count,
        {mean('confidence')} AS ac, {mean('confidence', 'confidence > 0')} AS acp, any_value(gm) AS gm, any_value(gv) AS gv,
        max(bucket_index) AS last_bucket, count(*) FILTER (start_ms >= end_ms) AS bad FROM records GROUP BY 1""",
    # older timing analysis, over its own buckets (old) and over the bounded ones (new)
    **{
        f"{p}_t0": f"""SELECT recording_id, bucket_index, min(bucket_start_ms) AS start_ms, arg_max(end_ms, rn) AS end_ms, count(*) AS word_count,
        CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, CAST(sum(CAST(probability AS DECIMAL(18,8))) AS DOUBLE) / count(*) AS confidence,
        count(gap_ms) AS gap_count, CAST(coalesce(sum(gap_ms), 0) AS BIGINT) AS gap_sum, CAST(coalesce(sum(gap_ms * gap_ms), 0) AS BIGINT) AS gap_squares
        FROM {src} GROUP BY 1, 2"""
        for p, src in (("old", "old_bucketed"), ("new", "bucketed"))
    },
    **{
        f"{p}_t": f"""SELECT *, CASE WHEN end_ms > start_ms THEN word_count / ((end_ms - start_ms) / 1000.0) ELSE 0.0 END AS wps,
        CASE WHEN gap_count > 0 THEN gap_sum / 1000.0 / gap_count ELSE 0.0 END AS m,
        CASE WHEN gap_count > 1 THEN {SVAR} ELSE 0.0 END AS v FROM {p}_t0"""
        for p in ("old", "new")
    },
    **{
        f"{p}_g0": f"""SELECT recording_id, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(gap_count) AS BIGINT) AS gap_count,
        CAST(sum(gap_sum) AS BIGINT) AS gap_sum, CAST(sum(gap_squares) AS BIGINT) AS gap_squares, count(*) AS bucket_count FROM {p}_t GROUP BY 1"""
        for p in ("old", "new")
    },
    **{
        f"{p}_p": f"""SELECT recording_id, {', '.join(_percentile(q) for q in (25, 50, 75, 90, 95, 99))}
        FROM (SELECT recording_id, list(CAST(gap_ms AS DOUBLE) ORDER BY gap_ms) AS l, count(*) - 1 AS n FROM {src}
        WHERE gap_ms IS NOT NULL GROUP BY 1)"""
        for p, src in (("old", "old_bucketed"), ("new", "bucketed"))
    },
    **{
        f"{p}_g": f"""SELECT *, CASE WHEN gap_count > 0 THEN gap_sum / 1000.0 / gap_count ELSE 0.0 END AS gm,
        CASE WHEN gap_count > 1 THEN sqrt({SVAR}) ELSE 0.0 END AS gs FROM {p}_g0 LEFT JOIN {p}_p USING (recording_id)"""
        for p in ("old", "new")
    },
    **{
        f"{p}_gs": f"""SELECT *, CASE WHEN gap_count = 0 THEN 'No gaps detected' ELSE
        CASE WHEN gm < 0.05 THEN 'very fast' WHEN gm < 0.1 THEN 'fast' WHEN gm < 0.2 THEN 'normal' WHEN gm < 0.4 THEN 'slow' ELSE 'very slow' END
        || ' speech with ' || CASE WHEN gs < 0.02 THEN 'very consistent' WHEN gs < 0.05 THEN 'consistent' WHEN gs < 0.1 THEN 'variable'
        ELSE 'highly variable' END || ' pacing (μ=' || {fx('gm', 3)} || 's, σ=' || {fx('gs', 3)} || 's)' END AS summary FROM {p}_g"""
        for p in ("old", "new")
    },
    **{
        f"{name}": f"""SELECT t.*, gm, gs, abs(m - gm) AS dev, CASE WHEN t.gap_count < 2 OR NOT (abs(m - gm) > {g} * gs OR v > {g} * gs * gs) THEN 'normal'
        WHEN abs(m - gm) > 3 * ({g} * gs) OR v > 3 * ({g} * gs * gs) THEN 'severe'
        WHEN abs(m - gm) > 2 * ({g} * gs) OR v > 2 * ({g} * gs * gs) THEN 'moderate' ELSE 'mild' END AS severity
        FROM {p}_t t JOIN {p}_g USING (recording_id)"""
        for name, p, g in (("old_f", "old", 1.5), ("new_f", "new", 1.5), ("tight_f", "new", 0.5))
    },
    **{
        f"{p}_a": f"""SELECT g.*, odd FROM {p}_gs g JOIN (SELECT recording_id, count(*) FILTER (severity <> 'normal') AS odd FROM {p}_f GROUP BY 1)
        USING (recording_id)"""
        for p in ("old", "new")
    },
    "timing": """SELECT f.*, b.text, b.gaps, s.speaker_overlap = 'overlap' AS speaker_overlap, f.severity <> 'normal' AS anomaly
        FROM new_f f JOIN buckets b USING (recording_id, bucket_index) LEFT JOIN status s USING (recording_id, bucket_index)""",
    "feat": _text_features("segments", "recording_id, segment_id, start_ms, end_ms, avg_logprob, no_speech_prob"),
    "unc0": f"""SELECT *, {present(("avg_logprob < -1.0", "low_model_confidence"), ("no_speech_prob > 0.5", "high_no_speech_probability"))}
        || {ISSUES} || {present(("end_ms > start_ms AND n * 1000 > (end_ms - start_ms) * 6", "speech_too_fast"),
                                ("end_ms > start_ms AND n * 2000 < end_ms - start_ms AND n > 1", "speech_too_slow"),
                                ("end_ms - start_ms < 1000 AND n > 10", "duration_text_mismatch"))} AS reasons,
        CASE WHEN avg_logprob >= -0.5 THEN 'low' WHEN avg_logprob >= -1.5 THEN 'medium' ELSE 'high' END AS level FROM feat""",
    "unc": """SELECT *, level = 'high' OR len(reasons) >= 2 OR list_contains(reasons, 'low_model_confidence') AS review FROM unc0""",
    "temporal": """SELECT recording_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.0, 1.0 - count(*) FILTER (nx - end_ms > 5000 OR nx < end_ms)
        / (count(*) - 1)) END AS tc FROM (SELECT *, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY segment_id) AS nx FROM segments) GROUP BY 1""",
    "q0": f"""SELECT recording_id, count(*) AS n, count(*) FILTER (review) AS flagged, count(*) FILTER (level <> 'low' OR review) AS problems,
        count(*) FILTER (avg_logprob < -1.5) AS low, {mean('avg_logprob')} AS mean, stddev_samp(avg_logprob) AS sd,
        count(*) FILTER (list_contains(reasons, 'low_model_confidence')) AS k1, count(*) FILTER (list_contains(reasons, 'high_no_speech_probability')) AS k2,
        count(*) FILTER (list_contains(reasons, 'repetitive_text')) AS k3, count(*) FILTER (list_contains(reasons, 'excessive_fillers')) AS k4
        FROM unc GROUP BY 1""",
    "q1": """SELECT q0.*, tc, 1.0 - low / n AS rel, CASE WHEN mean >= -0.5 THEN 0.95 WHEN mean >= -1.0 THEN 0.90 WHEN mean >= -1.5 THEN 0.80 ELSE 0.70 END AS acc,
        problems / n AS pr, CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, 1.0 - sd / 2.0) END AS cons FROM q0 JOIN temporal USING (recording_id)""",
    "quality": "SELECT *, rel * 0.3 + acc * 0.3 + (1.0 - pr) * 0.2 + cons * 0.1 + 1.0 * 0.05 + tc * 0.05 AS q FROM q1",
    "advice": "SELECT recording_id, CASE WHEN len(a) = 0 THEN [CASE WHEN q < 0.9 THEN 'Good quality transcription with minor areas for improvement' "
    "ELSE 'High quality transcription - minimal issues detected' END] ELSE a END AS a FROM (SELECT *, "
    + present(
        ("q < 0.7", "Consider using a higher quality audio source or different model settings"),
        ("pr > 0.3", "High number of problematic segments detected - manual review recommended"),
        ("k1 > n * 0.2", "Consider using a larger model or different compute settings for better confidence"),
        ("k2 > n * 0.1", "Audio may contain significant silence or noise - consider preprocessing"),
        ("k3 > 0", "Repetitive text detected - may indicate model hallucination"),
        ("k4 > 0", "Excessive filler words detected - consider post-processing cleanup"),
        ("cons < 0.8", "Low consistency detected - check for audio quality variations"),
        ("tc < 0.9", "Temporal inconsistencies detected - check audio segmentation"),
    )
    + " AS a FROM quality)",
    "cstats": f"""SELECT recording_id, count(*) AS segment_count, {mean('avg_logprob')} AS mean, quantile_cont(avg_logprob, 0.5) AS med, stddev_pop(avg_logprob) AS sd,
        min(avg_logprob) AS mn, max(avg_logprob) AS mx FROM segments GROUP BY 1""",
    "who": """SELECT recording_id, segment_id, arg_min(speaker, -ov * 1000000 + turn_no) AS speaker FROM (SELECT s.recording_id, s.segment_id, t.speaker, t.turn_no,
        least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov FROM segments s JOIN turns t
        ON s.recording_id = t.recording_id AND s.start_ms < t.end_ms AND s.end_ms > t.start_ms AND s.end_ms > s.start_ms) WHERE ov > 0 GROUP BY 1, 2""",
    "lap": """SELECT s.recording_id, s.segment_id, count(*) AS k,
        string_agg(o.start_ms || ':' || o.end_ms || ':' || o.overlap_type, '|' ORDER BY first_turn, second_turn) AS l
        FROM segments s JOIN laps o ON s.recording_id = o.recording_id AND o.start_ms < s.end_ms AND o.end_ms > s.start_ms GROUP BY 1, 2""",
    "labelled": """SELECT s.*, w.speaker, lap.k IS NOT NULL AS has_overlap, coalesce(lap.k, 0) AS k, coalesce(l, '') AS l FROM segments s
        LEFT JOIN who w USING (recording_id, segment_id) LEFT JOIN lap USING (recording_id, segment_id)""",
    "dsum": """SELECT t.*, coalesce(k, 0) AS k, coalesce(ms, 0) AS ms FROM (SELECT recording_id, max(end_ms) AS total, count(DISTINCT speaker) AS spk, count(*) AS n
        FROM turns GROUP BY 1) t LEFT JOIN (SELECT recording_id, count(*) AS k, CAST(sum(duration_ms) AS BIGINT) AS ms FROM laps GROUP BY 1) USING (recording_id)""",
    "opens": f"""SELECT *, sum(CASE WHEN prev_end_ms IS NULL OR start_ms - prev_end_ms >= 1000 THEN 1 ELSE 0 END) OVER ({RW}) - 1 AS run_no FROM clean""",
    "speech": "SELECT recording_id, CAST(run_no AS BIGINT) AS run_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM opens GROUP BY 1, 2",
    "silences": """SELECT recording_id, end_ms AS start_ms, nx AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS nx
        FROM speech) WHERE nx - end_ms >= 500""",
    "quiet": """SELECT recording_id, end_ms AS start_ms, nx AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS nx
        FROM speech) WHERE nx - end_ms >= 1
        UNION ALL SELECT recording_id, 0, min(start_ms) FROM speech GROUP BY 1 HAVING min(start_ms) > 0
        UNION ALL SELECT recording_id, max(s.end_ms), duration_ms FROM speech s JOIN durations USING (recording_id) GROUP BY 1, 3 HAVING duration_ms > max(s.end_ms)""",
    "splits": """SELECT recording_id, i AS split_no, CASE WHEN i = n - 1 THEN duration_ms ELSE i * 25000 END AS place, duration_ms FROM
        (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(ceil(duration_ms / 25000) AS BIGINT) + 1 AS n FROM durations))""",
    **{
        name: f"""SELECT recording_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS split2, duration_ms, false AS done FROM durations
        UNION ALL SELECT recording_id, n + 1, s2 // 2 - {o}, s2, duration_ms, last FROM (SELECT x.recording_id, n, x.duration_ms, pos + {ch} >= x.duration_ms - {mn} AS last,
          CASE WHEN pos + {ch} >= x.duration_ms - {mn} THEN 2 * x.duration_ms
          ELSE coalesce(arg_min(s.start_ms + s.end_ms, abs(s.start_ms + s.end_ms - 2 * (pos + {ch})) * 100000000 + s.start_ms), 2 * (pos + {ch})) END AS s2
          FROM {name} x LEFT JOIN silences s ON s.recording_id = x.recording_id AND s.start_ms >= greatest(pos + {mn}, pos + {ch} - 5000)
            AND s.start_ms <= least(pos + {ch} + 5000, x.duration_ms)
          WHERE NOT done GROUP BY x.recording_id, n, pos, x.duration_ms)"""
        for name, ch, o, mn in (("sil", 30000, 5000, 5000), ("sil_short", 12000, 2000, 3000))
    },
    **{
        name: f"""SELECT recording_id, split_no AS chunk_id, a / 2000.0 AS start_time, b / 2000.0 AS end_time, b / 2000.0 - a / 2000.0 AS duration,
        s2 / 2000.0 AS original_start, nx / 2000.0 AS original_end,
        CASE WHEN split_no > 0 THEN s2 / 2000.0 - a / 2000.0 ELSE 0.0 END AS overlap_prev,
        CASE WHEN nx < 2 * duration_ms THEN b / 2000.0 - nx / 2000.0 ELSE 0.0 END AS overlap_next, duration_ms
        FROM (SELECT *, greatest(0, s2 - 10000) AS a, least(2 * duration_ms, nx + 10000) AS b FROM
          (SELECT *, lead(s2) OVER (PARTITION BY recording_id ORDER BY split_no) AS nx FROM ({src})) WHERE nx IS NOT NULL) WHERE b // 2 - a // 2 >= 5000"""
        for name, src in (
            ("chunks", "SELECT recording_id, split_no, 2 * place AS s2, duration_ms FROM splits"),
            ("sil_chunks", "SELECT recording_id, n AS split_no, split2 AS s2, duration_ms FROM sil"),
        )
    },
    **{
        name: f"""SELECT recording_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS begin_ms, duration_ms FROM durations
        UNION ALL SELECT recording_id, least(CASE WHEN mx > 0 THEN brk ELSE pos + {tg} END, duration_ms), pos, duration_ms FROM (
          SELECT x.recording_id, pos, x.duration_ms, coalesce(max(len), 0) AS mx, arg_min(a + len // 2, -len * 1000000000 + a) AS brk FROM {name} x
          LEFT JOIN LATERAL (SELECT greatest(q.start_ms, x.pos + {tg} - 5000) AS a, least(q.end_ms, x.pos + {tg} + 10000, x.duration_ms)
              - greatest(q.start_ms, x.pos + {tg} - 5000) AS len FROM quiet q WHERE q.recording_id = x.recording_id) s ON len > 0
          WHERE pos < x.duration_ms GROUP BY x.recording_id, pos, x.duration_ms)"""
        for name, tg in (("vad_walk", 45000), ("vad_walk_short", 20000))
    },
    **{
        name: f"""SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY begin_ms) - 1 AS chunk_no,
        coalesce((SELECT sum(least(s.end_ms, pos) - greatest(s.start_ms, begin_ms)) FROM speech s WHERE s.recording_id = w.recording_id
          AND s.start_ms < pos AND s.end_ms > begin_ms), 0) / (pos - begin_ms) AS share FROM {src} w WHERE pos - begin_ms >= {mn}"""
        for name, src, mn in (("vad", "vad_walk", 10000), ("vad_short", "vad_walk_short", 6000))
    },
    "heard": """SELECT c.recording_id, chunk_id, segment_id, start_ms - CAST(round(start_time * 1000) AS BIGINT) AS rs, end_ms - CAST(round(start_time * 1000) AS BIGINT) AS re,
        start_ms, end_ms, text, avg_logprob, no_speech_prob, original_start, original_end, start_time FROM segments s JOIN chunks c
        ON s.recording_id = c.recording_id AND start_ms >= round(start_time * 1000) AND start_ms < round(end_time * 1000)""",
    "core": "SELECT * FROM heard WHERE start_ms >= round(original_start * 1000) AND start_ms < round(original_end * 1000)",
    "runs": """SELECT recording_id, chunk_id, CASE WHEN (recording_id + chunk_id) % 3 = 0 THEN 'en' ELSE 'de' END AS language, (80 + chunk_id % 20) / 100.0 AS lp,
        duration, 1.0 + (chunk_id % 4) * 0.25 AS pt, -((recording_id + chunk_id) % 200) / 100.0 AS ac FROM chunks""",
    "top": """SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY avg_logprob, segment_id) AS rank FROM segments WHERE avg_logprob < -0.5""",
    "picked": r"""SELECT * FROM top WHERE end_ms - start_ms >= 1000 AND no_speech_prob <= 0.8
        AND len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) >= 2""",
    "wide": """SELECT *, greatest(0, least(start_ms - 2000, coalesce(ps, start_ms))) AS xs, greatest(end_ms + 2000, coalesce(ne, end_ms)) AS xe FROM (SELECT *,
        lag(start_ms) OVER (PARTITION BY recording_id ORDER BY segment_id) AS ps, lead(end_ms) OVER (PARTITION BY recording_id ORDER BY segment_id) AS ne FROM segments)""",
    "cand": "SELECT wide.* FROM wide SEMI JOIN picked USING (recording_id, segment_id)",
    # the slow pass: the target 0.2 s late (row 1), and what precedes it (row 0)
    "slow": """SELECT *, 1 AS no, CAST(floor((start_ms - xs + 200) * 10 / 7.0 + 0.5) AS BIGINT) AS a,
        CAST(floor((end_ms - xs + 200) * 10 / 7.0 + 0.5) AS BIGINT) AS b, text AS t, avg_logprob + 0.15 AS lp, no_speech_prob AS ns FROM cand
        UNION ALL SELECT *, 0, 0, CAST(floor((start_ms - xs) * 10 / 7.0 + 0.5) AS BIGINT), 'before', -0.1, 0.0 FROM cand""",
    "hit": """SELECT *, least(b * 7, (end_ms - xs) * 10) - greatest(a * 7, (start_ms - xs) * 10) AS ov FROM slow
        QUALIFY ov > 3500 AND row_number() OVER (PARTITION BY recording_id, segment_id ORDER BY ov DESC, no) = 1""",
    "back": """SELECT recording_id, segment_id, CAST(greatest(start_ms - 1000, least(start_ms + 1000, xs + floor(a * 7 / 10.0 + 0.5))) AS BIGINT) AS start_ms,
        CAST(greatest(end_ms - 1000, least(end_ms + 1000, xs + floor(b * 7 / 10.0 + 0.5))) AS BIGINT) AS end_ms, t AS text, lp AS avg_logprob,
        ns AS no_speech_prob FROM hit""",
    "final": """SELECT s.recording_id, s.segment_id, coalesce(b.start_ms, s.start_ms) AS start_ms, coalesce(b.end_ms, s.end_ms) AS end_ms, coalesce(b.text, s.text) AS text,
        coalesce(b.avg_logprob, s.avg_logprob) AS avg_logprob, coalesce(b.no_speech_prob, s.no_speech_prob) AS no_speech_prob,
        b.segment_id IS NOT NULL AS reprocessed, s.avg_logprob AS original_confidence FROM segments s LEFT JOIN back b USING (recording_id, segment_id)""",
    "report": f"""SELECT recording_id, count(*) AS n, count(*) FILTER (reprocessed) AS k,
        coalesce({mean('avg_logprob - original_confidence', 'reprocessed')}, 0.0) AS g,
        coalesce(max(avg_logprob - original_confidence) FILTER (reprocessed), 0.0) AS mx FROM final GROUP BY 1""",
}


def with_ctes(body: str) -> str:
    """Prefix the common table expressions that ``body`` needs, directly or not."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", sql)):
            if word in CTES and word not in need and re.search(rf"(?:FROM|JOIN)\s+{word}\b", sql):
                need.append(word)
                visit(CTES[word])

    visit(body)
    ordered = [n for n in CTES if n in need]
    # the recursive ones read clean, pn, silences or quiet many times over
    heads = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" if not _recursive(n) else f"{n} AS (\n{CTES[n]}\n)" for n in ordered)
    return f"WITH RECURSIVE {heads}\n{body}" if heads else body


def _recursive(name: str) -> bool:
    return bool(re.search(rf"(?:FROM|JOIN)\s+{name}\b", CTES[name]))


def srt_lines(source: str, order: str, text: str) -> str:
    numbered = f"(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY {order}) AS cue FROM {source})"
    return lines(
        numbered, 0, "cue", "CAST(cue AS VARCHAR)", f"{srt('start_ms')} || ' --> ' || {srt('end_ms')}", text, "''"
    )


def flag(cond: str, label: str) -> str:
    return f"CASE WHEN {cond} THEN ' {label}' ELSE '' END"


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


LABEL = "CASE WHEN coalesce(speaker, '') <> '' THEN '[' || speaker || '] ' ELSE '' END"
DIST = "slow_count, normal_count, fast_count, overlap_count, single_count, unknown_count"
PCTS = (25, 50, 75, 90, 95, 99)
SEC = "start_ms / 1000.0 AS start_time, end_ms / 1000.0 AS end_time"

_BODY: dict[str, str] = {
    "flatten_words": """SELECT w.recording_id, w.segment_id, pos, trim(word) AS word, w.start_ms, w.end_ms, probability FROM words w
        SEMI JOIN segments USING (recording_id, segment_id)""",
    "clean_words": """SELECT recording_id, sort_ms, segment_id, pos, start_ms, end_ms, word, probability, timing_repaired, prev_end_ms FROM clean""",
    "clean_words_without_repair": f"""SELECT recording_id, segment_id, pos, CASE WHEN start_ms < p THEN p + 1 ELSE start_ms END AS start_ms, end_ms FROM
        (SELECT *, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id, pos) AS p FROM words
         WHERE start_ms >= 0 AND end_ms > start_ms)""",
    "word_gaps": "SELECT recording_id, sort_ms, segment_id, pos, word, CASE WHEN prev_end_ms IS NOT NULL THEN greatest(0, start_ms - prev_end_ms) END AS gap_ms FROM clean",
    "join_words": "SELECT recording_id, segment_id, string_agg(word, ' ' ORDER BY sort_ms, pos) AS text FROM clean GROUP BY 1, 2",
    "bucketize": "SELECT recording_id, segment_id, pos, start_ms, end_ms, bucket_index, bucket_start_ms, gap_ms FROM bucketed",
    "bucketize_legacy": "SELECT recording_id, segment_id, pos, start_ms, end_ms, bucket_index, bucket_start_ms, gap_ms FROM old_bucketed",
    "bucket_table": f"""SELECT recording_id, bucket_index, start_ms, end_ms, word_count, text, gap_count, coalesce(array_to_string(gaps, '|'), '') AS gaps_ms,
        gap_sum, gap_squares, gap_min, gap_max, {r('confidence')} AS confidence FROM buckets""",
    "cadence_buckets": f"""SELECT recording_id, bucket_index, {r('start_ms / 1000.0')} AS start_time, {r('end_ms / 1000.0')} AS end_time,
        {r('(end_ms - start_ms) / 1000.0')} AS duration, word_count, text, gap_count AS word_gap_count, {r('m')} AS word_gap_mean, {r('v')} AS word_gap_var,
        cadence, {r('confidence')} AS confidence_score FROM rec0""",
    "gap_stats": f"""SELECT recording_id, bucket_index, gap_count, {r('m')} AS gap_mean, {r('v')} AS gap_var, {r('sqrt(v)')} AS gap_std,
        {r('gap_min / 1000.0')} AS min_gap, {r('gap_max / 1000.0')} AS max_gap FROM b2""",
    "cadence_context": f"""SELECT recording_id, {r('gm')} AS global_mean, {r('sqrt(gv)')} AS global_std, {r('gv')} AS global_variance, total_gaps, 1.5 AS gap_threshold,
        {r('gm + 1.5 * sqrt(gv)')} AS slow_threshold, {r('gm - 1.5 * sqrt(gv)')} AS fast_threshold FROM ctx""",
    "validate_buckets": f"""SELECT recording_id, count(*) AS bucket_count, count(*) FILTER (bad) = 0 AS valid, count(*) FILTER (bad) AS duration_violations,
        {r('sum(d) / 1000.0')} AS total_duration, {r('sum(d) / count(*) / 1000.0')} AS average_duration, {r('sum(word_count) / count(*)')} AS average_word_count,
        {r('min(d) / 1000.0')} AS min_duration, {r('max(d) / 1000.0')} AS max_duration FROM (SELECT *, end_ms - start_ms AS d,
        (end_ms - start_ms < 3750 OR end_ms - start_ms > 4250) AND bucket_index < max(bucket_index) OVER (PARTITION BY recording_id) AS bad FROM buckets) GROUP BY 1""",
    "bucket_violations": f"""SELECT recording_id, bucket_index, {r('(end_ms - start_ms) / 1000.0')} AS duration, 3.75 AS expected_min, 4.25 AS expected_max FROM
        (SELECT *, max(bucket_index) OVER (PARTITION BY recording_id) AS top FROM buckets) WHERE bucket_index < top AND (end_ms - start_ms < 3750 OR end_ms - start_ms > 4250)""",
    "merge_short": """, m AS (SELECT recording_id, bucket_index AS i, CAST(1 AS BIGINT) AS w FROM buckets WHERE false UNION ALL SELECT 0, 0, 0 WHERE false),
        seq AS (SELECT *, max(bucket_index) OVER (PARTITION BY recording_id) AS top FROM buckets),
        walk AS (SELECT recording_id, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS i, CASE WHEN end_ms - start_ms < 4300 AND top > 0 THEN 2 ELSE 1 END AS w FROM seq WHERE bucket_index = 0
          UNION ALL SELECT s.recording_id, no + 1, s.bucket_index, CASE WHEN s.end_ms - s.start_ms < 4300 AND s.bucket_index < s.top THEN 2 ELSE 1 END
          FROM walk JOIN seq s ON s.recording_id = walk.recording_id AND s.bucket_index = walk.i + walk.w)
        SELECT b.recording_id, i AS first_bucket, arg_min(start_ms, bucket_index) AS start_ms, arg_max(end_ms, bucket_index) AS end_ms, CAST(sum(word_count) AS BIGINT) AS word_count,
        count(*) AS merged_from, string_agg(text, ' ' ORDER BY bucket_index) AS text, no AS bucket_index
        FROM walk JOIN buckets b ON b.recording_id = walk.recording_id AND b.bucket_index >= i AND b.bucket_index < i + w GROUP BY 1, 2, no""",
    "validate_gaps": f"""SELECT recording_id, count(*) AS total_buckets, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(greatest(0, word_count - 1)) AS BIGINT) AS total_gaps,
        count(*) FILTER (word_count >= 2) AS buckets_with_gaps, count(*) FILTER (cadence = 'slow') AS slow_buckets, count(*) FILTER (cadence = 'normal') AS normal_buckets,
        count(*) FILTER (cadence = 'fast') AS fast_buckets, {r('any_value(gm)')} AS global_mean, {r('sqrt(any_value(gv))')} AS global_std, {r('any_value(gv)')} AS global_variance,
        {r('count(*) FILTER (word_count >= 2) / count(*)')} AS quality_score FROM rec0 GROUP BY 1""",
    "bucket_overlap_status": "SELECT recording_id, bucket_index, speaker_overlap FROM status",
    "assemble_records": f"SELECT recording_id, bucket_index, word_count, {r('m')} AS word_gap_mean, cadence, speaker_overlap, {r('confidence')} AS confidence_score FROM records",
    "validate_records": f"""SELECT recording_id, n AS record_count, bad = 0 AS valid, bad AS error_count, {r('ms / 1000.0')} AS total_duration, wc AS total_words, gc AS total_gaps,
        {r('ac')} AS average_confidence, {DIST}, {r('CASE WHEN ms > 0 THEN wc / (ms / 1000.0) ELSE 0.0 END')} AS words_per_second, {r('gc / n')} AS gaps_per_record FROM distribution""",
    "record_errors": "SELECT recording_id, bucket_index, 'Record ' || bucket_index || ': Invalid time range' AS error FROM records WHERE start_ms >= end_ms",
    "summarize_records": f"""SELECT recording_id, n AS record_count, {hu('ms / 1000.0', 2)} AS total_duration, wc AS total_words, gc AS total_gaps, {hu('coalesce(acp, 0.0)', 3)} AS average_confidence,
        slow_count, normal_count, fast_count, {hu('slow_count / n * 100', 1)} AS slow_pct, {hu('normal_count / n * 100', 1)} AS normal_pct, {hu('fast_count / n * 100', 1)} AS fast_pct,
        overlap_count, single_count, unknown_count, overlap_count > 0 AS overlap_detected, unknown_count = 0 AS detection_available,
        CASE WHEN ms > 0 THEN {hu('wc / (ms / 1000.0)', 2)} ELSE 0.0 END AS words_per_second, {hu('ms / 1000.0 / n', 2)} AS average_bucket_duration,
        {hu('wc / n', 1)} AS average_words_per_bucket FROM distribution""",
    "markdown_statistics": f"""SELECT recording_id, n AS record_count, last_bucket, {r('ms / 1000.0')} AS total_duration, wc AS total_words, gc AS total_gaps, {DIST}, {r('ac')} AS average_confidence,
        {r('wc / n')} AS words_per_segment, {r('gc / n')} AS gaps_per_segment, {r('gm')} AS global_mean, {r('gv')} AS global_variance, {r('sqrt(gv)')} AS global_std FROM distribution""",
    "timing_buckets": f"""SELECT recording_id, bucket_index, start_ms, end_ms, word_count, {r('wps')} AS words_per_second, {r('speech_ms / 1000.0')} AS total_speech_time,
        {r('(end_ms - start_ms - speech_ms) / 1000.0')} AS total_silence_time, {r('confidence')} AS confidence, gap_count AS word_gap_count, {r('m')} AS word_gap_mean,
        {r('v')} AS word_gap_var, gap_sum, gap_squares FROM old_t""",
    "gap_lists": """SELECT recording_id, bucket_index, sort_ms // 300000 AS part_no, array_to_string(list(gap_ms ORDER BY rn), '|') AS gaps_ms FROM old_bucketed WHERE gap_ms IS NOT NULL GROUP BY 1, 2, 3""",
    "first_gaps": """SELECT recording_id, bucket_index, array_to_string(list(gap_ms ORDER BY rn)[1:20], '|') AS gaps_ms FROM old_bucketed WHERE gap_ms IS NOT NULL GROUP BY 1, 2""",
    "bucket_text_parts": "SELECT recording_id, bucket_index, sort_ms // 300000 AS part_no, string_agg(word, ' ' ORDER BY rn) AS text FROM old_bucketed GROUP BY 1, 2, 3",
    "global_cadence": f"""SELECT recording_id, {r('gm')} AS global_gap_mean, {r('gs')} AS global_gap_std, total_words, gap_count AS total_gaps, bucket_count, 1.5 AS anomaly_threshold,
        {', '.join(f"{r(f'p{p}')} AS p{p}" for p in PCTS)}, summary AS cadence_summary FROM old_gs""",
    "flag_anomalies": f"SELECT recording_id, bucket_index, severity <> 'normal' AS cadence_anomaly, severity AS cadence_severity, {r('dev')} AS gap_deviation_from_global FROM old_f",
    "flag_anomalies_tight": "SELECT recording_id, bucket_index, severity <> 'normal' AS cadence_anomaly, severity AS cadence_severity FROM tight_f",
    "cadence_analysis": f"""SELECT recording_id, {r('gm')} AS global_gap_mean, {r('gs')} AS global_gap_std, total_words, gap_count AS total_gaps, bucket_count, 1.5 AS anomaly_threshold,
        {', '.join(f"{r(f'p{p}')} AS p{p}" for p in PCTS)}, summary AS cadence_summary, odd AS anomalous_buckets FROM old_a""",
    "text_issues": f"""SELECT recording_id, segment_id, array_to_string({ISSUES}, '|') AS text_issues, {r('CASE WHEN n > 0 THEN fc / n ELSE 0.0 END')} AS filler_ratio, iw AS incomplete_words,
        up AS unusual_punctuation, n AS word_count, im AS incoherent_matches FROM feat""",
    "text_issues_documents": f"""SELECT doc_id, array_to_string({ISSUES}, '|') AS text_issues, {r('CASE WHEN n > 0 THEN fc / n ELSE 0.0 END')} AS filler_ratio, iw AS incomplete_words,
        up AS unusual_punctuation, n AS word_count, im AS incoherent_matches FROM ({_text_features("documents", "doc_id")})""",
    "segment_uncertainty": """SELECT recording_id, segment_id, start_ms, end_ms, trim(text) AS text, avg_logprob AS confidence_score, level AS uncertainty_level,
        array_to_string(reasons, '|') AS uncertainty_reasons, review AS suggested_review FROM unc""",
    "flag_uncertain": "SELECT recording_id, segment_id, avg_logprob AS confidence_score FROM unc WHERE avg_logprob < -1.0 OR level = 'high' OR len(reasons) >= 2",
    "confidence_stats": f"""SELECT recording_id, segment_count, {r('mean')} AS mean_confidence, {r('sd')} AS std_confidence, mn AS min_confidence, mx AS max_confidence, b.* EXCLUDE (recording_id),
        {r('med')} AS median_confidence FROM cstats JOIN (SELECT recording_id, count(*) FILTER (avg_logprob < -2) AS very_low_bin, count(*) FILTER (avg_logprob >= -2 AND avg_logprob < -1) AS low_bin,
        count(*) FILTER (avg_logprob >= -1 AND avg_logprob < -0.5) AS medium_bin, count(*) FILTER (avg_logprob >= -0.5 AND avg_logprob <= 0) AS high_bin,
        count(*) FILTER (avg_logprob < -1.5) AS low_confidence_count, count(*) FILTER (avg_logprob >= -1.5 AND avg_logprob < -0.5) AS medium_confidence_count,
        count(*) FILTER (avg_logprob >= -0.5) AS high_confidence_count FROM segments GROUP BY 1) b USING (recording_id)""",
    "confidence_threshold": f"SELECT recording_id, {r('quantile_cont(avg_logprob, 0.1)')} AS threshold FROM segments GROUP BY 1",
    "temporal_consistency": f"SELECT recording_id, {r('tc')} AS temporal_consistency FROM temporal",
    "quality_metrics": f"""SELECT recording_id, n AS total_segments, flagged AS flagged_segments, {r('mean')} AS average_segment_confidence, {r('tc')} AS temporal_consistency,
        {r('rel')} AS transcription_reliability, {r('acc')} AS estimated_accuracy, {r('pr')} AS problematic_segments_ratio, {r('cons')} AS consistency_score, 1.0 AS language_consistency,
        {r('flagged / n * 100')} AS flagged_percentage, {r('q')} AS overall_quality_score FROM quality""",
    "issue_counts": "SELECT recording_id, reason, count(*) AS segments FROM (SELECT recording_id, unnest(reasons) AS reason FROM unc) GROUP BY 1, 2",
    "recommendations": "SELECT recording_id, array_to_string(a, '|') AS recommendations FROM advice",
    "analyze_uncertainty": f"""SELECT recording_id, {r('q')} AS overall_quality_score, {r('med')} AS median_confidence, {r('c.sd')} AS std_confidence, {r('flagged / n * 100')} AS flagged_percentage,
        array_to_string(a, '|') AS recommendations FROM quality JOIN advice USING (recording_id) JOIN cstats c USING (recording_id)""",
    "quality_report": f"SELECT recording_id, {r('q')} AS overall_quality_score, flagged AS flagged_segments, n AS total_segments, {r('flagged / n * 100')} AS flagged_percentage FROM quality",
    "quality_bands": """SELECT recording_id, segment_id, pos, CASE WHEN probability >= 0.95 THEN 'excellent' WHEN probability >= 0.85 THEN 'good' WHEN probability >= 0.7 THEN 'fair' ELSE 'poor' END
        AS quality_level, CASE WHEN probability > 0.7 THEN 'high' WHEN probability >= 0.3 THEN 'medium' ELSE 'low' END AS priority FROM clean""",
    "diarization": "SELECT * FROM turns",
    "detect_overlaps": "SELECT * FROM pairs",
    "dedupe_overlaps": "SELECT * FROM laps",
    "assign_speakers": "SELECT s.recording_id, s.segment_id, speaker FROM segments s LEFT JOIN who USING (recording_id, segment_id)",
    "attach_overlaps": "SELECT recording_id, segment_id, has_overlap, k AS overlap_count, l AS overlaps FROM labelled",
    "speaker_stats": f"""SELECT recording_id, speaker, {r('t / 1000.0')} AS total_duration, n AS segment_count, {r('t / n / 1000.0')} AS average_segment_duration,
        {r('t / total * 100')} AS speaking_percentage, {r('mx / 1000.0')} AS longest_segment, {r('mn / 1000.0')} AS shortest_segment,
        row_number() OVER (PARTITION BY recording_id ORDER BY t DESC, ft) AS rank FROM (SELECT recording_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS t, count(*) AS n,
        max(end_ms - start_ms) AS mx, min(end_ms - start_ms) AS mn, min(turn_no) AS ft FROM turns GROUP BY 1, 2) JOIN (SELECT recording_id, max(end_ms) AS total FROM turns GROUP BY 1) USING (recording_id)""",
    "diarization_summary": f"""SELECT recording_id, {r('total / 1000.0')} AS total_duration, spk AS speaker_count, n AS total_segments, k AS total_overlaps, {r('ms / 1000.0')} AS overlap_duration,
        {r('CASE WHEN total > 0 THEN ms * 100.0 / total ELSE 0.0 END')} AS overlap_percentage FROM dsum""",
    "speaker_report": f"SELECT recording_id, spk AS speaker_count, n AS total_segments, k AS total_overlaps, {r('total / 1000.0')} AS total_duration FROM dsum",
    "speaker_transcripts": """SELECT recording_id, coalesce(speaker, 'UNKNOWN') AS speaker, segment_id // 256 AS part_no,
        string_agg(text || CASE WHEN has_overlap THEN ' [OVERLAP]' ELSE '' END, ' ' ORDER BY start_ms, segment_id) AS transcript FROM labelled GROUP BY 1, 2, 3""",
    "conversation_mode": """SELECT recording_id, segment_id, CASE WHEN has_overlap THEN 'overlap' WHEN nr > 1 AND speaker IS DISTINCT FROM ps AND start_ms < pe THEN 'interruption'
        WHEN nr > 1 AND speaker IS DISTINCT FROM ps THEN 'dialogue' ELSE 'monologue' END AS mode FROM (SELECT *, lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe, row_number() OVER w AS nr
        FROM labelled WINDOW w AS (PARTITION BY recording_id ORDER BY segment_id))""",
    "enrich_segments": """SELECT s.recording_id, s.segment_id, coalesce(l.speaker, '') AS speaker, has_overlap, level AS uncertainty_level, CASE WHEN review THEN 'REVIEW_NEEDED' ELSE '' END AS quality_flag
        FROM segments s JOIN labelled l USING (recording_id, segment_id) JOIN unc u USING (recording_id, segment_id)""",
    "speech_from_words": "SELECT * FROM speech",
    "silence_from_speech": "SELECT * FROM silences",
    "speech_runs": """, cov AS (SELECT recording_id, idx, max(h % 9 + 1) AS e, max(h % 11 + 1) AS c FROM (SELECT recording_id, h,
          unnest(range(start_ms // 100, (end_ms - 1) // 100 + 1)) AS idx FROM clean WHERE end_ms > start_ms) GROUP BY 1, 2),
        fr AS (SELECT f.recording_id, f.idx, CAST(coalesce(e, 0) AS DOUBLE) AS e, CAST(coalesce(c, 0) AS DOUBLE) AS c FROM (SELECT recording_id,
          unnest(range(CAST(ceil(duration_ms / 100) AS BIGINT))) AS idx FROM durations) f LEFT JOIN cov USING (recording_id, idx)),
        lim AS (SELECT recording_id, quantile_cont(e, 0.3) AS le, quantile_cont(c, 0.4) AS lc FROM fr GROUP BY 1),
        on_ AS (SELECT recording_id, idx, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM fr JOIN lim USING (recording_id) WHERE e > le AND c > lc)
        SELECT recording_id, min(idx) * 100 AS start_ms, (max(idx) + 1) * 100 AS end_ms FROM on_ GROUP BY recording_id, g""",
    "silence_removal_plan": """SELECT recording_id, start_ms - u AS start_ms, end_ms + u AS end_ms, u AS padding_ms FROM (SELECT *, CASE WHEN start_ms > p THEN p ELSE 0 END AS u FROM
        (SELECT s.*, least(100, start_ms, duration_ms - end_ms) AS p FROM speech s JOIN durations USING (recording_id)))""",
    "chunking_totals": f"""SELECT recording_id, {r('duration_ms / 1000.0')} AS total_duration, {r('(duration_ms - kept) / 1000.0')} AS silence_removed, {r('kept / duration_ms')} AS compression_ratio FROM
        (SELECT recording_id, duration_ms, CAST(sum(end_ms - start_ms + CASE WHEN start_ms > p THEN 2 * p ELSE 0 END) AS BIGINT) AS kept FROM
        (SELECT s.*, duration_ms, least(100, start_ms, duration_ms - end_ms) AS p FROM speech s JOIN durations USING (recording_id)) GROUP BY 1, 2)""",
    "time_splits": f"SELECT recording_id, split_no, {r('place / 1000.0')} AS split_s, duration_ms FROM splits",
    "silence_splits": f"SELECT recording_id, n AS split_no, {r('split2 / 2000.0')} AS split_s, duration_ms FROM sil",
    "silence_splits_short": f"SELECT recording_id, n AS split_no, {r('split2 / 2000.0')} AS split_s, duration_ms FROM sil_short",
    "build_chunks": f"""SELECT recording_id, chunk_id, {r('start_time')} AS start_time, {r('end_time')} AS end_time, {r('duration')} AS duration,
        printf('chunk_%03d_%.1fs-%.1fs.wav', chunk_id, original_start, original_end) AS file_path, {r('original_start')} AS original_start, {r('original_end')} AS original_end,
        true AS has_speech, 1.0 AS confidence, {r('overlap_prev')} AS overlap_prev, {r('overlap_next')} AS overlap_next FROM chunks""",
    "build_chunks_at_silences": f"""SELECT recording_id, chunk_id, {r('start_time')} AS start_time, {r('end_time')} AS end_time, {r('duration')} AS duration, {r('original_start')} AS original_start,
        {r('original_end')} AS original_end, true AS has_speech, 1.0 AS confidence, {r('overlap_prev')} AS overlap_prev, {r('overlap_next')} AS overlap_next FROM sil_chunks""",
    "stream_chunks": """SELECT recording_id, i * 5 AS chunk_id, CAST(i * 5 - b AS DOUBLE) AS start_time, CAST(i * 5 + 5 AS DOUBLE) AS end_time, CAST(5 + b AS DOUBLE) AS duration,
        CAST(i * 5 AS DOUBLE) AS original_start, CAST(i * 5 + 5 AS DOUBLE) AS original_end, CAST(b AS DOUBLE) AS overlap_prev, 0.0 AS overlap_next FROM
        (SELECT recording_id, i, CASE WHEN i > 0 THEN 1 ELSE 0 END AS b FROM (SELECT recording_id, unnest(range(CAST(ceil(duration_ms / 5000) AS BIGINT))) AS i FROM durations))""",
    **{
        q: f"""SELECT recording_id, chunk_no, printf('chunk_%04d', chunk_no) AS chunk_name, {r('greatest(0, begin_ms - 1500) / 1000.0')} AS start_time,
        {r('least(duration_ms, pos + 1500) / 1000.0')} AS end_time, {r('(pos - begin_ms + 3000) / 1000.0')} AS duration, share > 0.1 AS has_speech, 1.5 AS silence_padding,
        CAST(floor(share * 100) AS INT) AS priority FROM {src}"""
        for q, src in (("vad_chunks", "vad"), ("vad_chunks_sliced", "vad_short"))
    },
    "prioritised_chunks": """SELECT recording_id, chunk_no, CAST(floor(share * 100) AS INT) AS priority,
        row_number() OVER (PARTITION BY recording_id ORDER BY floor(share * 100) DESC, chunk_no) - 1 AS work_order FROM vad""",
    "nearest_silence": f"""SELECT p.recording_id, p.place AS target_ms, {r('arg_min(s.start_ms + s.end_ms, abs(s.start_ms + s.end_ms - 2 * p.place) * 100000000 + s.start_ms) / 2.0')} AS split_ms
        FROM splits p JOIN silences s ON s.recording_id = p.recording_id AND s.start_ms BETWEEN p.place - 5000 AND p.place + 5000 GROUP BY 1, 2""",
    "offset_segments": "SELECT recording_id, chunk_id, segment_id, start_ms, end_ms, text, avg_logprob, no_speech_prob FROM heard",
    "offset_segments_by_core": """SELECT recording_id, chunk_id, segment_id, rs + CAST(round(original_start * 1000) AS BIGINT) AS start_ms,
        re + CAST(round(original_start * 1000) AS BIGINT) AS end_ms FROM heard""",
    "rescale_time": "SELECT recording_id, chunk_id, segment_id, CAST(floor(rs * 1.75 + 0.5) AS BIGINT) AS start_ms, CAST(floor(re * 1.75 + 0.5) AS BIGINT) AS end_ms FROM heard",
    "keep_core_segments": "SELECT recording_id, chunk_id, segment_id, start_ms, end_ms FROM core",
    "renumber": """SELECT recording_id, chunk_id, segment_id AS chunk_segment_id, row_number() OVER (PARTITION BY recording_id ORDER BY chunk_id, segment_id) - 1 AS segment_id FROM core""",
    "union_chunk_results": "SELECT recording_id, chunk_id, count(*) AS segments, CAST(sum(start_ms) AS BIGINT) AS start_sum FROM heard GROUP BY 1, 2",
    "merge_chunks": rf"""SELECT r.recording_id, coalesce(k, 0) AS segment_count, language, {r('lp')} AS language_probability, {r('duration_ms / 1000.0')} AS duration,
        {r('coalesce(conf, -5.0)')} AS avg_confidence, {r('pt')} AS processing_time, coalesce(wc, 0) AS word_count, chunk_count FROM
        (SELECT recording_id, arg_min(language, chunk_id) AS language, {mean('lp')} AS lp, sum(pt) AS pt, count(*) AS chunk_count FROM runs GROUP BY 1) r
        LEFT JOIN (SELECT recording_id, count(*) AS k, {mean('avg_logprob')} AS conf, CAST(sum(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''))) AS BIGINT) AS wc
          FROM core GROUP BY 1) USING (recording_id) JOIN durations USING (recording_id)""",
    "merged_text": "SELECT recording_id, chunk_id // 64 AS part_no, string_agg(text, ' ' ORDER BY chunk_id, segment_id) AS text FROM core GROUP BY 1, 2",
    "run_metrics": rf"""SELECT recording_id, {r('duration_ms / 1000.0')} AS total_audio_duration, {r('pt')} AS total_processing_time, {r('pt / 2 + 1')} AS wall_clock_time,
        {r('duration_ms / 1000.0 / pt')} AS processing_speed, n AS chunks_processed, {r('pt / n')} AS avg_chunk_processing_time, {r('d')} AS avg_chunk_duration, {r('a')} AS avg_confidence,
        {r('mn')} AS min_confidence, {r('mx')} AS max_confidence, {r('pt / (pt / 2 + 1)')} AS parallel_efficiency, {r('wc / (duration_ms / 1000.0 / 60.0)')} AS words_per_minute FROM
        (SELECT recording_id, sum(pt) AS pt, count(*) AS n, {mean('duration')} AS d, {mean('ac')} AS a, min(ac) AS mn, max(ac) AS mx FROM runs GROUP BY 1) JOIN durations USING (recording_id)
        JOIN (SELECT recording_id, CAST(sum(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''))) AS BIGINT) AS wc FROM segments GROUP BY 1) USING (recording_id)""",
    "chunking_stats": f"""SELECT recording_id, n AS total_chunks, {r('duration_ms / 1000.0')} AS total_duration, {r('a')} AS average_chunk_duration, {r('mn')} AS min_chunk_duration, {r('mx')} AS max_chunk_duration,
        {r('sd')} AS std_chunk_duration, {r('n / (duration_ms / 1000.0 / 60.0)')} AS chunks_per_minute,
        {r('CASE WHEN n < 2 THEN 1.0 WHEN so IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - so / 5.0)) END')} AS overlap_efficiency, {r('core / (duration_ms / 1000.0)')} AS core_coverage FROM
        (SELECT recording_id, count(*) AS n, {mean('duration')} AS a, min(duration) AS mn, max(duration) AS mx, stddev_pop(duration) AS sd, sum(original_end - original_start) AS core FROM chunks GROUP BY 1)
        LEFT JOIN (SELECT recording_id, stddev_pop(o) AS so FROM (SELECT recording_id, unnest([overlap_prev, overlap_next]) AS o FROM chunks) WHERE o > 0 GROUP BY 1) USING (recording_id)
        JOIN durations USING (recording_id)""",
    "lowest_confidence": "SELECT recording_id, segment_id, avg_logprob FROM picked",
    "lowest_confidence_10": "SELECT recording_id, segment_id, avg_logprob, rank FROM picked WHERE rank <= 10",
    "expand_context": """SELECT recording_id, segment_id, start_ms, end_ms, xs AS expanded_start_ms, xe AS expanded_end_ms, start_ms - xs AS overlap_before_ms, xe - end_ms AS overlap_after_ms FROM wide""",
    "match_target": f"""SELECT recording_id, segment_id, no AS result_no, a AS result_start_ms, b AS result_end_ms, t AS text, {r('lp')} AS avg_logprob, {r('ns')} AS no_speech_prob FROM hit""",
    "map_back": f"SELECT recording_id, segment_id, start_ms, end_ms, text, {r('avg_logprob')} AS avg_logprob, {r('no_speech_prob')} AS no_speech_prob FROM back",
    "apply_reprocessed": f"SELECT recording_id, segment_id, start_ms, end_ms, text, {r('avg_logprob')} AS avg_logprob, {r('no_speech_prob')} AS no_speech_prob, reprocessed, original_confidence FROM final",
    "apply_reprocessed_if_better": f"""SELECT recording_id, segment_id, better AS reprocessed, {r('CASE WHEN better THEN lp ELSE o END')} AS avg_logprob, {r('o')} AS original_confidence FROM
        (SELECT s.recording_id, s.segment_id, s.avg_logprob AS o, b.avg_logprob - CASE WHEN s.segment_id % 2 = 0 THEN 1 ELSE 0 END AS lp,
         coalesce(b.avg_logprob - CASE WHEN s.segment_id % 2 = 0 THEN 1 ELSE 0 END > s.avg_logprob, false) AS better FROM segments s LEFT JOIN back b USING (recording_id, segment_id))""",
    "confidence_delta": f"SELECT recording_id, segment_id, reprocessed, {r('avg_logprob - original_confidence')} AS improvement FROM final",
    "reprocess_report": f"""SELECT recording_id, n AS total_segments, k AS reprocessed_segments, {r('g')} AS average_confidence_improvement, {r('mx')} AS max_confidence_improvement,
        {r('k / n')} AS reprocessing_rate, -0.5 AS confidence_threshold_used, 0.7 AS slow_speed_multiplier, 2.0 AS context_padding_seconds FROM report""",
    "reprocess_with_model": f"SELECT recording_id, segment_id, start_ms, end_ms, text, {r('avg_logprob')} AS avg_logprob, {r('no_speech_prob')} AS no_speech_prob, reprocessed, original_confidence, CAST(NULL AS VARCHAR) AS error FROM final",
    "map_chunks_failures": "SELECT recording_id, count(*) FILTER (role <> 'system') AS succeeded, count(*) FILTER (role = 'system') AS failed FROM conv GROUP BY 1",
    "map_recordings": "SELECT recording_id, 0 AS turn_no, 'A' AS speaker, 0 AS start_ms, duration_ms AS end_ms, CAST(NULL AS VARCHAR) AS error FROM durations",
    "srt_plain": srt_lines("segments", "segment_id", "text"),
    "srt_speaker": srt_lines("labelled", "segment_id", f"{LABEL} || text || {flag('has_overlap', '[OVERLAP]')}"),
    "srt_advanced": srt_lines("labelled", "segment_id", f"{LABEL} || text || {flag('has_overlap', '[OVERLAP]')} || {flag('avg_logprob < -1.0', '[LOW_CONF]')}"),
    "srt_confidence": srt_lines("final", "segment_id", "trim(text) || CASE WHEN reprocessed THEN ' [ENHANCED]' WHEN avg_logprob < -0.5 THEN ' [LOW_CONF]' ELSE '' END"),
    "srt_timing": srt_lines(
        "timing",
        "bucket_index",
        "text || CASE WHEN anomaly THEN ' [' || upper(severity) || '_CADENCE]' ELSE '' END || "
        + flag("coalesce(speaker_overlap, false)", "[OVERLAP]")
        + " || "
        + flag("confidence < 0.5", "[LOW_CONF]"),
    ),
    "txt_timestamped": lines("labelled", 0, "segment_id", f"'[' || {mmss('start_ms')} || '] ' || {LABEL} || text"),
    "txt_paragraph": lines("segments", 1, "segment_id", "trim(text)"),
    "txt_confidence": _union(
        lines(
            "report", 0, "0", "'# Transcription with Confidence Enhancement'", "'# Total segments: ' || n", "'# Enhanced segments: ' || k",
            f"'# Enhancement rate: ' || {fx('k / n * 100', 1)} || '%'", "''",
        ),
        lines("final", 1, "segment_id", "trim(text)"),
    ),
    "csv_segment": f"""SELECT recording_id, segment_id, {r('start_ms / 1000.0')} AS start_time, {r('end_ms / 1000.0')} AS end_time, {r('(end_ms - start_ms) / 1000.0')} AS duration, text,
        avg_logprob AS confidence, coalesce(speaker, '') AS speaker, has_overlap FROM labelled""",
    "csv_analysis": f"""SELECT l.recording_id, l.segment_id, {r('l.start_ms / 1000.0')} AS start_time, {r('l.end_ms / 1000.0')} AS end_time, {r('(l.end_ms - l.start_ms) / 1000.0')} AS duration, l.text,
        l.avg_logprob AS confidence, l.no_speech_prob, coalesce(speaker, '') AS speaker, has_overlap, level AS uncertainty_level, CASE WHEN review THEN 'REVIEW_NEEDED' ELSE '' END AS quality_flag
        FROM labelled l JOIN unc USING (recording_id, segment_id)""",
    "csv_timing": f"""SELECT recording_id, bucket_index AS bucket_id, {r('start_ms / 1000.0')} AS start_time, {r('end_ms / 1000.0')} AS end_time, {r('(end_ms - start_ms) / 1000.0')} AS duration, text,
        word_count, {r('confidence')} AS confidence, speaker_overlap, gap_count AS word_gap_count, {r('m')} AS word_gap_mean, {r('v')} AS word_gap_var, {r('wps')} AS words_per_second,
        {r('speech_ms / 1000.0')} AS speech_time, {r('(end_ms - start_ms - speech_ms) / 1000.0')} AS silence_time, anomaly AS cadence_anomaly, severity AS cadence_severity,
        {r('dev')} AS gap_deviation_from_global FROM timing""",
    "csv_uncertainty": f"""SELECT recording_id, segment_id, {r('start_ms / 1000.0')} AS start_time, {r('end_ms / 1000.0')} AS end_time, trim(text) AS text, avg_logprob AS confidence_score,
        level AS uncertainty_level, array_to_string(reasons, '; ') AS uncertainty_reasons, review AS suggested_review FROM unc""",
    "json_segment_lines": _union(
        lines(
            "durations", 0, "0",
            "'{\"recording_id\":' || recording_id || ',\"metadata\":{\"version\":\"0.1.0\",\"format\":\"Transcript JSON v1.0\"},\"transcription\":{\"language\":\"en\",\"duration\":' "
            "|| CAST(CAST(duration_ms / 1000.0 AS DOUBLE) AS VARCHAR) || '},\"segments\":['",
        ),
        lines(
            "(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id) - 1 AS no FROM segments)", 1, "no",
            "CASE WHEN no = 0 THEN '' ELSE ',' END || '{\"id\":' || segment_id || ',\"start\":' || CAST(CAST(start_ms / 1000.0 AS DOUBLE) AS VARCHAR) || ',\"end\":' "
            "|| CAST(CAST(end_ms / 1000.0 AS DOUBLE) AS VARCHAR) || ',\"text\":' || CAST(to_json(text) AS VARCHAR) || ',\"avg_logprob\":' || CAST(CAST(avg_logprob AS DOUBLE) AS VARCHAR) "
            "|| ',\"no_speech_prob\":' || CAST(CAST(no_speech_prob AS DOUBLE) AS VARCHAR) || '}'",
        ),
        lines("durations", 2, "0", "']}'"),
    ),
    "json_segment": f"""SELECT recording_id, segment_id, {r('start_ms / 1000.0')} AS start, {r('end_ms / 1000.0')} AS "end", text, avg_logprob, no_speech_prob FROM segments""",
    "json_advanced": f"""SELECT l.recording_id, spk AS speaker_count, d.k AS overlaps_detected, segment_id AS id, {r('start_ms / 1000.0')} AS start, speaker, has_overlap
        FROM labelled l JOIN dsum d USING (recording_id)""",
    "json_orchestrator": f"""SELECT f.recording_id, k AS reprocessed_segments, segment_id AS id, {r('end_ms / 1000.0')} AS "end", reprocessed, original_confidence
        FROM final f JOIN report USING (recording_id)""",
    "json_enhanced": f"""SELECT x.recording_id, wc AS total_words, bucket_index, {r('end_ms / 1000.0')} AS end_time, gap_count AS word_gap_count, cadence, speaker_overlap
        FROM records x JOIN distribution USING (recording_id)""",
    "json_timing": f"""SELECT recording_id, bucket_index AS bucket_id, {r('start_ms / 1000.0')} AS start_ts, {r('end_ms / 1000.0')} AS end_ts, text, word_count, word_count AS listed_words,
        gap_count AS word_gap_count, {r('m')} AS word_gap_mean, {r('confidence')} AS confidence, speaker_overlap, severity AS cadence_severity FROM timing""",
    "json_chunks": f"""SELECT recording_id, chunk_id, {r('start_time')} AS start_time, {r('end_time')} AS end_time, {r('duration')} AS duration,
        printf('chunk_%03d_%.1fs-%.1fs.wav', chunk_id, original_start, original_end) AS file_path, {r('original_start')} AS original_start, {r('original_end')} AS original_end,
        {r('overlap_prev')} AS overlap_prev, {r('overlap_next')} AS overlap_next, true AS has_speech, 1.0 AS confidence FROM chunks""",
    "json_diarization": f"""SELECT t.recording_id, spk AS speaker_count, speaker AS speaker_id, {r('start_ms / 1000.0')} AS start_time, {r('end_ms / 1000.0')} AS end_time,
        {r('(end_ms - start_ms) / 1000.0')} AS duration FROM turns t JOIN dsum USING (recording_id)""",
    "json_uncertainty": """SELECT u.recording_id, flagged AS flagged_segments, segment_id, level AS uncertainty_level, array_to_string(reasons, '|') AS uncertainty_reasons, review AS suggested_review
        FROM unc u JOIN quality USING (recording_id)""",
    "rttm_lines": lines(
        "turns", 0, "turn_no",
        "'SPEAKER recording_' || recording_id || ' 1 ' || printf('%d.%03d', start_ms // 1000, start_ms % 1000) || ' ' || "
        "printf('%d.%03d', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || ' <NA> <NA> ' || speaker || ' <NA> <NA>'",
    ),
    "rttm_read_back": "SELECT 'recording_' || recording_id AS stem, speaker, start_ms, end_ms FROM turns",
    "bucket_markdown": _union(
        lines(
            "distribution", 0, "0", "'# Enhanced Transcription'", "''", "'## Processing Summary'", "''", f"'**Total Duration:** ' || {fx('ms / 1000.0', 1)} || ' seconds  '",
            "'**Total Words:** ' || wc || '  '", "'**Total Word Gaps:** ' || gc || '  '", "'**Timing Buckets:** ' || n || ' (4-second windows)  '",
            "'**Analysis Method:** Population variance with ±1.5σ cadence thresholds  '", "''", "'## Enhanced Transcript'", "''",
            "'*Each section represents a ~4-second timing window with comprehensive word-gap analysis.*'", "''",
        ),
        lines(
            "records", 1, "bucket_index", f"(bucket_index + 1) || '. **[' || {mmss('start_ms')} || '–' || {mmss('end_ms')} || ']** ' || text",
            f"'<sub>confidence ' || {fx('confidence', 2)} || '</sub>'", "'<sub>speaker_overlap ' || speaker_overlap || '</sub>'", "'<sub>word_gap_count ' || gap_count || '</sub>'",
            f"'<sub>word_gaps ' || coalesce(array_to_string(list_transform(gaps, lambda g: {fx('g / 1000.0', 4)}), ', '), '') || '</sub>'",
            f"'<sub>word_gap_mean ' || {fx('m', 4)} || '</sub>'", f"'<sub>word_gap_var ' || {fx('v', 6)} || '</sub>'", "'<sub>cadence ' || cadence || '</sub>'", "''",
        ),
        lines(
            "distribution", 2, "0", "'## Analysis Summary'", "''", "'### Cadence Distribution'", "''",
            *[f"'- **{n}:** ' || {c} || ' segments (' || {fx(f'{c} / n * 100', 1)} || '%)  '" for n, c in (("Slow", "slow_count"), ("Normal", "normal_count"), ("Fast", "fast_count"))],
            "''", "'### Speaker Overlap Analysis'", "''",
            *[
                f"'- **{n}:** ' || {c} || ' segments (' || {fx(f'{c} / n * 100', 1)} || '%)  '"
                for n, c in (("Overlap", "overlap_count"), ("Single", "single_count"), ("Unknown Check Pyannote", "unknown_count"))
            ],
            "''", "'### Quality Metrics'", "''", f"'- **Average Confidence:** ' || {fx('ac', 3)} || '  '", f"'- **Words per Segment:** ' || {fx('wc / n', 1)} || '  '",
            f"'- **Gaps per Segment:** ' || {fx('gc / n', 1)} || '  '", "''",
            *[
                f"CASE WHEN gc > 0 THEN {e} END"
                for e in (
                    "'### Global Gap Statistics'", "''", "'- **Total Gaps Analyzed:** ' || gc || '  '", f"'- **Global Mean:** ' || {fx('gm', 4)} || 's  '",
                    f"'- **Global Variance:** ' || {fx('gv', 6)} || '  '", f"'- **Global Std Dev:** ' || {fx('sqrt(gv)', 4)} || 's  '",
                    f"'- **Cadence Thresholds:** Fast < ' || {fx('gm - 1.5 * sqrt(gv)', 3)} || 's, Slow > ' || {fx('gm + 1.5 * sqrt(gv)', 3)} || 's  '",
                )
            ],
        ),
    ),
    "validate_report": """SELECT recording_id, true AS has_title, true AS has_transcript, true AS has_summary, true AS has_cadence_info, true AS has_gap_info, true AS valid,
        n AS section_count FROM distribution""",
    "timing_markdown": _union(
        lines(
            "new_a", 0, "0", "'# Enhanced Transcription with Timing Analysis'", "''", "'**Timing Buckets:** ' || bucket_count || '  '", "'**Total Words:** ' || total_words || '  '",
            "'**Total Gaps:** ' || gap_count || '  '", "'**Cadence Summary:** ' || summary || '  '",
            f"CASE WHEN odd > 0 THEN '**Anomalous Buckets:** ' || odd || '/' || bucket_count || ' (' || {fx('odd / bucket_count * 100', 1)} || '%)  ' END", "''", "'## Cadence Statistics'", "''",
            f"'- **Global Gap Mean:** ' || {fx('gm', 3)} || 's  '", f"'- **Global Gap Std:** ' || {fx('gs', 3)} || 's  '", "'- **Anomaly Threshold:** 1.5x standard deviation  '", "''",
            "'### Gap Distribution Percentiles'", "''", *[f"'- **P{p}:** ' || {fx(f'p{p}', 3)} || 's  '" for p in PCTS], "''", "'## Detailed Transcript with Timing Analysis'", "''",
        ),
        f"""SELECT recording_id, 1 AS section, bucket_index * 2 AS item, CAST(part - min(part) OVER (PARTITION BY recording_id, bucket_index) AS INT) AS sub,
        CASE WHEN part = min(part) OVER (PARTITION BY recording_id, bucket_index) THEN (bucket_index + 1) || '. **[' || {mmss_ms('start_ms')} || '–' || {mmss_ms('end_ms')} || ']** ' ELSE '    ' END
        || words || '  ' AS line FROM (SELECT t.recording_id, t.bucket_index, t.start_ms, t.end_ms, sort_ms // 300000 AS part, string_agg(word, ' ' ORDER BY rn) AS words
        FROM bucketed w JOIN timing t USING (recording_id, bucket_index) GROUP BY ALL)""",
        lines(
            "timing", 1, "bucket_index * 2 + 1", f"'    <sub>confidence ' || {fx('confidence', 2)} || '</sub>  '",
            "'    <sub>speaker_overlap ' || coalesce(CAST(speaker_overlap AS VARCHAR), 'unknown') || '</sub>  '", "'    <sub>word_gap_count ' || gap_count || '</sub>  '",
            f"CASE WHEN gap_count > 0 THEN '    <sub>word_gaps ' || array_to_string(list_transform(gaps, lambda g: {fx('g / 1000.0', 4)}), ',') || '</sub>  ' END",
            f"'    <sub>word_gap_mean ' || {fx('m', 4)} || '</sub>  '", f"'    <sub>word_gap_var ' || {fx('v', 6)} || '</sub>  '", "''",
        ),
    ),
    "cadence_report": _union(
        lines(
            "new_a", 0, "0", "'# Cadence Analysis Report'", "''", "'**Analysis Summary:** ' || summary || '  '", "''", "'## Global Statistics'", "''",
            "'- **Total Words:** ' || format('{:,}', total_words) || '  '", "'- **Total Word Gaps:** ' || format('{:,}', gap_count) || '  '",
            f"'- **Global Gap Mean:** ' || {fx('gm', 4)} || 's  '", f"'- **Global Gap Std:** ' || {fx('gs', 4)} || 's  '", "'- **Anomaly Threshold:** 1.5x std deviation  '",
            f"'- **Anomalous Buckets:** ' || odd || '/' || bucket_count || ' (' || {fx('odd / bucket_count * 100', 1)} || '%)  '", "''", "'## Gap Distribution'", "''",
            "'| Percentile | Gap Duration |'", "'|------------|-------------|'", *[f"'| P{p} | ' || {fx(f'p{p}', 4)} || 's |'" for p in PCTS], "''",
            *[
                f"CASE WHEN odd > 0 THEN {e} END"
                for e in ("'## Anomalous Cadence Segments'", "''", "'| Time Range | Severity | Gap Mean | Gap Var | Deviation |'", "'|------------|----------|----------|---------|----------|'")
            ],
        ),
        lines(
            "(SELECT * FROM timing WHERE anomaly)", 1, "bucket_index",
            f"'| ' || {mmss_ms('start_ms')} || '–' || {mmss_ms('end_ms')} || ' | ' || severity || ' | ' || {fx('m', 4)} || 's | ' || {fx('v', 6)} || ' | ' || {fx('dev', 4)} || 's |'",
        ),
        lines(
            "new_a", 2, "0", "CASE WHEN odd > 0 THEN '' END", "'## Recommendations'", "''",
            "CASE WHEN odd = 0 THEN '✅ **Excellent cadence consistency** - No anomalous segments detected.  ' "
            "WHEN odd / bucket_count < 0.1 THEN '✅ **Good cadence consistency** - Only minor anomalies detected.  ' "
            "WHEN odd / bucket_count < 0.3 THEN '⚠️ **Moderate cadence variation** - Consider reviewing flagged segments.  ' "
            "ELSE '🔴 **High cadence variation** - Significant pacing inconsistencies detected.  ' END",
            "CASE WHEN gm > 0.3 THEN '- Consider speech coaching for faster delivery  ' WHEN gm < 0.05 THEN '- Consider slowing down for better clarity  ' END",
            "CASE WHEN gs > 0.1 THEN '- Work on consistent pacing throughout speech  ' END",
        ),
    ),
    "quality_report_text": _union(
        "SELECT recording_id, 0 AS section, 0 AS item, CAST(unnest(range(len(ls))) AS INT) AS sub, unnest(ls) AS line FROM (SELECT recording_id, "
        f"['Uncertainty Analysis Report', '========================================', '', 'Overall Quality Score: ' || {fx('q', 2)}, "
        f"'Flagged Segments: ' || flagged || '/' || n || ' (' || {fx('flagged / n * 100', 1)} || '%)', 'Average Confidence: ' || {fx('mean', 2)}, '', 'Recommendations:'] "
        "|| list_transform(a, lambda x, i: i || '. ' || x) || ['', 'Flagged Segments:', '--------------------'] AS ls FROM quality JOIN advice USING (recording_id))",
        lines(
            "(SELECT * FROM unc WHERE review)", 1, "segment_id", "''",
            f"'Segment ' || segment_id || ' (' || {fx('start_ms / 1000.0', 1)} || 's - ' || {fx('end_ms / 1000.0', 1)} || 's)'", "'Text: ' || trim(text)",
            f"'Confidence: ' || {fx('avg_logprob', 2)}", "'Issues: ' || array_to_string(reasons, ', ')",
        ),
    ),
    "reprocess_report_markdown": lines(
        "report", 0, "0", "'# Confidence Enhancement Report'", "''", "'**Job ID:** ' || recording_id || '  '", "'**Processing Speed:** 1.75x  '", "'**Enhancement Enabled:** True  '", "''",
        "'## Enhancement Results'", "''", "'- **Total Segments:** ' || n || '  '", "'- **Enhanced Segments:** ' || k || '  '", f"'- **Enhancement Rate:** ' || {fx('k / n * 100', 1)} || '%  '",
        f"'- **Average Confidence Improvement:** ' || {fx('g', 3)} || '  '", f"'- **Maximum Improvement:** ' || {fx('mx', 3)} || '  '", "''", "'## Processing Parameters'", "''",
        "'- **Confidence Threshold:** -0.5  '", "'- **Enhancement Speed:** 0.7x  '", "'- **Context Padding:** 2.0s  '", "''",
        "CASE WHEN k = 0 THEN '✅ **All segments had acceptable confidence - no enhancement needed.**  ' WHEN g > 0.1 THEN '✅ **Significant quality improvements achieved!**  ' "
        "WHEN g > 0.05 THEN '✅ **Moderate quality improvements achieved.**  ' ELSE 'ℹ️ **Minor quality improvements achieved.**  ' END",
    ),
    "speaker_markdown": _union(
        lines(
            "quality", 0, "0", "'# Advanced Transcription Report'", "''", "'**Language:** en  '", "'**Segments:** ' || n", "''", f"'**Quality Score:** ' || {fx('q', 2)} || '  '",
            "'**Flagged Segments:** ' || flagged", "''", "'## Transcript'", "''",
        ),
        lines(
            "(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id) AS cue FROM labelled)", 1, "cue",
            f"cue || '. **[' || {fx('start_ms / 1000.0', 2)} || '–' || {fx('end_ms / 1000.0', 2)} || ']** ' || CASE WHEN coalesce(speaker, '') <> '' THEN '**[' || speaker || ']** ' ELSE '' END || text || "
            "CASE WHEN has_overlap THEN ' ⚠️ OVERLAP' ELSE '' END || CASE WHEN avg_logprob < -1.0 THEN ' 🔍 LOW_CONF' ELSE '' END || '  '",
            f"'    <sub>confidence ' || {fx('avg_logprob', 2)} || '</sub>'", "''",
        ),
    ),
    "time_formats": f"""SELECT recording_id, segment_id, {srt('start_ms')} AS srt, {mmss('start_ms')} AS mmss, {mmss_ms('end_ms')} AS mmss_ms, {mmss('start_ms')} || '–' || {mmss('end_ms')} AS span,
        printf('%02d:%02d:%02d', start_ms * 1000 // 3600000 % 24, start_ms * 1000 // 60000 % 60, start_ms * 1000 // 1000 % 60) AS of_day FROM segments""",
    "warehouse_buckets": f"""SELECT CAST(recording_id AS VARCHAR) AS job_id, printf('bucket_%05d', bucket_index) AS bucket_id, text, CAST(word_count AS INT) AS word_count, coalesce(speaker_overlap, false) AS speaker_overlap,
        anomaly AS cadence_anomaly, CASE severity WHEN 'normal' THEN 'low' WHEN 'mild' THEN 'medium' WHEN 'moderate' THEN 'high' ELSE 'critical' END AS cadence_severity,
        {r('start_ms / 1000.0')} AS start_timestamp, {r('end_ms / 1000.0')} AS end_timestamp, {r('(end_ms - start_ms) / 1000.0')} AS duration, {hu('wps', 3)} AS words_per_second FROM timing""",
    "warehouse_checks": "SELECT CAST(recording_id AS VARCHAR) AS job_id, '' AS bucket_id, '' AS failed_check FROM timing WHERE confidence < 0 OR confidence > 1",
    "warehouse_jobs": f"""SELECT CAST(recording_id AS VARCHAR) AS job_id, 'recording_' || recording_id AS input_path, 'queued' AS status, 'large-v3' AS model_size, 'auto' AS language,
        1.75 AS speed_multiplier, false AS enhanced_analysis, false AS speaker_diarization, {r('duration_ms / 1000.0')} AS duration_seconds FROM durations""",
    "warehouse_words": f"""SELECT recording_id || '/' || printf('bucket_%05d', bucket_index) AS bucket_id,
        CAST(row_number() OVER (PARTITION BY recording_id, bucket_index ORDER BY rn) - 1 AS INT) AS word_index, word, {r('start_ms / 1000.0')} AS start_timestamp, {r('end_ms / 1000.0')} AS end_timestamp,
        {r('CAST(CAST(probability AS DECIMAL(4,3)) AS DOUBLE)')} AS probability, {r('(end_ms - start_ms) / 1000.0')} AS duration FROM bucketed""",
    "warehouse_cadence": f"""SELECT CAST(recording_id AS VARCHAR) AS job_id, {hu('gm', 6)} AS gap_mean, CAST(total_words AS INT) AS total_words, CAST(gap_count AS INT) AS total_gaps, 1.5 AS anomaly_threshold,
        CAST(odd AS INT) AS anomalous_buckets, {', '.join(f"{hu(f'p{p}', 6)} AS gap_p{p}" for p in (50, 75, 90, 95, 99))}, summary AS cadence_summary FROM new_a""",
    "warehouse_speakers": "SELECT CAST(recording_id AS VARCHAR) AS job_id, CAST(spk AS INT) AS speaker_count, CAST(k AS INT) AS overlaps_detected FROM dsum",
    "warehouse_metrics": f"""SELECT CAST(recording_id AS VARCHAR) AS job_id, CAST(count(*) AS INT) AS chunks_processed, 0 AS chunks_failed, {r('any_value(duration_ms) / 1000.0')} AS original_duration_seconds
        FROM runs JOIN durations USING (recording_id) GROUP BY recording_id""",
    "warehouse_violations": """SELECT CAST(recording_id AS VARCHAR) AS job_id, printf('bucket_%05d', bucket_index) AS bucket_id, 'reference' AS failed_check FROM timing WHERE recording_id % 3 = 0
        UNION ALL SELECT CAST(recording_id AS VARCHAR), 'bucket_00000', 'unique' FROM timing WHERE bucket_index = 0""",
    "job_status_summary": f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'queued' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
        CAST(o_orderkey % 3600 AS INT) AS processing_time_seconds, o_orderkey * 1000 AS file_size_bytes, {r('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)')} AS duration_seconds,
        coalesce(tb, 0) AS total_buckets, coalesce(ab, 0) AS anomalous_buckets, {r('ac')} AS avg_confidence, {r('(o_orderkey % 1000) / 1000.0')} AS gap_mean,
        'pace ' || (o_orderkey % 5) AS cadence_summary, {r('cost')} AS cost_estimate_usd FROM orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS tb, count(*) FILTER (l_returnflag = 'R') AS ab, floor(avg(CAST(l_discount AS DECIMAL(18,2))) * 1000000.0 + 0.5) / 1000000.0 AS ac,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "processing_performance": f"""SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS processing_date, count(*) AS jobs_processed, {r('avg(o_orderkey % 3600)')} AS avg_processing_time,
        {r('avg(n)')} AS avg_chunks_per_job, {r('avg(a - b)')} AS avg_time_saved, {r('CAST(sum(cost) AS DOUBLE)')} AS total_cost_usd, {r('avg(sp)')} AS avg_speed_multiplier FROM orders JOIN
        (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS a, sum(CAST(floor(l_quantity / 2) AS BIGINT)) AS b, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost,
         max(CAST(l_discount AS DECIMAL(18,2))) AS sp FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""",
    "file_stats": f"""SELECT l_suppkey AS batch_id, count(*) AS total_files, {r('sum(l_quantity)')} AS total_processing_time, {r('sum(l_quantity * 4)')} AS total_original_duration,
        {r('sum(l_quantity * 2 + l_linenumber)')} AS total_processed_duration, {r('sum(l_quantity * 2 + l_linenumber) / sum(l_quantity * 4)')} AS compression_ratio,
        {r('sum(l_quantity * 4) / sum(l_quantity)')} AS processing_speed, {r('sum(l_quantity) / count(*)')} AS average_processing_time,
        count(*) FILTER (l_returnflag IN ('R', 'A')) AS normalize, count(*) FILTER (l_returnflag = 'R') AS remove_silence FROM lineitem GROUP BY 1""",
    "batch_summary": """SELECT o_custkey % 50 AS batch_id, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS successful, count(*) FILTER (o_orderstatus = 'P') AS failed,
        CAST(sum(o_orderkey % 60) AS BIGINT) AS total_time FROM orders GROUP BY 1""",
    "stage_metrics": "SELECT CAST(l_orderkey AS VARCHAR) AS job_id, " + r("sum(l_quantity)") + " AS total_processing_time, "
    + ", ".join(
        f"{r(f'coalesce(sum(l_quantity) FILTER (l_linenumber % 4 = {i}), 0.0) * 100 / sum(l_quantity)')} AS {n}_percentage"
        for i, n in enumerate(("chunking", "transcription", "reprocessing", "output"))
    )
    + " FROM lineitem GROUP BY l_orderkey",
    "stage_outcomes": f"""SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) FILTER (l_returnflag = 'N') AS stages_completed, count(*) FILTER (l_returnflag = 'R') AS stages_failed,
        {r('sum(l_quantity)')} AS total_processing_time, 600.0 AS audio_duration, {r("count(*) FILTER (l_returnflag = 'N') / count(*) * 100")} AS success_rate,
        {r('600.0 / sum(l_quantity)')} AS processing_speed_factor FROM lineitem GROUP BY l_orderkey""",
    "recording_report": f"""SELECT d.recording_id, duration_ms, {r('q')} AS overall_quality_score, flagged AS flagged_segments, spk AS speaker_count,
        bucket_count, odd AS anomalous_buckets, {r('gm')} AS global_gap_mean, summary AS cadence_summary FROM durations d LEFT JOIN quality USING (recording_id)
        LEFT JOIN dsum USING (recording_id) LEFT JOIN new_a USING (recording_id)""",
    "search_text": rf"""SELECT recording_id, bucket_index, hits FROM (SELECT *, len(list_filter(regexp_extract_all(lower(text), '[{W}]+'), lambda x: x = 'the')) AS hits FROM buckets) WHERE hits > 0""",
    "stream_transcript_windows": """SELECT user_id AS recording_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS word_count, string_agg(event_type, ' ' ORDER BY ts, event_type) AS text FROM events GROUP BY ALL""",
    "stream_transcript_windows_back_context": """SELECT user_id AS recording_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 3601 SECOND, '%Y-%m-%d %H:%M:%S') AS window_end,
        count(*) AS word_count FROM (SELECT user_id, ts, unnest([date_trunc('hour', ts) - INTERVAL 1 SECOND, date_trunc('hour', ts) + INTERVAL 3599 SECOND]) AS w FROM events)
        WHERE ts >= w AND ts < w + INTERVAL 3601 SECOND GROUP BY user_id, w""",
    "stream_error_rate": f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) FILTER (event_type = 'error') AS errors,
        count(*) AS requests, {r("count(*) FILTER (event_type = 'error') / 300.0")} AS rate FROM (SELECT event_type, date_trunc('minute', ts) - to_minutes(unnest(range(5))) AS w FROM events) GROUP BY w""",
    "stream_error_ratio_alerts": f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, errors, requests, {r('rate')} AS rate,
        count(*) FILTER (rate > 0.1) OVER (ORDER BY w RANGE BETWEEN INTERVAL 4 MINUTE PRECEDING AND CURRENT ROW) = 5 AS alert FROM
        (SELECT w, count(*) FILTER (event_type = 'error') AS errors, count(*) AS requests, count(*) FILTER (event_type = 'error') / count(*) AS rate FROM
         (SELECT event_type, date_trunc('minute', ts) - to_minutes(unnest(range(5))) AS w FROM events) GROUP BY w)""",
    "stream_log_counts": """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""",
    "stream_sessions": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS events FROM
        (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n
         FROM events)) GROUP BY user_id, s""",
    "stream_progress": """SELECT user_id % 10 AS job_id, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""",
    "stream_bucketize": "SELECT recording_id, bucket_index, start_ms, end_ms, word_count, text FROM buckets",
    "stream_merge_chunks": "SELECT recording_id, count(*) AS segments FROM core GROUP BY 1",
}


def _assemble(body: str) -> str:
    """A body may start with its own expressions, written as ``, name AS (...)``."""
    body = body.strip()
    if not body.startswith(","):
        return with_ctes(body)
    return with_ctes(body).replace("\n" + body, body, 1)


#: White space as Unicode has it, for strip() and split().
SPACE = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]"
STRIP = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _spaced(sql: str) -> str:
    return sql.replace("trim(text)", STRIP).replace("trim(word)", STRIP.replace("(text", "(word")).replace(r"'\s+'", f"'{SPACE}+'")


#: Queries that write files and read them back give the rows of those that do not.
FILES = {"segment_files": "json_segment", "timing_files": "json_timing", "chunk_files": "json_chunks", "report_files": "validate_report", "search_index": "search_text", "srt_packed": "srt_plain"}

# the same report on the buckets of the older rule
_BODY["cadence_report_older"] = _BODY["cadence_report"].replace("new_a", "old_a").replace("SELECT * FROM timing WHERE anomaly", "SELECT * FROM old_f WHERE severity <> 'normal'")

ORACLES: dict[str, str] = {name: _spaced(_assemble(body)) for name, body in _BODY.items()}
ORACLES |= {name: ORACLES[same] for name, same in FILES.items()}
