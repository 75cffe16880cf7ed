"""The registered queries again, as SQL for an independent engine."""

from __future__ import annotations

from tapeloom.plans.full_log import command_fold_sql, fold_sql

# Unicode white space as a RE2 class.
WS = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

TRIM = f"regexp_replace({{0}}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def trim(column: str) -> str:
    return TRIM.replace("{0}", column)


VERSIONS = """
v AS (SELECT CAST(conv_id AS VARCHAR) AS recording_id, turn AS version_no, conv_id || '-' || turn AS transcript_id,
        conv_id || '-' || (turn // 2) AS clip_id, turn // 2 AS position, text,
        CASE role WHEN 'user' THEN 'user_edit' WHEN 'assistant' THEN 'raw_asr' ELSE 'imported' END AS provenance
      FROM conversations),
c AS (SELECT recording_id, clip_id, position, bool_or(provenance = 'imported') AS deleted FROM v GROUP BY ALL),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY recording_id, clip_id ORDER BY version_no DESC) = 1)
"""

DOCUMENT = f"""
WITH {VERSIONS}, d AS (SELECT c.recording_id, c.position, '[clip ' || c.clip_id || ' | ' || l.provenance || ']' || chr(10) || {trim('l.text')} AS piece
  FROM c JOIN l USING (recording_id, clip_id) WHERE NOT c.deleted)
SELECT *, strlen(piece) AS byte_count,
  CAST(coalesce(sum(strlen(piece) + 2) OVER (PARTITION BY recording_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM d
"""

TURNS = """
t AS (SELECT CAST(conv_id AS VARCHAR) AS recording_id, conv_id || '-' || turn AS clip_id, turn AS position,
        role = 'system' AS deleted FROM conversations),
a AS (SELECT * FROM t WHERE NOT deleted)
"""

LINES = """
li AS (SELECT CAST(l_orderkey AS VARCHAR) AS recording_id,
        l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS clip_id,
        epoch_us(l_shipdate) AS start_us, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS end_us,
        CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'N' THEN 'pending' ELSE 'transcribed' END AS status,
        l_linestatus AS line_status FROM lineitem),
media AS (SELECT CAST(l_orderkey AS VARCHAR) AS recording_id, CAST(sum(l_quantity) AS BIGINT) * 1000000 AS duration_us,
        CAST(sum(l_quantity) AS BIGINT) * 16000 AS frame_count FROM lineitem GROUP BY 1)
"""

TIMELINE = """
e0 AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, event_id, event_type, props,
        greatest(CAST(round(value * 100) AS BIGINT), 1) * 10000 AS len FROM events),
tl AS (SELECT recording_id, CAST(event_id AS VARCHAR) AS clip_id, event_id AS position,
        CAST(sum(len) OVER w - len AS BIGINT) AS start_us, CAST(sum(len) OVER w AS BIGINT) AS end_us,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status,
        CASE WHEN event_type = 'error' THEN props END AS failure
       FROM e0 WINDOW w AS (PARTITION BY recording_id ORDER BY event_id))
"""

USER_EVENTS = """
ue AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, event_id AS sequence, props,
        CASE event_type WHEN 'signup' THEN 'recording_created' WHEN 'view' THEN 'recording_started'
          WHEN 'click' THEN 'recording_saved' WHEN 'error' THEN 'recording_failed' ELSE 'clip_added' END AS kind FROM events),
ra AS (SELECT *, CASE kind WHEN 'recording_created' THEN 'created' WHEN 'recording_started' THEN 'recording'
          WHEN 'recording_saved' THEN 'saved' WHEN 'recording_failed' THEN 'failed' END AS st FROM ue),
re AS (SELECT * FROM ra WHERE st IS NOT NULL),
latest AS (SELECT recording_id, CASE WHEN bool_or(kind = 'recording_created') THEN 'microphone_recording' END AS source_kind,
        CASE WHEN bool_or(kind = 'recording_created') THEN 'u' || recording_id END AS source_path,
        arg_max(st, sequence) FILTER (WHERE st IS NOT NULL) AS status,
        CASE WHEN arg_max(st, sequence) FILTER (WHERE st IS NOT NULL) = 'failed' THEN arg_max(props, sequence) FILTER (WHERE st IS NOT NULL) END AS failure,
        max(sequence) AS last_sequence FROM ra GROUP BY 1)
"""

# A system turn's commit finds its clip deleted, which is where that conversation's log stops.
CONV_LOG = """
s AS (SELECT conv_id, min(turn) AS st FROM conversations WHERE role = 'system' GROUP BY 1),
lt AS (SELECT c.*, s.st, CAST(c.conv_id AS VARCHAR) AS recording_id, c.conv_id || '-' || c.turn AS clip_id,
        s.st IS NOT NULL AND c.turn = s.st AS stops FROM conversations c LEFT JOIN s USING (conv_id)
       WHERE s.st IS NULL OR c.turn <= s.st)
"""

VECTORS = """
x AS (SELECT vec_id, CAST(label AS VARCHAR) AS recording_id, unnest(embedding) AS s, generate_subscripts(embedding, 1) - 1 AS i,
        row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS b, count(*) OVER (PARTITION BY label) * 64 AS n FROM embeddings),
sig AS (SELECT vec_id, recording_id, s, i, b * 64 + i AS f, n FROM x)
"""

GAIN = "greatest(least(s * CAST(1.9952623 AS FLOAT), CAST(1 AS FLOAT)), CAST(-1 AS FLOAT))"
GATE = "CASE WHEN abs(s) < CAST(0.02 AS FLOAT) THEN s * CAST(0.08 AS FLOAT) ELSE s END"
EQ = "greatest(least(s + (s - coalesce(p, CAST(0 AS FLOAT)) * CAST(0.995 AS FLOAT)) * CAST(0.25 AS FLOAT), CAST(1 AS FLOAT)), CAST(-1 AS FLOAT))"

PROFILES = f"""
pv AS (SELECT *, lag(s) OVER (PARTITION BY recording_id ORDER BY f) AS p FROM sig),
pr AS (SELECT recording_id, 'original' AS profile, f, n, s FROM pv UNION ALL SELECT recording_id, 'gain6_db', f, n, {GAIN} FROM pv
  UNION ALL SELECT recording_id, 'noise_gate', f, n, {GATE} FROM pv UNION ALL SELECT recording_id, 'voice_eq', f, n, {EQ} FROM pv)
"""


def _rounded(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


def _resample(rate: int) -> str:
    return f"""
WITH {VECTORS}, tot AS (SELECT DISTINCT recording_id, n, n * 16000 // {rate} AS m FROM sig),
o AS (SELECT recording_id, n, unnest(range(greatest(m, 1))) AS k FROM tot),
q AS (SELECT *, k * {rate} // 16000 AS lo, CAST(k * {rate} % 16000 AS DOUBLE) / 16000 AS w FROM o)
SELECT q.recording_id, q.k AS frame_no, {_rounded('CAST(CAST(a.s AS DOUBLE) * (1 - q.w) + CAST(z.s AS DOUBLE) * q.w AS FLOAT)')} AS sample
FROM q JOIN sig a ON a.recording_id = q.recording_id AND a.f = q.lo
JOIN sig z ON z.recording_id = q.recording_id AND z.f = least(q.lo + 1, q.n - 1)
"""


def _uuid(*parts: str) -> str:
    joined = "md5(concat_ws(chr(31), " + ", ".join(parts) + "))"
    return (
        f"substr({joined},1,8) || '-' || substr({joined},9,4) || '-5' || substr({joined},14,3) || '-8' || "
        f"substr({joined},18,3) || '-' || substr({joined},21,12)"
    )


PROBES = """
pc AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 1000000 AS VARCHAR), 6, '0') AS part FROM orders)
"""

LABEL_CLIPS = """
lm AS (SELECT CAST(label AS VARCHAR) AS recording_id, count(*) * 64 AS n, count(*) * 64 * 1000000 // 16000 AS dur FROM embeddings GROUP BY 1),
lc0 AS (SELECT recording_id, n, dur, unnest(range((dur - 1) // 10000 + 1)) AS chunk_no FROM lm),
lc AS (SELECT recording_id, recording_id || '-' || chunk_no AS clip_id, n, chunk_no * 10000 AS start_us,
        least((chunk_no + 1) * 10000, dur) AS end_us FROM lc0)
"""

MEL = """
fb AS (SELECT unnest(range(201)) AS k),
edge AS (SELECT i, CASE WHEN mel >= 15 THEN 1000 * exp((ln(6.4) / 27) * (mel - 15)) ELSE mel * 200.0 / 3 END AS hz
  FROM (SELECT unnest(range(82)) AS i, unnest(range(82)) * (15 + ln(8.0) / (ln(6.4) / 27)) / 81 AS mel)),
filt AS (SELECT l.i AS mel_bin, k, greatest(least((k * 40.0 - l.hz) / (c.hz - l.hz), (r.hz - k * 40.0) / (r.hz - c.hz)), 0) * 2 / (r.hz - l.hz) AS w
  FROM edge l JOIN edge c ON c.i = l.i + 1 JOIN edge r ON r.i = l.i + 2, fb)
"""


def _mel_levels(windows: str) -> str:
    """Least and greatest level per mel band of feature windows (recording_id, window_id, f, s, n)."""
    return f"""
WITH {VECTORS}, {MEL}, ws AS ({windows}),
live AS (SELECT DISTINCT recording_id, window_id, unnest(range(least(n // 160 + 4, 3000))) AS fr FROM ws),
idx AS (SELECT recording_id, window_id, fr, j, CASE WHEN fr * 160 + j - 200 > 479999 THEN 959998 - (fr * 160 + j - 200) ELSE abs(fr * 160 + j - 200) END AS f
  FROM live, (SELECT unnest(range(400)) AS j)),
wv AS (SELECT idx.recording_id, idx.window_id, fr, j, CAST(s AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * j / 400)) AS v
  FROM idx JOIN ws ON ws.recording_id = idx.recording_id AND ws.window_id = idx.window_id AND ws.f = idx.f),
tw AS (SELECT k, m, cos(2 * pi() * m / 400) AS c, sin(2 * pi() * m / 400) AS sn FROM fb, (SELECT unnest(range(400)) AS m)),
dft AS (SELECT recording_id, window_id, fr, tw.k, sum(v * c) AS re, sum(v * sn) AS im FROM wv JOIN fb ON true JOIN tw ON tw.k = fb.k AND tw.m = (fb.k * wv.j) % 400 GROUP BY 1, 2, 3, 4),
en AS (SELECT recording_id, window_id, fr, mel_bin, log10(greatest(sum(w * (re * re + im * im)), 1e-10)) AS v FROM dft JOIN filt USING (k) GROUP BY 1, 2, 3, 4),
mx AS (SELECT recording_id, window_id, max(v) AS top FROM en GROUP BY 1, 2),
pb AS (SELECT recording_id, window_id, mel_bin, min(v) AS lo, max(v) AS hi, count(*) AS seen FROM en GROUP BY 1, 2, 3)
SELECT recording_id, window_id, mel_bin, CAST(3000 AS BIGINT) AS n_frames,
  round((greatest(CASE WHEN seen < 3000 THEN least(lo, -10) ELSE lo END, top - 8) + 4) / 4, 3) AS min_level, round((greatest(hi, top - 8) + 4) / 4, 3) AS max_level
FROM pb JOIN mx USING (recording_id, window_id)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["transcript_document"] = DOCUMENT
    q["document_totals"] = f"""SELECT recording_id, count(*) AS transcript_count,
        CAST(sum(byte_count) + 2 * (count(*) - 1) AS BIGINT) AS byte_count FROM ({DOCUMENT}) GROUP BY 1"""
    q["latest_transcript"] = f"WITH {VERSIONS} SELECT recording_id, clip_id, version_no, provenance, text FROM l"
    q["version_history"] = f"""WITH {VERSIONS}
        SELECT recording_id, clip_id, version_no, row_number() OVER w - 1 AS version_index, provenance,
          lag(provenance) OVER w AS previous_provenance, lag(text) OVER w IS NOT NULL AND coalesce(lag(text) OVER w <> text, false) AS changed
        FROM v WINDOW w AS (PARTITION BY recording_id, clip_id ORDER BY version_no)"""
    q["clip_navigation"] = f"""WITH {TURNS}
        SELECT recording_id, clip_id, row_number() OVER w AS clip_index, count(*) OVER (PARTITION BY recording_id) AS clip_count,
          coalesce(lag(clip_id) OVER w, last_value(clip_id) OVER (PARTITION BY recording_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_clip_id,
          coalesce(lead(clip_id) OVER w, first_value(clip_id) OVER w) AS next_clip_id
        FROM a WINDOW w AS (PARTITION BY recording_id ORDER BY position)"""
    q["first_active_clip"] = f"WITH {TURNS} SELECT recording_id, arg_min(clip_id, position) AS clip_id, min(position) AS position FROM a GROUP BY 1"
    q["active_target_index"] = f"""WITH {TURNS} SELECT recording_id, clip_id,
        row_number() OVER (PARTITION BY recording_id ORDER BY position) - 1 AS active_index, position AS target_index FROM a"""
    q["recording_view"] = f"""WITH {VERSIONS}, f AS (SELECT recording_id, arg_min(clip_id, position) AS clip_id FROM c WHERE NOT deleted GROUP BY 1)
        SELECT r.recording_id, 'saved' AS status, f.clip_id AS selected_clip_id, l.provenance, l.text, l.transcript_id IS NOT NULL AS committed
        FROM (SELECT DISTINCT recording_id FROM v) r LEFT JOIN f USING (recording_id) LEFT JOIN l ON l.recording_id = r.recording_id AND l.clip_id = f.clip_id"""
    q["recording_view_selected"] = f"""WITH {VERSIONS}, a AS (SELECT * FROM c WHERE NOT deleted), f AS (SELECT recording_id, arg_min(clip_id, position) AS clip_id FROM a GROUP BY 1),
        z AS (SELECT recording_id, arg_max(clip_id, position) AS clip_id, bool_or(deleted) FILTER (WHERE deleted) AS any_deleted FROM c GROUP BY 1),
        s AS (SELECT z.recording_id, CASE WHEN a.clip_id IS NOT NULL THEN a.clip_id ELSE f.clip_id END AS clip_id FROM z LEFT JOIN a ON a.recording_id = z.recording_id AND a.clip_id = z.clip_id LEFT JOIN f ON f.recording_id = z.recording_id),
        n AS (SELECT recording_id, count(*) AS n_notes, min('clip ' || clip_id || ': odd ' || clip_id) AS first_note FROM a WHERE position % 2 = 1 GROUP BY 1)
        SELECT s.recording_id, s.clip_id AS selected_clip_id, l.provenance, l.text, l.transcript_id IS NOT NULL AS committed, n_notes, first_note
        FROM s LEFT JOIN l ON l.recording_id = s.recording_id AND l.clip_id = s.clip_id LEFT JOIN n ON n.recording_id = s.recording_id"""
    q["report_lines"] = f"SELECT 'recording_id: ' || recording_id || ', transcript_count: ' || transcript_count || ', byte_count: ' || byte_count AS value FROM ({q['document_totals']})"
    q["show_recordings"] = f"""WITH {LINES} SELECT CAST(o_orderkey AS VARCHAR) AS recording_id, o_orderstatus AS status,
        count(li.recording_id) AS clip_count, count(*) FILTER (WHERE li.line_status = 'F') AS transcript_count
        FROM orders LEFT JOIN li ON li.recording_id = CAST(o_orderkey AS VARCHAR) GROUP BY 1, 2"""
    q["media_summary"] = f"""WITH {LINES} SELECT o_orderpriority AS source_kind, o_orderstatus AS status, count(*) AS n_recordings,
        CAST(sum(frame_count) AS BIGINT) AS frame_count, CAST(sum(duration_us) AS BIGINT) AS duration_us, max(CASE WHEN media.recording_id IS NOT NULL THEN 16000 END) AS max_rate_hz
        FROM orders LEFT JOIN media ON media.recording_id = CAST(o_orderkey AS VARCHAR) GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"""
    q["next_action"] = f"""WITH {LINES}, act AS (SELECT * FROM li WHERE status <> 'failed'),
        f AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY start_us, clip_id) = 1),
        h AS (SELECT DISTINCT f.recording_id FROM f JOIN li ON li.recording_id = f.recording_id AND li.clip_id = f.clip_id AND li.line_status = 'F')
        SELECT CAST(o_orderkey AS VARCHAR) AS recording_id, CASE WHEN media.recording_id IS NULL THEN 'CLICK PREPARE TO NORMALIZE AUDIO'
          WHEN h.recording_id IS NULL THEN 'CLICK TRANSCRIBE TO CREATE TEXT' ELSE 'REVIEW TEXT, THEN CLICK EXPORT' END AS next_action
        FROM orders LEFT JOIN media ON media.recording_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN h ON h.recording_id = CAST(o_orderkey AS VARCHAR)"""
    q["next_recording"] = f"""WITH r AS (SELECT {_uuid("'customer'", "CAST(c_custkey AS VARCHAR)")} AS recording_id FROM customer)
        SELECT recording_id, coalesce(lead(recording_id) OVER (ORDER BY recording_id), min(recording_id) OVER ()) AS next_recording_id FROM r"""
    q["failure_report"] = f"""WITH {USER_EVENTS}, {TIMELINE}
        SELECT recording_id, NULL AS clip_id, 'recording: ' || failure AS message, 'error' AS severity FROM latest WHERE failure IS NOT NULL
        UNION ALL SELECT recording_id, clip_id, 'clip ' || clip_id || ': ' || failure, 'error' FROM tl WHERE failure IS NOT NULL"""

    q["replay_recordings"] = f"""WITH {CONV_LOG} SELECT recording_id, 'audio_file' AS source_kind, 'c' || recording_id AS source_path,
        'created' AS status, CAST(NULL AS VARCHAR) AS failure, max(turn * 3 + CASE WHEN stops THEN 3 ELSE 4 END) AS last_sequence FROM lt GROUP BY 1"""
    q["replay_clips"] = f"""WITH {CONV_LOG} SELECT recording_id, clip_id, turn AS position, turn * 1000000 AS start_us, (turn + 1) * 1000000 AS end_us,
        CASE WHEN stops THEN 'deleted' WHEN role = 'user' THEN 'edited' ELSE 'transcribed' END AS status, CAST(NULL AS VARCHAR) AS failure FROM lt"""
    q["replay_transcripts"] = f"""WITH {CONV_LOG} SELECT recording_id, turn * 3 + 4 AS version_no, 'v-' || conv_id || '-' || turn AS transcript_id, clip_id,
        CASE WHEN role = 'user' THEN 'user_edit' ELSE 'raw_asr' END AS provenance, text FROM lt WHERE NOT stops"""
    q["replay_rejects"] = f"""WITH {CONV_LOG} SELECT recording_id, turn * 3 + 4 AS sequence, 'transcript_committed' AS kind, 'clip_deleted' AS reason_code FROM lt WHERE stops"""
    q["replay_full_recordings"] = fold_sql("SELECT recording_id, source_kind, source_path, status, failure, last AS last_sequence FROM fin")
    q["replay_full_clips"] = fold_sql("""SELECT recording_id, u.c.id AS clip_id, u.i - 1 AS position, u.c.s AS start_us, u.c.e AS end_us, u.c.st AS status, u.c.fail AS failure
        FROM (SELECT recording_id, unnest(clips) AS c, generate_subscripts(clips, 1) AS i FROM fin) u""")
    q["replay_full_transcripts"] = fold_sql("""SELECT recording_id, t.no AS version_no, t.id AS transcript_id, t.clip AS clip_id, t.prov AS provenance, t.text AS text
        FROM (SELECT recording_id, unnest(texts) AS t FROM fin)""")
    q["replay_full_rejects"] = fold_sql("""SELECT st.recording_id, ev.sequence, st.kind, st.code AS reason_code FROM st JOIN ev ON ev.recording_id = st.recording_id AND ev.i = st.i WHERE code IS NOT NULL""")
    q["life_cycle_rejects"] = f"""WITH {USER_EVENTS}, n AS (SELECT recording_id, kind, row_number() OVER w AS sequence,
          last_value(CASE WHEN kind <> 'clip_added' THEN kind END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was
          FROM ra WINDOW w AS (PARTITION BY recording_id ORDER BY sequence)),
        b AS (SELECT *, CASE WHEN kind = 'recording_created' THEN CASE WHEN was IS NOT NULL THEN 'recording_already_exists' END
            WHEN was IS NULL THEN 'recording_not_found'
            WHEN kind = 'recording_started' AND was <> 'recording_created' THEN 'invalid_recording_transition'
            WHEN kind = 'recording_saved' AND was <> 'recording_started' THEN 'invalid_recording_transition'
            WHEN kind = 'recording_failed' AND was NOT IN ('recording_created', 'recording_started') THEN 'invalid_recording_transition' END AS reason_code FROM n)
        SELECT recording_id, sequence, kind, reason_code FROM b WHERE reason_code IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY sequence) = 1"""
    q["numbering_rejects"] = f"""WITH {USER_EVENTS}, n AS (SELECT recording_id, kind, sequence, row_number() OVER w AS rank,
          last_value(CASE WHEN kind <> 'clip_added' THEN kind END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was
          FROM ra WINDOW w AS (PARTITION BY recording_id ORDER BY sequence)),
        b AS (SELECT *, CASE WHEN sequence <> rank THEN 'event_out_of_order' WHEN kind = 'recording_created' THEN CASE WHEN was IS NOT NULL THEN 'recording_already_exists' END
            WHEN was IS NULL THEN 'recording_not_found'
            WHEN kind = 'recording_started' AND was <> 'recording_created' THEN 'invalid_recording_transition'
            WHEN kind = 'recording_saved' AND was <> 'recording_started' THEN 'invalid_recording_transition'
            WHEN kind = 'recording_failed' AND was NOT IN ('recording_created', 'recording_started') THEN 'invalid_recording_transition' END AS reason_code FROM n)
        SELECT recording_id, sequence, kind, reason_code FROM b WHERE reason_code IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY sequence) = 1"""
    q["latest_state"] = f"WITH {USER_EVENTS} SELECT * FROM latest"
    q["transition_audit"] = f"""WITH {USER_EVENTS}, t AS (SELECT coalesce(lag(st) OVER (PARTITION BY recording_id ORDER BY sequence), 'none') AS from_status, st AS to_status FROM re)
        SELECT from_status, to_status, from_status || '>' || to_status IN ('none>created', 'created>recording', 'recording>saved', 'created>failed', 'recording>failed') AS legal,
          count(*) AS n_events FROM t GROUP BY 1, 2, 3"""
    q["sequence_audit"] = f"""WITH {USER_EVENTS}, t AS (SELECT recording_id, sequence, sequence <> coalesce(lag(sequence) OVER (PARTITION BY recording_id ORDER BY sequence), 0) + 1 AS off FROM ue)
        SELECT recording_id, count(*) AS n_records, count(*) FILTER (WHERE off) AS n_out_of_order, min(sequence) FILTER (WHERE off) AS first_bad_sequence FROM t GROUP BY 1"""
    q["state_equals"] = f"""WITH {LINES}, a AS (SELECT recording_id, clip_id, status FROM li),
        b AS (SELECT recording_id, clip_id, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status FROM li),
        d AS (SELECT 'replayed' AS only_in, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'snapshot', * FROM (FROM b EXCEPT ALL FROM a))
        SELECT only_in, status, count(*) AS n_rows FROM d GROUP BY 1, 2"""
    q["event_lines"] = """WITH l AS (
          SELECT conv_id, 1 AS sequence, 'recording_created' AS kind, NULL AS text, NULL AS start_us FROM conversations WHERE turn = 0
          UNION ALL SELECT conv_id, turn * 3 + 2, 'clip_added', NULL, turn * 1000000 FROM conversations
          UNION ALL SELECT conv_id, turn * 3 + 3, CASE WHEN role = 'system' THEN 'clip_deleted' ELSE 'transcription_started' END, NULL, NULL FROM conversations
          UNION ALL SELECT conv_id, turn * 3 + 4, 'transcript_committed', text, NULL FROM conversations)
        SELECT CAST(conv_id AS VARCHAR) AS recording_id, kind, count(*) AS n_events, CAST(sum(sequence) AS BIGINT) AS sum_sequence,
          CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, CAST(sum(start_us) AS BIGINT) AS sum_start_us FROM l GROUP BY 1, 2"""
    q["foreign_lines"] = """SELECT CAST(conv_id + 1 AS VARCHAR) AS recording_id, turn * 3 + 4 AS sequence, 'transcript_committed' AS kind,
        'wrong_recording' AS reason_code FROM conversations"""
    own = _uuid("'log'", "CAST(conv_id AS VARCHAR)")
    q["file_order_rejects"] = f"""SELECT {own} AS recording_id, CAST(3 AS BIGINT) AS line_no, CAST(4 AS BIGINT) AS sequence, 'transcript_committed' AS kind, 'event_out_of_order' AS reason_code
        FROM conversations WHERE conv_id % 5 = 1 AND turn = 0"""
    q["list_recordings"] = f"""SELECT {own} AS recording_id, 'audio_file' AS source_kind, 'created' AS status, max(turn) * 3 + 4 AS last_sequence
        FROM conversations WHERE conv_id % 5 <> 1 GROUP BY conv_id HAVING NOT bool_or(role = 'system')"""
    q["manifest_round_trip"] = f"""WITH {CONV_LOG} SELECT {own} AS recording_id, 'created' AS status, count(*) AS n_clips, CAST(sum((turn + 1) * 1000000) AS BIGINT) AS sum_end_us,
        nullif(count(*) FILTER (WHERE NOT stops), 0) AS n_transcripts, CAST(sum(strlen(text)) FILTER (WHERE NOT stops) AS BIGINT) AS text_bytes FROM lt GROUP BY conv_id"""
    q["manifest_continued"] = f"""WITH {CONV_LOG}, m AS (SELECT conv_id, max(turn * 3 + CASE WHEN stops THEN 3 ELSE 4 END) AS last, count(*) FILTER (WHERE NOT stops) AS n FROM lt GROUP BY 1)
        SELECT {own} AS recording_id, last + 1 AS first_new, n AS n_new, last + n AS last_sequence, 0 AS n_live FROM m WHERE n > 0"""
    q["export_reports"] = q["document_totals"]
    q["export_missing"] = f"""WITH {VERSIONS} SELECT DISTINCT recording_id, 'no_committed_transcripts' AS reason_code FROM v
        WHERE recording_id NOT IN (SELECT recording_id FROM c WHERE NOT deleted)"""
    q["wav_round_trip"] = f"""WITH {VECTORS} SELECT recording_id, f AS frame_no, {_rounded('s')} AS sample, n AS frame_count, n * 1000000 // 16000 AS duration_us FROM sig"""
    q["malformed_lines"] = f"""SELECT CAST(doc_id AS VARCHAR) AS recording_id, 'invalid_event_line' AS reason_code, strlen(text) AS raw_bytes
        FROM documents WHERE regexp_matches(text, '[^{WS}]')"""
    q["apply_commands"] = f"""WITH {CONV_LOG}
        SELECT CAST(c.conv_id AS VARCHAR) AS recording_id, c.conv_id || '-' || c.turn AS clip_id, 'transcript_committed' AS kind,
          CASE WHEN lt.clip_id IS NULL THEN 'clip_not_found' WHEN lt.stops THEN 'clip_deleted' ELSE 'accepted' END AS outcome
        FROM conversations c LEFT JOIN lt ON lt.conv_id = c.conv_id AND lt.turn = c.turn"""

    q["command_log"] = command_fold_sql("""SELECT recording_id, CASE WHEN code IS NULL THEN last ELSE num END AS sequence, kind, CASE WHEN code IS NULL THEN clip_id END AS clip_id, code AS reason_code
        FROM (SELECT st.*, ev.sequence * 2 + ev.copy AS num, ev.clip_id FROM st JOIN ev ON ev.recording_id = st.recording_id AND ev.i = st.i)""")
    q["replay_tail"] = fold_sql("""SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, a.status, a.failure, a.last_sequence,
          a.n_clips, a.placed, a.edited_at, a.n_failures, a.n_transcripts, a.sum_versions, b.stop_sequence, b.reason_code
        FROM (SELECT recording_id, status, failure, last AS last_sequence, nullif(len(clips), 0) AS n_clips,
            CAST((SELECT sum((i - 1) * clips[i].e) FROM range(1, len(clips) + 1) AS t(i)) AS BIGINT) AS placed,
            CAST((SELECT sum(i) FROM range(1, len(clips) + 1) AS t(i) WHERE clips[i].st = 'edited') AS BIGINT) AS edited_at,
            CASE WHEN len(clips) > 0 THEN len(list_filter(clips, lambda x: x.fail IS NOT NULL)) END AS n_failures,
            nullif(len(texts), 0) AS n_transcripts, CAST(list_sum(list_transform(texts, lambda x: x.no)) AS BIGINT) AS sum_versions FROM fin) a
        FULL JOIN (SELECT st.recording_id, ev.sequence AS stop_sequence, st.code AS reason_code FROM st JOIN ev ON ev.recording_id = st.recording_id AND ev.i = st.i WHERE st.code IS NOT NULL) b
          ON a.recording_id = b.recording_id""")
    q["command_tail"] = fold_sql("""SELECT recording_id, last + 2 * i - 1 + k AS sequence, CASE k WHEN 0 THEN 'clip_deleted' ELSE 'clip_added' END AS kind,
          CASE k WHEN 0 THEN clips[i].id ELSE 'n' || (i - 1) END AS clip_id, NULL AS reason_code
        FROM (SELECT recording_id, last, clips, unnest(range(1, len(clips) + 1)) AS i FROM fin) CROSS JOIN (VALUES (0), (1)) AS t(k)
        UNION ALL SELECT recording_id, -1, 'clip_added', NULL, 'clip_overlaps' FROM fin WHERE clips[1].st = 'edited'
        """, "sequence <= 3 + CAST(recording_id AS BIGINT) % 17")
    orders = "k AS (SELECT CAST(l_orderkey AS VARCHAR) AS recording_id, count(*) AS n FROM lineitem GROUP BY 1)"
    q["command_splits"] = f"""WITH {orders}, r AS (SELECT recording_id, n, unnest(range(n)) AS r FROM k)
        SELECT recording_id, n + 2 + 3 * r AS sequence, 'clip_deleted' AS kind, NULL AS start_us, NULL AS end_us FROM r
        UNION ALL SELECT recording_id, n + 3 + 3 * r, 'clip_added', r * 10, r * 10 + 5 FROM r
        UNION ALL SELECT recording_id, n + 4 + 3 * r, 'clip_added', r * 10 + 5, r * 10 + 10 FROM r"""
    q["command_appends"] = f"""WITH {orders}, r AS (SELECT recording_id, n, unnest(range(n // 2)) AS r FROM k)
        SELECT recording_id, n + 2 + 3 * r AS sequence, 'clip_deleted' AS kind, NULL AS start_us, NULL AS end_us FROM r
        UNION ALL SELECT recording_id, n + 3 + 3 * r, 'clip_deleted', NULL, NULL FROM r
        UNION ALL SELECT recording_id, n + 4 + 3 * r, 'clip_added', r * 20, r * 20 + 20 FROM r"""
    q["command_moves"] = f"""WITH {orders}, r AS (SELECT recording_id, n, unnest(range(n)) AS r FROM k)
        SELECT recording_id, n + 2 + r - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS sequence, 'clip_moved' AS kind, NULL AS start_us, NULL AS end_us FROM r WHERE r > 0 OR n % 2 = 1
        UNION ALL SELECT recording_id, 0, 'clip_moved', -1, -1 FROM k WHERE n % 2 = 0"""
    q["moved_clips"] = f"""WITH {orders}, r AS (SELECT recording_id, n, unnest(range(n)) AS r FROM k)
        SELECT recording_id, 'c' || r AS clip_id, n - 1 - r AS position, r * 10 AS start_us, 'pending' AS status, 2 * n + n % 2 AS last_sequence FROM r"""
    q["append_rejects"] = f"""WITH {TIMELINE}, n AS (SELECT *, lead(clip_id) OVER w AS nxt, lead(clip_id, 2) OVER w AS far, lead(status, 2) OVER w AS far_status,
          row_number() OVER w - 1 AS i FROM tl WINDOW w AS (PARTITION BY recording_id ORDER BY start_us))
        SELECT 'chain' AS asked, recording_id, clip_id AS first_clip_id, nxt AS second_clip_id, 'clip_not_active' AS reason_code FROM n WHERE nxt IS NOT NULL AND i % 2 = 1
        UNION ALL SELECT 'pair', recording_id, clip_id, far, CASE WHEN 'failed' IN (status, far_status) THEN 'clip_not_active' ELSE 'clips_not_adjacent' END FROM n WHERE far IS NOT NULL
        UNION ALL SELECT 'pair', recording_id, clip_id, clip_id, 'same_clip' FROM n
        UNION ALL SELECT 'pair', recording_id, clip_id, 'gone', 'clip_not_active' FROM n"""
    q["chunk_rejects"] = f"""WITH {LINES}, o AS (SELECT m.recording_id, duration_us, o_orderstatus AS st FROM media m JOIN orders ON CAST(o_orderkey AS VARCHAR) = m.recording_id)
        SELECT recording_id, CASE WHEN st = 'O' AND duration_us > 0 THEN 'planned' ELSE 'invalid_chunk_duration' END AS outcome,
          CASE WHEN st = 'O' AND duration_us > 0 THEN (duration_us - 1) // 30000000 + 1 ELSE 0 END AS n_chunks FROM o"""
    q["plan_chunks"] = f"""WITH {LINES}, k AS (SELECT recording_id, duration_us, unnest(range((duration_us - 1) // 30000000 + 1)) AS chunk_no FROM media WHERE duration_us > 0)
        SELECT recording_id, chunk_no, chunk_no * 30000000 AS start_us, least((chunk_no + 1) * 30000000, duration_us) AS end_us FROM k"""
    q["clip_timeline"] = f"WITH {TIMELINE} SELECT recording_id, clip_id, start_us, end_us, start_us + (end_us - start_us) // 2 AS middle_us FROM tl"
    q["coverage"] = f"""WITH {TIMELINE}, m AS (SELECT recording_id, max(end_us) + 1000000 AS duration_us FROM tl GROUP BY 1),
        a AS (SELECT *, start_us > coalesce(lag(end_us) OVER (PARTITION BY recording_id ORDER BY start_us), 0) AS gap FROM tl WHERE status <> 'failed'),
        g AS (SELECT recording_id, CAST(sum(end_us - start_us) AS BIGINT) AS covered, count(*) FILTER (WHERE gap) AS gaps, max(end_us) AS last_end FROM a GROUP BY 1)
        SELECT m.recording_id, duration_us, coalesce(covered, 0) AS covered_us, duration_us - coalesce(covered, 0) AS gap_us,
          coalesce(gaps, 0) + CASE WHEN coalesce(last_end, 0) < duration_us THEN 1 ELSE 0 END AS n_gaps,
          coalesce(last_end, 0) = duration_us AND coalesce(gaps, 0) = 0 AS exact_cover FROM m LEFT JOIN g USING (recording_id)"""
    q["overlaps"] = f"""WITH {LINES}, p AS (SELECT a.recording_id, a.clip_id, a.start_us, a.end_us, b.clip_id AS other,
            b.start_us < a.start_us AS earlier, b.end_us AS b_end
          FROM li a JOIN li b ON a.recording_id = b.recording_id AND b.end_us > a.start_us
            AND (b.start_us < a.start_us OR (b.start_us = a.start_us AND b.clip_id < a.clip_id)))
        SELECT recording_id, clip_id, start_us, end_us, other AS other_clip_id FROM p
        QUALIFY row_number() OVER (PARTITION BY recording_id, clip_id, start_us, end_us
          ORDER BY earlier DESC, CASE WHEN earlier THEN b_end END DESC, CASE WHEN earlier THEN other END DESC, other) = 1"""
    q["coalesce_runs"] = f"""WITH {LINES}, a AS (SELECT *, max(end_us) OVER (PARTITION BY recording_id ORDER BY start_us, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM li),
        b AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start_us THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_us, clip_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
        SELECT recording_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_clips FROM b GROUP BY recording_id, run"""
    q["locate"] = f"""WITH {TIMELINE}, p AS (SELECT CAST(o_custkey AS VARCHAR) AS recording_id, CAST(o_orderkey AS VARCHAR) AS point_id,
          CAST(round(o_totalprice * 100) AS BIGINT) * 10 AS at_us FROM orders)
        SELECT p.recording_id, point_id, at_us, tl.clip_id FROM p LEFT JOIN tl ON tl.recording_id = p.recording_id AND tl.start_us <= at_us AND at_us < tl.end_us"""
    q["split_midpoint"] = f"""WITH {TIMELINE}, m AS (SELECT *, start_us + (end_us - start_us) // 2 AS mid FROM tl),
        h AS (SELECT recording_id, clip_id AS original_clip_id, mid AS split_at_us, 'left' AS side, start_us, mid AS end_us FROM m
          UNION ALL SELECT recording_id, clip_id, mid, 'right', mid, end_us FROM m)
        SELECT *, {_uuid("'split'", "recording_id", "original_clip_id", "CAST(split_at_us AS VARCHAR)", "side")} AS clip_id FROM h"""
    q["split_rejects"] = f"""WITH {TIMELINE} SELECT recording_id, clip_id, position AS split_at_us, CASE WHEN status = 'failed' THEN 'clip_not_active' ELSE 'split_outside_clip' END AS reason_code
        FROM tl WHERE status = 'failed' OR NOT (position > start_us AND position < end_us)"""
    q["append_pairs"] = f"""WITH {TIMELINE}, n AS (SELECT *, lead(clip_id) OVER w AS nxt, lead(end_us) OVER w AS nxt_end, row_number() OVER w - 1 AS i
          FROM tl WINDOW w AS (PARTITION BY recording_id ORDER BY start_us))
        SELECT recording_id, clip_id AS first_clip_id, nxt AS second_clip_id, start_us, nxt_end AS end_us, {_uuid("'append'", "recording_id", "clip_id", "nxt")} AS clip_id
        FROM n WHERE nxt IS NOT NULL AND i % 2 = 0"""
    q["ensure_chunks"] = f"""WITH {LINES}, o AS (SELECT m.recording_id, duration_us, o_orderstatus AS st FROM media m JOIN orders ON CAST(o_orderkey AS VARCHAR) = m.recording_id),
        z AS (SELECT *, (duration_us - 1) // 30000000 + 1 AS p30, (duration_us - 1) // 10000000 + 1 AS p10 FROM o WHERE duration_us > 0)
        SELECT recording_id, CASE st WHEN 'O' THEN 'add' WHEN 'F' THEN 'reuse' ELSE CASE WHEN duration_us <= 10000000 THEN 'reuse' ELSE 'mismatch' END END AS decision,
          CASE st WHEN 'O' THEN 0 WHEN 'F' THEN p30 ELSE p10 END AS n_active, p30 AS n_planned FROM z"""
    plan = f"""WITH {LINES}, o AS (SELECT m.recording_id, duration_us, o_orderstatus AS st FROM media m JOIN orders ON CAST(o_orderkey AS VARCHAR) = m.recording_id WHERE duration_us > 0),
        c AS (SELECT *, unnest(range((duration_us - 1) // 30000000 + 1)) AS i FROM o WHERE st <> 'P' OR duration_us <= 10000000),
        r AS (SELECT recording_id, st, i, i * 30000000 AS start_us, least((i + 1) * 30000000, duration_us) AS end_us FROM c)"""
    new = _uuid("'chunk'", "recording_id", "CAST(start_us AS VARCHAR)", "CAST(end_us AS VARCHAR)")
    q["ensure_chunks_use"] = f"{plan} SELECT recording_id, CASE WHEN st = 'O' THEN {new} ELSE 'k' || i END AS clip_id, start_us, end_us FROM r"
    q["ensure_chunks_add"] = f"{plan} SELECT recording_id, {new} AS clip_id, start_us, end_us FROM r WHERE st = 'O'"
    q["ensure_full_clip"] = f"""WITH {LINES}, f AS (SELECT * FROM li WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY start_us, clip_id) = 1)
        SELECT media.recording_id, coalesce(f.start_us, 0) AS start_us, coalesce(f.end_us, duration_us) AS end_us, f.clip_id IS NULL AS is_new
        FROM media LEFT JOIN f USING (recording_id) WHERE duration_us > 0"""

    q["blank_text"] = f"""SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '[^{WS}]') AS blank, length({trim('text')}) AS n_trimmed, md5({trim('text')}) AS trimmed_md5 FROM documents"""
    q["id_audit"] = """WITH t AS (SELECT l_orderkey, l_linenumber, count(*) AS uses FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT 'clip_already_exists' AS reason_code, count(*) AS n_keys, CAST(sum(uses) AS BIGINT) AS n_rows FROM t HAVING count(*) > 0
        UNION ALL SELECT 'recording_not_found', count(DISTINCT l_orderkey), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0"""
    q["frame_arithmetic"] = """WITH f AS (SELECT l_orderkey, l_partkey, CAST([8000, 11025, 16000, 22050, 44100, 48000, 96000][l_linenumber] AS INTEGER) AS rate,
          CAST(round(l_extendedprice * 100) AS BIGINT) AS frames FROM lineitem)
        SELECT *, frames * 1000000 // rate AS duration_us, frames * 16000 // 1000000 AS sample_floor, (frames * 16000 + 999999) // 1000000 AS sample_ceil FROM f"""
    q["media_kinds"] = r"""WITH p AS (SELECT page_id, nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/\\]\.([^./\\]*)$', 1)), '') AS extension FROM pages)
        SELECT page_id, extension, CASE WHEN extension IN ('mp4', 'mov', 'mkv', 'webm', 'avi') THEN 'video_file' ELSE 'audio_file' END AS source_kind,
          coalesce(extension IN ('wav', 'mp3', 'm4a', 'flac', 'ogg', 'aac', 'opus', 'aiff', 'mp4', 'mov', 'mkv', 'webm', 'avi'), false) AS supported FROM p"""
    q["profile_names"] = """SELECT vec_id, ['ORIGINAL', 'GAIN +6DB', 'NOISE GATE', 'VOICE EQ'][label % 4 + 1] AS label, ['RAW', 'GAIN', 'GATE', 'EQ'][label % 4 + 1] AS short_label,
          ['gain6_db', 'noise_gate', 'voice_eq', 'original'][label % 4 + 1] AS next_profile,
          'store/recordings/' || vec_id || '/audio/' || ['normalized-16khz-mono.wav', 'profiles/gain-6db.wav', 'profiles/noise-gate.wav', 'profiles/voice-eq.wav'][label % 4 + 1] AS path FROM embeddings"""
    q["probe_parse"] = f"""WITH {PROBES}, c AS (SELECT 'csv-' || o_orderkey AS recording_id, (o_custkey % 7200) * 1000000 + CAST(part AS BIGINT) AS duration_us, 48000 AS sample_rate_hz, 2 AS channels,
            CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE cents END AS given FROM pc WHERE o_orderpriority <> '5-LOW'),
        l AS (SELECT 'log-' || o_orderkey AS recording_id, (o_custkey % 360000) * 1000000 + CAST(part AS BIGINT) AS duration_us, 44100 AS sample_rate_hz,
            CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 6 ELSE 4 END AS channels FROM pc)
        SELECT recording_id, duration_us, CAST(sample_rate_hz AS BIGINT) AS sample_rate_hz, channels, coalesce(given, duration_us * 48000 // 1000000) AS frame_count FROM c
        UNION ALL SELECT recording_id, duration_us, sample_rate_hz, channels, duration_us * 44100 // 1000000 FROM l"""
    q["probe_rejects"] = "SELECT 'csv-' || o_orderkey AS recording_id, 'invalid_probe' AS reason_code, o_orderpriority || ',' || o_orderstatus AS raw FROM orders WHERE o_orderpriority = '5-LOW'"

    q["gain"] = f"WITH {VECTORS} SELECT vec_id, i, {_rounded(GAIN)} AS sample FROM sig"
    q["noise_gate"] = f"WITH {VECTORS} SELECT vec_id, i, {_rounded(GATE)} AS sample FROM sig"
    q["voice_eq"] = f"WITH {VECTORS}, pv AS (SELECT *, lag(s) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM sig) SELECT vec_id, i, {_rounded(EQ)} AS sample FROM pv"
    q["pad_or_trim"] = f"""WITH {VECTORS}, ids AS (SELECT DISTINCT vec_id FROM sig), g AS (SELECT vec_id, unnest(range(100)) AS i FROM ids)
        SELECT g.vec_id, g.i, coalesce({_rounded('s')}, 0) AS sample, 100 AS length FROM g LEFT JOIN sig ON sig.vec_id = g.vec_id AND sig.i = g.i
        UNION ALL SELECT vec_id, i, {_rounded('s')}, 50 FROM sig WHERE i < 50"""
    q["downmix"] = f"""WITH {VECTORS}, m AS (SELECT vec_id, i // 3 AS i, CAST(0 AS FLOAT) + max(CASE WHEN i % 3 = 0 THEN s END) + coalesce(max(CASE WHEN i % 3 = 1 THEN s END), CAST(0 AS FLOAT))
            + coalesce(max(CASE WHEN i % 3 = 2 THEN s END), CAST(0 AS FLOAT)) AS t FROM sig GROUP BY 1, 2)
        SELECT vec_id, i, {_rounded('CAST(t / CAST(3 AS FLOAT) AS FLOAT)')} AS sample FROM m"""
    q["downmix_callback"] = f"""WITH {VECTORS}, m AS (SELECT vec_id, i // 3 AS i, CAST(0 AS FLOAT) + max(CASE WHEN i % 3 = 0 THEN s END) + coalesce(max(CASE WHEN i % 3 = 1 THEN s END), CAST(0 AS FLOAT))
            + coalesce(max(CASE WHEN i % 3 = 2 THEN s END), CAST(0 AS FLOAT)) AS t, count(*) AS k FROM sig GROUP BY 1, 2)
        SELECT vec_id, i, {_rounded('greatest(least(CAST(t / CAST(k AS FLOAT) AS FLOAT), CAST(1 AS FLOAT)), CAST(-1 AS FLOAT))')} AS sample FROM m"""
    for name, width in (("pcm24_to_float", 3), ("pcm32_to_float", 4)):
        value = " + ".join(f"{256 ** k} * CAST(ascii(substr(url, i * {width} + {k + 1}, 1)) AS BIGINT)" for k in range(width))
        top = 256 ** width // 2
        q[name] = f"""WITH g AS (SELECT page_id, url, unnest(range(length(url) // {width})) AS i FROM pages), w AS (SELECT page_id, i, {value} AS u FROM g)
        SELECT page_id, i, {_rounded(f'CAST(CASE WHEN u >= {top} THEN u - {2 * top} ELSE u END AS FLOAT) / CAST({top} AS FLOAT)')} AS sample FROM w"""
    q["pcm_to_float"] = f"""WITH g AS (SELECT page_id, url, unnest(range(length(url) // 2)) AS i FROM pages),
        w AS (SELECT page_id, i, ascii(substr(url, i * 2 + 1, 1)) + 256 * ascii(substr(url, i * 2 + 2, 1)) AS u FROM g)
        SELECT page_id, i, {_rounded('CAST(CASE WHEN u > 32767 THEN u - 65536 ELSE u END AS FLOAT) / CAST(32768 AS FLOAT)')} AS sample FROM w"""
    q["profiles"] = f"WITH {VECTORS}, {PROFILES} SELECT recording_id, profile, f AS frame_no, {_rounded('s')} AS sample FROM pr"
    q["profile_receipts"] = """WITH t AS (SELECT CAST(label AS VARCHAR) AS recording_id, count(*) * 64 AS frame_count FROM embeddings GROUP BY 1),
        p AS (SELECT unnest(['gain6_db', 'noise_gate', 'voice_eq']) AS profile, unnest(['gain-6db', 'noise-gate', 'voice-eq']) AS stem)
        SELECT recording_id, profile, 'store/recordings/' || recording_id || '/audio/normalized-16khz-mono.wav' AS source_path,
          'store/recordings/' || recording_id || '/audio/profiles/' || stem || '.wav' AS output_path, frame_count * 1000000 // 16000 AS duration_us, frame_count FROM t, p"""
    q["resample"] = _resample(24_000)
    q["upsample"] = _resample(11_025)
    left = "floor(greatest(least(CAST(s AS DOUBLE), 3.0), -3.0) * 10000)"
    mono = f"CAST(({left} + floor({left} / 2)) / 65536 AS FLOAT)"
    q["stereo_files"] = _resample(8_000).replace("sig AS (SELECT vec_id, recording_id, s,", f"sig AS (SELECT vec_id, recording_id, {mono} AS s,").replace(
        "AS sample", "AS sample, 2 * q.n AS frame_count, 2 * q.n * 1000000 // 16000 AS duration_us"
    )
    q["reblock"] = f"""WITH {VECTORS} SELECT recording_id, f // 100 AS block_no, f // 100 * 100 AS first_frame, n AS total_frames, count(*) AS n_samples FROM sig GROUP BY 1, 2, 3, 4"""
    q["waveform_peaks"] = f"""WITH {VECTORS} SELECT recording_id, f * least(180, n) // n AS bin, {_rounded('max(abs(s))')} AS peak FROM sig GROUP BY 1, 2"""
    q["peaks_of_empty"] = f"""WITH {VECTORS} SELECT recording_id, 'original' AS profile, f * least(7, n) // n AS bin, {_rounded('max(abs(s))')} AS peak FROM sig
          WHERE CAST(recording_id AS BIGINT) % 3 <> 0 GROUP BY 1, 2, 3
        UNION ALL SELECT DISTINCT recording_id, 'original', 0, 0 FROM sig WHERE CAST(recording_id AS BIGINT) % 3 = 0"""
    q["cut_clips"] = f"""WITH {VECTORS}, {LABEL_CLIPS}, r AS (SELECT *, start_us * 16000 // 1000000 AS lo, least((end_us * 16000 + 999999) // 1000000, n) AS hi FROM lc)
        SELECT r.recording_id, r.clip_id, sig.f - r.lo AS frame_no, {_rounded('sig.s')} AS sample FROM r JOIN sig ON sig.recording_id = r.recording_id AND sig.f >= r.lo AND sig.f < r.hi"""
    q["cut_stored"] = q["cut_clips"] + " WHERE r.start_us % 30000 = 0"
    q["cut_rejects"] = f"""WITH {LABEL_CLIPS}, c AS (SELECT CAST(l_linenumber AS VARCHAR) AS recording_id, l_orderkey * 10 AS start_us, l_orderkey * 10 + l_partkey AS end_us FROM lineitem),
        j AS (SELECT c.*, lm.n, least(start_us * 16000 // 1000000, n) AS lo, least((end_us * 16000 + 999999) // 1000000, n) AS hi FROM c LEFT JOIN lm USING (recording_id)),
        k AS (SELECT recording_id, CASE WHEN n IS NULL THEN 'recording_not_prepared' WHEN end_us <= start_us OR end_us > n * 1000000 // 16000 THEN 'invalid_clip_range' WHEN lo >= hi THEN 'empty_clip' END AS reason_code FROM j)
        SELECT recording_id, reason_code, count(*) AS n_clips FROM k WHERE reason_code IS NOT NULL GROUP BY 1, 2"""
    q["level_stats"] = f"""WITH {VECTORS}, {PROFILES} SELECT recording_id, profile, count(*) AS n_samples,
        round(count(*) FILTER (WHERE abs(s) < CAST(0.02 AS FLOAT)) / count(*), 6) AS gated_share, {_rounded('max(abs(s))')} AS peak,
        round(sqrt(sum(CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) / count(*)), 6) AS rms FROM pr GROUP BY 1, 2"""
    q["power_spectrum"] = f"""WITH {VECTORS}, w AS (SELECT vec_id, i, CAST(s AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM sig), k AS (SELECT unnest(range(33)) AS bin),
        d AS (SELECT vec_id, bin, sum(v * cos(2 * pi() * bin * i / 64)) AS re, sum(v * sin(2 * pi() * bin * i / 64)) AS im FROM w, k GROUP BY 1, 2)
        SELECT vec_id, bin, round(re * re + im * im, 5) AS power FROM d"""
    q["log_mel"] = _mel_levels("SELECT recording_id, 'all#' || f // 480000 AS window_id, f % 480000 AS f, s, least(480000, n - f // 480000 * 480000) AS n FROM sig")
    q["spectrogram_stats"] = f"""SELECT recording_id, window_id, CAST(3000 AS BIGINT) AS n_frames, min(min_level) AS min_value, max(max_level) AS max_value
        FROM ({_mel_levels("SELECT recording_id, 'all#' || f // 480000 AS window_id, f % 480000 AS f, s, least(480000, n - f // 480000 * 480000) AS n FROM sig")}) GROUP BY 1, 2"""
    q["window_samples"] = """WITH l AS (SELECT CAST(l_linenumber AS VARCHAR) AS recording_id, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
          row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS b FROM lineitem),
        x AS (SELECT recording_id, (b * 64 + i) // 480000 AS window_no, (cents + i * part) % 128 - 64 AS v FROM l, (SELECT unnest(range(64)) AS i))
        SELECT recording_id, 'all#' || window_no AS window_id, window_no, count(*) AS n_samples, CAST(sum(v) AS BIGINT) AS sum_64ths FROM x GROUP BY 1, 2, 3"""

    toks = """u AS (SELECT CAST(user_id AS VARCHAR) AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, event_type AS token FROM events),
        r AS (SELECT *, token = lag(token, 1) OVER w AND token = lag(token, 2) OVER w AND token = lag(token, 3) OVER w AS rep FROM u WHERE step < 64 WINDOW w AS (PARTITION BY clip_id ORDER BY step)),
        z AS (SELECT clip_id, min(step) FILTER (WHERE token = 'purchase') AS e, min(step) FILTER (WHERE rep) AS c FROM r GROUP BY 1),
        g AS (SELECT *, CASE WHEN e IS NOT NULL AND (c IS NULL OR e < c) THEN 'end_of_text' WHEN c IS NOT NULL THEN 'repeated_token_collapse' ELSE 'max_decode_tokens' END AS stop_reason FROM z),
        kept AS (SELECT r.clip_id, step, token, stop_reason FROM r JOIN g USING (clip_id) WHERE CASE stop_reason WHEN 'end_of_text' THEN step < e WHEN 'repeated_token_collapse' THEN step <= c ELSE true END)"""
    q["cut_tokens"] = f"WITH {toks} SELECT * FROM kept"
    limited = toks.replace("FROM u WHERE step < 64 WINDOW", "FROM u WHERE step < 64 - CAST(clip_id AS BIGINT) % 60 WINDOW")
    q["cut_tokens_limited"] = f"WITH {limited} SELECT * FROM kept WHERE token <> 'error'"
    q["stop_reasons"] = f"WITH {toks} SELECT g.clip_id, count(kept.step) AS n_tokens, g.stop_reason FROM g LEFT JOIN kept USING (clip_id) GROUP BY 1, 3"
    q["pending_work"] = f"""WITH {LINES}, done AS (SELECT DISTINCT recording_id, clip_id FROM li WHERE line_status = 'F')
        SELECT recording_id, clip_id, start_us, end_us, status FROM li WHERE status IN ('pending', 'failed')
          AND NOT EXISTS (SELECT 1 FROM done WHERE done.recording_id = li.recording_id AND done.clip_id = li.clip_id)"""
    q["transcribe_fixed"] = f"""WITH {LABEL_CLIPS} SELECT recording_id, clip_id, start_us, 'raw_asr' AS provenance, '[fake transcription]' AS text, CAST(NULL AS VARCHAR) AS error, 'fake' AS backend_id FROM lc"""
    checked = f"""{VECTORS}, {LABEL_CLIPS}, r AS (SELECT *, start_us * 16000 // 1000000 AS lo, least((end_us * 16000 + 999999) // 1000000, n) AS hi FROM lc),
        h AS (SELECT r.recording_id, r.clip_id, r.start_us, count(*) AS n, count(*) FILTER (WHERE abs(sig.s) > CAST(0.1 AS FLOAT)) AS loud FROM r JOIN sig ON sig.recording_id = r.recording_id AND sig.f >= r.lo AND sig.f < r.hi GROUP BY 1, 2, 3),
        o AS (SELECT recording_id, clip_id, start_us, CASE WHEN loud % 5 = 4 THEN NULL ELSE 'raw_asr' END AS provenance, CASE WHEN loud % 5 = 4 THEN NULL ELSE loud || ' of ' || n END AS text,
            CASE WHEN loud % 5 = 4 THEN 'no speech in ' || n || ' samples' END AS error FROM h
          UNION ALL SELECT recording_id, recording_id || '-past', 5, NULL, NULL, 'invalid_clip_range' FROM lm)"""
    q["transcribe_checked"] = f"WITH {checked} SELECT * FROM o"
    q["transcribe_events"] = f"""WITH {checked}
        SELECT recording_id, start_us * 2 AS ordinal, 'begin_transcription' AS kind, clip_id, NULL AS provenance, NULL AS text, NULL AS reason FROM o
        UNION ALL SELECT recording_id, start_us * 2 + 1, CASE WHEN error IS NULL THEN 'commit_transcript' ELSE 'fail_transcription' END, clip_id, provenance, text, error FROM o"""
    q["text_outcomes"] = f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS recording_id, conv_id || '-' || (turn // 2) AS clip_id, turn, {trim('text')} AS tx FROM conversations),
        g AS (SELECT recording_id, clip_id, coalesce(string_agg(tx, ' ' ORDER BY turn) FILTER (WHERE tx <> ''), '') AS text FROM t GROUP BY 1, 2)
        SELECT recording_id, clip_id, nullif(text, '') AS text, CASE WHEN text = '' THEN 'empty_transcript' END AS error FROM g"""
    q["live_level"] = f"""SELECT CAST(user_id AS VARCHAR) AS recording_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS window_start_us, count(*) AS n_samples,
        {_rounded('max(abs(CAST(value AS FLOAT)))')} AS peak FROM events GROUP BY 1, 2"""
    q["clip_windows"] = f"""WITH {LINES}, w AS (SELECT recording_id, duration_us, unnest(range((duration_us - 1) // 30000000 + 1)) AS window_no FROM media WHERE duration_us > 0)
        SELECT recording_id, 'all#' || window_no AS window_id, window_no, 7 + window_no * 30000000 AS start_us,
          least(7 + (window_no + 1) * 30000000, duration_us + 7) AS end_us, duration_us > 30000000 AS is_long FROM w"""
    q["transcribable"] = """SELECT l_orderkey, l_partkey,
        CASE WHEN l_linestatus = 'O' THEN 'empty_audio_path' WHEN l_returnflag = 'N' OR l_linenumber > 5 THEN 'not_16khz_mono' END AS transcribe_code,
        CASE WHEN l_returnflag = 'N' OR l_linenumber > 5 THEN 'profile_needs_16khz_mono' END AS profile_code FROM lineitem"""
    q["block_faults"] = """SELECT CAST(a.label AS VARCHAR) AS recording_id, 'original' AS profile, a.vec_id AS block_no, 'block_missing_before' AS reason_code
        FROM embeddings a LEFT JOIN embeddings b ON b.label = a.label AND b.vec_id = a.vec_id - 1 WHERE b.vec_id IS NULL AND a.vec_id > 0"""
    packets = """p AS (SELECT CAST(conv_id AS VARCHAR) AS recording_id, turn, role = 'assistant' AS stop,
        CASE WHEN role = 'system' THEN 480 ELSE strlen(text) // 2 END AS n FROM conversations)"""
    q["capture_blocks"] = f"""WITH {packets} SELECT recording_id, row_number() OVER w - 1 AS block_no, CAST(sum(n) OVER w - n AS BIGINT) AS first_frame,
        CAST(sum(n) OVER (PARTITION BY recording_id) AS BIGINT) AS total_frames, n AS n_samples FROM p WHERE n > 0
        WINDOW w AS (PARTITION BY recording_id ORDER BY turn)"""
    q["stream_blocks"] = q["capture_blocks"]
    q["stream_placed"] = f"""WITH {packets}, b AS (SELECT recording_id, turn, n, sum(least(n, 1)) OVER w - least(n, 1) AS block_no, sum(n) OVER w - n AS first_frame FROM p
          WINDOW w AS (PARTITION BY recording_id ORDER BY turn))
        SELECT recording_id, CAST(turn AS BIGINT) AS packet_no, CASE WHEN turn > 5 THEN 'recording_ended' WHEN n = 0 THEN 'no_frames' ELSE 'placed' END AS outcome,
          CASE WHEN turn <= 5 AND n > 0 THEN CAST(block_no AS BIGINT) END AS block_no, CASE WHEN turn <= 5 AND n > 0 THEN CAST(first_frame AS BIGINT) END AS first_frame,
          CAST(NULL AS BIGINT) AS total_frames, CASE WHEN turn <= 5 AND n > 0 THEN CAST(n AS BIGINT) END AS n_samples FROM b
        UNION ALL SELECT recording_id, NULL, CASE WHEN first_frame + n > 0 THEN 'saved' ELSE 'failed' END, CAST(block_no + least(n, 1) AS BIGINT), NULL,
          CAST(first_frame + n AS BIGINT), NULL FROM b WHERE turn = 5"""
    q["stream_capture"] = f"""WITH {packets}, e AS (SELECT recording_id, min(turn) AS st FROM p WHERE stop GROUP BY 1),
        f AS (SELECT recording_id, CAST(sum(n) AS BIGINT) AS n FROM p JOIN e USING (recording_id) WHERE turn <= st GROUP BY 1), ids AS (SELECT DISTINCT recording_id FROM p)
        SELECT recording_id, 'recording_created' AS kind, NULL AS reason, NULL AS sample_rate_hz, NULL AS frame_count, NULL AS duration_us FROM ids
        UNION ALL SELECT recording_id, 'recording_started', NULL, NULL, NULL, NULL FROM ids
        UNION ALL SELECT recording_id, CASE WHEN n = 0 THEN 'recording_failed' ELSE 'recording_saved' END,
          CASE WHEN n = 0 THEN 'microphone recording stopped before any audio frames were captured' END, 16000, n, n * 1000000 // 16000 FROM f
        UNION ALL SELECT recording_id, 'packets_rejected', 'recording_ended', NULL, count(*), NULL FROM p JOIN e USING (recording_id) WHERE turn > st GROUP BY 1"""
    q["stream_replay"] = f"""WITH s AS (SELECT conv_id, min(turn) AS st FROM conversations WHERE role = 'system' GROUP BY 1),
        l AS (SELECT conv_id, 1 AS sequence, 'recording_created' AS kind FROM conversations WHERE turn = 0
          UNION ALL SELECT conv_id, turn * 3 + 2, 'clip_added' FROM conversations
          UNION ALL SELECT conv_id, turn * 3 + 3, CASE WHEN role = 'system' THEN 'clip_deleted' ELSE 'transcription_started' END FROM conversations
          UNION ALL SELECT conv_id, turn * 3 + 4, 'transcript_committed' FROM conversations)
        SELECT CAST(conv_id AS VARCHAR) AS recording_id, sequence, kind,
          CASE WHEN st IS NULL OR sequence < st * 3 + 4 THEN 'accepted' WHEN sequence = st * 3 + 4 THEN 'clip_deleted' ELSE 'log_closed' END AS outcome FROM l LEFT JOIN s USING (conv_id)"""
    q["stream_growing_logs"] = f"""SELECT kind, outcome, count(*) AS n_records, CAST(sum(sequence) AS BIGINT) AS sum_sequence, count(DISTINCT recording_id) AS n_recordings FROM ({q["stream_replay"]}) GROUP BY 1, 2"""
    q["stream_commands"] = """SELECT CAST(conv_id AS VARCHAR) AS recording_id, 'created' AS status, 1 + 3 * count(*) - count(*) FILTER (WHERE role = 'system') AS last_sequence,
        count(*) AS n_clips, count(*) FILTER (WHERE role = 'system') AS n_deleted, count(*) * (count(*) - 1) // 2 AS sum_positions,
        nullif(count(*) FILTER (WHERE role <> 'system'), 0) AS n_transcripts, nullif(count(*) FILTER (WHERE role = 'system'), 0) AS n_refused,
        max(CASE WHEN role = 'system' THEN 'clip_deleted' END) AS reason_code FROM conversations GROUP BY conv_id"""
    q["stream_snapshots"] = f"""WITH {CONV_LOG} SELECT recording_id, 'created' AS status, 1 + 3 * count(*) - count(*) FILTER (WHERE stops) AS last_sequence,
        count(*) AS n_clips, count(*) FILTER (WHERE stops) AS n_deleted, count(*) * (count(*) - 1) // 2 AS sum_positions,
        nullif(count(*) FILTER (WHERE NOT stops), 0) AS n_transcripts FROM lt GROUP BY recording_id"""
    q["capture_report"] = f"""WITH {packets} SELECT recording_id, 16000 AS sample_rate_hz, CAST(sum(n) AS BIGINT) AS frame_count,
        CAST(sum(n) * 1000000 // 16000 AS BIGINT) AS duration_us, bool_or(stop) AS stopped FROM p GROUP BY 1"""
    return q
