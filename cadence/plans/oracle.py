"""The same rows as plans.queries gives, as SQL over the raw tables."""

from __future__ import annotations

TOKENS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
WORDS = rf"""
t AS (SELECT doc_id AS recording_id, CAST(unnest(range(0, len(ws))) AS BIGINT) AS pos, unnest(ws) AS word FROM (SELECT doc_id, {TOKENS} AS ws FROM documents)),
words AS (SELECT recording_id, CASE WHEN recording_id % 2 = 0 THEN 'kids' ELSE 'normal' END AS label, pos, word, CAST(s8 AS DOUBLE) / 8 AS start_sec,
  CAST(s8 + CASE WHEN (pos + recording_id) % 7 = 0 THEN 4 ELSE 2 END AS DOUBLE) / 8 AS end_sec
  FROM (SELECT *, 4 * pos + (pos - pos % 9) + CASE WHEN pos % 11 = 0 THEN 1 ELSE 0 END AS s8 FROM t))"""
PARTS = r"""CASE WHEN regexp_replace(word, '[^A-Za-z]', '', 'g') = '' THEN [word] ELSE string_split(replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(word, '[^A-Za-z]', '', 'g'), '(?i)([aeiouy].*[^aeiouyl])(e)$', '\1#\2'),
  '(?i)([^aeiouy#])([aeiouy]+)', '|\1\2', 'g'), '(?i)^([^aeiouy|]*)[|]', '\1'), '#', ''), '|') END"""
SYLLABLES = f"""
parts AS (SELECT *, {PARTS} AS parts FROM words),
u AS (SELECT recording_id, label, pos, CAST(unnest(range(0, len(parts))) AS BIGINT) AS i, unnest(parts) AS syllable, CAST(len(parts) AS BIGINT) AS n, start_sec AS s, end_sec AS e FROM parts),
units AS (SELECT recording_id, label, pos, i + 1 AS syllable_index, n AS syllable_count, syllable, s + i * ((e - s) / n) AS start_sec,
  CASE WHEN i = n - 1 THEN e ELSE s + (i + 1) * ((e - s) / n) END AS end_sec FROM u)"""
SIZES = f"sizes AS (SELECT doc_id AS recording_id, 3 * len({TOKENS}) AS n FROM documents)"


def _stats(units: str, keys: str) -> str:
    """Frames in closed intervals by their numbers: frame i lies at i / 4 seconds."""
    return f"""
{SIZES},
f AS (SELECT {keys}, recording_id AS r, unnest(range(CAST(ceil(4 * start_sec) AS BIGINT), CAST(floor(4 * end_sec) AS BIGINT) + 1)) AS i FROM {units}),
g AS (SELECT f.*, (r * 31 + i * 17) % 97 AS v FROM f JOIN sizes ON sizes.recording_id = r WHERE i < n AND r % 10 <> 9),
stats AS (SELECT {keys}, round(avg(75.0 + 5 * v), 2) AS pitch_mean_hz, round(var_pop(75.0 + 5 * v), 2) AS pitch_variance FROM g WHERE v >= 20 GROUP BY {keys})"""


WORD_FEATURES = f"""
WITH {WORDS}, {_stats('words', 'recording_id, pos')},
feats AS (SELECT w.recording_id, label, w.pos, word, start_sec, end_sec, pitch_mean_hz, pitch_variance,
  round(CASE WHEN lead(start_sec) OVER o IS NOT NULL THEN greatest(0.0, lead(start_sec) OVER o - end_sec) END, 3) AS pause_after_sec,
  round(greatest(1, len({PARTS})) / greatest(end_sec - start_sec, 1e-6), 3) AS speech_rate_sps
  FROM words w LEFT JOIN stats s ON s.recording_id = w.recording_id AND s.pos = w.pos WINDOW o AS (PARTITION BY w.recording_id ORDER BY w.pos))
"""
_MEASURES = ", ".join(
    f"round(avg({c}), 4) AS {c}_avg, round(stddev_samp({c}), 4) AS {c}_std, round(quantile_cont({c}, 0.5), 4) AS {c}_median, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS {c}_null_share"
    for c in ("pitch_mean_hz", "pitch_variance", "pause_after_sec", "speech_rate_sps")
)
SEGMENTS = r"""
tt AS (SELECT conv_id, turn, CAST(unnest(range(0, len(ws))) AS BIGINT) AS word_pos, unnest(ws) AS word FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM conversations)),
sound AS (SELECT conv_id AS recording_id, turn, word_pos, word, CAST(200 * turn + 4 * word_pos AS DOUBLE) / 8 AS start_sec, CAST(200 * turn + 4 * word_pos + 3 AS DOUBLE) / 8 AS end_sec
  FROM tt WHERE (turn + word_pos) % 19 <> 0 AND (turn + word_pos) % 13 <> 0 AND (turn + word_pos) % 17 <> 0),
usable AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY turn, word_pos) - 1 AS pos, word, start_sec, end_sec FROM sound)"""
LINES = """
ml AS (SELECT page_id // 100 AS file, 2 * page_id AS line_no, CASE WHEN page_id % 100 = 0 THEN 'kids' ELSE 'normal' END AS marker, NULL AS url FROM pages WHERE page_id % 50 = 0
  UNION ALL SELECT page_id // 100, 2 * page_id + 1, NULL, 'https://youtu.be/v' || CAST(page_id - page_id % 3 AS VARCHAR) FROM pages),
sec AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM ml),
ents AS (SELECT min(line_no) AS line_no, url, label FROM sec WHERE url IS NOT NULL AND label IS NOT NULL GROUP BY url, label),
man AS (SELECT row_number() OVER (ORDER BY line_no) AS manifest_index, url, label FROM ents)"""
FOUND = r"""
found AS (SELECT doc_id AS rank, CASE WHEN doc_id % 2 = 0 THEN 'youtube_kids' ELSE 'youtube' END AS source, 'v' || CAST(doc_id - doc_id % 3 AS VARCHAR) AS video_id,
  trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, source AS channel, n_chars % 900 AS duration FROM documents),
elig AS (SELECT * FROM found WHERE duration BETWEEN 100 AND 600)"""
VERIFIED = rf"""
WITH {FOUND},
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS k FROM elig) WHERE k = 1),
md AS (SELECT 'v' || CAST(doc_id - doc_id % 3 AS VARCHAR) AS video_id, doc_id, lang, n_chars % 900 AS duration, trim(regexp_replace('T' || split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title FROM documents
  WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY doc_id - doc_id % 3)),
verified AS (SELECT c.video_id, c.source, CASE WHEN m.doc_id % 3 = 0 THEN c.title ELSE m.title END AS title, c.channel, CAST(m.duration AS INTEGER) AS duration_seconds,
  CASE WHEN m.doc_id % 4 = 0 THEN 'english_search_candidate' ELSE m.lang END AS language, 'passed_unauthenticated_metadata_format_check' AS download_check
  FROM cand c JOIN md m USING (video_id) WHERE m.doc_id % 17 <> 0 AND m.doc_id % 11 <> 0 AND (m.doc_id % 4 = 0 OR m.lang LIKE 'en%') AND m.duration BETWEEN 0 AND 900)
"""
STATE = """
js AS (SELECT o_orderkey AS job_id, 'https://youtu.be/o' || CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_custkey % 2 = 0 THEN 'kids' ELSE 'normal' END AS label,
  CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 29 = 0 THEN 'interrupted' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'pending' END AS status,
  o_custkey % 3 AS attempts FROM orders),
outs AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_quantity < 25)"""
_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "processing", "completed", "failed", "interrupted"))
EVENTS = """
ev AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'download' WHEN 1 THEN 'vocal_isolation' WHEN 2 THEN 'transcription_alignment' ELSE 'prosody_analysis' END AS stage FROM events)"""
#: What a job's events come to: its last event but progress fixes the status, and with what came after it the stage.
LIFE = f"""
WITH {EVENTS},
fixed AS (SELECT *, max(CASE WHEN kind <> 'progress' THEN (ts, seq) END) OVER (PARTITION BY job_id) AS fixed_at FROM ev),
life AS (SELECT job_id, coalesce(max(CASE WHEN (ts, seq) = fixed_at THEN kind END), 'none') AS k, max(CASE WHEN (ts, seq) = fixed_at THEN stage END) AS own_stage,
  arg_max(stage, (ts, seq)) FILTER (kind = 'progress' AND (ts, seq) > fixed_at) AS moved, count(*) FILTER (kind = 'started') AS attempts, count(*) AS n_events,
  arg_max(CASE WHEN kind = 'failed' THEN 'failed in ' || stage ELSE '' END, (ts, seq)) FILTER (kind IN ('started', 'completed', 'failed')) AS err FROM fixed GROUP BY job_id),
jobs AS (SELECT job_id, CASE k WHEN 'started' THEN 'processing' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'queued' END AS status,
  CASE k WHEN 'started' THEN coalesce(moved, 'initializing') WHEN 'completed' THEN 'finished' WHEN 'failed' THEN own_stage ELSE 'waiting' END AS stage,
  attempts, nullif(err, '') AS error, n_events FROM life)
"""
CAPTIONS = f"""
WITH {WORDS},
b AS (SELECT *, CASE WHEN start_sec - lag(end_sec) OVER o > 0.6 OR regexp_matches(lag(word) OVER o, '[.?!]["'']*$') THEN 1 ELSE 0 END AS hard FROM words WINDOW o AS (PARTITION BY recording_id ORDER BY pos)),
st AS (SELECT *, sum(hard) OVER (PARTITION BY recording_id ORDER BY pos) AS stretch FROM b),
folded AS (SELECT recording_id, stretch, list(pos ORDER BY pos) AS ps, list_reduce(list_prepend({{'c': 0, 'd': []::INTEGER[]}}, list({{'c': length(word), 'd': []::INTEGER[]}} ORDER BY pos)),
  lambda a, x: {{'c': CASE WHEN a.c > 0 AND a.c + x.c + 1 > 38 THEN x.c + 1 ELSE a.c + x.c + 1 END, 'd': list_append(a.d, CASE WHEN a.c > 0 AND a.c + x.c + 1 > 38 THEN 1 ELSE 0 END)}}) AS z
  FROM st GROUP BY recording_id, stretch),
opened AS (SELECT recording_id, unnest(ps) AS pos, unnest(z.d) AS soft, unnest(range(0, len(ps))) AS k FROM folded),
capt AS (SELECT recording_id, pos, CAST(sum(CASE WHEN soft = 1 OR k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY pos) - 1 AS BIGINT) AS line FROM opened)
"""

INFO_TEXT = r"""'“' || translate(word, '\\{}', '/()') || '”    pitch ' || coalesce(printf('%.0f Hz', pitch_mean_hz), '—') || '    pause after ' || coalesce(printf('%.2f s', pause_after_sec), '—')
  || '    rate ' || printf('%.1f syl/s', speech_rate_sps)"""
#: Syllables that begin in a line: both stand under buckets of five seconds, so that they are joined by equal keys.
IN_LINES = """
one AS (SELECT recording_id, line, min(start_sec) AS first_start, arg_max(end_sec, pos) AS last_end, min(pos) AS first_pos, max(pos) AS last_pos FROM capt JOIN words USING (recording_id, pos) GROUP BY 1, 2),
spread AS (SELECT *, unnest(range(CAST(floor((first_start - 0.005::DOUBLE) / 5) AS BIGINT), CAST(floor((last_end + 0.005::DOUBLE) / 5) AS BIGINT) + 1)) AS bucket FROM one),
inl AS (SELECT o.recording_id, line, pos, syllable_index, syllable_count, syllable, start_sec, end_sec
  FROM spread o JOIN units x ON x.recording_id = o.recording_id AND CAST(floor(x.start_sec / 5) AS BIGINT) = bucket AND x.start_sec >= first_start - 0.005::DOUBLE AND x.start_sec <= last_end + 0.005::DOUBLE)"""


def _cs(x: str) -> str:
    return f"CAST(round_even({x} * 100, 0) AS BIGINT)"


def _clock(x: str) -> str:
    """h:mm:ss.cc of a time in seconds."""
    c = _cs(f"greatest({x}, 0.0::DOUBLE)")
    return f"CAST({c} // 360000 AS VARCHAR) || ':' || lpad(CAST({c} // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"


def _dialogue(layer: int, start: str, end: str, style: str, margin: str, text: str) -> str:
    return f"'Dialogue: {layer},' || {_clock(start)} || ',' || {_clock(end)} || ',{style},,0,0,' || {margin} || ',,' || {text}"


def _sung(name: str, rows: str) -> str:
    """One command string per line of rows(recording_id, line, line_start, line_end, k1, k2, s, e, shown), in the order of k1, k2."""
    return rf"""
{name}_b AS (SELECT *, greatest({_cs('line_start')}, coalesce(max(greatest({_cs('s')}, {_cs('e')})) OVER (PARTITION BY recording_id, line ORDER BY k0, k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {_cs('line_start')})) AS b FROM ({rows})),
{name}_p AS (SELECT *, greatest(0, {_cs('s')} - b) AS gap, greatest({_cs('e')}, greatest(b, {_cs('s')})) - greatest(b, {_cs('s')}) AS len FROM {name}_b),
{name} AS (SELECT recording_id, line, line_start, line_end, string_agg(CASE WHEN gap > 0 THEN '{{\k' || CAST(gap AS VARCHAR) || '}}' ELSE '' END || '{{\k' || CAST(len AS VARCHAR) || '}}' || translate(shown, '\{{}}', '/()'), '' ORDER BY k0, k1, k2) AS text
  FROM {name}_p GROUP BY 1, 2, 3, 4)"""


LABELS = ((215, "WORDS · WhisperX forced alignment"), (355, "SYLLABLES · estimated within each word"), (525, "PROSODY · Praat / Parselmouth"))
_STATS = _stats("words", "recording_id, pos").replace("f AS", "fr AS").replace("FROM f JOIN", "FROM fr JOIN").replace("SELECT f.*", "SELECT fr.*")
#: All event lines of all recordings, in the order of (grp, line, pos).
CAPTION_EVENTS = CAPTIONS + f""", {SYLLABLES}, {_STATS}, {IN_LINES},
ends AS (SELECT *, greatest(least(last_end + 0.4, coalesce(lead(first_start) OVER (PARTITION BY recording_id ORDER BY line) - 0.25, last_end + 2.0)), last_end) AS line_end FROM one),
lt AS (SELECT *, greatest(first_start - 0.25, coalesce(lag(line_end) OVER (PARTITION BY recording_id ORDER BY line), 0.0)) AS line_start FROM ends),
{_sung('sw', "SELECT recording_id, line, line_start, line_end, 0 AS k0, pos AS k1, 0 AS k2, start_sec AS s, end_sec AS e, word || CASE WHEN pos = last_pos THEN '' ELSE ' ' END AS shown FROM capt JOIN words USING (recording_id, pos) JOIN lt USING (recording_id, line)")},
{_sung('ss', "SELECT recording_id, line, line_start, line_end, start_sec AS k0, pos AS k1, syllable_index AS k2, start_sec AS s, end_sec AS e, syllable || CASE WHEN syllable_index = syllable_count THEN '  ' ELSE '·' END AS shown FROM inl JOIN lt USING (recording_id, line)")},
feats AS (SELECT w.recording_id, w.pos, word, start_sec, end_sec, pitch_mean_hz, lead(start_sec) OVER o AS nxt,
  round(CASE WHEN lead(start_sec) OVER o IS NOT NULL THEN greatest(0.0, lead(start_sec) OVER o - end_sec) END, 3) AS pause_after_sec, round(greatest(1, len({PARTS})) / greatest(end_sec - start_sec, 1e-6), 3) AS speech_rate_sps
  FROM words w LEFT JOIN stats s ON s.recording_id = w.recording_id AND s.pos = w.pos WINDOW o AS (PARTITION BY w.recording_id ORDER BY w.pos)),
heads AS (SELECT doc_id AS recording_id, CASE WHEN doc_id % 2 = 0 THEN 'kids' ELSE 'normal' END || ' · https://youtu.be/d' || CAST(doc_id AS VARCHAR) AS title, coalesce(stop, 0.0) + 5.0::DOUBLE AS stop
  FROM documents LEFT JOIN (SELECT recording_id, arg_max(end_sec, pos) AS stop FROM words GROUP BY 1) ON recording_id = doc_id),
events_of AS (SELECT recording_id, 0 AS grp, 0::BIGINT AS line, 0::BIGINT AS pos, {_dialogue(0, '0.0::DOUBLE', 'stop', 'Title', "'0'", r"translate(title, '\{}', '/()')")} AS event FROM heads
  {' '.join(f"UNION ALL SELECT recording_id, 0, 0, {k + 1}, " + _dialogue(0, '0.0::DOUBLE', 'stop', 'Label', f"'{top}'", f"'{label}'") + ' FROM heads' for k, (top, label) in enumerate(LABELS))}
  UNION ALL SELECT recording_id, 1, line, 0, {_dialogue(1, 'line_start', 'line_end', 'Words', "'0'", 'text')} FROM sw
  UNION ALL SELECT recording_id, 1, line, 1, {_dialogue(1, 'line_start', 'line_end', 'Syll', "'0'", 'text')} FROM ss
  UNION ALL SELECT recording_id, 2, pos, 0, {_dialogue(2, 'start_sec', 'greatest(least(end_sec + 0.3, coalesce(nxt, end_sec + 1)), end_sec)', 'Info', "'0'", INFO_TEXT)} FROM feats)
"""

SQL: dict[str, str] = {
    "syllabify": f"WITH {WORDS} SELECT recording_id, pos, array_to_string({PARTS}, '|') AS syllables, CAST(greatest(1, len({PARTS})) AS BIGINT) AS n FROM words",
    "syllable_units": f"WITH {WORDS}, {SYLLABLES} SELECT recording_id, pos, syllable_index, syllable_count, syllable, start_sec, end_sec FROM units",
    "word_features": WORD_FEATURES + "SELECT * FROM feats",
    "syllable_features": f"""WITH {WORDS}, {SYLLABLES}, {_stats('units', 'recording_id, pos, syllable_index')}
        SELECT w.recording_id, w.pos, w.syllable_index, syllable, pitch_mean_hz, pitch_variance,
        round(CASE WHEN lead(start_sec) OVER o IS NOT NULL THEN greatest(0.0, lead(start_sec) OVER o - end_sec) END, 3) AS pause_after_sec, round(1.0::DOUBLE / greatest(end_sec - start_sec, 1e-6), 3) AS speech_rate_sps
        FROM units w LEFT JOIN stats s ON s.recording_id = w.recording_id AND s.pos = w.pos AND s.syllable_index = w.syllable_index
        WINDOW o AS (PARTITION BY w.recording_id ORDER BY w.pos, w.syllable_index)""",
    "compare_labels_once": WORD_FEATURES + " UNION ALL ".join(f"SELECT label, '{n}' AS feature, count({n}) AS n, TRUE AS in_bound FROM feats GROUP BY label" for n in ("pitch_mean_hz", "pitch_variance", "pause_after_sec", "speech_rate_sps")),
    "compare_labels": WORD_FEATURES + f"SELECT label, count(*) AS n_words, count(DISTINCT recording_id) AS n_recordings, {_MEASURES} FROM feats GROUP BY label",
    "usable_words": f"WITH {SEGMENTS} SELECT * FROM usable",
    "nest_payload": f"WITH {SEGMENTS} SELECT recording_id, pos, word, start_sec AS start_time, end_sec AS end_time FROM usable",
    "record_counts": f"""WITH {WORDS} SELECT doc_id AS recording_id, coalesce(n_words, 0) AS n_words, coalesce(n_syllables, 0) AS n_syllables, coalesce(n_words + n_syllables, 0) AS n_records
        FROM documents LEFT JOIN (SELECT recording_id, count(*) AS n_words, CAST(sum(len({PARTS})) AS BIGINT) AS n_syllables FROM words GROUP BY 1) ON recording_id = doc_id""",
    "manifest_index": f"WITH {LINES} SELECT * FROM man",
    "manifest_rejects": f"""WITH {LINES} SELECT line_no, 'ftp://elsewhere' AS line, 'unsupported url' AS reason FROM sec WHERE line_no % 14 = 3""",
    "shards": f"WITH {LINES} SELECT manifest_index, (manifest_index - 1) % 4 AS shard, url FROM man",
    "shards_complete_disjoint": f"WITH {LINES} SELECT (manifest_index - 1) % 4 AS shard, count(*) AS n, CAST(sum(manifest_index) AS BIGINT) AS index_sum, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM man GROUP BY 1",
    "label_overlap": f"WITH {LINES} SELECT url, count(DISTINCT label) AS n_labels FROM ents GROUP BY url HAVING count(DISTINCT label) > 1",
    "output_names": f"""WITH {LINES} SELECT line_no, substr(url, 18) AS key, label || '/video_' || CASE WHEN line_no < 10000 THEN lpad(CAST(line_no AS VARCHAR), 4, '0') ELSE CAST(line_no AS VARCHAR) END || '_' || substr(url, 18) || '.json' AS output, TRUE AS supported FROM ents""",
    "video_key": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a-' || CAST(page_id AS VARCHAR) WHEN 1 THEN CAST(page_id AS VARCHAR) || '_x' ELSE 'video' END AS key FROM pages",
    "clean": r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS cleaned FROM documents",
    "kids_genre": """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'song|rhymes|music|bum|goose') THEN 'music' WHEN regexp_matches(lower(text), 'story|read aloud|peppa') THEN 'stories/shows'
        WHEN regexp_matches(lower(text), 'science|experiment|scishow|nat geo|national geographic|brainpop|minuteearth') THEN 'science/learning' WHEN regexp_matches(lower(text), 'draw|craft') THEN 'art/crafts'
        WHEN regexp_matches(lower(text), 'yoga') THEN 'movement/yoga' WHEN regexp_matches(lower(text), 'numberblocks|math') THEN 'math' ELSE 'educational/entertainment' END AS genre FROM documents""",
    "search_tasks": "SELECT p_partkey AS task_no, CAST(y AS INTEGER) AS search_year, 'part ' || CAST(p_partkey AS VARCHAR) || ' ' || CAST(y AS VARCHAR) AS search_query FROM part CROSS JOIN range(2008, 2026) t(y)",
    "eligible_candidates": f"""WITH {FOUND} SELECT rank, source, CASE WHEN source = 'youtube_kids' THEN 'kids_candidate' ELSE 'normal_youtube' END AS classification, title, channel, CAST(duration AS INTEGER) AS duration_seconds, video_id,
        'https://www.youtube.com/watch?v=' || video_id AS url, CASE WHEN source = 'youtube_kids' THEN 'https://www.youtubekids.com/watch/' || video_id ELSE '' END AS kids_url
        FROM (SELECT *, row_number() OVER (PARTITION BY source, video_id ORDER BY rank) AS k FROM elig) WHERE k = 1""",
    "per_query_limit": f"WITH {FOUND} SELECT rank, channel FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY rank) AS k FROM found) WHERE k <= 13",
    "verify_candidates": VERIFIED + "SELECT video_id, title, channel, duration_seconds, language, download_check FROM verified",
    "quota": VERIFIED + """SELECT label, video_id FROM (SELECT CASE WHEN source = 'youtube_kids' THEN 'kids' ELSE 'normal' END AS label, video_id,
        row_number() OVER (PARTITION BY source ORDER BY md5('20260920:' || video_id), video_id) AS k FROM verified) WHERE k <= 20""",
    "oversample": f"WITH {FOUND} SELECT rank, video_id FROM elig ORDER BY rank LIMIT 90",
    "collection_progress": VERIFIED + """SELECT count(*) AS checked, count(*) AS candidate_count, count(*) FILTER (c.source = 'youtube_kids' AND v.video_id IS NOT NULL) AS kids_verified,
        count(*) FILTER (c.source <> 'youtube_kids' AND v.video_id IS NOT NULL) AS normal_verified FROM cand c LEFT JOIN verified v USING (video_id)""",
    "access_rate": "SELECT source AS kind, count(*) AS n, count(*) FILTER (n_chars % 5 <> 0 AND doc_id % 7 <> 0) AS n_ok FROM documents GROUP BY source",
    "usable_outcome": "SELECT doc_id, n_chars % 5 <> 0 AND doc_id % 7 <> 0 AS ok, md5(CASE WHEN doc_id % 7 = 0 THEN 'timeout' WHEN n_chars % 5 <> 0 THEN '' ELSE right(text, 1000) END) AS error FROM documents",
    "sample_by_label": """SELECT label, video_id FROM (SELECT lang AS label, 'v' || CAST(doc_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY lang ORDER BY md5('20260920:v' || CAST(doc_id AS VARCHAR))) AS k
        FROM documents WHERE n_chars >= 500) WHERE k <= 10""",
    "resume": f"""WITH {STATE}, nm AS (SELECT job_id, label FROM js WHERE job_id % 10 <> 0 UNION ALL SELECT job_id + 1000000, label FROM js WHERE job_id % 50 = 1)
        SELECT nm.job_id AS manifest_index, 'https://youtu.be/o' || CAST(nm.job_id AS VARCHAR) AS url, nm.label, CASE WHEN js.status IN ('processing', 'interrupted') OR js.status IS NULL THEN 'pending' ELSE js.status END AS status,
        coalesce(js.attempts, 0) AS attempts FROM nm LEFT JOIN js ON js.job_id = nm.job_id AND js.label = nm.label""",
    "reopen_missing": f"""WITH {STATE} SELECT js.job_id, CASE WHEN status = 'completed' AND o.job_id IS NULL THEN 'pending' ELSE status END AS status,
        CASE WHEN status = 'completed' AND o.job_id IS NULL THEN 'output_missing' ELSE '' END AS stage_status FROM js LEFT JOIN outs o ON o.job_id = js.job_id""",
    "retry_failed": f"WITH {STATE} SELECT job_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM js",
    "pending_jobs": f"WITH {STATE} SELECT job_id, url, label FROM js WHERE status = 'pending'",
    "status_summary": f"WITH {STATE} SELECT label, {_COUNTS} FROM js GROUP BY GROUPING SETS ((label), ())",
    "shard_rollup": f"WITH {STATE} SELECT job_id % 8 AS shard, {_COUNTS} FROM js GROUP BY GROUPING SETS ((job_id % 8), ())",
    "final_status": f"WITH {STATE} SELECT CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 1 ELSE 0 END AS exit_code FROM js",
    "fold_progress": f"WITH {EVENTS} SELECT job_id, seq, ts, kind, stage FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS k FROM ev) WHERE k = 1",
    "lifecycle": LIFE + "SELECT job_id, status, stage, attempts, error, n_events FROM jobs",
    "attempt_number": f"WITH {EVENTS} SELECT job_id, seq, count(*) FILTER (kind = 'started') OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS attempt FROM ev",
    "job_list": LIFE + "SELECT job_id, status, stage, attempts FROM jobs",
    "job_summary": LIFE + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("queued", "processing", "completed", "failed")) + " FROM jobs",
    "result_lookup": f"""WITH {STATE}, asked AS (SELECT DISTINCT l_orderkey + l_linenumber * 1000 AS job_id FROM lineitem)
        SELECT a.job_id, CASE WHEN js.job_id IS NULL THEN 404 WHEN js.status <> 'completed' THEN 409 WHEN o.job_id IS NULL THEN 410 ELSE 200 END AS code
        FROM asked a LEFT JOIN js ON js.job_id = a.job_id LEFT JOIN outs o ON o.job_id = a.job_id""",
    "admit_jobs": """WITH r AS (SELECT event_id AS request_no, CASE WHEN user_id % 9 = 0 THEN 'https://example.com/' ELSE 'https://youtu.be/' END || CAST(user_id AS VARCHAR) AS url,
        CASE WHEN event_id % 7 = 0 THEN 'other' WHEN user_id % 2 = 0 THEN 'kids' ELSE 'normal' END AS label, CASE WHEN event_id % 11 = 0 THEN 'phone' WHEN user_id % 3 = 0 THEN 'word' ELSE 'both' END AS granularity,
        CASE WHEN event_id % 13 = 0 THEN 10 ELSE 75 END AS f, CASE WHEN event_id % 17 = 0 THEN 60 ELSE 600 END AS c FROM events),
        z AS (SELECT *, CASE WHEN NOT starts_with(url, 'https://youtu.be/') THEN 'unsupported url' WHEN label = 'other' THEN 'unknown label' WHEN granularity = 'phone' THEN 'unknown granularity'
          WHEN f < 20 OR f >= c THEN 'invalid pitch range' END AS reason FROM r)
        SELECT request_no, left(sha256(concat_ws('|', url, label, granularity, f, c)), 16) AS job_id, reason IS NULL AS accepted, reason FROM z""",
    "caption_lines": CAPTIONS + "SELECT recording_id, pos, line FROM capt",
    "caption_times": CAPTIONS + """, one AS (SELECT recording_id, line, min(start_sec) AS first_start, arg_max(end_sec, pos) AS last_end, min(pos) AS first_pos, max(pos) AS last_pos FROM capt JOIN words USING (recording_id, pos) GROUP BY 1, 2),
        ends AS (SELECT *, greatest(least(last_end + 0.4, coalesce(lead(first_start) OVER (PARTITION BY recording_id ORDER BY line) - 0.25, last_end + 2.0)), last_end) AS line_end FROM one)
        SELECT recording_id, line, first_pos, last_pos, round(greatest(first_start - 0.25, coalesce(lag(line_end) OVER (PARTITION BY recording_id ORDER BY line), 0.0)), 6)::DOUBLE AS line_start, round(line_end, 6)::DOUBLE AS line_end FROM ends""",
    "karaoke_segments": f"""WITH {WORDS}, cs AS (SELECT recording_id, pos, pos // 9 AS line, CAST(round_even(start_sec * 100, 0) AS BIGINT) AS s, CAST(round_even(end_sec * 100, 0) AS BIGINT) AS e, CAST(round_even((pos // 9) * 45.0::DOUBLE / 8 * 100, 0) AS BIGINT) AS f FROM words),
        bf AS (SELECT *, greatest(f, coalesce(max(greatest(s, e)) OVER (PARTITION BY recording_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f)) AS b FROM cs)
        SELECT recording_id, pos, greatest(0, s - b) AS gap_cs, greatest(e, greatest(b, s)) - greatest(b, s) AS length_cs FROM bf""",
    "word_info": f"""WITH {WORDS}, z AS (SELECT *, CAST(round_even(start_sec * 100, 0) AS BIGINT) AS c, coalesce(lead(start_sec) OVER (PARTITION BY recording_id ORDER BY pos), end_sec + 1) AS nxt FROM words)
        SELECT recording_id, pos, CAST(c // 360000 AS VARCHAR) || ':' || lpad(CAST(c // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS shown,
        round(greatest(least(end_sec + 0.3, nxt), end_sec), 6)::DOUBLE AS info_end, translate(word, '\\{{}}', '/()') AS word, regexp_matches(word, '[.?!]["'']*$') AS ends FROM z""",
    "syllables_in_lines": CAPTIONS + f""", {SYLLABLES}, {IN_LINES} SELECT recording_id, line, pos, syllable_index FROM inl""",
    "word_info_text": WORD_FEATURES + f"SELECT recording_id, pos, {INFO_TEXT} AS info FROM feats",
    "syllable_text": f"WITH {WORDS}, {SYLLABLES} SELECT recording_id, pos, syllable_index, syllable || CASE WHEN syllable_index = syllable_count THEN '  ' ELSE '·' END AS shown FROM units",
    "sorted_by_start": f"WITH {WORDS} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec - CASE WHEN pos % 5 = 0 THEN 2 ELSE 0 END, pos) - 1 AS pos, pos AS was FROM words",
    "payload_counts": f"WITH {SEGMENTS} SELECT c.conv_id AS recording_id, 'word' AS granularity, coalesce(n, 0) AS n_words FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT recording_id, count(*) AS n FROM usable GROUP BY 1) ON recording_id = conv_id",
    "labelled_manifest": f"""WITH {FOUND} SELECT CASE WHEN source = 'youtube_kids' THEN 0 ELSE 1 END AS section, rank AS position, 'https://youtu.be/' || video_id AS line FROM found WHERE rank % 17 <> 0
        UNION ALL VALUES (0, -1, '# LABEL: YOUTUBE_KIDS'), (1, -1, '# LABEL: NORMAL_YOUTUBE')""",
    "durations": """SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 60, 2) AS minutes, 'adult/general' AS age_group, n_chars BETWEEN 40 AND 1200 AND doc_id % 50 >= 20 AND doc_id % 50 < n_chars AS range_ok FROM documents""",
    "incremental_work": "SELECT DISTINCT user_id AS job_id, CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events",
    "map_recordings": """SELECT doc_id AS recording_id, CASE WHEN length(text) >= 100 THEN length(text) END AS n, CASE WHEN length(text) >= 100 THEN 'align-' || lang END AS aligner,
        CASE WHEN length(text) >= 100 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN length(text) < 100 THEN 'ValueError: too short' END AS error FROM documents""",
}
#: The watermark is the greatest time less an hour, in whole milliseconds; a gap of twelve hours interrupts an attempt.
SQL["stream_stuck_jobs"] = """
WITH e AS (SELECT user_id AS job_id, event_id AS seq, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'started' WHEN 'view' THEN 'progress'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS kind, CASE event_id % 4 WHEN 0 THEN 'download' WHEN 1 THEN 'vocal_isolation' WHEN 2 THEN 'transcription_alignment'
    ELSE 'prosody_analysis' END AS stage, (epoch_ms(max(ts) OVER ()) - 3600000) * 1000 AS mark FROM events),
d AS (SELECT *, count_if(kind <> 'progress') OVER o AS part, lead(us) OVER (PARTITION BY job_id ORDER BY us, seq) AS later FROM e WHERE us <= mark WINDOW o AS (PARTITION BY job_id ORDER BY us, seq)),
g AS (SELECT *, coalesce(later - 1, mark) - us >= 43200000000 AS gap FROM d),
s AS (SELECT job_id, part, arg_min(kind, (us, seq)) AS opens, arg_min(stage, (us, seq)) AS opens_stage, min(CASE WHEN gap THEN us END) AS cut FROM g GROUP BY ALL),
p AS (SELECT g.job_id, part, max(us) AS moved, arg_max(stage, (us, seq)) AS stage FROM g JOIN s USING (job_id, part) WHERE kind = 'progress' AND opens = 'started' AND us <= coalesce(cut, us) GROUP BY ALL),
newest AS (SELECT s.*, p.stage AS moved_to FROM s LEFT JOIN p USING (job_id, part) QUALIFY row_number() OVER (PARTITION BY s.job_id ORDER BY part DESC) = 1),
n AS (SELECT job_id, count(*) AS n_events, count_if(kind = 'started') AS attempts, max(us) AS seen_us,
    arg_max(CASE WHEN kind = 'failed' THEN 'failed in ' || stage ELSE '' END, (us, seq)) FILTER (kind IN ('started', 'completed', 'failed')) AS error FROM g GROUP BY 1),
x AS (SELECT job_id, count_if(opens = 'started' AND cut IS NOT NULL) AS interruptions FROM s GROUP BY 1)
SELECT job_id, CASE WHEN opens = 'started' THEN CASE WHEN cut IS NULL THEN 'processing' ELSE 'interrupted' END WHEN opens IN ('completed', 'failed') THEN opens ELSE 'queued' END AS status,
  CASE opens WHEN 'started' THEN coalesce(moved_to, 'initializing') WHEN 'completed' THEN 'finished' WHEN 'failed' THEN opens_stage ELSE 'waiting' END AS stage,
  CAST(attempts AS BIGINT) AS attempts, nullif(error, '') AS error, n_events, CAST(interruptions AS BIGINT) AS interruptions, seen_us
FROM newest JOIN n USING (job_id) JOIN x USING (job_id)"""
SQL["stream_fold_progress"] = SQL["fold_progress"]
SQL["stream_lifecycle"], SQL["stream_admission"], SQL["manifest_files"] = SQL["lifecycle"], SQL["admit_jobs"], SQL["manifest_index"]
SQL["caption_events"] = CAPTION_EVENTS + "SELECT recording_id, grp, line, pos, event FROM events_of"
SQL["caption_file"] = CAPTION_EVENTS + "SELECT recording_id, 17 + count(*) AS n_lines, sha256(string_agg(event, chr(10) ORDER BY grp, line, pos)) AS events FROM events_of GROUP BY 1"
SQL["caption_files"] = SQL["caption_file"]
SQL["result_files"] = f"""WITH {WORDS}, {SYLLABLES}, rec AS (SELECT recording_id, label, 'https://youtu.be/d' || CAST(recording_id AS VARCHAR) AS source_url FROM (SELECT DISTINCT recording_id, label FROM words))
    SELECT source_url, label, 'word' AS kind, pos, word AS part, start_sec AS start_time, end_sec AS end_time FROM words JOIN rec USING (recording_id, label)
    UNION ALL SELECT source_url, label, 'syllable', row_number() OVER (PARTITION BY recording_id ORDER BY pos, syllable_index) - 1, syllable, start_sec, end_sec FROM units JOIN rec USING (recording_id, label)"""
SQL["manifest_written"] = f"""WITH {FOUND} SELECT 'csv' AS form, CASE WHEN source = 'youtube_kids' THEN 'kids' ELSE 'normal' END AS label, rank AS position, 'https://youtu.be/' || video_id AS url FROM found
    UNION ALL SELECT 'json', CASE WHEN source = 'youtube_kids' THEN 'kids' ELSE 'normal' END, rank, 'https://youtu.be/' || video_id FROM found
    UNION ALL SELECT 'labelled', label, min(row_number) OVER (PARTITION BY label, url), url FROM (SELECT DISTINCT label, url, first AS row_number FROM (
      SELECT CASE WHEN source = 'youtube_kids' THEN 'kids' ELSE 'normal' END AS label, 'https://youtu.be/' || video_id AS url, min(rank) OVER (PARTITION BY source, video_id) AS first FROM found))"""
SQL["access_sample_files"] = """SELECT doc_id, kind, yt_dlp_ok, duration, title, form FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS kind, n_chars % 5 <> 0 AS yt_dlp_ok, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS DOUBLE) END AS duration,
    CASE WHEN doc_id % 2 = 1 THEN lang || ', "' || CAST(doc_id AS VARCHAR) || '"' END AS title FROM documents), (VALUES ('csv'), ('jsonl')) t(form)"""
SQL["state_snapshots"] = f"WITH {STATE} SELECT job_id, url, label, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, attempts, CAST(2 AS INTEGER) AS version FROM js"
SQL["all_sources"] = f"WITH {FOUND} SELECT rank, source, video_id FROM found UNION ALL SELECT rank, source, video_id FROM found WHERE source = 'youtube_kids'"
SQL["checked_at"] = "SELECT doc_id, TRUE AS in_form, TRUE AS is_now FROM documents"
SQL["payload_counts_both"] = f"""WITH {WORDS} SELECT doc_id AS recording_id, 'both' AS granularity, coalesce(n_words, 0) AS n_words, coalesce(n_syllables, 0) AS n_syllables
    FROM documents LEFT JOIN (SELECT recording_id, count(*) AS n_words, CAST(sum(len({PARTS})) AS BIGINT) AS n_syllables FROM words GROUP BY 1) ON recording_id = doc_id"""
SQL["supervised_recordings"] = """SELECT doc_id AS recording_id, CASE WHEN length(text) % 997 <> 13 THEN length(text) END AS n, CASE WHEN length(text) % 997 <> 13 THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN length(text) % 997 = 13 THEN 'ChildProcessError: the model''s process ended with code 3' END AS error FROM documents"""
SQL["requeue_service"] = f"""WITH {STATE} SELECT job_id, CASE WHEN status IN ('pending', 'processing') THEN 'queued' ELSE status END AS status,
    CASE WHEN status = 'processing' THEN 'restart_queued' ELSE 'running' END AS stage_status, CASE WHEN status = 'processing' THEN 'API restarted; job queued from the beginning.' ELSE '' END AS detail FROM js"""
SQL["result_arrays"] = f"""WITH {WORDS}, {SYLLABLES}, s AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY pos, syllable_index) - 1 AS at_pos FROM units)
    SELECT 'word' AS kind, pos, count(*) AS n, count(DISTINCT word) AS different, max(start_sec) AS latest FROM words GROUP BY pos
    UNION ALL SELECT 'syllable', at_pos, count(*), count(DISTINCT syllable), max(start_sec) FROM s GROUP BY at_pos"""
SQL["uploader_channel"] = VERIFIED + """SELECT video_id, CASE WHEN duration_seconds % 2 = 0 THEN 'u ' ELSE 'c ' END || duration_seconds AS channel FROM verified"""
SQL["voiced_in_spans"] = f"""WITH {WORDS}, {SIZES}, spans AS (SELECT recording_id, 'word' AS kind, pos AS span, start_sec, end_sec FROM words
  UNION ALL SELECT recording_id, 'nine', pos // 9, min(start_sec), max(end_sec) FROM words GROUP BY recording_id, pos // 9
  UNION ALL SELECT recording_id, 'recording', 0, min(start_sec), max(end_sec) FROM words GROUP BY recording_id),
 f AS (SELECT recording_id, kind, span, unnest(range(CAST(ceil(4 * start_sec) AS BIGINT), CAST(floor(4 * end_sec) AS BIGINT) + 1)) AS i FROM spans),
 g AS (SELECT recording_id, kind, span, count(*) AS n, sum(75 + 5 * ((recording_id * 31 + i * 17) % 97)) AS hz, max(i) / 4 AS last FROM f JOIN sizes USING (recording_id)
  WHERE i < sizes.n AND recording_id % 10 <> 9 AND (recording_id * 31 + i * 17) % 97 >= 20 GROUP BY recording_id, kind, span)
 SELECT s.recording_id, s.kind, CAST(s.span AS BIGINT) AS span, CAST(coalesce(n, 0) AS BIGINT) AS n_voiced, CAST(coalesce(hz, 0) AS BIGINT) AS hz_sum, CAST(last AS DOUBLE) AS last_voiced
 FROM spans s LEFT JOIN g ON g.recording_id = s.recording_id AND g.kind = s.kind AND g.span = s.span"""
