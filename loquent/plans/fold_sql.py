"""SQL of order-dependent queries, from their rules: windows where a rule looks at neighbours, recursion where it has state."""

from __future__ import annotations

from loquent.plans.intervals_queries import SEGMENTS, TOKENS

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Tokens with times in seconds.
SECONDS = f'{TOKENS}, tt AS (SELECT stream_id, seq, start_ms / 1000 AS start, end_ms / 1000 AS "end", text, CAST(turn % 2 + 1 AS INTEGER) AS speaker FROM timed)'


def _clock(seconds: str, hours: bool, mark: str) -> str:
    ms = f"CAST(round_even({seconds} * 1000, 0) AS BIGINT)"
    short = f"printf('%02d:%02d{mark}%03d', {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"
    return f"CASE WHEN {str(hours).lower()} OR {ms} >= 3600000 THEN printf('%02d:', {ms} // 3600000) ELSE '' END || {short}"


def cues(kind: str) -> str:
    text = "replace(trim(text), '-->', '->')"
    times = f"{_clock('start', kind == 'srt', ',' if kind == 'srt' else '.')} || ' --> ' || {_clock('stop', kind == 'srt', ',' if kind == 'srt' else '.')}"
    cue = {
        "txt": text,
        "tsv": f"CAST(round_even(start * 1000, 0) AS BIGINT) || chr(9) || CAST(round_even(stop * 1000, 0) AS BIGINT) || chr(9) || replace({text}, chr(9), ' ')",
        "json": f"CAST(to_json({{'id': number, 'start': start, 'end': stop, 'text': {text}}}) AS VARCHAR)",
        "vtt": f"{times} || chr(10) || {text} || chr(10)",
        "srt": f"number || chr(10) || {times} || chr(10) || {text} || chr(10)",
    }[kind]
    return f"""WITH {SECONDS}, c AS (SELECT stream_id, min(start) AS start, max("end") AS stop, string_agg(text, ' ' ORDER BY seq) AS text FROM tt GROUP BY stream_id, speaker, seq // 20), n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start) AS number FROM c) SELECT stream_id, number, {cue} AS cue FROM n"""


BLANKS = f"""WITH {SECONDS}, b AS (SELECT *, seq % 50 < 16 OR trim(text, {_SPACES}) IN ('[BLANK_AUDIO]', '[typing]') AS blank FROM tt), r AS (SELECT *, seq - row_number() OVER (PARTITION BY stream_id, blank ORDER BY seq) AS run FROM b)
SELECT stream_id, seq, start, "end", text, CAST(-1 AS INTEGER) AS speaker FROM r WHERE NOT blank UNION ALL SELECT stream_id, min(seq), min(start), max("end"), '', -2 FROM r WHERE blank GROUP BY stream_id, run HAVING max("end") - min(start) >= 4"""

MONOTONIC = f"""WITH RECURSIVE {SECONDS}, m AS (SELECT stream_id, seq, CASE WHEN seq % 7 = 3 THEN start - 0.4 :: DOUBLE ELSE start END AS start, "end" FROM tt),
r AS (SELECT stream_id, seq, start, greatest(start, "end") AS "end" FROM m WHERE seq = 0 UNION ALL SELECT stream_id, seq, start, greatest(start, "end") FROM (SELECT m.stream_id, m.seq, CASE WHEN m.start < r."end" THEN r."end" + 0.01 :: DOUBLE ELSE m.start END AS start, m."end" FROM r JOIN m ON m.stream_id = r.stream_id AND m.seq = r.seq + 1))
SELECT * FROM r"""

SENTENCES = f"""WITH {SECONDS}, e AS (SELECT *, regexp_matches(rtrim(text, {_SPACES}), '[.!?]$') AS ends FROM tt), s AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM e)
SELECT stream_id, CAST(sentence AS BIGINT) AS sentence, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY seq) AS text FROM s GROUP BY stream_id, sentence"""

TRUNCATED = f"""WITH {SECONDS}, w AS (SELECT stream_id, seq, start, CASE WHEN seq % 9 = 0 THEN "end" + 2 ELSE "end" END AS "end", text, trim(text, {_SPACES}) IN ('.', '!', '?', '。', '！', '？') AS mark FROM tt), l AS (SELECT *, lag(mark, 1, true) OVER (PARTITION BY stream_id ORDER BY seq) AS after_mark, "end" - start > 0.7 :: DOUBLE AS long FROM w)
SELECT stream_id, seq, CASE WHEN long AND NOT mark AND after_mark THEN "end" - 0.7 :: DOUBLE ELSE start END AS start, CASE WHEN long AND mark THEN start + 0.7 :: DOUBLE ELSE "end" END AS "end", text FROM l"""


def snapped(later: int, first: int) -> str:
    """Changes of speaker move to the nearest mark, the earlier one if both are as near; a token at the very time of a change
    still belongs to the speaker before."""
    return f"""WITH {TOKENS}, {SEGMENTS}, k AS (SELECT * FROM timed WHERE seq >= {first}), marks AS (SELECT stream_id, start_ms AS "at" FROM k WHERE regexp_matches(trim(text), '[.!?]\\n?$')),
c AS (SELECT stream_id, start_ms + {later} AS "at", speaker FROM segs), n AS (SELECT c.*, (SELECT max(m."at") FROM marks m WHERE m.stream_id = c.stream_id AND m."at" < c."at") AS b, (SELECT min(m."at") FROM marks m WHERE m.stream_id = c.stream_id AND m."at" >= c."at") AS a FROM c),
p AS (SELECT stream_id, speaker, CASE WHEN a IS NULL THEN coalesce(b, "at") WHEN b IS NOT NULL AND "at" - b <= a - "at" THEN b ELSE a END AS "at" FROM n)
SELECT k.stream_id, k.seq, coalesce(arg_max(p.speaker, p."at" * 100 + p.speaker), -1) AS speaker FROM k LEFT JOIN p ON p.stream_id = k.stream_id AND p."at" < k.start_ms GROUP BY 1, 2"""


_CALLS = """calls AS (SELECT user_id AS service, epoch_us(ts) / 1e6 AS "at", event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


def breaker(failures: int, rest: float, clear: bool = False, trials: int = 1) -> str:
    """State after each call: closed, open or half_open, with bad and good calls and the time of the last bad one."""
    kept = "0" if clear else "bad"
    return f"""WITH RECURSIVE {_CALLS},
r AS (SELECT service, 0 :: BIGINT AS i, 0 :: DOUBLE AS "at", '' AS state, false AS passed, 'closed' AS now, 0 AS bad, 0 AS good, 0 :: DOUBLE AS since FROM calls WHERE i = 1 UNION ALL
SELECT service, i, "at", state, passed,
 CASE WHEN NOT passed THEN 'open' WHEN ok AND state = 'half_open' THEN CASE WHEN good + 1 >= {trials} THEN 'closed' ELSE state END WHEN ok THEN state WHEN state = 'half_open' OR bad + 1 >= {failures} THEN 'open' ELSE state END,
 CASE WHEN NOT passed THEN bad WHEN ok AND state = 'half_open' THEN CASE WHEN good + 1 >= {trials} THEN 0 ELSE bad END WHEN ok THEN {kept} ELSE bad + 1 END,
 CASE WHEN passed AND ok AND state = 'half_open' THEN good + 1 ELSE good END, CASE WHEN passed AND NOT ok THEN "at" ELSE since END
FROM (SELECT c.service, c.i, c."at", c.ok, r.bad, r.since, CASE WHEN r.now = 'open' AND c."at" - r.since >= {rest} THEN 0 ELSE r.good END AS good, CASE WHEN r.now = 'open' AND c."at" - r.since >= {rest} THEN 'half_open' ELSE r.now END AS state, r.now <> 'open' OR c."at" - r.since >= {rest} AS passed FROM r JOIN calls c ON c.service = r.service AND c.i = r.i + 1))
SELECT service, "at", state, passed FROM r WHERE i > 0"""


RESTARTS = f"""WITH RECURSIVE {_CALLS}, r AS (SELECT service, 0 :: BIGINT AS i, 0 :: DOUBLE AS "at", false AS allowed, [] :: DOUBLE[] AS times FROM calls WHERE i = 1 UNION ALL
SELECT service, i, "at", len(times) < 3, CASE WHEN len(times) < 3 THEN list_append(times, "at") ELSE times END FROM (SELECT c.service, c.i, c."at", list_filter(r.times, lambda t: c."at" - t < 86400) AS times FROM r JOIN calls c ON c.service = r.service AND c.i = r.i + 1))
SELECT service, "at", allowed FROM r WHERE i > 0"""


def voice(frames: str) -> str:
    """Frames (stream_id, sample, prob): on from 0.5 on, off once 2,048 samples passed since it fell below 0.35; both padded
    by 1,600."""
    return f"""WITH RECURSIVE f AS ({frames}), n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY sample) AS i FROM f),
r AS (SELECT stream_id, 0 :: BIGINT AS i, false AS active, 0 :: BIGINT AS since, NULL :: VARCHAR AS event, NULL :: BIGINT AS sample FROM n WHERE i = 1 UNION ALL
SELECT stream_id, i, CASE WHEN prob >= 0.5 THEN true WHEN ends THEN false ELSE active END, CASE WHEN prob >= 0.5 OR ends THEN 0 ELSE since END,
 CASE WHEN prob >= 0.5 AND NOT active THEN 'start' WHEN ends THEN 'end' END, CASE WHEN prob >= 0.5 AND NOT active THEN sample - 1600 WHEN ends THEN since + 1600 END
FROM (SELECT *, active AND prob < 0.35 AND sample - since >= 2048 AS ends FROM (SELECT n.stream_id, n.i, n.sample, n.prob, r.active, CASE WHEN r.active AND n.prob < 0.35 AND r.since = 0 THEN n.sample ELSE r.since END AS since FROM r JOIN n ON n.stream_id = r.stream_id AND n.i = r.i + 1)))
SELECT stream_id, event, sample FROM r WHERE event IS NOT NULL"""


VOICE = voice("SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) * 512 AS sample, value / 50 AS prob FROM events")
STREAMED_VOICE = voice("SELECT user_id AS stream_id, event_id * 512 AS sample, value / 50 AS prob FROM events")

RESETS = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS moment, event_type = 'purchase' AS output, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT user_id, 0 :: BIGINT AS i, NULL :: DOUBLE AS moment, NULL :: DOUBLE AS begin, NULL :: DOUBLE AS last, false AS reset, NULL :: DOUBLE AS ended FROM e WHERE i = 1 UNION ALL
SELECT user_id, i, moment, CASE WHEN late THEN moment ELSE begin END, CASE WHEN output THEN moment WHEN late THEN NULL ELSE last END, late, CASE WHEN late THEN begin END
FROM (SELECT *, NOT output AND moment - begin > 43200 AND (last IS NULL OR moment - last > 43200) AS late FROM (SELECT e.user_id, e.i, e.moment, e.output, coalesce(r.begin, e.moment) AS begin, r.last FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, moment AS "at", ended AS begin FROM r WHERE reset"""

# Of every size of block, how many words at the end equal those one block earlier.
TRIMMED = """WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations), t AS (SELECT *, words[greatest(1, len(words) - 299):] AS x FROM c), s AS (SELECT conv_id, turn, x, len(x) AS n, unnest(range(1, len(x) // 2 + 1)) AS size FROM t),
m AS (SELECT conv_id, turn, size, coalesce(min(k), any_value(n) - size) // size + 1 AS copies FROM s LEFT JOIN range(300) p(k) ON k < n - size AND x[n - k] <> x[n - k - size] GROUP BY 1, 2, 3),
b AS (SELECT conv_id, turn, arg_max((copies - 1) * size, copies * size * 1000 - size) AS cut FROM m WHERE copies > 1 GROUP BY 1, 2)
SELECT c.conv_id, c.turn, CASE WHEN cut IS NULL THEN words ELSE words[:len(words) - cut] END AS words FROM c LEFT JOIN b ON b.conv_id = c.conv_id AND b.turn = c.turn"""

# Blank markers as silence, then gaps of four seconds inside a stream and of eight at its end.
SILENCES = BLANKS.replace(
    "\nSELECT stream_id, seq, start", ",\nq AS (SELECT stream_id, seq, start", 1
) + """), m AS (SELECT stream_id, seq, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round("end" * 1000) AS BIGINT) AS end_ms, text, speaker FROM q), g AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY stream_id ORDER BY seq), 0) AS before FROM m)
SELECT * FROM m UNION ALL SELECT stream_id, seq, before, start_ms, '', -2 FROM g WHERE start_ms - before >= 4000 UNION ALL SELECT stream_id, max(seq), max(end_ms), 1000000, '', -2 FROM m GROUP BY stream_id HAVING 1000000 - max(end_ms) >= 8000"""

# A line goes on until another speaker follows a mark; the number of a token's line and its speaker are the state.
LINES = f"""WITH RECURSIVE {SECONDS}, k AS (SELECT *, trim(text, {_SPACES}) IN ('.', '!', '?') AS mark FROM tt),
r AS (SELECT stream_id, seq, 0 :: BIGINT AS line, speaker AS own, mark FROM k WHERE seq = 0 UNION ALL
SELECT stream_id, seq, line + CASE WHEN splits THEN 1 ELSE 0 END, CASE WHEN splits THEN speaker ELSE own END, mark FROM (SELECT k.stream_id, k.seq, k.mark, k.speaker, r.line, r.own, k.speaker <> r.own AND (r.mark OR k.speaker = -2 OR r.own = -2) AS splits FROM r JOIN k ON k.stream_id = r.stream_id AND k.seq = r.seq + 1)),
f AS (SELECT *, seq = min(seq) OVER (PARTITION BY stream_id, line) AS leads FROM r JOIN tt USING (stream_id, seq))
SELECT stream_id, line, min(start) FILTER (leads) AS start, arg_max("end", seq) FILTER (leads OR text <> '') AS "end", string_agg(CASE WHEN leads THEN text ELSE ' ' || text END, '' ORDER BY seq) FILTER (leads OR text <> '') AS text, any_value(own) AS speaker FROM f GROUP BY stream_id, line"""

#: A cue in a file is its number, its times, its text and an empty line.
SUBTITLES = f"WITH {TOKENS} SELECT stream_id, CAST(sum(4 + length(trim(text)) - length(replace(trim(text), chr(10), ''))) AS BIGINT) AS lines, count(*) AS cues FROM timed GROUP BY 1"
